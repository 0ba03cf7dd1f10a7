import math
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from gapwright.llm import exact_dedup, line_dedup, mixing, packing, quality, scratch, simhash, substring, token_files
from gapwright.llm.text import n_words, whole

from . import brute

TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")


def same(got, want):
    assert Counter(map(tuple, got)) == Counter(map(tuple, want))


def test_exact_dedup(messy, rows, no_docs):
    found = exact_dedup.exact_dedup(messy, carry={"sha": F.sha2("_norm", 256)}).collect()
    same([(r.doc_id, r.keep_id, r.group_size, r.sha) for r in found], brute.exact(rows))
    by_text = defaultdict(list)
    for r in found:
        by_text[r.sha].append(r)
    assert all(sum(r.kept for r in group) == 1 for group in by_text.values())
    assert all(r.doc_id == r.keep_id for r in found if r.kept)
    assert exact_dedup.exact_dedup(no_docs).count() == 0


def test_exact_dedup_hashes_only_what_survives(spark):
    docs = spark.createDataFrame([(k, "x" * k) for k in range(1, 200)] + [(500, "y" * 70), (501, "y" * 70)], "doc_id long, text string")
    found = {r.doc_id: r for r in exact_dedup.exact_dedup(docs).collect()}
    assert found[501].keep_id == 500 and found[501].group_size == 2 and found[70].group_size == 1


def test_line_dedup(messy, rows, no_docs):
    found = line_dedup.line_dedup(messy)
    assert found.columns == ["doc_id", "text", "source", "kept", "n_words", "n_lines", "n_dropped"]
    same([(r.doc_id, r.n_lines, r.n_dropped, r.text) for r in found.collect()], brute.lines(rows))
    assert line_dedup.line_dedup(no_docs).count() == 0


def test_native_operators_run_no_python(messy):
    for df in (exact_dedup.exact_dedup(messy), line_dedup.line_dedup(messy)):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert not any(word in plan for word in ("Python", "Arrow", "Pandas", "CartesianProduct", "NestedLoop"))


def test_simhash(messy, rows, no_docs, monkeypatch):
    want = brute.near(rows)
    for many in (simhash.MANY, 0):  # 0: every key is made finer
        monkeypatch.setattr(simhash.linked, "__defaults__", (simhash.RADIUS, many))
        found = simhash.near_dedup(messy.drop("n_words")).collect()
        same([(r.doc_id, r.fp & (1 << 64) - 1, r.component_id) for r in found], want)
    assert simhash.near_dedup(no_docs).count() == 0


@pytest.mark.parametrize("radius", [0, 1, 2, 3, 5])
def test_bit_slices(radius):
    r = np.random.default_rng(radius)
    for groups in (1, 40):
        base = r.integers(0, 1 << 63, 4, dtype=np.uint64)
        fps = base[r.integers(0, 4, 300)]
        for k in range(300):
            for _ in range(r.integers(0, 6)):
                fps[k] ^= np.uint64(1) << np.uint64(r.integers(0, 64))
        fps, group = np.unique(fps), None
        group = np.sort(r.integers(0, groups, len(fps)))
        got = {(a, b) for i, j in simhash.near_pairs(fps, group, radius) for a, b in zip(i.tolist(), j.tolist(), strict=True)}
        want = {(a, b) for b in range(len(fps)) for a in range(b) if group[a] == group[b] and bin(int(fps[a] ^ fps[b])).count("1") <= radius}
        assert got == want


def test_chain_of_near_fingerprints(spark):
    chain = [0]
    for k in range(60):
        chain.append(chain[-1] ^ (1 << k))
    fps = spark.createDataFrame([(f,) for f in chain], "fp long")
    found = simhash.linked(fps, 2).collect()
    assert {r.fp for r in found} | {0} == set(chain) and {r.root for r in found} == {0}


def test_substring_dedup(messy, rows, no_docs, monkeypatch):
    want = brute.passages(rows)
    for most in (substring.MOST_WORDS, 0):  # 0: every anchor window by window
        monkeypatch.setattr(substring, "MOST_WORDS", most)
        found = substring.substring_dedup(messy)
        assert sorted(found.columns) == sorted(["doc_id", "text", "source", "kept", "n_words", "n_removed"])
        same([(r.doc_id, r.n_words, r.n_removed, r.text) for r in found.collect()], want)
    assert substring.substring_dedup(no_docs).count() == 0


def test_automaton():
    r = np.random.default_rng(2)
    for _ in range(40):
        added = [[b"%d" % x for x in r.integers(0, 3, r.integers(1, 25))] for _ in range(4)]
        automaton = substring.Automaton()
        for words in added:
            automaton.add(words)
        asked = [b"%d" % x for x in r.integers(0, 3, 30)]
        there = {tuple(w[p : p + 5]) for w in added for p in range(len(w) - 4)}
        assert automaton.matched(asked, 5) == [p for p in range(26) if tuple(asked[p : p + 5]) in there]


def sized(docs):
    return docs.withColumn("size", n_words(whole("text")))


def test_mixing(messy, rows, no_docs):
    found = mixing.mix(sized(messy)).collect()
    sizes = defaultdict(int)
    for r in found:
        sizes[r.source] += r.size
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(order)}
    target, open_ones, left = {}, set(order), 1.5 * sum(sizes.values())
    while True:  # the rule as it is written
        share = {s: left * weight[s] / sum(weight[x] for x in open_ones) for s in open_ones}
        above = {s for s in open_ones if share[s] > 2 * sizes[s]}
        if not above:
            target |= share
            break
        for s in above:
            target[s] = 2.0 * sizes[s]
            left -= target[s]
        open_ones -= above
    for r in found:
        assert r.source_size == sizes[r.source] and math.isclose(r.target, target[r.source])
        assert 0 <= r.copies <= 2 and r.taken == r.copies * r.size
    for s in order:
        ratio = target[s] / sizes[s]
        assert abs(sum(r.copies for r in found if r.source == s) - ratio * sum(r.source == s for r in found)) < 1
    key = lambda rs: Counter((r.doc_id, r.text, r.copies) for r in rs)
    assert key(found) == key(mixing.mix(sized(messy).repartition(7)).collect())
    assert len(mixing.emitted(mixing.mix(sized(messy)), ["doc_id"]).collect()) == sum(r.copies for r in found)
    assert mixing.mix(sized(no_docs)).count() == 0


def test_mixing_words_come_near(spark):
    docs = spark.range(20_000).select(F.col("id").alias("doc_id"), F.concat(F.lit("s"), F.col("id") % 4).alias("source"), (1 + F.col("id") * 7 % 900).alias("size"))
    per = mixing.mix(docs).groupBy("source", "target").agg(F.sum("taken").alias("taken")).collect()
    assert all(abs(r.taken - r.target) < 1000 for r in per) and len(per) == 4
    none = docs.limit(5).withColumn("size", F.lit(0).cast("long"))
    assert {(r.target, r.copies) for r in mixing.mix(none).collect()} == {(0.0, 0)}


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(TOKENIZER)  # as the file has it


def test_token_files(spark, messy, rows, no_docs, tokenizer):
    path = scratch.new_folder(spark, "test-tokens")
    token_files.write(messy, path, TOKENIZER, segment=500)
    ordered = sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[1] or ""))
    ids = [[*tokenizer.encode(t or "", add_special_tokens=False).ids, 0] for _, t in ordered]
    want, start = [], 0
    for (i, _), own in zip(ordered, ids, strict=True):
        want.append((i, start, len(own), zlib.crc32(np.array(own, "<u4").tobytes())))
        start += len(own)
    same(token_files.documents(spark, path).collect(), want)
    segments = token_files.segments(spark, path)
    bases = {(r.shard, r.segment): r.base for r in token_files.starts(segments).collect()}
    flat = [x for own in ids for x in own]
    for row in segments.collect():
        levels = [s.asDict() for s in row.levels]
        for at in range(0, row.n_ids, 97):
            assert token_files.access(levels, at) == flat[bases[row.shard, row.segment] + at]
    empty = scratch.new_folder(spark, "test-tokens")
    token_files.write(no_docs, empty, TOKENIZER)
    assert token_files.documents(spark, empty).count() == 0


def test_directly_addressable_codes():
    r = np.random.default_rng(1)
    ids = r.integers(0, 1 << 32, 3000) >> r.integers(0, 32, 3000)
    levels = token_files.encode(ids)
    assert len(levels) == 4 and token_files.decode(levels).tolist() == ids.tolist()
    assert [token_files.access(levels, k) for k in range(3000)] == ids.tolist()


def test_packing(messy, rows, no_docs, tokenizer):
    found = packing.pack(messy, TOKENIZER, capacity=256).collect()
    docs = Counter(tuple([*tokenizer.encode(t or "", add_special_tokens=False).ids, 2]) for _, t in rows)
    want = Counter()
    for ids, n in docs.items():
        cuts = [0, *range(len(ids) % 256 or 256, len(ids) + 1, 256)]
        for k, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
            want[k, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes())] += n
    assert Counter((r.piece, r.start, r.length, r.ids_crc32) for r in found) == want
    sequences = defaultdict(list)
    for r in found:
        sequences[r.sequence_id].append((r.offset, r.length))
    for s in sequences.values():
        at = 0
        for offset, length in sorted(s):
            assert offset == at
            at += length
        assert at <= 256
    assert len(sequences) <= math.ceil(sum(r.length for r in found) / 256) + 2
    assert packing.pack(no_docs, TOKENIZER).count() == 0


def test_plan_packs_any_histogram():
    r = np.random.default_rng(4)
    for capacity, most, scale in ((64, 64, 50), (64, 20, 50), (1024, 1024, 40), (100, 100, 3), (10, 10, 100_000)):
        counts = r.integers(0, scale, capacity + 1)
        counts[most + 1 :] = 0
        counts[0] = 0
        plan = packing.plan(counts, capacity)
        packed = np.zeros_like(counts)
        for lengths, n in plan:
            assert sum(lengths) <= capacity and n > 0
            for x in lengths:
                packed[x] += n
        assert packed.tolist() == counts.tolist()
        best_fit = sum(n for _, n in packing.residual(counts, capacity))
        assert sum(n for _, n in plan) <= best_fit * 1.01 + 2


def labelled(spark):
    good = [(k, " ".join(f"word{(k * 7 + j * j) % 97}" for j in range(60)), 1) for k in range(120)]
    bad = [(1000 + k, " ".join(f"wo{(k + j * 5) % 89}###" for j in range(60)), 0) for k in range(60)]
    docs = spark.createDataFrame([(i, t) for i, t, _ in good + bad], "doc_id long, text string")
    labels = spark.createDataFrame([(i, q) for i, _, q in good + bad] + [(5, 1), (None, 0), (7, None), (9999, 0)], "doc_id long, quality int")
    return docs, labels


def test_quality_rules(spark, messy, rows, no_docs):
    docs, labels = labelled(spark)
    model = quality.train(docs, labels, sample=120)
    seen = quality.scored(docs, model).collect()
    assert np.mean([r.kept == (r.doc_id < 1000) for r in seen if not r.base_failed]) > 0.98
    clean = [r.probability for r in seen if r.doc_id < 1000]
    assert min(clean) > 0.5
    found = quality.scored(messy, model)
    same([(r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in found.collect()], [(i, *brute.base_counts(t)) for i, t in rows])
    for r in found.collect():
        assert r.base_failed == (r.n_words < 10 or 100 * r.n_repeat_words > 20 * r.n_words) and not (r.base_failed and r.kept)
    assert quality.scored(no_docs, model).count() == 0
    assert quality.scored(docs, quality.train(docs, labels.limit(0))).where("NOT kept AND NOT base_failed").count() == 0
    assert quality.train(no_docs, labels).weights.sum() == 0


def test_texts_over_a_chunk_count_alike(monkeypatch):
    from gapwright.llm import ngrams

    text = ("some words # here\n" * 50 + "x" * 300 + " tail é").encode()
    flat = [np.ones(2 * ngrams.BUCKETS), np.ones(ngrams.BUCKETS)]
    whole_one = ngrams.stats([text], *flat)
    monkeypatch.setattr(ngrams, "CHUNK", 64)
    monkeypatch.setattr(ngrams.sliced, "__defaults__", (64,))
    cut = ngrams.stats([text], *flat)
    for name in ("words", "word_chars", "symbols", "dup_lines", "repeat_words"):
        assert getattr(whole_one, name).tolist() == getattr(cut, name).tolist()
