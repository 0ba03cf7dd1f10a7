import re
import zlib
from collections import Counter
from functools import lru_cache
from itertools import product

import pytest

from gapwright.llm import turns

from . import brute

FOLDER = "/root/testdata/sf0.001"
COLUMNS = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "sha"]


def damage(rows):
    """rows: (conv, turn, role, text) -> the same after damage, and all ids"""
    out = []
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if kind == 0:
            continue
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        out += [(conv, turn, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
    return out


def faults(rows):
    seen, out = set(), []
    for role, text in rows:
        bare = text.strip(brute.SPACE)
        out.append("blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else "")
        seen.add((role, text))
    return out


def cheapest(rows, found):
    """By the grammar over states, longest sequences included: (cost, audit)."""

    @lru_cache(maxsize=None)
    def best(k, q, inserted):
        ways = []
        after = {"": "u", "s": "u", "u": "a", "a": "u"}[q]
        if k == len(rows):
            if q in ("", "a"):
                ways.append((0, ""))
        else:
            role, fault = rows[k][0][:1], found[k]
            c, a = best(k + 1, q, 0)
            ways.append((c + 3, "D" + a))
            if fault not in ("blank", "duplicate"):
                more = fault == "truncated"
                if role and (role == after or (role, q) == ("s", "")):
                    c, a = best(k + 1, role, 0)
                    ways.append((c + more, "K" + a))
                c, a = best(k + 1, after, 0)
                ways.append((c + 2 + more, "R" + a))
        if inserted < 4:
            c, a = best(k, after, inserted + 1)
            ways.append((c + 2, "I" + a))
        return min(ways, default=(10**9, ""))

    for k in range(len(rows), -1, -1):  # keeps the recursion flat
        for q in ("", "s", "u", "a"):
            best(k, q, 0)
    return best(0, "", 0)


def applied(rows, audit):
    out, k, q = [], 0, ""
    for edit in audit:
        after = {"": "u", "s": "u", "u": "a", "a": "u"}[q]
        role = {"u": "user", "a": "assistant"}[after]
        if edit == "I":
            out.append((role, ""))
            q = after
            continue
        if edit == "K":
            out.append(rows[k])
            q = rows[k][0][0]
        elif edit == "R":
            out.append((role, rows[k][1]))
            q = after
        k += 1
    return out


def plain(rows, ids=None):
    by = {i: [] for i in (ids if ids is not None else [r[0] for r in rows])}
    for conv, turn, role, text in rows:
        by[conv].append((turn, role, text))
    out = []
    for conv, own in by.items():
        own.sort(key=lambda t: (t[0] is not None, t[0] or 0, t[1], turns.hashlib.md5(t[2].encode()).digest()))
        pairs = [(role, text) for _, role, text in own]
        found, numbers = faults(pairs), [t for t, _, _ in own if t is not None]
        gaps = max(numbers) - min(numbers) + 1 - len(set(numbers)) if numbers else 0
        illegal = sum(a[0][:1] + b[0][:1] not in ("su", "ua", "au") for a, b in zip(pairs, pairs[1:]))
        cost, audit = cheapest(tuple(pairs), tuple(found))
        said = "\n".join(f"{role}:{text}" for role, text in applied(pairs, audit))
        out.append((conv, gaps, found.count("blank"), found.count("duplicate"), found.count("truncated"), illegal, cost, audit, brute.sha256(said)))
    return out


def test_every_edit_of_short_conversations():
    """All sequences of edits, judged by the grammar itself."""
    roles = {"s": "system", "u": "user", "a": "assistant", "t": "tool"}
    for n in range(4):
        for signature in product(product("suat", ("ok", "truncated", "blank")), repeat=n):
            if n == 3 and sum(r in "st" for r, _ in signature) > 1:
                continue
            best = None
            for edits in product(product(("", "I", "II"), "KRD"), repeat=n) if n < 3 else product(product(("", "I"), "KRD"), repeat=n):
                for tail in ("", "I", "II"):
                    audit = "".join(i + e for i, e in edits) + tail
                    cost = 2 * audit.count("I")
                    fine = True
                    for (_, e), (_, fault) in zip(edits, signature):
                        cost += {"K": 0, "R": 2, "D": 3}[e] + (fault == "truncated" and e != "D")
                        fine &= fault != "blank" or e == "D"
                    rows = [(roles[r], "x") for r, _ in signature]
                    if fine and (best is None or (cost, audit) < best):
                        try:
                            said = "".join(r[0] for r, _ in applied(rows, audit))
                        except KeyError:  # a role without a place in the grammar
                            continue
                        if re.fullmatch("(s?(ua)+)?", said):
                            best = (cost, audit)
            node = turns.Node(turns.AT_END)
            for role, fault in reversed(signature):
                node = node.before(chr(65 + 4 * turns.FAULTS.index(fault) + "suat".index(role)))
            assert node.tables[0][turns.START] == best, (signature, node.tables[0], best)


def hard_rows():
    r = __import__("random").Random(7)
    texts = ["Fine.", "Cut", "", " \n", None, "Why?", "Fine.", "no mark ", "é!", "x" * 200_000 + "."]
    roles = ["user", "assistant", "system", "user", "assistant", "tool", "", None, "umpire", "User"]
    rows = [(c, r.choice([None, *range(-3, 30)]), r.choice(roles), r.choice(texts)) for c in range(60) for _ in range(r.randint(1, 12))]
    rows += [(None, t, "user", "Hi.") for t in (None, 0, 5)] + [(61, 1, "assistant", "Same.")] * 9 + [(62, -(2**63), "user", "a."), (62, 2**63 - 1, "user", "b.")]
    rows += [(63, t, ("user", "assistant")[t % 3 % 2], r.choice(["Yes.", "No", "Well then."])) for t in range(1500)]
    return rows + rows[:5]


@pytest.fixture(scope="module")
def hard(spark):
    return spark.createDataFrame(hard_rows(), "conv_id long, turn long, role string, text string").repartition(4)


@pytest.mark.parametrize("chunk", [3, 512])
def test_against_plain_version(hard, chunk):
    rows = hard_rows()
    told = turns.damaged(hard)
    plans = turns.audits(told, live_col="live", chunk=chunk).cache()
    sha = {r.conv_id: r.repaired_sha256 for r in turns.digests(turns.repaired(told, plans, live_col="live")).collect()}
    got = [(*tuple(r), sha.get(r.conv_id, brute.sha256(""))) for r in plans.collect()]
    want = plain(damage(rows), dict.fromkeys(r[0] for r in rows))
    want = [tuple(None if n == 1 and v >= 2**63 else v for n, v in enumerate(w)) for w in want]
    assert Counter(got) == Counter(want)


def test_own_names_and_no_rows(spark, hard):
    named = hard.selectExpr("conv_id AS id", "turn AS n", "role AS who", "text AS said", "1 AS cost", "'x' AS audit")
    plans = turns.audits(named, "id", "n", "who", "said")
    out = turns.repaired(named, plans, "id", "n", "who", "said")
    assert plans.columns[0] == "id" and out.columns == ["id", "place", "role", "text"]
    want = {w[0]: w for w in plain([(c, t, r if r is not None else " ", x if x is not None else " ") for c, t, r, x in hard_rows()])}
    got = {r.id: r for r in plans.collect()}
    assert {i: g.audit for i, g in got.items()} == {i: w[7] for i, w in want.items()}
    roles = {}
    for row in sorted(out.collect(), key=lambda r: r.place):
        roles[row.id] = roles.get(row.id, "") + row.role[0]
    assert all(re.fullmatch("(s?(ua)+)?", said) for said in roles.values())
    none = turns.audits(hard.limit(0))
    assert none.count() == 0 and turns.repaired(hard.limit(0), none).count() == 0


def test_a_node_is_made_once(monkeypatch):
    made = []
    before = turns.Node.before
    monkeypatch.setattr(turns.Node, "before", lambda self, symbol: made.append(1) or before(self, symbol))
    import pyarrow as pa

    names = ["conv_id", "line", "signature", "first_turn", "last_turn", "turns", "starts", "ends"]
    signatures = sorted(s[::-1] for s in ["BCBC", "ACBC", "CBC", "BCBC", "BC", "FC"])
    batch = pa.RecordBatch.from_pylist([dict(zip(names, (k, k, s, 0, 0, 1, True, True))) for k, s in enumerate(signatures)])
    list(turns._over_automaton("conv_id")(iter([batch, batch.slice(0, 0)])))
    suffixes = {s[:k] for s in signatures for k in range(1, len(s) + 1)}
    assert len(made) == len(suffixes)


def test_query(spark):
    from gapwright.llm import queries

    rows = [tuple(r) for r in spark.read.parquet(f"{FOLDER}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    got = [tuple(r) for r in queries.QUERIES["op13_turn_repair"](spark, FOLDER).collect()]
    assert Counter(got) == Counter(plain(damage(rows), dict.fromkeys(r[0] for r in rows)))
