import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from gapwright.llm import queries

from . import brute

FOLDER = "/root/testdata/sf0.001"


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    # a column that clashes with results of several operators goes through unchanged
    docs = docs.withColumn("kept", F.lit("own")).withColumn("target", F.lit(7)).withColumn("copies", F.lit(1))
    columns = docs.columns
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality rules", "line dedup", "near dedup", "mix sources", "pack sequences"]
    kept = []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        before = docs
        docs = stage(spark, docs, FOLDER)
        docs.write.parquet(str(tmp_path / str(k)))
        docs = spark.read.parquet(str(tmp_path / str(k)))
        kept.append((before, docs))
    for before, after in kept[:4]:
        assert after.columns == columns and after.where("kept <> 'own' OR target <> 7").count() == 0
    rows = lambda df: [(r.doc_id, r.text) for r in df.collect()]
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{FOLDER}/labels.parquet").collect()}
    right = []
    first, left = rows(kept[0][0]), {i for i, _ in rows(kept[0][1])}
    for i, t in first:
        n, *_, again = brute.base_counts(t)
        if n < 10 or 100 * again > 20 * n:
            assert i not in left
        elif i in labels:
            right.append((i in left) == bool(labels[i]))
    assert sum(right) > 0.9 * len(right)  # fitted on fewer than a hundred rows here
    assert sorted(rows(kept[1][1])) == sorted((i, t) for i, _, _, t in brute.lines(rows(kept[1][0])))
    near = brute.near(rows(kept[2][0]))
    assert {i for i, _ in rows(kept[2][1])} == {i for i, _, c in near if i == c}
    assert {i for i, _ in rows(kept[3][1])} <= {i for i, _ in rows(kept[3][0])}
    packed = docs.agg(F.sum("length").alias("n"), F.countDistinct("sequence_id").alias("s")).first()
    assert packed.s <= packed.n / 1024 * 1.02 + 2


def test_stages_on_messy_rows(spark, messy, no_docs):
    """Null and repeated ids, null and empty texts, ties, a long text, and an
    empty table, each stage by itself; columns of results' names go through."""
    docs = messy.withColumn("component_id", F.lit("own")).withColumn("text_sha256", F.lit("own"))
    rows = lambda df: [(r.doc_id, r.text) for r in df.collect()]
    data = rows(docs)
    for name, stage in corpus_pipeline.STAGES[:4]:
        for given in (docs, docs.limit(0)):
            out = stage(spark, given, FOLDER)
            assert out.columns == docs.columns, name
            assert set(out.where("kept <> 'own' OR component_id <> 'own'").select("doc_id").collect()) == set()
    quality, lines, near, mixed = (stage(spark, docs, FOLDER) for _, stage in corpus_pipeline.STAGES[:4])
    words = {(i, t): brute.base_counts(t) for i, t in data}
    assert all(n >= 10 and 100 * again <= 20 * n for n, *_, again in (words[r] for r in rows(quality)))
    assert sorted(rows(lines), key=str) == sorted(((i, t) for i, _, _, t in brute.lines(data)), key=str)
    stay = {i for i, _, c in brute.near(data) if i == c}
    assert {i for i, _ in rows(near)} == stay
    assert set(rows(mixed)) <= set(data)
    packed = corpus_pipeline.pack_sequences(spark, docs, FOLDER)
    assert {r.doc_id for r in packed.select("doc_id").collect()} == {i for i, _ in data}
    assert corpus_pipeline.pack_sequences(spark, docs.limit(0), FOLDER).count() == 0


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query_reads_all_rows(spark, name):
    number = name.split("_")[0]
    table, key = {"op4": ("pages", "page_id"), "op9": ("pages", "page_id"), "op11": ("embeddings", "vec_id"), "op13": ("conversations", "conv_id")}.get(
        number, ("documents", "doc_id")
    )
    want = spark.read.parquet(f"{FOLDER}/{table}.parquet").select(key).distinct()
    got = queries.QUERIES[name](spark, FOLDER)
    assert got.select(key).distinct().exceptAll(want).count() == 0 and want.exceptAll(got.select(key).distinct()).count() == 0


@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_query_matches_sql(spark, name):
    import duckdb

    with duckdb.connect() as con:
        for table in ("documents", "pages", "labels", "conversations"):
            con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{FOLDER}/{table}.parquet'")
        found = con.execute(queries.ORACLE[name])
        names = [d[0] for d in found.description]
        want = found.fetchall()
    got = queries.QUERIES[name](spark, FOLDER)
    assert sorted(got.columns) == sorted(names)
    assert sorted(map(str, (tuple(r) for r in got.select(*names).collect()))) == sorted(map(str, want))
