"""Deduplication of lines across documents."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gapwright.llm.ranks import salted_join
from gapwright.llm.text import line_key, whole

LEAST_CHARS = 10
LEAST_DOCS = 2


def line_dedup(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_chars: int = LEAST_CHARS, least_docs: int = LEAST_DOCS
) -> DataFrame:
    """``docs`` with the text rid of repeated lines, and ``n_lines`` and
    ``n_dropped`` added.

    Lines are split at line feeds and normalised (white space off both ends,
    A-Z in lower case). The different keys of a document, of at least
    ``least_chars`` code points, are exploded as 128-bit hashes; documents per
    hash are counted, with the smallest id that holds it. Of a key found in
    ``least_docs`` documents or more, only the lines in that document stay.
    The other lines are joined again in their order. Counting adds up before
    the shuffle, so a line found everywhere is one row from each task; the
    join that marks positions carries hashes, not lines, and is salted.

    Null text is one empty line and becomes an empty text. Repeated rows hold
    one id, so they lose nothing to each other, though each counts towards
    ``least_docs``. Rows with a null id come after all others; among themselves
    they are one document.
    An empty table gives no rows. Other columns pass through, whatever their
    names (names that begin with an underscore are taken).
    """
    key = F.transform(F.split(whole(text_col), "\n"), line_key)
    digests = F.transform(key, lambda k: F.when(F.char_length(k) >= least_chars, F.unhex(F.md5(k))))
    source = docs.select(
        F.col(id_col).alias("_id"), F.xxhash64(whole(text_col)).alias("_text"), digests.alias("_digests")
    )
    counts = (
        source.select("_id", F.explode(F.array_distinct("_digests")).alias("_hash"))
        .where("_hash IS NOT NULL")
        .groupBy("_hash")
        .agg(
            F.min("_id").alias("_keeper"), F.max("_id").alias("_last"), F.count(F.lit(1)).alias("_docs"),
            F.max(F.col("_id").isNull()).alias("_some_null"),
        )
    )
    several = (F.col("_keeper") != F.col("_last")) | (F.col("_some_null") & F.col("_keeper").isNotNull())
    shared = counts.where((F.col("_docs") >= least_docs) & several)
    placed = source.select("_id", "_text", F.posexplode("_digests").alias("_pos", "_hash")).where("_hash IS NOT NULL")
    drops = (
        salted_join(placed, shared.select("_hash", "_keeper"), "_hash")
        .where(~F.col("_id").eqNullSafe(F.col("_keeper")))
        .groupBy("_id", "_text")
        .agg(F.collect_set("_pos").alias("_drops"))
    )
    lines = docs.select(
        "*", F.col(id_col).alias("_id"), F.xxhash64(whole(text_col)).alias("_text"), F.split(whole(text_col), "\n").alias("_lines")
    ).drop(text_col)
    drops = drops.withColumnsRenamed({"_id": "_drop_id", "_text": "_drop_text"})
    out = lines.join(drops, lines["_id"].eqNullSafe(drops["_drop_id"]) & (lines["_text"] == drops["_drop_text"]), "left")
    gone = F.coalesce("_drops", F.array().cast("array<int>"))
    stay = F.array_except(F.sequence(F.lit(0), F.size("_lines") - 1), gone)
    text = F.array_join(F.transform(stay, lambda i: F.get(F.col("_lines"), i)), "\n")
    counted = {"n_lines": F.size("_lines").cast("long"), "n_dropped": F.size(gone).cast("long")}
    return out.select(
        *[text.alias(c) if c == text_col else F.col(c) for c in docs.columns if c not in counted],
        *[c.alias(n) for n, c in counted.items()],
    )
