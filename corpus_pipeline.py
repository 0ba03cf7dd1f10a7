"""Documents to packed training sequences, in five stages.

Each stage takes what the one before it kept, as written and read again, and
returns whole documents with the columns of the table; the last returns the
pieces of the packed sequences.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gapwright.llm import line_dedup, mixing, packing, quality, simhash
from gapwright.llm.scratch import kept
from gapwright.llm.ship import ship
from gapwright.llm.text import n_words, whole

TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def _aside(docs: DataFrame, names: set[str]) -> tuple[DataFrame, list]:
    """``docs`` with columns named like an operator's results renamed, and how
    to get the original columns back."""
    own = {c: f"_own_{c}" for c in docs.columns if c in names}
    return docs.withColumnsRenamed(own), [F.col(own.get(c, c)).alias(c) for c in docs.columns]


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and the classifier. Null and empty
    texts have no words and fail; repeated rows are judged alike and stay or
    go together; rows with null ids are judged by their text. Very long texts
    are read slice by slice. An empty table gives no rows."""
    ship(spark)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    free, columns = _aside(docs, {*quality.COUNTS, "base_failed", "probability", "kept"})
    return quality.scored(free, quality.train(free, labels)).where("kept").select(*columns)


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without lines that an earlier document holds; ``n_chars``
    is counted again. A null text becomes an empty one. Null ids come after
    all others; rows repeated under one id are one document and lose no line to
    each other. An empty table gives no rows."""
    free, columns = _aside(docs, {"n_lines", "n_dropped"})
    out = line_dedup.line_dedup(free).select(*columns)
    return out.withColumn("n_chars", F.char_length("text").cast("long")) if "n_chars" in docs.columns else out


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates (SimHash of three-word shingles, two
    differing bits or fewer) the document with the smallest id. Documents
    without words have fingerprint zero and are one group; null ids stay only
    where their group has no other. Rows repeated under the id that stays are
    one document and all stay. An empty table gives no rows."""
    ship(spark)
    groups = simhash.near_dedup(docs.select("doc_id", "text"))
    stay = groups.where(F.col("doc_id").eqNullSafe(F.col("component_id"))).select(F.col("doc_id").alias("_stay")).distinct()
    return docs.join(stay, docs["doc_id"].eqNullSafe(F.col("_stay")), "left_semi")


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the mix takes it, those taken never left out.
    Null sources are one source; documents without words may be taken; repeated
    rows are taken each by itself. An empty table gives no rows. Ranks are found on narrow
    rows: in the order of size the longest texts would lie in one partition."""
    free, columns = _aside(docs, {"copies"})
    rows = kept(free.withColumn("_row", F.monotonically_increasing_id()), "mix-input")
    mixed = mixing.mix(rows.select("_row", "doc_id", "source", n_words(whole("text")).alias("size")))
    return mixing.emitted(rows.join(mixed.select("_row", "copies"), "_row"), columns)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents and their places in sequences of 1024 tokens. Null
    and empty texts are the end id alone; repeated rows are packed as often as
    they occur; an empty table gives no rows."""
    ship(spark)
    return packing.pack(docs, TOKENIZER)


STAGES: list[tuple[str, Stage]] = [
    ("quality rules", quality_rules),
    ("line dedup", drop_lines),
    ("near dedup", near_duplicates),
    ("mix sources", mix_sources),
    ("pack sequences", pack_sequences),
]

#: None: SQL can express neither the classifier nor the tokenizer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = kept(docs, name.replace(" ", "-"))
    return docs
