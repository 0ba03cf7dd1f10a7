"""Aggregations and the rankings built on them."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from gapwright.functions.text import is_label


def count_by(df: DataFrame, key: Column, name: str, out: str, limit: int | None = None) -> DataFrame:
    """Rows per non-NULL key, most first, ties by key."""
    counts = df.select(key.alias(name)).filter(F.col(name).isNotNull()).groupBy(name)
    ranked = counts.agg(F.count(F.lit(1)).alias(out)).orderBy(F.desc(out), F.asc(name))
    return ranked if limit is None else ranked.limit(limit)


def distinct_counts(df: DataFrame, total: str, cols: Mapping[str, str]) -> DataFrame:
    """Row count and the number of distinct values of some columns, nulls aside.

    Several distinct counts in one aggregate would multiply every row by their
    number before the shuffle. Here each column is read by itself, made
    distinct in each task first, and counted; the counts are scalar subqueries
    beside the row count, so a column costs its own values and nothing else."""
    counted = {out: df.select(c).filter(F.col(c).isNotNull()).distinct().agg(F.count(F.lit(1))).scalar() for out, c in cols.items()}
    return df.agg(F.count(F.lit(1)).alias(total)).select(total, *[n.alias(out) for out, n in counted.items()])


def conditional_sums(df: DataFrame, tests: Mapping[str, Column], by: Sequence[str] = ()) -> DataFrame:
    """Row count and rows per predicate, all in one pass."""
    return df.groupBy(*by).agg(
        F.count(F.lit(1)).alias("total"),
        *[F.count_if(F.coalesce(t, F.lit(False))).alias(name) for name, t in tests.items()],
    )


CELLS = 1 << 16  # of a histogram


def _scale(v: Column) -> Column:
    """A bucket for each double, never falling as the double grows: 15 to an
    octave, below zero and above, so that a bucket spans 5 % of its value."""
    size = F.floor((F.least(F.log2(F.abs(v)), F.lit(1030.0)) + 1100) * 15).cast("int")
    return F.when(F.isnan(v), F.lit(CELLS)).when(v == 0, F.lit(0)).when(v < 0, -size).otherwise(size)


def median(df: DataFrame, col: str, by: Sequence[str] = ()) -> DataFrame:
    """Exact median per group, for groups of any size.

    Spark's ``percentile`` keeps all distinct values of a group in one buffer.
    Here equal values are counted first, on a shuffle by group and value, and
    the two middle values are found by histograms, each finer than the one
    before: values are counted by bucket (adding up in each task), the counts
    tell in which bucket a middle rank lies, and only the values between that
    bucket's least and largest are counted by the next histogram. The first
    one has buckets of 5 %, the next two cut what is left into 65,536 cells
    each. Between the ends of such a cell lie at most some 100,000 different
    doubles, so the last one counts values. No task ever orders more counts
    than that for a middle rank, whatever the data, and no value is held.
    """
    by = list(by)
    names = [f"__g{i}" for i in range(len(by))]
    v = F.col(col).cast("double")
    values = df.filter(F.col(col).isNotNull()).select(*[F.col(c).alias(n) for c, n in zip(by, names)], v.alias("__v"))
    # the input is read once: all rounds start from one exchange
    rows = values.groupBy(*names, "__v").agg(F.count(F.lit(1)).alias("__n")).withColumn("__s", _scale(F.col("__v")))
    place = [*names, "__s", "__lo", "__hi"]
    share = (F.col("__v") - F.col("__lo")) / (F.col("__hi") - F.col("__lo"))
    cell = F.when(F.col("__hi") > F.col("__lo"), F.least(F.floor(share * CELLS).cast("int"), F.lit(CELLS - 1))).otherwise(0)
    wanted = None
    for step in ("scale", "cell", "cell", "value"):
        bucket = {"scale": F.col("__s"), "cell": cell, "value": F.col("__v")}[step].alias("__b")
        counts = [F.sum("__n").alias("__n"), F.min("__v").alias("__least"), F.max("__v").alias("__most")]
        if wanted is None:
            found = rows.groupBy(*names, bucket).agg(*counts)
            ranks = F.expr("array(struct(0 AS t, (__total - 1) DIV 2 AS r), struct(1 AS t, __total DIV 2 AS r))")
            summed = found.withColumn("__total", F.sum("__n").over(Window.partitionBy(*names))).withColumn("__w", F.explode(ranks))
            held = summed.select("*", F.col("__w.t").alias("__t"), F.col("__w.r").alias("__r"), F.col("__b").alias("__s"))
        else:
            places = wanted.select(*place).distinct()
            between = (F.col("r.__v") >= F.col("p.__lo")) & (F.col("r.__v") <= F.col("p.__hi"))
            inside = rows.alias("r").join(places.alias("p"), _same("r", "p", [*names, "__s"]) & between).select("r.*", "__lo", "__hi")
            found = inside.groupBy(*place, bucket).agg(*counts)
            held = found.alias("f").join(wanted.alias("w"), _same("f", "w", place)).select("f.*", "w.__t", "w.__r")
        ends = F.sum("__n").over(Window.partitionBy(*names, "__t").orderBy("__b"))
        at = held.withColumn("__end", ends).withColumn("__start", F.col("__end") - F.col("__n"))
        hit = at.filter((F.col("__start") <= F.col("__r")) & (F.col("__r") < F.col("__end")))
        wanted = hit.select(*names, "__s", F.col("__least").alias("__lo"), F.col("__most").alias("__hi"), "__t", (F.col("__r") - F.col("__start")).alias("__r"))
    a, b = (F.max(F.when(F.col("__t") == t, F.col("__lo"))) for t in (0, 1))
    middle = wanted.groupBy(*names).agg(a.alias("__a"), b.alias("__b"))
    value = F.when(F.col("__a") == F.col("__b"), F.col("__a")).otherwise(F.col("__a") + (F.col("__b") - F.col("__a")) * 0.5)
    return middle.select(*[F.col(n).alias(c) for c, n in zip(by, names)], value.alias("median"))


def _same(a: str, b: str, columns: Sequence[str]) -> Column:
    return reduce(lambda x, y: x & y, (F.col(f"{a}.{c}").eqNullSafe(F.col(f"{b}.{c}")) for c in columns))


def majority_vote(df: DataFrame, key: str, value: str, weight: str | None = None) -> DataFrame:
    """One value per key: most rows (or the largest sum of ``weight``), ties to
    the smallest value. Votes are counted per (key, value) first, so a hot key
    costs no more than its number of distinct values."""
    counted = F.count(F.lit(1)) if weight is None else F.sum(weight)
    votes = df.groupBy(key, value).agg(counted.alias("__votes"))
    order = Window.partitionBy(key).orderBy(F.desc("__votes"), F.asc(value))
    return votes.withColumn("__rn", F.row_number().over(order)).filter("__rn = 1").select(key, value)


def first_per_key(df: DataFrame, key: str, values: Sequence[str], flag: str, flag_on: str) -> DataFrame:
    """Smallest combination of ``values`` per key, and whether the key has more
    than one ``flag_on`` value. Repeats collapse before the shuffle by key."""
    distinct = df.select(key, *values).distinct()
    return distinct.groupBy(key).agg(
        F.min(F.struct(*values)).alias("__first"),
        (F.min(flag_on) < F.max(flag_on)).alias(flag),
    ).select(key, *[F.col("__first")[v].alias(v) for v in values], flag)


def dedupe(df: DataFrame, cluster: Column, order: Sequence[Column]) -> DataFrame:
    """Best row per cluster, ties to the smallest row over all its columns.
    Spark keeps only each task's best row per cluster before the shuffle
    (window group limit), so a hot cluster stays small."""
    w = Window.partitionBy("__cluster").orderBy(*order, F.struct(*df.columns))
    return (
        df.withColumn("__cluster", cluster)
        .withColumn("__rn", F.row_number().over(w))
        .filter("__rn = 1")
        .drop("__cluster", "__rn")
    )


def rank_in_group(df: DataFrame, by: Sequence[str], order: Sequence[Column], out: str) -> DataFrame:
    return df.withColumn(out, F.row_number().over(Window.partitionBy(*by).orderBy(*order)))


def dense_rank_share(
    df: DataFrame, by: Sequence[str], order: Sequence[Column], value: str, rank: str, share: str
) -> DataFrame:
    """Dense rank within the group and the value's share of the group's sum."""
    group = Window.partitionBy(*by)
    return df.withColumn(rank, F.dense_rank().over(group.orderBy(*order))).withColumn(
        share, F.try_divide(F.col(value), F.sum(value).over(group))
    )


def rank_groups(df: DataFrame, by: str, within: str, out: str) -> DataFrame:
    """Count rows per (within, by) and rank the groups inside ``within``."""
    counts = df.groupBy(within, by).agg(F.count(F.lit(1)).alias("n"))
    return rank_in_group(counts, [within], [F.desc("n"), F.asc(by)], out)


def normalize_by_max(df: DataFrame, col: str, out: str) -> DataFrame:
    """Value over the maximum of the column; NULL when the maximum is 0. The
    maximum is a scalar subquery, so no single task sees all rows."""
    top = df.agg(F.max(F.col(col).cast("double"))).scalar()
    return df.withColumn(out, F.try_divide(F.col(col).cast("double"), F.nullif(top, F.lit(0.0))))


def score_range(df: DataFrame, col: str) -> DataFrame:
    """``min_score, max_score`` of a column, 0 and 1 when there are no rows."""
    return df.agg(
        F.coalesce(F.min(col), F.lit(0.0)).alias("min_score"),
        F.coalesce(F.max(col), F.lit(1.0)).alias("max_score"),
    )


def topk(df: DataFrame, order: Sequence[Column], k: int) -> DataFrame:
    """First ``k`` rows; ``order`` ends in a key so that ties are settled. Each
    task keeps k rows and only those are merged."""
    return df.orderBy(*order).limit(k)


def by_ranking(col: str, ranking: Sequence[str]) -> Column:
    """Sort key that puts values in the given order, others last."""
    out = F.lit(len(ranking) + 1)
    for i, value in reversed(list(enumerate(ranking, 1))):
        out = F.when(F.col(col) == value, i).otherwise(out)
    return out


def order_by_rank(df: DataFrame, col: str, ranking: Sequence[str], *then: str) -> DataFrame:
    return df.orderBy(by_ranking(col, ranking), *[F.asc(c) for c in then])


def options(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Sorted distinct values for a choice list."""
    return df.select(*cols).distinct().orderBy(*cols)


MOST_LABELS = 400  # of a list to choose from


def label_list(df: DataFrame, col: str, limit: int = MOST_LABELS) -> DataFrame:
    """One row holding the first ``limit`` distinct labels in order: the list
    that a question or a choice is made from. Each task keeps ``limit`` labels
    and only those are merged. Operators over many rows use ``labels`` instead."""
    first = labels(df, col).orderBy("label").limit(limit)
    return first.agg(F.array_sort(F.collect_list("label")).alias("labels"))


def labels(df: DataFrame, col: str) -> DataFrame:
    """Distinct trimmed labels, one per row."""
    return df.filter(is_label(F.col(col))).select(F.trim(F.col(col)).alias("label")).distinct()


def top_json(df: DataFrame, order: Sequence[Column], k: int, cols: Sequence[str], out: str) -> DataFrame:
    """One JSON list of the first ``k`` rows, in their order."""
    top = df.orderBy(*order).limit(k)
    # position of each of the k rows; k is a fixed small number
    ranked = top.withColumn("__pos", F.row_number().over(Window.orderBy(*order)))
    rows = F.array_sort(F.collect_list(F.struct("__pos", *cols)))
    bare = F.transform(rows, lambda r: F.struct(*[r[c].alias(c) for c in cols]))
    return ranked.agg(F.to_json(bare).alias(out))


def list_json(df: DataFrame, key: str, value: str, out: str) -> DataFrame:
    """Sorted distinct values per key as a JSON list."""
    distinct = df.select(key, value).distinct()
    return distinct.groupBy(key).agg(F.to_json(F.sort_array(F.collect_list(value))).alias(out))


def canonical_spelling(*sources: DataFrame) -> DataFrame:
    """``raw, canonical`` for one-column frames of labels: per lower-case form
    the exact spelling used most over all sources, ties to the smallest."""
    labels = [s.select(F.trim(F.col(s.columns[0])).alias("raw")) for s in sources]
    stacked = reduce(DataFrame.unionAll, labels).filter(is_label(F.col("raw")))
    usage = stacked.groupBy("raw").agg(F.count(F.lit(1)).alias("__n"))
    keyed = usage.withColumn("__key", F.lower("raw"))
    order = Window.partitionBy("__key").orderBy(F.desc("__n"), F.asc("raw"))
    return keyed.select("raw", F.first("raw").over(order).alias("canonical"))


def attach_stats(df: DataFrame, one_row: DataFrame, name: str) -> DataFrame:
    """Add a one-row aggregate as one struct column, as a scalar subquery."""
    return df.withColumn(name, one_row.select(F.struct(*one_row.columns)).scalar())
