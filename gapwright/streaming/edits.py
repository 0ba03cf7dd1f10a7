"""A stream of field edits kept as the last edit per entity and field.

The state is a table (entity, field_name, value, time, tie) with a row for each
entity and field that was ever edited. Every micro-batch is checked, merged
with the state by event time and published: only the buckets of entities that
changed are written, and the number of the batch is noted with the same switch.
A batch that Spark runs again after a stop is passed over, and late edits lose
against newer ones, so the state depends on the edits alone and not on how they
were cut into files and batches.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from gapwright.operators.upsert import last_edits
from gapwright.sources.publish import mark, publish_changed, recover_tables

Check = Callable[[DataFrame], tuple[DataFrame, DataFrame]]


def absorb(
    batch: DataFrame, number: int, target: str, check: Check, stream: str = "edits", key: str = "facility_id", time: str = "made_at", tie: str = "edit_id"
) -> bool:
    """Bring one batch into ``target`` and its rejected edits into
    ``target_rejected``; false if that was done before. Edits of one entity and
    field are told apart by time and then by ``tie``; an edit given twice
    counts once."""
    spark = batch.sparkSession
    recover_tables(spark, [target, f"{target}_rejected"])
    done = mark(spark, target, stream)
    if done is not None and int(done) >= number:
        return False
    accepted, rejected = check(batch)
    marks = {stream: str(number)}
    # the rejected first: if a run stops in between, the batch comes again and changes nothing there
    refused = rejected.select(tie, key, "field_name", "error", time)
    publish_changed(spark, f"{target}_rejected", _merged(spark, f"{target}_rejected", refused, [tie], time, "field_name"), [tie])
    edits = accepted.select(key, "field_name", "value", time, tie)
    publish_changed(spark, target, _merged(spark, target, edits, [key, "field_name"], time, tie), [key], marks=marks)
    return True


def _merged(spark: SparkSession, target: str, fresh: DataFrame, keys: Sequence[str], time: str, tie: str) -> DataFrame:
    both = spark.table(target).unionByName(fresh) if spark.catalog.tableExists(target) else fresh
    return last_edits(both, keys, [F.desc(time), F.desc(tie)])


def run(edits: DataFrame, target: str, checkpoint: str, check: Check, stream: str = "edits", **columns: str) -> StreamingQuery:
    """Start taking a streaming frame of edits in: all that is there now, then
    the query ends. Run again with the same ``checkpoint`` it goes on where it
    stopped. ``stream`` names the source in the notes of ``target``, which may
    take in several."""

    def each(batch: DataFrame, number: int) -> None:
        absorb(batch, number, target, check, stream, **columns)

    return edits.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def latest(spark: SparkSession, target: str) -> DataFrame:
    """The state: the last accepted edit per entity and field."""
    return spark.table(target)
