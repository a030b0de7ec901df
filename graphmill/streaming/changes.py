"""Change streams: overlay updates, latest state per key, quiet periods and windowed counts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from graphmill.storage import Index, drop_stored, stored


def latest(changes: DataFrame, key: list[str], order: str, tie: str | None = None) -> DataFrame:
    """Of each key its last row, by order and then tie. In a stream, state is one row for each key."""
    rest = [c for c in changes.columns if c not in key]
    by = F.struct(order, tie) if tie else F.col(order)
    return changes.groupBy(*key).agg(F.max_by(F.struct(*rest), by).alias("_v")).select(*key, "_v.*")


def quiet_periods(changes: DataFrame, key: list[str], time: str, gap: str, late: str | None = None) -> DataFrame:
    """(key, start, end, changes): runs of changes with less than a gap between them."""
    if late:
        changes = changes.withWatermark(time, late)
    return changes.groupBy(*key, F.session_window(time, gap).alias("w")).agg(F.count("*").alias("changes")).select(*key, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "changes")


def counts(events: DataFrame, key: list[str], time: str, size: str, slide: str | None = None, late: str | None = None) -> DataFrame:
    """(key, start, events) by tumbling or sliding windows of event time; rows later than `late` are dropped
    in a stream."""
    if late:
        events = events.withWatermark(time, late)
    return events.groupBy(*key, F.window(time, size, slide).alias("w")).agg(F.count("*").alias("events")).select(*key, F.col("w.start").alias("start"), "events")


def update_overlay(index: Index, batch: DataFrame, branch: str, now: int, apply: Callable[[Index, DataFrame, int], None] | None = None, stream: tuple[str, int] | None = None) -> int:
    """One micro-batch of changed paths (path, source, deleted, seq): their new rows are written as an overlay
    batch of their own, sources that did not change are skipped, and the paths, which the state then names with
    the batch, become dirty; a deleted path has no row. Nothing that readers use is overwritten, and until the
    state is added they see the batch before. Gives how many paths changed.

    apply(index, files of the batch, number) writes what else belongs to the batch, before it is seen. stream: name
    and number of the stream's batch; one that is in the index is passed over. Ids come from branch, path, seq
    and content, and the batch's number stays free until the state has it, so that a batch that is delivered again after a
    crash overwrites what it had written with the same rows and ids."""
    if index.delivered(stream):
        return 0
    last = latest(batch, ["path"], "seq")
    if "last_hash" not in batch.columns:  # else the hash of the file's bytes
        last = last.withColumn("last_hash", F.sha2(F.coalesce("source", F.lit("")), 256))
    seen = visible(index).where(F.col("branch") == branch).select("path", F.col("last_hash").alias("_h"), F.lit(True).alias("_in"))
    fresh = stored(last.join(seen, "path", "left").where("(deleted and _in) or (not deleted and (_h is null or _h <> last_hash))").drop("_h", "_in"))
    changed = fresh.count()
    if changed:
        number = index.next_batch()
        own = F.abs(F.xxhash64(F.lit(branch), "path", "seq", "last_hash"))
        files = fresh.where("not deleted").select(own.alias("id"), "path", F.lit(branch).alias("branch"), "language", F.octet_length("source").cast("long").alias("size_bytes"), "last_hash", "source", F.lit(now).cast("long").alias("indexed_at"))
        index.write("files", files, "overlay", number)
        if apply:
            apply(index, files, number)
        index.mark_dirty(fresh, branch, now, number, stream)
    elif stream:
        index._advance(branch, None, stream)
    drop_stored(fresh)
    return changed


def visible(index: Index) -> DataFrame:
    from graphmill.operators.visibility import effective_files

    return effective_files(index.raw("files"), index.dirty_files(), index.baseline_generations())


def follow(index: Index, stream: DataFrame, branch: str, checkpoint: str, clock: Callable[[], int], interval: str | None = None) -> StreamingQuery:
    """Keep an index's overlay up to date with a stream of changes; without an interval, take what there is
    and stop. The stream is named by its checkpoint: a batch that is delivered again is recognised by its number."""
    writer = stream.writeStream.foreachBatch(lambda df, n: update_overlay(index, df, branch, clock(), stream=(checkpoint, n)) and None)
    writer = writer.option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime=interval) if interval else writer.trigger(availableNow=True)).start()


CHANGE = T.StructType([T.StructField("path", T.StringType()), T.StructField("language", T.StringType()), T.StructField("source", T.StringType()), T.StructField("deleted", T.BooleanType()), T.StructField("seq", T.LongType())])


def change_files(spark: SparkSession, path: str, files_per_batch: int = 1000) -> DataFrame:
    """A stream of change rows from JSON files as they arrive below path."""
    return spark.readStream.schema(CHANGE).option("maxFilesPerTrigger", files_per_batch).json(path)
