"""Files that changed since the last sync, in batch and as a stream.

Events are ``(project_id, path, event_type, ts, event_id)`` with create, update, delete and sync.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from loomdex.operators.upsert import latest_by_key
from loomdex.runtime import scratch_root
from loomdex.streaming.log import BatchLog


def dirty_since_sync(events: DataFrame) -> DataFrame:
    """Distinct files of each project with an event after its last sync."""
    syncs = events.where("event_type = 'sync'").groupBy("project_id").agg(F.max("ts").alias("synced"))
    after = events.where("event_type <> 'sync'").join(syncs, "project_id", "left")
    return after.where("synced is null or ts > synced").select("project_id", "path").distinct()


def dirty_by_window(events: DataFrame, period: str = "10 minutes") -> DataFrame:
    """``(window_start, project_id, n_paths, paths)``: what each periodic sync finds. Works on streams with a watermark too."""
    paths = F.array_sort(F.collect_set("path"))
    grouped = events.groupBy(F.window("ts", period).alias("w"), "project_id").agg(paths.alias("paths"))
    return grouped.select(F.col("w.start").alias("window_start"), "project_id", F.size("paths").cast("long").alias("n_paths"), "paths")


def _latest_events(rows: DataFrame) -> DataFrame:
    """The last event of each file, and the last sync of each project, whose path is null."""
    return latest_by_key(rows, ["project_id", "path"], ["ts", "event_id", "batch_id"])


class DirtyFold:
    """A foreachBatch sink that keeps, in a shared folder, the latest event of each file and the last sync of each project.

    Micro-batches may come in any order and may be repeated: the fold keeps maxima only. A new object on the same
    folder knows what the one before it knew, so a stream that is started again goes on from its checkpoint.
    """

    def __init__(self, spark: SparkSession, folder: str | None = None, project: str = "long"):
        self.spark = spark
        folder = folder or f"{scratch_root(spark)}/loomdex-{uuid.uuid4().hex}/dirty"
        schema = f"project_id {project}, path string, event_type string, ts timestamp, event_id long"
        self.log = BatchLog(spark, folder, schema, _latest_events)

    def __call__(self, batch: DataFrame, batch_id: int) -> None:
        path = F.when(F.col("event_type") != "sync", F.col("path")).alias("path")
        events = batch.select("project_id", path, "event_type", F.col("ts").cast("timestamp").alias("ts"), F.col("event_id").cast("long").alias("event_id"))
        self.log.append(batch_id, latest_by_key(events, ["project_id", "path"], ["ts", "event_id"]))

    def dirty(self) -> DataFrame:
        return dirty_since_sync(self.log.rows())


def watch(events: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str, period: str = "10 minutes") -> StreamingQuery:
    """Start a stream of events into a sink, which gets what has come at every ``period``."""
    return events.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint).trigger(processingTime=period).start()


def periodic_sync(fold: DirtyFold, on_dirty: Callable[[DataFrame], None]) -> Callable[[DataFrame, int], None]:
    """A sink that folds each batch and then hands the files that are dirty, if any, to a sync."""

    def run(batch: DataFrame, batch_id: int) -> None:
        fold(batch, batch_id)
        dirty = fold.dirty()
        if not dirty.isEmpty():
            on_dirty(dirty)

    return run


def drain(events: DataFrame, fold: Callable[[DataFrame, int], None], checkpoint: str) -> None:
    """Run a stream of events through the fold until it has taken all there is: a sync at shutdown."""
    query = events.writeStream.foreachBatch(fold).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()


def drain_dirty(spark: SparkSession, events: DataFrame) -> DataFrame:
    """Write events as an event log, read it as a stream, and return the dirty files that the fold ends with."""
    root = f"{scratch_root(spark)}/loomdex-{uuid.uuid4().hex}"
    events.write.parquet(f"{root}/log")
    stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 2 * spark.sparkContext.defaultParallelism).parquet(f"{root}/log")
    fold = DirtyFold(spark, f"{root}/dirty", events.schema["project_id"].dataType.simpleString())
    drain(stream, fold, f"{root}/state")
    return fold.dirty()
