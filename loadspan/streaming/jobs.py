"""Structured Streaming jobs for the 15-minute cycle."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.listener import StreamingQueryListener

from loadspan.config import DEFAULTS, Thresholds
from loadspan.operators.anomaly import severity, zscore
from loadspan.operators.stats import region_stats
from loadspan.sources.increments import EVENT_DDL

LATENESS = "30 minutes"


def event_stream(spark: SparkSession, folder: str, pattern: str = "*.parquet", files_per_batch: int | None = None) -> DataFrame:
    """Stream of the event files that arrive in a folder."""
    reader = spark.readStream.schema(EVENT_DDL).option("pathGlobFilter", pattern)
    if files_per_batch is not None:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(folder)


def stream_load(events: DataFrame, lateness: str = LATENESS) -> DataFrame:
    """15-minute sums per region, each emitted once its interval can no longer change.

    Watermarks need TIMESTAMP, so event time is cast under UTC and cast back. State is one sum per
    open interval and region.
    """
    timed = events.select(F.col("event_type").alias("region"), F.col("ts").cast("timestamp").alias("_t"), "value")
    return (
        timed.withWatermark("_t", lateness)
        .groupBy("region", F.window("_t", "15 minutes").alias("_w"))
        .agg(F.round(F.sum("value"), 6).alias("load"))
        .select("region", F.col("_w.start").cast("timestamp_ntz").alias("ts"), "load")
    )


def stream_anomaly(events: DataFrame, stats: DataFrame, thresholds: Thresholds = DEFAULTS, lateness: str = LATENESS) -> DataFrame:
    """Closed intervals scored against a table of region statistics that is listed once, at the start; findings only.

    :func:`start_anomalies` reads the statistics anew for each batch.
    """
    return scored(stream_load(events, lateness), stats, thresholds)


def scored(load: DataFrame, stats: DataFrame, thresholds: Thresholds = DEFAULTS) -> DataFrame:
    z = zscore(F.col("load"), F.col("mean"), F.col("std"))
    return (
        load.join(stats.select("region", "mean", "std"), "region")
        .withColumn("z_score", z)
        .filter(F.col("z_score") > thresholds.region)
        .select("region", "ts", "load", "z_score", severity(F.col("z_score"), thresholds).alias("severity"))
    )


def open_windows(events: DataFrame, lateness: str = LATENESS) -> DataFrame:
    """15-minute sums that the stream still holds after all of ``events``: those its watermark has not passed.

    The stream emits them with the next rows; until then this batch table is how to see them.
    """
    mark = events.agg((F.max("ts") - F.expr(f"INTERVAL {lateness}")).alias("v")).scalar()
    slot = F.window(F.col("ts").cast("timestamp"), "15 minutes")
    sums = events.groupBy(F.col("event_type").alias("region"), slot.alias("_w")).agg(F.round(F.sum("value"), 6).alias("load"))
    return sums.filter(F.col("_w.end").cast("timestamp_ntz") > mark).select(
        "region", F.col("_w.start").cast("timestamp_ntz").alias("ts"), "load"
    )


def start_anomalies(stream: DataFrame, week: Callable[[], DataFrame], path: str, checkpoint: str,
                    thresholds: Thresholds = DEFAULTS, every: str | None = "15 minutes") -> StreamingQuery:
    """Score each batch of closed intervals against the statistics of ``week()``, which is read anew for every batch.

    A batch has a folder of its own, so one that is repeated after a failure replaces itself.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        found = scored(batch, region_stats(week()), thresholds)
        found.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return _start(stream, write, checkpoint, every)


def _start(stream: DataFrame, write: Callable[[DataFrame, int], None], checkpoint: str, every: str | None) -> StreamingQuery:
    trigger = {"processingTime": every} if every else {"availableNow": True}
    return stream.writeStream.foreachBatch(write).outputMode("append").option("checkpointLocation", checkpoint).trigger(**trigger).start()


def start_table(stream: DataFrame, path: str, checkpoint: str, every: str | None = None) -> StreamingQuery:
    """Append the stream to a Parquet table. ``every`` is a trigger interval; None takes what is there."""
    trigger = {"processingTime": every} if every else {"availableNow": True}
    return (
        stream.writeStream.format("parquet").outputMode("append")
        .option("path", path).option("checkpointLocation", checkpoint).trigger(**trigger).start()
    )


PROGRESS_DDL = "query_id STRING, batch_id BIGINT, rows_read BIGINT, rows_dropped BIGINT"


def progress_row(progress) -> tuple[str, int, int, int]:
    dropped = sum(int(s.get("numRowsDroppedByWatermark", 0)) for s in progress.get("stateOperators", []))
    return str(progress["id"]), int(progress["batchId"]), int(progress["numInputRows"]), dropped


class ProgressLog(StreamingQueryListener):
    """Appends the progress of every batch to a table, so that none is forgotten however long a query runs."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path

    def onQueryStarted(self, event) -> None:  # noqa: N802
        pass

    def onQueryIdle(self, event) -> None:  # noqa: N802
        pass

    def onQueryTerminated(self, event) -> None:  # noqa: N802
        pass

    def onQueryProgress(self, event) -> None:  # noqa: N802
        row = progress_row(json.loads(event.progress.json))
        self.spark.createDataFrame([row], PROGRESS_DDL).coalesce(1).write.mode("append").parquet(self.path)

    def table(self, query: StreamingQuery) -> DataFrame:
        """Rows read and rows dropped behind the watermark, per batch of a query, over all its starts from one checkpoint."""
        rows = self.spark.read.schema(PROGRESS_DDL).parquet(self.path)
        return rows.filter(F.col("query_id") == str(query.id)).drop("query_id")
