"""What streaming jobs keep between batches: the newest interval of every region, tiles of days, late rows."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from loadspan.config import DEFAULTS, SLOTS_PER_DAY, SLOTS_PER_WEEK, STEP_MINUTES, Thresholds
from loadspan.operators.stats import MIN_STD
from loadspan.sources import increments
from loadspan.sources.daystore import DayStore
from loadspan.sources.stage import staging
from loadspan.sources.versions import finished_batches, remove, version_of_batch, write_version
from loadspan.streaming import jobs

LATEST_DDL = "region STRING, ts TIMESTAMP_NTZ, load DOUBLE"
TILE_DDL = "region STRING, ts TIMESTAMP_NTZ, slots ARRAY<STRUCT<slot: INT, load: DOUBLE>>, n BIGINT, total DOUBLE, squares DOUBLE"


def merge_latest(batch: DataFrame, batch_id: int, path: str) -> DataFrame:
    """(region, ts, load): the newest closed interval of every region seen so far, kept as the state after this batch.

    The state before is that of the last finished earlier batch, so a repeated batch makes the same state again.
    """
    spark = batch.sparkSession
    done = [b for b in finished_batches(spark, path) if b < batch_id]
    rows = batch.select("region", "ts", "load")
    if done:
        rows = rows.unionByName(spark.read.schema(LATEST_DDL).parquet(f"{path}/batch={done[-1]:012d}"))
    merged = rows.groupBy("region").agg(F.max("ts").alias("ts"), F.max_by("load", "ts").alias("load"))
    made = f"{path}/batch={batch_id:012d}"
    merged.write.mode("overwrite").parquet(made)
    remove(spark, [f"{path}/batch={b:012d}" for b in done[:-1]])
    return spark.read.schema(LATEST_DDL).parquet(made)


def current_rows(latest: DataFrame) -> DataFrame:
    """A row for every region at the newest closed interval of all; a region that was silent in it has load 0."""
    end = latest.agg(F.max("ts").alias("v")).scalar()
    return latest.select("region", end.alias("ts"), F.when(F.col("ts") == end, F.col("load")).otherwise(0.0).alias("load"))


def document_writer(build: Callable[[DataFrame], DataFrame], path: str) -> Callable[[DataFrame, int], None]:
    """``foreachBatch`` function: merges the state below ``path``/state and writes the documents of the batch as one version.

    A version bears the number of its batch; one that is finished is not written again, so a repeated batch gives one version.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        if batch.isEmpty() or version_of_batch(spark, path, batch_id):
            return
        write_version(build(current_rows(merge_latest(batch, batch_id, f"{path}/state"))), path, batch=batch_id)

    return write


def start_documents(stream: DataFrame, build: Callable[[DataFrame], DataFrame], path: str, checkpoint: str,
                    every: str | None = "15 minutes") -> StreamingQuery:
    """Refresh the snapshot with each batch: ``build`` makes documents of one row for every region ever seen.

    All rows are of the newest closed interval. ``build`` reads histories and statistics itself, so they are those of the time of the
    batch. Readers see the newest version; a batch without closed intervals leaves the current one. ``path`` belongs to one checkpoint.
    """
    return jobs._start(stream, document_writer(build, path), checkpoint, every)


def open_tiles(spark: SparkSession, path: str) -> DayStore:
    return DayStore(spark, path, TILE_DDL)


def add_tiles(store: DayStore, intervals: DataFrame, batch_id: int) -> None:
    """Merge closed intervals into the tiles of their days: a row per region and day, with its slots, their sum and sum of squares.

    An interval that is given again replaces itself.
    """
    if batch_id in store.batches():
        return
    at = (F.hour("ts") * 60 + F.minute("ts")) / STEP_MINUTES
    rows = intervals.select("region", F.to_date("ts").alias("day"), at.cast("int").alias("slot"), "load", F.lit(1).alias("turn"))
    with staging("tiles") as keep:
        rows = keep(rows)
        ends = intervals.agg(F.max("ts").alias("v")).first().v
        days = [r.day for r in rows.select("day").distinct().collect()]
        if not days:
            return
        before = store.read(days=days).select("region", F.to_date("ts").alias("day"), F.explode("slots").alias("s")).select(
            "region", "day", "s.slot", "s.load", F.lit(0).alias("turn"))
        slots = rows.unionByName(before).groupBy("region", "day", "slot").agg(F.max_by("load", "turn").alias("load"))
        tiles = slots.groupBy("region", "day").agg(
            F.array_sort(F.collect_list(F.struct("slot", "load"))).alias("slots"), F.count(F.lit(1)).alias("n"), F.sum("load").alias("total"),
            F.sum(F.col("load") * F.col("load")).alias("squares"),
        ).withColumn("ts", F.col("day").cast("timestamp_ntz"))
        store.replace_days(keep(tiles), batch_id, seen=ends)


def tile_stats(store: DayStore, end: datetime | None = None, rows: int = SLOTS_PER_WEEK) -> DataFrame:
    """(region, mean, std) of the ``rows`` steps up to ``end``, from at most a tile for each region and day.

    Equal to ``region_stats`` of the dense series: steps without a row are 0. The sums of whole days are taken as they are; of the first and the
    last day only the slots inside count.
    """
    end = end or store.newest()
    start = end - timedelta(minutes=(rows - 1) * STEP_MINUTES)
    tiles = store.read(start.date(), end.date())
    at = F.col("ts")
    low, high = F.lit(start.isoformat()).cast("timestamp_ntz"), F.lit(end.isoformat()).cast("timestamp_ntz")
    whole = (at >= low) & (at + F.expr(f"INTERVAL {(SLOTS_PER_DAY - 1) * STEP_MINUTES} MINUTES") <= high)
    time = lambda s: at + F.make_dt_interval(mins=s["slot"] * STEP_MINUTES)
    inside = F.filter("slots", lambda s: time(s).between(low, high))

    def part(known: str, value: Callable[[Column], Column]) -> Column:
        return F.when(whole, F.col(known)).otherwise(F.aggregate(inside, F.lit(0.0), lambda acc, s: acc + value(s["load"])))

    sums = tiles.select("region", part("total", lambda v: v).alias("t"), part("squares", lambda v: v * v).alias("q")).groupBy("region").agg(
        F.sum("t").alias("t"), F.sum("q").alias("q"))
    known = store.regions().join(sums, "region", "left").na.fill(0.0, ["t", "q"])
    std = F.sqrt(F.greatest(F.lit(0.0), F.col("q") - F.col("t") * F.col("t") / rows) / (rows - 1))
    return known.select("region", (F.col("t") / rows).alias("mean"), F.when(std > 0, std).otherwise(MIN_STD).alias("std"))


def start_tiled_anomalies(stream: DataFrame, tiles: str, path: str, checkpoint: str, thresholds: Thresholds = DEFAULTS,
                          every: str | None = "15 minutes", rows: int = SLOTS_PER_WEEK) -> StreamingQuery:
    """Score each batch of closed intervals against the ``rows`` steps up to its newest one.

    The batch is merged into the tiles below ``tiles`` first; statistics come from a tile per region and day, and no raw event is read again.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        store = open_tiles(batch.sparkSession, tiles)
        with staging("closed") as keep:
            closed = keep(batch)
            add_tiles(store, closed, batch_id)
            if store.newest() is not None:
                found = jobs.scored(closed, tile_stats(store, rows=rows), thresholds)
                found.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return jobs._start(stream, write, checkpoint, every)


def series_writer(spark: SparkSession, path: str, late: str, lateness: timedelta = timedelta(minutes=30)) -> Callable[[DataFrame, int], None]:
    """``foreachBatch`` function over raw events: every row goes into the day it belongs to, late ones into a table of their own too.

    A row is late if its time is before the watermark of the batch: the newest time of earlier batches less ``lateness``. Its batch
    is the folder of the late table, so a repeated batch replaces its own rows.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        store = increments.open_series(spark, path)
        if batch_id in store.batches() or batch.isEmpty():
            return
        with staging("arrived") as keep:
            rows = keep(batch)
            newest = store.newest()
            if newest is not None:
                mark = F.lit((newest - lateness).isoformat()).cast("timestamp_ntz")
                rows.filter(F.col("ts") < mark).write.mode("overwrite").parquet(f"{late}/batch={batch_id}")
            increments.add_events(store, rows, batch_id)

    return write


def start_series(stream: DataFrame, path: str, late: str, checkpoint: str, every: str | None = "15 minutes") -> StreamingQuery:
    """Keep the series of a stream of raw events, late rows included, as :func:`series_writer` does."""
    return jobs._start(stream, series_writer(stream.sparkSession, path, late), checkpoint, every)
