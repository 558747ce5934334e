"""The series kept up to date from event files: partial sums by day, of which a run reads only what is new."""

from __future__ import annotations

from datetime import date, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loadspan.config import STEP_MINUTES, WEATHER_COLUMNS
from loadspan.functions.time import floor_15min
from loadspan.sources.daystore import DayStore
from loadspan.sources.stage import staging
from loadspan.sources.tables import Axis, dense_grid, floor_step

EVENT_DDL = "event_id BIGINT, ts TIMESTAMP_NTZ, user_id BIGINT, event_type STRING, value DOUBLE, props STRING"
SUMS_DDL = "region STRING, ts TIMESTAMP_NTZ, load DOUBLE, reading DOUBLE, readings BIGINT, events BIGINT, highest DOUBLE, last TIMESTAMP_NTZ"


def open_series(spark: SparkSession, path: str) -> DayStore:
    return DayStore(spark, path, SUMS_DDL)


def partial_sums(events: DataFrame) -> DataFrame:
    """Sums per region and step that can be added to those of other events."""
    reading = F.get_json_object("props", "$.k").cast("double")
    return events.filter(F.col("event_type").isNotNull() & F.col("ts").isNotNull()).groupBy(
        F.col("event_type").alias("region"), floor_15min("ts").alias("ts")
    ).agg(
        F.sum("value").alias("load"), F.sum(reading).alias("reading"), F.count(reading).alias("readings"), F.count(F.lit(1)).alias("events"),
        F.max("value").alias("highest"), F.max("ts").alias("last"),
    )


def added(sums: DataFrame) -> DataFrame:
    """One row per region and step of several partial sums."""
    return sums.groupBy("region", "ts").agg(
        *[F.sum(c).alias(c) for c in ("load", "reading", "readings", "events")], F.max("highest").alias("highest"), F.max("last").alias("last"),
    )


def add_events(store: DayStore, events: DataFrame, batch: int, files: list[str] | None = None) -> list[date]:
    """Add events to the days they belong to, however late they are, and commit the batch; the days that it rewrote.

    Reads ``events`` once and, of the store, the same days; other days stay as they are. A committed batch changes nothing.
    """
    if batch in store.batches():
        return []
    with staging("increment") as keep:
        new = keep(partial_sums(events))
        days = sorted(r.day for r in new.select(F.to_date("ts").alias("day")).distinct().collect())
        # staged, as the days are read before they are replaced
        merged = keep(added(store.read(days=days).unionByName(new)))
        store.replace_days(merged, batch, files or [], new.agg(F.max("last").alias("v")).first().v)
    return days


def take_in(store: DayStore, folder: str, pattern: str = "*.parquet") -> list[str]:
    """Add the event files of a folder that no earlier run has taken in; their names, empty if there are none."""
    reader = store.spark.read.schema(EVENT_DDL).option("pathGlobFilter", pattern).option("recursiveFileLookup", "true")
    new = sorted(set(reader.parquet(folder).inputFiles()) - store.files())
    if new:
        add_events(store, store.spark.read.schema(EVENT_DDL).parquet(*new), max(store.batches(), default=-1) + 1, new)
    return new


def axis_of(store: DayStore) -> Axis:
    """Time axis from the commits alone."""
    days = store.current()
    if not days:
        raise ValueError("nothing has been taken in")
    return Axis(min(days), floor_step(store.newest(), STEP_MINUTES))


def series_of(store: DayStore, rows: int | None = None) -> DataFrame:
    """Dense load and weather of all regions, or of the last ``rows`` steps, from the folders of their days alone."""
    axis = axis_of(store)
    lo, first = axis.lo, axis.first
    if rows is not None:
        lo = axis.back(rows)
        first = (axis.newest - timedelta(minutes=(rows - 1) * axis.minutes)).date()
    sums = store.read(first, axis.newest.date()).filter(F.col("ts") >= lo)
    observed = sums.select(
        "region", "ts", "load", F.try_divide("reading", "readings").alias("temperature"), F.col("events").cast("double").alias("humidity"),
        F.col("highest").alias("solar_irradiance"),
    )
    return dense_grid(observed, store.regions(), lo, axis.hi, ["load", *WEATHER_COLUMNS])
