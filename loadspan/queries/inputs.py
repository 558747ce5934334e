"""Canonical tables of the given data, as the queries use them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loadspan.config import SLOTS_PER_WEEK
from loadspan.functions.time import steps_after
from loadspan.operators import forecast
from loadspan.sources import tables


# Tables opened and time axes read so far by the running query; cleared before each one.
_tables: dict[tuple[str, str], DataFrame] = {}
_axes: dict[str | tuple[str, str], tables.Axis] = {}


def forget() -> None:
    _tables.clear()
    _axes.clear()


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    """A given table; its footer is read once per query."""
    if (d, name) not in _tables:
        _tables[d, name] = tables.read(spark, d, name)
    return _tables[d, name]


def events(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events")


def regions(spark: SparkSession, d: str) -> DataFrame:
    return tables.region_keys(events(spark, d), "event_type")


def axis(spark: SparkSession, d: str) -> tables.Axis:
    if d not in _axes:
        _axes[d] = tables.read_axis(events(spark, d))
    return _axes[d]


def load(spark: SparkSession, d: str) -> DataFrame:
    return tables.load_table(events(spark, d), axis(spark, d))


def recent(spark: SparkSession, d: str) -> DataFrame:
    return tables.load_table(events(spark, d), axis(spark, d), SLOTS_PER_WEEK)


def series(spark: SparkSession, d: str) -> DataFrame:
    """Load and weather side by side, from one pass over the events."""
    return tables.series_table(events(spark, d), axis(spark, d))


def weather(spark: SparkSession, d: str) -> DataFrame:
    return tables.weather_table(events(spark, d), axis(spark, d))


def end(spark: SparkSession, d: str) -> Column:
    return axis(spark, d).hi


def rounded(df: DataFrame, places: int = 6) -> DataFrame:
    """Round all doubles, so that the order of float sums does not show.

    Means of cents often end exactly on half a unit; the slack sends all of those up, whatever
    their last bit.
    """
    return df.select(
        [F.round(F.col(c) + 1e-9, places).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes]
    )


def latest(spark: SparkSession, d: str) -> DataFrame:
    """Newest row of every region: a one-step trailing read."""
    return tables.load_table(events(spark, d), axis(spark, d), 1)


def two_weeks(spark: SparkSession, d: str) -> DataFrame:
    return tables.load_table(events(spark, d), axis(spark, d), 2 * SLOTS_PER_WEEK)


def path(spark: SparkSession, d: str) -> DataFrame:
    """Seasonal-naive path of 48 hours after the newest step."""
    return forecast.seasonal_naive(recent(spark, d), end(spark, d))


def anchors(spark: SparkSession, d: str) -> DataFrame:
    """Seasonal-naive anchors of every origin in the trailing week."""
    hi = end(spark, d)
    return forecast.seasonal_anchors(two_weeks(spark, d), steps_after(hi, 1 - SLOTS_PER_WEEK), hi)


def latest_anchors(spark: SparkSession, d: str) -> DataFrame:
    """Anchors of the newest origin only, from its path."""
    return forecast.path_anchor(path(spark, d)).withColumn("origin", end(spark, d))


def load_daily(spark: SparkSession, d: str, latest_only: bool = False) -> DataFrame:
    orders, customer, nation, region = (table(spark, d, t) for t in ("orders", "customer", "nation", "region"))
    if (d, "days") not in _axes:
        _axes[d, "days"] = tables.read_axis(orders, "o_orderdate", minutes=24 * 60)
    days = _axes[d, "days"]
    return tables.daily_table(orders, customer, nation, region, days, latest_only)


def latest_weather(spark: SparkSession, d: str) -> DataFrame:
    return tables.weather_table(events(spark, d), axis(spark, d), 1)
