"""Canonical tables from raw event, order and line tables.

``load(region, ts, load)`` and ``weather(region, ts, temperature, humidity, solar_irradiance)``
are dense: every region has every 15-minute step from the first UTC day to the newest step. Steps without
events have load 0 and no weather.
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass
from datetime import date, datetime, timedelta

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loadspan.config import STEP_MINUTES, WEATHER_COLUMNS
from loadspan.functions.time import floor_15min, floor_day
from loadspan.session import shuffle_width
from loadspan.sources.versions import newest as newest_version
from loadspan.sources.versions import write_version


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


@dataclass(frozen=True)
class Axis:
    """First UTC day and newest step of a table, as constants.

    Constants reach the scans as pushed filters and keep one subquery per use out of the plans.
    """

    first: date
    newest: datetime
    minutes: int = STEP_MINUTES

    @property
    def lo(self) -> Column:
        return ntz(self.first)

    @property
    def hi(self) -> Column:
        """The newest step: the one that holds the newest row, not the end of its day."""
        return ntz(self.newest)

    def back(self, rows: int) -> Column:
        """First step of the last ``rows`` steps."""
        return self.hi - F.expr(f"INTERVAL {(rows - 1) * self.minutes} MINUTES")


def ntz(at: date | datetime) -> Column:
    return F.lit(at.isoformat()).cast("timestamp_ntz")


def floor_step(at: datetime, minutes: int) -> datetime:
    """Begin of the step of the day that holds a time."""
    day = at.replace(hour=0, minute=0, second=0, microsecond=0)
    return day + timedelta(minutes=(at - day) // timedelta(minutes=minutes) * minutes)


def read_axis(facts: DataFrame, ts: str = "ts", minutes: int = STEP_MINUTES) -> Axis:
    """Read the time axis: one row reaches the driver."""
    row = facts.agg(F.min(ts).alias("lo"), F.max(ts).alias("hi")).first()
    if row.lo is None:
        raise ValueError("the table has no timestamps")
    return Axis(row.lo.date(), floor_step(row.hi, minutes), minutes)


def days_before(day: date, days: int) -> date:
    return day - timedelta(days=days)


def region_keys(facts: DataFrame, region: str) -> DataFrame:
    return facts.select(F.col(region).alias("region")).filter(F.col("region").isNotNull()).distinct()


def spine(regions: DataFrame, lo: Column, hi: Column, minutes: int = STEP_MINUTES) -> DataFrame:
    """Every grid step for every region.

    Days are exploded first, into a row per region and day, and these few rows are dealt over the full shuffle width before the
    steps are: adaptive coalescing sees only their bytes and would give the whole expansion to a few tasks. So five regions fill all
    tasks. Steps come second also because a sequence between two constants would be folded into the plan, step by step.
    """
    width = shuffle_width(regions.sparkSession)
    first_day, last_day = (t.cast("date").cast("timestamp_ntz") for t in (lo, hi))
    step = F.expr(f"INTERVAL {minutes} MINUTES")
    last_step = F.col("_day") + F.expr(f"INTERVAL {24 * 60 - minutes} MINUTES")
    return (
        regions.select("region", F.explode(F.sequence(first_day, last_day, F.expr("INTERVAL 1 DAY"))).alias("_day"))
        .repartition(width, "region", "_day")
        .select("region", F.explode(F.sequence(F.col("_day"), last_step, step)).alias("ts"))
        .filter(F.col("ts").between(lo, hi))
    )


def dense_grid(
    facts: DataFrame,
    regions: DataFrame,
    lo: Column,
    hi: Column,
    values: list[str],
    fills: Mapping[str, float] = {"load": 0.0},
    minutes: int = STEP_MINUTES,
) -> DataFrame:
    """Left-join facts keyed by ``(region, ts)`` to the spine. Gaps of the values named in ``fills`` are filled, others stay null."""
    return (
        spine(regions, lo, hi, minutes)
        .join(facts, ["region", "ts"], "left")
        .select("region", "ts", *[F.coalesce(F.col(v), F.lit(fills[v])).alias(v) if v in fills else F.col(v) for v in values])
    )


def observed_load(events: DataFrame) -> DataFrame:
    """Sum of values per region and 15-minute step, observed steps only.

    Rounded to 6 places, so that the order in which partial sums meet does not show.
    """
    return (
        events.groupBy(F.col("event_type").alias("region"), floor_15min("ts").alias("ts"))
        .agg(F.round(F.sum("value"), 6).alias("load"))
    )


def observed_series(events: DataFrame) -> DataFrame:
    """Load and weather per region and observed step, in one pass over the events."""
    reading = F.get_json_object("props", "$.k").cast("double")
    return (
        events.groupBy(F.col("event_type").alias("region"), floor_15min("ts").alias("ts"))
        .agg(
            F.round(F.sum("value"), 6).alias("load"),
            F.round(F.avg(reading), 6).alias("temperature"),
            F.count(F.lit(1)).cast("double").alias("humidity"),
            F.max("value").alias("solar_irradiance"),
        )
    )


def observed_weather(events: DataFrame) -> DataFrame:
    """Weather per region and observed step; the unused sum is pruned from the plan."""
    return observed_series(events).drop("load")


def load_table(events: DataFrame, axis: Axis, trailing_rows: int | None = None) -> DataFrame:
    """Dense load of all regions, or of the last ``trailing_rows`` steps.

    A trailing read filters ``events`` by time in the scan, so old files are not read for it.
    """
    regions = region_keys(events, "event_type")
    lo = axis.lo
    if trailing_rows is not None:
        lo = axis.back(trailing_rows)
        events = events.filter(F.col("ts") >= lo)
    return dense_grid(observed_load(events), regions, lo, axis.hi, ["load"])


def series_table(events: DataFrame, axis: Axis, trailing_rows: int | None = None) -> DataFrame:
    """Dense load and weather side by side: one scan, one aggregation, one join with the grid."""
    regions = region_keys(events, "event_type")
    lo = axis.lo
    if trailing_rows is not None:
        lo = axis.back(trailing_rows)
        events = events.filter(F.col("ts") >= lo)
    return dense_grid(observed_series(events), regions, lo, axis.hi, ["load", *WEATHER_COLUMNS])


def weather_table(events: DataFrame, axis: Axis, trailing_rows: int | None = None) -> DataFrame:
    """Dense weather of all regions, or of the last ``trailing_rows`` steps."""
    regions = region_keys(events, "event_type")
    lo = axis.lo
    if trailing_rows is not None:
        lo = axis.back(trailing_rows)
        events = events.filter(F.col("ts") >= lo)
    return dense_grid(observed_weather(events), regions, lo, axis.hi, WEATHER_COLUMNS)


def observed_daily(orders: DataFrame, customer: DataFrame, nation: DataFrame, region: DataFrame) -> DataFrame:
    """Order value per day and region of the customer.

    Orders are summed per day and nation before nation and region names are joined.
    """
    by_nation = (
        orders.select("o_custkey", "o_orderdate", "o_totalprice")
        .join(customer.select("c_custkey", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey"))
        .groupBy("c_nationkey", floor_day("o_orderdate").alias("ts"))
        .agg(F.sum("o_totalprice").alias("load"))
    )
    names = nation.join(region, F.col("n_regionkey") == F.col("r_regionkey")).select(
        F.col("n_nationkey").alias("c_nationkey"), F.col("r_name").alias("region")
    )
    return by_nation.join(names, "c_nationkey").groupBy("region", "ts").agg(F.round(F.sum("load"), 2).alias("load"))


def daily_table(
    orders: DataFrame, customer: DataFrame, nation: DataFrame, region: DataFrame, axis: Axis,
    latest_only: bool = False,
) -> DataFrame:
    """Dense daily load per region, or that of the last day, which filters the scan of ``orders``.

    Regions are those in which a customer lives, so that ``orders`` is not read for them.
    """
    lo = axis.hi if latest_only else axis.lo
    recent = orders.filter(F.col("o_orderdate") >= lo) if latest_only else orders
    facts = observed_daily(recent, customer, nation, region)
    lived_in = customer.select(F.col("c_nationkey").alias("n_nationkey")).distinct()
    names = nation.join(lived_in, "n_nationkey", "left_semi").join(region, F.col("n_regionkey") == F.col("r_regionkey"))
    regions = region_keys(names, "r_name")
    return dense_grid(facts, regions, lo, axis.hi, ["load"], minutes=axis.minutes)


def flow_edges(
    lineitem: DataFrame, supplier: DataFrame, orders: DataFrame, customer: DataFrame,
    nation: DataFrame, region: DataFrame,
) -> DataFrame:
    """Flow of line value from the supplier's region to the customer's region.

    Summed per pair of nations first; names are joined to those few rows.
    """
    buyers = orders.select("o_orderkey", "o_custkey").join(
        customer.select("c_custkey", F.col("c_nationkey").alias("_to")), F.col("o_custkey") == F.col("c_custkey")
    ).select("o_orderkey", "_to")
    by_nation = (
        lineitem.select("l_orderkey", "l_suppkey", "l_extendedprice")
        .join(supplier.select("s_suppkey", F.col("s_nationkey").alias("_from")),
              F.col("l_suppkey") == F.col("s_suppkey"))
        .join(buyers, F.col("l_orderkey") == F.col("o_orderkey"))
        .groupBy("_from", "_to")
        .agg(F.sum("l_extendedprice").alias("flow"))
    )
    names = nation.join(region, F.col("n_regionkey") == F.col("r_regionkey"))
    start = names.select(F.col("n_nationkey").alias("_from"), F.col("r_name").alias("src"))
    stop = names.select(F.col("n_nationkey").alias("_to"), F.col("r_name").alias("dst"))
    return by_nation.join(start, "_from").join(stop, "_to").groupBy("src", "dst").agg(
        F.round(F.sum("flow"), 2).alias("flow")
    )


def write_series(series: DataFrame, path: str) -> None:
    """Write days of a canonical table into their folders, for readers that prune by time; other days stay as they are.

    A day that is written again is replaced as a whole, so ``series`` has whole days (``sources.increments`` adds to days).
    Rows are ranged by day and region, so that a day lies in few files and a day with many rows in several.
    """
    dated = series.withColumn("day", F.to_date("ts"))
    dated.repartitionByRange("day", "region", "ts").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("day").parquet(path)


def write_regions(series: DataFrame, path: str) -> None:
    """Add the names of a canonical table to those beside it: trailing reads then need no pass over the whole table.

    Names are kept as versions, of which the newest has all, so a region that is silent in ``series`` isn't forgotten.
    """
    names = region_keys(series, "region")
    known = read_regions(series.sparkSession, path)
    write_version(names if known is None else names.unionByName(known).distinct(), path, "parquet")


def read_regions(spark: SparkSession, path: str) -> DataFrame | None:
    """Names written by :func:`write_regions`, or None."""
    made = newest_version(spark, path)
    return made and spark.read.schema("region string").parquet(made)


def axis_of_days(spark: SparkSession, path: str, minutes: int = STEP_MINUTES) -> Axis:
    """Time axis of a table in folders of days: the days from the folders' names, the newest step from the newest folder alone."""
    days = spark.read.parquet(path).agg(F.min("day").alias("lo"), F.max("day").alias("hi")).first()
    if days.lo is None:
        raise ValueError("the table has no days")
    newest = read_series(spark, path, days.hi, days.hi).agg(F.max("ts").alias("v")).first().v
    return Axis(days.lo, floor_step(newest, minutes), minutes)


def trailing_series(spark: SparkSession, path: str, regions: DataFrame, axis: Axis, rows: int) -> DataFrame:
    """The last ``rows`` steps of a dense table in folders of days; only the folders of these days are read.

    Regions of ``regions`` without a row in these days are added with load 0.
    """
    first = axis.newest - timedelta(minutes=(rows - 1) * axis.minutes)
    recent = read_series(spark, path, first.date(), axis.newest.date()).filter(F.col("ts") >= axis.back(rows))
    values = [c for c in recent.columns if c not in ("region", "ts")]
    return dense_grid(recent, regions, axis.back(rows), axis.hi, values, minutes=axis.minutes)


def read_series(spark: SparkSession, path: str, first: date | None = None, last: date | None = None) -> DataFrame:
    """Read a table written by :func:`write_series`; the days bound the folders listed and read."""
    series = spark.read.parquet(path)
    if first is not None:
        series = series.filter(F.col("day") >= F.lit(first))
    if last is not None:
        series = series.filter(F.col("day") <= F.lit(last))
    return series.drop("day")
