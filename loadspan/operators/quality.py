"""Data-quality checks; each returns a table of counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loadspan.config import STEP_MINUTES
from loadspan.functions.time import minutes_between
from loadspan.plans.ranges import with_previous_in_ranges


def grid_regularity(series: DataFrame, minutes: int = STEP_MINUTES) -> DataFrame:
    """Per region: steps that are not ``minutes`` long, timestamps off the grid, with seconds.

    Rows of equal time are counted before they move; the different times are then dealt by ranges of equal size, so a region with all its times
    in one minute is spread like any other.
    """
    times = series.groupBy("region", "ts").agg(F.count(F.lit(1)).alias("_n"))
    gap = minutes_between("ts", "previous")

    def counted(condition) -> Column:
        return F.sum(F.when(condition, F.col("_n")).otherwise(0))

    irregular = F.col("_n") - 1 + F.when(F.col("previous").isNotNull() & (gap != minutes), 1).otherwise(0)
    return with_previous_in_ranges(times, ["region"], "ts").groupBy("region").agg(
        F.sum("_n").alias("rows"), F.sum(irregular).alias("irregular_steps"),
        counted(F.minute("ts") % minutes != 0).alias("off_grid_minutes"),
        counted(F.extract(F.lit("SECOND"), F.col("ts")) != 0).alias("with_seconds"),
    )


def range_validation(load: DataFrame, weather: DataFrame) -> DataFrame:
    """Violations per rule: nulls, negative load, temperature and humidity out of range, negative irradiance or wind."""
    load_rules = {
        "load_null": F.col("load").isNull(),
        "load_negative": F.col("load") < 0,
    }
    weather_rules = {
        "temperature_null": F.col("temperature").isNull(),
        "temperature_range": ~F.col("temperature").between(-50, 60),
        "humidity_null": F.col("humidity").isNull(),
        "humidity_range": ~F.col("humidity").between(0, 100),
    }
    if "wind_speed" in weather.columns:
        weather_rules["wind_speed_null"] = F.col("wind_speed").isNull()
        weather_rules["wind_speed_negative"] = F.col("wind_speed") < 0

    def counted(df: DataFrame, rules) -> DataFrame:
        counts = df.agg(*[F.count_if(c).alias(n) for n, c in rules.items()])
        return counts.unpivot([], list(rules), "rule", "violations")

    return counted(load, load_rules).unionByName(counted(weather, weather_rules))


def alignment_check(left: DataFrame, right: DataFrame) -> DataFrame:
    """Rows per region present on both sides or on one side only."""
    a = left.select("region", "ts", F.lit(1).alias("_l"))
    b = right.select("region", "ts", F.lit(1).alias("_r"))
    return a.join(b, ["region", "ts"], "full_outer").groupBy("region").agg(
        F.count_if(F.col("_l").isNotNull() & F.col("_r").isNotNull()).alias("matched"),
        F.count_if(F.col("_r").isNull()).alias("left_only"),
        F.count_if(F.col("_l").isNull()).alias("right_only"),
    )


def missing_rows(expected: DataFrame, actual: DataFrame) -> DataFrame:
    """Expected keys the actual table lacks."""
    return expected.select("region", "ts").join(actual.select("region", "ts"), ["region", "ts"], "left_anti")
