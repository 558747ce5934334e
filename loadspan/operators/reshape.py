"""Projections, filters and reshaping of the canonical tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loadspan.functions.time import steps_after
from loadspan.plans.blocks import with_position
from loadspan.plans.skew import salted_join
from loadspan.config import STEP_MINUTES


def region_canonical(df: DataFrame, source: str = "source_name") -> DataFrame:
    """Rename all source names, in order, to ``region_1..n``; a null name stays null.

    One task ranks the distinct names, no other rows; a name with many rows is joined by many tasks.
    """
    names = df.select(F.col(source)).where(F.col(source).isNotNull()).distinct()
    rank = F.row_number().over(Window.orderBy(source))
    mapping = names.select(source, F.concat(F.lit("region_"), rank.cast("string")).alias("region"))
    return salted_join(df, mapping, [source], df.columns, "left")


def region_names(df: DataFrame) -> list[str]:
    """Names of all regions, in order, for the columns of a wide table; a wide table has one for each anyway."""
    return [r.region for r in df.select("region").where(F.col("region").isNotNull()).distinct().orderBy("region").collect()]


def long_to_wide(df: DataFrame, regions: Sequence[str], value: str) -> DataFrame:
    """One column per named region. With the list given, no job runs to find it."""
    return df.groupBy("ts").pivot("region", list(regions)).agg(F.first(value))


def wide_to_long(df: DataFrame, regions: Sequence[str], value: str) -> DataFrame:
    return df.unpivot(["ts"], list(regions), "region", value)


INTEGER_LIMITS = [("tinyint", 2**7), ("smallint", 2**15), ("int", 2**31)]


def integer_ranges(df: DataFrame) -> DataFrame:
    """One row per integer column: min, max and the smallest type with both strictly inside its limits."""
    names = [f.name for f in df.schema if isinstance(f.dataType, (T.IntegralType,))]
    bounds = df.agg(
        *[F.min(n).cast("bigint").alias(f"{n}__min") for n in names],
        *[F.max(n).cast("bigint").alias(f"{n}__max") for n in names],
    )
    entries = F.array(
        *[
            F.struct(
                F.lit(n).alias("column_name"),
                F.col(f"{n}__min").alias("min_value"),
                F.col(f"{n}__max").alias("max_value"),
            )
            for n in names
        ]
    )
    narrow = F.lit("bigint")
    for name, limit in reversed(INTEGER_LIMITS):
        inside = (F.col("min_value") > -limit) & (F.col("max_value") < limit - 1)
        narrow = F.when(inside, name).otherwise(narrow)
    return bounds.select(F.explode(entries).alias("e")).select("e.*").withColumn("narrow_type", narrow)


def narrow_types(df: DataFrame) -> DataFrame:
    """Cast integers to their smallest type and doubles to float.

    The new schema depends on the data, so one small job reads a row per integer column.
    """
    types = {r.column_name: r.narrow_type for r in integer_ranges(df).collect()}
    kinds = {f.name: f.dataType for f in df.schema}

    def cast(name: str) -> Column:
        if name in types:
            # never widen: a column already narrower than bigint keeps its own type
            target = types[name] if types[name] != "bigint" else kinds[name].simpleString()
            return F.col(name).cast(target)
        if isinstance(kinds[name], (T.DoubleType, T.DecimalType)):
            return F.col(name).cast("float")
        return F.col(name)

    return df.select([cast(n).alias(n) for n in df.columns])


def chrono_split(
    df: DataFrame, first: float = 0.8, second: float = 0.9, keys: Sequence[str] = ("region",), order: str = "ts"
) -> DataFrame:
    """Ordered split per series into ``train``, ``validation`` and ``test``."""
    keys = list(keys)
    part = (
        F.when(F.col("idx") < F.floor(F.col("n") * first), "train")
        .when(F.col("idx") < F.floor(F.col("n") * second), "validation")
        .otherwise("test")
    )
    return with_position(df, keys, order, size="n").withColumn("part", part)


def view_filter(load: DataFrame, region: str | None = None) -> DataFrame:
    """Series of one region, or of the total of all regions."""
    if region is not None:
        return load.filter(F.col("region") == region).select("ts", "load")
    return load.groupBy("ts").agg(F.sum("load").alias("load"))


# Defaults shown when no reading is numeric.
WEATHER_DEFAULTS = {"temperature": 20.0, "humidity": 60.0, "solar_irradiance": 0.0}


def coerce_numeric(text: str | Column) -> Column:
    """Number in a text, or null."""
    value = F.col(text) if isinstance(text, str) else text
    return value.try_cast("double")


def coerced_mean(df: DataFrame, keys: Sequence[str], text: str, default: float, name: str) -> DataFrame:
    """Mean of the numeric values of a text column, ``default`` where none is numeric."""
    return df.groupBy(*keys).agg(F.coalesce(F.avg(coerce_numeric(text)), F.lit(default)).alias(name))


def finite_filter(df: DataFrame, value: str, key: str = "ts") -> DataFrame:
    """Drop every row of a timestamp at which any value is missing or not finite."""
    bad = F.col(value).isNull() | F.isnan(value) | (F.abs(F.col(value)) == float("inf"))
    return df.join(df.filter(bad).select(key).distinct(), key, "left_anti")


def target_align(target: DataFrame, features: DataFrame) -> DataFrame:
    """Target rows whose region and timestamp occur among the features."""
    return target.join(features.select("region", "ts"), ["region", "ts"], "left_semi")


def recent_history(load: DataFrame, hours_back: int, end: Column) -> DataFrame:
    """Rows in the closed interval of ``hours_back`` hours up to ``end``."""
    start = steps_after(end, -hours_back * 60 // STEP_MINUTES)
    return load.filter(F.col("ts").between(start, end))


def horizon_dim(spark, horizons: dict[str, int], cadence_minutes: int = STEP_MINUTES) -> DataFrame:
    """Horizon names with their steps; as many rows as names given."""
    return spark.createDataFrame(
        [(h, s, cadence_minutes) for h, s in horizons.items()], "horizon string, steps int, cadence_minutes int"
    )


def history_plus_forecast(history: DataFrame, forecast: DataFrame) -> DataFrame:
    """History and forecast in one table, told apart by ``kind``."""
    return history.select("region", "ts", F.col("load").alias("value"), F.lit("history").alias("kind")).unionByName(
        forecast.select("region", "ts", F.col("point").alias("value"), F.lit("forecast").alias("kind"))
    )
