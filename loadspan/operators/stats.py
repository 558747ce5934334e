"""Aggregations: statistics, totals, shares, resampling, exact quantiles, error measures."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loadspan.functions.time import as_col, floor_day
from loadspan.plans.blocks import with_window_columns
from loadspan.plans.skew import salted_join, with_global_rank

MIN_STD = 1e-6


def safe_std(value: str | Column) -> Column:
    """Sample standard deviation; a missing or zero one becomes 1e-6."""
    std = F.stddev_samp(value)
    return F.when(std > 0, std).otherwise(F.lit(MIN_STD))


def region_stats(window: DataFrame, value: str = "load") -> DataFrame:
    return window.groupBy("region").agg(F.avg(value).alias("mean"), safe_std(value).alias("std"))


def system_total(load: DataFrame) -> DataFrame:
    """Sum over regions per timestamp: one row per timestamp after the map-side sums."""
    return load.groupBy("ts").agg(F.sum("load").alias("total"))


def load_share(load: DataFrame) -> DataFrame:
    """Share of the total at each timestamp, 0 where the total is not positive.

    ``share`` and ``share_percent`` are null-free; ``ratio`` is null where the total is 0.
    """
    shared = with_share(load.join(system_total(load), "ts"))
    return shared.select("region", "ts", "load", "total", "share", "share_percent", "ratio")


def with_share(rows: DataFrame) -> DataFrame:
    """Rows with ``load`` and ``total``, and their shares."""
    positive = F.col("total") > 0
    return rows.select(
        "*",
        F.when(positive, F.col("load") / F.col("total")).otherwise(0.0).alias("share"),
        F.when(positive, F.col("load") / F.col("total") * 100).otherwise(0.0).alias("share_percent"),
        F.try_divide(F.col("load"), F.col("total")).alias("ratio"),
    )


def share_stats(shares: DataFrame, stats: str = "observed") -> DataFrame:
    """Mean and deviation of each region's share history, with fallbacks.

    A missing mean falls back to 1/n, a missing or non-positive deviation to a fifth of the mean.
    ``stats="uniform"`` ignores the history: mean 1/n, deviation 0.025.
    """
    raw = shares.groupBy("region").agg(F.avg("ratio").alias("m"), F.stddev_samp("ratio").alias("s"))
    uniform = F.lit(1.0) / raw.agg(F.count(F.lit(1)).alias("n")).scalar()
    if stats == "uniform":
        return raw.select("region", uniform.alias("share_mean"), F.lit(0.025).alias("share_std"))
    mean = F.when((F.col("m") > 0) & F.col("s").isNotNull(), F.col("m")).otherwise(uniform)
    return raw.select("region", mean.alias("share_mean"), "s").select(
        "region",
        "share_mean",
        F.greatest(
            F.when(F.col("s") > 0, F.col("s")).otherwise(F.col("share_mean") * 0.2), F.lit(MIN_STD)
        ).alias("share_std"),
    )


def snapshot_kpis(latest: DataFrame, anchors: DataFrame, anomalies: DataFrame, horizon: str = "1h") -> DataFrame:
    """Total load, forecast total one hour ahead with its change, region and anomaly counts."""
    now = latest.agg(F.sum("load").alias("total_load"), F.count(F.lit(1)).alias("regions"))
    ahead = anchors.agg(F.sum(F.when(F.col("horizon") == horizon, F.col("point"))).alias("v")).scalar()
    found = anomalies.agg(F.count(F.lit(1)).alias("v")).scalar()
    return now.select(
        "total_load",
        ahead.alias("forecast_1h"),
        (ahead - F.col("total_load")).alias("change_1h"),
        "regions",
        found.alias("anomalies"),
    )


def exact_quantile(
    df: DataFrame, keys: Sequence[str], value: str, p: float, name: str = "quantile", accuracy: int = 10_000
) -> DataFrame:
    """Exact linearly interpolated quantile per group, without holding a group in one task.

    ``percentile`` keeps all distinct values of a group in one task. Here an approximate quantile
    cuts each group into three slices around the target; exact counts per slice say which slice
    holds the wanted ranks, and only that slice is ranked. The cut decides how the work spreads,
    never the result: a rank outside the middle slice is found in an outer one.
    """
    keys = list(keys)
    counts = df.filter(F.col(value).isNotNull()).groupBy(*keys, F.col(value).alias("_v")).agg(
        F.count(F.lit(1)).alias("_n")
    )
    margin = 2.0 / accuracy
    cuts = df.groupBy(*keys).agg(
        F.percentile_approx(value, [max(p - margin, 0.0), min(p + margin, 1.0)], accuracy).alias("_cuts")
    )
    sliced = salted_join(counts, cuts, keys, ["_v"]).select(
        *keys, "_v", "_n",
        F.when(F.col("_v") < F.col("_cuts")[0], 0).when(F.col("_v") <= F.col("_cuts")[1], 1).otherwise(2)
        .alias("_slice"),
    )
    sizes = sliced.groupBy(*keys).agg(
        F.sum(F.when(F.col("_slice") == 0, F.col("_n")).otherwise(0)).alias("_n0"),
        F.sum(F.when(F.col("_slice") == 1, F.col("_n")).otherwise(0)).alias("_n1"),
        F.sum("_n").alias("_total"),
    )
    rank = (F.col("_total") - 1) * F.lit(p)
    before = F.when(F.col("_slice") == 0, F.lit(0)).when(F.col("_slice") == 1, F.col("_n0")).otherwise(
        F.col("_n0") + F.col("_n1")
    )
    size = F.when(F.col("_slice") == 0, F.col("_n0")).when(F.col("_slice") == 1, F.col("_n1")).otherwise(
        F.col("_total") - F.col("_n0") - F.col("_n1")
    )
    wanted = (
        salted_join(sliced, sizes, keys, ["_v"])
        .withColumn("_rank", rank)
        .withColumn("_before", before)
        .filter((F.ceil("_rank") >= F.col("_before")) & (F.floor("_rank") < F.col("_before") + size))
    )
    running = Window.partitionBy(*keys, "_slice").orderBy("_v").rowsBetween(Window.unboundedPreceding, 0)
    placed = wanted.withColumn("_upto", F.col("_before") + F.sum("_n").over(running))
    at = lambda r: F.min(F.when(F.col("_upto") > r, F.col("_v")))
    lower, upper = at(F.floor("_rank")), at(F.ceil("_rank"))
    weight = F.first("_rank") - F.floor(F.first("_rank"))
    return placed.groupBy(*keys).agg((lower + (upper - lower) * weight).alias(name))


# Error measures: aggregate columns, null where undefined so that means skip them.


def mape(actual: str | Column, predicted: str | Column) -> Column:
    y, p = as_col(actual), as_col(predicted)
    return F.avg(F.when(y != 0, F.abs((y - p) / F.when(y != 0, y)))) * 100


def mae(actual: str | Column, predicted: str | Column) -> Column:
    return F.avg(F.abs(as_col(actual) - as_col(predicted)))


def rmse(actual: str | Column, predicted: str | Column) -> Column:
    err = as_col(actual) - as_col(predicted)
    return F.sqrt(F.avg(err * err))


def scaled(model_error: Column, naive_error: Column) -> Column:
    """MASE from its two parts; null when the naive error is 0 or missing."""
    return F.when(naive_error > 0, model_error / naive_error)


def coverage(actual: str | Column, lower: str | Column, upper: str | Column) -> Column:
    inside = as_col(actual).between(as_col(lower), as_col(upper))
    return F.coalesce(F.avg(F.when(inside, 1.0).otherwise(0.0)) * 100, F.lit(0.0))


def daily_peak_trough(load: DataFrame) -> DataFrame:
    """Daily peak, trough and load factor with their change to the day before, in percent."""
    days = load.groupBy("region", floor_day("ts").alias("ts")).agg(
        F.max("load").alias("peak"),
        F.min("load").alias("trough"),
        F.try_divide(F.avg("load"), F.max("load")).alias("load_factor"),
    )

    def change(w):
        def percent(name: str) -> Column:
            before = F.lag(name).over(w)
            return F.try_divide(F.col(name) - before, before) * 100

        return {f"{n}_change": percent(n) for n in ("peak", "trough", "load_factor")}

    return with_window_columns(days, ["region"], "ts", change, back="1 DAY", days=366)


def error_histogram(errors: DataFrame, value: str, bins: int = 30) -> DataFrame:
    """Counts in ``bins`` equal bins between the smallest and the largest error."""
    span = errors.agg(F.min(value).alias("lo"), F.max(value).alias("hi"))
    lo, hi = span.select("lo").scalar(), span.select("hi").scalar()
    width = (hi - lo) / bins
    bin_no = F.least(F.lit(bins - 1), F.floor(F.coalesce(F.try_divide(F.col(value) - lo, width), F.lit(0.0))))
    return errors.filter(F.col(value).isNotNull()).groupBy(bin_no.cast("int").alias("bin")).agg(
        F.count(F.lit(1)).alias("n")
    )


def region_and_total(load: DataFrame) -> DataFrame:
    """Statistics per region plus a TOTAL row over the system total."""
    total = system_total(load).select(F.lit("TOTAL").alias("region"), "ts", F.col("total").alias("load"))
    both = load.select("region", "ts", "load").unionByName(total)
    return both.groupBy("region").agg(
        F.avg("load").alias("mean"),
        safe_std("load").alias("std"),
        F.max("load").alias("peak"),
        F.sum("load").alias("energy"),
    )


def regional_mean_compare(load: DataFrame) -> DataFrame:
    """Mean load per region with its rank, highest first."""
    means = load.groupBy("region").agg(F.avg("load").alias("mean"))
    return with_global_rank(means, F.round("mean", 6))


def weather_average(latest_weather: DataFrame) -> DataFrame:
    """Null-safe mean over regions, 0 when nothing is numeric."""
    names = ["temperature", "humidity", "solar_irradiance"]
    return latest_weather.agg(
        *[F.coalesce(F.avg(F.col(n).cast("string").try_cast("double")), F.lit(0.0)).alias(n) for n in names]
    )
