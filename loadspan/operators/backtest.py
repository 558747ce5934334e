"""Rolling-origin backtests: folds, a binned range join, seasonal-naive scores, rollups."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loadspan.config import HORIZON_STEPS, SLOTS_PER_WEEK, STEP_MINUTES, WINDOW_ROWS
from loadspan.operators.forecast import horizon_array, with_horizons
from loadspan.operators.stats import coverage, mae, mape, rmse, scaled
from loadspan.plans.blocks import with_position, with_window_columns
from loadspan.plans.skew import salted_join

TRAIN_ROWS = 2880


def backtest_folds(sizes: DataFrame, weeks: int = 4, test: int = SLOTS_PER_WEEK, train: int = TRAIN_ROWS) -> DataFrame:
    """Index ranges per region and week, computed from the row count ``n`` of each region.

    Week w tests ``[n - (weeks - w + 1) * test, + test)`` and trains on up to ``train`` rows before.
    Folds outside the series are dropped.
    """
    start = F.col("n") - (F.lit(weeks) - F.col("week") + 1) * test
    folds = sizes.select("region", "n", F.explode(F.sequence(F.lit(1), F.lit(weeks))).alias("week"))
    return (
        folds.withColumn("test_start", start)
        .withColumn("test_end", F.col("test_start") + test)
        .withColumn("train_start", F.greatest(F.lit(0), F.col("test_start") - train))
        .filter((F.col("train_start") < F.col("test_start")) & (F.col("test_end") <= F.col("n")))
        .select("region", "week", "train_start", "test_start", "test_end")
    )


def range_join(
    points: DataFrame, ranges: DataFrame, keys: Sequence[str], position: str, start: str, end: str, bin_size: int
) -> DataFrame:
    """Points in ``[start, end)`` of ranges with equal keys, as an equi-join on bins of positions.

    A range is copied to the bins it touches; a join group holds at most ``bin_size`` points, so no
    nested loop runs and no series ends up in one task.
    """
    keys = list(keys)
    bins = F.sequence(F.floor(F.col(start) / bin_size), F.floor((F.col(end) - 1) / bin_size))
    binned = ranges.select("*", F.explode(bins).alias("_bin"))
    inside = (F.col(position) >= F.col(start)) & (F.col(position) < F.col(end))
    return (
        points.withColumn("_bin", F.floor(F.col(position) / bin_size))
        .join(binned, [*keys, "_bin"])
        .filter(inside)
        .drop("_bin")
    )


def fold_rows(series: DataFrame, folds: DataFrame) -> DataFrame:
    """Rows of each fold with their ``part``; a row may train several folds."""
    joined = range_join(series, folds, ["region"], "idx", "train_start", "test_end", SLOTS_PER_WEEK)
    return joined.withColumn("part", F.when(F.col("idx") >= F.col("test_start"), "test").otherwise("train"))


def seasonal_positions(load: DataFrame, season: int = SLOTS_PER_WEEK) -> DataFrame:
    """Rows of a dense load with the value one season earlier, their position, and the length of their series."""
    lagged = with_window_columns(
        load, ["region"], "ts", lambda w: {"seasonal": F.lag("load", season).over(w)}, back=f"{season * STEP_MINUTES} MINUTES",
    )
    return with_position(lagged, ["region"], "ts", size="n")


def in_folds(series: DataFrame, weeks: int = 4, test: int = SLOTS_PER_WEEK, train: int = TRAIN_ROWS) -> DataFrame:
    """Each row once for every fold it is in. A fold follows from the length of the series, so no table of folds is joined."""

    def fold(week: Column) -> Column:
        start = F.col("n") - (weeks - week + 1) * test
        return F.struct(
            week.alias("week"), F.greatest(F.lit(0), start - train).cast("bigint").alias("train_start"),
            start.cast("bigint").alias("test_start"), (start + test).cast("bigint").alias("test_end"),
        )

    def holds(f: Column) -> Column:
        inside = (F.col("idx") >= f["train_start"]) & (F.col("idx") < f["test_end"])
        return inside & (f["train_start"] < f["test_start"]) & (f["test_end"] <= F.col("n"))

    folds = F.filter(F.transform(F.sequence(F.lit(1), F.lit(weeks)), fold), holds)
    rows = series.select("*", F.explode(folds).alias("_f")).select(*series.columns, "_f.*").drop("n")
    return rows.withColumn("part", F.when(F.col("idx") >= F.col("test_start"), "test").otherwise("train"))


def scored_folds(load: DataFrame, weeks: int = 4, season: int = SLOTS_PER_WEEK) -> DataFrame:
    """Fold rows with the forecast of test rows and the seasonal difference of training rows.

    The forecast is the value one season earlier when the fold trains on at least a season, else
    the last training value, of which there is one for each region and fold.
    """
    rows = in_folds(seasonal_positions(load, season), weeks)
    last = rows.filter(F.col("idx") == F.col("test_start") - 1).select("region", "week", F.col("load").alias("last_train"))
    rows = salted_join(rows, last, ["region", "week"], ["ts"], "left")
    enough = F.col("test_start") - F.col("train_start") >= season
    is_test = F.col("part") == "test"
    return rows.withColumn(
        "predicted", F.when(is_test, F.when(enough, F.col("seasonal")).otherwise(F.col("last_train")))
    ).withColumn("naive_error", naive_error(season))


def naive_error(season: int = SLOTS_PER_WEEK) -> Column:
    """Seasonal difference of a training row whose earlier value is in the training rows too."""
    trained = (F.col("part") == "train") & (F.col("idx") - season >= F.col("train_start"))
    return F.when(trained, F.abs(F.col("load") - F.col("seasonal")))


def rolling_backtest(load: DataFrame, weeks: int = 4, predictions: DataFrame | None = None) -> DataFrame:
    """MAPE, MASE and sizes per region and week.

    ``predictions`` (region, ts, predicted) replaces the seasonal-naive forecast of the test rows.
    """
    rows = scored_folds(load, weeks)
    if predictions is not None:
        rows = rows.drop("predicted").join(predictions, ["region", "ts"], "left")
    is_test = F.col("part") == "test"
    y, p = F.when(is_test, F.col("load")), F.when(is_test, F.col("predicted"))
    return rows.groupBy("region", "week").agg(
        mape(y, p).alias("mape"),
        scaled(mae(y, p), F.avg("naive_error")).alias("mase"),
        F.count_if(~is_test).alias("train_size"),
        F.count_if(is_test).alias("test_size"),
    )


def backtest_regions(weekly: DataFrame) -> DataFrame:
    """Mean of the weekly scores per region; undefined scores are skipped."""
    return weekly.groupBy("region").agg(
        F.avg("mape").alias("mape"), F.avg("mase").alias("mase"), F.count(F.lit(1)).alias("weeks_tested")
    )


def backtest_overall(regions: DataFrame, weeks: int = 4) -> DataFrame:
    """Mean of the region means."""
    return regions.agg(
        F.avg("mape").alias("overall_mape"), F.avg("mase").alias("overall_mase"),
        F.count(F.lit(1)).alias("regions_tested"),
    ).withColumn("total_weeks", F.lit(weeks))


def horizon_origins(folds: DataFrame, window: int = WINDOW_ROWS, every: int = 4, limit: int | None = None) -> DataFrame:
    """Forecast origins per fold and horizon: the last index seen before forecasting.

    Origins follow each other ``every`` steps from one window into the test rows; the horizon must
    end inside them. ``limit`` bounds the offset where a caller wants fewer.
    """
    last = F.col("test_end") - F.col("test_start") - F.col("steps") - window - 1
    if limit is not None:
        last = F.least(last, F.lit(limit - 1))
    offsets = F.when(last >= 0, F.sequence(F.lit(0).cast("bigint"), last.cast("bigint"), F.lit(every).cast("bigint")))
    return (
        with_horizons(folds)
        .select("*", F.explode(offsets).alias("_o"))
        .withColumn("origin", F.col("test_start") + F.col("_o") + window - 1)
        .drop("_o", "cadence_minutes")
    )


def horizon_entries(horizons: Mapping[str, int], window: int, every: int, limit: int | None) -> Column:
    """Horizons for which a test row is the target of an origin.

    Origins follow each other ``every`` steps from one window into the test rows, and the horizon must end inside them.
    """
    offset = F.col("idx") - F.col("test_start")
    length = F.col("test_end") - F.col("test_start")

    def holds(h: Column) -> Column:
        origin = offset - h["steps"] - (window - 1)
        ok = (origin >= 0) & (origin % every == 0) & (origin + window + h["steps"] < length)
        return ok if limit is None else ok & (origin < limit)

    return F.filter(horizon_array(horizons), holds)


def horizon_backtest(
    load: DataFrame, weeks: int = 4, every: int = 4, limit: int | None = None, band: float = 0.1,
    horizons: Mapping[str, int] = HORIZON_STEPS, window: int = WINDOW_ROWS,
) -> DataFrame:
    """Errors per region, fold and horizon of the seasonal-naive forecast at all origins.

    The band is ``band`` of the forecast on both sides. Scale of MASE: seasonal differences of the training rows, which are
    summed in the same pass as a group without a horizon. Steps without a value a season earlier have no forecast and are no samples. ``limit`` bounds the origins where a caller wants fewer.
    """
    rows = in_folds(seasonal_positions(load), weeks).withColumn("naive_error", naive_error())
    none = F.array(F.struct(F.lit(None).cast("string").alias("horizon"), F.lit(None).cast("int").alias("steps"),
                            F.lit(None).cast("int").alias("cadence_minutes")))
    entries = F.when(F.col("part") == "train", none).when(F.col("seasonal").isNotNull(), horizon_entries(horizons, window, every, limit))
    each = rows.select("region", "week", "load", F.col("seasonal").alias("predicted"), "naive_error", F.explode(entries).alias("_h"))
    width = F.abs("predicted") * band
    errors = each.select("*", "_h.horizon", "_h.steps").groupBy("region", "week", "horizon", "steps").agg(
        mape("load", "predicted").alias("mape"),
        rmse("load", "predicted").alias("rmse"),
        mae("load", "predicted").alias("_mae"),
        coverage("load", F.col("predicted") - width, F.col("predicted") + width).alias("coverage"),
        F.count(F.lit(1)).alias("samples"), F.avg("naive_error").alias("_naive"),
    )
    scale = F.max(F.when(F.col("horizon").isNull(), F.col("_naive"))).over(Window.partitionBy("region", "week"))
    return errors.withColumn("_scale", scale).filter(F.col("horizon").isNotNull()).select(
        "region", "week", "horizon", "steps", "mape", "rmse", scaled(F.col("_mae"), F.col("_scale")).alias("mase"),
        "coverage", "samples",
    )


def error_by_horizon(errors: DataFrame) -> DataFrame:
    """Means over regions and folds per horizon, then an ``overall`` row with the mean over horizons."""
    measures = ["mape", "rmse", "mase", "coverage"]
    by_horizon = errors.groupBy("horizon").agg(
        *[F.avg(m).alias(m) for m in measures], F.sum("samples").alias("samples")
    )
    overall = by_horizon.agg(*[F.avg(m).alias(m) for m in measures], F.sum("samples").alias("samples"))
    return by_horizon.unionByName(overall.withColumn("horizon", F.lit("overall")))
