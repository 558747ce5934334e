"""Feature operators: calendar, lags, hourly resampling, rolling windows, labels, window vectors."""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loadspan.config import (
    FEATURE_COLUMNS, LAG_HOURS, LAG_STEPS, SLOTS_PER_HOUR, STEP_MINUTES, WEATHER_COLUMNS, WINDOW_ROWS,
)
from loadspan.functions.time import calendar, floor_hour
from loadspan.plans.blocks import with_position, with_window_columns
from loadspan.plans.skew import salted_join


def reach(rows: int, minutes: int = STEP_MINUTES) -> str:
    """Interval text covering ``rows`` grid steps."""
    return f"{rows * minutes} MINUTES"


def calendar_features(df: DataFrame, ts: str = "ts") -> DataFrame:
    return df.withColumns(calendar(ts))


def lag_features(
    load: DataFrame, lags: Mapping[str, int] = LAG_STEPS, value: str = "load", minutes: int = STEP_MINUTES
) -> DataFrame:
    """One column per lag; row lags equal time lags only on a dense grid."""
    return with_window_columns(
        load, ["region"], "ts",
        lambda w: {name: F.lag(value, rows).over(w) for name, rows in lags.items()},
        back=reach(max(lags.values()), minutes),
    )


def lead_target(load: DataFrame, steps: int, value: str = "load", name: str = "target", gap: int = 0) -> DataFrame:
    """Label ``steps`` rows ahead; ``gap=1`` looks one further row ahead."""
    ahead = steps + gap
    return with_window_columns(
        load, ["region"], "ts", lambda w: {name: F.lead(value, ahead).over(w)}, ahead=reach(ahead)
    )


def hourly_resample(df: DataFrame, values: Iterable[str]) -> DataFrame:
    """Hourly means per region; a window aggregate with map-side partial sums."""
    return df.groupBy("region", floor_hour("ts").alias("ts")).agg(
        *[F.avg(v).alias(v) for v in values]
    )


def weather_join(features: DataFrame, weather: DataFrame) -> DataFrame:
    return features.join(weather, ["region", "ts"], "left")


def weather_means(series: DataFrame, share: float = 1.0, columns: Iterable[str] = WEATHER_COLUMNS) -> DataFrame:
    """(region, columns): mean readings over the first ``share`` of each series, so that later rows tell a learner nothing."""
    if share < 1:
        series = with_position(series, ["region"], "ts", size="_n").filter(F.col("idx") < F.floor(F.col("_n") * share))
    return series.groupBy("region").agg(*[F.avg(c).alias(c) for c in columns])


def impute_weather(series: DataFrame, means: DataFrame | None = None, columns: Iterable[str] = WEATHER_COLUMNS) -> DataFrame:
    """Missing readings become the mean of their region, for learners that need a row for every step; null where a region has none.

    ``means`` are those of :func:`weather_means`, of a learner's training rows; without them, those of all of ``series``.
    """
    columns = list(columns)
    means = weather_means(series, columns=columns) if means is None else means
    named = means.select("region", *[F.col(c).alias(f"_{c}") for c in columns])
    filled = salted_join(series, named, ["region"], ["ts"], "left")
    return filled.select([F.coalesce(c, f"_{c}").alias(c) if c in columns else F.col(c) for c in series.columns])


def drop_warmup(features: DataFrame) -> DataFrame:
    """Drop rows with any missing feature, which is the warm-up of the longest lag."""
    return features.na.drop("any")


def quarter_hour_features(load: DataFrame, weather: DataFrame | None = None) -> DataFrame:
    """The 13 features at 15-minute cadence next to the load itself.

    Without ``weather`` the weather columns come with ``load`` (``tables.series_table``) and no
    join runs.
    """
    features = calendar_features(lag_features(load))
    if weather is not None:
        features = weather_join(features, weather)
    return drop_warmup(features).select("region", "ts", "load", *FEATURE_COLUMNS)


def hourly_features(load: DataFrame, weather: DataFrame | None = None) -> DataFrame:
    """The same features at hourly cadence, from hourly means."""
    if weather is None:
        features = calendar_features(lag_features(hourly_resample(load, ["load", *WEATHER_COLUMNS]), LAG_HOURS, minutes=60))
    else:
        lagged = lag_features(hourly_resample(load, ["load"]), LAG_HOURS, minutes=60)
        features = weather_join(calendar_features(lagged), hourly_resample(weather, WEATHER_COLUMNS))
    return drop_warmup(features).select("region", "ts", "load", *FEATURE_COLUMNS)


def rolling_mean(df: DataFrame, rows: int, value: str, name: str, keys: tuple[str, ...] = ("region",)) -> DataFrame:
    """Mean of the last ``rows`` rows, null until the frame is full."""

    def columns(w):
        frame = w.rowsBetween(-(rows - 1), 0)
        full = F.count(value).over(frame) == rows
        return {name: F.when(full, F.avg(value).over(frame))}

    return with_window_columns(df, list(keys), "ts", columns, back=reach(rows - 1))


def rolling_features(load: DataFrame, windows: Iterable[int], lag_hours: Iterable[int]) -> DataFrame:
    """Rolling means over ``windows`` rows and lags of ``lag_hours``, all in one pass."""
    windows, lag_hours = list(windows), list(lag_hours)

    def columns(w) -> dict[str, Column]:
        out: dict[str, Column] = {}
        for rows in windows:
            frame = w.rowsBetween(-(rows - 1), 0)
            full = F.count("load").over(frame) == rows
            out[f"mean_{rows}"] = F.when(full, F.avg("load").over(frame))
        for hours in lag_hours:
            out[f"lag_{hours}h"] = F.lag("load", hours * SLOTS_PER_HOUR).over(w)
        return out

    rows = max([*(r - 1 for r in windows), *(h * SLOTS_PER_HOUR for h in lag_hours)])
    return with_window_columns(load, ["region"], "ts", columns, back=reach(rows))


def sliding_window_array(
    df: DataFrame, values: list[str], size: int = WINDOW_ROWS, name: str = "window", include_current: bool = False
) -> DataFrame:
    """Array of the last ``size`` rows before the current one, each an array of ``values``.

    ``include_current`` ends the frame at the current row. Incomplete frames are kept; filter on
    ``size(window)`` or use :func:`left_pad_window`.
    """
    first, last = (-(size - 1), 0) if include_current else (-size, -1)
    row = F.array(*[F.col(v).cast("double") for v in values])
    return with_window_columns(
        df, ["region"], "ts", lambda w: {name: F.collect_list(row).over(w.rowsBetween(first, last))},
        back=reach(size), days=7, full_width=True,
    )


def full_windows(df: DataFrame, size: int = WINDOW_ROWS, name: str = "window") -> DataFrame:
    return df.filter(F.size(name) == size)


def flatten_window(window: str | Column) -> Column:
    return F.flatten(window)


def left_pad_window(flat: Column, width: int) -> Column:
    """Zeros in front, up to ``width`` values."""
    return F.concat(F.array_repeat(F.lit(0.0), width - F.size(flat)), flat)
