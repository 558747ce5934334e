"""Forecast tables in long form ``(region, step, ts, point)`` and operators on their paths."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loadspan.config import HORIZON_STEPS, SLOTS_PER_WEEK, STEP_MINUTES, WINDOW_ROWS
from loadspan.functions.time import as_col, minutes_between, steps_after
from loadspan.operators.stats import exact_quantile
from loadspan.plans.blocks import with_window_columns
from loadspan.plans.skew import salted_join

HORIZON_MINUTES = {name: steps * STEP_MINUTES for name, steps in HORIZON_STEPS.items()}


def horizon_array(horizons: Mapping[str, int] = HORIZON_STEPS, cadence: int = STEP_MINUTES) -> Column:
    """The horizon table as an array literal, so that pairing rows with horizons needs no join."""
    return F.array(
        *[
            F.struct(F.lit(h).alias("horizon"), F.lit(s).alias("steps"), F.lit(cadence).alias("cadence_minutes"))
            for h, s in horizons.items()
        ]
    )


def with_horizons(
    df: DataFrame, horizons: Mapping[str, int] = HORIZON_STEPS, reaching: str | None = None, cadence: int = STEP_MINUTES
) -> DataFrame:
    """Each row once per horizon; with ``reaching``, only horizons of at least that many steps."""
    entries = horizon_array(horizons, cadence)
    if reaching is not None:
        entries = F.filter(entries, lambda h: h["steps"] >= F.col(reaching))
    return df.select("*", F.explode(entries).alias("_h")).select(*df.columns, "_h.*")


def horizon_minutes(name: str | Column) -> Column:
    out = F.lit(None).cast("int")
    for horizon, minutes in HORIZON_MINUTES.items():
        out = F.when(as_col(name) == horizon, minutes).otherwise(out)
    return out


def validate_horizons(dim: DataFrame) -> DataFrame:
    """Rows of a horizon table (horizon, steps, cadence_minutes) whose steps do not span the horizon."""
    span = F.col("steps") * F.col("cadence_minutes")
    return dim.filter(~F.coalesce(span == horizon_minutes("horizon"), F.lit(False)))


def history_hours(window: int = WINDOW_ROWS, longest_lag: int = SLOTS_PER_WEEK, hourly_window: int = 72,
                  longest_hourly_lag: int = 168, least: int = 24) -> int:
    """Hours of history a deployment run needs: the longest lag and a window before the newest step."""
    return max(least, (longest_lag + window) * STEP_MINUTES // 60, hourly_window + longest_hourly_lag)


def horizon_of(step: str | Column) -> Column:
    """Name of the shortest horizon that reaches a step, else null."""
    out = F.lit(None).cast("string")
    for horizon, steps in sorted(HORIZON_STEPS.items(), key=lambda kv: -kv[1]):
        out = F.when(as_col(step) <= steps, horizon).otherwise(out)
    return out


def horizon_ending_at(step: str | Column) -> Column:
    """Name of the horizon whose last step this is, else null."""
    out = F.lit(None).cast("string")
    for horizon, steps in HORIZON_STEPS.items():
        out = F.when(as_col(step) == steps, horizon).otherwise(out)
    return out


def seasonal_naive(load: DataFrame, end: Column, steps: int = 192, season: int = SLOTS_PER_WEEK) -> DataFrame:
    """Path of the next ``steps`` steps after ``end``: the values one season earlier.

    The source rows are a time range, moved forward: no window, join or shuffle.
    """
    first, last = steps_after(end, 1 - season), steps_after(end, steps - season)
    step = (minutes_between("ts", end) / STEP_MINUTES + season).cast("int")
    return load.filter(F.col("ts").between(first, last)).select(
        "region", step.alias("step"), steps_after("ts", season).alias("ts"), F.col("load").alias("point")
    )


def last_value_forecast(latest: DataFrame, end: Column, steps: int = 192) -> DataFrame:
    """Persistence path: the last value at every step."""
    return latest.select("region", F.explode(F.sequence(F.lit(1), F.lit(steps))).alias("step"), "load").select(
        "region", "step", steps_after(end, F.col("step")).alias("ts"), F.col("load").alias("point")
    )


def seasonal_anchors(load: DataFrame, first: Column, last: Column, season: int = SLOTS_PER_WEEK) -> DataFrame:
    """Naive forecast at each horizon for every origin between ``first`` and ``last``.

    The value at t is the forecast of the origins whose horizon ends one season after t.
    """
    origin = steps_after("ts", F.lit(season) - F.col("steps"))
    return (
        with_horizons(load)
        .select("region", origin.alias("origin"), "horizon", "steps", F.col("load").alias("point"))
        .filter(F.col("origin").between(first, last))
    )


def path_anchor(forecast: DataFrame) -> DataFrame:
    """Last step of each horizon."""
    return forecast.withColumn("horizon", horizon_ending_at("step")).filter(F.col("horizon").isNotNull())


def path_prefix(forecast: DataFrame, horizons: Mapping[str, int] = HORIZON_STEPS) -> DataFrame:
    """Steps 1..n of each horizon; a step belongs to all horizons that reach it."""
    return with_horizons(forecast, horizons, reaching="step").drop("cadence_minutes")


def path_sum(forecast: DataFrame, values: Sequence[str] = ("point",)) -> DataFrame:
    """Step-wise sums over regions, of the bounds too when named."""
    keys = [k for k in ("step", "ts") if k in forecast.columns]
    return forecast.groupBy(*keys).agg(*[F.sum(v).alias(v) for v in values])


def path_arrays(forecast: DataFrame, values: Sequence[str] = ("point",)) -> DataFrame:
    """One row per region and horizon with arrays of at most 192 values in step order."""
    entries = F.array_sort(F.collect_list(F.struct("step", *values)))
    nested = path_prefix(forecast).groupBy("region", "horizon", "steps").agg(entries.alias("_p"))
    return nested.select("region", "horizon", "steps", *[F.col(f"_p.{v}").alias(v) for v in values])


def edge_pad(path: Column, n: int | Column) -> Column:
    """First ``n`` values, extended with the last one where the path is shorter."""
    size = n if isinstance(n, Column) else F.lit(n)
    missing = F.greatest(size - F.size(path), F.lit(0))
    return F.concat(F.slice(path, 1, size), F.array_repeat(F.element_at(path, -1), missing))


def region_series(paths: DataFrame, anchors: DataFrame, latest: DataFrame, horizon: str) -> DataFrame:
    """Forecast series of each region up to a horizon: its path where it has one, else its anchors.

    ``paths`` (region, horizon, point, lower, upper as arrays) are cut or extended to the horizon;
    missing bounds become 10 % below or above the value. Regions with neither repeat their load.
    Paths and anchors of a region are one row each, so two joins by region suffice.
    """
    n = HORIZON_STEPS[horizon]
    own = paths.filter(F.col("horizon") == horizon).select("region", "point", "lower", "upper")
    listed = anchors.filter(F.col("step") <= n).groupBy("region").agg(
        F.array_sort(F.collect_list(F.struct("step", "point", "lower", "upper"))).alias("_anchors")
    )
    steps = F.sequence(F.lit(1), F.lit(n))
    point = edge_pad(F.col("point"), n)

    def bound(name: str, factor: float) -> Column:
        usable = (F.size("lower") > 0) & (F.size("upper") > 0)
        return F.when(usable, edge_pad(F.col(name), n)).otherwise(F.transform(point, lambda x: x * factor))

    def at(step: Column) -> Column:
        reached = F.filter("_anchors", lambda a: a["step"] <= step)
        anchor = F.when(F.size(reached) > 0, F.element_at(reached, -1)).otherwise(F.col("_anchors")[0])
        value = F.coalesce(anchor["point"], F.col("load"))
        both = anchor["lower"].isNotNull() & anchor["upper"].isNotNull()
        return F.struct(
            step.alias("step"), value.alias("point"),
            F.when(both, anchor["lower"]).otherwise(value * 0.9).alias("lower"),
            F.when(both, anchor["upper"]).otherwise(value * 1.1).alias("upper"),
        )

    from_path = F.arrays_zip(
        steps.alias("step"), point.alias("point"), bound("lower", 0.9).alias("lower"), bound("upper", 1.1).alias("upper")
    )
    joined = latest.select("region", "load").join(own, "region", "left").join(listed, "region", "left")
    series = F.when(F.size("point") > 0, from_path).otherwise(F.transform(steps, at))
    return joined.select("region", F.inline(series)).toDF("region", "step", "point", "lower", "upper")


def anchor_step_fill(anchors: DataFrame, n_steps: int, keys: Sequence[str] = ("region",)) -> DataFrame:
    """Step function through anchors ``(step, point, lower, upper)``.

    A step takes the latest anchor at or before it, steps before the first anchor take the first.
    A missing bound becomes 10 % below or above the value. Each anchor is expanded over the steps
    it covers, so no grid is joined; a group holds one row per horizon.
    """
    keys = list(keys)
    w = Window.partitionBy(*keys).orderBy("step")
    start = F.when(F.row_number().over(w) == 1, F.lit(1)).otherwise(F.col("step"))
    stop = F.coalesce(F.lead("step").over(w) - 1, F.lit(n_steps))
    has_bounds = F.col("lower").isNotNull() & F.col("upper").isNotNull()
    return (
        anchors.filter(F.col("step") <= n_steps)
        .select(
            *keys, "point", start.alias("_a"), stop.alias("_b"),
            F.when(has_bounds, F.col("lower")).otherwise(F.col("point") * 0.9).alias("lower"),
            F.when(has_bounds, F.col("upper")).otherwise(F.col("point") * 1.1).alias("upper"),
        )
        .select(*keys, F.explode(F.sequence("_a", "_b")).alias("step"), "point", "lower", "upper")
    )


def naive_residuals(load: DataFrame, season: int = SLOTS_PER_WEEK) -> DataFrame:
    """Value, forecast one season earlier and absolute error; rows without a forecast are dropped."""
    lagged = with_window_columns(
        load, ["region"], "ts", lambda w: {"predicted": F.lag("load", season).over(w)},
        back=f"{season * STEP_MINUTES} MINUTES",
    )
    return lagged.filter(F.col("predicted").isNotNull()).withColumn(
        "abs_error", F.abs(F.col("load") - F.col("predicted"))
    )


def residual_quantile(residuals: DataFrame, level: float = 0.95, keys: Sequence[str] = ("region",)) -> DataFrame:
    """Exact quantile of absolute errors per group, as ``qhat``."""
    return exact_quantile(residuals, list(keys), "abs_error", level, "qhat")


def prediction_interval(forecast: DataFrame, qhat: DataFrame | None = None, keys: Sequence[str] = ("region",)) -> DataFrame:
    """``point`` +/- ``qhat``; a tenth of the value where no quantile is known."""
    if qhat is None:
        joined = forecast.withColumn("qhat", F.lit(None).cast("double"))
    else:
        joined = salted_join(forecast, qhat, list(keys), forecast.columns, "left")
    half = F.coalesce(F.col("qhat"), F.abs("point") * 0.1)
    return joined.withColumn("lower", F.col("point") - half).withColumn("upper", F.col("point") + half).drop("qhat")


def recursive_forecast(
    history: DataFrame, weights: Mapping[int, float], intercept: float = 0.0, steps: int = 192
) -> DataFrame:
    """Roll a linear lag model forward, feeding each prediction back.

    ``weights`` maps a lag in steps to its weight. The state is an array of the last ``max(lag)``
    values per region, however long the history; the recursion runs inside one expression.
    """
    depth = max(weights)
    newest = history.agg(F.max("ts").alias("v")).scalar()
    tail = history.filter(F.col("ts") > steps_after(newest, -depth))
    values = F.array_sort(F.collect_list(F.struct("ts", "load")))["load"]
    state = tail.groupBy("region").agg(values.alias("_hist"), F.max("ts").alias("end"))

    def advance(acc: Column, _step: Column) -> Column:
        value = F.lit(intercept)
        for lag, weight in weights.items():
            value = value + F.element_at(acc, -lag) * weight
        return F.concat(acc, F.array(value))

    rolled = F.aggregate(F.sequence(F.lit(1), F.lit(steps)), F.slice("_hist", -depth, depth), advance)
    return (
        state.filter(F.size("_hist") >= depth)
        .select("region", "end", F.posexplode(F.slice(rolled, depth + 1, steps)).alias("_i", "point"))
        .select("region", (F.col("_i") + 1).alias("step"), steps_after("end", F.col("_i") + 1).alias("ts"), "point")
    )


def region_horizon_lookup(regions: DataFrame, anchors: DataFrame) -> DataFrame:
    """Forecast of every region and horizon, 0 where there is none."""
    return with_horizons(regions.select("region")).join(
        anchors.select("region", "horizon", "point"), ["region", "horizon"], "left"
    ).select("region", "horizon", "steps", F.coalesce("point", F.lit(0.0)).alias("point"))


def explode_nested(documents: DataFrame, column: str, names: Sequence[str]) -> DataFrame:
    """Rows of a map nested ``len(names) - 1`` levels deep; the last name is the value."""
    df = documents.withColumn("_v", F.col(column))
    for name in names[:-1]:
        df = df.select("*", F.explode("_v").alias(name, "_n")).drop("_v").withColumnRenamed("_n", "_v")
    return df.select(*names[:-1], F.col("_v").alias(names[-1]))


def map_by(name: str, value: Column) -> Column:
    """Map from ``name`` to ``value`` of a group, entries in order of the key.

    Only keys are compared, because maps as values cannot be.
    """
    def compare(a: Column, b: Column) -> Column:
        return F.when(a["k"] < b["k"], -1).when(a["k"] > b["k"], 1).otherwise(0)

    entries = F.collect_list(F.when(value.isNotNull(), F.struct(F.col(name).alias("k"), value.alias("v"))))
    return F.map_from_entries(F.array_sort(entries, compare))


def nest_long(df: DataFrame, value: Column, keys: Sequence[str] = ("region",)) -> DataFrame:
    """Horizon map per region: at most one entry per horizon."""
    return df.groupBy(*keys).agg(map_by("horizon", value).alias("map"))
