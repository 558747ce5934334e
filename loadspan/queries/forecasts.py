"""Queries on forecast tables: paths, anchors, intervals and their array forms."""

from __future__ import annotations

from pyspark.sql import functions as F

from loadspan.operators import forecast as fc
from loadspan.operators import reshape
from loadspan.queries import inputs as src
from loadspan.queries.anomalies import EXTRA, NEEDS
from loadspan.queries.inputs import rounded
from loadspan.queries.registry import query
from loadspan.queries.sqlbase import sql

QHAT = """, resid AS (SELECT region, abs(load - p) AS e FROM (
    SELECT region, load, lag(load, 672) OVER (PARTITION BY region ORDER BY ts) AS p FROM load) q WHERE p IS NOT NULL),
    qhat AS (SELECT region, quantile_cont(e, 0.95) AS qhat FROM resid GROUP BY region)"""


def naive_interval(spark, d):
    qhat = fc.residual_quantile(fc.naive_residuals(src.load(spark, d)))
    return fc.prediction_interval(src.path(spark, d), qhat)


@query("seasonal_naive", sql("SELECT region, step, ts, point FROM path", *NEEDS, extra=EXTRA))
def seasonal_naive(spark, d):
    return src.path(spark, d)


@query("prediction_interval", sql("""SELECT region, step, ts, point, round(point - qhat + 1e-9, 6) AS lower, round(point + qhat + 1e-9, 6) AS upper,
    round(point - 0.1 * abs(point) + 1e-9, 6) AS band_lower, round(point + 0.1 * abs(point) + 1e-9, 6) AS band_upper
    FROM path JOIN qhat USING (region)""", *NEEDS, extra=EXTRA + QHAT))
def prediction_interval(spark, d):
    banded = fc.prediction_interval(naive_interval(spark, d).withColumnsRenamed({"lower": "l", "upper": "u"}))
    return rounded(
        banded.withColumnsRenamed({"lower": "band_lower", "upper": "band_upper", "l": "lower", "u": "upper"})
    )


@query("history_plus_forecast", sql("""SELECT region, ts, load AS value, 'history' AS kind FROM recent
    UNION ALL SELECT region, ts, point, 'forecast' FROM path""", *NEEDS, extra=EXTRA))
def history_plus_forecast(spark, d):
    return reshape.history_plus_forecast(src.recent(spark, d), src.path(spark, d))


@query("path_prefix", sql("""SELECT region, horizon, step, point FROM path JOIN horizons ON step <= steps""",
       *NEEDS, extra=EXTRA))
def path_prefix(spark, d):
    return fc.path_prefix(src.path(spark, d)).select("region", "horizon", "step", "point")


@query("path_anchor", sql("SELECT region, horizon, ts, point FROM path JOIN horizons ON step = steps", *NEEDS, extra=EXTRA))
def path_anchor(spark, d):
    return fc.path_anchor(src.path(spark, d)).select("region", "horizon", "ts", "point")


@query("path_sum", sql("SELECT step, ts, round(point + 1e-9, 6) AS point FROM total_path", *NEEDS, extra=EXTRA))
def path_sum(spark, d):
    return rounded(fc.path_sum(src.path(spark, d)))


@query("edge_pad", sql("""SELECT g.region, h.horizon, n.i AS step, coalesce(p.point, e.point) AS point
    FROM (SELECT region, max(step) AS last_step FROM path GROUP BY region) g CROSS JOIN horizons h
    CROSS JOIN (SELECT unnest(generate_series(1, 240)) AS i) n
    LEFT JOIN path p ON p.region = g.region AND p.step = n.i AND n.i <= h.steps
    LEFT JOIN path e ON e.region = g.region AND e.step = h.steps""", *NEEDS, extra=EXTRA))
def edge_pad(spark, d):
    padded = fc.path_arrays(src.path(spark, d)).select("region", "horizon", fc.edge_pad(F.col("point"), 240).alias("p"))
    return padded.select("region", "horizon", F.posexplode("p").alias("i", "point")).select(
        "region", "horizon", (F.col("i") + 1).cast("bigint").alias("step"), "point"
    )


@query("anchor_step_fill", sql("""SELECT a.region, a.origin, CAST(n.i AS INTEGER) AS step, a.point, round(a.point * 0.9 + 1e-9, 6) AS lower,
    round(a.point * 1.1 + 1e-9, 6) AS upper FROM (SELECT unnest(generate_series(1, 192)) AS i) n
    JOIN (SELECT *, lead(steps) OVER (PARTITION BY region, origin ORDER BY steps) AS next_steps,
        lag(steps) OVER (PARTITION BY region, origin ORDER BY steps) AS prev_steps FROM anchors) a
    ON (n.i >= a.steps OR a.prev_steps IS NULL) AND n.i < coalesce(a.next_steps, 193)""",
    *NEEDS, extra=EXTRA))
def anchor_step_fill(spark, d):
    anchors = src.anchors(spark, d).select(
        "region", "origin", F.col("steps").alias("step"), "point",
        F.lit(None).cast("double").alias("lower"), F.lit(None).cast("double").alias("upper"),
    )
    return rounded(fc.anchor_step_fill(anchors, 192, ["region", "origin"]))


@query("region_horizon_lookup", sql("""SELECT r.region, h.horizon, h.steps, coalesce(p.point, 0.0) AS point
    FROM regions r CROSS JOIN horizons h LEFT JOIN path p ON p.region = r.region AND p.step = h.steps AND p.point > 20""",
    *NEEDS, "regions", extra=EXTRA))
def region_horizon_lookup(spark, d):
    regions = src.events(spark, d).select(F.col("event_type").alias("region")).distinct()
    known = fc.path_anchor(src.path(spark, d)).filter("point > 20")
    return fc.region_horizon_lookup(regions, known)


@query("explode_nested", sql("SELECT region, horizon, point FROM path JOIN horizons ON step = steps", *NEEDS, extra=EXTRA))
def explode_nested(spark, d):
    nested = fc.nest_long(fc.path_anchor(src.path(spark, d)), F.col("point"))
    document = nested.select(F.create_map("region", "map").alias("predictions"))
    return fc.explode_nested(document, "predictions", ["region", "horizon", "point"])


@query("nest_long", sql("""SELECT region, count(*) AS horizons, string_agg(horizon || '=' || CAST(CAST(round(point * 100) AS BIGINT) AS VARCHAR),
    ',' ORDER BY horizon) AS entries FROM path JOIN horizons ON step = steps GROUP BY region""", *NEEDS, extra=EXTRA))
def nest_long(spark, d):
    nested = fc.nest_long(fc.path_anchor(src.path(spark, d)), F.round(F.col("point") * 100).cast("bigint"))
    pair = F.transform(F.map_entries("map"), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string")))
    return nested.select(
        "region", F.size("map").cast("bigint").alias("horizons"), F.array_join(pair, ",").alias("entries")
    )


@query("longest_horizon", sql("""SELECT region, arg_max(horizon, steps) AS horizon, CAST(max(steps) AS INTEGER) AS steps
    FROM anchors GROUP BY region""", *NEEDS, extra=EXTRA))
def longest_horizon(spark, d):
    return src.anchors(spark, d).groupBy("region").agg(
        F.max_by("horizon", "steps").alias("horizon"), F.max("steps").alias("steps")
    )


# Weights of the registered recursive forecast; at step s it needs the values at s-96, s-192 and s-672.
WEIGHTS = {96: 0.5, 192: 0.2, 672: 0.3}


@query("recursive_forecast", sql("""SELECT region, CAST(step AS INTEGER) AS step, hi + to_minutes(CAST(step * 15 AS INTEGER)) AS ts,
    round(point + 1e-9, 6) AS point FROM (
    SELECT region, step, point FROM first_day UNION ALL
    SELECT f.region, f.step + 96, 0.5 * f.point + 0.2 * b.load + 0.3 * c.load FROM first_day f
    JOIN hist b ON b.region = f.region AND b.k = f.step + 96 - 192 JOIN hist c ON c.region = f.region AND c.k = f.step + 96 - 672) u, bounds""",
    *NEEDS, extra=EXTRA + """, hist AS (SELECT region, load, CAST(date_diff('minute', hi, ts) / 15 AS INTEGER) AS k FROM recent, bounds),
    first_day AS (SELECT a.region, a.k + 96 AS step, 0.5 * a.load + 0.2 * b.load + 0.3 * c.load AS point FROM hist a
    JOIN hist b ON b.region = a.region AND b.k = a.k - 96 JOIN hist c ON c.region = a.region AND c.k = a.k - 576
    WHERE a.k > -96)"""))
def recursive_forecast(spark, d):
    return rounded(fc.recursive_forecast(src.recent(spark, d), WEIGHTS))


@query("region_series", sql("""SELECT g.region, CAST(n.i AS INTEGER) AS step,
    round(CASE WHEN g.region <> 'click' THEN p.point ELSE coalesce(a.point, f.point) END + 1e-9, 6) AS point,
    round(CASE WHEN g.region <> 'click' THEN p.point - qhat ELSE coalesce(a.point, f.point) * 0.9 END + 1e-9, 6) AS lower,
    round(CASE WHEN g.region <> 'click' THEN p.point + qhat ELSE coalesce(a.point, f.point) * 1.1 END + 1e-9, 6) AS upper
    FROM regions g CROSS JOIN (SELECT unnest(generate_series(1, 96)) AS i) n JOIN qhat q ON q.region = g.region
    LEFT JOIN path p ON p.region = g.region AND p.step = n.i
    LEFT JOIN path a ON a.region = g.region AND a.step = (SELECT max(steps) FROM horizons WHERE steps <= n.i)
    LEFT JOIN path f ON f.region = g.region AND f.step = 1""", *NEEDS, "regions", extra=EXTRA + QHAT))
def region_series(spark, d):
    """Series of a day: paths with bounds for all regions but one, for which only anchors are kept."""
    banded = naive_interval(spark, d)
    arrays = fc.path_arrays(banded, ["point", "lower", "upper"]).filter("region <> 'click'")
    anchors = fc.path_anchor(src.path(spark, d)).select(
        "region", "step", "point", F.lit(None).cast("double").alias("lower"), F.lit(None).cast("double").alias("upper")
    )
    return rounded(fc.region_series(arrays, anchors, src.latest(spark, d).drop("ts"), "24h"))
