"""Queries on the anomaly rules. Registered for every row of the trailing week: on the given data
the newest row alone triggers nothing."""

from __future__ import annotations

from pyspark.sql import functions as F

from loadspan.config import SLOTS_PER_WEEK
from loadspan.operators import anomaly as an
from loadspan.operators import forecast as fc
from loadspan.operators import stats
from loadspan.queries import inputs as src
from loadspan.queries.analytics import SHARE_STATS
from loadspan.queries.inputs import rounded
from loadspan.queries.registry import query
from loadspan.queries.sqlbase import sql
from loadspan.sources.stage import staged

SQL_TYPES = {"string": "VARCHAR", "double": "DOUBLE", "timestamp_ntz": "TIMESTAMP"}


def finding_sql(rule: str, rest: str, **columns: str) -> str:
    columns = {"rule": f"'{rule}'", **columns}
    out = []
    for name, kind in an.FINDING.items():
        expr = columns.get(name, "NULL")
        if kind == "double" and expr != "NULL":
            expr = f"round({expr} + 1e-9, 6)"
        out.append(f"CAST({expr} AS {SQL_TYPES[kind]}) AS {name}")
    return f"SELECT {', '.join(out)} FROM {rest}"


SEVERITY = "CASE WHEN z > 3 THEN 'high' ELSE 'medium' END"

# Tables the rules need beyond the shared ones: forecasts are the values one week earlier.
EXTRA = SHARE_STATS + """,
    anchors AS (SELECT region, origin, horizon, steps, point FROM (
        SELECT l.region, l.ts + INTERVAL 7 DAY - to_minutes(h.steps * 15) AS origin, h.horizon, h.steps, l.load AS point
        FROM load l CROSS JOIN horizons h) q, bounds WHERE origin > hi - INTERVAL 7 DAY AND origin <= hi),
    path AS (SELECT region, CAST(date_diff('minute', hi, ts + INTERVAL 7 DAY) / 15 AS INTEGER) AS step,
        ts + INTERVAL 7 DAY AS ts, load AS point, hi FROM load, bounds
        WHERE ts + INTERVAL 7 DAY > hi AND ts + INTERVAL 7 DAY <= hi + INTERVAL 48 HOUR),
    total_path AS (SELECT step, ts, hi, sum(point) AS point FROM path GROUP BY step, ts, hi),
    total_anchors AS (SELECT origin, horizon, sum(point) AS point FROM anchors GROUP BY origin, horizon),
    diffs AS (SELECT ts, total, total - lag(total) OVER (ORDER BY ts) AS diff FROM recent_total),
    diff_stats AS (SELECT avg(diff) AS mean, CASE WHEN stddev_samp(diff) > 0 THEN stddev_samp(diff) ELSE 1e-6 END AS std,
        count(diff) AS n FROM diffs),
    peers AS (SELECT ts, avg(load) AS mean, CASE WHEN stddev_samp(load) > 0 THEN stddev_samp(load) ELSE 1e-6 END AS std
        FROM recent GROUP BY ts)"""
NEEDS = ("load", "recent", "stats", "recent_total", "total_stats", "horizons", "bounds")


def z(value: str, alias: str = "s") -> str:
    return f"round(abs(({value} - {alias}.mean) / {alias}.std), 6)"


def rule_sql(peer: float) -> dict[str, str]:
    return {
        "anomaly_region": finding_sql(
            "anomaly_region",
            f"(SELECT r.*, s.mean, s.std, {z('r.load')} AS z FROM recent r JOIN stats s ON s.region = r.region) q WHERE z > 2.5",
            region="region", severity=SEVERITY, z_score="z", current_load="load",
            expected_low="mean - 2 * std", expected_high="mean + 2 * std", ts="ts"),
        "anomaly_forecast_anchor": finding_sql(
            "anomaly_forecast_anchor",
            f"(SELECT a.*, {z('a.point')} AS z FROM anchors a JOIN stats s ON s.region = a.region) q WHERE z > 2.0",
            region="region", horizon="horizon", severity="'forecast'", z_score="z", predicted_load="point", ts="origin"),
        "anomaly_peer": finding_sql(
            "anomaly_peer",
            f"(SELECT r.*, {z('r.load')} AS z FROM recent r JOIN peers s ON s.ts = r.ts) q WHERE z > {peer}",
            region="region", severity=SEVERITY, type="'peer'", z_score="z", current_load="load", ts="ts"),
        "anomaly_share": finding_sql(
            "anomaly_share",
            f"""(SELECT r.region, r.ts, share, share_mean, share_std, round(abs((share - share_mean) / share_std), 6) AS z,
            round(share, 6) >= 0.40 AS large, round(share - share_mean, 6) >= 0.15 AS grown
            FROM shares r JOIN share_stats s ON s.region = r.region) q WHERE z > {peer} OR large OR grown""",
            region="region", severity="CASE WHEN large OR z > 3 THEN 'high' ELSE 'medium' END", type="'share'",
            z_score="z", current_share="share", expected_low="greatest(share_mean - 2 * share_std, 0)",
            expected_high="least(share_mean + 2 * share_std, 1)", ts="ts"),
        "anomaly_total": finding_sql(
            "anomaly_total",
            f"(SELECT t.*, s.mean, s.std, {z('t.total')} AS z FROM recent_total t CROSS JOIN total_stats s) q WHERE z > 2.5",
            region="'TOTAL'", severity=SEVERITY, z_score="z", current_load="total",
            expected_low="mean - 2 * std", expected_high="mean + 2 * std", ts="ts"),
        "anomaly_total_anchor": finding_sql(
            "anomaly_total_anchor",
            f"(SELECT a.*, {z('a.point')} AS z FROM total_anchors a CROSS JOIN total_stats s) q WHERE z > 2.0",
            region="'TOTAL'", horizon="horizon", severity="'forecast'", z_score="z", predicted_load="point", ts="origin"),
        "anomaly_total_path": finding_sql(
            "anomaly_total_path",
            f"""(SELECT *, row_number() OVER (PARTITION BY horizon ORDER BY z DESC, step) AS rn FROM (
            SELECT p.*, h.horizon, {z('p.point')} AS z FROM total_path p JOIN horizons h ON p.step <= h.steps
            CROSS JOIN total_stats s) w) q WHERE rn = 1 AND z > 2.0""",
            region="'TOTAL'", horizon="horizon", severity="'forecast'", z_score="z", predicted_load="point", ts="hi"),
        "anomaly_spike": finding_sql(
            "anomaly_spike",
            f"""(SELECT t.ts, a.point, s.n, {z('(a.point - t.total)')} AS z FROM recent_total t
            JOIN total_anchors a ON a.origin = t.ts AND a.horizon = '15min' CROSS JOIN diff_stats s) q
            WHERE n > 10 AND z > 3.0""",
            region="'TOTAL'", horizon="'15min'", severity="'forecast'", z_score="z", predicted_load="point",
            note="'forecast jump against recent changes of the total'", ts="ts"),
        "anomaly_region_path": finding_sql(
            "anomaly_region_path",
            f"""(SELECT *, row_number() OVER (PARTITION BY region, horizon ORDER BY z DESC, step) AS rn FROM (
            SELECT p.*, h.horizon, {z('p.point')} AS z FROM path p JOIN horizons h ON p.step <= h.steps
            JOIN stats s ON s.region = p.region) w) q WHERE rn = 1 AND z > 2.0""",
            region="region", horizon="horizon", severity="'forecast'", type="'per-step'", z_score="z",
            predicted_load="point", ts="hi"),
    }


# Five regions bound a peer score by 1.789, so the peer threshold of the registered rules is 1.2.
PEER = 1.2
THRESHOLDS = an.Thresholds(peer=PEER)
RULE_SQL = rule_sql(PEER)


def _sql(name: str) -> str:
    return sql(RULE_SQL[name], *NEEDS, extra=EXTRA)


@query("anomaly_region", _sql("anomaly_region"))
def anomaly_region(spark, d):
    return rounded(an.anomaly_region(src.recent(spark, d), THRESHOLDS, "window"))


@query("anomaly_forecast_anchor", _sql("anomaly_forecast_anchor"))
def anomaly_forecast_anchor(spark, d):
    return rounded(an.anomaly_forecast_anchor(src.recent(spark, d), src.anchors(spark, d), THRESHOLDS))


@query("anomaly_peer", _sql("anomaly_peer"))
def anomaly_peer(spark, d):
    return rounded(an.anomaly_peer(src.recent(spark, d), THRESHOLDS, "window"))


@query("anomaly_share", _sql("anomaly_share"))
def anomaly_share(spark, d):
    return rounded(an.anomaly_share(src.recent(spark, d), THRESHOLDS, "window"))


@query("anomaly_total", _sql("anomaly_total"))
def anomaly_total(spark, d):
    return rounded(an.anomaly_total(src.recent(spark, d), THRESHOLDS, "window"))


@query("anomaly_total_anchor", _sql("anomaly_total_anchor"))
def anomaly_total_anchor(spark, d):
    return rounded(an.anomaly_total_anchor(src.recent(spark, d), src.anchors(spark, d), THRESHOLDS))


@query("anomaly_total_path", _sql("anomaly_total_path"))
def anomaly_total_path(spark, d):
    return rounded(an.anomaly_total_path(src.recent(spark, d), src.path(spark, d), src.end(spark, d), THRESHOLDS))


@query("anomaly_spike", _sql("anomaly_spike"))
def anomaly_spike(spark, d):
    return rounded(an.anomaly_spike(src.recent(spark, d), src.anchors(spark, d), THRESHOLDS, "window"))


@query("anomaly_region_path", _sql("anomaly_region_path"))
def anomaly_region_path(spark, d):
    return rounded(an.anomaly_region_path(src.recent(spark, d), src.path(spark, d), src.end(spark, d), THRESHOLDS))


def every_finding(spark, d):
    """All rules over one table of two weeks that they share."""
    axis = src.axis(spark, d)
    fortnight = staged(src.two_weeks(spark, d), "fortnight")
    week = fortnight.filter(F.col("ts") >= axis.back(SLOTS_PER_WEEK))
    anchors = fc.seasonal_anchors(fortnight, axis.back(SLOTS_PER_WEEK), axis.hi)
    return an.all_rules(week, anchors, fc.seasonal_naive(week, axis.hi), axis.hi, THRESHOLDS, "window",
                        keep=lambda df: staged(df, "rules"))


ALL_SQL = " UNION ALL ".join(RULE_SQL[name] for name in an.RULES)


@query("anomalies_all", sql(ALL_SQL, *NEEDS, extra=EXTRA))
def anomalies_all(spark, d):
    return rounded(every_finding(spark, d))


@query("anomaly_union", sql(
    RULE_SQL["anomaly_region"] + " UNION ALL " + RULE_SQL["anomaly_total"] + " UNION ALL " + RULE_SQL["anomaly_total"],
    *NEEDS, extra=EXTRA))
def anomaly_union(spark, d):
    window = src.recent(spark, d)
    total = an.anomaly_total(window, THRESHOLDS, "window")
    return rounded(an.anomaly_union([an.anomaly_region(window, THRESHOLDS, "window"), total, total]))


RULE_ORDER = "CASE rule " + " ".join(f"WHEN '{r}' THEN {i}" for i, r in enumerate(an.RULES)) + " END"


@query("first_anomalies", sql(
    f"SELECT * FROM ({ALL_SQL}) a ORDER BY {RULE_ORDER}, region, ts, coalesce((SELECT steps FROM horizons h "
    "WHERE h.horizon = a.horizon), 0) LIMIT 5", *NEEDS, extra=EXTRA))
def first_anomalies(spark, d):
    return rounded(an.first_anomalies(every_finding(spark, d)))


@query("severity", sql(f"""SELECT region, severity, count(*) AS n FROM (SELECT region, {SEVERITY} AS severity FROM (
    SELECT r.region, {z('r.load')} AS z FROM recent r JOIN stats s ON s.region = r.region) p) q
    GROUP BY region, severity""", "recent", "stats"))
def severity(spark, d):
    window = src.recent(spark, d)
    scored = window.join(stats.region_stats(window), "region")
    level = an.severity(an.zscore(F.col("load"), F.col("mean"), F.col("std")))
    return scored.groupBy("region", level.alias("severity")).agg(F.count(F.lit(1)).alias("n"))


@query("worst_step", sql(f"""SELECT region, horizon, step, round(point + 1e-9, 6) AS point, z FROM (
    SELECT *, row_number() OVER (PARTITION BY region, horizon ORDER BY z DESC, step) AS rn FROM (
    SELECT p.region, p.step, p.point, h.horizon, {z('p.point')} AS z FROM path p JOIN horizons h ON p.step <= h.steps
    JOIN stats s ON s.region = p.region) w) q WHERE rn = 1""", *NEEDS, extra=EXTRA))
def worst_step(spark, d):
    scored = fc.path_prefix(src.path(spark, d)).join(stats.region_stats(src.recent(spark, d)), "region").withColumn(
        "z", an.zscore(F.col("point"), F.col("mean"), F.col("std"))
    )
    return rounded(an.worst_step(scored, ["region", "horizon"]))


@query("snapshot_kpis", sql(f"""SELECT round(sum(load) + 1e-9, 6) AS total_load, round((SELECT sum(point) FROM path WHERE step = 4) + 1e-9, 6) AS forecast_1h,
    round((SELECT sum(point) FROM path WHERE step = 4) - sum(load) + 1e-9, 6) AS change_1h, count(*) AS regions,
    (SELECT count(*) FROM ({ALL_SQL}) a) AS anomalies FROM latest""", *NEEDS, "latest", extra=EXTRA))
def snapshot_kpis(spark, d):
    return rounded(stats.snapshot_kpis(src.latest(spark, d), src.latest_anchors(spark, d), every_finding(spark, d)))
