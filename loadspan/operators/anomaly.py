"""Anomaly rules. Each returns findings in one schema; statistics cover the trailing week.

``scope="latest"`` scores the newest row, ``scope="window"`` every row of the trailing window
against the same statistics. Scores are rounded to 6 places before they meet a threshold.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loadspan.config import DEFAULTS, Thresholds
from loadspan.operators.forecast import path_prefix, path_sum
from loadspan.operators.stats import load_share, region_stats, safe_std, share_stats, system_total, with_share
from loadspan.plans.blocks import with_window_columns
from loadspan.plans.skew import salted_join

FINDING = {
    "rule": "string", "region": "string", "horizon": "string", "severity": "string", "type": "string",
    "z_score": "double", "current_load": "double", "predicted_load": "double", "current_share": "double",
    "expected_low": "double", "expected_high": "double", "note": "string", "ts": "timestamp_ntz",
}

# Order in which the rules report.
RULES = [
    "anomaly_region", "anomaly_forecast_anchor", "anomaly_peer", "anomaly_share", "anomaly_total",
    "anomaly_total_anchor", "anomaly_total_path", "anomaly_spike", "anomaly_region_path",
]


def finding_columns(rule: str, **columns: Column) -> list[Column]:
    """Columns of the common schema; those not given are null."""
    columns = {"rule": F.lit(rule), **columns}
    return [columns.get(name, F.lit(None)).cast(kind).alias(name) for name, kind in FINDING.items()]


def findings(df: DataFrame, rule: str, **columns: Column) -> DataFrame:
    """Project to the common schema."""
    return df.select(*finding_columns(rule, **columns))


def zscore(value: Column, mean: Column, std: Column) -> Column:
    return F.round(F.abs((value - mean) / std), 6)


def severity(z: Column, thresholds: Thresholds = DEFAULTS) -> Column:
    return F.when(z > thresholds.high, "high").otherwise("medium")


def scored_rows(window: DataFrame, scope: str, end: Column | None = None) -> DataFrame:
    """The rows a rule scores: all of the window, or those of its newest timestamp ``end``."""
    if scope == "window":
        return window
    if scope != "latest":
        raise ValueError(f"unknown scope {scope}")
    if end is None:
        end = window.agg(F.max("ts").alias("v")).scalar()
    return window.filter(F.col("ts") == end)


def window_stats(window: DataFrame, exclude_current: bool) -> DataFrame:
    """Statistics per region, with or without the newest row."""
    if exclude_current:
        newest = window.agg(F.max("ts").alias("v")).scalar()
        window = window.filter(F.col("ts") < newest)
    return region_stats(window)


def region_status(window: DataFrame, thresholds: Thresholds = DEFAULTS, scope: str = "latest",
                  exclude_current: bool = False) -> DataFrame:
    """Each scored row with its statistics and score: one row per region for the latest scope."""
    stats = window_stats(window, exclude_current)
    scored = salted_join(scored_rows(window, scope), stats, ["region"], ["ts"])
    z = zscore(F.col("load"), F.col("mean"), F.col("std"))
    return scored.withColumn("z_score", z).withColumn("is_anomaly", F.col("z_score") > thresholds.region)


def anomaly_region(window: DataFrame, thresholds: Thresholds = DEFAULTS, scope: str = "latest",
                   exclude_current: bool = False) -> DataFrame:
    """Region against its own history."""
    hit = region_status(window, thresholds, scope, exclude_current).filter("is_anomaly")
    return hit.select(region_finding(F.col("z_score"), thresholds).alias("f")).select("f.*")


def region_finding(z: Column, thresholds: Thresholds) -> Column:
    """Finding of a row with ``load`` and its region's ``mean`` and ``std``."""
    return F.struct(*finding_columns(
        "anomaly_region", region=F.col("region"), severity=severity(z, thresholds), z_score=z, current_load=F.col("load"),
        expected_low=F.col("mean") - 2 * F.col("std"), expected_high=F.col("mean") + 2 * F.col("std"), ts=F.col("ts"),
    ))


def anomaly_forecast_anchor(window: DataFrame, anchors: DataFrame, thresholds: Thresholds = DEFAULTS) -> DataFrame:
    """Forecast at a horizon against the region's history. ``anchors``: region, origin, horizon, point."""
    return _anchor_findings(salted_join(anchors, region_stats(window), ["region"], ["origin"]), thresholds)


def _anchor_findings(known: DataFrame, thresholds: Thresholds) -> DataFrame:
    scored = known.withColumn("z", zscore(F.col("point"), F.col("mean"), F.col("std")))
    return findings(
        scored.filter(F.col("z") > thresholds.forecast), "anomaly_forecast_anchor",
        region=F.col("region"), horizon=F.col("horizon"), severity=F.lit("forecast"), z_score=F.col("z"),
        predicted_load=F.col("point"), ts=F.col("origin"),
    )


def anomaly_peer(window: DataFrame, thresholds: Thresholds = DEFAULTS, scope: str = "latest") -> DataFrame:
    """Region against all regions at the same timestamp."""
    rows = scored_rows(window, scope)
    peers = rows.groupBy("ts").agg(F.avg("load").alias("mean"), safe_std("load").alias("std"))
    scored = rows.join(peers, "ts").withColumn("z", zscore(F.col("load"), F.col("mean"), F.col("std")))
    return scored.filter(F.col("z") > thresholds.peer).select(peer_finding(F.col("z"), thresholds).alias("f")).select("f.*")


def peer_finding(z: Column, thresholds: Thresholds) -> Column:
    return F.struct(*finding_columns(
        "anomaly_peer", region=F.col("region"), severity=severity(z, thresholds), type=F.lit("peer"), z_score=z,
        current_load=F.col("load"), ts=F.col("ts"),
    ))


def anomaly_share(window: DataFrame, thresholds: Thresholds = DEFAULTS, scope: str = "latest",
                  stats: str = "observed") -> DataFrame:
    """Share of the total: unusual, at least 40 %, or at least 15 points above its mean."""
    shares = load_share(window)
    history = share_stats(shares, stats)
    scored = salted_join(scored_rows(shares, scope), history, ["region"], ["ts"])
    return scored.filter(share_hit(thresholds)).select(share_finding(thresholds).alias("f")).select("f.*")


def share_score() -> Column:
    return zscore(F.col("share"), F.col("share_mean"), F.col("share_std"))


def large_share(thresholds: Thresholds) -> Column:
    return F.round(F.col("share"), 6) >= thresholds.share_absolute


def share_hit(thresholds: Thresholds) -> Column:
    grown = F.round(F.col("share") - F.col("share_mean"), 6) >= thresholds.share_increase
    return (share_score() > thresholds.peer) | large_share(thresholds) | grown


def share_finding(thresholds: Thresholds) -> Column:
    """Finding of a row with its ``share`` and its region's ``share_mean`` and ``share_std``."""
    z, spread = share_score(), 2 * F.col("share_std")
    return F.struct(*finding_columns(
        "anomaly_share", region=F.col("region"), type=F.lit("share"), z_score=z,
        severity=F.when(large_share(thresholds) | (z > thresholds.high), "high").otherwise("medium"),
        current_share=F.col("share"),
        expected_low=F.greatest(F.col("share_mean") - spread, F.lit(0.0)),
        expected_high=F.least(F.col("share_mean") + spread, F.lit(1.0)), ts=F.col("ts"),
    ))


def total_stats(window: DataFrame) -> tuple[Column, Column]:
    """Mean and deviation of the system total, as scalar subqueries."""
    stats = system_total(window).agg(F.avg("total").alias("mean"), safe_std("total").alias("std"))
    return stats.select("mean").scalar(), stats.select("std").scalar()


def anomaly_total(window: DataFrame, thresholds: Thresholds = DEFAULTS, scope: str = "latest") -> DataFrame:
    """System total against its own history."""
    mean, std = total_stats(window)
    total = scored_rows(system_total(window), scope)
    scored = total.withColumns({"mean": mean, "std": std}).withColumn(
        "z", zscore(F.col("total"), F.col("mean"), F.col("std"))
    )
    return findings(
        scored.filter(F.col("z") > thresholds.region), "anomaly_total", region=F.lit("TOTAL"),
        severity=severity(F.col("z"), thresholds), z_score=F.col("z"), current_load=F.col("total"),
        expected_low=F.col("mean") - 2 * F.col("std"), expected_high=F.col("mean") + 2 * F.col("std"), ts=F.col("ts"),
    )


def total_anchors(anchors: DataFrame, missing: str = "skip") -> DataFrame:
    """Anchors summed over regions per origin and horizon.

    ``missing="zero"`` also gives 0 for the horizons of an origin that have no forecast at all.
    """
    from loadspan.operators.forecast import with_horizons

    if missing == "zero":
        origins = anchors.select("origin").distinct()
        empty = with_horizons(origins).select("origin", "horizon", F.lit(0.0).alias("point"))
        anchors = anchors.select("origin", "horizon", "point").unionByName(empty)
    return anchors.groupBy("origin", "horizon").agg(F.sum("point").alias("point"))


def anomaly_total_anchor(window: DataFrame, anchors: DataFrame, thresholds: Thresholds = DEFAULTS,
                         missing: str = "skip") -> DataFrame:
    """Forecast total at a horizon against the history of the total."""
    mean, std = total_stats(window)
    scored = total_anchors(anchors, missing).withColumn("z", zscore(F.col("point"), mean, std))
    return findings(
        scored.filter(F.col("z") > thresholds.forecast), "anomaly_total_anchor", region=F.lit("TOTAL"),
        horizon=F.col("horizon"), severity=F.lit("forecast"), z_score=F.col("z"),
        predicted_load=F.col("point"), ts=F.col("origin"),
    )


def worst_step(scored: DataFrame, keys: list[str]) -> DataFrame:
    """Value and score of the step with the largest score, the first one on ties."""
    order = F.struct(F.col("z"), -F.col("step"))
    return scored.groupBy(*keys).agg(
        F.max("z").alias("z"), F.max_by("point", order).alias("point"), F.max_by("step", order).alias("step")
    )


def anomaly_total_path(window: DataFrame, forecast: DataFrame, end: Column,
                       thresholds: Thresholds = DEFAULTS) -> DataFrame:
    """Worst step of the summed path within each horizon."""
    mean, std = total_stats(window)
    scored = path_prefix(path_sum(forecast)).withColumn("z", zscore(F.col("point"), mean, std))
    worst = worst_step(scored, ["horizon"]).filter(F.col("z") > thresholds.forecast)
    return findings(
        worst, "anomaly_total_path", region=F.lit("TOTAL"), horizon=F.col("horizon"), severity=F.lit("forecast"),
        z_score=F.col("z"), predicted_load=F.col("point"), ts=end,
    )


def total_diff(total: DataFrame) -> DataFrame:
    """First difference of the system total; blocks of days keep it off a single task."""
    return with_window_columns(
        total, [], "ts", lambda w: {"diff": F.col("total") - F.lag("total").over(w)}, back="15 MINUTES"
    )


def anomaly_spike(window: DataFrame, anchors: DataFrame, thresholds: Thresholds = DEFAULTS,
                  scope: str = "latest") -> DataFrame:
    """Jump from the current total to the first forecast step against the history of differences.

    Needs more than 10 differences. ``anchors`` must hold the 15-minute horizon of each origin.
    """
    total = system_total(window)
    stats = total_diff(total).agg(
        F.avg("diff").alias("mean"), safe_std("diff").alias("std"), F.count("diff").alias("n")
    )
    mean, std, n = (stats.select(c).scalar() for c in ("mean", "std", "n"))
    first = total_anchors(anchors.filter(F.col("horizon") == "15min")).withColumnRenamed("origin", "ts")
    jumps = scored_rows(total, scope).join(first, "ts").withColumn(
        "z", zscore(F.col("point") - F.col("total"), mean, std)
    )
    return findings(
        jumps.filter((n > 10) & (F.col("z") > thresholds.spike)), "anomaly_spike", region=F.lit("TOTAL"),
        horizon=F.lit("15min"), severity=F.lit("forecast"), z_score=F.col("z"), predicted_load=F.col("point"),
        note=F.lit("forecast jump against recent changes of the total"), ts=F.col("ts"),
    )


def anomaly_region_path(window: DataFrame, forecast: DataFrame, end: Column,
                        thresholds: Thresholds = DEFAULTS) -> DataFrame:
    """Worst step of each region's path within each horizon."""
    return _path_findings(path_prefix(forecast).join(region_stats(window), "region"), end, thresholds)


def _path_findings(known: DataFrame, end: Column, thresholds: Thresholds) -> DataFrame:
    scored = known.withColumn("z", zscore(F.col("point"), F.col("mean"), F.col("std")))
    worst = worst_step(scored, ["region", "horizon"]).filter(F.col("z") > thresholds.forecast)
    return findings(
        worst, "anomaly_region_path", region=F.col("region"), horizon=F.col("horizon"), severity=F.lit("forecast"),
        type=F.lit("per-step"), z_score=F.col("z"), predicted_load=F.col("point"), ts=end,
    )


def anomaly_union(parts: list[DataFrame]) -> DataFrame:
    """All findings, duplicates kept."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def all_rules(window: DataFrame, anchors: DataFrame, forecast: DataFrame, end: Column,
              thresholds: Thresholds = DEFAULTS, scope: str = "latest", share: str = "observed",
              missing: str = "skip", keep: Callable[[DataFrame], DataFrame] = lambda df: df) -> DataFrame:
    """Findings of all nine rules, from one aggregation per timestamp and one per region.

    The rules on rows of regions are judged side by side on one scored row, the rules on the total on one row per timestamp.
    ``keep`` may write the three shared tables (rows with totals, timestamps, regions) and read them back, so that the window is
    read twice instead of once for each rule and statistic.
    """
    times = keep(window.groupBy("ts").agg(
        F.sum("load").alias("total"), F.avg("load").alias("peer_mean"), safe_std("load").alias("peer_std"),
    ))
    rows = keep(with_share(window.join(times, "ts")))
    known = keep(region_stats(rows).join(share_stats(rows, share), "region"))
    z_load = zscore(F.col("load"), F.col("mean"), F.col("std"))
    z_peer = zscore(F.col("load"), F.col("peer_mean"), F.col("peer_std"))
    judged = salted_join(scored_rows(rows, scope, end), known, ["region"], ["ts"])
    on_rows = judged.select(F.explode(F.filter(F.array(
        F.struct((z_load > thresholds.region).alias("hit"), region_finding(z_load, thresholds).alias("f")),
        F.struct((z_peer > thresholds.peer).alias("hit"), peer_finding(z_peer, thresholds).alias("f")),
        F.struct(share_hit(thresholds).alias("hit"), share_finding(thresholds).alias("f")),
    ), lambda x: x["hit"])).alias("e")).select("e.f.*")
    on_anchors = _anchor_findings(salted_join(anchors, known, ["region"], ["origin"]), thresholds)
    on_paths = _path_findings(path_prefix(forecast).join(known, "region"), end, thresholds)
    totals = times.select("ts", F.col("total").alias("load"))
    return anomaly_union([
        on_rows, on_anchors, on_paths,
        anomaly_total(totals, thresholds, scope), anomaly_total_anchor(totals, anchors, thresholds, missing),
        anomaly_total_path(totals, forecast, end, thresholds), anomaly_spike(totals, anchors, thresholds, scope),
    ])


def rule_position(rule: str | Column) -> Column:
    col = F.col(rule) if isinstance(rule, str) else rule
    out = F.lit(len(RULES))
    for i, name in enumerate(RULES):
        out = F.when(col == name, i).otherwise(out)
    return out


def first_anomalies(found: DataFrame, n: int = 5) -> DataFrame:
    """The first ``n`` findings in report order: a top-n, not a sort of everything."""
    from loadspan.operators.forecast import horizon_minutes

    order = [rule_position("rule"), F.col("region"), F.col("ts"), F.coalesce(horizon_minutes("horizon"), F.lit(0))]
    return found.orderBy(*order).limit(n)
