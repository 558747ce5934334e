"""Queries on statistics, totals, shares, rankings and the network."""

from __future__ import annotations

from pyspark.sql import functions as F

from loadspan.operators import features as fx
from loadspan.operators import reshape, stats, topology
from loadspan.operators import forecast as fc
from loadspan.operators.anomaly import total_diff
from loadspan.queries import inputs as src
from loadspan.queries.inputs import rounded
from loadspan.queries.registry import query
from loadspan.queries.sqlbase import sql
from loadspan.sources import tables


@query("region_stats", sql("SELECT region, round(mean + 1e-9, 6) AS mean, round(std + 1e-9, 6) AS std FROM stats", "stats"))
def region_stats(spark, d):
    return rounded(stats.region_stats(src.recent(spark, d)))


@query("region_status", sql("""SELECT l.region, l.ts, round(load + 1e-9, 6) AS load, round(mean + 1e-9, 6) AS mean,
    round(std + 1e-9, 6) AS std, round(abs((load - mean) / std), 6) AS z_score,
    round(abs((load - mean) / std), 6) > 2.5 AS is_anomaly
    FROM latest l JOIN stats s ON s.region = l.region""", "latest", "stats"))
def region_status(spark, d):
    from loadspan.operators.anomaly import region_status as status

    return rounded(status(src.recent(spark, d)))


@query("stats_broadcast", sql("""SELECT r.region, r.ts, round(r.load + 1e-9, 6) AS load, round(s.mean + 1e-9, 6) AS region_mean,
    round(t.mean + 1e-9, 6) AS system_mean, round((r.load - s.mean) / s.std + 1e-9, 6) AS z
    FROM recent r JOIN stats s ON s.region = r.region CROSS JOIN total_stats t""", "recent", "stats", "total_stats"))
def stats_broadcast(spark, d):
    from loadspan.operators.anomaly import total_stats

    window = src.recent(spark, d)
    system_mean, _ = total_stats(window)
    joined = window.join(stats.region_stats(window), "region")
    return rounded(joined.select(
        "region", "ts", "load", F.col("mean").alias("region_mean"), system_mean.alias("system_mean"),
        ((F.col("load") - F.col("mean")) / F.col("std")).alias("z"),
    ))


@query("system_total", sql("SELECT ts, round(total + 1e-9, 6) AS total FROM total", "total"))
def system_total(spark, d):
    return rounded(stats.system_total(src.load(spark, d)))


SHARE = """shares AS (SELECT l.region, l.ts, l.load, t.total,
    CASE WHEN total > 0 THEN load / total ELSE 0.0 END AS share, load / nullif(total, 0) AS ratio
    FROM {0} l JOIN {1} t ON t.ts = l.ts)"""
ALL_SHARES = SHARE.format("load", "total")
RECENT_SHARES = SHARE.format("recent", "recent_total")
SHARE_STATS = RECENT_SHARES + """, share_raw AS (SELECT region, avg(ratio) AS m, stddev_samp(ratio) AS s,
    (SELECT count(DISTINCT region) FROM shares) AS n FROM shares GROUP BY region),
    share_mean AS (SELECT region, CASE WHEN m > 0 AND s IS NOT NULL THEN m ELSE 1.0 / n END AS share_mean, s FROM share_raw),
    share_stats AS (SELECT region, share_mean,
    greatest(CASE WHEN s > 0 THEN s ELSE share_mean * 0.2 END, 1e-6) AS share_std FROM share_mean)"""


@query("load_share", sql("""SELECT region, ts, round(load + 1e-9, 6) AS load, round(total + 1e-9, 6) AS total,
    round(share + 1e-9, 6) AS share, round(share * 100 + 1e-9, 6) AS share_percent FROM shares""",
    "load", "total", extra=ALL_SHARES))
def load_share(spark, d):
    return rounded(stats.load_share(src.load(spark, d)).drop("ratio"))


@query("finite_filter", sql("""SELECT region, ts, round(ratio + 1e-9, 6) AS ratio FROM shares WHERE ts NOT IN (
    SELECT ts FROM shares WHERE ratio IS NULL OR isnan(ratio) OR isinf(ratio))""", "load", "total", extra=ALL_SHARES))
def finite_filter(spark, d):
    shares = stats.load_share(src.load(spark, d)).select("region", "ts", "ratio")
    return rounded(reshape.finite_filter(shares, "ratio"))


@query("share_stats", sql("""SELECT region, round(share_mean + 1e-9, 6) AS share_mean,
    round(share_std + 1e-9, 6) AS share_std FROM share_stats""", "recent", "recent_total", extra=SHARE_STATS))
def share_stats(spark, d):
    return rounded(stats.share_stats(stats.load_share(src.recent(spark, d))))


@query("weather_average", sql("""SELECT round(avg(temperature) + 1e-9, 6) AS temperature, round(avg(humidity) + 1e-9, 6) AS humidity,
    round(avg(solar_irradiance) + 1e-9, 6) AS solar_irradiance FROM weather, bounds WHERE ts = hi""", "weather", "bounds"))
def weather_average(spark, d):
    return rounded(stats.weather_average(src.latest_weather(spark, d)))


@query("residual_quantile", sql("""SELECT region, round(quantile_cont(abs(load - p), 0.95) + 1e-9, 6) AS qhat FROM (
    SELECT region, load, lag(load, 672) OVER (PARTITION BY region ORDER BY ts) AS p FROM load) q
    WHERE p IS NOT NULL GROUP BY region""", "load"))
def residual_quantile(spark, d):
    return rounded(fc.residual_quantile(fc.naive_residuals(src.load(spark, d))))


@query("daily_peak_trough", sql("""SELECT region, ts, round(peak + 1e-9, 6) AS peak, round(trough + 1e-9, 6) AS trough,
    round(load_factor + 1e-9, 6) AS load_factor,
    round((peak - lag(peak) OVER w) / nullif(lag(peak) OVER w, 0) * 100 + 1e-9, 6) AS peak_change,
    round((trough - lag(trough) OVER w) / nullif(lag(trough) OVER w, 0) * 100 + 1e-9, 6) AS trough_change,
    round((load_factor - lag(load_factor) OVER w) / nullif(lag(load_factor) OVER w, 0) * 100 + 1e-9, 6) AS load_factor_change
    FROM (SELECT region, date_trunc('day', ts) AS ts, max(load) AS peak, min(load) AS trough,
        avg(load) / nullif(max(load), 0) AS load_factor FROM load GROUP BY 1, 2) q
    WINDOW w AS (PARTITION BY region ORDER BY ts)""", "load"))
def daily_peak_trough(spark, d):
    return rounded(stats.daily_peak_trough(src.load(spark, d)))


@query("error_histogram", sql("""SELECT CAST(least(29, floor((e - lo) / nullif((hi - lo) / 30, 0))) AS INTEGER) AS bin,
    count(*) AS n FROM (SELECT e, min(e) OVER () AS lo, max(e) OVER () AS hi FROM (
    SELECT load - lag(load, 672) OVER (PARTITION BY region ORDER BY ts) AS e FROM load) p WHERE e IS NOT NULL) q
    GROUP BY 1""", "load"))
def error_histogram(spark, d):
    errors = fc.naive_residuals(src.load(spark, d)).select((F.col("load") - F.col("predicted")).alias("error"))
    return stats.error_histogram(errors, "error")


@query("region_and_total", sql("""SELECT region, round(avg(load) + 1e-9, 6) AS mean,
    round(CASE WHEN stddev_samp(load) > 0 THEN stddev_samp(load) ELSE 1e-6 END + 1e-9, 6) AS std,
    round(max(load) + 1e-9, 6) AS peak, round(sum(load), 4) AS energy FROM (
    SELECT region, load FROM load UNION ALL SELECT 'TOTAL', total FROM total) u GROUP BY region""", "load", "total"))
def region_and_total(spark, d):
    table = rounded(stats.region_and_total(src.load(spark, d)))
    return table.withColumn("energy", F.round("energy", 4))


@query("regional_mean_compare", sql("""SELECT region, round(avg(load) + 1e-9, 2) AS mean,
    CAST(rank() OVER (ORDER BY round(avg(load) + 1e-9, 6) DESC) AS INTEGER) AS rank FROM load_daily GROUP BY region""", "load_daily"))
def regional_mean_compare(spark, d):
    return rounded(stats.regional_mean_compare(src.load_daily(spark, d)), 2)


@query("trailing_7d", sql("SELECT region, ts, load FROM recent", "recent"))
def trailing_7d(spark, d):
    return src.recent(spark, d)


@query("total_diff", sql("SELECT ts, round(total + 1e-9, 6) AS total, round(total - lag(total) OVER (ORDER BY ts) + 1e-9, 6) AS diff FROM total", "total"))
def total_diff_query(spark, d):
    return rounded(total_diff(stats.system_total(src.load(spark, d))))


@query("rolling_mean_24", sql("""SELECT ts, round(total + 1e-9, 6) AS total,
    CASE WHEN count(total) OVER w = 24 THEN round(avg(total) OVER w + 1e-9, 6) END AS mean_24
    FROM total WINDOW w AS (ORDER BY ts ROWS BETWEEN 23 PRECEDING AND CURRENT ROW)""", "total"))
def rolling_mean_24(spark, d):
    return rounded(fx.rolling_mean(stats.system_total(src.load(spark, d)), 24, "total", "mean_24", keys=()))


@query("latest_row", sql("""SELECT region, max(ts) AS ts, round(arg_max(load, ts) + 1e-9, 6) AS load FROM observed
    GROUP BY region""", "observed"))
def latest_row(spark, d):
    observed = tables.observed_load(src.events(spark, d))
    return observed.groupBy("region").agg(F.max("ts").alias("ts"), F.max_by("load", "ts").alias("load"))


@query("sorted_regions", sql("SELECT region, count(*) AS steps FROM observed GROUP BY region ORDER BY region", "observed"))
def sorted_regions(spark, d):
    observed = tables.observed_load(src.events(spark, d))
    return observed.groupBy("region").agg(F.count(F.lit(1)).alias("steps")).orderBy("region")


@query("load_band", sql("""SELECT region, ts, load, CASE WHEN load > 500 THEN 'red' WHEN load > 300 THEN 'orange'
    ELSE 'green' END AS band FROM observed""", "observed"))
def load_band(spark, d):
    return tables.observed_load(src.events(spark, d)).withColumn("band", topology.load_band("load"))


@query("stress_points", sql("""SELECT region, ts, load, CASE WHEN load > 550 THEN 'high' ELSE 'medium' END AS stress_level
    FROM observed WHERE load > 500""", "observed"))
def stress_points(spark, d):
    return topology.stress_points(tables.observed_load(src.events(spark, d)))


@query("capacity_utilisation", sql("""SELECT d.region, load AS used, round(capacity, 2) AS capacity,
    round(capacity - load, 2) AS available, round(load / capacity + 1e-9, 6) AS utilisation
    FROM load_daily d JOIN (SELECT region, max(load) * 1.25 AS capacity FROM load_daily GROUP BY region) c
    ON c.region = d.region WHERE ts = (SELECT max(ts) FROM load_daily)""", "load_daily"))
def capacity_utilisation(spark, d):
    daily = src.load_daily(spark, d)
    table = topology.capacity_utilisation(src.load_daily(spark, d, latest_only=True), topology.capacity_dim(daily))
    return rounded(table).withColumns({"capacity": F.round("capacity", 2), "available": F.round("available", 2)})


EDGES = """edges AS (SELECT rs.r_name AS src, rc.r_name AS dst, round(sum(l_extendedprice), 2) AS flow
    FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN orders ON l_orderkey = o_orderkey
    JOIN customer ON o_custkey = c_custkey JOIN nation ns ON s_nationkey = ns.n_nationkey
    JOIN region rs ON ns.n_regionkey = rs.r_regionkey JOIN nation nc ON c_nationkey = nc.n_nationkey
    JOIN region rc ON nc.n_regionkey = rc.r_regionkey GROUP BY 1, 2),
    nodes AS (SELECT region, load / 1000 AS load FROM load_daily WHERE ts = (SELECT max(ts) FROM load_daily) AND load > 0)"""
BAND = "CASE WHEN {0}.load > 500 THEN 'red' WHEN {0}.load > 300 THEN 'orange' ELSE 'green' END"


@query("topology_join", sql(f"""SELECT src, dst, flow, round(a.load + 1e-9, 6) AS src_load, {BAND.format('a')} AS src_band,
    round(b.load + 1e-9, 6) AS dst_load, {BAND.format('b')} AS dst_band,
    CASE WHEN round(flow / sum(flow) OVER (PARTITION BY src) + 1e-9, 6) >= 0.2 THEN 'congested' ELSE 'normal' END AS status
    FROM edges JOIN nodes a ON a.region = src JOIN nodes b ON b.region = dst""", "load_daily", extra=EDGES))
def topology_join(spark, d):
    parts = [src.table(spark, d, t) for t in ("lineitem", "supplier", "orders", "customer", "nation", "region")]
    nodes = src.load_daily(spark, d, latest_only=True).filter("load > 0").select(
        "region", (F.col("load") / 1000).alias("load")
    )
    joined = topology.topology_join(tables.flow_edges(*parts), nodes)
    return rounded(topology.connection_status(joined))
