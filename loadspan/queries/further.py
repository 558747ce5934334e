"""Queries on operators that the other modules use in part: gaps, persistence, hourly horizons, day folders, narrow floats."""

from __future__ import annotations

from pyspark.sql import functions as F

from loadspan.config import HOURLY_HORIZON_STEPS, SLOTS_PER_WEEK
from loadspan.functions.text import metric_text
from loadspan.operators import features as fx
from loadspan.operators import forecast as fc
from loadspan.operators import quality, reshape, topology
from loadspan.plans.ranges import asof_join
from loadspan.queries import inputs as src
from loadspan.queries.analytics import EDGES
from loadspan.queries.inputs import rounded
from loadspan.queries.registry import query
from loadspan.queries.sqlbase import sql
from loadspan.session import shared_dir
from loadspan.sources import tables


@query("missing_rows", sql("""SELECT l.region, l.ts FROM load l LEFT JOIN observed o ON o.region = l.region AND o.ts = l.ts
    WHERE o.region IS NULL""", "load", "observed"))
def missing_rows(spark, d):
    """Steps of the grid without any event."""
    return quality.missing_rows(src.load(spark, d), tables.observed_load(src.events(spark, d)))


@query("last_value_forecast", sql("""SELECT region, CAST(n.i AS INTEGER) AS step, ts + to_minutes(CAST(n.i * 15 AS INTEGER)) AS ts, load AS point
    FROM latest CROSS JOIN (SELECT unnest(generate_series(1, 192)) AS i) n""", "latest"))
def last_value_forecast(spark, d):
    return fc.last_value_forecast(src.latest(spark, d), src.end(spark, d))


@query("hourly_horizons", sql("""SELECT h.region, z.horizon, CAST(z.steps AS INTEGER) AS steps, count(*) AS origins, 0 AS invalid
    FROM (SELECT DISTINCT region, time_bucket(INTERVAL 1 HOUR, ts) AS ts FROM load) h
    CROSS JOIN (VALUES ('24h', 24), ('48h', 48)) z(horizon, steps) GROUP BY 1, 2, 3""", "load"))
def hourly_horizons(spark, d):
    """Origins at hourly cadence, and those whose steps do not span their horizon."""
    paired = fc.with_horizons(fx.hourly_resample(src.load(spark, d), ["load"]), HOURLY_HORIZON_STEPS, cadence=60)
    bad = fc.validate_horizons(paired).groupBy("region", "horizon", "steps").agg(F.count(F.lit(1)).alias("bad"))
    counted = paired.groupBy("region", "horizon", "steps").agg(F.count(F.lit(1)).alias("origins"))
    return counted.join(bad, ["region", "horizon", "steps"], "left").select(
        "region", "horizon", "steps", "origins", F.coalesce("bad", F.lit(0)).cast("int").alias("invalid")
    )


@query("series_by_day", sql("""SELECT region, ts, load FROM load, bounds
    WHERE CAST(ts AS DATE) BETWEEN CAST(hi AS DATE) - 2 AND CAST(hi AS DATE) - 1""", "load", "bounds"))
def series_by_day(spark, d):
    """The two days before the newest one, from a table in folders of days."""
    path = shared_dir(spark, "series")
    tables.write_series(src.load(spark, d), path)
    last = src.axis(spark, d).newest.date()
    return tables.read_series(spark, path, tables.days_before(last, 2), tables.days_before(last, 1))


@query("trailing_by_day", sql("SELECT region, ts, load FROM recent", "recent"))
def trailing_by_day(spark, d):
    """The trailing week of a table in folders of days, with names and axis from beside it."""
    path = shared_dir(spark, "series")
    load = src.load(spark, d)
    tables.write_series(load, f"{path}/series")
    tables.write_regions(load, f"{path}/regions")
    axis = tables.axis_of_days(spark, f"{path}/series")
    return tables.trailing_series(spark, f"{path}/series", tables.read_regions(spark, f"{path}/regions"), axis, SLOTS_PER_WEEK)


@query("recent_hours", sql("SELECT region, ts, load FROM load, bounds WHERE ts BETWEEN hi - INTERVAL 36 HOUR AND hi", "load", "bounds"))
def recent_hours(spark, d):
    return reshape.recent_history(src.load(spark, d), 36, src.end(spark, d))


@query("known_edges", sql("""SELECT src, dst, flow FROM edges WHERE src IN (SELECT region FROM nodes WHERE load > 50)
    AND dst IN (SELECT region FROM nodes WHERE load > 50)""", "load_daily", extra=EDGES))
def known_edges(spark, d):
    parts = [src.table(spark, d, t) for t in ("lineitem", "supplier", "orders", "customer", "nation", "region")]
    nodes = src.load_daily(spark, d, latest_only=True).filter("load > 0").filter("load / 1000 > 50")
    return topology.known_edges(tables.flow_edges(*parts), nodes)


@query("metric_text", sql("SELECT region, printf('%.1f MW', mean) AS body FROM (SELECT region, round(avg(load) + 1e-9, 6) AS mean FROM load GROUP BY region) q", "load"))
def metric_text_query(spark, d):
    means = rounded(src.load(spark, d).groupBy("region").agg(F.avg("load").alias("mean")))
    return means.select("region", metric_text("mean", "MW").alias("body"))


@query("narrow_floats", """SELECT l_orderkey, l_linenumber, CAST(CAST(l_extendedprice AS FLOAT) AS DOUBLE) AS price,
    CAST(CAST(l_quantity AS FLOAT) AS DOUBLE) AS quantity FROM lineitem""")
def narrow_floats(spark, d):
    lines = src.table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_extendedprice", "l_quantity")
    narrow = reshape.narrow_types(lines)
    return narrow.select(
        F.col("l_orderkey").cast(lines.schema["l_orderkey"].dataType).alias("l_orderkey"),
        F.col("l_linenumber").cast(lines.schema["l_linenumber"].dataType).alias("l_linenumber"),
        F.col("l_extendedprice").cast("double").alias("price"), F.col("l_quantity").cast("double").alias("quantity"),
    )


@query("asof_events", """SELECT p.event_id, c.ts AS found_ts, c.value AS last_value FROM (SELECT * FROM events WHERE event_type = 'purchase') p
    LEFT JOIN (SELECT p.event_id, c.ts, c.value FROM (SELECT * FROM events WHERE event_type = 'purchase') p
        ASOF JOIN (SELECT * FROM events WHERE event_type = 'click') c ON p.user_id = c.user_id AND p.ts >= c.ts
        WHERE c.ts >= p.ts - INTERVAL 2 DAY) c ON c.event_id = p.event_id""")
def asof_events(spark, d):
    """The last click of the same user within two days before each purchase."""
    events = src.events(spark, d).select("event_id", "ts", "user_id", "event_type", "value")
    clicks = events.filter("event_type = 'click'").withColumnRenamed("value", "last_value")
    bought = events.filter("event_type = 'purchase'").select("event_id", "ts", "user_id")
    return asof_join(bought, clicks, ["user_id"], "ts", ["last_value"], "2 DAYS").select("event_id", "found_ts", "last_value")
