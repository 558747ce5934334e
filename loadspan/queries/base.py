"""Queries on sources, projections, joins, quality checks and features."""

from __future__ import annotations

from pyspark.sql import functions as F

from loadspan.config import (
    FEATURE_COLUMNS, HORIZON_STEPS, LAG_COLUMNS, ROLLING_LAG_HOURS, ROLLING_WINDOWS, SLOTS_PER_HOUR, WEATHER_COLUMNS,
    WINDOW_ROWS,
)
from loadspan.functions.time import calendar, floor_15min, steps_after, us_holiday
from loadspan.operators import features as fx
from loadspan.operators import quality, reshape
from loadspan.operators.forecast import history_hours, horizon_minutes, with_horizons
from loadspan.plans.blocks import with_position
from loadspan.queries import inputs as src
from loadspan.queries.inputs import rounded
from loadspan.queries.registry import query
from loadspan.queries.sqlbase import sql
from loadspan.sources import tables

# Columns of the wide table in the SQL; the query takes its names from the data.
REGIONS = ["click", "error", "purchase", "signup", "view"]
COMPLETE = "lag_168h IS NOT NULL AND temperature IS NOT NULL AND humidity IS NOT NULL AND solar_irradiance IS NOT NULL"
FEATURE_SQL = ", ".join(
    f"round({c} + 1e-9, 6) AS {c}" if c in LAG_COLUMNS + ["temperature", "humidity", "solar_irradiance"] else c
    for c in FEATURE_COLUMNS
)


@query("load_series", sql("SELECT l.region, l.ts, load, temperature, humidity, solar_irradiance "
       "FROM load l LEFT JOIN weather w ON w.region = l.region AND w.ts = l.ts", "load", "weather"))
def load_series(spark, d):
    return src.series(spark, d)


@query("dense_grid", sql("SELECT region, ts, load FROM load", "load"))
def dense_grid(spark, d):
    return src.load(spark, d)


@query("recent_history", sql(
    "SELECT region, ts, load FROM load, bounds WHERE ts BETWEEN hi - INTERVAL 240 HOUR AND hi", "load", "bounds"))
def recent_history(spark, d):
    return tables.load_table(src.events(spark, d), src.axis(spark, d), history_hours() * SLOTS_PER_HOUR + 1)


@query("region_canonical", sql(
    """SELECT e.event_type AS source_name, 'region_' || dense_rank() OVER (ORDER BY e.event_type) AS region, n
    FROM (SELECT event_type, count(*) AS n FROM events GROUP BY 1) e"""))
def region_canonical(spark, d):
    named = src.events(spark, d).select(F.col("event_type").alias("source_name"))
    return reshape.region_canonical(named).groupBy("source_name", "region").agg(F.count(F.lit(1)).alias("n"))


@query("long_to_wide", sql("SELECT ts, " + ", ".join(
    f"max(load) FILTER (WHERE region = '{r}') AS \"{r}\"" for r in REGIONS) + " FROM load GROUP BY ts", "load"))
def long_to_wide(spark, d):
    load = src.load(spark, d)
    return reshape.long_to_wide(load, reshape.region_names(src.regions(spark, d)), "load")


@query("wide_to_long", sql("SELECT region, ts, load FROM load", "load"))
def wide_to_long(spark, d):
    names = reshape.region_names(src.regions(spark, d))
    return reshape.wide_to_long(reshape.long_to_wide(src.load(spark, d), names, "load"), names, "load")


@query("narrow_types", """SELECT column_name, min_value, max_value,
    CASE WHEN min_value > -128 AND max_value < 127 THEN 'tinyint'
         WHEN min_value > -32768 AND max_value < 32767 THEN 'smallint'
         WHEN min_value > -2147483648 AND max_value < 2147483647 THEN 'int' ELSE 'bigint' END AS narrow_type,
    narrowed_sum FROM (
    SELECT 'l_orderkey' AS column_name, CAST(min(l_orderkey) AS BIGINT) AS min_value,
        CAST(max(l_orderkey) AS BIGINT) AS max_value, CAST(sum(l_orderkey) AS BIGINT) AS narrowed_sum FROM lineitem
    UNION ALL SELECT 'l_partkey', min(l_partkey), max(l_partkey), CAST(sum(l_partkey) AS BIGINT) FROM lineitem
    UNION ALL SELECT 'l_suppkey', min(l_suppkey), max(l_suppkey), CAST(sum(l_suppkey) AS BIGINT) FROM lineitem
    UNION ALL SELECT 'l_linenumber', min(l_linenumber), max(l_linenumber), CAST(sum(l_linenumber) AS BIGINT)
    FROM lineitem) q""")
def narrow_types(spark, d):
    columns = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber"]
    lines = src.table(spark, d, "lineitem").select(*columns, "l_quantity")
    sums = reshape.narrow_types(lines).agg(*[F.sum(c).alias(c) for c in columns])
    return reshape.integer_ranges(lines).join(
        sums.unpivot([], columns, "column_name", "narrowed_sum"), "column_name"
    )


@query("drop_warmup", sql(f"SELECT region, ts, round(load + 1e-9, 6) AS load, {FEATURE_SQL} FROM features "
       f"WHERE {COMPLETE}", "features"))
def drop_warmup(spark, d):
    return rounded(fx.quarter_hour_features(src.series(spark, d)))


@query("chrono_split", sql("""SELECT region, ts, idx, n, CASE WHEN idx < floor(n * 0.8) THEN 'train'
    WHEN idx < floor(n * 0.9) THEN 'validation' ELSE 'test' END AS part FROM (
    SELECT region, ts, row_number() OVER (PARTITION BY region ORDER BY ts) - 1 AS idx,
        count(*) OVER (PARTITION BY region) AS n FROM observed) q""", "observed"))
def chrono_split(spark, d):
    return reshape.chrono_split(tables.observed_load(src.events(spark, d))).drop("load")


@query("view_filter", sql("""SELECT ts, 'TOTAL' AS view, round(sum(load) + 1e-9, 6) AS load FROM load GROUP BY ts
    UNION ALL SELECT ts, 'click', load FROM load WHERE region = 'click'""", "load"))
def view_filter(spark, d):
    load = src.load(spark, d)
    total = reshape.view_filter(load).withColumn("view", F.lit("TOTAL"))
    one = reshape.view_filter(load, "click").withColumn("view", F.lit("click"))
    return rounded(total.unionByName(one))


@query("coerce_numeric", """SELECT event_type AS region,
    round(coalesce(avg(TRY_CAST(reading AS DOUBLE)), 20.0) + 1e-9, 6) AS temperature FROM (
    SELECT event_type, CASE WHEN event_type = 'error' THEN json_extract_string(props, '$.k') || ' C'
        WHEN value > 100 THEN 'n/a' ELSE json_extract_string(props, '$.k') END AS reading FROM events) q
    GROUP BY event_type""")
def coerce_numeric(spark, d):
    k = F.get_json_object("props", "$.k")
    reading = (
        F.when(F.col("event_type") == "error", F.concat(k, F.lit(" C")))
        .when(F.col("value") > 100, "n/a")
        .otherwise(k)
    )
    text = src.events(spark, d).select(F.col("event_type").alias("region"), reading.alias("reading"))
    default = reshape.WEATHER_DEFAULTS["temperature"]
    return rounded(reshape.coerced_mean(text, ["region"], "reading", default, "temperature"))


@query("weather_join", sql("""SELECT o.region, o.ts, o.load, w.temperature, w.humidity, w.solar_irradiance
    FROM observed o LEFT JOIN sensed w ON w.region = o.region AND w.ts = o.ts AND w.humidity > 1""",
    "observed", "sensed"))
def weather_join(spark, d):
    events = src.events(spark, d)
    return fx.weather_join(tables.observed_load(events), tables.observed_weather(events).filter("humidity > 1"))


@query("target_align", sql(f"""SELECT region, ts, load FROM load l WHERE EXISTS (
    SELECT 1 FROM features f WHERE f.region = l.region AND f.ts = l.ts AND {COMPLETE})""",
    "load", "features"))
def target_align(spark, d):
    return reshape.target_align(src.load(spark, d), fx.quarter_hour_features(src.series(spark, d)))


@query("alignment_check", sql("""SELECT coalesce(o.region, w.region) AS region,
    count(*) FILTER (WHERE o.region IS NOT NULL AND w.region IS NOT NULL) AS matched,
    count(*) FILTER (WHERE w.region IS NULL) AS left_only, count(*) FILTER (WHERE o.region IS NULL) AS right_only
    FROM observed o FULL OUTER JOIN weather w ON w.region = o.region AND w.ts = o.ts GROUP BY 1""",
    "observed", "weather"))
def alignment_check(spark, d):
    return quality.alignment_check(tables.observed_load(src.events(spark, d)), src.weather(spark, d))


@query("grid_regularity", sql("""SELECT region, kind, count(*) AS rows,
    count(*) FILTER (WHERE prev IS NOT NULL AND ts - prev <> INTERVAL 15 MINUTE) AS irregular_steps,
    count(*) FILTER (WHERE minute(ts) % 15 <> 0) AS off_grid_minutes,
    count(*) FILTER (WHERE date_trunc('minute', ts) <> ts) AS with_seconds FROM (
    SELECT region, kind, ts, lag(ts) OVER (PARTITION BY region, kind ORDER BY ts) AS prev FROM (
        SELECT region, 'dense' AS kind, ts FROM load UNION ALL SELECT region, 'observed', ts FROM observed
        UNION ALL SELECT event_type, 'raw', ts FROM events) u) q GROUP BY region, kind""", "load"))
def grid_regularity(spark, d):
    events = src.events(spark, d)
    raw = events.select(F.col("event_type").alias("region"), "ts")
    kinds = {"dense": src.load(spark, d), "observed": tables.observed_load(events), "raw": raw}
    out = None
    for kind, series in kinds.items():
        part = quality.grid_regularity(series.select("region", "ts")).withColumn("kind", F.lit(kind))
        out = part if out is None else out.unionByName(part)
    return out


@query("range_validation", sql("""SELECT 'load_null' AS rule, count(*) FILTER (WHERE load IS NULL) AS violations FROM load
    UNION ALL SELECT 'load_negative', count(*) FILTER (WHERE load < 0) FROM load
    UNION ALL SELECT 'temperature_null', count(*) FILTER (WHERE temperature IS NULL) FROM weather
    UNION ALL SELECT 'temperature_range', count(*) FILTER (WHERE temperature NOT BETWEEN -50 AND 60) FROM weather
    UNION ALL SELECT 'humidity_null', count(*) FILTER (WHERE humidity IS NULL) FROM weather
    UNION ALL SELECT 'humidity_range', count(*) FILTER (WHERE humidity NOT BETWEEN 0 AND 100) FROM weather
    UNION ALL SELECT 'wind_speed_null', count(*) FILTER (WHERE solar_irradiance - 5 IS NULL) FROM weather
    UNION ALL SELECT 'wind_speed_negative', count(*) FILTER (WHERE solar_irradiance - 5 < 0) FROM weather""",
    "load", "weather"))
def range_validation(spark, d):
    weather = src.weather(spark, d).withColumn("wind_speed", F.col("solar_irradiance") - 5)
    return quality.range_validation(src.load(spark, d), weather)


@query("calendar_features", sql("""SELECT o_orderkey, CAST(hour(ts) AS INTEGER) AS hour,
    CAST(isodow(ts) - 1 AS INTEGER) AS day_of_week, CAST(month(ts) AS INTEGER) AS month,
    CAST(isodow(ts) >= 6 AS INTEGER) AS is_weekend,
    CAST(CAST(ts AS DATE) IN (SELECT d FROM holidays) AS INTEGER) AS is_holiday
    FROM (SELECT o_orderkey, o_orderdate AS ts FROM orders) o""", "holidays"))
def calendar_features(spark, d):
    return src.table(spark, d, "orders").select(
        "o_orderkey", *[c.alias(n) for n, c in calendar("o_orderdate").items()]
    )


@query("us_holiday_flag", sql("""SELECT date_trunc('day', o_orderdate) AS day, count(*) AS orders_placed FROM orders
    WHERE CAST(o_orderdate AS DATE) IN (SELECT d FROM holidays) GROUP BY 1""", "holidays"))
def us_holiday_flag(spark, d):
    return (
        src.table(spark, d, "orders")
        .filter(us_holiday("o_orderdate"))
        .groupBy(F.col("o_orderdate").cast("date").cast("timestamp_ntz").alias("day"))
        .agg(F.count(F.lit(1)).alias("orders_placed"))
    )


@query("floor_15min", """SELECT event_id, date_trunc('hour', ts) + to_minutes(CAST(floor(minute(ts) / 15) * 15 AS INTEGER))
    AS slot FROM events""")
def floor_15min_query(spark, d):
    return src.events(spark, d).select("event_id", floor_15min("ts").alias("slot"))


@query("lag_features", sql("""SELECT region, ts, lag(load, 4) OVER w AS lag_1h, lag(load, 24) OVER w AS lag_6h,
    lag(load, 96) OVER w AS lag_24h, lag(load, 192) OVER w AS lag_48h, lag(load, 672) OVER w AS lag_168h
    FROM load WINDOW w AS (PARTITION BY region ORDER BY ts)""", "load"))
def lag_features(spark, d):
    return fx.lag_features(src.load(spark, d)).drop("load")


HOURLY = """hourly AS (SELECT l.region, time_bucket(INTERVAL 1 HOUR, l.ts) AS ts, round(avg(load) + 1e-9, 6) AS load,
    round(avg(temperature) + 1e-9, 6) AS temperature, round(avg(humidity) + 1e-9, 6) AS humidity,
    round(avg(solar_irradiance) + 1e-9, 6) AS solar_irradiance
    FROM load l JOIN weather w ON w.region = l.region AND w.ts = l.ts GROUP BY 1, 2)"""


@query("hourly_resample", sql("SELECT * FROM hourly", "load", "weather", extra=HOURLY))
def hourly_resample(spark, d):
    return rounded(fx.hourly_resample(src.series(spark, d), ["load", "temperature", "humidity", "solar_irradiance"]))


@query("hourly_lag_features", sql("""SELECT * FROM (SELECT region, ts, load, CAST(hour(ts) AS INTEGER) AS hour,
    CAST(isodow(ts) - 1 AS INTEGER) AS day_of_week, CAST(month(ts) AS INTEGER) AS month,
    CAST(isodow(ts) >= 6 AS INTEGER) AS is_weekend,
    CAST(CAST(ts AS DATE) IN (SELECT d FROM holidays) AS INTEGER) AS is_holiday,
    lag(load, 1) OVER w AS lag_1h, lag(load, 6) OVER w AS lag_6h, lag(load, 24) OVER w AS lag_24h,
    lag(load, 48) OVER w AS lag_48h, lag(load, 168) OVER w AS lag_168h, temperature, humidity, solar_irradiance
    FROM hourly WINDOW w AS (PARTITION BY region ORDER BY ts)) q WHERE lag_168h IS NOT NULL AND temperature IS NOT NULL
        AND humidity IS NOT NULL AND solar_irradiance IS NOT NULL""",
    "load", "weather", "holidays", extra=HOURLY))
def hourly_lag_features(spark, d):
    return rounded(fx.hourly_features(src.series(spark, d)))


@query("lead_target", sql("""SELECT region, ts, load, lead(load, 96) OVER (PARTITION BY region ORDER BY ts) AS target
    FROM load""", "load"))
def lead_target(spark, d):
    return fx.lead_target(src.load(spark, d), HORIZON_STEPS["24h"])




def _digest(values):
    return F.md5(F.array_join(F.transform(values, lambda x: F.round(x * 100).cast("bigint").cast("string")), ","))


@query("sliding_window_array", sql("""SELECT region, ts, len(w) AS n_rows, round(w[1] + 1e-9, 6) AS oldest, round(w[96] + 1e-9, 6) AS newest,
    md5(array_to_string([CAST(CAST(round(x * 100) AS BIGINT) AS VARCHAR) FOR x IN w], ',')) AS digest FROM (
    SELECT region, ts, list(load) OVER (PARTITION BY region ORDER BY ts ROWS BETWEEN 96 PRECEDING AND 1 PRECEDING) AS w
    FROM load) q WHERE len(w) = 96""", "load"))
def sliding_window_array(spark, d):
    windows = fx.full_windows(fx.sliding_window_array(src.load(spark, d), ["load"]))
    flat = windows.withColumn("w", fx.flatten_window("window"))
    return flat.select(
        "region", "ts", F.size("w").cast("bigint").alias("n_rows"), F.round(F.col("w")[0], 6).alias("oldest"),
        F.round(F.element_at("w", -1), 6).alias("newest"), _digest(F.col("w")).alias("digest"),
    )


@query("left_pad_window", sql("""SELECT region, ts, len(w) AS n_values,
    md5(array_to_string([CAST(CAST(round(x * 100) AS BIGINT) AS VARCHAR) FOR x IN w], ',')) AS digest FROM (
    SELECT region, ts, list_concat([0.0 FOR x IN range(96 - len(l))], l) AS w FROM (
        SELECT region, ts, list(load) OVER (PARTITION BY region ORDER BY ts ROWS BETWEEN 95 PRECEDING AND CURRENT ROW) AS l
        FROM load) p) q""", "load"))
def left_pad_window(spark, d):
    windows = fx.sliding_window_array(src.load(spark, d), ["load"], include_current=True)
    padded = windows.withColumn("w", fx.left_pad_window(fx.flatten_window("window"), WINDOW_ROWS))
    return padded.select("region", "ts", F.size("w").cast("bigint").alias("n_values"), _digest(F.col("w")).alias("digest"))


@query("flatten_window", sql("""SELECT region, ts, len(w) AS n_values,
    md5(array_to_string([CAST(CAST(round(x * 100) AS BIGINT) AS VARCHAR) FOR x IN w], ',')) AS digest FROM (
    SELECT region, ts, flatten(list([hour, day_of_week, month, is_weekend, is_holiday, lag_1h, lag_6h, lag_24h, lag_48h,
        lag_168h, coalesce(temperature, 0), coalesce(humidity, 0), coalesce(solar_irradiance, 0)]) OVER (PARTITION BY region ORDER BY ts
        ROWS BETWEEN 96 PRECEDING AND 1 PRECEDING)) AS w
    FROM features WHERE lag_168h IS NOT NULL) q WHERE len(w) = 1248""", "features"))
def flatten_window(spark, d):
    # windows count rows, so they need every step: missing weather is 0 here, by choice of this query
    features = fx.quarter_hour_features(src.series(spark, d).na.fill(0.0, WEATHER_COLUMNS))
    windows = fx.full_windows(fx.sliding_window_array(features, FEATURE_COLUMNS))
    flat = windows.withColumn("w", fx.flatten_window("window"))
    return flat.select("region", "ts", F.size("w").cast("bigint").alias("n_values"), _digest(F.col("w")).alias("digest"))


@query("rolling_features", sql("SELECT region, ts, " + ", ".join(
    f"CASE WHEN count(load) OVER (PARTITION BY region ORDER BY ts ROWS BETWEEN {r - 1} PRECEDING AND CURRENT ROW) = {r} "
    f"THEN round(avg(load) OVER (PARTITION BY region ORDER BY ts ROWS BETWEEN {r - 1} PRECEDING AND CURRENT ROW) + 1e-9, 6) END "
    f"AS mean_{r}" for r in ROLLING_WINDOWS) + ", " + ", ".join(
    f"round(lag(load, {h * 4}) OVER (PARTITION BY region ORDER BY ts) + 1e-9, 6) AS lag_{h}h" for h in ROLLING_LAG_HOURS)
    + " FROM load", "load"))
def rolling_features(spark, d):
    return rounded(fx.rolling_features(src.load(spark, d), ROLLING_WINDOWS, ROLLING_LAG_HOURS).drop("load"))


@query("series_index", sql("""SELECT region, ts, row_number() OVER (PARTITION BY region ORDER BY ts) - 1 AS idx
    FROM observed""", "observed"))
def series_index(spark, d):
    return with_position(tables.observed_load(src.events(spark, d)), ["region"], "ts").drop("load")


@query("horizon_steps", sql("""SELECT l.region, h.horizon, h.steps, count(*) AS origins,
    max(l.ts + to_minutes(h.steps * 15)) AS last_target,
    h.steps * 15 = CASE h.horizon WHEN '15min' THEN 15 WHEN '1h' THEN 60 WHEN '6h' THEN 360 WHEN '12h' THEN 720
        WHEN '24h' THEN 1440 ELSE 2880 END AS consistent
    FROM observed l CROSS JOIN horizons h GROUP BY l.region, h.horizon, h.steps""", "observed", "horizons"))
def horizon_steps(spark, d):
    origins = with_horizons(tables.observed_load(src.events(spark, d)))
    target = steps_after("ts", F.col("steps"), F.col("cadence_minutes"))
    consistent = F.col("steps") * F.col("cadence_minutes") == horizon_minutes("horizon")
    return origins.groupBy("region", "horizon", "steps").agg(
        F.count(F.lit(1)).alias("origins"), F.max(target).alias("last_target"),
        F.bool_and(consistent).alias("consistent"),
    )
