"""Queries on snapshot documents, reports and their files."""

from __future__ import annotations

from pyspark.sql import functions as F

from loadspan.config import SLOTS_PER_WEEK
from loadspan.functions.time import floor_day
from loadspan.operators import anomaly as an
from loadspan.operators import backtest as bt
from loadspan.operators import forecast as fc
from loadspan.operators import stats
from loadspan.queries import inputs as src
from loadspan.queries.anomalies import THRESHOLDS
from loadspan.queries.backtests import NUMBER, PERCENT, SERIES, SUMMARY_LINES, weekly
from loadspan.queries.inputs import rounded
from loadspan.queries.registry import query
from loadspan.queries.sqlbase import sql
from loadspan.session import shared_dir
from loadspan.sources import reports, snapshot, tables
from loadspan.sources.stage import staged
from loadspan.sources.versions import newest

ANY_REGION = "^[a-z_0-9]+$"


def documents(spark, d):
    """JSON documents of a day and region each, in one of three versions by the day of the month; every fifth has a text for a number."""
    daily = tables.observed_load(src.events(spark, d)).groupBy(floor_day("ts").alias("day"), "region").agg(
        F.round(F.sum("load"), 2).alias("load")
    )
    nested = daily.select("day", "region", F.create_map("region", "load").alias("m"))
    dom = F.dayofmonth("day")
    loads = F.to_json("m")
    predicted = F.to_json(F.transform_values("m", lambda k, v: F.create_map(F.lit("24h"), v)))
    ranges = F.to_json(F.transform_values("m", lambda k, v: F.create_map(
        F.lit("24h"), F.struct((v * 0.9).alias("lower"), (v * 1.1).alias("upper")))))
    head = F.concat(
        F.lit('{"timestamp":"'), snapshot.iso(F.col("day")), F.lit('","anomalies":[],"current_load":'), loads,
        F.lit(',"intervals":'), ranges, F.lit(',"predictions":'),
        F.when(dom % 5 == 0, F.regexp_replace(predicted, '"24h":[0-9.E]+', '"24h":"unknown"')).otherwise(predicted),
    )
    body = (
        F.when(dom % 3 == 0, F.concat(head, F.lit(',"schema_version":"1.0.0"}')))
        .when(dom % 3 == 1, F.concat(head, F.lit(',"schema_version":"1.1.0","forecast_paths":{},"interval_paths":{}}')))
        .otherwise(F.concat(head, F.lit(
            ',"schema_version":"1.2.0","forecast_paths":{},"interval_paths":{},'
            '"weather":{"temperature":21.5,"humidity":60.0,"solar_irradiance":0.0}}')))
    )
    return nested.select(F.concat(snapshot.iso(F.col("day")), F.lit("/"), F.col("region")).alias("doc_id"), body.alias("body"))


@query("snapshot_validate", sql("""SELECT doc_id, rule, path FROM (SELECT strftime(day, '%Y-%m-%dT%H:%M:%S') || '/' || region AS doc_id, 'not_a_number' AS rule,
    'predictions.' || region || '.24h' AS path, dayofmonth(day) AS dom FROM (
    SELECT DISTINCT date_trunc('day', ts) AS day, region FROM observed) g) q WHERE dom % 5 = 0""", "observed"))
def snapshot_validate(spark, d):
    return snapshot.validate(documents(spark, d), ANY_REGION)


@query("snapshot_migrate", sql("""SELECT strftime(day, '%Y-%m-%dT%H:%M:%S') || '/' || region AS doc_id, '1.2.0' AS schema_version,
    CAST(0 AS BIGINT) AS paths, CAST(0 AS BIGINT) AS interval_paths,
    CAST(CASE WHEN dayofmonth(day) % 3 = 2 THEN 21.5 ELSE 20.0 END AS DOUBLE) AS temperature,
    CAST(CASE WHEN dayofmonth(day) % 3 = 2 THEN 60.0 ELSE 0.5 END AS DOUBLE) AS humidity,
    CAST(CASE WHEN dayofmonth(day) % 3 = 2 THEN 0.0 ELSE 500.0 END AS DOUBLE) AS solar_irradiance,
    round(sum(load) + 1e-9, 6) AS total_load
    FROM (SELECT date_trunc('day', ts) AS day, region, round(sum(load), 2) AS load FROM observed GROUP BY 1, 2) q GROUP BY day, region""", "observed"))
def snapshot_migrate(spark, d):
    parsed = documents(spark, d).select(
        "doc_id", F.from_json("body", snapshot.snapshot_schema()).alias("s")
    ).select("doc_id", "s.*")
    total = F.aggregate(F.map_values("current_load"), F.lit(0.0), lambda a, x: a + x)
    return rounded(snapshot.migrate(parsed).select(
        "doc_id", "schema_version", F.size("forecast_paths").cast("bigint").alias("paths"),
        F.size("interval_paths").cast("bigint").alias("interval_paths"), "weather.*", total.alias("total_load"),
    ))


@query("json_shape", sql("""SELECT region, ts, '{"region":"' || region || '","ts":"' || strftime(ts, '%Y-%m-%dT%H:%M:%S') || '","steps":['
    || k || ',' || (k + 1) || '],"counts":{"' || region || '":{"n":' || k || '}}}' AS body
    FROM (SELECT region, ts, CAST(floor(load) AS BIGINT) AS k FROM observed) q""", "observed"))
def json_shape(spark, d):
    """Rows as JSON with a timestamp, a list and a map of maps."""
    k = F.floor("load").cast("bigint")
    nested = tables.observed_load(src.events(spark, d)).select(
        "region", "ts", F.array(k, k + 1).alias("steps"), F.create_map("region", F.create_map(F.lit("n"), k)).alias("counts")
    )
    return nested.select("region", "ts", snapshot.json_shape(nested).alias("body"))


def snapshot_documents(spark, d):
    end = src.end(spark, d)
    fortnight = staged(src.two_weeks(spark, d), "fortnight")
    week = fortnight.filter(F.col("ts") >= src.axis(spark, d).back(SLOTS_PER_WEEK))
    qhat = fc.residual_quantile(fc.naive_residuals(fortnight))
    path = staged(fc.prediction_interval(fc.seasonal_naive(week, end), qhat), "path")
    anchors = fc.path_anchor(path).withColumn("origin", end)
    found = an.all_rules(week, anchors, path, end, THRESHOLDS, "latest")
    means = stats.weather_average(src.latest_weather(spark, d))
    return snapshot.build_snapshot(an.scored_rows(week, "latest", end), path, found, means, timestamp=end)


def written_snapshot(spark, d):
    path = shared_dir(spark, "snapshot")
    snapshot.write_snapshot(snapshot_documents(spark, d), path, ANY_REGION)
    return path


@query("snapshot_write", sql("""SELECT l.region, round(l.load + 1e-9, 6) AS current_load, 6 AS horizons, 0 AS issues, round(p.point + 1e-9, 6) AS point_48h,
    (SELECT strftime(hi, '%Y-%m-%dT%H:%M:%S') FROM bounds) AS timestamp FROM latest l
    JOIN (SELECT region, load AS point FROM load, bounds WHERE ts + INTERVAL 7 DAY = hi + INTERVAL 48 HOUR) p ON p.region = l.region
    UNION ALL SELECT NULL, NULL, 0, 0, NULL, strftime(hi, '%Y-%m-%dT%H:%M:%S') FROM bounds""", "latest", "load", "bounds"))
def snapshot_write(spark, d):
    """The written documents, read back with their issues; the one of the total has no region."""
    found = snapshot.read_snapshot(spark, written_snapshot(spark, d), region_pattern=ANY_REGION)
    region = F.try_element_at(F.map_keys("current_load"), F.lit(1))
    return rounded(found.withColumn("region", region).select(
        "region", F.col("current_load")[F.col("region")].alias("current_load"),
        F.when(F.col("region").isNull(), 0).otherwise(F.size(F.col("predictions")[F.col("region")])).alias("horizons"),
        F.size("issues").alias("issues"), F.col("predictions")[F.col("region")]["48h"].alias("point_48h"), "timestamp",
    ))


@query("snapshot_read", sql("""SELECT p.region, h.horizon, round(p.point + 1e-9, 6) AS point, CAST(h.steps AS BIGINT) AS path_steps, '1.2.0' AS schema_version
    FROM (SELECT region, CAST(date_diff('minute', hi, ts + INTERVAL 7 DAY) / 15 AS INTEGER) AS step, load AS point
        FROM load, bounds WHERE ts + INTERVAL 7 DAY > hi) p JOIN horizons h ON h.steps = p.step""", "load", "bounds", "horizons"))
def snapshot_read(spark, d):
    """Anchors and path lengths of a snapshot that was written and read back."""
    document = snapshot.read_snapshot(spark, written_snapshot(spark, d), region_pattern=ANY_REGION)
    anchors = document.select("schema_version", "forecast_paths", F.explode("predictions").alias("region", "m")).select(
        "schema_version", "region", F.col("forecast_paths")[F.col("region")].alias("paths"), F.explode("m").alias("horizon", "point")
    )
    length = F.size(F.col("paths")[F.col("horizon")]).cast("bigint")
    return rounded(anchors.select("region", "horizon", "point", length.alias("path_steps"), "schema_version"))


@query("backtest_report", sql("""SELECT b.region, round(b.mape + 1e-9, 6) AS mape, round(b.mase + 1e-9, 6) AS mase, weeks_tested,
    CAST(w.week AS INTEGER) AS week, round(w.mape + 1e-9, 6) AS week_mape, round(w.mase + 1e-9, 6) AS week_mase, train_size, test_size
    FROM by_region b JOIN weekly w ON w.region = b.region""", "load", extra=SERIES))
def backtest_report(spark, d):
    """Regions of a report that was written and read back."""
    path = shared_dir(spark, "backtest")
    reports.write_backtest_report(staged(weekly(spark, d), "weekly"), path)
    regions, _ = reports.read_backtest_report(spark, path)
    return rounded(regions.select("region", "mape", "mase", "weeks_tested", F.explode("weekly_results").alias("w")).select(
        "region", "mape", "mase", "weeks_tested", "w.week", F.col("w.mape").alias("week_mape"), F.col("w.mase").alias("week_mase"),
        "w.train_size", "w.test_size",
    ))


@query("backtest_summary_file", sql(f"""SELECT line AS value FROM (
    SELECT 'weeks per region: 4' AS line UNION ALL SELECT 'regions scored: ' || count(*) FROM by_region
    UNION ALL SELECT 'mean percentage error: ' || {PERCENT.format('avg(mape)')} FROM by_region
    UNION ALL SELECT 'mean scaled error: ' || {NUMBER.format('avg(mase)')} FROM by_region
    UNION ALL {SUMMARY_LINES}) q""", "load", extra=SERIES))
def backtest_summary_file(spark, d):
    """Lines of the summary as written."""
    path = shared_dir(spark, "summary")
    regions = staged(bt.backtest_regions(weekly(spark, d)), "regions")
    reports.write_summary_text(regions, bt.backtest_overall(regions), path)
    return spark.read.text(newest(spark, path))
