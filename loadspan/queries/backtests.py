"""Queries on rolling-origin backtests."""

from __future__ import annotations

from pyspark.sql import functions as F

from loadspan.config import SLOTS_PER_WEEK
from loadspan.operators import backtest as bt
from loadspan.operators import stats
from loadspan.operators.forecast import naive_residuals, prediction_interval, residual_quantile
from loadspan.plans.blocks import with_position
from loadspan.queries import inputs as src
from loadspan.queries.inputs import rounded
from loadspan.queries.registry import query
from loadspan.queries.sqlbase import sql

SERIES = """series AS (SELECT region, ts, load, row_number() OVER (PARTITION BY region ORDER BY ts) - 1 AS idx,
    count(*) OVER (PARTITION BY region) AS n, lag(load, 672) OVER (PARTITION BY region ORDER BY ts) AS seasonal FROM load),
    fold AS (SELECT DISTINCT region, week, greatest(0, n - (5 - week) * 672 - 2880) AS train_start,
        n - (5 - week) * 672 AS test_start, n - (5 - week) * 672 + 672 AS test_end
        FROM series CROSS JOIN (SELECT unnest(generate_series(1, 4)) AS week) w
        WHERE n - (5 - week) * 672 > 0),
    fold_rows AS (SELECT s.*, f.week, f.train_start, f.test_start, s.idx >= f.test_start AS is_test FROM series s
        JOIN fold f ON f.region = s.region AND s.idx >= f.train_start AND s.idx < f.test_end),
    scored AS (SELECT r.*, CASE WHEN is_test THEN CASE WHEN test_start - train_start >= 672 THEN seasonal
            ELSE (SELECT load FROM series l WHERE l.region = r.region AND l.idx = r.test_start - 1) END END AS predicted,
        CASE WHEN NOT is_test AND idx - 672 >= train_start THEN abs(load - seasonal) END AS naive_error FROM fold_rows r),
    weekly AS (SELECT region, week, avg(abs((load - predicted) / load)) FILTER (WHERE is_test AND load <> 0) * 100 AS mape,
        avg(abs(load - predicted)) FILTER (WHERE is_test) / nullif(avg(naive_error), 0) AS mase,
        count(*) FILTER (WHERE NOT is_test) AS train_size, count(*) FILTER (WHERE is_test) AS test_size
        FROM scored GROUP BY region, week),
    by_region AS (SELECT region, avg(mape) AS mape, avg(mase) AS mase, count(*) AS weeks_tested FROM weekly GROUP BY region)"""


def weekly(spark, d):
    return bt.rolling_backtest(src.load(spark, d))


@query("backtest_folds", sql("""SELECT region, CAST(week AS INTEGER) AS week, CAST(train_start AS BIGINT) AS train_start,
    CAST(test_start AS BIGINT) AS test_start, CAST(test_end AS BIGINT) AS test_end FROM fold""", "load", extra=SERIES))
def backtest_folds(spark, d):
    sizes = src.load(spark, d).groupBy("region").agg(F.count(F.lit(1)).alias("n"))
    return bt.backtest_folds(sizes)


@query("fold_range_join", sql("""SELECT region, CAST(week AS INTEGER) AS week, ts, CAST(idx AS BIGINT) AS idx,
    CASE WHEN is_test THEN 'test' ELSE 'train' END AS part FROM fold_rows""", "load", extra=SERIES))
def fold_range_join(spark, d):
    series = with_position(src.load(spark, d), ["region"], "ts")
    sizes = series.groupBy("region").agg(F.count(F.lit(1)).alias("n"))
    return bt.fold_rows(series, bt.backtest_folds(sizes)).select("region", "week", "ts", "idx", "part")


@query("seasonal_naive_folds", sql("""SELECT region, CAST(week AS INTEGER) AS week, ts, load, predicted FROM scored WHERE is_test""",
       "load", extra=SERIES))
def seasonal_naive_folds(spark, d):
    return bt.scored_folds(src.load(spark, d)).filter("part = 'test'").select("region", "week", "ts", "load", "predicted")


@query("rolling_backtest", sql("""SELECT region, CAST(week AS INTEGER) AS week, round(mape + 1e-9, 6) AS mape, round(mase + 1e-9, 6) AS mase,
    train_size, test_size FROM weekly""", "load", extra=SERIES))
def rolling_backtest(spark, d):
    return rounded(weekly(spark, d))


@query("backtest_rollup", sql("""SELECT region, round(mape + 1e-9, 6) AS mape, round(mase + 1e-9, 6) AS mase, weeks_tested FROM by_region""",
       "load", extra=SERIES))
def backtest_rollup(spark, d):
    return rounded(bt.backtest_regions(weekly(spark, d)))


@query("backtest_overall", sql("""SELECT round(avg(mape) + 1e-9, 6) AS overall_mape, round(avg(mase) + 1e-9, 6) AS overall_mase,
    count(*) AS regions_tested, 4 AS total_weeks FROM by_region""", "load", extra=SERIES))
def backtest_overall(spark, d):
    return rounded(bt.backtest_overall(bt.backtest_regions(weekly(spark, d))))


@query("mape", sql("""SELECT region, round(avg(abs((load - seasonal) / load)) FILTER (WHERE load <> 0) * 100 + 1e-9, 6) AS mape
    FROM series WHERE seasonal IS NOT NULL GROUP BY region""", "load", extra=SERIES))
def mape(spark, d):
    return rounded(naive_residuals(src.load(spark, d)).groupBy("region").agg(stats.mape("load", "predicted").alias("mape")))


@query("mase", sql("""SELECT region, CAST(week AS INTEGER) AS week, round(mase + 1e-9, 6) AS mase FROM weekly""", "load", extra=SERIES))
def mase(spark, d):
    return rounded(weekly(spark, d).select("region", "week", "mase"))


@query("interval_coverage", sql("""SELECT s.region, round(100.0 * avg(CAST(load BETWEEN seasonal - qhat AND seasonal + qhat AS DOUBLE)) + 1e-9, 6) AS coverage,
    count(*) AS samples FROM series s JOIN (SELECT region, quantile_cont(abs(load - seasonal), 0.9) AS qhat FROM series
    WHERE seasonal IS NOT NULL AND idx < n - 672 GROUP BY region) q ON q.region = s.region
    WHERE seasonal IS NOT NULL AND idx >= n - 672 GROUP BY s.region""", "load", extra=SERIES))
def interval_coverage(spark, d):
    end = src.end(spark, d)
    cut = end - F.expr("INTERVAL 7 DAYS")
    residuals = naive_residuals(src.load(spark, d))
    qhat = residual_quantile(residuals.filter(F.col("ts") <= cut), 0.9)
    banded = prediction_interval(
        residuals.filter(F.col("ts") > cut).withColumn("point", F.col("predicted")), qhat
    )
    return rounded(banded.groupBy("region").agg(
        stats.coverage("load", "lower", "upper").alias("coverage"), F.count(F.lit(1)).alias("samples")
    ))


@query("min_sample_guard", sql("""SELECT region, count(*) AS windows FROM (
    SELECT region, count(*) OVER (PARTITION BY region ORDER BY ts ROWS BETWEEN 96 PRECEDING AND 1 PRECEDING) AS c FROM observed) q
    WHERE c = 96 GROUP BY region HAVING count(*) >= 200""", "observed"))
def min_sample_guard(spark, d):
    from loadspan.operators.models import min_sample_guard as guard
    from loadspan.sources import tables

    observed = with_position(tables.observed_load(src.events(spark, d)), ["region"], "ts")
    windows = observed.filter(F.col("idx") >= 96)
    return guard(windows, 200).groupBy("region").agg(F.count(F.lit(1)).alias("windows"))


@query("conformal_calibrate", sql("""SELECT region, round(quantile_cont(abs(load - seasonal), 0.95) + 1e-9, 6) AS qhat, 0.05 AS alpha FROM (
    SELECT *, row_number() OVER (PARTITION BY region ORDER BY ts) - 1 AS k, count(*) OVER (PARTITION BY region) AS m
    FROM series WHERE seasonal IS NOT NULL) q WHERE k >= floor(m * 0.9) GROUP BY region""", "load", extra=SERIES))
def conformal_calibrate(spark, d):
    from loadspan.operators.models import conformal_calibrate as calibrate

    return rounded(calibrate(naive_residuals(src.load(spark, d))))


HORIZON_ERRORS = SERIES + """, origin AS (SELECT f.region, f.week, h.horizon, h.steps, f.train_start, f.test_start,
        f.test_start + o + 95 + h.steps AS idx FROM fold f CROSS JOIN horizons h
        CROSS JOIN (SELECT unnest(generate_series(0, 671)) AS o) g WHERE o + 96 + h.steps < 672),
    naive AS (SELECT region, week, avg(naive_error) AS naive FROM scored GROUP BY region, week),
    horizon_errors AS (SELECT o.region, o.week, o.horizon, o.steps, avg(abs((load - seasonal) / load)) FILTER (WHERE load <> 0) * 100 AS mape,
        sqrt(avg((load - seasonal) * (load - seasonal))) AS rmse, avg(abs(load - seasonal)) / nullif(max(naive), 0) AS mase,
        avg(CAST(load BETWEEN seasonal - 0.1 * abs(seasonal) AND seasonal + 0.1 * abs(seasonal) AS DOUBLE)) * 100 AS coverage,
        count(*) AS samples FROM origin o JOIN series s ON s.region = o.region AND s.idx = o.idx AND seasonal IS NOT NULL
        JOIN naive v ON v.region = o.region AND v.week = o.week GROUP BY 1, 2, 3, 4)"""


def horizon_errors(spark, d):
    return bt.horizon_backtest(src.load(spark, d), every=1)


@query("horizon_backtest", sql("""SELECT region, CAST(week AS INTEGER) AS week, horizon, steps, round(mape + 1e-9, 6) AS mape, round(rmse + 1e-9, 6) AS rmse,
    round(mase + 1e-9, 6) AS mase, round(coverage + 1e-9, 6) AS coverage, samples FROM horizon_errors""",
    "load", "horizons", extra=HORIZON_ERRORS))
def horizon_backtest(spark, d):
    return rounded(horizon_errors(spark, d))


@query("error_by_horizon", sql("""SELECT horizon, round(mape + 1e-9, 6) AS mape, round(rmse + 1e-9, 6) AS rmse, round(mase + 1e-9, 6) AS mase,
    round(coverage + 1e-9, 6) AS coverage, samples FROM (
    SELECT horizon, avg(mape) AS mape, avg(rmse) AS rmse, avg(mase) AS mase, avg(coverage) AS coverage,
        CAST(sum(samples) AS BIGINT) AS samples FROM horizon_errors GROUP BY horizon
    UNION ALL SELECT 'overall', avg(mape), avg(rmse), avg(mase), avg(coverage), CAST(sum(samples) AS BIGINT) FROM (
        SELECT horizon, avg(mape) AS mape, avg(rmse) AS rmse, avg(mase) AS mase, avg(coverage) AS coverage,
        sum(samples) AS samples FROM horizon_errors GROUP BY horizon) g) u""", "load", "horizons", extra=HORIZON_ERRORS))
def error_by_horizon(spark, d):
    return rounded(bt.error_by_horizon(horizon_errors(spark, d)))


@query("format_metrics", sql("""SELECT region, CASE WHEN mape IS NULL THEN 'N/A' ELSE printf('%.1f%%', mape) END AS mape_text,
    CASE WHEN mase IS NULL THEN 'N/A' ELSE printf('%.3f', mase) END AS mase_text FROM weekly""", "load", extra=SERIES))
def format_metrics(spark, d):
    from loadspan.functions.text import number_text, percent_text

    return weekly(spark, d).select(
        "region", percent_text("mape").alias("mape_text"), number_text("mase").alias("mase_text")
    )


PERCENT = "CASE WHEN {0} IS NULL THEN 'N/A' ELSE printf('%.1f%%', {0}) END"
NUMBER = "CASE WHEN {0} IS NULL THEN 'N/A' ELSE printf('%.3f', {0}) END"
SUMMARY_LINES = (
    f"SELECT printf('  %s: MAPE=%6s, MASE=%6s, Weeks=%d', region, {PERCENT.format('mape')}, {NUMBER.format('mase')}, weeks_tested) "
    "AS line FROM by_region"
)


@query("backtest_summary_text", sql(SUMMARY_LINES, "load", extra=SERIES))
def backtest_summary_text(spark, d):
    from loadspan.functions.text import summary_line

    return bt.backtest_regions(weekly(spark, d)).select(summary_line().alias("line"))
