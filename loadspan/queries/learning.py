"""Queries on fitted models. Where the fitted numbers themselves are the result, there is no SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from loadspan.config import FEATURE_COLUMNS, HORIZON_STEPS, SLOTS_PER_WEEK, WEATHER_COLUMNS
from loadspan.operators import features as fx
from loadspan.operators import models, reshape, stats, windows
from loadspan.operators import regional
from loadspan.operators.forecast import prediction_interval, residual_quantile
from loadspan.operators.roll import roll_forward
from loadspan.plans import batch
from loadspan.queries import inputs as src
from loadspan.queries.base import COMPLETE
from loadspan.queries.inputs import rounded
from loadspan.queries.registry import query
from loadspan.queries.sqlbase import sql
from loadspan.session import shared_dir
from loadspan.sources import bundle, tables
from loadspan.sources.stage import staged

COLUMNS = [*FEATURE_COLUMNS, "load"]
ALL = ("boosted", "forest", "linear")

FEATURE_LIST = ", ".join(FEATURE_COLUMNS)
# Feature rows with missing weather imputed, those with a next step, and their chronological parts.
IMPUTED = ", ".join(f"coalesce({c}, avg({c}) FILTER (WHERE idx < floor(n * 0.8)) OVER (PARTITION BY region)) AS {c}" for c in WEATHER_COLUMNS)
ROWS = f"""imputed AS (SELECT region, ts, load, {', '.join(c for c in FEATURE_COLUMNS if c not in WEATHER_COLUMNS)}, {IMPUTED} FROM (
        SELECT *, row_number() OVER (PARTITION BY region ORDER BY ts) - 1 AS idx, count(*) OVER (PARTITION BY region) AS n FROM features) p),
    complete AS (SELECT region, ts, load, {FEATURE_LIST} FROM imputed WHERE {COMPLETE}),
    labelled AS (SELECT c.*, n.load AS label FROM complete c JOIN complete n ON n.region = c.region AND n.ts = c.ts + INTERVAL 15 MINUTE),
    enough AS (SELECT region FROM labelled GROUP BY region HAVING count(*) >= 200),
    parts AS (SELECT *, CASE WHEN idx < floor(n * 0.8) THEN 'train' WHEN idx < floor(n * 0.9) THEN 'validation' ELSE 'test' END AS part
        FROM (SELECT l.*, row_number() OVER (PARTITION BY l.region ORDER BY ts) - 1 AS idx, count(*) OVER (PARTITION BY l.region) AS n
            FROM labelled l JOIN enough e ON e.region = l.region) q)"""


# The means that fill missing weather come from rows that every later split puts into its training part: rows of next steps, and of direct
# horizons, of which the last tenth of the first 80 % calibrates.
NEXT_STEP, DIRECT = 0.8, 0.7


def imputed(spark, d, share):
    """The series with missing weather filled from its first ``share``, and the means it was filled with."""
    # the means and the rows both read it: staged, the events are aggregated once
    series = staged(src.series(spark, d), "series")
    means = staged(fx.weather_means(series, share), "weather-means")
    return fx.impute_weather(series, means), means


def split_rows(spark, d):
    """Next-step rows with their chronological part."""
    table = fx.quarter_hour_features(imputed(spark, d, NEXT_STEP)[0])
    rows = models.min_sample_guard(models.next_step_rows(table))
    return staged(reshape.chrono_split(rows).drop("idx", "n"), "next-step")


def fitted(spark, d, algorithms=ALL):
    rows = split_rows(spark, d)
    return models.fit_ensemble(rows.filter("part = 'train'"), COLUMNS, algorithms=algorithms), rows


def score(scored):
    return scored.groupBy("region").agg(
        stats.mape("label", "point").alias("mape"), stats.rmse("label", "point").alias("rmse"),
        F.count(F.lit(1)).alias("samples"),
    )


@query("feature_select", sql(f"SELECT region, count(*) AS rows, {len(FEATURE_COLUMNS)} AS width FROM features WHERE {COMPLETE} GROUP BY region", "features"))
def feature_select(spark, d):
    from pyspark.ml.functions import vector_to_array

    table = fx.quarter_hour_features(src.series(spark, d))
    vector = models.feature_select(table).withColumn("a", vector_to_array("raw"))
    return vector.groupBy("region").agg(F.count(F.lit(1)).alias("rows"), F.max(F.size("a")).alias("width"))


@query("scale_features", sql("""SELECT part, CAST("column" AS INTEGER) AS "column", round(avg(v) + 1e-9, 4) AS mean, round(stddev_samp(v) + 1e-9, 4) AS std FROM (
    """ + " UNION ALL ".join(f"""SELECT part, {i} AS "column", CASE WHEN s > 0 THEN ({c} - m) / s ELSE 0 END AS v
    FROM parts CROSS JOIN (SELECT avg({c}) AS m, stddev_samp({c}) AS s FROM parts WHERE part = 'train') t""" for i, c in enumerate(FEATURE_COLUMNS))
    + ') u GROUP BY part, "column"', "features", extra=ROWS))
def scale_features(spark, d):
    from pyspark.ml.functions import vector_to_array

    rows = split_rows(spark, d)
    model = models.scaler().fit(rows.filter("part = 'train'"))
    scaled = model.transform(rows).withColumn("a", vector_to_array("scaled"))
    values = scaled.select("part", F.posexplode("a").alias("column", "value"))
    return rounded(values.groupBy("part", "column").agg(F.avg("value").alias("mean"), F.stddev_samp("value").alias("std")), 4)


@query("fit_ensemble")
def fit_ensemble(spark, d):
    ensemble, rows = fitted(spark, d)
    return rounded(score(ensemble.transform(rows.filter("part = 'test'"))), 4)


@query("ensemble_mean")
def ensemble_mean(spark, d):
    ensemble, rows = fitted(spark, d)
    scored = ensemble.transform(rows.filter("part = 'test'"), {"forest": 0.7, "linear": 0.3})
    return rounded(scored.select("region", "ts", "label", "point"), 4)


@query("model_conformal")
def model_conformal(spark, d):
    """Error quantile of the fitted model over the validation part of each region."""
    ensemble, rows = fitted(spark, d)
    scored = ensemble.transform(rows.filter("part = 'validation'"))
    return rounded(residual_quantile(scored.withColumn("abs_error", F.abs(F.col("label") - F.col("point")))), 4)


@query("direct_forecast")
def direct_forecast(spark, d):
    """Forecast of each region at each step from its newest features, with its interval."""
    series = imputed(spark, d, DIRECT)[0]
    ensemble, qhat = batch.train(series)
    newest = models.direct_scoring_rows(fx.quarter_hour_features(series))
    scored = prediction_interval(ensemble.transform(newest), qhat, ["region", "horizon"])
    return rounded(scored.select("region", "horizon", "steps", "point", "lower", "upper"), 4)


@query("feature_importance")
def feature_importance(spark, d):
    ensemble, rows = fitted(spark, d, ("boosted", "forest"))
    return rounded(models.feature_importance(ensemble, rows, COLUMNS))


@query("top_importances")
def top_importances(spark, d):
    """The largest importances of each region and horizon."""
    _, _, importances = batch.train_all(imputed(spark, d, DIRECT)[0], ("boosted", "forest"))
    return rounded(models.top_importances(importances, keys=["region", "horizon"]))


@query("recursive_ensemble")
def recursive_ensemble(spark, d):
    """The fitted ensemble rolled 192 steps ahead for every region, each prediction fed back, with intervals of the validation errors."""
    ensemble, rows = fitted(spark, d)
    scored = ensemble.transform(rows.filter("part = 'validation'"))
    qhat = residual_quantile(scored.withColumn("abs_error", F.abs(F.col("label") - F.col("point"))))
    path = prediction_interval(roll_forward(imputed(spark, d, NEXT_STEP)[0], ensemble, COLUMNS), qhat)
    return rounded(path.select("region", "step", "ts", "point", "lower", "upper"), 4)


@query("window_models")
def window_models(spark, d):
    """Test errors, an hour ahead, of the linear member on windows of 96 rows of 13 features; bins come from the first 80 % of each series."""
    series = imputed(spark, d, NEXT_STEP)[0]
    table = staged(reshape.chrono_split(fx.quarter_hour_features(series)).drop("idx", "n"), "window-features")
    edges = windows.bin_edges(table.filter("part = 'train'"), FEATURE_COLUMNS)
    rows = staged(windows.window_rows(table, edges, HORIZON_STEPS["1h"]).join(table.select("region", "ts", "part"), ["region", "ts"]), "windows")
    # the label of a training row lies in the training part too
    last = table.filter("part = 'train'").groupBy("region").agg(F.max("ts").alias("last"))
    train = rows.join(last, "region").filter(F.col("ts") + F.expr("INTERVAL 1 HOUR") <= F.col("last"))
    fitted_windows = windows.fit_windows(train, ("linear",))
    return rounded(score(windows.score_windows(rows.filter("part = 'test'"), fitted_windows)), 4)


@query("per_region_models")
def per_region_models(spark, d):
    """Test errors of a linear model of its own for every region."""
    rows = split_rows(spark, d)
    fitted_models = regional.fit_regions(rows.filter("part = 'train'"), COLUMNS, ridge=0.01, minimum=200)
    return rounded(score(regional.forecast_regions(rows.filter("part = 'test'"), fitted_models, COLUMNS)), 4)


@query("per_region_slopes", sql("""SELECT region, count(*) AS samples, round(regr_slope(label, load) + 1e-9, 6) AS slope,
    round(regr_intercept(label, load) + 1e-9, 6) AS intercept, round(regr_r2(label, load) + 1e-9, 6) AS r2 FROM parts WHERE part = 'train' GROUP BY region""",
    "features", extra=ROWS))
def per_region_slopes(spark, d):
    """The next load on the load, fitted for every region at once."""
    train = split_rows(spark, d).filter("part = 'train'")
    found = regional.fit_regions(train, ["load"])
    return rounded(found.select("region", "samples", F.col("coefficients")[0].alias("slope"), "intercept", "r2"))


@query("model_store", sql("SELECT region, count(*) AS rows, CAST(0 AS DOUBLE) AS difference FROM parts WHERE part = 'test' GROUP BY region",
       "features", extra=ROWS))
def model_store(spark, d):
    """Forecasts of a stored and reloaded forecaster next to those of the original."""
    ensemble, rows = fitted(spark, d)
    path = shared_dir(spark, "models")
    bundle.save(bundle.Forecaster(ensemble, COLUMNS), spark, path)
    test = rows.filter("part = 'test'")
    again = bundle.load(spark, path).ensemble.transform(test).select("region", "ts", F.col("point").alias("reloaded"))
    both = ensemble.transform(test).select("region", "ts", "point").join(again, ["region", "ts"])
    return both.groupBy("region").agg(
        F.count(F.lit(1)).alias("rows"), F.round(F.max(F.abs(F.col("point") - F.col("reloaded"))), 6).alias("difference")
    )


@query("deployment")
def deployment(spark, d):
    """One run of the deployment plan: a row for each region and step of the documents, with bounds, anomalies and importances."""
    series, means = imputed(spark, d, DIRECT)
    ensemble, qhat, importances = batch.train_all(series)
    # the longest lag before the window of statistics: 8 days would do, two weeks are two whole seasons
    recent = tables.series_table(src.events(spark, d), src.axis(spark, d), 2 * SLOTS_PER_WEEK)
    documents, _ = batch.deploy(fx.impute_weather(recent, means), ensemble, staged(qhat, "qhat"), importances=importances)
    documents = staged(documents, "documents")
    longest = documents.select(
        F.explode("forecast_paths").alias("region", "p"), "interval_paths", "feature_importances", F.size("anomalies").alias("anomalies"),
    ).select("region", F.col("p")["48h"].alias("p"), F.col("interval_paths")[F.col("region")]["48h"].alias("i"),
             F.size(F.col("feature_importances")[F.col("region")]).alias("horizons_explained"), "anomalies")
    steps = longest.select("region", F.posexplode("p").alias("at", "point"), "i", "horizons_explained", "anomalies")
    return rounded(steps.select("region", (F.col("at") + 1).alias("step"), "point", F.col("i")["lower"][F.col("at")].alias("lower"),
                                F.col("i")["upper"][F.col("at")].alias("upper"), "horizons_explained", "anomalies"), 4)
