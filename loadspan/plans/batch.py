"""The three batch plans: train, deploy, backtest."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loadspan.config import DEFAULTS, FEATURE_COLUMNS, Thresholds
from loadspan.operators import anomaly, backtest, features, forecast, models, reshape, stats
from loadspan.operators.importance import permutation_importance
from loadspan.operators.roll import roll_forward
from loadspan.sources import reports, snapshot
from loadspan.sources.stage import staged

DIRECT_COLUMNS = [*FEATURE_COLUMNS, "load", "steps"]


def training_rows(series: DataFrame, minimum: int = 200) -> DataFrame:
    """Direct-forecast samples of the first 80 % of each series of load and weather.

    The samples of each region and horizon are split 90/10 into fit (``train``) and calibration
    (``test``), in order of time.
    """
    table = reshape.chrono_split(features.quarter_hour_features(series))
    train = models.min_sample_guard(table.filter("part = 'train'").drop("idx", "n", "part"), minimum)
    samples = models.direct_rows(train)
    return reshape.chrono_split(samples, 0.9, 0.9, ["region", "horizon"]).drop("idx", "n")


def train(series: DataFrame, algorithms: Sequence[str] = ("boosted", "forest", "linear"),
          level: float = 0.95, **settings) -> tuple[models.Ensemble, DataFrame]:
    """Pooled ensemble with the steps ahead as a feature, and the error quantile per region and horizon."""
    ensemble, qhat, _ = train_all(series, algorithms, level, **settings)
    return ensemble, qhat


def train_all(series: DataFrame, algorithms: Sequence[str] = ("boosted", "forest", "linear"), level: float = 0.95,
              **settings) -> tuple[models.Ensemble, DataFrame, DataFrame]:
    """As :func:`train`, and the permutation importances per region and horizon, measured on the calibration rows."""
    rows = staged(training_rows(series), "training")
    ensemble = models.fit_ensemble(rows.filter("part = 'train'"), DIRECT_COLUMNS, algorithms=algorithms, **settings)
    held = rows.filter("part = 'test'")
    importances = permutation_importance(held, ensemble, DIRECT_COLUMNS)
    scored = ensemble.transform(held)
    residuals = scored.withColumn("abs_error", F.abs(F.col("label") - F.col("point")))
    return ensemble, forecast.residual_quantile(residuals, level, ["region", "horizon"]), importances


def deploy(
    series: DataFrame, ensemble: models.Ensemble, qhat: DataFrame,
    thresholds: Thresholds = DEFAULTS, timestamp: Column | None = None, importances: DataFrame | None = None,
    roll: Sequence[str] | None = None,
) -> tuple[DataFrame, DataFrame]:
    """Snapshot documents and findings for the newest step, with a value for each of 192 steps.

    ``series`` (region, ts, load and weather) needs the last 8 days: the longest lag and a day. An ensemble with the steps ahead as a feature
    scores every step from the newest row, and the interval of a step is that of the horizon it falls in. With ``roll``, the columns
    of a next-step ensemble, that ensemble is rolled forward, each prediction fed back, and ``qhat`` has one quantile for each region.
    ``importances`` (region, horizon, feature, importance) go into the documents.
    """
    series = staged(series, "recent")
    load = series.select("region", "ts", "load")
    end = series.agg(F.max("ts").alias("v")).scalar()
    if roll:
        path = forecast.prediction_interval(roll_forward(series, ensemble, roll), qhat)
    else:
        table = features.quarter_hour_features(series)
        scored = ensemble.transform(models.direct_scoring_rows(table))
        path = forecast.prediction_interval(scored, qhat, ["region", "horizon"]).select(
            "region", F.col("steps").alias("step"), forecast.steps_after(end, F.col("steps")).alias("ts"), "point", "lower", "upper"
        )
    path = staged(path, "path")
    anchors = forecast.path_anchor(path)
    week = load.filter(F.col("ts") > end - F.expr("INTERVAL 7 DAYS"))
    found = anomaly.all_rules(
        week, anchors.withColumn("origin", end), path, end, thresholds, "latest"
    )
    latest = anomaly.scored_rows(load, "latest", end)
    means = stats.weather_average(anomaly.scored_rows(series, "latest", end))
    return snapshot.build_snapshot(latest, path, found, means, importances, timestamp), found


def run_backtest(load: DataFrame, path: str, weeks: int = 4) -> DataFrame:
    """Weekly scores, with the report and its text written below ``path``."""
    weekly = staged(backtest.rolling_backtest(load, weeks), "backtest")
    reports.write_backtest_report(weekly, f"{path}/report", weeks)
    regions = backtest.backtest_regions(weekly)
    reports.write_summary_text(regions, backtest.backtest_overall(regions, weeks), f"{path}/summary_text")
    return weekly
