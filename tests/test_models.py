import pytest
from pyspark.sql import functions as F

from loadspan.config import HORIZON_STEPS
from loadspan.operators import features as fx
from loadspan.operators import models, stats
from loadspan.plans import batch
from loadspan.sources import reports, snapshot


@pytest.fixture(scope="module")
def series(spark):
    """Two regions with a daily pattern over 16 days."""
    base = spark.range(96 * 16).select(
        F.expr("TIMESTAMP_NTZ'2024-01-01' + make_dt_interval(0, 0, cast(id * 15 as int))").alias("ts"),
        (F.sin(F.col("id") * 6.283185307179586 / 96) * 10 + 50).alias("v"), (F.col("id") % 7 / 10).alias("n"),
    )
    load = base.select(
        F.explode(F.array(F.lit("region_1"), F.lit("region_2"))).alias("region"), "ts", "v", "n"
    ).select("region", "ts", F.when(F.col("region") == "region_1", F.col("v") + F.col("n")).otherwise(F.col("v") * 2).alias("load"))
    return load.cache()


@pytest.fixture(scope="module")
def weather(series):
    return series.select("region", "ts", (F.col("load") / 3).alias("temperature"), F.lit(50.0).alias("humidity"), F.lit(0.0).alias("solar_irradiance"))


def test_guard_drops_short_series(hours):
    rows = hours({"a": range(5), "b": range(3)})
    assert {r.region for r in models.min_sample_guard(rows, 5).collect()} == {"a"}


def test_scaler_is_fitted_on_training_rows_only(spark):
    train = spark.createDataFrame([(1.0,), (3.0,)], "x double")
    model = models.scaler(["x"]).fit(train)
    got = model.transform(spark.createDataFrame([(2.0,)], "x double")).first().scaled
    assert got[0] == 0


def test_ensemble_weights(spark):
    df = spark.createDataFrame([(1.0, 3.0)], "p_a double, p_b double")
    assert models.ensemble_mean(df, ["a", "b"]).first().point == 2
    assert models.ensemble_mean(df, ["a", "b"], {"a": 0.7, "b": 0.3}).first().point == pytest.approx(1.6)
    assert models.ensemble_mean(df, ["a", "b"], {"b": 0.3}).first().point == 3
    for wrong in ({"c": 1.0}, {"a": 0.0}):
        with pytest.raises(ValueError):
            models.ensemble_mean(df, ["a", "b"], wrong)


def test_a_failing_member_is_left_out(spark, series, weather, monkeypatch):
    rows = models.next_step_rows(fx.quarter_hour_features(series, weather))

    class Broken:
        def fit(self, _):
            raise RuntimeError("no")

    real = models.members
    monkeypatch.setattr(models, "members", lambda label: {**real(label), "boosted": Broken()})
    columns = [*models.FEATURE_COLUMNS, "load"]
    assert set(models.fit_ensemble(rows, columns, algorithms=["boosted", "linear"]).fitted) == {"linear"}
    with pytest.raises(RuntimeError):
        models.fit_ensemble(rows, columns, algorithms=["boosted"])


def test_direct_rows_label_each_horizon(series, weather):
    rows = models.direct_rows(fx.quarter_hour_features(series, weather))
    assert {(r.horizon, r.steps) for r in rows.select("horizon", "steps").distinct().collect()} == set(HORIZON_STEPS.items())
    other = series.select("region", F.col("ts").alias("target_ts"), F.col("load").alias("y"))
    assert rows.join(other, ["region", "target_ts"]).filter("label <> y").count() == 0


def test_train_deploy_and_snapshot(spark, series, weather, tmp_path):
    both = series.join(weather, ["region", "ts"])
    ensemble, qhat = batch.train(both, ("linear", "forest"), trees=20)
    assert {(r.region, r.horizon) for r in qhat.collect()} == {(r, h) for r in ("region_1", "region_2") for h in HORIZON_STEPS}
    documents, found = batch.deploy(both, ensemble, qhat)
    path = str(tmp_path / "snapshot")
    snapshot.write_snapshot(documents, path)
    docs = {next(iter(d.current_load), "TOTAL"): d for d in snapshot.read_snapshot(spark, path).collect()}
    assert set(docs) == {"region_1", "region_2", "TOTAL"}
    one, two = docs["region_1"], docs["region_2"]
    values = one.forecast_paths["region_1"]["48h"]
    assert len(values) == 192 and len(set(values)) > 6
    assert two.intervals["region_2"]["24h"].lower < two.predictions["region_2"]["24h"] < two.intervals["region_2"]["24h"].upper
    assert 40 < one.predictions["region_1"]["24h"] < 65 and 75 < two.predictions["region_2"]["24h"] < 130
    assert sum(len(d.anomalies) for d in docs.values()) == found.count()


def test_importances_by_region_and_horizon(series, weather):
    both = series.join(weather, ["region", "ts"])
    _, _, importances = batch.train_all(both, ("forest",), trees=10)
    rows = importances.groupBy("region", "horizon").agg(F.sum("importance").alias("s"), F.count(F.lit(1)).alias("n")).collect()
    assert {(r.region, r.horizon) for r in rows} == {(r, h) for r in ("region_1", "region_2") for h in HORIZON_STEPS}
    assert all(r.s == pytest.approx(1) and r.n == len(batch.DIRECT_COLUMNS) for r in rows)


def test_fitted_ensemble_forecasts_and_ranks(series, weather):
    rows = models.next_step_rows(fx.quarter_hour_features(series, weather))
    ensemble = models.fit_ensemble(rows, [*models.FEATURE_COLUMNS, "load"], algorithms=["linear", "forest"], trees=20)
    assert ensemble.transform(rows).agg(stats.mape("label", "point").alias("e")).first().e < 10
    importances = models.feature_importance(ensemble, rows, [*models.FEATURE_COLUMNS, "load"])
    top = models.top_importances(importances, 3).orderBy("rank").collect()
    assert [r["rank"] for r in top] == [1, 2, 3] and top[0].importance >= top[2].importance
    assert importances.agg(F.sum("importance").alias("s")).first().s == pytest.approx(1, abs=1e-6)


def test_backtest_report(spark, series, tmp_path):
    weekly = batch.run_backtest(series, str(tmp_path))
    assert weekly.count() == 4
    regions, summary = reports.read_backtest_report(spark, str(tmp_path / "report"))
    assert {r.region: len(r.weekly_results) for r in regions.collect()} == {"region_1": 2, "region_2": 2}
    assert summary.first().regions_tested == 2
    # a later report without its summary isn't read, nor is a part of it
    weekly.limit(1).write.json(f"{tmp_path}/report/version=99999999999999999999-x/regions")
    assert reports.read_backtest_report(spark, str(tmp_path / "report"))[0].count() == 2
    lines = [r.value for r in spark.read.text(str(tmp_path / "summary_text")).collect()]
    assert lines[0] == "weeks per region: 4" and lines[4].startswith("  region_1: MAPE=")
