"""Fitted ensembles rolled forward, regional models, permutation importances and stored forecasters."""

import datetime as dt

import numpy as np
import pytest
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from loadspan.operators import features as fx
from loadspan.operators import models, regional
from loadspan.operators.importance import permutation_errors, permutation_importance
from loadspan.operators.roll import flatten, region_place, roll_forward
from loadspan.plans import batch
from loadspan.sources import bundle

COLUMNS = [*models.FEATURE_COLUMNS, "load"]


@pytest.fixture(scope="module")
def series(spark):
    """Three regions over 12 days with a holiday ahead, and weather that differs by row."""
    base = spark.range(96 * 12).select(
        F.expr("TIMESTAMP_NTZ'2024-06-07' + make_dt_interval(0, 0, cast(id * 15 as int))").alias("ts"), F.col("id"),
        F.explode(F.array(*[F.lit(r) for r in ("a", "b", "c")])).alias("region"),
    )
    level = F.ascii("region") - 90
    return base.select(
        "region", "ts", (level * (2 + F.sin(F.col("id") * 6.283185307179586 / 96)) + (F.col("id") * 7919 % 13) / 5).alias("load"),
        (F.col("id") % 17).cast("double").alias("temperature"), F.lit(40.0).alias("humidity"), (F.col("id") % 5).cast("double").alias("solar_irradiance"),
    ).cache()


@pytest.fixture(scope="module")
def rows(series):
    return models.next_step_rows(fx.quarter_hour_features(series)).cache()


@pytest.fixture(scope="module")
def ensemble(rows):
    return models.fit_ensemble(rows, COLUMNS, rounds=6, depth=4, trees=4)


@pytest.mark.parametrize("regions", ["one-hot", "hashed", None])
def test_flat_members_predict_as_the_models(rows, ensemble, regions):
    fitted = ensemble if regions == "one-hot" else models.fit_ensemble(rows, COLUMNS, regions=regions, rounds=3, depth=5, trees=3)
    flat = flatten(fitted, rows)
    some = region_place(fitted, rows.sample(0.2, seed=1)).withColumn("_x", F.array(*[F.col(c).cast("double") for c in COLUMNS]))
    scored = fitted.prepared.transform(some)
    for model in fitted.fitted.values():
        scored = model.transform(scored)
    got = scored.select("_x", "hot", *[f"p_{m}" for m in fitted.fitted]).toPandas()
    x, hot = np.array(got["_x"].tolist()), got["hot"].to_numpy()
    for name, member in flat.members.items():
        assert np.allclose(member.predict((x - flat.mean) * flat.scale, hot), got[f"p_{name}"], rtol=0, atol=1e-9), name


@pytest.mark.parametrize("weights", [None, {"boosted": 0.6, "linear": 0.4}])
def test_every_step_is_what_transform_gives_from_the_steps_before(series, ensemble, weights):
    path = roll_forward(series, ensemble, COLUMNS, 192, weights).cache()
    assert path.count() == 3 * 192
    newest = series.groupBy("region").agg(*[F.max_by(c, "ts").alias(c) for c in models.FEATURE_COLUMNS[-3:]])
    longer = series.unionByName(path.select("region", "ts", F.col("point").alias("load")).join(newest, "region"))
    scored = ensemble.transform(fx.quarter_hour_features(longer), weights).select(
        "region", (F.col("ts") + F.expr("INTERVAL 15 MINUTES")).alias("ts"), F.col("point").alias("again"))
    both = path.join(scored, ["region", "ts"]).select(F.max(F.abs(F.col("point") - F.col("again"))).alias("d"), F.count(F.lit(1)).alias("n")).first()
    assert both.n == 3 * 192 and both.d < 1e-9
    assert path.agg(F.min("step"), F.max("step")).first()[:] == (1, 192)


def test_regions_without_enough_history_are_left_out(series, ensemble):
    gap = series.filter("NOT (region = 'a' AND ts = TIMESTAMP_NTZ'2024-06-15 00:00:00') AND NOT (region = 'c' AND ts > TIMESTAMP_NTZ'2024-06-18')")
    assert {r.region for r in roll_forward(gap, ensemble, COLUMNS, 2).collect()} == {"b"}
    assert roll_forward(series.filter("false"), ensemble, COLUMNS, 2).count() == 0
    other = series.withColumn("region", F.concat("region", F.lit("x")))
    assert roll_forward(other, ensemble, COLUMNS, 2).count() == 6  # unknown regions have no column of their own


def test_deployment_can_roll(series, ensemble, spark):
    qhat = spark.createDataFrame([("a", 1.0), ("b", 2.0), ("c", 3.0)], "region string, qhat double")
    documents, _ = batch.deploy(series, ensemble, qhat, roll=COLUMNS)
    one = {next(iter(d.current_load), ""): d for d in documents.collect()}["b"]
    path = [r.point for r in roll_forward(series, ensemble, COLUMNS).filter("region = 'b'").orderBy("step").collect()]
    assert one.forecast_paths["b"]["48h"] == pytest.approx(path, abs=1e-6)
    assert one.intervals["b"]["24h"].upper - one.intervals["b"]["24h"].lower == pytest.approx(4.0, abs=1e-5)


def test_many_regions_are_fitted_in_one_pass(spark):
    n = 10_000
    data = spark.range(n * 6).select(
        (F.col("id") % n).cast("string").alias("region"), (F.rand(1) * 5 + 1e4).alias("x"), (F.rand(2) * 100).alias("z"), F.randn(3).alias("e"),
    ).withColumn("label", F.col("x") * (F.col("region").cast("int") % 7) - 2 * F.col("z") + F.col("e")).cache()
    got = regional.fit_regions(data, ["x"]).select("region", "samples", F.col("coefficients")[0].alias("slope"), "intercept", "r2")
    want = data.groupBy("region").agg(F.regr_slope("label", "x").alias("s"), F.regr_r2("label", "x").alias("q"), F.avg("label").alias("m"), F.avg("x").alias("mx"))
    worst = got.join(want, "region").select(
        F.count(F.lit(1)).alias("n"), F.max(F.abs(F.col("slope") - F.col("s")) / (1 + F.abs("s"))).alias("d"), F.max(F.abs(F.col("r2") - F.col("q"))).alias("e"),
        F.max(F.abs(F.col("intercept") + F.col("slope") * F.col("mx") - F.col("m"))).alias("f"),
    ).first()
    assert worst.n == n and worst.d < 1e-6 and worst.e < 1e-6 and worst.f < 1e-3
    both = {r.region: r for r in regional.fit_regions(data, ["x", "z"]).filter("region IN ('17', '4321')").collect()}
    for region, found in both.items():
        part = data.filter(F.col("region") == region).toPandas()
        x = np.column_stack([part["x"] - 1e4, part["z"], np.ones(len(part))])
        exact = np.linalg.lstsq(x, part["label"], rcond=None)[0]
        assert found.coefficients == pytest.approx(exact[:2], rel=1e-5, abs=1e-5)
        assert found.intercept + 1e4 * found.coefficients[0] == pytest.approx(exact[2], rel=1e-5, abs=1e-4)


def test_regional_models_of_odd_groups(spark):
    rows = [("flat", 1.0, 2.0, 5.0)] * 4 + [("one", 1.0, 1.0, 1.0)] + [("null", None, 1.0, 2.0)] * 3 + [("twin", float(i), 2.0 * i, 3.0 * i + 1) for i in range(5)] + [(None, float(i), 0.0, -i) for i in range(3)]
    frame = spark.createDataFrame([(r, x, z, float(y)) for r, x, z, y in rows], "region string, x double, z double, label double")
    got = {r.region: r for r in regional.fit_regions(frame, ["x", "z"]).collect()}
    assert set(got) == {"flat", "twin", None}
    assert got["flat"].coefficients == [0, 0] and got["flat"].intercept == 5 and got["flat"].r2 is None
    assert got["twin"].coefficients[0] + 2 * got["twin"].coefficients[1] == pytest.approx(3) and got["twin"].r2 == pytest.approx(1)
    assert got[None].coefficients == pytest.approx([-1, 0])
    scored = regional.forecast_regions(frame, regional.fit_regions(frame, ["x", "z"]), ["x", "z"], spread=["x"])
    assert {r.region for r in scored.collect()} == {"flat", "twin"}
    assert regional.fit_regions(frame.filter("false"), ["x"]).count() == 0


@pytest.fixture(scope="module")
def planted(spark):
    """Label 5 * x in region a and 3 * w in region b; noise decides nothing."""
    rows = spark.range(3000).select(
        F.when(F.col("id") % 2 == 0, "a").otherwise("b").alias("region"), F.lit("1h").alias("horizon"), F.randn(1).alias("x"), F.randn(2).alias("w"), F.randn(3).alias("noise"),
        F.expr("TIMESTAMP_NTZ'2024-01-01' + make_dt_interval(0, 0, cast(id as int))").alias("ts"),
    )
    return rows.withColumn("label", F.when(F.col("region") == "a", F.col("x") * 5).otherwise(F.col("w") * 3)).cache()


def test_permutation_importance_finds_the_planted_columns(planted):
    columns = ["x", "w", "noise"]
    fitted = models.fit_ensemble(planted, columns, algorithms=["boosted", "forest"], rounds=20, depth=6, trees=20)
    got = {(r.region, r.feature): r.importance for r in permutation_importance(planted, fitted, columns).collect()}
    assert len(got) == 6
    assert got["a", "x"] > 0.8 and got["b", "w"] > 0.8
    assert got["a", "noise"] < 0.05 and got["b", "noise"] < 0.05
    errors = permutation_errors(planted, fitted, columns, block=100).collect()
    assert sum(r.rows for r in errors if r.feature == "x") == 3000
    again = {(r.region, r.feature): r.shuffled for r in permutation_errors(planted.repartition(5), fitted, columns, block=100).collect()}
    assert all(again[r.region, r.feature] == pytest.approx(r.shuffled) for r in errors)


def test_stored_forecaster_is_one_unit(spark, rows, ensemble, tmp_path):
    path = str(tmp_path / "store")
    with pytest.raises(FileNotFoundError):
        bundle.load(spark, path)
    qhat = spark.createDataFrame([("a", 1.5)], "region string, qhat double")
    ensemble.failed["forest2"] = "ValueError: no"
    bundle.save(bundle.Forecaster(ensemble, COLUMNS, qhat, None, {"level": "0.95"}), spark, path)
    again = bundle.load(spark, path)
    assert again.columns == COLUMNS and again.remarks == {"level": "0.95"} and again.importances is None
    assert again.ensemble.failed == {"forest2": "ValueError: no"} and again.ensemble.region_labels == ensemble.region_labels
    assert [tuple(r) for r in again.quantiles.collect()] == [("a", 1.5)]
    total = lambda e: e.transform(rows).agg(F.sum("point")).first()[0]
    assert total(again.ensemble) == pytest.approx(total(ensemble))
    ensemble.failed.clear()


def test_a_writer_that_dies_leaves_the_old_forecaster(spark, ensemble, tmp_path):
    path = str(tmp_path / "store")
    first = bundle.save(bundle.Forecaster(ensemble, COLUMNS, None, None, {"run": "1"}), spark, path)

    class Dies:
        schema = None

        @property
        def write(self):
            raise RuntimeError("killed")

    with pytest.raises(RuntimeError):
        bundle.save(bundle.Forecaster(ensemble, COLUMNS, Dies(), None, {"run": "2"}), spark, path)
    assert bundle.load(spark, path).remarks == {"run": "1"}
    for run in "345":
        bundle.save(bundle.Forecaster(ensemble, COLUMNS, None, None, {"run": run}), spark, path)
    assert bundle.load(spark, path).remarks == {"run": "5"}
    assert len(bundle.finished(spark, path)) == 2 and first not in bundle.finished(spark, path)


def test_filled_weather_knows_nothing_of_later_rows(spark):
    start = dt.datetime(2024, 1, 1)
    rows = [("a", start + dt.timedelta(minutes=15 * i), float(i), 1.0 if i < 8 else 100.0, None, 0.0) for i in range(9)]
    rows.append(("a", start + dt.timedelta(minutes=15 * 9), 9.0, None, None, None))
    frame = spark.createDataFrame(rows, "region string, ts timestamp_ntz, load double, temperature double, humidity double, solar_irradiance double")
    filled = fx.impute_weather(frame, fx.weather_means(frame, 0.8)).orderBy("ts").collect()
    assert filled[-1].temperature == 1.0 and filled[-1].humidity is None and len(filled) == 10
    assert fx.impute_weather(frame).orderBy("ts").collect()[-1].temperature == pytest.approx(12.0)


def test_vector_places_match(rows, ensemble):
    """Places of regions point at the 1 of the encoded columns."""
    placed = region_place(ensemble, rows.select("region").distinct())
    hot = {r.region: r.hot for r in placed.collect()}
    seen = ensemble.prepared.transform(rows.limit(50)).select("region", vector_to_array("region_hot").alias("v")).collect()
    assert all(r.v[hot[r.region]] == 1.0 for r in seen)
