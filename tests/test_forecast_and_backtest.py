import datetime as dt
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from loadspan.config import HORIZON_STEPS
from loadspan.operators import backtest as bt
from loadspan.operators import features as fx
from loadspan.operators import forecast as fc
from loadspan.operators import stats


def test_anchor_step_fill(spark):
    rows = [("a", 4, 5.0, None, None), ("a", 24, 7.0, 6.0, 9.0)]
    anchors = spark.createDataFrame(rows, "region string, step int, point double, lower double, upper double")
    got = {r.step: (r.point, r.lower, r.upper) for r in fc.anchor_step_fill(anchors, 24).collect()}
    assert len(got) == 24
    assert all(got[s][0] == 5 for s in range(1, 24)) and got[24] == (7, 6, 9)
    assert got[1][1:] == pytest.approx((4.5, 5.5))


def test_anchors_beyond_the_horizon_are_left_out(spark):
    rows = [("a", 4, 5.0, None, None), ("a", 24, 7.0, None, None)]
    anchors = spark.createDataFrame(rows, "region string, step int, point double, lower double, upper double")
    assert {r.point for r in fc.anchor_step_fill(anchors, 4).collect()} == {5.0}


def test_edge_and_left_pad(spark):
    df = spark.range(1).select(F.array(F.lit(1.0), F.lit(2.0)).alias("p"))
    assert df.select(fc.edge_pad(F.col("p"), 4).alias("x")).first().x == [1, 2, 2, 2]
    assert df.select(fc.edge_pad(F.col("p"), 1).alias("x")).first().x == [1]
    assert df.select(fx.left_pad_window(F.col("p"), 6).alias("x")).first().x == [0, 0, 0, 0, 1, 2]


def test_prefix_of_the_longest_path_is_the_shorter_path(hours):
    load = hours({"a": range(672)})
    end = F.lit("2024-01-07 23:45:00").cast("timestamp_ntz")
    arrays = {r.horizon: r.point for r in fc.path_arrays(fc.seasonal_naive(load, end)).collect()}
    assert {h: len(p) for h, p in arrays.items()} == HORIZON_STEPS
    assert arrays["48h"][:24] == arrays["6h"] == [float(i) for i in range(24)]


def test_recursive_forecast_feeds_back(hours):
    load = hours({"a": [1.0, 2.0, 3.0, 4.0]})
    got = [r.point for r in fc.recursive_forecast(load, {1: 1.0, 4: 0.5}, 1.0, steps=6).orderBy("step").collect()]
    hist = [1.0, 2.0, 3.0, 4.0]
    for _ in range(6):
        hist.append(1 + hist[-1] + 0.5 * hist[-4])
    assert got == pytest.approx(hist[4:])


def test_recursive_forecast_needs_enough_history(hours):
    assert fc.recursive_forecast(hours({"a": [1.0]}), {2: 1.0}).count() == 0


def measure(spark, column, rows, schema="y double, p double"):
    return spark.createDataFrame(rows, schema).agg(column.alias("v")).first().v


def test_mape(spark):
    assert measure(spark, stats.mape("y", "p"), [(100.0, 110.0), (200.0, 180.0), (300.0, 330.0)]) == pytest.approx(10)
    assert measure(spark, stats.mape("y", "p"), [(100.0, 110.0), (200.0, 190.0)]) == pytest.approx(7.5)
    assert measure(spark, stats.mape("y", "p"), [(0.0, 1.0)]) is None


def test_coverage(spark):
    rows = [(100.0, 95.0, 105.0), (110.0, 105.0, 115.0), (120.0, 115.0, 125.0), (1.0, 2.0, 3.0)]
    assert measure(spark, stats.coverage("y", "l", "u"), rows[:3], "y double, l double, u double") == 100
    assert measure(spark, stats.coverage("y", "l", "u"), rows, "y double, l double, u double") == 75
    assert measure(spark, stats.coverage("y", "l", "u"), [], "y double, l double, u double") == 0


def test_interval_falls_back_to_a_tenth(spark):
    df = spark.createDataFrame([("a", -50.0), ("b", 10.0)], "region string, point double")
    q = spark.createDataFrame([("b", 3.0)], "region string, qhat double")
    got = {r.region: (r.lower, r.upper) for r in fc.prediction_interval(df, q).collect()}
    assert got == {"a": (-55, -45), "b": (7, 13)}


@pytest.mark.parametrize("n, weeks", [(672, 0), (673, 1), (2880, 4), (10000, 4)])
def test_fold_bounds(spark, n, weeks):
    folds = bt.backtest_folds(spark.createDataFrame([("a", n)], "region string, n bigint")).collect()
    assert len(folds) == weeks
    for f in folds:
        assert f.test_end - f.test_start == 672 and f.test_end <= n
        assert f.train_start == max(0, f.test_start - 2880)


def brute_backtest(y, weeks=4, season=672, train=2880):
    out = {}
    for week in range(weeks):
        start = len(y) - (weeks - week) * season
        first = max(0, start - train)
        if first >= start:
            continue
        past, test = y[first:start], y[start:start + season]
        pred = past[-season:] if len(past) >= season else np.full(season, past[-1])
        nz = test != 0
        mape = np.mean(np.abs((test[nz] - pred[nz]) / test[nz])) * 100 if nz.any() else None
        naive = np.mean(np.abs(past[season:] - past[:-season])) if len(past) > season else 0
        out[week + 1] = (mape, np.mean(np.abs(test - pred)) / naive if naive else None, len(past))
    return out


def test_rolling_backtest_against_loops(hours):
    rng = np.random.default_rng(5)
    series = {"a": rng.integers(0, 9, 2900).astype(float), "b": rng.random(4500) + 1, "c": rng.random(1400)}
    got = {(r.region, r.week): r for r in bt.rolling_backtest(hours({k: list(v) for k, v in series.items()})).collect()}
    want = {(k, w): v for k, y in series.items() for w, v in brute_backtest(y).items()}
    assert set(got) == set(want)
    for key, (mape, mase, size) in want.items():
        assert got[key].train_size == size and got[key].test_size == 672
        assert got[key].mape == pytest.approx(mape)
        assert got[key].mase is None if mase is None else got[key].mase == pytest.approx(mase)


def test_known_backtest_cells(spark):
    from __spark_entry__ import queries

    got = {(r.region, r.week): r for r in queries()["rolling_backtest"](spark, "/root/testdata/sf0.01").collect()}
    assert got["click", 1].mape == pytest.approx(219.9141, abs=1e-4) and got["click", 1].mase is None
    assert got["view", 3].mase == pytest.approx(1.0616, abs=1e-4)
    assert got["signup", 4].mape == pytest.approx(259.5102, abs=1e-4)


def test_backtest_takes_other_forecasts(hours):
    load = hours({"a": [float(i % 7 + 1) for i in range(2900)]})
    perfect = load.withColumnRenamed("load", "predicted")
    assert {r.mape for r in bt.rolling_backtest(load, predictions=perfect).collect()} == {0.0}


def test_horizon_origins_every_hour_up_to_fifty(spark):
    folds = spark.createDataFrame([("a", 4, 0, 1000, 1672)], "region string, week int, train_start bigint, test_start bigint, test_end bigint")
    got = bt.horizon_origins(folds, limit=50).groupBy("horizon").agg(F.sort_array(F.collect_list("origin")).alias("o"), F.first("steps").alias("s")).collect()
    for r in got:
        want = [1000 + i + 95 for i in range(0, min(50, 672 - r.s), 4) if i + 96 + r.s < 672]
        assert r.o == want and len(r.o) == 13


def test_mean_of_means_skips_undefined(spark):
    weekly = spark.createDataFrame([("a", 1, 10.0, None), ("a", 2, 20.0, 1.0), ("b", 1, 40.0, 2.0)], "region string, week int, mape double, mase double")
    regions = bt.backtest_regions(weekly)
    assert {r.region: (r.mape, r.mase) for r in regions.collect()} == {"a": (15, 1), "b": (40, 2)}
    overall = bt.backtest_overall(regions).first()
    assert (overall.overall_mape, overall.overall_mase, overall.regions_tested) == (27.5, 1.5, 2)


def test_range_join_equals_a_nested_loop(spark):
    points = spark.range(200).select(F.lit("a").alias("k"), F.col("id").alias("pos"))
    bounds = [(0, 1), (5, 60), (59, 61), (150, 400), (7, 7)]
    ranges = spark.createDataFrame([("a", lo, hi) for lo, hi in bounds], "k string, lo bigint, hi bigint")
    got = sorted((r.lo, r.hi, r.pos) for r in bt.range_join(points, ranges.filter("lo < hi"), ["k"], "pos", "lo", "hi", 16).collect())
    assert got == sorted((lo, hi, p) for lo, hi in bounds for p in range(200) if lo <= p < hi)


def test_step_times_do_not_shift_with_the_session_zone(spark, hours):
    load = hours({"a": range(672)}, start=dt.datetime(2024, 3, 25))
    end = F.lit("2024-03-31 23:45:00").cast("timestamp_ntz")
    spark.conf.set("spark.sql.session.timeZone", "Europe/Berlin")
    try:
        first = fc.seasonal_naive(load, end).orderBy("step").first()
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    assert first.ts == dt.datetime(2024, 4, 1) and first.step == 1 and math.isclose(first.point, 0.0)


def test_region_series_prefers_paths_then_anchors_then_load(spark):
    paths = spark.createDataFrame(
        [("p", "1h", [1.0, 2.0], [0.5], [3.0, 4.0]), ("q", "1h", [5.0, 6.0, 7.0, 8.0, 9.0], [], [])],
        "region string, horizon string, point array<double>, lower array<double>, upper array<double>",
    )
    anchors = spark.createDataFrame(
        [("a", 1, 10.0, None, None), ("a", 24, 99.0, None, None), ("p", 4, 77.0, None, None)],
        "region string, step int, point double, lower double, upper double",
    )
    latest = spark.createDataFrame([(r, 20.0) for r in "pqaz"], "region string, load double")
    got = {}
    for r in fc.region_series(paths, anchors, latest, "1h").orderBy("step").collect():
        got.setdefault(r.region, []).append((r.point, r.lower, r.upper))
    assert got["p"] == [(1, 0.5, 3), (2, 0.5, 4), (2, 0.5, 4), (2, 0.5, 4)]
    assert [v[0] for v in got["q"]] == [5, 6, 7, 8] and got["q"][0][1:] == pytest.approx((4.5, 5.5))
    assert [v[0] for v in got["a"]] == [10] * 4 and [v[0] for v in got["z"]] == [20] * 4
    total = fc.path_sum(fc.region_series(paths, anchors, latest, "1h"), ["point", "lower"]).orderBy("step").first()
    assert total.point == 36


def test_horizon_tables(spark):
    from loadspan.config import HOURLY_HORIZON_STEPS
    from loadspan.operators.reshape import horizon_dim

    assert fc.validate_horizons(horizon_dim(spark, HORIZON_STEPS)).count() == 0
    assert fc.validate_horizons(horizon_dim(spark, HOURLY_HORIZON_STEPS, 60)).count() == 0
    assert {r.horizon for r in fc.validate_horizons(horizon_dim(spark, {"24h": 24, "1h": 4, "2y": 1})).collect()} == {"24h", "2y"}
    assert fc.history_hours() == 240
