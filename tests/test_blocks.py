"""Block-wise window computations equal plain windows over whole series."""

import datetime as dt
import random

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from loadspan.operators.stats import exact_quantile
from loadspan.plans.blocks import with_position, with_previous, with_window_columns


@pytest.fixture
def gappy(spark):
    rng = random.Random(7)
    start = dt.datetime(2023, 12, 30)
    rows = []
    for region, n in (("a", 700), ("b", 40), ("c", 1)):
        steps = sorted(rng.sample(range(3000), n))
        rows += [(region, start + dt.timedelta(minutes=15 * s), rng.random()) for s in steps]
    # a long silence, wider than several blocks
    rows.append(("b", start + dt.timedelta(days=200), 1.0))
    return spark.createDataFrame(rows, "region string, ts timestamp_ntz, load double").cache()


def plain():
    return Window.partitionBy("region").orderBy("ts")


def same(a, b):
    assert sorted(map(tuple, a.collect()), key=str) == sorted(map(tuple, b.collect()), key=str)


@pytest.mark.parametrize("days", [1, 3, 28])
def test_position_and_size(gappy, days):
    got = with_position(gappy, ["region"], "ts", size="n", days=days).select("region", "ts", "idx", "n")
    n = F.count(F.lit(1)).over(Window.partitionBy("region"))
    same(got, gappy.select("region", "ts", (F.row_number().over(plain()) - 1).cast("bigint").alias("idx"), n.alias("n")))


@pytest.mark.parametrize("days", [1, 3, 28])
def test_previous(gappy, days):
    got = with_previous(gappy, ["region"], "ts", days=days).select("region", "ts", "previous")
    same(got, gappy.select("region", "ts", F.lag("ts").over(plain()).alias("previous")))


@pytest.mark.parametrize("days", [1, 2, 28])
def test_lag_and_lead_on_dense_series(hours, days):
    load = hours({"a": range(900), "b": range(500)})
    def columns(w):
        return {"back": F.lag("load", 200).over(w), "ahead": F.lead("load", 100).over(w)}
    got = with_window_columns(load, ["region"], "ts", columns, back="3000 MINUTES", ahead="1500 MINUTES", days=days)
    want = load.withColumns(columns(plain()))
    same(got.select(want.columns), want)


def test_window_without_keys(hours):
    total = hours({"t": range(400)}).select("ts", F.col("load").alias("total"))
    got = with_window_columns(total, [], "ts", lambda w: {"d": F.col("total") - F.lag("total").over(w)}, back="15 MINUTES", days=1)
    assert got.filter("d = 1").count() == 399
    assert got.filter("d is null").count() == 1


@pytest.mark.parametrize("accuracy", [2, 10, 10_000])
@pytest.mark.parametrize("p", [0.0, 0.05, 0.5, 0.95, 1.0])
def test_exact_quantile(spark, accuracy, p):
    """A coarse cut must not change the result, with ties and a group of a third of all rows."""
    rng = random.Random(3)
    groups = {"hot": [rng.choice([1.0, 2.0, 5.5]) for _ in range(900)] + [rng.random() * 9 for _ in range(100)],
              "small": [3.0], "even": [rng.gauss(0, 1) for _ in range(500)], "spread": [10.0**i for i in range(8)]}
    rows = [(g, v) for g, vs in groups.items() for v in vs]
    df = spark.createDataFrame(rows, "g string, v double")
    got = {r.g: r.q for r in exact_quantile(df, ["g"], "v", p, "q", accuracy).collect()}
    assert set(got) == set(groups)
    for g, values in groups.items():
        assert got[g] == pytest.approx(np.quantile(values, p), rel=1e-12, abs=1e-12)
