"""What keeps the registered importances short: no walk for every column, members fitted side by side, events aggregated once."""

import datetime as dt
import threading

import numpy as np
import pytest
from pyspark.sql import functions as F

from loadspan.operators import models
from loadspan.operators.importance import LeafSets, walked
from loadspan.operators.roll import Trees
from loadspan.queries import learning


def grown(depth, whole, count=12, wide=3, regions=2):
    """Random trees over ``wide`` columns and the region's; values and cuts are tenths, so that many values lie on a cut."""
    draw = np.random.default_rng(depth)
    feature, threshold, left, right, value = [], [], [], [], []

    def grow(levels):
        at = len(feature)
        for column, start in ((feature, -1), (threshold, 0.0), (left, 0), (right, 0), (value, draw.normal())):
            column.append(start)
        if levels and (whole or draw.random() < 0.7):
            feature[at] = int(draw.integers(wide + regions))
            threshold[at] = 0.5 if feature[at] >= wide else round(float(draw.normal()), 1)
            left[at], right[at] = grow(levels - 1), grow(levels - 1)
        return at

    roots = [grow(depth) for _ in range(count)]
    return Trees(*map(np.array, (feature, threshold, left, right, value, roots)), draw.random(count), depth)


@pytest.mark.parametrize("depth, whole", [(0, True), (1, True), (4, False), (6, True)])
def test_leaf_sets_predict_as_a_walk_for_every_column(depth, whole):
    trees, draw = grown(depth, whole), np.random.default_rng(1)
    x, hot = np.round(draw.normal(size=(500, 3)), 1), draw.integers(-1, 2, 500)
    x[::50, 1] = np.nan
    orders = [draw.permutation(500) for _ in range(3)]
    sets = LeafSets(trees, 3)
    assert sets.small
    assert sets.predict(x, hot, orders) == pytest.approx(walked(trees, x, hot, orders))


def test_trees_of_more_leaves_than_bits_are_walked():
    assert not LeafSets(grown(7, True), 3).small


def test_members_are_fitted_side_by_side(spark, monkeypatch):
    both = threading.Barrier(2)

    class Waits:
        def fit(self, rows):
            both.wait(30)
            return rows.count()

    monkeypatch.setattr(models, "members", lambda label: {"boosted": Waits(), "forest": Waits()})
    rows = spark.range(4).select(F.lit("a").alias("region"), F.col("id").cast("double").alias("load"), F.lit(1.0).alias("label"))
    ensemble = models.fit_ensemble(rows, ["load"], algorithms=["boosted", "forest"])
    assert list(ensemble.fitted.items()) == [("boosted", 4), ("forest", 4)]
    # many rows: one after the other, so each waits in vain
    monkeypatch.setattr(models, "ROWS_SIDE_BY_SIDE", 3)
    both = threading.Barrier(2)
    monkeypatch.setattr(Waits, "fit", lambda self, rows: both.wait(0.2))
    with pytest.raises(RuntimeError):
        models.fit_ensemble(rows, ["load"], algorithms=["boosted", "forest"])


def test_events_are_aggregated_once_for_the_means_and_the_rows(spark, tmp_path):
    first = dt.datetime(2024, 1, 1)
    rows = [(i, first + dt.timedelta(minutes=15 * i), kind, float(i), '{"k": 1}') for i in range(200) for kind in ("a", "b")]
    spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, event_type string, value double, props string").write.parquet(f"{tmp_path}/events.parquet")
    learning.src.forget()
    series, means = learning.imputed(spark, str(tmp_path), learning.DIRECT)
    assert series.count() == 400 and means.count() == 2
    assert not [f for f in series.inputFiles() if "events.parquet" in f]
