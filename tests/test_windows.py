"""Window vectors of bins against plain loops, and members fitted on them."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from loadspan.operators import windows


@pytest.fixture(scope="module")
def features(spark):
    return spark.range(96 * 9).select(
        F.explode(F.array(F.lit("a"), F.lit("b"))).alias("region"), "id", F.expr("TIMESTAMP_NTZ'2024-01-01' + make_dt_interval(0, 0, cast(id * 15 as int))").alias("ts"),
    ).select(
        "region", "ts", (F.sin(F.col("id") * 6.283185307179586 / 96) * 10 + F.ascii("region")).alias("load"), (F.col("id") % 5).cast("int").alias("k"),
        F.when(F.col("id") % 7 > 0, F.col("id") % 11).cast("double").alias("gaps"), F.lit(3.0).alias("same"),
    ).cache()


def test_windows_equal_a_plain_loop(features):
    edges = windows.bin_edges(features, ["load", "k", "gaps", "same"], bins=8)
    assert len(edges["k"]) == 5 and len(edges["same"]) == 1 and len(edges["load"]) <= 7
    got = {(r.region, r.ts): r for r in windows.window_rows(features, edges, steps=4, size=6).collect()}
    for region in "ab":
        rows = features.filter(F.col("region") == region).orderBy("ts").collect()
        bins = [[0 if r[c] is None else sum(e < r[c] for e in edges[c]) for c in edges] for r in rows]
        for i, r in enumerate(rows):
            found = got.get((region, r.ts))
            if i < 6 or i + 4 >= len(rows):
                assert found is None
            else:
                assert found.window == [v for b in bins[i - 6:i] for v in b] and found.label == rows[i + 4].load
    assert windows.window_rows(features, edges, 4, 6).schema["window"].dataType.elementType.simpleString() == "tinyint"


def test_members_learn_from_whole_windows(spark, features, tmp_path):
    columns = ["load", "k", "gaps"]
    windows.window_rows(features, windows.bin_edges(features, columns), 4).write.parquet(str(tmp_path / "w"))
    rows = spark.read.parquet(str(tmp_path / "w"))
    assert rows.count() == 2 * (96 * 9 - 96 - 4)
    fitted = windows.fit_windows(rows, rounds=3, depth=3, trees=5)
    assert set(fitted) == {"boosted", "forest", "linear"} and all(m.numFeatures == 96 * 3 for m in fitted.values())
    scored = windows.score_windows(rows, {"forest": fitted["forest"], "linear": fitted["linear"]}).toPandas()
    assert np.abs(scored["point"] - scored["label"]).mean() < 2
    assert scored.columns.tolist() == ["region", "ts", "label", "window", "point"]


def test_edges_of_nothing(spark, features):
    assert windows.bin_edges(features.filter("false"), ["load"]) == {"load": []}
    assert windows.window_rows(features.limit(0), {"load": []}, 1).count() == 0
    with pytest.raises(ValueError):
        windows.bin_edges(features, ["load"], bins=300)
