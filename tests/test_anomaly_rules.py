"""Hand-worked frames for the anomaly rules."""

import datetime as dt
import math

import pytest
from pyspark.sql import functions as F

from loadspan.config import Thresholds
from loadspan.operators import anomaly as an
from loadspan.operators import stats

END = dt.datetime(2024, 1, 1)


def anchors(spark, rows):
    return spark.createDataFrame(
        [(r, END, h, float(v)) for r, h, v in rows], "region string, origin timestamp_ntz, horizon string, point double"
    )


def path(spark, values):
    rows = [(r, i + 1, END, float(v)) for r, vs in values.items() for i, v in enumerate(vs)]
    return spark.createDataFrame(rows, "region string, step int, ts timestamp_ntz, point double")


def end_literal():
    return F.lit("2024-01-01").cast("timestamp_ntz")


def test_flat_history_finds_nothing(hours):
    flat = hours({"a": [10.0] * 672})
    assert stats.region_stats(flat).first()["std"] == 1e-6
    assert an.anomaly_region(flat).count() == 0
    assert an.region_status(flat).first()["z_score"] == 0


def test_single_spike(hours):
    found = an.anomaly_region(hours({"a": [10.0] * 671 + [100.0]})).collect()
    assert len(found) == 1
    assert found[0].z_score == pytest.approx(671 / math.sqrt(672), abs=1e-6)
    assert found[0].severity == "high"
    assert found[0].current_load == 100


def test_short_history(hours):
    status = an.region_status(hours({"a": [1.0, 2.0, 3.0]})).first()
    assert status["mean"] == 2 and status["z_score"] == 1


def test_threshold_is_strict(hours):
    window = hours({"a": [1.0, 2.0, 3.0]})
    assert an.anomaly_region(window, Thresholds(region=1.0)).count() == 0
    assert an.anomaly_region(window, Thresholds(region=0.999999)).count() == 1


def test_exclude_current(hours):
    window = hours({"a": [1.0, 3.0, 9.0]})
    assert an.region_status(window, exclude_current=True).first()["mean"] == 2


def test_peer_bound_of_five_regions(hours):
    rows = hours({**{r: [1.0] for r in "abcd"}, "e": [9.0]})
    assert an.anomaly_peer(rows).count() == 0
    found = an.anomaly_peer(rows, Thresholds(peer=1.2)).collect()
    assert [(f.region, f.type) for f in found] == [("e", "peer")]
    assert found[0].z_score == pytest.approx(1.788854, abs=1e-6)


def test_share_of_exactly_forty_percent(hours):
    window = hours({"a": [4.0, 4.0], "b": [3.0, 3.0], "c": [3.0, 3.0]})
    found = an.anomaly_share(window).collect()
    assert [(f.region, f.severity, f.current_share) for f in found] == [("a", "high", 0.4)]


def test_share_increase(hours):
    window = hours({"a": [2.0] * 20 + [7.0], "b": [8.0] * 20 + [13.0], "c": [10.0] * 20 + [0.0]})
    found = {f.region: f for f in an.anomaly_share(window, Thresholds(peer=99, share_absolute=0.99)).collect()}
    assert set(found) == {"a", "b"}
    assert found["a"].expected_low >= 0 and found["a"].expected_high <= 1


def test_uniform_share_statistics(hours):
    shares = stats.load_share(hours({"a": [9.0], "b": [1.0]}))
    got = {r.region: (r.share_mean, r.share_std) for r in stats.share_stats(shares, "uniform").collect()}
    assert got == {"a": (0.5, 0.025), "b": (0.5, 0.025)}


def test_share_fallbacks(hours):
    # one row per region: no deviation, so the mean falls back to 1/n and the deviation to a fifth
    got = stats.share_stats(stats.load_share(hours({"a": [9.0], "b": [1.0]}))).collect()
    assert {(r.share_mean, round(r.share_std, 9)) for r in got} == {(0.5, 0.1)}


def test_zero_total_gives_zero_shares(hours):
    shares = stats.load_share(hours({"a": [1.0, 0.0], "b": [1.0, 0.0]}))
    last = shares.filter("total = 0").collect()
    assert [r.share for r in last] == [0, 0] and [r.ratio for r in last] == [None, None]


def test_spike_needs_more_than_ten_differences(spark, hours):
    jump = anchors(spark, [("a", "15min", 1000)])
    def run(n):
        window = hours({"a": [float(i % 3) for i in range(n)]}, start=END - dt.timedelta(minutes=15 * (n - 1)))
        return an.anomaly_spike(window, jump).count()
    assert run(11) == 0
    assert run(12) == 1


def test_forecast_anchor(spark, hours):
    window = hours({"a": [1.0, 2.0, 3.0]})
    found = an.anomaly_forecast_anchor(window, anchors(spark, [("a", "1h", 5), ("a", "6h", 4)])).collect()
    assert [(f.horizon, f.severity, f.z_score) for f in found] == [("1h", "forecast", 3)]


def test_total_anchor_with_missing_horizons(spark, hours):
    window = hours({"a": [10.0, 11.0, 12.0], "b": [10.0, 11.0, 12.0]})
    given = anchors(spark, [("a", "1h", 11), ("b", "1h", 11)])
    assert an.anomaly_total_anchor(window, given).count() == 0
    zero = an.anomaly_total_anchor(window, given, missing="zero").collect()
    assert sorted(f.horizon for f in zero) == sorted(["15min", "6h", "12h", "24h", "48h"])


def test_worst_step_takes_the_first_on_ties(spark, hours):
    window = hours({"a": [1.0, 2.0, 3.0]})
    found = an.anomaly_region_path(window, path(spark, {"a": [2, 7, -3, 7]}), end_literal()).collect()
    by = {f.horizon: f for f in found}
    assert set(by) == {"1h", "6h", "12h", "24h", "48h"}
    assert by["1h"].predicted_load == 7 and by["1h"].z_score == 5 and by["1h"].type == "per-step"


def test_total_path(spark, hours):
    window = hours({"a": [1.0, 2.0, 3.0], "b": [0.0, 0.0, 0.0]})
    found = an.anomaly_total_path(window, path(spark, {"a": [2, 9], "b": [0, 1]}), end_literal()).collect()
    assert {f.horizon: f.predicted_load for f in found} == {h: 10 for h in ("1h", "6h", "12h", "24h", "48h")}


def test_all_rules_and_report_order(spark, hours):
    window = hours({"a": [10.0] * 671 + [100.0], "b": [10.0] * 672})
    end = F.lit("2024-01-07 23:45:00").cast("timestamp_ntz")
    found = an.all_rules(window, anchors(spark, [("a", "1h", 500)]), path(spark, {"a": [500]}), end)
    first = an.first_anomalies(found).collect()
    assert len(first) == 5
    position = [an.RULES.index(f.rule) for f in first]
    assert position == sorted(position)
    assert first[0].rule == "anomaly_region"


def test_unknown_scope(hours):
    with pytest.raises(ValueError):
        an.anomaly_region(hours({"a": [1.0]}), scope="everything")
