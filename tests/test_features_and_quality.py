import datetime as dt

import pandas as pd
import pytest
from pandas.tseries.holiday import USFederalHolidayCalendar
from pyspark.sql import functions as F

from loadspan.functions import profile, text
from loadspan.functions.time import calendar, floor_15min, us_holiday
from loadspan.operators import features as fx
from loadspan.operators import quality, reshape, stats, topology
from loadspan.sources import tables


def test_holidays_equal_pandas(spark):
    days = pd.date_range("1970-01-01", "2040-12-31")
    want = set(USFederalHolidayCalendar().holidays(days[0], days[-1]).strftime("%Y-%m-%d"))
    got = (
        spark.sql("SELECT explode(sequence(DATE'1970-01-01', DATE'2040-12-31', INTERVAL 1 DAY)) d")
        .filter(us_holiday("d")).select(F.col("d").cast("string")).collect()
    )
    assert {r[0] for r in got} == want
    assert "2021-12-31" in want


def test_calendar_counts_monday_as_zero(spark):
    df = spark.createDataFrame([(dt.datetime(2024, 1, 1, 13, 44, 59),), (dt.datetime(2024, 1, 7, 0, 0),)], "ts timestamp_ntz")
    monday, sunday = df.select(*[c.alias(n) for n, c in calendar("ts").items()], floor_15min("ts").alias("f")).collect()
    assert (monday.hour, monday.day_of_week, monday.is_weekend, monday.is_holiday) == (13, 0, 0, 1)
    assert (sunday.day_of_week, sunday.is_weekend, sunday.is_holiday) == (6, 1, 0)
    assert monday.f == dt.datetime(2024, 1, 1, 13, 30)


def test_gap_is_irregular_until_the_grid_is_dense(spark, hours):
    series = hours({"a": [1, 2, 3, 4], "b": [1, 2, 3, 4]}).filter("NOT (region = 'a' AND load = 2)")
    got = {r.region: r.irregular_steps for r in quality.grid_regularity(series.select("region", "ts")).collect()}
    assert got == {"a": 1, "b": 0}
    lo, hi = (F.lit(t).cast("timestamp_ntz") for t in ("2024-01-01 00:00:00", "2024-01-01 00:45:00"))
    dense = tables.dense_grid(series, series.select("region").distinct(), lo, hi, ["load"])
    assert dense.filter("region = 'a'").orderBy("ts").select("load").collect() == [(1,), (0,), (3,), (4,)]
    assert {r.irregular_steps for r in quality.grid_regularity(dense.select("region", "ts")).collect()} == {0}


def test_seconds_and_fractions_are_off_the_grid(spark):
    rows = [("a", dt.datetime(2024, 1, 1)), ("a", dt.datetime(2024, 1, 1, 0, 15, 0, 1)), ("a", dt.datetime(2024, 1, 1, 0, 31, 2))]
    got = quality.grid_regularity(spark.createDataFrame(rows, "region string, ts timestamp_ntz")).first()
    assert (got.irregular_steps, got.off_grid_minutes, got.with_seconds) == (2, 1, 2)


def test_range_rules(spark, hours):
    load = hours({"a": [1.0, -1.0]})
    weather = load.select("region", "ts", F.lit(70.0).alias("temperature"), F.lit(None).cast("double").alias("humidity"), F.lit(-1.0).alias("wind_speed"))
    got = {r["rule"]: r["violations"] for r in quality.range_validation(load, weather).collect()}
    assert got == {"load_null": 0, "load_negative": 1, "temperature_null": 0, "temperature_range": 2,
                   "humidity_null": 2, "humidity_range": 0, "wind_speed_null": 0, "wind_speed_negative": 2}


def test_missing_rows(hours):
    both = hours({"a": [1, 2]})
    assert quality.missing_rows(both, both.filter("load = 1")).count() == 1


def test_features_have_thirteen_columns_and_no_gaps(hours):
    load = hours({"a": range(700)})
    weather = load.select("region", "ts", *[F.col("load").alias(c) for c in ("temperature", "humidity", "solar_irradiance")])
    table = fx.quarter_hour_features(load, weather)
    assert table.count() == 28 and len(table.columns) == 16
    row = table.orderBy("ts").first()
    assert (row.lag_1h, row.lag_168h, row.temperature) == (668, 0, 672)
    assert fx.hourly_features(load, weather).count() == 175 - 168


def test_label_gap(hours):
    load = hours({"a": range(10)})
    assert fx.lead_target(load, 2).orderBy("ts").first().target == 2
    assert fx.lead_target(load, 2, gap=1).orderBy("ts").first().target == 3


def test_chrono_split_sizes(hours):
    got = reshape.chrono_split(hours({"a": range(105)})).groupBy("part").count().collect()
    assert {r.part: r["count"] for r in got} == {"train": 84, "validation": 10, "test": 11}


def test_all_regions_are_renamed(spark):
    df = spark.createDataFrame([(f"n{i}",) for i in range(9)], "source_name string")
    got = [r.region for r in reshape.region_canonical(df).orderBy("source_name").collect()]
    assert got == [f"region_{i + 1}" for i in range(9)]


def test_narrow_types(spark):
    df = spark.createDataFrame([(1, 127, 40000, 2**40, 1.5, "x", True)], "a bigint, b bigint, c bigint, d bigint, e double, f string, g boolean")
    assert dict(reshape.narrow_types(df).dtypes) == {
        "a": "tinyint", "b": "smallint", "c": "int", "d": "bigint", "e": "float", "f": "string", "g": "boolean"}


def test_wide_and_back(hours):
    load = hours({"a": [1, 2], "b": [3, 4]})
    wide = reshape.long_to_wide(load, ["a", "b"], "load")
    assert wide.columns == ["ts", "a", "b"]
    back = reshape.wide_to_long(wide, ["a", "b"], "load").select(load.columns)
    assert sorted(back.collect()) == sorted(load.collect())


def test_finite_filter_drops_the_whole_timestamp(spark, hours):
    load = hours({"a": [1.0, float("nan"), 3.0], "b": [1.0, 2.0, float("inf")]})
    assert {r.ts.minute for r in reshape.finite_filter(load, "load").collect()} == {0}


def test_shares_sum_to_one_and_total_is_the_sum(hours):
    load = hours({"a": [1, 2], "b": [3, 6]})
    assert [round(r.s, 12) for r in stats.load_share(load).groupBy("ts").agg(F.sum("share").alias("s")).collect()] == [1, 1]
    table = {r.region: r.energy for r in stats.region_and_total(load).collect()}
    assert table["TOTAL"] == table["a"] + table["b"] == 12


def test_peak_hours_wrap_at_midnight(spark):
    df = spark.createDataFrame([(dt.datetime(2024, 1, 1, 23, 30), [0])], "ts timestamp_ntz, hours array<int>")
    value = df.select(profile.peak_hour_proximity("ts", "hours").alias("v")).first().v
    assert value == pytest.approx(0.15 * 2.718281828459045 ** (-0.25 / 0.5))


def test_curves_stay_in_range(spark):
    df = spark.sql("SELECT explode(sequence(TIMESTAMP_NTZ'2024-01-01', TIMESTAMP_NTZ'2024-12-31', INTERVAL 1 HOUR)) ts, 'region_7' region")
    curves = profile.with_region_profile(df).select(*[c.alias(n) for n, c in profile.weather_curves("ts").items()])
    low = curves.agg(F.min("humidity").alias("h"), F.min("solar_irradiance").alias("s")).first()
    high = curves.agg(F.max("humidity").alias("h"), F.max("solar_irradiance").alias("s")).first()
    assert (low.h, low.s) == (20, 0) and high.h <= 95 and 900 < high.s <= 1100


def test_texts(spark):
    df = spark.createDataFrame([("a", 9.06, None, 4)], "region string, mape double, mase double, weeks_tested int")
    assert df.select(text.summary_line().alias("l")).first().l == "  a: MAPE=  9.1%, MASE=   N/A, Weeks=4"
    assert df.select(text.metric_text("mape", "MW").alias("l")).first().l == "9.1 MW"


def test_topology(spark):
    nodes = spark.createDataFrame([("a", 600.0), ("b", 301.0), ("c", 500.0)], "region string, load double")
    edges = spark.createDataFrame([("a", "b", 90.0), ("a", "c", 10.0), ("a", "x", 5.0)], "src string, dst string, flow double")
    assert topology.known_edges(edges, nodes).count() == 2
    got = {r.dst: (r.src_band, r.dst_band, r.status) for r in topology.connection_status(topology.topology_join(edges, nodes)).collect()}
    assert got == {"b": ("red", "orange", "congested"), "c": ("red", "orange", "normal")}
    assert [(r.region, r.stress_level) for r in topology.stress_points(nodes).collect()] == [("a", "high")]
    assert topology.capacity_utilisation(nodes, topology.capacity_dim(nodes)).filter("region = 'a'").first().available == 150
