"""Canonical tables: names, the end of the axis, gaps."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from loadspan.operators import features as fx
from loadspan.operators import reshape
from loadspan.sources import tables

START = dt.datetime(2024, 1, 1)


def events(spark, rows):
    """Rows (region, minutes, value, k)."""
    made = [(i, START + dt.timedelta(minutes=m), 1, r, float(v), f'{{"k": {k}}}') for i, (r, m, v, k) in enumerate(rows)]
    return spark.createDataFrame(
        made, "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string",
    )


def test_twelve_regions_are_all_renamed(spark):
    named = spark.createDataFrame([(f"src{i:02d}",) for i in range(12)] * 2 + [(None,)], "source_name string")
    got = {r.source_name: r.region for r in reshape.region_canonical(named).collect()}
    assert got == {f"src{i:02d}": f"region_{i + 1}" for i in range(12)} | {None: None}


def test_a_wide_table_has_every_region(spark, hours):
    load = hours({"click": [1, 2], "unseen": [3, 4]})
    names = reshape.region_names(load)
    assert names == ["click", "unseen"]
    long = reshape.wide_to_long(reshape.long_to_wide(load, names, "load"), names, "load")
    assert sorted(long.select("region", "ts", "load").collect()) == sorted(load.select("region", "ts", "load").collect())


def test_the_grid_ends_at_the_newest_step(spark):
    given = events(spark, [("a", 0, 1, 5), ("b", 9 * 60 + 50, 102, 7), ("a", 9 * 60 + 44, 3, 1)])
    axis = tables.read_axis(given)
    load = tables.load_table(given, axis)
    newest = load.filter(F.col("ts") == axis.hi)
    assert {(r.region, r.ts, r.load) for r in newest.collect()} == {
        ("a", START + dt.timedelta(minutes=585), 0.0), ("b", START + dt.timedelta(minutes=585), 102.0)
    }
    assert load.count() == 2 * 40 and load.agg(F.max("ts").alias("m")).first().m == START + dt.timedelta(minutes=585)
    last = tables.load_table(given, axis, 1)
    assert sorted(last.collect()) == sorted(newest.collect())


def test_missing_weather_stays_missing(spark):
    given = events(spark, [("a", 0, 1, 5), ("a", 75, 2, 9), ("b", 130, 1, 3)])
    axis = tables.read_axis(given)
    series = tables.series_table(given, axis)
    assert series.filter("load IS NULL").count() == 0
    assert series.filter("temperature IS NOT NULL").count() == 3
    assert sorted(tables.weather_table(given, axis).collect()) == sorted(series.drop("load").collect())
    hourly = fx.hourly_resample(series, ["load", "temperature"])
    got = {(r.region, r.ts.hour): (r.load, r.temperature) for r in hourly.collect()}
    assert got["a", 0] == (0.25, 5.0) and got["a", 1] == (0.5, 9.0) and got["b", 0] == (0.0, None)


@pytest.mark.parametrize("minutes,want", [(15, (9, 45)), (60, (9, 0)), (1440, (0, 0))])
def test_steps_are_floored_from_the_begin_of_the_day(minutes, want):
    at = tables.floor_step(dt.datetime(2024, 3, 5, 9, 59, 59, 5), minutes)
    assert (at.day, at.hour, at.minute, at.second) == (5, *want, 0)
