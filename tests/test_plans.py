"""Physical plans and skew helpers."""

import datetime as dt
import re

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as contract
from loadspan.plans.skew import salted_join, with_global_rank
from loadspan.queries import inputs
from loadspan.sources import tables

QUERIES = contract.queries()


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def scans(text: str) -> list[str]:
    return [line for line in text.splitlines() if "FileScan" in line]


def test_trailing_read_filters_in_the_scan(spark, sf_dir):
    text = plan(QUERIES["trailing_7d"](spark, sf_dir))
    facts = [s for s in scans(text) if "value" in s.split("ReadSchema")[1]]
    first = inputs.axis(spark, sf_dir).newest - dt.timedelta(minutes=15 * 671)
    assert facts and all(f"GreaterThanOrEqual(ts,{first:%Y-%m-%dT%H:%M}" in s for s in facts)


def test_scans_read_only_what_is_used(spark, sf_dir):
    text = plan(QUERIES["latest_row"](spark, sf_dir))
    assert [re.search(r"ReadSchema: (.*)", s).group(1) for s in scans(text)] == [
        "struct<ts:timestamp_ntz,event_type:string,value:double>"
    ]
    columns = {c for s in scans(plan(QUERIES["topology_join"](spark, sf_dir))) for c in re.findall(r"(l_\w+):", s)}
    assert columns == {"l_orderkey", "l_suppkey", "l_extendedprice"}


@pytest.mark.parametrize("name", [
    "dense_grid", "load_share", "anomaly_region", "anomaly_total", "anomaly_total_path", "anomaly_spike",
    "fold_range_join", "rolling_backtest", "horizon_backtest", "topology_join", "residual_quantile", "anchor_step_fill",
    "region_horizon_lookup", "path_prefix", "horizon_steps", "stats_broadcast",
])
def test_no_nested_loops_or_products(spark, sf_dir, name):
    text = plan(QUERIES[name](spark, sf_dir))
    assert "BroadcastNestedLoopJoin" not in text and "CartesianProduct" not in text
    assert "Python" not in text


def test_lags_share_one_shuffle(spark, sf_dir):
    text = plan(QUERIES["lag_features"](spark, sf_dir))
    assert len(re.findall(r"Exchange hashpartitioning\(region#\d+, _block#\d+", text)) == 1
    assert len(re.findall(r"\bWindow \[", text)) == 1


def test_spine_of_few_regions_fills_the_tasks(spark):
    names = spark.createDataFrame([("a",), ("b",)], "region string")
    steps = tables.spine(names, tables.ntz(dt.date(2024, 1, 1)), tables.ntz(dt.date(2024, 3, 1)))
    rows = steps.groupBy(F.spark_partition_id().alias("p")).count().collect()
    width = int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert sum(r["count"] for r in rows) == 2 * (60 * 96 + 1) and len(rows) == width
    assert max(r["count"] for r in rows) < sum(r["count"] for r in rows) / 4


def test_salted_join_equals_a_join(spark):
    rows = spark.range(1000).select(F.when(F.col("id") % 3 == 0, "hot").otherwise(F.col("id").cast("string")).alias("k"), "id")
    per_key = rows.groupBy("k").agg(F.count(F.lit(1)).alias("n")).filter("k = 'hot' OR k < '5'")
    for how in ("inner", "left", "left_semi"):
        got = salted_join(rows, per_key, ["k"], ["id"], how, salts=7)
        want = rows.join(per_key, "k", how)
        assert sorted(got.select(want.columns).collect()) == sorted(want.collect())


@pytest.mark.parametrize("bins", [1, 3, 1024])
def test_global_rank(spark, bins):
    values = [5.0, 5.0, 1.0, 9.0, 2.5, 9.0, -3.0]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    got = sorted((r.v, r["rank"]) for r in with_global_rank(df, F.col("v"), bins=bins).collect())
    assert got == sorted((v, 1 + sum(o > v for o in values)) for v in values)
    same = spark.createDataFrame([(1.0,), (1.0,)], "v double")
    assert {r["rank"] for r in with_global_rank(same, F.col("v"), bins=bins).collect()} == {1}


def test_series_partitioned_by_day(spark, tmp_path, hours):
    load = hours({"a": range(96 * 3), "b": range(96 * 3)})
    path = str(tmp_path / "load")
    tables.write_series(load, path)
    assert sorted(tables.read_series(spark, path).select(load.columns).collect()) == sorted(load.collect())
    one = tables.read_series(spark, path, dt.date(2024, 1, 2), dt.date(2024, 1, 2))
    assert one.count() == 192
    assert "PartitionFilters: [isnotnull(day" in plan(one)


def test_writing_new_days_keeps_the_others(spark, tmp_path, hours):
    path, names = str(tmp_path / "load"), str(tmp_path / "regions")
    first, second = hours({"a": range(96 * 2), "b": range(96 * 2)}), hours({"a": range(96)}, dt.datetime(2024, 1, 3))
    again = hours({"a": [7.0] * 96}, dt.datetime(2024, 1, 2))
    for part in (first, second, again):
        tables.write_series(part, path)
        tables.write_regions(part, names)
    days = {r.day: (r.n, r.s) for r in tables.read_series(spark, path).groupBy(F.to_date("ts").alias("day")).agg(
        F.count(F.lit(1)).alias("n"), F.sum("load").alias("s")).collect()}
    assert days == {dt.date(2024, 1, 1): (192, 2 * sum(range(96))), dt.date(2024, 1, 2): (96, 7 * 96), dt.date(2024, 1, 3): (96, sum(range(96)))}
    assert {r.region for r in tables.read_regions(spark, names).collect()} == {"a", "b"}


def test_trailing_table_equals_the_end_of_the_whole(spark, sf_dir):
    inputs.forget()
    axis = inputs.axis(spark, sf_dir)
    whole = inputs.load(spark, sf_dir).filter(F.col("ts") >= axis.back(672))
    assert sorted(inputs.recent(spark, sf_dir).collect()) == sorted(whole.collect())


def test_a_trailing_read_of_days_reads_only_their_folders(spark, sf_dir):
    text = plan(QUERIES["trailing_by_day"](spark, sf_dir))
    facts = [s for s in scans(text) if "load:double" in s]
    assert facts and all("PartitionFilters: [isnotnull(day" in s and ">= " in s for s in facts)
    assert all("event_type" not in s for s in scans(text))


def test_an_empty_table_has_no_axis(spark):
    with pytest.raises(ValueError):
        tables.read_axis(spark.createDataFrame([], "ts timestamp_ntz"))
