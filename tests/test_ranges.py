"""Computations by ranges: as-of joins and previous rows against SQL and plain loops."""

import datetime as dt
import random

import duckdb
import pytest
from pyspark.sql import functions as F

from loadspan.operators import quality
from loadspan.plans.ranges import asof_join, ranged, with_previous_in_ranges

START = dt.datetime(2024, 1, 1)


def sides(seed):
    rng = random.Random(seed)
    hot = lambda: "hot" if rng.random() < 0.5 else rng.choice("abc")
    at = lambda: START + dt.timedelta(seconds=rng.randrange(4000))
    left = [(i, hot(), at()) for i in range(400)] + [(900, None, at()), (901, "a", None), (902, "gone", at())]
    right = [(hot(), at(), float(i)) for i in range(300)] + [(None, START, 1.0), ("a", None, 2.0), ("b", START, None)]
    return left, right


@pytest.mark.parametrize("tolerance", [None, "60 SECONDS"])
@pytest.mark.parametrize("seed", range(2))
def test_asof_join_equals_the_sql(spark, seed, tolerance):
    left, right = sides(seed)
    rows = spark.createDataFrame(left, "id int, k string, ts timestamp_ntz")
    known = spark.createDataFrame(right, "k string, ts timestamp_ntz, v double")
    got = sorted((r.id, r.found_ts, r.v) for r in asof_join(rows, known, ["k"], "ts", ["v"], tolerance).collect())
    con = duckdb.connect()
    con.execute("CREATE TABLE l(id INT, k TEXT, ts TIMESTAMP)")
    con.executemany("INSERT INTO l VALUES (?, ?, ?)", left)
    con.execute("CREATE TABLE raw(k TEXT, ts TIMESTAMP, v DOUBLE)")
    con.executemany("INSERT INTO raw VALUES (?, ?, ?)", right)
    con.execute("CREATE TABLE r AS SELECT k, ts, max(v) AS v FROM raw WHERE k IS NOT NULL AND ts IS NOT NULL GROUP BY k, ts")
    near = "r.ts >= l.ts - INTERVAL 60 SECOND" if tolerance else "true"
    want = con.execute(f"""SELECT l.id, CASE WHEN {near} THEN r.ts END, CASE WHEN {near} THEN r.v END FROM l ASOF LEFT JOIN r ON l.k = r.k AND l.ts >= r.ts ORDER BY 1""").fetchall()
    assert got == want
    assert sum(f is not None for _, f, _ in got) > 50


def test_asof_join_of_empty_sides_and_clashes(spark):
    left = spark.createDataFrame([(1, START)], "k int, ts timestamp_ntz")
    right = spark.createDataFrame([(1, START, 5)], "k int, ts timestamp_ntz, v int")
    assert [tuple(r) for r in asof_join(left, right.filter("false"), ["k"], "ts", ["v"]).collect()] == [(1, START, None, None)]
    assert asof_join(left.filter("false"), right, ["k"], "ts", ["v"]).count() == 0
    with pytest.raises(ValueError):
        asof_join(left.withColumn("v", F.lit(1)), right, ["k"], "ts", ["v"])


def test_a_region_with_all_rows_in_one_minute_is_spread(spark):
    rows = spark.range(40_000).select(
        F.when(F.col("id") % 50 == 0, "few").otherwise("all").alias("region"),
        F.expr("TIMESTAMP_NTZ'2024-01-01' + make_dt_interval(0, 0, 0, cast((id * 7919 % 40000) / 1000 as decimal(18,6)))").alias("ts"),
    )
    sizes = [r["count"] for r in ranged(rows, ["region"], "ts").groupBy("_part").count().collect()]
    assert len(sizes) == int(spark.conf.get("spark.sql.shuffle.partitions")) and max(sizes) < 2 * 40_000 / len(sizes)
    found = with_previous_in_ranges(rows, ["region"], "ts")
    assert found.filter("previous IS NULL").count() == 2 and found.filter("previous >= ts").count() == 0
    one = {r.region: r for r in quality.grid_regularity(rows).collect()}
    assert one["all"].rows == 39_200 and one["all"].irregular_steps == 39_199


def test_previous_rows_equal_a_plain_loop(spark):
    rng = random.Random(4)
    rows = sorted({(rng.choice("ab"), START + dt.timedelta(minutes=rng.randrange(5000))) for _ in range(300)})
    want = {(k, t): next((u for j, u in reversed(rows[:i]) if j == k), None) for i, (k, t) in enumerate(rows)}
    got = with_previous_in_ranges(spark.createDataFrame(rows, "k string, ts timestamp_ntz"), ["k"], "ts").collect()
    assert {(r.k, r.ts): r.previous for r in got} == want
