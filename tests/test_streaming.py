import datetime as dt
import random
import time

import pytest
from pyspark.sql import functions as F

from loadspan.operators.stats import region_stats
from loadspan.sources import increments, tables, versions
from loadspan.sources.tables import observed_load
from loadspan.streaming import jobs, state

START = dt.datetime(2024, 1, 1)


def event(i, minutes, region="a", value=1.0):
    return (i, START + dt.timedelta(minutes=minutes), 1, region, float(value), "{}")


def put(spark, folder, rows, name):
    spark.createDataFrame(rows, jobs.EVENT_DDL).coalesce(1).write.mode("append").parquet(f"{folder}/{name}")
    for file in (folder / name).glob("*.parquet"):
        file.rename(folder / f"{name}.parquet")


@pytest.fixture
def folder(tmp_path):
    path = tmp_path / "in"
    path.mkdir()
    return path


def run(spark, stream, out):
    query = jobs.start_table(stream, f"{out}/t", f"{out}/c")
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{out}/t"), query


def test_stream_equals_batch_on_closed_intervals(spark, folder, tmp_path):
    rows = [event(i, i * 3, "ab"[i % 2], i) for i in range(200)]
    put(spark, folder, rows, "one")
    got, _ = run(spark, jobs.stream_load(jobs.event_stream(spark, str(folder))), tmp_path)
    batch = {(r.region, r.ts): r.load for r in observed_load(spark.read.parquet(str(folder / "one.parquet"))).collect()}
    streamed = {(r.region, r.ts): r.load for r in got.collect()}
    closed = max(r[1] for r in rows) - dt.timedelta(minutes=30)
    assert streamed == {k: v for k, v in batch.items() if k[1] + dt.timedelta(minutes=15) <= closed}
    assert len(streamed) > 60


def test_late_rows_are_dropped_and_counted(spark, folder, tmp_path):
    put(spark, folder, [event(1, 0), event(2, 100)], "b1")
    stream = jobs.stream_load(jobs.event_stream(spark, str(folder)))
    run(spark, stream, tmp_path)
    put(spark, folder, [event(3, 1), event(4, 90), event(5, 200)], "b2")
    log = jobs.ProgressLog(spark, f"{tmp_path}/p")
    spark.streams.addListener(log)
    try:
        got, query = run(spark, stream, tmp_path)
        spark._jsparkSession.sparkContext().listenerBus().waitUntilEmpty()
        time.sleep(1)
    finally:
        spark.streams.removeListener(log)
    # 0 closed in the first run without the late row; 90 and 100 closed in the second
    assert {r.ts.hour * 60 + r.ts.minute: r.load for r in got.collect()} == {0: 1, 90: 2}
    assert log.table(query).agg(F.sum("rows_dropped").alias("n")).first().n == 1


def test_stream_anomaly_scores_against_a_batch_table(spark, folder, tmp_path, hours):
    stats = region_stats(hours({"a": [9.0, 10.0, 11.0]}))
    put(spark, folder, [event(1, 0, value=10), event(2, 15, value=50), event(3, 300)], "one")
    got, _ = run(spark, jobs.stream_anomaly(jobs.event_stream(spark, str(folder)), stats), tmp_path)
    assert [(r.load, r.z_score, r.severity) for r in got.collect()] == [(50, 40, "high")]


def states(spark, path):
    return sorted(tuple(r) for r in spark.read.json(versions.newest(spark, path)).select("region", "load").collect())


def test_a_silent_region_stays_in_the_snapshot_with_load_0(spark, folder, tmp_path):
    stream, path = jobs.stream_load(jobs.event_stream(spark, str(folder))), f"{tmp_path}/s"

    def batch(rows, name):
        put(spark, folder, rows, name)
        state.start_documents(stream, lambda rows: rows, path, f"{tmp_path}/c", every=None).awaitTermination()
        return states(spark, path)

    both = [event(i, i * 10, "ab"[i % 2], value=i) for i in range(12)]
    first = batch(both, "b1")
    assert {r for r, _ in first} == {"a", "b"} and any(v > 0 for _, v in first)
    assert batch([event(100 + i, 300 + i * 10, "a", value=7) for i in range(12)], "b2") == [("a", 14.0), ("b", 0.0)]
    assert [r for r, _ in batch([event(200 + i, 600 + i * 10, "c", value=1) for i in range(12)], "b3")] == ["a", "b", "c"]


def test_a_repeated_batch_gives_one_version_and_the_same_state(spark, tmp_path, hours):
    path, built = f"{tmp_path}/s", []
    write = state.document_writer(lambda rows: built.append(1) or rows, path)
    write(hours({"a": [1, 2], "b": [3]}), 0)
    write(hours({"a": [5, 6, 7, 8]}), 1)
    write(hours({"a": [5, 6, 7, 8]}), 1)
    assert len(versions.versions(spark, path)) == 2 and len(built) == 2
    assert states(spark, path) == [("a", 8.0), ("b", 0.0)]
    # a writer that died after the state makes both again
    versions.remove(spark, [versions.version_of_batch(spark, path, 1)])
    write(hours({"a": [5, 6, 7, 8]}), 1)
    assert states(spark, path) == [("a", 8.0), ("b", 0.0)] and len(versions.versions(spark, path)) == 2
    write(hours({"a": []}).filter("false"), 2)
    assert len(versions.versions(spark, path)) == 2


@pytest.mark.parametrize("rows", [672, 100, 3])
def test_tiles_give_the_statistics_of_the_series(spark, tmp_path, rows):
    rng = random.Random(rows)
    given = [(r, START + dt.timedelta(minutes=15 * i), rng.random() * 50) for i in range(96 * 9 + 37) for r in "abc" if rng.random() < 0.7]
    given += [("old", START, 3.0)]
    store = state.open_tiles(spark, f"{tmp_path}/t")
    frame = spark.createDataFrame(given, "region string, ts timestamp_ntz, load double")
    cut = START + dt.timedelta(days=4, hours=5)
    for k, part in enumerate((F.col("ts") <= cut, F.col("ts") > cut)):
        state.add_tiles(store, frame.filter(part), k)
        state.add_tiles(store, frame.filter(part), k)
    axis = tables.Axis(START.date(), max(t for _, t, _ in given))
    names = frame.select("region").distinct()
    week = tables.dense_grid(frame, names, axis.back(rows), axis.hi, ["load"])
    want = {r.region: (r.mean, r.std) for r in region_stats(week).collect()}
    got = {r.region: (r.mean, r.std) for r in state.tile_stats(store, rows=rows).collect()}
    assert got.keys() == want.keys()
    assert all(got[r] == pytest.approx(want[r], rel=1e-9, abs=1e-12) for r in want)
    days = state.tile_stats(store, rows=rows).inputFiles()
    assert len({f.split("day=")[1][:10] for f in days if "day=" in f}) <= rows // 96 + 2


def test_tiled_anomalies_of_two_batches(spark, folder, tmp_path):
    stream = jobs.stream_load(jobs.event_stream(spark, str(folder)))
    out = (f"{tmp_path}/tiles", f"{tmp_path}/found", f"{tmp_path}/c")
    for name, start, value in (("b1", 0, 5), ("b2", 600, 5)):
        rows = [event(i, start + i * 15, value=value + i % 2) for i in range(30)]
        put(spark, folder, [*rows, event(99, start + 450, value=400 if start else 5)] + [event(100, start + 520)], name)
        state.start_tiled_anomalies(stream, *out, every=None, rows=40).awaitTermination()
    found = spark.read.schema("region STRING, ts TIMESTAMP_NTZ, load DOUBLE, z_score DOUBLE, severity STRING").parquet(f"{out[1]}/*").collect()
    assert [(r.load, r.severity) for r in found] == [(400, "high")]


def test_late_rows_reach_their_day_and_are_listed(spark, folder, tmp_path):
    stream = jobs.event_stream(spark, str(folder))
    out = (f"{tmp_path}/series", f"{tmp_path}/late", f"{tmp_path}/c")
    first = [event(i, i * 20, "ab"[i % 2], i) for i in range(100)]
    second = [event(500, 5, "a", 9), event(501, 1979, "b", 8), event(502, 1900, "c", 7), event(503, 4000, "a", 6)]
    for name, rows in (("b1", first), ("b2", second)):
        put(spark, folder, rows, name)
        state.start_series(stream, *out, every=None).awaitTermination()
    assert sorted(r.event_id for r in spark.read.parquet(f"{out[1]}/*").collect()) == [500, 502]
    store = increments.open_series(spark, out[0])
    want = observed_load(spark.read.parquet(str(folder / "*.parquet"))).collect()
    assert sorted((r.region, r.ts, r.load) for r in store.read().collect()) == sorted((r.region, r.ts, r.load) for r in want)
    # a repeated batch adds nothing
    state.series_writer(spark, *out[:2])(spark.createDataFrame(second, increments.EVENT_DDL), store.batches()[-1])
    assert store.read().agg(F.sum("events")).first()[0] == 104


def test_statistics_are_read_anew_for_each_batch(spark, folder, tmp_path, hours):
    put(spark, folder, [event(1, 0, value=10), event(2, 15, value=50), event(3, 300)], "b1")
    weeks = [hours({"a": [9.0, 10.0, 11.0]}), hours({"a": [1.0, 500.0]})]
    asked = []

    def week():
        asked.append(1)
        return weeks[0] if len(asked) < 3 else weeks[1]

    stream = jobs.stream_load(jobs.event_stream(spark, str(folder)))
    out = (f"{tmp_path}/t", f"{tmp_path}/c")
    jobs.start_anomalies(stream, week, *out, every=None).awaitTermination()
    put(spark, folder, [event(4, 301, value=50), event(5, 600)], "b2")
    jobs.start_anomalies(stream, week, *out, every=None).awaitTermination()
    found = spark.read.schema("region STRING, ts TIMESTAMP_NTZ, load DOUBLE, z_score DOUBLE, severity STRING").parquet(f"{out[0]}/*")
    assert [(r.load, r.z_score) for r in found.collect()] == [(50, 40)] and len(asked) > 2


def test_progress_of_all_batches_is_kept(spark, folder, tmp_path):
    for i in range(3):
        put(spark, folder, [event(i, i * 100)], f"b{i}")
    log = jobs.ProgressLog(spark, f"{tmp_path}/p")
    spark.streams.addListener(log)
    try:
        stream = jobs.stream_load(jobs.event_stream(spark, str(folder), files_per_batch=1))
        _, query = run(spark, stream, tmp_path)
        spark._jsparkSession.sparkContext().listenerBus().waitUntilEmpty()
        time.sleep(1)
    finally:
        spark.streams.removeListener(log)
    assert log.table(query).agg(F.sum("rows_read").alias("n")).first().n == 3


def test_open_windows_are_what_the_stream_has_not_emitted(spark, folder, tmp_path):
    rows = [event(i, i * 3, "ab"[i % 2], i) for i in range(100)]
    put(spark, folder, rows, "one")
    got, _ = run(spark, jobs.stream_load(jobs.event_stream(spark, str(folder))), tmp_path)
    given = spark.read.parquet(str(folder / "one.parquet"))
    both = got.unionByName(jobs.open_windows(given))
    assert sorted(both.collect()) == sorted(observed_load(given).select("region", "ts", "load").collect())
