"""The series kept up to date from files: what a run reads and rewrites, and what a writer that dies leaves."""

import datetime as dt
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from loadspan.sources import increments, tables
from loadspan.sources.daystore import DayStore

START = dt.datetime(2024, 1, 1)


def put(spark, folder, name, rows):
    given = [(i, START + dt.timedelta(minutes=m), 1, region, float(v), '{"k": %d}' % k) for i, (m, region, v, k) in enumerate(rows)]
    spark.createDataFrame(given, increments.EVENT_DDL).coalesce(1).write.parquet(f"{folder}/{name}")


def written(path):
    return {f.relative_to(path): f.stat().st_mtime_ns for f in Path(path).rglob("*.parquet")}


def test_a_run_reads_new_files_and_rewrites_their_days(spark, tmp_path):
    folder, store = f"{tmp_path}/in", increments.open_series(spark, f"{tmp_path}/s")
    day = 24 * 60
    put(spark, folder, "one", [(0, "a", 1, 5), (day + 3, "b", 2, 6), (2 * day, "a", 3, 7)])
    assert len(increments.take_in(store, folder)) == 1
    before = written(f"{tmp_path}/s/days")
    put(spark, folder, "two", [(day + 5, "b", 10, 8), (3 * day, "c", 4, 9)])
    taken = increments.take_in(store, folder)
    assert len(taken) == 1 and "/two/" in taken[0]
    assert increments.take_in(store, folder) == [] and len(store.batches()) == 2
    after = written(f"{tmp_path}/s/days")
    changed = {str(f).split("/")[0] for f in after if after[f] != before.get(f)}
    assert changed == {"day=2024-01-02", "day=2024-01-04"}
    assert all(after[f] == t for f, t in before.items())
    rows = {(r.region, r.ts): r for r in store.read().collect()}
    assert rows["b", START + dt.timedelta(days=1)].load == 12 and rows["b", START + dt.timedelta(days=1)].events == 2 and len(rows) == 4
    assert {r.region for r in store.regions().collect()} == {"a", "b", "c"}
    axis = increments.axis_of(store)
    assert (axis.first, axis.newest) == (START.date(), START + dt.timedelta(days=3))


def test_the_series_is_that_of_all_events(spark, tmp_path):
    folder, store = f"{tmp_path}/in", increments.open_series(spark, f"{tmp_path}/s")
    rows = [(i * 37 % 5000, "abc"[i % 3], i % 11, i % 7) for i in range(400)]
    for k in range(4):
        put(spark, folder, f"part{k}", rows[k::4])
        increments.take_in(store, folder)
    events = spark.read.schema(increments.EVENT_DDL).parquet(f"{folder}/*")
    want = tables.series_table(events, tables.read_axis(events))
    key = lambda r: (r.region, r.ts)
    got = sorted(increments.series_of(store).collect(), key=key)
    plain = lambda r: tuple(round(v, 6) if isinstance(v, float) else v for v in r)
    assert list(map(plain, got)) == list(map(plain, sorted(want.select(*got[0].__fields__).collect(), key=key)))
    trailing = increments.series_of(store, 100)
    assert sorted(trailing.collect(), key=key) == sorted((r for r in got if r.ts > got[-1].ts - dt.timedelta(minutes=1500)), key=key)
    days = {f.split("day=")[1][:10] for f in trailing.inputFiles() if "day=" in f}
    assert days <= {"2024-01-03", "2024-01-04"}


def test_a_writer_that_dies_before_the_commit_changes_nothing(spark, tmp_path, monkeypatch):
    store = increments.open_series(spark, f"{tmp_path}/s")
    put(spark, f"{tmp_path}/in", "one", [(0, "a", 1, 5)])
    increments.take_in(store, f"{tmp_path}/in")
    put(spark, f"{tmp_path}/in", "two", [(1, "a", 10, 5), (2000, "b", 1, 1)])
    with monkeypatch.context() as m:
        m.setattr(DayStore, "regions", lambda self: 1 / 0)
        with pytest.raises(ZeroDivisionError):
            increments.take_in(store, f"{tmp_path}/in")
    assert [r.load for r in store.read().collect()] == [1] and store.batches() == [0]
    increments.take_in(store, f"{tmp_path}/in")
    assert sorted((r.region, r.load) for r in increments.open_series(spark, f"{tmp_path}/s").read().collect()) == [("a", 11), ("b", 1)]
    for k in range(3):
        put(spark, f"{tmp_path}/in", f"more{k}", [(2, "a", 1, 1)])
        increments.take_in(store, f"{tmp_path}/in")
    assert store.read().agg(F.sum("load")).first()[0] == 15
    assert len(list(Path(f"{tmp_path}/s/days/day=2024-01-01").glob("batch=*"))) == 2


def test_an_empty_folder_and_rows_without_a_name(spark, tmp_path):
    store = increments.open_series(spark, f"{tmp_path}/s")
    with pytest.raises(ValueError):
        increments.axis_of(store)
    assert store.read().count() == 0 and store.regions().count() == 0
    put(spark, f"{tmp_path}/in", "one", [(0, None, 1, 5), (5, "a", 2, 5)])
    increments.take_in(store, f"{tmp_path}/in")
    assert [(r.region, r.load) for r in store.read().collect()] == [("a", 2)]
    assert increments.add_events(store, spark.createDataFrame([], increments.EVENT_DDL), 7) == [] and store.batches() == [0, 7]
