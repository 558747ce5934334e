"""Queries that run a stream over the event files to their end."""

from __future__ import annotations

import time

from pyspark.sql import functions as F

from loadspan.config import SLOTS_PER_WEEK
from loadspan.operators import anomaly as an
from loadspan.operators import forecast as fc
from loadspan.operators.stats import weather_average
from loadspan.queries import inputs as src
from loadspan.queries.anomalies import THRESHOLDS
from loadspan.queries.inputs import rounded
from loadspan.queries.registry import query
from loadspan.queries.sqlbase import sql
from loadspan.session import shared_dir
from loadspan.sources import increments, snapshot
from loadspan.sources.stage import staged
from loadspan.streaming import jobs, state

# The stream emits an interval when the newest row is half an hour past its end.
CLOSED = """closed AS (SELECT o.*, o.ts + INTERVAL 15 MINUTE <= (SELECT max(ts) - INTERVAL 30 MINUTE FROM events) AS closed FROM observed o)"""


def events(spark, d):
    return jobs.event_stream(spark, d, "events.parquet")


def finished(spark, stream, purpose):
    """Run a stream over all that is there and return the table it wrote and the query."""
    path = shared_dir(spark, purpose)
    running = jobs.start_table(stream, f"{path}/table", f"{path}/checkpoint")
    running.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{path}/table"), running


@query("stream_load_15min", sql("SELECT region, ts, load, closed FROM closed", "observed", extra=CLOSED))
def stream_load_15min(spark, d):
    """Intervals the stream has emitted, and those it still holds."""
    emitted = finished(spark, jobs.stream_load(events(spark, d)), "stream-load")[0].withColumn("closed", F.lit(True))
    return emitted.unionByName(jobs.open_windows(src.events(spark, d)).withColumn("closed", F.lit(False)))


@query("stream_anomaly", sql("""SELECT region, ts, load, z AS z_score, CASE WHEN z > 3 THEN 'high' ELSE 'medium' END AS severity FROM (
    SELECT c.region, c.ts, c.load, round(abs((c.load - s.mean) / s.std), 6) AS z FROM closed c JOIN stats s ON s.region = c.region WHERE closed) q
    WHERE z > 2.5""", "observed", "stats", extra=CLOSED))
def stream_anomaly(spark, d):
    """Closed intervals that stand out from the trailing week, whose statistics each batch reads anew."""
    path = shared_dir(spark, "stream-anomaly")
    running = jobs.start_anomalies(
        jobs.stream_load(events(spark, d)), lambda: src.recent(spark, d), f"{path}/table", f"{path}/checkpoint", every=None,
    )
    running.awaitTermination()
    return spark.read.schema("region STRING, ts TIMESTAMP_NTZ, load DOUBLE, z_score DOUBLE, severity STRING").parquet(f"{path}/table/*")


def documents(spark, d, latest):
    """Snapshot of the newest closed intervals: seasonal-naive paths with intervals, findings of the rules, weather means."""
    fortnight = staged(src.two_weeks(spark, d), "fortnight")
    end = latest.agg(F.max("ts").alias("v")).scalar()
    past = fortnight.filter(F.col("ts") <= end)
    week = past.filter(F.col("ts") > end - F.expr("INTERVAL 7 DAYS"))
    path = staged(fc.prediction_interval(fc.seasonal_naive(week, end)), "path")
    found = an.all_rules(week, fc.path_anchor(path).withColumn("origin", end), path, end, THRESHOLDS, "latest")
    return snapshot.build_snapshot(latest.select("region", "load"), path, found, weather_average(src.latest_weather(spark, d)), timestamp=end)


@query("stream_snapshot", sql("""SELECT c.region, round(coalesce(n.load, 0.0) + 1e-9, 6) AS current_load, round(p.load + 1e-9, 6) AS point_24h, strftime(h.hi2, '%Y-%m-%dT%H:%M:%S') AS timestamp
    FROM (SELECT DISTINCT region FROM closed WHERE closed) c
    CROSS JOIN (SELECT max(ts) AS hi2 FROM closed WHERE closed) h
    LEFT JOIN closed n ON n.region = c.region AND n.ts = h.hi2
    LEFT JOIN load p ON p.region = c.region AND p.ts = h.hi2 + INTERVAL 24 HOUR - INTERVAL 7 DAY""", "observed", "load", extra=CLOSED))
def stream_snapshot(spark, d):
    """The current snapshot after the stream has read everything: the load at the newest closed interval and the forecast of a day of every region."""
    path = shared_dir(spark, "stream-snapshot")
    running = state.start_documents(
        jobs.stream_load(events(spark, d)), lambda latest: documents(spark, d, latest), f"{path}/out", f"{path}/checkpoint", every=None,
    )
    running.awaitTermination()
    found = snapshot.read_snapshot(spark, f"{path}/out", region_pattern="^[a-z_0-9]+$")
    one = found.select(F.explode("current_load").alias("region", "current_load"), "predictions", "timestamp")
    return rounded(one.select("region", "current_load", F.col("predictions")[F.col("region")]["24h"].alias("point_24h"), "timestamp"))


@query("stream_late_rows", """SELECT CAST(count(*) AS BIGINT) AS rows_read, count(*) FILTER (WHERE ts < mid) > 0 AS any_dropped, CAST(3 AS BIGINT) AS files_read
    FROM events CROSS JOIN (SELECT date_trunc('day', min(ts)) + (date_trunc('day', max(ts)) - date_trunc('day', min(ts))) / 2 AS mid FROM events) m""")
def stream_late_rows(spark, d):
    """The newer half of the events is read first, so that the older half comes too late: rows read, and whether any were dropped."""
    given = src.events(spark, d)
    mid = middle(spark, d)
    path = shared_dir(spark, "stream-late")
    newer, even = F.col("ts") >= mid, F.col("event_id") % 2 == 0
    log = jobs.ProgressLog(spark, f"{path}/progress")
    spark.streams.addListener(log)
    try:
        # a batch drops what was late before the batch ahead of it, so two parts of the newer half come first; each part is a batch of its own
        for i, part in enumerate((newer & even, newer & ~even, ~newer)):
            given.filter(part).write.parquet(f"{path}/in/part={i}")
            stream = jobs.stream_load(jobs.event_stream(spark, f"{path}/in"))
            running = jobs.start_table(stream, f"{path}/table", f"{path}/checkpoint")
            running.awaitTermination()
        spark._jsparkSession.sparkContext().listenerBus().waitUntilEmpty()
        time.sleep(1)
    finally:
        spark.streams.removeListener(log)
    return log.table(running).agg(
        F.sum("rows_read").alias("rows_read"), (F.sum("rows_dropped") > 0).alias("any_dropped"),
        F.count_if(F.col("rows_read") > 0).alias("files_read"),
    )


def middle(spark, d):
    axis = src.axis(spark, d)
    return axis.lo + (F.date_trunc("day", axis.hi) - axis.lo) / 2


MIDDLE = "(SELECT date_trunc('day', min(ts)) + (date_trunc('day', max(ts)) - date_trunc('day', min(ts))) / 2 AS mid FROM events)"


@query("late_rows_merged", sql(f"""SELECT o.region, o.ts, round(o.load + 1e-9, 6) AS load, n.late_rows FROM observed o JOIN (
    SELECT event_type AS region, time_bucket(INTERVAL 15 MINUTE, ts) AS ts, count(*) FILTER (WHERE ts < mid) AS late_rows
    FROM events CROSS JOIN {MIDDLE} m GROUP BY 1, 2) n ON n.region = o.region AND n.ts = o.ts""", "observed"))
def late_rows_merged(spark, d):
    """The newer half of the events is read first; the older half comes late, is listed as such, and still reaches the days it belongs to."""
    given, mid = src.events(spark, d), middle(spark, d)
    path = shared_dir(spark, "stream-merge")
    for i, part in enumerate((F.col("ts") >= mid, F.col("ts") < mid)):
        given.filter(part).write.parquet(f"{path}/in/part={i}")
        state.start_series(jobs.event_stream(spark, f"{path}/in"), f"{path}/series", f"{path}/late", f"{path}/checkpoint", every=None).awaitTermination()
    late = spark.read.schema(increments.EVENT_DDL).parquet(f"{path}/late/*")
    counted = increments.partial_sums(late).select("region", "ts", F.col("events").alias("late_rows"))
    sums = increments.open_series(spark, f"{path}/series").read()
    return rounded(sums.join(counted, ["region", "ts"], "left").select("region", "ts", "load", F.coalesce("late_rows", F.lit(0)).cast("bigint").alias("late_rows")))


@query("stream_anomaly_tiles", sql("""SELECT region, ts, load, z AS z_score, CASE WHEN z > 3 THEN 'high' ELSE 'medium' END AS severity FROM (
    SELECT c.region, c.ts, c.load, round(abs((c.load - s.mean) / s.std), 6) AS z FROM closed c JOIN (
        SELECT l.region, avg(l.load) AS mean, CASE WHEN stddev_samp(l.load) > 0 THEN stddev_samp(l.load) ELSE 1e-6 END AS std
        FROM load l CROSS JOIN (SELECT max(ts) AS t FROM closed WHERE closed) h WHERE l.ts > h.t - INTERVAL 7 DAY AND l.ts <= h.t GROUP BY l.region) s
    ON s.region = c.region WHERE closed) q WHERE z > 2.5""", "observed", "load", extra=CLOSED))
def stream_anomaly_tiles(spark, d):
    """Closed intervals that stand out from the week up to the newest one, whose statistics come from a tile per region and day."""
    path = shared_dir(spark, "stream-tiles")
    state.start_tiled_anomalies(
        jobs.stream_load(events(spark, d)), f"{path}/tiles", f"{path}/table", f"{path}/checkpoint", every=None,
    ).awaitTermination()
    found = spark.read.schema("region STRING, ts TIMESTAMP_NTZ, load DOUBLE, z_score DOUBLE, severity STRING").parquet(f"{path}/table/*")
    return rounded(found)


@query("incremental_series", sql("SELECT l.region, l.ts, round(l.load + 1e-9, 6) AS load, round(temperature + 1e-9, 6) AS temperature, humidity, round(solar_irradiance + 1e-9, 6) AS solar_irradiance "
    "FROM load l JOIN weather w ON w.region = l.region AND w.ts = l.ts", "load", "weather"))
def incremental_series(spark, d):
    """The series from files that arrive one after the other; every run reads only the new ones and rewrites only their days."""
    given = src.events(spark, d)
    path = shared_dir(spark, "increments")
    store = increments.open_series(spark, f"{path}/series")
    for i in range(3):
        given.filter(F.col("event_id") % 3 == i).write.parquet(f"{path}/in/part={i}")
        increments.take_in(store, f"{path}/in")
    return rounded(increments.series_of(store))


@query("incremental_week", sql("SELECT region, ts, round(load + 1e-9, 6) AS load FROM recent", "recent"))
def incremental_week(spark, d):
    """The trailing week of a series kept up to date: names, axis and days come from beside it, so no pass over the whole table."""
    path = shared_dir(spark, "increments")
    store = increments.open_series(spark, f"{path}/series")
    increments.take_in(store, d, "events.parquet")
    return rounded(increments.series_of(store, SLOTS_PER_WEEK).select("region", "ts", "load"))
