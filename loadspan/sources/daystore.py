"""A table in folders of days that grows batch by batch: only the days of a batch are rewritten, and a batch counts once."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field
from datetime import date, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from loadspan.sources.versions import _folder, remove

COMMIT_DDL = "day DATE, file STRING, newest TIMESTAMP_NTZ"


@dataclass
class DayStore:
    """Rows of ``schema`` (with ``region`` and ``ts``) below ``path``.

    ``days/day=D/batch=B`` has a day's rows as of batch B, ``regions/batch=B`` all names known then, and ``commits/batch=B`` which days the
    batch rewrote, which files it took in and its newest time (``rows`` are read twice, so callers stage them). The commit is written last: without it none of the batch's folders is ever
    read, so a writer that dies changes nothing and can do the batch again. A day is read from its newest committed batch. The driver knows a row
    for each day and each file. One writer at a time.
    """

    spark: SparkSession
    path: str
    schema: str
    _known: list | None = field(default=None, repr=False)

    def batches(self) -> list[int]:
        files, place = _folder(self.spark, f"{self.path}/commits")
        if not files.exists(place):
            return []
        hadoop = self.spark._jvm.org.apache.hadoop.fs.Path
        found = [s.getPath() for s in files.listStatus(place) if s.isDirectory()]
        return sorted(int(p.getName().split("=")[1]) for p in found if files.exists(hadoop(p, "_SUCCESS")))

    def commits(self) -> list:
        """(batch, day, file, newest) of all commits."""
        if self._known is None:
            paths = [f"{self.path}/commits/batch={b:012d}" for b in self.batches()]
            rows = [] if not paths else self.spark.read.schema(COMMIT_DDL).option("basePath", f"{self.path}/commits").parquet(*paths).select(
                F.regexp_extract(F.input_file_name(), r"batch=(\d+)", 1).cast("bigint").alias("batch"), "day", "file", "newest").collect()
            self._known = sorted(rows, key=lambda r: r.batch)
        return self._known

    def files(self) -> set[str]:
        return {r.file for r in self.commits() if r.file is not None}

    def current(self) -> dict[date, int]:
        """The batch that each day is read from."""
        return {r.day: r.batch for r in self.commits() if r.day is not None}

    def newest(self) -> datetime | None:
        return max((r.newest for r in self.commits() if r.newest is not None), default=None)

    def regions(self) -> DataFrame:
        done = self.batches()
        if not done:
            return self.spark.createDataFrame([], "region string")
        return self.spark.read.schema("region string").parquet(f"{self.path}/regions/batch={done[-1]:012d}")

    def read(self, first: date | None = None, last: date | None = None, days: Sequence[date] | None = None) -> DataFrame:
        """Rows of the days asked for, from no other folders."""
        wanted = {
            d: b for d, b in self.current().items()
            if (first is None or d >= first) and (last is None or d <= last) and (days is None or d in days)
        }
        if not wanted:
            return self.spark.createDataFrame([], StructType.fromDDL(self.schema))
        paths = [f"{self.path}/days/day={d.isoformat()}/batch={b:012d}" for d, b in sorted(wanted.items())]
        return self.spark.read.schema(self.schema).parquet(*paths)

    def replace_days(self, rows: DataFrame, batch: int, files: Sequence[str] = (), seen: datetime | None = None) -> None:
        """Make ``rows`` (of whole days) the rows of their days and commit ``batch``; a batch that is committed is left as it is."""
        if batch in self.batches():
            return
        names = [f.name for f in StructType.fromDDL(self.schema).fields]
        dated = rows.select(*names, F.to_date("ts").alias("day"), F.lit(f"{batch:012d}").alias("batch"))
        days = [r.day for r in dated.select("day").distinct().collect()]
        # ranges by day and region: a day lies in few files, one with many rows in several
        dated.repartitionByRange("day", "region", "ts").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(
            "day", "batch").parquet(f"{self.path}/days")
        paths = [f"{self.path}/days/day={d.isoformat()}/batch={batch:012d}" for d in days]
        made = self.spark.read.schema(self.schema).parquet(*paths) if paths else dated
        before = self.current()
        known = self.regions().union(made.select("region")).distinct()
        known.coalesce(1).write.mode("overwrite").parquet(f"{self.path}/regions/batch={batch:012d}")
        newest = made.agg(F.max("ts").alias("v")).first().v
        newest = max((t for t in (newest, seen) if t is not None), default=None)
        log = [(d, None, None) for d in days] + [(None, f, None) for f in files] + [(None, None, newest)]
        self.spark.createDataFrame(log, COMMIT_DDL).coalesce(1).write.mode("overwrite").parquet(f"{self.path}/commits/batch={batch:012d}")
        self._known = None
        self._forget({d: before[d] for d in days if d in before})

    def _forget(self, replaced: dict[date, int]) -> None:
        """Remove a day's folders before the one just replaced, which a reader may have open."""
        for day, kept in replaced.items():
            files, place = _folder(self.spark, f"{self.path}/days/day={day.isoformat()}")
            old = [s.getPath() for s in files.listStatus(place) if int(s.getPath().getName().split("=")[1]) < kept]
            remove(self.spark, [p.toString() for p in old])
