"""Output folders of which readers see one complete version: the newest that has been finished."""

from __future__ import annotations

import time
import uuid

from pyspark.sql import DataFrame, SparkSession

DONE = "_SUCCESS"


def _folder(spark: SparkSession, path: str):
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()), place


def versions(spark: SparkSession, path: str, mark: str = DONE) -> list[str]:
    """Paths of the finished versions, oldest first. One without the mark of its committer was not finished."""
    files, place = _folder(spark, path)
    if not files.exists(place):
        return []
    found = [s.getPath() for s in files.listStatus(place) if s.isDirectory() and s.getPath().getName().startswith("version=")]
    done = [p for p in found if files.exists(spark._jvm.org.apache.hadoop.fs.Path(p, mark))]
    return [p.toString() for p in sorted(done, key=lambda p: p.getName())]


def newest(spark: SparkSession, path: str) -> str | None:
    """Path of the newest finished version, or None."""
    found = versions(spark, path)
    return found[-1] if found else None


def batch_name(batch: int) -> str:
    """Name of the version of a batch; names of later batches sort behind it."""
    return f"version=batch-{batch:012d}"


def version_of_batch(spark: SparkSession, path: str, batch: int) -> str | None:
    """Path of the finished version of a batch, or None."""
    return next((v for v in versions(spark, path) if v.endswith("/" + batch_name(batch))), None)


def finished_batches(spark: SparkSession, path: str) -> list[int]:
    """Numbers of the finished ``batch=`` folders of a path, in order."""
    files, place = _folder(spark, path)
    if not files.exists(place):
        return []
    hadoop = spark._jvm.org.apache.hadoop.fs.Path
    found = [s.getPath() for s in files.listStatus(place) if s.getPath().getName().startswith("batch=")]
    return sorted(int(p.getName().split("=")[1]) for p in found if files.exists(hadoop(p, DONE)))


def remove(spark: SparkSession, paths: list[str]) -> None:
    for path in paths:
        files, place = _folder(spark, path)
        files.delete(place, True)


def new_version(path: str) -> str:
    """Path of a new version, behind all others in order."""
    return f"{path.rstrip('/')}/version={time.time_ns():020d}-{uuid.uuid4().hex[:8]}"


def write_version(df: DataFrame, path: str, kind: str = "json", keep: int = 2, batch: int | None = None) -> str:
    """Write a new version beside the others as ``kind`` (json, text or parquet), then remove all but the newest ``keep``.

    Nothing that a reader may have open is overwritten: a reader sees the version before until the new one is finished,
    and a writer that dies leaves that one current. The version before is kept for readers that have begun. With ``batch``, the version bears its
    number, and what an unfinished write of that batch has left is replaced.
    """
    spark = df.sparkSession
    made = new_version(path) if batch is None else f"{path.rstrip('/')}/{batch_name(batch)}"
    writer = df.write.mode("errorifexists" if batch is None else "overwrite")
    getattr(writer, kind)(made)
    remove(spark, versions(spark, path)[:-keep])
    return made
