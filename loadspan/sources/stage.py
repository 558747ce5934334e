"""Intermediate tables in the shared folder."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

from loadspan.session import shared_dir


def staged(df: DataFrame, purpose: str) -> DataFrame:
    """Write a table several branches read, and read it back.

    Written files outlive lost executors and end the lineage; the branches then share one scan.
    """
    path = shared_dir(df.sparkSession, purpose)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


class Staging:
    """Stages tables when called, and names folders for what is written otherwise."""

    def __init__(self, purpose: str) -> None:
        self.purpose = purpose
        self.made: list[tuple[SparkSession, str]] = []

    def __call__(self, df: DataFrame) -> DataFrame:
        path = self.folder(df.sparkSession)
        df.write.parquet(path)
        return df.sparkSession.read.schema(df.schema).parquet(path)

    def folder(self, spark: SparkSession) -> str:
        path = shared_dir(spark, self.purpose)
        self.made.append((spark, path))
        return path

    def remove(self) -> None:
        for spark, path in self.made:
            place = spark._jvm.org.apache.hadoop.fs.Path(path)
            place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


@contextmanager
def staging(purpose: str) -> Iterator[Staging]:
    """Stage tables for a plan that ends inside the block; their folders are removed when it does.

    For plans that write their result in the block. A lazy result that leaves it needs :func:`staged`.
    """
    keep = Staging(purpose)
    try:
        yield keep
    finally:
        keep.remove()
