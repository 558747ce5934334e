"""Joins and ranks that hold when one key has a third of all rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SALTS = 32


def salted_join(
    rows: DataFrame, per_key: DataFrame, keys: Sequence[str], spread: Sequence[str], how: str = "inner",
    salts: int = SALTS,
) -> DataFrame:
    """Join many rows per key with at most one row per key.

    Rows of a key are dealt over ``salts`` groups by the hash of the ``spread`` columns, and the
    row of the key is copied to each, so a hot key is joined by many tasks. A small ``per_key`` is
    still broadcast by the planner, which checks its size.
    """
    keys = list(keys)
    dealt = rows.withColumn("_salt", F.pmod(F.xxhash64(*spread), F.lit(salts)).cast("int"))
    copied = per_key.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return dealt.join(copied, [*keys, "_salt"], how).drop("_salt")


def with_global_rank(df: DataFrame, value: Column, name: str = "rank", bins: int = 256) -> DataFrame:
    """Rank over all rows, largest value first, equal values sharing a rank; a null value has a null rank.

    Equal values are counted first. The different values fall into bins between approximate quantiles, so an outlier
    does not leave all others in one bin; a value's rank is one more than the rows above it in its bin and in the bins before. At most
    ``bins`` counts meet in one task.
    """
    valued = df.withColumn("_v", value)
    counted = valued.filter(F.col("_v").isNotNull()).groupBy("_v").agg(F.count(F.lit(1)).alias("_n"))
    cuts = counted.agg(F.percentile_approx("_v", [i / bins for i in range(1, bins)] or [0.5], 10_000).alias("c")).scalar()
    binned = counted.withColumn("_cuts", cuts).withColumn(
        "_bin", F.size(F.filter("_cuts", lambda c: c > F.col("_v")))
    ).drop("_cuts")
    earlier = Window.orderBy("_bin").rowsBetween(Window.unboundedPreceding, -1)
    before = binned.groupBy("_bin").agg(F.sum("_n").alias("_all")).select(
        "_bin", F.coalesce(F.sum("_all").over(earlier), F.lit(0)).alias("_before")
    )
    above = Window.partitionBy("_bin").orderBy(F.col("_v").desc()).rowsBetween(Window.unboundedPreceding, -1)
    ranked = binned.join(before, "_bin").select(
        "_v", (F.coalesce(F.sum("_n").over(above), F.lit(0)) + F.col("_before") + 1).cast("int").alias(name)
    )
    return salted_join(valued, ranked, ["_v"], df.columns, "left").drop("_v")
