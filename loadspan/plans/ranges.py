"""Ordered computations over ranges of equal size: what lies dense in time is cut finer, whatever the key or the minute.

Rows are dealt by ranges of (keys, time), so that a part holds about equally many rows even if one key has nearly all of them in one
minute. A value that must cross parts travels as one row per part and key.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loadspan.session import shuffle_width
from loadspan.sources.stage import staged


def ranged(df: DataFrame, keys: Sequence[str], order: str) -> DataFrame:
    """Rows with ``_part``: the number of their range of (keys, order); rows equal in these are in one part.

    Written once, as the bounds of the ranges come from a sample and all who use the parts must see the same.
    """
    width = shuffle_width(df.sparkSession)
    return staged(df.repartitionByRange(width, *keys, order).withColumn("_part", F.spark_partition_id()), "ranges")


def carried(parts: DataFrame, keys: Sequence[str], last: Column, name: str) -> DataFrame:
    """(_part, keys, name): for every part and key the greatest ``last`` of the key's earlier parts."""
    ends = parts.groupBy("_part", *keys).agg(last.alias("_last"))
    earlier = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    return ends.select("_part", *keys, F.max("_last").over(earlier).alias(name))


def joined_parts(parts: DataFrame, carry: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows with the carry of their part and key; null keys are keys like any other."""
    other = carry.select(*[F.col(c).alias(f"_c_{c}") for c in ("_part", *keys)], *[c for c in carry.columns if c not in ("_part", *keys)])
    same = [parts["_part"] == F.col("_c__part"), *[parts[k].eqNullSafe(F.col(f"_c_{k}")) for k in keys]]
    return parts.join(other, same).drop(*[f"_c_{c}" for c in ("_part", *keys)])


def with_previous_in_ranges(df: DataFrame, keys: Sequence[str], order: str, name: str = "previous") -> DataFrame:
    """Order value of the row before, however far back it lies and however many rows a key has in a minute."""
    parts = ranged(df, keys, order)
    inside = Window.partitionBy("_part", *keys).orderBy(order)
    both = joined_parts(parts, carried(parts, keys, F.max(order), "_carry"), keys)
    return both.withColumn(name, F.coalesce(F.lag(order).over(inside), "_carry")).drop("_part", "_carry")


def asof_join(
    left: DataFrame, right: DataFrame, keys: Sequence[str], ts: str, values: Sequence[str], tolerance: str | None = None, found: str = "found_ts",
) -> DataFrame:
    """Each row of ``left`` with the newest row of ``right`` that has its keys and is not after it: its time as ``found``, and its ``values``.

    Times may be irregular on both sides. ``tolerance`` is an interval text; what is further back is not found. A row without a match keeps nulls, as does one
    with a null key or time. Of several rows of ``right`` with the same keys and time, the one with the greatest values counts. Column names of ``left``
    must differ from ``found`` and ``values``.

    Both sides are united and dealt by ranges of (keys, time); the last row known at the begin of a part comes from one row per part and
    key, so neither a key with a third of all rows nor a crowded minute ends in one task.
    """
    keys, values = list(keys), list(values)
    if clash := sorted({found, *values} & set(left.columns)):
        raise ValueError(f"columns of the left side: {', '.join(clash)}")
    known = right.na.drop("any", subset=[*keys, ts]).select(*keys, ts, F.struct(*[F.col(v) for v in values]).alias("_v")).groupBy(*keys, ts).agg(F.max("_v").alias("_v"))
    kept = F.struct(*[F.col(c) for c in left.columns])
    given = F.struct(F.col(ts).alias("at"), F.col("_v").alias("v"))
    rows = left.select(*keys, ts, F.lit(1).alias("_side"), kept.alias("_row"))
    both = known.select(*keys, ts, F.lit(0).alias("_side"), given.alias("_found")).unionByName(rows, allowMissingColumns=True)
    parts = ranged(both, keys, ts)
    # a row of the right side at the same time counts, so it comes first
    inside = Window.partitionBy("_part", *keys).orderBy(ts, "_side").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    carry = carried(parts, keys, F.max("_found"), "_carry")
    met = joined_parts(parts, carry, keys).withColumn("_hit", F.coalesce(F.last("_found", ignorenulls=True).over(inside), "_carry")).filter("_side = 1")
    near = F.col("_hit.at").isNotNull() & F.col(ts).isNotNull()
    if tolerance:
        near = near & (F.col("_hit.at") >= F.col(ts) - F.expr(f"INTERVAL {tolerance}"))
    return met.select("_row.*", F.when(near, F.col("_hit.at")).alias(found), *[F.when(near, F.col("_hit.v")[v]).alias(v) for v in values])
