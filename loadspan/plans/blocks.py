"""Ordered computations over long series without one task per series.

``Window.partitionBy(region)`` puts a whole series in one task, and one region may hold a third
of all rows. These helpers cut the time axis into blocks of some days, so that a task sorts
``(key, block)`` groups of bounded length. Rows a neighbouring block needs travel there as a
halo; counts and last values that must cross blocks travel as one summary row per block.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from loadspan.session import shuffle_width

BLOCK_DAYS = 28


def block_id(ts: str | Column, days: float = BLOCK_DAYS) -> Column:
    """Number of the block of ``days`` days, or a part of one, counted from 1970."""
    minute = F.unix_date(F.to_date(ts)) * 1440 + F.hour(ts) * 60 + F.minute(ts)
    return F.floor(minute / F.lit(round(days * 1440)))


def with_halo(
    df: DataFrame,
    order: str,
    *,
    back: str | None = None,
    ahead: str | None = None,
    days: float = BLOCK_DAYS,
) -> DataFrame:
    """Copy each row to its own block and to the blocks whose reach covers it.

    ``back`` and ``ahead`` are interval texts such as ``"7 days"``: how far a row looks into
    the past and the future. Adds ``_block`` and ``_own``.
    """
    ts = F.col(order)
    first = block_id(ts - F.expr(f"INTERVAL {ahead}") if ahead else ts, days)
    last = block_id(ts + F.expr(f"INTERVAL {back}") if back else ts, days)
    return df.select("*", F.explode(F.sequence(first, last)).alias("_block")).withColumn(
        "_own", F.col("_block") == block_id(ts, days)
    )


def with_window_columns(
    df: DataFrame,
    keys: Sequence[str],
    order: str,
    columns: Callable[[WindowSpec], dict[str, Column]],
    *,
    back: str | None = None,
    ahead: str | None = None,
    days: float = BLOCK_DAYS,
    full_width: bool = False,
) -> DataFrame:
    """Add row-frame window columns with one shuffle on ``(keys, block)``.

    ``columns`` receives the window and returns the new columns; frames must not reach past
    ``back`` and ``ahead``. ``full_width`` keeps all shuffle partitions, for columns much larger
    than the rows they come from: adaptive coalescing sees only the rows.
    """
    window = Window.partitionBy(*keys, "_block").orderBy(order)
    rows = with_halo(df, order, back=back, ahead=ahead, days=days)
    if full_width:
        rows = rows.repartition(shuffle_width(df.sparkSession), *keys, "_block")
    return rows.withColumns(columns(window)).filter("_own").drop("_block", "_own")


def with_position(
    df: DataFrame, keys: Sequence[str], order: str, name: str = "idx", *,
    size: str | None = None, days: float = BLOCK_DAYS,
) -> DataFrame:
    """0-based position of each row in its series: position in the block + rows of earlier blocks.

    ``size`` also adds the length of the series, from the same summary of blocks.
    """
    blocked = df.withColumn("_block", block_id(order, days))
    series = Window.partitionBy(*keys)
    earlier = series.orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    columns = {"_before": F.coalesce(F.sum("_rows").over(earlier), F.lit(0))}
    if size:
        columns[size] = F.sum("_rows").over(series)
    offsets = (
        blocked.groupBy(*keys, "_block").agg(F.count(F.lit(1)).alias("_rows")).withColumns(columns).drop("_rows")
    )
    inside = Window.partitionBy(*keys, "_block").orderBy(order)
    return (
        blocked.join(offsets, [*keys, "_block"])
        .withColumn(name, (F.row_number().over(inside) - 1 + F.col("_before")).cast("bigint"))
        .drop("_block", "_before")
    )


def with_previous(
    df: DataFrame, keys: Sequence[str], order: str, name: str = "previous", *, days: float = BLOCK_DAYS
) -> DataFrame:
    """Order value of the row before, however far back it lies."""
    blocked = df.withColumn("_block", block_id(order, days))
    over_blocks = Window.partitionBy(*keys).orderBy("_block")
    carry = (
        blocked.groupBy(*keys, "_block")
        .agg(F.max(order).alias("_last"))
        .select(*keys, "_block", F.lag("_last").over(over_blocks).alias("_carry"))
    )
    inside = Window.partitionBy(*keys, "_block").orderBy(order)
    return (
        blocked.join(carry, [*keys, "_block"])
        .withColumn(name, F.coalesce(F.lag(order).over(inside), F.col("_carry")))
        .drop("_block", "_carry")
    )
