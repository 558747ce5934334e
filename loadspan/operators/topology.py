"""Network tables: load bands, stress points, capacity, edges between known nodes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loadspan.functions.time import as_col


def load_band(load: str | Column, high: float = 500, medium: float = 300) -> Column:
    value = as_col(load)
    return F.when(value > high, "red").when(value > medium, "orange").otherwise("green")


def stress_points(nodes: DataFrame, threshold: float = 500, severe: float = 550) -> DataFrame:
    """Nodes loaded above the threshold with their stress level."""
    return nodes.filter(F.col("load") > threshold).withColumn(
        "stress_level", F.when(F.col("load") > severe, "high").otherwise("medium")
    )


def capacity_dim(load: DataFrame, headroom: float = 1.25) -> DataFrame:
    return load.groupBy("region").agg((F.max("load") * headroom).alias("capacity"))


def capacity_utilisation(latest: DataFrame, capacity: DataFrame) -> DataFrame:
    return latest.join(capacity, "region").select(
        "region", F.col("load").alias("used"), (F.col("capacity") - F.col("load")).alias("available"), "capacity",
        F.try_divide("load", "capacity").alias("utilisation"),
    )


def known_edges(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges with both ends among the nodes."""
    keys = nodes.select("region")
    return edges.join(keys, edges.src == keys.region, "left_semi").join(keys, edges.dst == keys.region, "left_semi")


def topology_join(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges with the load and band of both ends; edges with an unknown end are dropped."""
    banded = nodes.select("region", "load", load_band("load").alias("band"))
    start = banded.select(F.col("region").alias("src"), F.col("load").alias("src_load"), F.col("band").alias("src_band"))
    stop = banded.select(F.col("region").alias("dst"), F.col("load").alias("dst_load"), F.col("band").alias("dst_band"))
    return edges.join(start, "src").join(stop, "dst")


def connection_status(joined: DataFrame, share: float = 0.2) -> DataFrame:
    """``congested`` where one edge carries at least ``share`` of all that leaves its source.

    A source has at most one edge per other node.
    """
    out = F.sum("flow").over(Window.partitionBy("src"))
    return joined.withColumn(
        "status", F.when(F.round(F.try_divide(F.col("flow"), out), 6) >= share, "congested").otherwise("normal")
    )
