"""Connected components by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loadspan.llm.common import stage
from loadspan.plans.skew import salted_join


def components(edges: DataFrame, a: str = "a", b: str = "b", salts: int = 16, most_rounds: int = 60) -> DataFrame:
    """(id, component) for every id that has an edge to another id; the component is its smallest id.

    Large star: every larger neighbour of a node is linked to the smallest one around the node;
    small star: the node and its smaller neighbours are linked to the smallest. The two alternate until
    the edges are stars around the smallest ids (a number of rounds of about the logarithm of the
    longest path). Each round is written to the shared folder. Nodes with many neighbours are
    dealt over ``salts`` groups. Null ids and loops are dropped; an empty table gives an empty one.
    """
    at = stage(
        edges.select(F.greatest(a, b).alias("v"), F.least(a, b).alias("u"))
        .where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b))).distinct(),
        "edges",
    )
    seen = None
    for _ in range(most_rounds):
        both = at.select(F.col("v").alias("n"), F.col("u").alias("m")).union(at.select(F.col("u"), F.col("v")))
        least = both.groupBy("n").agg(F.least(F.min("m"), F.col("n")).alias("low"))
        large = salted_join(both.where("m > n"), least, ["n"], ["m"], salts=salts)
        large = stage(large.select(F.col("m").alias("v"), F.col("low").alias("u")).distinct(), "edges")
        low = large.groupBy("v").agg(F.min("u").alias("low"))
        small = salted_join(large, low, ["v"], ["u"], salts=salts)
        pairs = small.select(F.explode(F.array(
            F.struct(F.col("v"), F.col("low").alias("u")), F.struct(F.col("u").alias("v"), F.col("low").alias("u")),
        )).alias("e")).select("e.v", "e.u").where("v != u").distinct()
        at = stage(pairs, "edges")
        now = at.agg(
            F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.xxhash64("v", "u").cast("decimal(38,0)")), F.lit(0)).alias("h"),
        ).first()
        if (now.n, now.h) == seen:
            return at.select(F.col("v").alias("id"), F.col("u").alias("component")).union(
                at.select(F.col("u"), F.col("u")).distinct()
            )
        seen = (now.n, now.h)
    raise RuntimeError(f"no stable components after {most_rounds} rounds")
