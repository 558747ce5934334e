"""Near-duplicate embeddings: a forest of random-projection trees with spill, exact comparison within leaves."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructType

from loadspan.llm.common import stage
from loadspan.llm.graph import components
from loadspan.plans.skew import salted_join

TREES = 8
#: Distinct vectors that a leaf has on average at most, and of which more are compared in pairs of blocks.
LEAF = 512
BLOCK = 2048
#: Half the width of the zone that goes to both sides, in standard deviations of the projections.
SPILL = 0.2
#: Vectors from which the split points are taken, and levels that have split points of their own for each node.
SAMPLE = 8192
FITTED_LEVELS = 9
MOST_LEVELS = 22


#: Components of a direction; longer vectors are folded onto them to be split, and compared in full.
WIDE = 4096


def vectors(table: DataFrame, id_column: str, vector_column: str) -> DataFrame:
    """(id, vec, k1, k2): vectors as bytes with two hashes; null if not of finite components with one that is not 0."""
    kind = table.schema[vector_column].dataType.elementType
    dtype = np.float64 if isinstance(kind, DoubleType) else np.float32
    out = StructType([table.schema[id_column], *StructType.fromDDL("vec binary, k1 bigint, k2 bigint").fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vec, k1, k2 = [], [], []
            for i, x in zip(batch.column(0).to_pylist(), batch.column(1)):
                raw = None
                if i is not None and x.is_valid and len(x.values) and x.values.null_count == 0:
                    values = x.values.to_numpy(zero_copy_only=False).astype(dtype) + dtype(0)
                    if np.isfinite(values).all() and values.any():
                        raw = values.tobytes()
                vec.append(raw)
                k1.append(xxhash.xxh64_intdigest(raw, 1) if raw else 0)
                k2.append(xxhash.xxh64_intdigest(raw, 2) if raw else 0)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(vec, pa.binary()), pa.array(np.array(k1, np.uint64).view(np.int64)),
                 pa.array(np.array(k2, np.uint64).view(np.int64))], names=out.names,
            )

    return table.select(id_column, vector_column).mapInArrow(run, out).withColumnRenamed(id_column, "id")


def unit(raws: list[bytes], wide: bool) -> np.ndarray:
    """Rows of length 1 in double precision, of vectors with equally many components; scaled first, so that no square overflows."""
    x = np.frombuffer(b"".join(raws), np.float64 if wide else np.float32).reshape(len(raws), -1).astype(np.float64)
    if not len(x):
        return x
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def by_size(raws: list[bytes], wide: bool) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(components, places, rows of length 1) of the vectors, those with equally many components together."""
    sizes = np.array([len(r) for r in raws], np.int64)
    for size in np.unique(sizes):
        at = np.flatnonzero(sizes == size)
        yield int(size) // (8 if wide else 4), at, unit([raws[i] for i in at], wide)


def folded(x: np.ndarray, width: int) -> np.ndarray:
    """Rows of at most ``width`` components, the later ones of longer rows added to the first."""
    if x.shape[1] <= width:
        return x
    return np.pad(x, ((0, 0), (0, -x.shape[1] % width))).reshape(len(x), -1, width).sum(1)


@dataclass
class Forest:
    """A direction for each tree and level, split points for the nodes of the upper levels and for whole lower levels."""

    directions: np.ndarray
    nodes: list[list[np.ndarray]]
    medians: np.ndarray
    margins: np.ndarray

    @property
    def trees(self) -> int:
        return self.directions.shape[0]

    @property
    def levels(self) -> int:
        return self.directions.shape[1]

    def leaves(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, code) of every leaf of every row; codes of a tree are smaller than those of the next."""
        x = folded(x, self.directions.shape[2])
        rows_out, codes_out = [], []
        for t in range(self.trees):
            rows, node = np.arange(len(x)), np.zeros(len(x), np.int64)
            for level in range(self.levels):
                at = (x @ self.directions[t, level, :x.shape[1]])[rows] - self.split(t, level, node)
                m = self.margins[t, level]
                left, right = at < m, at >= -m
                rows, node = np.concatenate((rows[left], rows[right])), np.concatenate((2 * node[left], 2 * node[right] + 1))
            rows_out.append(rows)
            codes_out.append((t << self.levels) | node)
        return np.concatenate(rows_out), np.concatenate(codes_out)

    def split(self, t: int, level: int, node: np.ndarray) -> np.ndarray | float:
        return self.nodes[t][level][node] if level < len(self.nodes[t]) else self.medians[t, level]


def grow(samples: list[np.ndarray], dim: int, levels: int, trees: int = TREES, spill: float = SPILL, seed: int = 11) -> Forest:
    """Random unit directions; split points are medians of the samples in the node, of all of them where a node has few."""
    rng = np.random.default_rng(seed)
    directions = rng.standard_normal((trees, levels, dim))
    directions /= np.sqrt((directions**2).sum(-1, keepdims=True))
    medians, margins = np.zeros((trees, levels)), np.zeros((trees, levels))
    nodes: list[list[np.ndarray]] = []
    for t in range(trees):
        node = np.zeros(sum(map(len, samples)), np.int64)
        splits = []
        for level in range(levels):
            along = np.concatenate([np.zeros(0), *(x @ directions[t, level, :x.shape[1]] for x in samples)])
            medians[t, level] = np.median(along) if len(along) else 0.0
            margins[t, level] = spill * along.std() if len(along) else 0.0
            if level < FITTED_LEVELS:
                points = np.full(2**level, medians[t, level])
                for k in range(2**level):
                    inside = along[node == k]
                    if len(inside) >= 8:
                        points[k] = np.median(inside)
                splits.append(points)
                node = 2 * node + (along >= points[node])
        nodes.append(splits)
    return Forest(directions, nodes, medians, margins)


def local_components(links: np.ndarray) -> np.ndarray:
    """The smallest index reachable from each row of a symmetric matrix of links."""
    n = len(links)
    at = np.arange(n)
    i, j = np.nonzero(links)
    while len(i):
        low = at.copy()
        np.minimum.at(low, i, at[j])
        low = low[low]
        if (low == at).all():
            break
        at = low
    return at


def compare(ids: np.ndarray, x: np.ndarray, weights: np.ndarray, earlier: list[np.ndarray], sides: np.ndarray | None, least: float):
    """(ids, links, roots) of the members of a leaf that link with another one.

    ``earlier`` are the codes of each member's leaves before this one: a pair that shares one has been counted there. With
    ``sides``, only pairs of different sides are counted, those within a side are another task's.
    """
    order = np.argsort(ids, kind="stable")
    ids, x, weights, earlier = ids[order], x[order], weights[order], [earlier[i] for i in order]
    links = x @ x.T >= least
    np.fill_diagonal(links, False)
    if sides is not None:
        sides = sides[order]
        links &= sides[:, None] != sides[None, :]
    members = np.flatnonzero(links.any(1))
    if not len(members):
        return ids[:0], weights[:0], ids[:0]
    links = links[np.ix_(members, members)]
    codes, place = np.unique(np.concatenate([earlier[i] for i in members]), return_inverse=True)
    owner = np.repeat(np.arange(len(members)), [len(earlier[i]) for i in members])
    fresh = links
    if len(codes):
        shared = np.flatnonzero(np.bincount(place, minlength=len(codes)) > 1)
        column = np.full(len(codes), -1)
        column[shared] = np.arange(len(shared))
        hit = column[place] >= 0
        inside = np.zeros((len(members), len(shared)), np.float32)
        inside[owner[hit], column[place[hit]]] = 1
        fresh = links & (inside @ inside.T == 0)
    counts = fresh.astype(np.int64) @ weights[members]
    roots = local_components(fresh)
    found = counts > 0
    return ids[members][found], counts[found], ids[members][roots][found]


def near(table: DataFrame, id_column: str = "vec_id", vector_column: str = "embedding", least: float = 0.9, trees: int = TREES,
         leaf: int = LEAF, block: int = BLOCK, spill: float = SPILL) -> DataFrame:
    """(id, n_links, component_id, kept) of every vector, a row for each row of ``table``.

    Vectors link if their cosine in double precision is at least ``least``; every link given is exact, and the forest finds nearly
    all (the README has the measured recall). ``n_links`` counts linked other rows, ``component_id`` is the smallest id reachable,
    ``kept`` that it is the own one. Rows with a null id, or a vector that is null, empty, of zeros, or with null or
    non-finite components, link with nothing; a null id has a null component. Vectors link only with those that have equally many
    components: that number is part of a leaf's key.

    Equal vectors are one entry with its number of rows. Each tree splits by random directions at medians of a bounded sample;
    vectors near a split go to both sides. Leaves are tasks of bounded size: one of more than ``block`` vectors, which no
    direction splits, is dealt into blocks and compared block by block. A pair is counted in the first leaf that both are in, so no list
    of pairs is kept: a leaf returns a count and a root for each member.
    """
    wide = isinstance(table.schema[vector_column].dataType.elementType, DoubleType)
    given = stage(vectors(table, id_column, vector_column), "vectors")
    reps = stage(
        given.where("vec IS NOT NULL").groupBy("k1", "k2").agg(
            F.min("id").alias("id"), F.count(F.lit(1)).alias("copies"), F.first("vec").alias("vec"),
        ), "distinct-vectors",
    )
    total = reps.count()
    levels = min(MOST_LEVELS, max(0, int(np.ceil(np.log2(max(total, 1) / leaf)))))
    rows = reps.orderBy("k1", "k2").limit(SAMPLE).select("vec").toPandas()["vec"].tolist()
    longest = reps.agg(F.max(F.octet_length("vec"))).first()[0] or 0
    dim = min(WIDE, max(1, longest // (8 if wide else 4)))
    forest = grow([folded(x, dim) for _, _, x in by_size([bytes(r) for r in rows], wide)], dim, levels, trees, spill)

    id_type = reps.schema["id"].dataType.simpleString()

    def places(raws):
        """(row, components, code) of all leaves of all vectors, by row and code."""
        found = [(at[row], np.full(len(row), size), code) for size, at, x in by_size(raws, wide) for row, code in [forest.leaves(x)]]
        row, size, code = (np.concatenate([np.zeros(0, np.int64), *parts]) for parts in zip(*found)) if found else [np.zeros(0, np.int64)] * 3
        order = np.lexsort((code, row))
        return row[order], size[order].astype(np.int32), code[order].astype(np.int32)

    def leaves(batches):
        for batch in batches:
            row, size, code = places(batch.column(1).to_pylist())
            start = np.searchsorted(row, np.arange(len(batch) + 1))
            every = [code[start[i]:start[i + 1]] for i in range(len(batch))]
            take = pa.array(row)
            place = np.arange(len(row)) - start[row]
            earlier = [every[i][:k].tobytes() for i, k in zip(row.tolist(), place.tolist())]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(take), batch.column(1).take(take), batch.column(2).take(take),
                 pa.array(size, pa.int32()), pa.array(code, pa.int32()), pa.array(earlier, pa.binary())],
                names=["id", "vec", "copies", "size", "code", "earlier"],
            )

    dealt = reps.select("id", "vec", "copies").mapInArrow(leaves, f"id {id_type}, vec binary, copies bigint, size int, code int, earlier binary")

    def leaf_counts(batches):
        for batch in batches:
            _, size, code = places(batch.column(0).to_pylist())
            keys, n = np.unique(size.astype(np.int64) << 32 | code, return_counts=True)
            yield pa.RecordBatch.from_arrays(
                [pa.array((keys >> 32).astype(np.int32)), pa.array((keys & 0xFFFFFFFF).astype(np.int32)), pa.array(n)], names=["size", "code", "n"],
            )

    sizes = reps.select("vec").mapInArrow(leaf_counts, "size int, code int, n bigint").groupBy("size", "code").agg(F.sum("n").alias("n"))
    large = stage(
        sizes.where(F.col("n") > block).select("size", "code", F.ceil(F.col("n") / block).cast("int").alias("blocks")), "large-leaves",
    )
    own = F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int")
    grouped = salted_join(dealt, large, ["size", "code"], ["id"], "left").withColumn("own", F.coalesce(own, F.lit(0))).withColumn(
        "other", F.explode(F.sequence(F.lit(0), F.coalesce(F.col("blocks"), F.lit(1)) - 1)),
    ).withColumn("p", F.least("own", "other")).withColumn("q", F.greatest("own", "other"))

    def in_leaf(key, group):
        _, _, p, q = (k.as_py() for k in key)
        ids = group.column("id").to_numpy()
        x = unit(group.column("vec").to_pylist(), wide)
        earlier = [np.frombuffer(e, np.int32) for e in group.column("earlier").to_pylist()]
        sides = group.column("own").to_numpy() if p != q else None
        got = compare(ids, x, group.column("copies").to_numpy(), earlier, sides, least)
        return pa.table(dict(zip(("id", "links", "root"), got)))

    found = stage(
        grouped.select("id", "vec", "copies", "earlier", "own", "size", "code", "p", "q").groupBy("size", "code", "p", "q").applyInArrow(
            in_leaf, f"id {id_type}, links bigint, root {id_type}",
        ), "leaf-links",
    )
    comps = components(found.select(F.col("id").alias("a"), F.col("root").alias("b")))
    links = found.groupBy("id").agg(F.sum("links").alias("links"))
    known = reps.join(links, "id", "left").join(comps, "id", "left").select(
        "k1", "k2", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("links"), F.coalesce("component", "id").alias("component"),
    )
    valid = salted_join(given.where("vec IS NOT NULL").select("id", "k1", "k2"), known, ["k1", "k2"], ["id"], "left")
    rest = given.where("vec IS NULL").select("id", F.lit(0).cast("bigint").alias("links"), F.col("id").alias("component"))
    return valid.select("id", "links", "component").union(rest).select(
        F.col("id").alias(id_column), F.col("links").alias("n_links"), F.col("component").alias("component_id"),
        (F.col("id") == F.col("component")).alias("kept"),
    )
