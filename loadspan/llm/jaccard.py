"""Jaccard join of documents by word shingles: a blocked sparse product over frequency-ordered prefixes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import MapType, StructType, VariantType

from loadspan.llm.common import chunks, raw_texts, stage
from loadspan.llm.embed_forest import local_components
from loadspan.llm.graph import components
from loadspan.plans.skew import salted_join

SHINGLE = 4
PERCENT = 85
#: Shingles that are kept to the end of the order: the most frequent ones, so many at most. The bound
#: sizes a broadcast; it decides how much is compared, never what is found.
HOT_SHINGLES = 1 << 16
HOT_COUNT = 24
COUNTED_AT_A_TIME = 2_000_000
#: Bits of the filter that tells where texts are read which of them are compared: 8 MB.
FILTER_BITS = 1 << 26
#: Minima of a set that name its clusters; clusters of more documents are compared as a whole, in blocks of documents.
MINIMA = 6
CLUSTER = 16
BLOCK = 512
#: Shingles of a block of columns in the product.
COLUMNS = 4096

_P = [np.uint64(p) for p in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F,
                             0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3)]


def shingles(text: bytes, size: int = SHINGLE) -> np.ndarray:
    """Distinct shingles of a text as sorted 64-bit hashes, A-Z in lower case; a text of fewer words is one shingle."""
    words = text.lower().split()
    n = len(words)
    if not n:
        return np.zeros(0, np.uint64)
    ids = np.frombuffer(b"".join(map(xxhash.xxh64_digest, words)), "<u8")
    width = min(size, n)
    with np.errstate(over="ignore"):
        out = ids[: n - width + 1] * _P[0]
        for k in range(1, width):
            out = (out ^ (out >> np.uint64(29))) * _P[(k + 3) % 8] + ids[k:n - width + 1 + k] * _P[k % 8]
        if n < size:
            out = out + np.uint64(n)
        out ^= out >> np.uint64(32)
        out *= _P[0]
        out ^= out >> np.uint64(29)
    return np.unique(out)


def prefix_size(n: int, percent: int = PERCENT) -> int:
    """Shingles of which two sets that link share one: n - ceil(t n) + 1."""
    return n - -(-n * percent // 100) + 1 if n else 0


def minima(grams: np.ndarray) -> list[int]:
    """The smallest shingle in each of ``MINIMA`` random orders; two sets share one with the chance of their similarity."""
    with np.errstate(over="ignore"):
        return [int(((grams ^ (grams >> np.uint64(23 + i))) * _P[(i + 4) % 8]).min().view(np.int64)) for i in range(MINIMA)]


def signatures(docs: DataFrame, size: int = SHINGLE, percent: int = PERCENT, hot: np.ndarray | None = None) -> DataFrame:
    """(doc_id, n, k1, k2, prefix, mins): the size of each set, two hashes of it, its first shingles in the order, and its minima.

    The order is by hash, the ``hot`` shingles last, from the least frequent to the most.
    """
    out = StructType([docs.schema["doc_id"], *StructType.fromDDL("n bigint, k1 bigint, k2 bigint, prefix array<bigint>, mins array<bigint>").fields])
    hot = np.zeros(0, np.int64) if hot is None else hot

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranked = np.argsort(hot.view(np.uint64), kind="stable")
        hot_keys = hot.view(np.uint64)[ranked]
        for batch in batches:
            n, k1, k2, prefix, mins = [], [], [], [], []
            for part in chunks(raw_texts(batch.column(1))):
                for text in part:
                    grams = shingles(text, size)
                    raw = grams.tobytes()
                    n.append(len(grams))
                    k1.append(xxhash.xxh64_intdigest(raw, 1))
                    k2.append(xxhash.xxh64_intdigest(raw, 2))
                    mins.append(minima(grams) if len(grams) else None)
                    if len(hot_keys) and len(grams):
                        at = np.minimum(np.searchsorted(hot_keys, grams), len(hot_keys) - 1)
                        found = hot_keys[at] == grams
                        late = at[found]
                        grams = np.concatenate((grams[~found], hot_keys[late[np.argsort(-ranked[late])]]))
                    prefix.append(grams[: prefix_size(len(grams), percent)].view(np.int64))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n, pa.int64()), pa.array(np.array(k1, np.uint64).view(np.int64)),
                 pa.array(np.array(k2, np.uint64).view(np.int64)), pa.array(prefix, pa.list_(pa.int64())), pa.array(mins, pa.list_(pa.int64()))],
                names=out.names,
            )

    return docs.select("doc_id", "text").mapInArrow(run, out)


def hot_shingles(docs: DataFrame, size: int = SHINGLE, percent: int = PERCENT) -> np.ndarray:
    """The most frequent shingles of the prefixes, most frequent first, ``HOT_SHINGLES`` at most.

    Tasks count the shingles of some thousand documents and pass on those they see twice: a frequent one is among them. What is missed
    is only compared more often.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []

        def counted() -> pa.RecordBatch:
            grams, n = np.unique(np.concatenate(held or [np.zeros(0, np.uint64)]), return_counts=True)
            held.clear()
            return pa.RecordBatch.from_arrays(
                [pa.array(grams[n > 1].view(np.int64)), pa.array(n[n > 1].astype(np.int64))], names=["gram", "n"],
            )

        for batch in batches:
            for part in chunks(raw_texts(batch.column(0))):
                for text in part:
                    grams = shingles(text, size)
                    held.append(grams[: prefix_size(len(grams), percent)])
            if sum(map(len, held)) > COUNTED_AT_A_TIME:
                yield counted()
        yield counted()

    counts = docs.select("text").mapInArrow(run, "gram bigint, n bigint").groupBy("gram").agg(F.sum("n").alias("n"))
    rows = counts.where(F.col("n") >= HOT_COUNT).orderBy(F.desc("n"), "gram").limit(HOT_SHINGLES).select("gram").toPandas()
    return rows["gram"].to_numpy(np.int64)


def bit_places(ids: np.ndarray) -> np.ndarray:
    """Three places of each id in a filter of ``FILTER_BITS`` bits."""
    with np.errstate(over="ignore"):
        mixed = (ids.astype(np.int64).view(np.uint64) ^ (ids.astype(np.int64).view(np.uint64) >> np.uint64(31))) * _P[0]
        return np.stack([(mixed * p) >> np.uint64(64 - FILTER_BITS.bit_length() + 1) for p in _P[1:4]])


def id_filter(ids: DataFrame) -> np.ndarray:
    """A Bloom filter of ids as 64-bit words. The driver gets at most ``FILTER_BITS`` / 64 words, however many ids there are."""

    def run(batches):
        for batch in batches:
            places = np.unique(bit_places(batch.column(0).to_numpy()))
            word = (places >> np.uint64(6)).astype(np.int64)
            bits = np.left_shift(np.uint64(1), places & np.uint64(63)).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(word), pa.array(bits)], names=["word", "bits"])

    words = ids.mapInArrow(run, "word bigint, bits bigint").groupBy("word").agg(F.bit_or("bits").alias("bits")).toPandas()
    out = np.zeros(FILTER_BITS // 64, np.uint64)
    out[words["word"].to_numpy(np.int64)] = words["bits"].to_numpy(np.int64).view(np.uint64)
    return out


def may_hold(kept: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """Which ids the filter of ``id_filter`` lets pass: all that it was made of, and a few others."""
    places = bit_places(ids)
    return ((kept[places >> np.uint64(6)] >> (places & np.uint64(63))) & np.uint64(1)).all(0)


def parted(docs: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Documents of other ids than ``ids``, and those of ``ids`` with few others, told apart where they are read."""
    kept = id_filter(ids.select(F.col("doc_id").cast("bigint")))

    @F.pandas_udf("boolean")
    def maybe(column: pd.Series) -> pd.Series:
        return pd.Series(may_hold(kept, column.to_numpy()))

    found = maybe(F.coalesce(F.col("doc_id").cast("bigint"), F.lit(0)))
    return docs.where(~found), docs.where(found)


def sets(docs: DataFrame, wanted: DataFrame, size: int) -> DataFrame:
    """(doc_id, grams) of the documents whose ids are ``wanted``, the hashes as bytes, and of few others.

    A filter of bounded size tells most other documents where they are read, so that texts are not moved. A full filter lets all pass,
    which is slower and no less right.
    """
    kept = id_filter(wanted.select(F.col(wanted.columns[0]).cast("bigint")))
    out = StructType([docs.schema["doc_id"], *StructType.fromDDL("grams binary").fields])

    def run(batches):
        for batch in batches:
            part = batch.filter(pa.array(may_hold(kept, batch.column(0).to_numpy(zero_copy_only=False))))
            found = [shingles(t, size).tobytes() for texts in chunks(raw_texts(part.column(1))) for t in texts]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(found, pa.binary())], names=out.names)

    return docs.where(F.col("doc_id").isNotNull()).select("doc_id", "text").mapInArrow(run, out)


def linked(pairs: DataFrame, grams: DataFrame, percent: int = PERCENT) -> DataFrame:
    """The pairs (a, b) whose sets have the similarity, by exact counts."""
    with_b = pairs.join(grams.select(F.col("doc_id").alias("b"), F.col("grams").alias("gb")), "b")
    both = with_b.join(grams.select(F.col("doc_id").alias("a"), F.col("grams").alias("ga")), "a").select("a", "b", "ga", "gb")

    def run(batches):
        for batch in batches:
            mask = []
            for x, y in zip(batch.column(2), batch.column(3)):
                s, t = np.frombuffer(x.as_py(), np.uint64), np.frombuffer(y.as_py(), np.uint64)
                if len(s) > len(t):
                    s, t = t, s
                common = int((t[np.minimum(np.searchsorted(t, s), len(t) - 1)] == s).sum()) if len(s) else 0
                mask.append(100 * common >= percent * (len(s) + len(t) - common) and common > 0)
            yield batch.select(["a", "b"]).filter(pa.array(mask, pa.bool_()))

    kind = grams.schema["doc_id"].dataType.simpleString()
    return both.mapInArrow(run, f"a {kind}, b {kind}")


def least_overlap(na: Column, nb: Column, percent: int) -> Column:
    """The smallest overlap with which sets of these sizes can link."""
    return F.ceil(percent * (na + nb) / F.lit(100 + percent))


def like_sizes(na: Column, nb: Column, percent: int) -> Column:
    return (100 * F.least(na, nb)) >= (percent * F.greatest(na, nb))


def overlaps(grams: list[np.ndarray]) -> np.ndarray:
    """Overlap counts of all sets of a block: the incidence of sets by shingles times itself, summed over blocks of columns.

    Shingles of one set alone add nothing and are left out.
    """
    sizes = np.fromiter(map(len, grams), np.int64, len(grams))
    _, column, counts = np.unique(np.concatenate(grams), return_inverse=True, return_counts=True)
    row = np.repeat(np.arange(len(grams)), sizes)
    place = np.cumsum(counts > 1) - 1
    shared = counts[column] > 1
    row, column = row[shared], place[column[shared]]
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    out = np.zeros((len(grams), len(grams)), np.float64)
    for first in range(0, int(column[-1]) + 1 if len(column) else 0, COLUMNS):
        lo, hi = np.searchsorted(column, (first, first + COLUMNS))
        block = np.zeros((len(grams), COLUMNS), np.float32)
        block[row[lo:hi], column[lo:hi] - first] = 1
        out += block @ block.T
    return out


def cluster_links(members: DataFrame, grams: DataFrame, percent: int) -> DataFrame:
    """Edges (a, b) that join what links within each cluster, block by block.

    ``members`` (doc, perm, key, blocks): a cluster of several blocks is compared block by block, so no task holds a large cluster.
    """
    kind = members.schema["doc"].dataType.simpleString()
    own = F.pmod(F.xxhash64("doc"), F.col("blocks")).cast("int")
    dealt = members.join(grams.select(F.col("doc_id").alias("doc"), "grams"), "doc").withColumn("own", own).withColumn(
        "other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)),
    ).withColumn("p", F.least("own", "other")).withColumn("q", F.greatest("own", "other"))

    def compare(key, group):
        p, q = key[2].as_py(), key[3].as_py()
        group = group.sort_by("doc")
        ids = group.column("doc").to_numpy()
        found = [np.frombuffer(g, np.uint64) for g in group.column("grams").to_pylist()]
        n = np.fromiter(map(len, found), np.float64, len(found))
        common = overlaps(found)
        links = (common > 0) & (100 * common >= percent * (n[:, None] + n[None, :] - common))
        np.fill_diagonal(links, False)
        if p != q:
            side = group.column("own").to_numpy()
            links &= side[:, None] != side[None, :]
        root = local_components(links)
        linked = root != np.arange(len(root))
        return pa.table({"a": ids[root[linked]], "b": ids[linked]})

    return dealt.select("doc", "grams", "own", "perm", "key", "p", "q").groupBy("perm", "key", "p", "q").applyInArrow(
        compare, f"a {kind}, b {kind}",
    )


def all_pairs(entries: DataFrame, percent: int) -> DataFrame:
    """Pairs of documents that are not known to be linked or compared, and whose common prefix shingles allow the similarity.

    The product of the prefix incidence with itself, shingle by shingle; the counts of a pair are summed. A pair's overlap is at most the
    count plus the shingles behind the prefix that ends first, so pairs with a smaller sum than their sizes ask for are discarded.
    ``entries`` (gram, doc, n, comp, clusters): pairs of one component or with a common cluster are known. In each list, the members of
    its largest cluster are only paired with others, not among themselves.
    """
    lists = entries.groupBy("gram").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo != hi").select("gram")
    open_ = entries.join(lists, "gram", "left_semi").withColumn("first", F.try_element_at("clusters", F.lit(1)))
    sizes = open_.where("first IS NOT NULL").groupBy("gram", "first").agg(F.count(F.lit(1)).alias("c"))
    major = sizes.groupBy("gram").agg(F.max_by("first", F.struct("c", "first")).alias("major"))
    marked = open_.join(major, "gram", "left").withColumn("apart", ~F.col("first").eqNullSafe(F.col("major")) | F.col("major").isNull())
    columns = ("doc", "comp", "n", "clusters", "apart")
    left = marked.where("apart").select("gram", *(F.col(c).alias(f"{c}_a") for c in columns))
    right = marked.select("gram", *(F.col(c).alias(f"{c}_b") for c in columns))
    compared = F.coalesce(F.exists(
        F.zip_with("clusters_a", "clusters_b", lambda x, y: x == y), lambda same: F.coalesce(same, F.lit(False)),
    ), F.lit(False))
    met = left.join(right, "gram").where(
        (F.col("doc_a") != F.col("doc_b")) & (~F.col("apart_b") | (F.col("doc_a") < F.col("doc_b")))
        & (F.col("comp_a") != F.col("comp_b")) & like_sizes(F.col("n_a"), F.col("n_b"), percent) & ~compared
    )
    counted = met.groupBy(F.least("doc_a", "doc_b").alias("a"), F.greatest("doc_a", "doc_b").alias("b")).agg(
        F.count(F.lit(1)).alias("c"), F.first("n_a").alias("na"), F.first("n_b").alias("nb"),
    )
    behind = F.ceil(percent * F.greatest("na", "nb") / 100) - 1
    return counted.where(F.col("c") + behind >= least_overlap(F.col("na"), F.col("nb"), percent)).select("a", "b")


def join(docs: DataFrame, size: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """(doc_id, n_shingles, component_id) of every whole text, a row for each row.

    Two documents link when 100 * intersection >= ``percent`` * union of their shingle sets; the component is the smallest id reachable
    by links. Texts without words link with nothing and are their own component. Rows of one id count as one document that links as
    each of its texts does. A null id links with nothing and has a null component. Equal sets are one
    entry: its links are those of its smallest id, so large groups of copies cost one row each. Sets are of 64-bit hashes.
    Only ``doc_id`` and ``text`` are read.

    Large groups of near copies share minima of their sets: clusters by such minima are compared as a whole, by products of
    blocks of documents, and joined by one edge for each member. Then the lists of documents by prefix shingle give the pairs that no cluster has
    compared and no component joins, which are checked on the whole sets. Every pair that can link is in one of the two. Ids are
    cast to bigint for a filter of bounded size.
    """
    id_type = docs.schema["doc_id"].dataType.simpleString()
    # a first pass finds the frequent shingles, a second one puts them last
    signed = stage(signatures(docs, size, percent, hot_shingles(docs, size, percent)), "signatures")
    usable = signed.where("n > 0 AND doc_id IS NOT NULL")
    each = usable.groupBy("k1", "k2").agg(F.min("doc_id").alias("doc"), F.first("n").alias("n"), F.first("prefix").alias("prefix"))
    every = each.select("doc", F.col("n").cast("int").alias("n"), F.posexplode("prefix").alias("pos", "gram"))
    shared = every.groupBy("gram").agg(F.count(F.lit(1)).alias("c")).where("c > 1").select("gram")
    entries = stage(every.join(shared, "gram", "left_semi"), "lists")
    small = usable.groupBy("k1", "k2").agg(F.min("doc_id").alias("doc"), F.first("mins").alias("mins"))
    named = small.select("doc", F.posexplode("mins").alias("perm", "key"))
    large = named.groupBy("perm", "key").agg(F.count(F.lit(1)).alias("size")).where(F.col("size") > CLUSTER)
    members = stage(salted_join(named, large, ["perm", "key"], ["doc"]).select(
        "doc", "perm", "key", F.ceil(F.col("size") / BLOCK).cast("int").alias("blocks")), "clusters")
    grams = stage(sets(docs, members.select("doc").distinct(), size), "grams")
    within = stage(cluster_links(members, grams, percent), "links")
    comps = stage(components(within), "components")
    one_cluster = [F.max(F.when(F.col("perm") == i, F.col("key"))) for i in range(MINIMA)]
    clusters = members.groupBy("doc").agg(F.array(*one_cluster).alias("clusters"))
    known = stage(clusters.join(comps.select(F.col("id").alias("doc"), "component"), "doc", "full"), "known")
    labelled = entries.join(known, "doc", "left").withColumn("comp", F.coalesce("component", "doc")).drop("component")
    pairs = stage(all_pairs(labelled, percent), "pairs")
    ids = pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct()
    across = stage(linked(pairs, stage(sets(docs, ids, size), "grams"), percent), "links")
    edges = within.union(across)
    reps = usable.groupBy("k1", "k2").agg(F.min("doc_id").alias("doc"), F.count(F.lit(1)).alias("rows"))
    # rows of one id with different sets meet in that id
    own = usable.groupBy("doc_id", "k1", "k2").agg(F.count(F.lit(1)).alias("c")).groupBy("doc_id").agg(F.count(F.lit(1)).alias("c")).where("c > 1")
    repeated = stage(usable.join(own.select("doc_id"), "doc_id", "left_semi").select("doc_id", "k1", "k2"), "repeated")
    theirs = reps.join(repeated.select("k1", "k2").distinct(), ["k1", "k2"], "left_semi").select("k1", "k2", "doc")
    same = salted_join(repeated, theirs, ["k1", "k2"], ["doc_id"]).select(F.col("doc_id").alias("a"), F.col("doc").alias("b"))
    comps = components(edges.union(same))
    # a set of one row without links needs none, as its component is its own id
    by_set = reps.join(comps.select(F.col("id").alias("doc"), "component"), "doc", "left").where("rows > 1 OR component IS NOT NULL").select(
        "k1", "k2", F.coalesce("component", "doc").alias("component"))
    joined = salted_join(signed.select("doc_id", "n", "k1", "k2"), by_set, ["k1", "k2"], ["doc_id"], "left")
    found = F.when(F.col("n") > 0, F.coalesce("component", "doc_id")).otherwise(F.col("doc_id"))
    return joined.select("doc_id", F.col("n").alias("n_shingles"),
                         F.when(F.col("doc_id").isNotNull(), found).cast(id_type).alias("component_id"))


def keep_one(docs: DataFrame, size: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """The document of the smallest id of each component of ``join``, with all columns of ``docs``.

    A row for each different text of that id stays: of rows with one id and one text, the one with the smallest hash of its
    columns. Texts without words and rows of a null id all stay. Ids are cast to bigint, as in ``join``.
    """
    found = stage(join(docs, size, percent).where("doc_id IS NOT NULL").groupBy("doc_id").agg(
        F.count(F.lit(1)).alias("rows"), F.count(F.when(F.col("doc_id") == F.col("component_id"), 1)).alias("own")), "heads")
    # few ids are not the head of a component with one row alone: a filter of them passes all other texts on where they are read
    sure, doubtful = parted(docs.where(F.col("doc_id").isNotNull()), found.where("rows > 1 OR own = 0"))
    heads = found.where("own > 0")
    single = doubtful.join(heads.where("own = 1"), "doc_id", "left_semi")
    # ids that repeat are few, so their rows alone are grouped
    several = doubtful.join(heads.where("own > 1"), "doc_id", "left_semi")
    hashed = F.xxhash64(*[F.col(f"`{f.name}`") for f in docs.schema.fields if not isinstance(f.dataType, (MapType, VariantType))])
    row = F.min_by(F.struct(*[F.col(f"`{c}`") for c in docs.columns]), hashed)
    # by position, as columns of any name may be there
    one = several.groupBy(F.col("doc_id").alias("_id"), F.col("text").alias("_text")).agg(row.alias("_row")).select("_row.*")
    return sure.union(single).union(one).union(docs.where(F.col("doc_id").isNull()))
