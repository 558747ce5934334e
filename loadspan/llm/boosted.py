"""Quality classifier: gradient-boosted trees on histograms of document statistics."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from loadspan.llm.common import chunks, map_texts, raw_texts, stage

#: Most labelled documents that a model is fitted on; which ones is decided by a hash of the id.
SAMPLE_ROWS = 20_000
THRESHOLD = 0.3

FEATURES = (
    "log_words", "chars_per_word", "long_words", "short_words", "distinct_words", "top_word", "repeated_next",
    "upper_share", "digit_share", "symbol_share", "mark_share", "loud_share", "bar_share", "non_ascii_share",
    "upper_words", "byte_entropy", "lines_per_word", "duplicate_lines", "end_marks", "space_share",
)

_UPPER, _DIGIT = np.zeros(256, bool), np.zeros(256, bool)
_UPPER[65:91] = True
_DIGIT[48:58] = True


def of(characters: bytes) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(characters)] = True
    return out


_SYMBOL, _MARK, _LOUD, _SPACE = of(b"#*$%&<>@^~=+_{}[]\\"), of(b".,;:'\"()-"), of(b"!?"), of(b" \t\n\r\x0b\x0c")


def statistics(text: bytes) -> np.ndarray:
    """The values of ``FEATURES`` of a whole text; all 0 for a text without words."""
    words = text.split()
    n = len(words)
    if not n:
        return np.zeros(len(FEATURES), np.float32)
    seen = np.frombuffer(text, np.uint8)
    counts = np.bincount(seen, minlength=256)
    size = len(text)
    ids = np.fromiter(map(hash, words), np.int64, n)
    lengths = np.fromiter(map(len, words), np.int64, n)
    ranked = np.sort(ids)
    first = np.flatnonzero(np.concatenate(([True], ranked[1:] != ranked[:-1])))
    runs = np.diff(np.append(first, n))
    shares = counts[counts > 0] / size
    lines = [x for x in text.split(b"\n") if x and not x.isspace()]
    return np.array([
        np.log1p(n), lengths.mean(), (lengths > 15).mean(), (lengths <= 2).mean(), len(first) / n, runs.max() / n,
        (ids[1:] == ids[:-1]).mean() if n > 1 else 0.0,
        counts[_UPPER].sum() / size, counts[_DIGIT].sum() / size, counts[_SYMBOL].sum() / size,
        counts[_MARK].sum() / size, counts[_LOUD].sum() / size, counts[124] / size, counts[128:].sum() / size,
        sum(map(bytes.isupper, words)) / n, -(shares * np.log2(shares)).sum(), len(lines) / n,
        1 - len(set(lines)) / len(lines), (counts[46] + counts[33] + counts[63]) / n, counts[_SPACE].sum() / size,
    ], np.float32)


def features(docs: DataFrame) -> DataFrame:
    """(doc_id, features array<float>) of every whole text; null is empty."""

    def make():
        return lambda texts: [[statistics(t).tolist() for t in texts]]

    return map_texts(docs, make, "features array<float>")


@dataclass
class Trees:
    """Complete trees of one depth as arrays: feature and threshold of inner nodes level by level, values of leaves."""

    feature: np.ndarray
    threshold: np.ndarray
    leaf: np.ndarray
    bias: float

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probability of label 1 of rows, all trees of a row at once."""
        if not len(x):
            return np.zeros(0)
        trees, inner = self.feature.shape
        at = np.zeros((len(x), trees), np.int64)
        which = np.arange(trees)
        rows = np.arange(len(x))[:, None]
        for _ in range(int(np.log2(inner + 1))):
            at = 2 * at + 1 + (x[rows, self.feature[which, at]] > self.threshold[which, at])
        total = self.leaf[which, at - inner].sum(1) + self.bias
        return 1 / (1 + np.exp(-np.clip(total, -35, 35)))


def fit(
    x: np.ndarray, y: np.ndarray, trees: int = 60, depth: int = 4, bins: int = 64, rate: float = 0.2, ridge: float = 1.0,
    least_rows: int = 10,
) -> Trees:
    """Boosted trees for log loss. Each split is the best over histograms of gradients of ``bins`` quantile bins.

    Labels of one kind, or none, give a constant score. A node that no split improves sends all rows left.
    """
    inner = 2**depth - 1
    share = float(np.clip(y.mean(), 1e-4, 1 - 1e-4)) if len(y) else 0.5
    bias = float(np.log(share / (1 - share)))
    out = Trees(np.zeros((trees, inner), np.int64), np.full((trees, inner), np.inf), np.zeros((trees, 2**depth)), bias)
    if len(np.unique(y)) < 2:
        return out
    n, m = x.shape
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(m)]
    binned = np.stack([np.searchsorted(e, x[:, j], "left") for j, e in enumerate(edges)])
    total = np.full(n, bias)
    for t in range(trees):
        p = 1 / (1 + np.exp(-total))
        g, h = p - y, p * (1 - p)
        node = np.zeros(n, np.int64)
        for level in range(depth):
            width = 2**level
            best = np.full(width, 1e-6)
            choice = np.zeros(width, np.int64)
            cut = np.full(width, bins, np.int64)
            for j in range(m):
                key = node * bins + binned[j]
                sums = [np.bincount(key, w, width * bins).reshape(width, bins) for w in (g, h, None)]
                left = [s.cumsum(1)[:, :-1] for s in sums]
                whole = [s.sum(1, keepdims=True) for s in sums]
                right = [w - s for w, s in zip(whole, left)]
                gain = left[0]**2 / (left[1] + ridge) + right[0]**2 / (right[1] + ridge) - whole[0]**2 / (whole[1] + ridge)
                gain = np.where((left[2] >= least_rows) & (right[2] >= least_rows), gain, 0)
                at = gain.argmax(1)
                top = gain[np.arange(width), at]
                better = top > best
                best[better], choice[better], cut[better] = top[better], j, at[better]
            places = width - 1 + np.arange(width)
            out.feature[t, places] = choice
            out.threshold[t, places] = [
                edges[j][c] if c < len(edges[j]) else np.inf for j, c in zip(choice.tolist(), cut.tolist())
            ]
            node = 2 * node + (binned[choice[node], np.arange(n)] > cut[node])
        value = -np.bincount(node, g, 2**depth) / (np.bincount(node, h, 2**depth) + ridge) * rate
        out.leaf[t] = value
        total += value[node]
    return out


def sample(rows: DataFrame, most_rows: int = SAMPLE_ROWS) -> DataFrame:
    """At most ``most_rows`` rows, those of the smallest hash of the id."""
    return rows.orderBy(F.xxhash64(F.lit(17), "doc_id"), "doc_id").limit(most_rows)


def train(measured: DataFrame, labels: DataFrame, train_on: Column, most_rows: int = SAMPLE_ROWS, **settings) -> Trees:
    """Trees from a bounded sample of the labelled rows for which ``train_on`` holds.

    The driver gets at most ``most_rows`` rows of ``FEATURES`` numbers. Null labels and ids are left out; a
    repeated label of an id counts once (the largest).
    """
    known = labels.where(F.col("doc_id").isNotNull() & F.col("quality").isNotNull() & train_on)
    known = known.groupBy("doc_id").agg(F.max("quality").alias("_label"))
    rows = sample(measured.join(known, "doc_id").select("doc_id", "features", "_label"), most_rows).toPandas()
    x = np.array(rows["features"].tolist(), np.float64).reshape(-1, len(FEATURES))
    return fit(x, rows["_label"].to_numpy(np.float64), **settings)


def scored(measured: DataFrame, model: Trees) -> DataFrame:
    """(doc_id, score) of measured documents."""

    def run(batches):
        for batch in batches:
            values = batch.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.float64)
            score = model.score(values.reshape(-1, len(FEATURES)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(score)], names=["doc_id", "score"])

    return measured.select("doc_id", "features").mapInArrow(
        run, StructType([measured.schema["doc_id"], *StructType.fromDDL("score double").fields]),
    )


def classify(docs: DataFrame, labels: DataFrame, train_on: Column, most_rows: int = SAMPLE_ROWS, **settings) -> DataFrame:
    """(doc_id, score) of every whole text. Texts are read once; their statistics go to the shared folder.

    Labels, languages and ids are not inputs of a score. An empty text gets the score of all-zero statistics.
    """
    measured = stage(features(docs), "statistics")
    return scored(measured, train(measured, labels, train_on, most_rows, **settings))


def keep(docs: DataFrame, labels: DataFrame, train_on: Column, threshold: float = THRESHOLD, **settings) -> DataFrame:
    """The rows of ``docs`` whose score is at least ``threshold``, with all their columns, without a join."""
    measured = stage(features(docs), "statistics")
    model = train(measured, labels, train_on, **settings)
    at = docs.columns.index("text")

    def run(batches):
        for batch in batches:
            mask: list[bool] = []
            for part in chunks(raw_texts(batch.column(at))):
                x = np.stack([statistics(t) for t in part]).astype(np.float64)
                mask += (model.score(x) >= threshold).tolist()
            yield batch.filter(pa.array(mask, pa.bool_()))

    return docs.mapInArrow(run, StructType(docs.schema.fields))
