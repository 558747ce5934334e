"""Toxicity: FTRL-proximal logistic regression over hashed words, word pairs and skip pairs."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loadspan.llm.boosted import sample
from loadspan.llm.common import WordCache, map_texts

#: Bounds of the labelled sample: documents, and words of a document that may be in it.
SAMPLE_ROWS = 5_000
SAMPLE_WORDS = 2_000
THRESHOLD = 0.7
#: Letters of the beginnings of words.
STARTS = (4, 5, 6)
MARKS = b".,;:!?\"'()[]{}*#%&$|-_<>"

_PAIR, _SKIP, _NEXT = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9)
_FOLD = np.uint64(32)
#: Slots of the table that tells most keys without a weight at once.
_SLOTS = 1 << 20


def word_keys(words: list[bytes]) -> list[bytes]:
    """Hashes of a word without its marks, in lower case, and of its first 4, 5 and 6 letters; words of marks alone keep them.

    Inflected forms of a word share their first letters. A beginning that is the whole word or longer repeats its hash.
    """
    out = []
    for word in words:
        text = ((word.decode("utf-8", "replace").lower().encode().strip(MARKS)) or word).decode("utf-8", "replace")
        whole = xxhash.xxh64_digest(text.encode())
        starts = [xxhash.xxh64_digest(b"^" + text[:k].encode()) if len(text) >= k else whole for k in STARTS]
        out.append(b"".join((whole, *starts)))
    return out


def gram_keys(hashes: bytes) -> np.ndarray:
    """32-bit keys of the words, their beginnings, neighbouring pairs, and pairs with one or two words between."""
    each = np.frombuffer(hashes, "<u8").reshape(-1, 1 + len(STARTS))
    ids = each[:, 0]
    with np.errstate(over="ignore"):
        grams = np.concatenate((
            each.ravel(), (ids[:-1] * _PAIR) ^ (ids[1:] * _NEXT), (ids[:-2] * _SKIP) ^ (ids[2:] * _NEXT),
            (ids[:-3] * _SKIP + _PAIR) ^ (ids[3:] * _NEXT),
        ))
        grams ^= grams >> _FOLD
        grams *= _PAIR
    return (grams >> _FOLD).astype(np.uint32)


@dataclass
class Weights:
    """Sorted keys with a weight, the weights, and the bias: what is left of the model after L1."""

    keys: np.ndarray
    values: np.ndarray
    bias: float

    def table(self) -> np.ndarray:
        known = np.zeros(_SLOTS, bool)
        known[self.keys & np.uint32(_SLOTS - 1)] = True
        return known

    def score(self, grams: np.ndarray, known: np.ndarray) -> float:
        """Probability of label 1; each gram counts once."""
        total = self.bias
        if len(self.keys):
            likely = np.unique(grams[known[grams & np.uint32(_SLOTS - 1)]])
            at = np.minimum(np.searchsorted(self.keys, likely), len(self.keys) - 1)
            total += float(self.values[at[self.keys[at] == likely]].sum())
        return float(1 / (1 + np.exp(-np.clip(total, -35, 35))))


def ftrl(
    examples: list[np.ndarray], y: np.ndarray, epochs: int = 8, alpha: float = 2.0, beta: float = 1.0, l1: float = 6.0,
    l2: float = 0.0, seed: int = 7,
) -> Weights:
    """FTRL-proximal over examples of distinct keys, with a rate of its own for each key.

    Keys that occur in one example alone get no weight. Labels of one kind, or none, leave the bias only.
    """
    share = float(np.clip(y.mean(), 1e-3, 1 - 1e-3)) if len(y) else 0.5
    empty = Weights(np.zeros(0, np.uint32), np.zeros(0), float(np.log(share / (1 - share))))
    if len(np.unique(y)) < 2:
        return empty
    keys, counts = np.unique(np.concatenate(examples), return_counts=True)
    keys = keys[counts > 1]
    if not len(keys):
        return empty
    rows = []
    for grams in examples:
        at = np.minimum(np.searchsorted(keys, grams), len(keys) - 1)
        rows.append(at[keys[at] == grams])
    z, n = np.zeros(len(keys)), np.zeros(len(keys))
    bias_z = bias_n = bias = 0.0
    order = np.random.default_rng(seed)
    for _ in range(epochs):
        for i in order.permutation(len(rows)):
            at = rows[i]
            w = -(z[at] - np.sign(z[at]) * l1) / ((beta + np.sqrt(n[at])) / alpha + l2) * (np.abs(z[at]) > l1)
            g = 1 / (1 + np.exp(-np.clip(w.sum() + bias, -35, 35))) - y[i]
            grown = n[at] + g * g
            z[at] += g - (np.sqrt(grown) - np.sqrt(n[at])) / alpha * w
            n[at] = grown
            bias_z += g - (np.sqrt(bias_n + g * g) - np.sqrt(bias_n)) / alpha * bias
            bias_n += g * g
            bias = -bias_z / ((beta + np.sqrt(bias_n)) / alpha)
    w = -(z - np.sign(z) * l1) / ((beta + np.sqrt(n)) / alpha + l2) * (np.abs(z) > l1)
    kept = w != 0
    return Weights(keys[kept], w[kept], float(bias))


def train(docs: DataFrame, labels: DataFrame, train_on: Column, most_rows: int = SAMPLE_ROWS, most_words: int = SAMPLE_WORDS,
          **settings) -> Weights:
    """Weights from a bounded sample: at most ``most_rows`` labelled rows for which ``train_on`` holds.

    The driver gets the hashed grams of documents of at most ``most_words`` words. Null labels and ids are left
    out; an id with several labels counts once (the largest).
    """
    known = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & train_on)
    chosen = sample(known.groupBy("doc_id").agg(F.max("toxic").alias("_label")), most_rows)
    texts = docs.select("doc_id", "text").join(chosen.select("doc_id"), "doc_id", "left_semi")

    def make():
        cache = WordCache(word_keys)

        def run(texts):
            words = [t.split() for t in texts]
            known = cache.of(words)
            out = []
            for ws in words:
                grams = np.unique(gram_keys(b"".join([known[w] for w in ws]))) if len(ws) <= most_words else None
                out.append(None if grams is None else grams.tobytes())
            return [out]

        return run

    grams = map_texts(texts, make, "grams binary").where(F.col("grams").isNotNull())
    rows = grams.join(chosen, "doc_id").orderBy("doc_id").toPandas()
    return ftrl([np.frombuffer(g, np.uint32) for g in rows["grams"]], rows["_label"].to_numpy(np.float64), **settings)


def scored(docs: DataFrame, weights: Weights) -> DataFrame:
    """(doc_id, score) of every whole text; null and empty texts get the score of the bias."""

    def make():
        cache = WordCache(word_keys, 50_000)
        slots = weights.table()

        def run(texts):
            words = [t.split() for t in texts]
            known = cache.of(words)
            grams = (gram_keys(b"".join([known[w] for w in ws])) for ws in words)
            return [[weights.score(x, slots) for x in grams]]

        return run

    return map_texts(docs, make, "score double")


def classify(docs: DataFrame, labels: DataFrame, train_on: Column, **settings) -> DataFrame:
    """(doc_id, score): how likely each whole text is toxic, by a model of the labelled rows.

    Neither labels nor ids, languages or sources are inputs of a score. Repeated rows give repeated results; tables without
    labels give every document the same score, 0.5.
    """
    return scored(docs, train(docs, labels, train_on, **settings))
