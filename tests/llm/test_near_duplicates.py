"""Components, the embedding forest and the Jaccard join against brute force."""

import random

import numpy as np
import pytest

from loadspan.llm import embed_forest, jaccard
from loadspan.llm.graph import components


class Groups:
    def __init__(self, ids):
        self.up = {i: i for i in ids}

    def find(self, i):
        while self.up[i] != i:
            i = self.up[i]
        return i

    def link(self, a, b):
        a, b = sorted((self.find(a), self.find(b)))
        self.up[b] = a


@pytest.mark.parametrize("seed", range(2))
def test_components(spark, seed):
    rng = random.Random(seed)
    edges = [(rng.randrange(200), rng.randrange(200)) for _ in range(90)]
    edges += [(i, i + 1) for i in range(300, 380)] + [(500, i) for i in range(400, 600)] + [(7, 7), (None, 3)]
    groups = Groups(range(601))
    for a, b in edges:
        if a is not None:
            groups.link(a, b)
    got = {r.id: r.component for r in components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    want = {i: groups.find(i) for i in range(601)}
    assert all(want[i] == c for i, c in got.items())
    assert all(i in got for a, b in edges if a is not None and a != b for i in (a, b))
    assert components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


def brute_vectors(rows, least=0.9):
    """n_links and component of each row of (id, vector)."""
    good = {}
    for k, (i, v) in enumerate(rows):
        if i is None or v is None or any(x is None or not np.isfinite(x) for x in v) or not any(v):
            continue
        x = np.array(v, np.float64) / max(map(abs, v))
        good[k] = x / np.linalg.norm(x)
    groups, links = Groups([i for i, _ in rows if i is not None]), dict.fromkeys(range(len(rows)), 0)
    keys = list(good)
    for a in range(len(keys)):
        for b in range(a + 1, len(keys)):
            if len(good[keys[a]]) == len(good[keys[b]]) and good[keys[a]] @ good[keys[b]] >= least:
                links[keys[a]] += 1
                links[keys[b]] += 1
                groups.link(rows[keys[a]][0], rows[keys[b]][0])
    return [(i, links[k], None if i is None else groups.find(i)) for k, (i, _) in enumerate(rows)]


def run_vectors(spark, rows, **settings):
    frame = spark.createDataFrame([(i, v, "x", 5) for i, v in rows], "vec_id bigint, embedding array<float>, id string, n_links int")
    out = embed_forest.near(frame.repartition(3), **settings).collect()
    assert all(r.kept == (r.vec_id == r.component_id) for r in out if r.vec_id is not None)
    return sorted(((r.vec_id, r.n_links, r.component_id) for r in out), key=str)


def test_vectors_with_faults(spark):
    rows = [(0, [1.0, 0.0, 0.0]), (1, [2.0, 0.0, 0.0]), (2, None), (3, [0.0, 0.0, 0.0]), (4, [1.0, None, 0.0]), (5, [float("nan"), 1.0, 0.0]),
            (6, [float("inf"), 1.0, 0.0]), (7, [1.0, 0.1, 0.0]), (8, [-1.0, 0.0, 0.0]), (9, [1.0, 0.0]), (10, []), (None, [1.0, 0.0, 0.0]),
            (12, [1e30, 0.0, 0.0]), (13, [0.0, 1.0, 0.0]), (14, [0.0, 1.0, 0.0]), (15, [0.0, 1.0, -0.0])]
    rows = [(i, None if v is None else [None if x is None else float(np.float32(x)) for x in v]) for i, v in rows]
    assert run_vectors(spark, rows) == sorted(brute_vectors(rows), key=str)


def test_no_vectors(spark):
    assert run_vectors(spark, []) == []
    assert run_vectors(spark, [(1, None)]) == [(1, 0, 1)]


@pytest.mark.parametrize("settings", [{}, {"leaf": 32, "block": 64}])
def test_vectors_in_groups(spark, settings):
    rng = np.random.default_rng(4)
    rows = []
    for size, noise in [(1, 0)] * 150 + [(2, 0.03)] * 40 + [(30, 0.03), (200, 0.02), (3, 0.09)]:
        centre = rng.standard_normal(16)
        for _ in range(size):
            rows.append((len(rows), (centre + noise * rng.standard_normal(16)).astype(np.float32).tolist()))
    rows += [(len(rows) + k, rows[0][1]) for k in range(50)]
    assert run_vectors(spark, rows, **settings) == sorted(brute_vectors(rows), key=str)


def test_vectors_of_the_whole_table(spark, given):
    rows = [(r.vec_id, r.embedding) for r in given("embeddings").collect()]
    out = embed_forest.near(given("embeddings"), leaf=64).collect()
    assert sorted((r.vec_id, r.n_links, r.component_id) for r in out) == sorted(brute_vectors(rows))


def shingle_set(text, size=4):
    words = (text or "").encode().lower().split()
    if len(words) < size:
        return frozenset([tuple(words)] if words else [])
    return frozenset(tuple(words[i:i + size]) for i in range(len(words) - size + 1))


def brute_texts(rows):
    sets = [shingle_set(t) for _, t in rows]
    groups = Groups([i for i, _ in rows if i is not None])
    for a in range(len(rows)):
        for b in range(a):
            common = len(sets[a] & sets[b]) if None not in (rows[a][0], rows[b][0]) else 0
            if common and 100 * common >= 85 * (len(sets[a]) + len(sets[b]) - common):
                groups.link(rows[a][0], rows[b][0])
    return sorted(((i, len(s), None if i is None else groups.find(i)) for (i, _), s in zip(rows, sets)), key=str)


def joined(frame):
    return sorted(((r.doc_id, r.n_shingles, r.component_id) for r in jaccard.join(frame).collect()), key=str)


def near_copies(seed):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(4))
    passage = [word() for _ in range(40)]
    texts = []
    for size, edits in [(1, 0)] * 30 + [(2, 1)] * 20 + [(60, 2), (25, 4), (9, 8)]:
        body = [word() for _ in range(rng.choice([20, 60, 150]))]
        if rng.random() < 0.5:
            body += passage
        for _ in range(size):
            text = list(body)
            for _ in range(rng.randint(0, edits)):
                text[rng.randrange(len(text))] = word()
            texts.append(" ".join(text))
    return texts + texts[:25] + [texts[0].upper()] * 40


@pytest.mark.parametrize("seed", range(2))
def test_near_copies(docs, seed):
    texts = near_copies(seed)
    assert joined(docs(texts)) == brute_texts(list(enumerate(texts)))


def test_frequent_shingles_change_nothing(docs, monkeypatch):
    monkeypatch.setattr(jaccard, "HOT_COUNT", 2)
    texts = near_copies(5)
    assert joined(docs(texts)) == brute_texts(list(enumerate(texts)))


def test_vectors_of_several_lengths(spark):
    rng = np.random.default_rng(3)
    rows = [(i, rng.standard_normal(n).astype(np.float32).tolist()) for i, n in enumerate([3, 3, 4, 8, 8, 5000] * 8)]
    rows += [(100 + i, [float(np.float32(x * 2)) for x in v]) for i, v in rows[::3]] + [(300, [1.0]), (301, [2.0]), (302, [-1.0])]
    want = sorted(brute_vectors(rows), key=str)
    assert run_vectors(spark, rows) == want and run_vectors(spark, rows, leaf=4, block=6, trees=20, spill=1.0) == want
    # one more vector of another length takes no link from the others
    two = [(1, [1.0, 0.0, 0.0]), (2, [1.0, 0.1, 0.0])]
    assert [r[1] for r in run_vectors(spark, [*two, (3, [1.0, 0.0, 0.0, 0.0])])] == [1, 1, 0]


def test_odd_texts(docs):
    texts = [None, "", " \n", "a", "A", "a b", "b a", "a b c", "a b c d", "A B C D", "x " * 3000, "x " * 40, "é ü", "É ü", "no break", None]
    assert joined(docs(texts)) == brute_texts(list(enumerate(texts)))
    rows = list(zip([1, 1, 2, 3, None, None], ["a b c d e", "p q r s t", "a b c d e", "p q r s t", "a b c d e", None]))
    assert joined(docs([t for _, t in rows], ids=[i for i, _ in rows])) == brute_texts(rows)
    assert joined(docs(["a"]).where("false")) == []


def test_keep_one(docs):
    texts = ["a b c d e", "A b c d e", None, "", "f g h i", "f g h i", None]
    kept = jaccard.keep_one(docs(texts, ids=[3, 1, 2, 4, 5, 5, None]))
    assert sorted((r.doc_id for r in kept.collect()), key=str) == [1, 2, 4, 5, None]
    assert kept.columns == docs(texts).columns


def test_keep_one_keeps_every_text_of_an_id(docs):
    texts = ["a b c d e", "p q r s t", "p q r s t", "x y", None, None, "a b c d e", ""]
    frame = docs(texts, ids=[7, 7, 7, 8, 9, 9, 10, 9])
    first = sorted(map(str, jaccard.keep_one(frame).collect()))
    assert [(r.doc_id, r.text) for r in jaccard.keep_one(frame).orderBy("doc_id", "text").collect()] == [
        (7, "a b c d e"), (7, "p q r s t"), (8, "x y"), (9, None), (9, ""),
    ]
    assert sorted(map(str, jaccard.keep_one(frame.repartition(7)).collect())) == first
    assert jaccard.keep_one(frame.where("false")).count() == 0


def test_texts_of_the_whole_table(given):
    rows = [(r.doc_id, r.text) for r in given("documents").collect()]
    assert joined(given("documents")) == brute_texts(rows)


def test_texts_are_parted_by_ids_without_moving_them(docs, spark):
    frame = docs([f"text {i}" for i in range(500)], ids=[i % 400 for i in range(500)])
    wanted = spark.range(0, 40, 10).withColumnRenamed("id", "doc_id")
    others, some = jaccard.parted(spark.createDataFrame(frame.collect(), frame.schema), wanted)
    assert "Exchange" not in others._jdf.queryExecution().executedPlan().toString()
    assert sorted(map(str, others.union(some).collect())) == sorted(map(str, frame.collect()))
    assert {r.doc_id for r in others.collect()}.isdisjoint({0, 10, 20, 30}) and some.count() < 20
    assert jaccard.parted(frame, wanted.where("false"))[0].count() == 500
