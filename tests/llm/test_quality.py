"""Quality rules, the boosted trees and the toxicity model."""

import math
import re
from collections import Counter

import numpy as np
import pytest
import sentencepiece
from pyspark.sql import functions as F

from loadspan.llm import boosted, quality_rules, toxicity
from loadspan.llm.queries import fold

ODD = [None, "", " \n\t ", "one", "a b a b a b a b", "x\nx\n\nx\r\nX", "#*$%&|<>", "no break", "日本語 テキスト", "é" * 4000,
       "w " * 20000, "a b c a b c x", "same line\nsame line\nother\n \n "]

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def base(text):
    text = text or ""
    words = WORD.findall(text)
    windows = Counter(tuple(words[i:i + 3]) for i in range(len(words) - 2))
    inside = {i + k for i in range(len(words) - 2) if windows[tuple(words[i:i + 3])] > 1 for k in range(3)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    failed = len(words) < 50 or 100 * len(inside) > 50 * len(words)
    return (len(words), sum(map(len, words)), sum(text.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(inside), failed)


def measured(row):
    return (row.n_words, row.word_chars, row.n_symbols, row.n_dup_lines, row.n_repeat_words, row.base_failed)


def test_base_rules_of_odd_texts(docs, pieces):
    rows = {r.doc_id: r for r in quality_rules.measure(docs(ODD), pieces).collect()}
    for i, text in enumerate(ODD):
        assert measured(rows[i]) == base(text), text
        assert not (rows[i].kept and rows[i].base_failed)


def test_base_rules_and_fertility_of_the_whole_table(given, pieces):
    model = sentencepiece.SentencePieceProcessor(model_file=pieces)
    rows = {r.doc_id: r for r in quality_rules.measure(given("documents"), pieces).collect()}
    for r in given("documents").collect():
        got = rows[r.doc_id]
        assert measured(got) == base(r.text)
        ids = [i for w in WORD.findall(r.text or "") for i in model.encode(w)]
        assert got.n_tokens == len(ids)
        if len(ids) > 1:
            pairs = sum(n * (n - 1) for n in Counter(ids).values())
            want = math.log2(len(ids) * (len(ids) - 1) / pairs) if pairs else 64.0
            assert got.token_entropy == pytest.approx(want)
            assert got.chars_per_token == pytest.approx(got.word_chars / len(ids))


def test_rules_reject_junk_and_keep_prose(given, pieces):
    rows = quality_rules.measure(given("documents"), pieces).join(given("labels"), "doc_id").where("NOT base_failed").collect()
    assert all(r.kept == bool(r.quality) for r in rows)


def test_keep_has_all_columns(docs, given, pieces):
    good = given("documents").join(given("labels").where("quality = 1"), "doc_id").where("length(text) > 2000").first().text
    kept = quality_rules.keep(docs([good, None, "short", good]), pieces)
    assert kept.columns == ["doc_id", "text", "lang", "source", "score", "n", "component"]
    assert sorted(r.doc_id for r in kept.collect()) == [0, 3]
    assert quality_rules.keep(docs([good]).where("false"), pieces).count() == 0


@pytest.mark.parametrize("text,script", [("abc", "latin"), ("日本", "han"), ("при вет", "cyrillic"), ("12 .", "other"), ("", "other"), ("καλ", "greek")])
def test_scripts(text, script):
    assert quality_rules.main_script(text.encode()) == script


def test_flat_trees_equal_a_walk():
    rng = np.random.default_rng(1)
    x = rng.random((400, 5))
    y = ((x[:, 0] > 0.5) ^ (x[:, 3] > 0.3)).astype(float)
    model = boosted.fit(x, y, trees=30, depth=3)
    score = model.score(x)
    assert ((score > 0.5) == y).mean() > 0.97
    for row, s in zip(x[:40], score):
        total = model.bias
        for t in range(30):
            node = 0
            while node < 7:
                node = 2 * node + 1 + int(row[model.feature[t, node]] > model.threshold[t, node])
            total += model.leaf[t, node - 7]
        assert s == pytest.approx(1 / (1 + math.exp(-total)))
    assert len(model.score(x[:0])) == 0
    assert (boosted.fit(x, np.ones(400)).score(x) > 0.99).all()
    assert boosted.fit(x[:0], y[:0]).score(x[:1])[0] == 0.5


def test_classifier_on_held_out_rows(given):
    held_out = fold(5) == 0
    scores = boosted.classify(given("documents"), given("labels"), ~held_out)
    assert scores.count() == given("documents").count()
    rows = scores.join(given("labels"), "doc_id").where(held_out).collect()
    assert len(rows) > 10
    assert np.mean([(r.score >= boosted.THRESHOLD) == bool(r.quality) for r in rows]) > 0.9


def test_classifier_of_odd_texts(docs, given, spark):
    labels = spark.createDataFrame([(0, 1), (1, 0), (None, 1), (3, None)], "doc_id bigint, quality int")
    rows = boosted.classify(docs(ODD), labels, F.lit(True)).collect()
    assert len(rows) == len(ODD) and all(0 <= r.score <= 1 for r in rows)
    assert boosted.classify(docs(ODD).where("false"), labels, F.lit(True)).count() == 0
    kept = boosted.keep(docs(ODD), labels.where("false"), F.lit(True))
    assert kept.count() == len(ODD) and kept.columns == docs(ODD).columns


def test_toxicity_on_held_out_rows(given):
    held_out = fold(3) == 1
    rows = toxicity.classify(given("documents"), given("labels"), ~held_out).join(given("labels"), "doc_id").where(held_out).collect()
    clean = [r for r in rows if not r.toxic]
    assert np.mean([r.score < toxicity.THRESHOLD for r in clean]) > 0.98


def test_ftrl_finds_the_word(docs, spark):
    words = ["alpha", "beta", "gamma", "delta", "omega", "sigma", "kappa", "theta"]
    rng = np.random.default_rng(2)
    texts, marks = [], []
    for i in range(400):
        text = list(rng.choice(words, 30))
        if i % 4 == 0:
            text[i % 30] = "VILE," if i % 8 else "vile"
        texts.append(" ".join(text))
        marks.append(int(i % 4 == 0))
    texts += [None, "", "vile " * 30000, "alpha beta"]
    labels = spark.createDataFrame(list(enumerate(marks)), "doc_id bigint, toxic int")
    rows = {r.doc_id: r.score for r in toxicity.classify(docs(texts), labels, F.col("doc_id") % 2 == 0).collect()}
    assert all((rows[i] >= toxicity.THRESHOLD) == bool(m) for i, m in enumerate(marks))
    assert rows[402] >= toxicity.THRESHOLD and rows[400] == rows[401] < 0.5 and rows[403] < 0.5


def test_toxicity_without_labels(docs, spark):
    labels = spark.createDataFrame([], "doc_id bigint, toxic int")
    rows = toxicity.classify(docs(["a b", None]), labels, F.lit(True)).collect()
    assert {r.score for r in rows} == {0.5}
    assert toxicity.classify(docs(["a"]).where("false"), labels, F.lit(True)).count() == 0


@pytest.mark.parametrize("seed", range(4))
def test_a_split_is_the_best_of_all(seed):
    rng = np.random.default_rng(seed)
    x = np.round(rng.random((200, 4)), 2)
    y = (x[:, seed % 4] + rng.random(200) > 1).astype(float)
    bins, ridge, least = 16, 1.0, 10
    model = boosted.fit(x, y, trees=1, depth=1, bins=bins, rate=1.0, ridge=ridge, least_rows=least)
    p = y.mean()
    g, h = p - y, np.full(200, p * (1 - p))

    def gain(inside):
        part = lambda m: g[m].sum() ** 2 / (h[m].sum() + ridge)
        return part(inside) + part(~inside) - g.sum() ** 2 / (h.sum() + ridge)

    cuts = [(j, e) for j in range(4) for e in np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1]))]
    allowed = [(gain(x[:, j] <= e), j, e) for j, e in cuts if least <= (x[:, j] <= e).sum() <= 200 - least]
    left = x[:, model.feature[0, 0]] <= model.threshold[0, 0]
    assert gain(left) == pytest.approx(max(allowed)[0])
    assert model.leaf[0] == pytest.approx([-g[left].sum() / (h[left].sum() + ridge), -g[~left].sum() / (h[~left].sum() + ridge)])


def test_ftrl_equals_a_plain_loop():
    rng = np.random.default_rng(9)
    examples = [np.unique(rng.integers(0, 60, 12)).astype(np.uint32) for _ in range(80)]
    y = np.array([float(3 in e or 7 in e) for e in examples])
    alpha, beta, l1, l2, epochs = 0.7, 1.0, 0.4, 0.1, 3
    got = toxicity.ftrl(examples, y, epochs, alpha, beta, l1, l2, seed=5)
    often = {k for k, n in Counter(int(k) for e in examples for k in e).items() if n > 1}
    z, n = dict.fromkeys(often, 0.0), dict.fromkeys(often, 0.0)
    bz = bn = bias = 0.0

    def weight(k):
        return 0.0 if abs(z[k]) <= l1 else -(z[k] - math.copysign(l1, z[k])) / ((beta + math.sqrt(n[k])) / alpha + l2)

    order = np.random.default_rng(5)
    for _ in range(epochs):
        for i in order.permutation(len(examples)):
            keys = [int(k) for k in examples[i] if int(k) in often]
            w = {k: weight(k) for k in keys}
            g = 1 / (1 + math.exp(-(sum(w.values()) + bias))) - y[i]
            for k in keys:
                z[k] += g - (math.sqrt(n[k] + g * g) - math.sqrt(n[k])) / alpha * w[k]
                n[k] += g * g
            bz += g - (math.sqrt(bn + g * g) - math.sqrt(bn)) / alpha * bias
            bn += g * g
            bias = -bz / ((beta + math.sqrt(bn)) / alpha)
    want = {k: weight(k) for k in often if weight(k)}
    assert got.bias == pytest.approx(bias) and set(map(int, got.keys)) == set(want)
    assert list(got.values) == pytest.approx([want[int(k)] for k in got.keys])
    known = got.table()
    for e in examples[:20]:
        total = bias + sum(want.get(int(k), 0.0) for k in e)
        assert got.score(np.repeat(e, 2), known) == pytest.approx(1 / (1 + math.exp(-total)))


def test_toxic_rows_of_the_given_table_are_found(spark):
    table = lambda name: spark.read.parquet(f"/root/testdata/sf0.1/{name}.parquet")
    held_out = fold(3) == 1
    rows = toxicity.classify(table("documents"), table("labels"), ~held_out).join(table("labels"), "doc_id").where(held_out).collect()
    toxic = [r.score >= toxicity.THRESHOLD for r in rows if r.toxic]
    assert len(toxic) >= 50 and np.mean(toxic) >= 0.75
    assert np.mean([r.score < toxicity.THRESHOLD for r in rows if not r.toxic]) > 0.98


def test_repeated_rows_and_null_ids_are_kept(docs, pieces, spark):
    frame = docs(["some words here", "some words here", "other", None]).selectExpr("CASE WHEN doc_id > 1 THEN NULL ELSE 5L END AS doc_id", "text", "lang", "score")
    labels = spark.createDataFrame([(5, 1, 0)], "doc_id bigint, quality int, toxic int")
    for got in (quality_rules.measure(frame, pieces), boosted.classify(frame, labels, F.lit(True)), toxicity.classify(frame, labels, F.lit(True))):
        assert sorted((r.doc_id for r in got.collect()), key=str) == [5, 5, None, None]
