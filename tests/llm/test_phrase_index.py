"""Collocations against brute-force counts of all phrases, and the index against plain search."""

import random
import re
from collections import Counter

import numpy as np
import pytest
from compare import connect, difference

from loadspan.llm import phrase_index

MARKS = re.compile(r"[.,;:!?\x0A-\x0D]")


def brute(rows, least, longest, top):
    """Rows of (lang, text): count every phrase, then follow the definition word by word."""
    n, f = Counter(), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        folded = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for piece in MARKS.split(folded):
            words = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(words)
            for k in range(1, longest + 1):
                for i in range(len(words) - k + 1):
                    f[lang, tuple(words[i:i + k])] += 1
    found = {x: a for x, a in f.items() if a >= least and len(x[1]) > 1}
    out = []
    for (lang, words), a in found.items():
        k = len(words)
        if any(
            g == lang and len(w) > k and b >= a and any(w[i:i + k] == words for i in range(len(w) - k + 1))
            for (g, w), b in found.items()
        ):
            continue
        score, cut = min(
            (1000 * a * n[lang] // (f[lang, words[:j]] * f[lang, words[j:]]), j) for j in range(1, k)
        )
        out.append((lang, " ".join(words), a, f[lang, words[:cut]], f[lang, words[cut:]], n[lang], score))
    ranked = []
    for lang in {r[0] for r in out}:
        mine = sorted((r for r in out if r[0] == lang), key=lambda r: (-r[6], -r[2], r[1].encode()))[:top]
        ranked += [(r[0], i, *r[1:]) for i, r in enumerate(mine, 1)]
    return sorted(ranked)


def texts(seed, docs=60):
    rng = random.Random(seed)
    words = ["a", "b", "A", "c", "é", "x\x00", "no\xa0break", "the", "d"]
    phrases = ["new york city", "a a a a a a", "of the", "a b a b a b", "\tIn  New\tYork", "one. two, three; new york"]
    out = []
    for _ in range(docs):
        parts = [rng.choice(words if rng.random() < 0.6 else phrases) for _ in range(rng.randint(0, 60))]
        out.append((rng.choice(["en", "de", None, "und"]), "".join(p + rng.choice([" ", " ", " ", "  ", "\n", ".", ",", "\r"]) for p in parts)))
    return [*out, ("en", None), ("en", ""), (None, " \t.\n"), ("fr", "alone"), *out[:5]]


@pytest.mark.parametrize(("seed", "least", "longest", "top", "shard"), [(0, 3, 5, 2000, 50), (1, 10, 5, 4, 10_000), (2, 2, 5, 2000, 1), (3, 5, 3, 7, 200), (4, 4, 2, 9, 100)])
def test_matches_brute_force(spark, seed, least, longest, top, shard):
    rows = texts(seed)
    frame = spark.createDataFrame([(*r, 1, "x", 2) for r in rows], "lang string, text string, a long, phrase string, shard long").repartition(3)
    got = phrase_index.collocations(frame, least, longest, top, shard)
    want = brute(rows, least, longest, top)
    assert sorted(tuple(r) for r in got.collect()) == want
    assert len(want) > 3


def test_empty_table_and_no_candidates(spark):
    frame = spark.createDataFrame([("en", "some words here")], "lang string, text string")
    assert phrase_index.collocations(frame.where("false")).count() == 0
    assert phrase_index.collocations(frame).count() == 0


def test_scores_beyond_64_bits_are_exact(spark):
    a, n, l, r = 10**13 + 7, 10**14 + 3, 10**14 + 1, 10**13 + 9
    row = spark.sql(f"SELECT (cast(1000 as decimal(4,0)) * cast({a} as decimal(17,0)) * cast({n} as decimal(17,0))) div (cast({l} as decimal(19,0)) * cast({r} as decimal(19,0))) AS s")
    assert row.first().s == 1000 * a * n // (l * r)


@pytest.mark.parametrize("seed", range(4))
def test_index_finds_all_phrases(seed):
    rng = np.random.default_rng(seed)
    text = np.append(0, rng.integers(0, 5, 400)).astype(np.int64)
    text[-1] = 0
    shard = phrase_index.Shard(text, 5, 4)
    found = shard.words()
    for k in range(2, 6):
        found = shard.left(found) if (k + seed) % 2 else shard.right(found)
        want = Counter(tuple(int(x) for x in text[i:i + k]) for i in range(len(text) - k + 1) if text[i:i + k].all())
        got = {tuple(int(x) for x in g): int(c) for g, c in zip(found.grams, found.count)}
        assert got == want


def test_slices_keep_pieces_whole():
    text = b"aa bb.cc" * 50
    cut = list(phrase_index.slices(text, 20))
    assert b"".join(cut) == text and len(cut) > 5 and all(c.endswith(b".") for c in cut[:-1])


def test_given_table_matches_the_sql(spark, given, sf_dir):
    got = phrase_index.collocations(given("documents"), least=20, top=300).toPandas()
    want = connect(sf_dir).execute(phrase_index.oracle(least=20, top=300)).df()
    assert difference(got, want) is None and len(got) > 20
