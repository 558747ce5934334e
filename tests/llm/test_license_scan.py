"""Licence scan against plain searches for phrases, substrings and chains."""

import random
import re
from functools import cache

import numpy as np
import pytest

from loadspan.llm import license_scan as scan_

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def base(text, phrases=scan_.PHRASES):
    ws = words(text)
    found = [(i, label) for p, label in phrases.items() for i in range(len(ws)) if ws[i:i + len(p.split())] == p.split()]
    starts = [i for i, _ in found]
    return len(ws), len(found), min(starts, default=None), max(starts, default=None), ",".join(sorted({x for _, x in found}))


MIT = scan_.TEMPLATES["mit"][0]
ODD = [
    None, "", " \n", "plain words of the software", "Released under the MIT License.", "mit\tlicense, MIT-license; (apache) license GENERAL public license",
    "the mit  licenses", "mit licenseé", "x é general_public-license", "mit mit license license", "general public general public license", MIT, "Some code.\n" + MIT + "\nand more",
    " ".join(MIT.split()[:90]), " ".join(w + (" inserted" if i % 15 == 14 else "") for i, w in enumerate(MIT.split())), "licensed under CC BY-NC 4.0.", "Licensed under CC BY 4.0",
    "licensed under cc", "word " * 4000 + "apache license", MIT * 3, "MIT\x00License", "K mit license",
]


def test_columns_match_plain_search(docs):
    got = {r.doc_id: r for r in scan_.scan(docs(ODD)).collect()}
    for i, text in enumerate(ODD):
        r = got[i]
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == base(text), text
        assert set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(",")) and 0 <= r.score <= 1
    label = {i: r.labels for i, r in got.items()}
    assert label[11] == label[12] == label[14] == label[19] == "mit" and label[15] == "cc-by-nc" and label[16] == "cc-by"
    assert label[3] == label[17] == "" and got[3].score == 0
    assert [(s.first, s.last, s.share) for s in got[12].spans] == [(2, 1 + len(words(MIT)), 1.0)]
    assert len(got[19].spans) == 3


def test_whole_table(given):
    rows = {r.doc_id: r for r in scan_.scan(given("documents")).collect()}
    for r in given("documents").collect():
        got = rows[r.doc_id]
        assert (got.n_words, got.n_base, got.first_word, got.last_word, got.base_labels) == base(r.text)
        assert ("cc-by-nc" in got.labels.split(",")) == ("licensed under cc by nc 4 0" in " ".join(words(r.text)))
        assert got.labels or got.score < scan_.SHARE


def test_rows_are_kept(docs):
    frame = docs(["mit license", "mit license", None])
    assert scan_.scan(frame.where("false")).count() == 0
    got = scan_.scan(frame.selectExpr("cast(null as bigint) AS doc_id", "text", "score AS labels")).collect()
    assert sorted(r.n_base for r in got) == [0, 1, 1]


@pytest.mark.parametrize("seed", range(20))
def test_matching_statistics_are_exact(seed):
    rng = random.Random(seed)
    sequences = [[rng.randint(1, 3) for _ in range(rng.randint(2, 14))] for _ in range(rng.randint(1, 6))]
    automaton = scan_.Automaton(sequences)
    text = [rng.randint(1, 4) for _ in range(80)]
    states, lengths = automaton.statistics(text)

    def places(part):
        return sorted((n, i + len(part) - 1) for n, s in enumerate(sequences) for i in range(len(s) - len(part) + 1) if s[i:i + len(part)] == part)

    for i, (state, length) in enumerate(zip(states, lengths)):
        longest = max((k for k in range(i + 2) if k == 0 or places(text[i + 1 - k:i + 1])), default=0)
        assert length == longest
        if length:
            assert sorted(automaton.ends[state]) == places(text[i + 1 - length:i + 1])


@pytest.mark.parametrize("seed", range(20))
def test_phrases_inside_phrases(seed):
    rng = random.Random(seed)
    phrases = {" ".join(rng.choices("abc", k=rng.randint(2, 4))): str(i) for i in range(5)}
    scanner = scan_.Scanner(phrases, {"t": ["a b c a b c a", "c c b a"]}, 2, 5, 0.5)
    text = " ".join(rng.choices("abcd", k=60))
    found, _ = scanner.scan(scanner.ids(text.encode()))
    want = [(i, label) for p, label in phrases.items() for i in range(60) if text.split()[i:i + len(p.split())] == p.split()]
    assert sorted(found) == sorted(want)


@pytest.mark.parametrize("seed", range(20))
def test_best_chain_matches_all_chains(seed):
    rng = random.Random(seed)
    matches = list({(rng.randint(0, 30), rng.randint(0, 30), rng.randint(2, 6)) for _ in range(9)})
    gap = 7

    @cache
    def best(k):
        word, at, n = matches[k]
        top = n
        for j, (w, t, m) in enumerate(matches):
            gain = min(n, word + n - w - m, at + n - t - m)
            if w < word and t < at and w + m >= word - gap and t + m >= at - gap and gain > 0:
                top = max(top, best(j) + gain)
        return top

    found = scan_.chains(matches, gap)
    assert max(c for _, _, c in found) == max(best(k) for k in range(len(matches)))


def test_long_texts_are_cut_at_spaces():
    text = b"mit license " * 500
    assert [w for part in scan_.words_of(text, 100) for w in part] == text.split()
    scanner = scan_.Scanner(scan_.PHRASES, {}, 4, 5, 0.5)
    assert len(scanner.scan(scanner.ids(text))[0]) == 500
    assert np.array_equal(scanner.ids(b""), np.zeros(0))
