"""Encoding, decoding and edit-aware counts against the tokenizers library."""

import hashlib
import random

import pytest
from tokenizers import Tokenizer

from loadspan.llm import bpe_tree, edit_counts

ODD = [None, "", " \t\n", "a", "a" * 3000, "the" * 900, "é日本" * 400, "<|endoftext|>" * 90, "x <|startoftext|>y", "It's I'LL 12,3",
       "tab\tand\x0b\x0c\r\nlines", "no break space", "é İ ß ﬁ", "\x00\x1c\x85", "word " * 5000]


@pytest.fixture(scope="module")
def library(word_bpe):
    return Tokenizer.from_file(word_bpe)


def test_encode_and_decode_match_the_library(docs, library, word_bpe):
    frame = docs(ODD)
    encoded = bpe_tree.encode(frame, word_bpe)
    ids = {r.doc_id: r.ids for r in encoded.collect()}
    texts = {r.doc_id: r.text for r in bpe_tree.decode(encoded, word_bpe).collect()}
    digests = {r.doc_id: r for r in bpe_tree.round_trip(frame, word_bpe).collect()}
    assert len(ids) == len(ODD)
    for i, text in enumerate(ODD):
        want = library.encode(text or "", add_special_tokens=False).ids
        plain = library.decode(want, skip_special_tokens=False)
        assert ids[i] == want, text
        assert texts[i] == plain
        assert digests[i].n_tokens == len(want)
        assert digests[i].ids_sha256 == hashlib.sha256(" ".join(map(str, want)).encode()).hexdigest()
        assert digests[i].decoded_sha256 == hashlib.sha256(plain.encode()).hexdigest()


def test_whole_table_matches_the_library(given, library, word_bpe):
    got = {r.doc_id: r.ids_sha256 for r in bpe_tree.round_trip(given("documents"), word_bpe).collect()}
    for r in given("documents").collect():
        want = library.encode(r.text or "", add_special_tokens=False).ids
        assert got[r.doc_id] == hashlib.sha256(" ".join(map(str, want)).encode()).hexdigest()


@pytest.mark.parametrize("seed", range(6))
def test_tree_concatenation_is_exact(library, word_bpe, seed):
    rng = random.Random(seed)
    bpe = bpe_tree.load(word_bpe)
    parts = [list("abcdehinorst"), ["the", "an", "ing", "tion"], ["=", "-", "!"], ["é", "日", "x", "<|endoftext|>", "'s", "9"]]
    for part in parts:
        word = "".join(rng.choice(part) for _ in range(rng.randint(600, 2500)))
        assert list(bpe.long_word(word)) == library.encode(word, add_special_tokens=False).ids


def test_empty_table_and_repeated_rows(docs, word_bpe, byte_bpe):
    assert bpe_tree.round_trip(docs(["a"]).where("false"), word_bpe).count() == 0
    rows = bpe_tree.round_trip(docs(["a b", "a b"], ids=[7, 7]), word_bpe).collect()
    assert [r.doc_id for r in rows] == [7, 7] and rows[0] == rows[1]
    assert edit_counts.count_edits(docs(["a"]).where("false"), byte_bpe).count() == 0


def full(library, text):
    return len(library.encode(text, add_special_tokens=False).ids)


@pytest.mark.parametrize("seed", range(5))
def test_edited_tree_equals_a_new_one(byte_bpe, seed):
    rng = random.Random(seed)
    library = Tokenizer.from_file(byte_bpe)
    library.encode_special_tokens = True
    counter = edit_counts.Counter(byte_bpe)
    bits = ["the", " ", "  ", "\n", " \n ", "'", "'re", "l", "9", "..", "é", "<|endoftext|>", "日", "a b c d e f g"]
    for _ in range(40):
        tree = edit_counts.build("".join(rng.choice(bits) for _ in range(rng.choice([0, 1, 5, 300]))), counter)
        for _ in range(5):
            start = rng.randint(0, len(tree.text))
            end = start + rng.choice([0, 1, 3, 60])
            new = "".join(rng.choice(bits) for _ in range(rng.choice([0, 1, 20])))
            want = tree.text[:start] + new + tree.text[end:]
            tree = edit_counts.edit(tree, start, end, new, counter)
            assert tree.text == want
            assert tree.total == full(library, want) == edit_counts.prefix(tree.tokens, len(tree.leaves))
            assert [s for leaf in tree.leaves for s in leaf] == list(map(len, edit_counts.PRETOKEN.findall(want)))


def test_counts_of_edited_documents(docs, byte_bpe):
    library = Tokenizer.from_file(byte_bpe)
    library.encode_special_tokens = True
    texts = [None, "", "mail a.b@c.example.org or 10.0.0.1 now", "word " * 3000 + "x@y.example.com" + " end" * 3000]
    rows = {r.doc_id: r for r in edit_counts.count_edits(docs(texts), byte_bpe).collect()}
    for i, text in enumerate(texts):
        edited = "[x]\n" + edit_counts.PRIVATE.sub("[private]", text or "")
        assert rows[i].n_tokens == full(library, text or "")
        assert rows[i].n_tokens_edited == full(library, edited)
    assert rows[3].n_reencoded < rows[3].n_pretokens / 10


def test_counts_of_the_whole_table(given, byte_bpe):
    library = Tokenizer.from_file(byte_bpe)
    library.encode_special_tokens = True
    got = {r.doc_id: r for r in edit_counts.count_edits(given("documents"), byte_bpe).collect()}
    for r in given("documents").collect():
        edited = f"[{r.source or ''}]\n" + edit_counts.PRIVATE.sub("[private]", r.text or "")
        assert (got[r.doc_id].n_tokens, got[r.doc_id].n_tokens_edited) == (full(library, r.text or ""), full(library, edited))


def test_large_texts_are_encoded_in_fragments(docs, library, word_bpe, monkeypatch):
    rng = random.Random(9)
    monkeypatch.setattr(bpe_tree, "LARGE_BYTES", 3000)
    texts = [
        "".join(rng.choice("abcdehinorst") for _ in range(30_000)), "the cat sat. " * 2000, "x" * 2999,
        " ".join("".join(rng.choice(["the", "é", "9", "!", "<|endoftext|>"]) for _ in range(rng.choice([2, 900]))) for _ in range(80)),
        " \n" * 4000, None,
    ]
    monkeypatch.setattr(bpe_tree.encode_large, "__defaults__", (700,))
    ids = sorted((r.doc_id, list(r.ids)) for r in bpe_tree.encode(docs(texts + texts[:1], ids=[*range(6), 0]), word_bpe).collect())
    assert [i for i, _ in ids] == [0, 0, 1, 2, 3, 4, 5]
    for i, got in ids:
        assert got == library.encode(texts[i] or "", add_special_tokens=False).ids
    rows = {r.doc_id: r for r in bpe_tree.round_trip(docs(texts), word_bpe).collect()}
    assert all(rows[i].ids_sha256 == hashlib.sha256(" ".join(map(str, got)).encode()).hexdigest() for i, got in ids)
