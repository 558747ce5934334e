"""Alignment of two tokenizers against whole-text calls of both libraries and plain loops."""

import bisect
import hashlib
from collections import Counter, defaultdict

import pytest
from sentencepiece import SentencePieceProcessor
from tokenizers import Tokenizer

from loadspan.llm import token_align

ODD = [
    None, "", " ", "   ", "\n", "\n\n", "a", "  two  spaces ", "line\nnext\n\nlast\n ", " \n x\t\ty \r\n z", "é漢😀ﬁ Ⅳ é", "naïve, café!!! über### x",
    "<|endoftext|> a<|endoftext|>", "<s>x</s> <unk> <0x0A>", "a ▁ b", "▁", "no break  space", "\x00\x1c\x85 \x1fq", "a" * 700, "漢" * 300, "don't I'LL it's\n'tis",
    "Wort.\nNext line, word;word", "tab\tand\x0b\x0c\r\nlines", "same words here", "same words here", "word " * 3000, "👩‍👩‍👧 ok", "é combining",
]


@pytest.fixture(scope="module")
def libraries(byte_bpe, pieces):
    a = Tokenizer.from_file(byte_bpe)
    a.encode_special_tokens = True
    return a, SentencePieceProcessor(model_file=pieces)


def whole(libraries, text):
    """Ids and byte ends of a space and the text from calls over the whole text, by decoded bytes alone."""
    a, b = libraries
    if not text:
        return None
    symbols = {c: x for x, c in token_align.BYTE_SYMBOLS.items()}
    a_ids = a.encode(" " + text, add_special_tokens=False).ids
    b_ids = b.encode(text)
    sides = []
    for ids, raw in (
        (a_ids, [bytes(symbols[c] for c in a.id_to_token(i)) for i in a_ids]),
        (b_ids, [bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode() for i in b_ids]),
    ):
        if b"".join(raw) != (" " + text).encode():
            return None
        ends, at = [], 0
        for x in raw:
            at += len(x)
            ends.append(at)
        sides += [ids, ends]
    return sides


def brute(libraries, texts):
    """The columns of every text: overlaps by comparing the ranges of all tokens between common ends."""
    found, docs = [], Counter()
    for text in texts:
        sides = whole(libraries, text)
        if sides is None:
            found.append(None)
            continue
        a, ae, b, be = sides
        groups, links = [], []
        every = [list(zip(a, [0, *ae], ae)), list(zip(b, [0, *be], be))]
        low = [0, 0]
        for cut in sorted(set(ae) & set(be)):
            high = [bisect.bisect_right(ae, cut), bisect.bisect_right(be, cut)]
            xs, ys = (side[s:e] for side, s, e in zip(every, low, high))
            groups.append(",".join(str(x[0]) for x in xs) + "|" + ",".join(str(y[0]) for y in ys))
            links += [(x[0], y[0]) for x in xs for y in ys if x[1] < y[2] and y[1] < x[2]]
            low = high
        docs.update(set(links))
        found.append((a, b, groups, links))
    most = defaultdict(int)
    for (a, _), n in docs.items():
        most[a] = max(most[a], n)
    out = []
    for f in found:
        if f is None:
            out.append((0, 0, 0, 0, 0, 0, ""))
            continue
        a, b, groups, links = f
        out.append((
            len(a), len(b), len(groups), len(links), sum(docs[x] == most[x[0]] for x in links), sum(docs[x] for x in links),
            hashlib.sha256(";".join(groups).encode()).hexdigest(),
        ))
    return out


def columns(frame):
    return {r.doc_id: tuple(r)[1:] for r in frame.select(
        "doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256").collect()}


@pytest.mark.parametrize("most", [1, 40, 1 << 20])
def test_odd_texts_match_brute_force(docs, libraries, byte_bpe, pieces, most):
    got = columns(token_align.measure(docs(ODD), byte_bpe, pieces, most))
    want = brute(libraries, ODD)
    for i, text in enumerate(ODD):
        assert got[i] == want[i], text


def test_whole_table_matches_brute_force(given, libraries, byte_bpe, pieces):
    rows = given("documents").select("doc_id", "text").collect()
    got = columns(token_align.measure(given("documents"), byte_bpe, pieces))
    want = brute(libraries, [r.text for r in rows])
    assert len(got) == len(rows)
    for r, w in zip(rows, want, strict=True):
        assert got[r.doc_id] == w


def test_spans_match_whole_text_calls(docs, libraries, byte_bpe, pieces):
    got = {r.doc_id: r for r in token_align.align(docs(ODD), byte_bpe, pieces).collect()}
    for i, text in enumerate(ODD):
        want = whole(libraries, text)
        r = got[i]
        if want is None:
            assert r.a_ids is None and r.b_ids is None
        else:
            assert [r.a_ids, r.a_ends, r.b_ids, r.b_ends] == want, text


def test_empty_table_null_ids_and_repeated_rows(docs, byte_bpe, pieces):
    frame = docs(["one text", "one text", None])
    assert token_align.measure(frame.where("false"), byte_bpe, pieces).count() == 0
    twice = token_align.measure(frame.selectExpr("cast(null as bigint) AS doc_id", "text", "n"), byte_bpe, pieces).collect()
    assert len(twice) == 3 and all(r.doc_id is None for r in twice)
    assert {r.count_sum for r in twice} == {0, 2 * max(r.n_links for r in twice)}


def test_units_are_put_together_from_parts(byte_bpe, pieces):
    aligner = token_align.Aligner(byte_bpe, pieces)
    assert aligner.split
    aligner.aligned(["word, word; word\nword"])
    assert set(aligner.known.fresh) == {" word", "word", ",", ";", "\n"}


def test_parts_are_encoded_in_runs_as_each_alone(byte_bpe, pieces, monkeypatch):
    aligner = token_align.Aligner(byte_bpe, pieces)
    plain = [f" {x}{y}" for x in ("was", "Wörter", "漢é", "12ab", "naïve😀") for y in ("", "n", "ing", "ß", "7")] + ["\nline", "\n\n x", " \t y"]
    odd = [" a▁b", " \x00x", " tab\t", "  ", ",", "word", " " + "a" * 300]
    alone = [a and token_align.links(*a, aligner.names) for a in aligner.spans(plain + odd)]
    assert False in alone and not all(aligner._runs(odd[:1] + plain))
    assert aligner._parts(plain + odd) == alone

    calls, spans = [], aligner.spans
    monkeypatch.setattr(aligner, "spans", lambda parts: calls.append(len(parts)) or spans(parts))
    assert aligner._parts(plain) == alone[:len(plain)]
    assert sum(calls) == 1


def test_a_run_whose_parts_are_not_ends_of_tokens_is_not_cut():
    tokens = ([5, 6], [2, 4], [7, 8], [2, 4])
    shown = [str(i) + mark for mark in ",|;\n" for i in range(9)]
    assert [x[:3] for x in token_align.run_links(*tokens, ["ab", "cd"], shown)] == [(1, 1, "5|7"), (1, 1, "6|8")]
    assert [x[:3] for x in token_align.run_links(*tokens, ["abcd"], shown)] == [(2, 2, "5|7;6|8")]
    assert token_align.run_links(*tokens, ["abc", "d"], shown) is None


def test_parts_of_characters_are_refined():
    assert token_align.partial("é".encode()[:1]) and not token_align.partial("é".encode())
    raw = [b"\xc3", b"\xa9", b"ab"]
    assert token_align.refine([2, 2, 4], [0, 1, 2], raw, [True, True, False]) == [1, 2, 4]
    assert token_align.refine([2, 4], [2, 2], raw, [True, True, False]) == [2, 4]
