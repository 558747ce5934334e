"""BPE encoding and decoding of whole texts; long unsplit runs by tree concatenation."""

from __future__ import annotations

import hashlib
import json
import os
import re
import uuid
from array import array
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loadspan.llm.common import WordCache, map_texts, raw_texts, spread, stage

#: A word of more bytes is not given to the library at once.
LONG_BYTES = 512
#: A text of more bytes is encoded by many tasks, in fragments of so many bytes or symbols.
LARGE_BYTES = 1 << 20
FRAGMENT = 1 << 17
#: Letter runs and mark runs that a worker keeps the ids of, unless an operator asks for more.
CORES = 80_000
#: Symbols of a leaf of the tree.
LEAF = 128
#: A word of Latin letters and trailing marks: the pattern of the pre-tokenizer always cuts between the two.
LETTERS_MARKS = re.compile("([A-Za-zÀ-ÖØ-öø-ÿ]+)([.,!?;:|#$%&*]*)")
#: Lower-case Latin letters in UTF-8.
LETTERS = re.compile(rb"(?:[a-z]|\xc3[\x9f-\xb6\xb8-\xbf])+")
#: Bytes of text that are cut into words at a time, and words whose ids are put in a row at a time.
CUT_BYTES = 1 << 20
ROW_WORDS = 1 << 18

#: The symbols that stand for the bytes of a text in byte-level vocabularies.
_SHOWN = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
BYTE_SYMBOLS = {b: chr(b) for b in _SHOWN} | {
    b: chr(0x100 + n) for n, b in enumerate(b for b in range(256) if b not in set(_SHOWN))
}
SYMBOLS = {b: s for b, s in BYTE_SYMBOLS.items() if b > 127}

#: Classes of bytes, white space 0, letters 1, marks 2 and others 3, and the pairs of them (four times the first and the second) with a cut between:
#: around white space and after a letter before a mark.
_CLASS = np.full(256, 3, np.uint8)
_CLASS[[0x20, *range(0x09, 0x0E)]] = 0
_CLASS[[*range(0x41, 0x5B), *range(0x61, 0x7B)]] = 1
_CLASS[list(b".,!?;:|#$%&*")] = 2
_CUTS = np.array([(p == 0) != (q == 0) or (p == 1 and q == 2) for p in range(4) for q in range(4)])
#: A-Z to a-z.
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 32


def library_threads_off() -> None:
    """Spark runs a task on each core; threads of the library would only compete."""
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")


class TreeEncoder:
    """Ids of a run of symbols that no pre-tokenizer splits.

    Halves are encoded on their own and joined upwards; halves of very long runs are rows of different tasks (``encode_large``). A join
    encodes a window of the last tokens of the left side and the first of the right one; if its
    first token is the first token of the left part and its last token the last of the right part, both
    sides agree: each neighbouring pair of tokens has then been seen by an encoding, which makes
    the whole the encoding of the run. Otherwise the window doubles, up to both sides in full.

    ``inner`` encodes a fragment without the mark for the end of a word, ``final`` one that ends it.
    """

    def __init__(self, inner: Callable[[str], list[str]], final: Callable[[str], list[str]], suffix: str = "") -> None:
        self.inner, self.final, self.suffix = inner, final, suffix

    def plain(self, token: str, last: bool) -> str:
        return token[: len(token) - len(self.suffix)] if last and self.suffix else token

    def encode(self, run: str, leaf: int = LEAF, ends: bool = True) -> list[str]:
        """Tokens of a run, or of a fragment that does not end its run."""
        spans = [(i, min(i + leaf, len(run))) for i in range(0, len(run), leaf)]
        return self.concatenate([(self.final if ends and e == len(run) else self.inner)(run[s:e]) for s, e in spans], ends)

    def concatenate(self, parts: list[list[str]], ends: bool = True) -> list[str]:
        """Tokens of neighbouring parts in one list, joined two by two; ``ends`` tells that the last one ends the run."""
        while len(parts) > 1:
            joined = [self.join(parts[i], parts[i + 1], ends and i + 2 >= len(parts)) for i in range(0, len(parts) - 1, 2)]
            parts = joined + parts[len(joined) * 2:]
        return parts[0] if parts else []

    def join(self, left: list[str], right: list[str], last: bool) -> list[str]:
        width = 4
        while True:
            nl, nr = min(width, len(left)), min(width, len(right))
            ends = last and nr == len(right)
            head, tail = left[len(left) - nl:], right[:nr]
            text = "".join(head) + "".join(tail[:-1]) + self.plain(tail[-1], ends)
            window = (self.final if ends else self.inner)(text)
            whole_left, whole_right = nl == len(left), nr == len(right)
            if (whole_left or window[0] == head[0]) and (whole_right or window[-1] == tail[-1]):
                return left[: len(left) - nl] + window + right[nr:]
            width *= 2


class Bpe:
    """Encoder of one tokenizer file, for pre-tokenizers that never let a token cross ASCII white space."""

    def __init__(self, path: str) -> None:
        library_threads_off()
        from tokenizers import Tokenizer

        self.path = path
        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        self.strings = [None] * (max(self.library.get_vocab(with_added_tokens=True).values()) + 1)
        for token, i in self.library.get_vocab(with_added_tokens=True).items():
            self.strings[i] = token
        self.special = {t.content: i for i, t in self.library.get_added_tokens_decoder().items()}
        self.cut = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")")
        self.cores: dict[str, tuple[int, ...]] = {"": ()}
        self.most_cores = CORES
        self.kept: WordCache | None = None
        self.tree: TreeEncoder | None = None

    def load_tree(self) -> TreeEncoder:
        if self.tree is None:
            from tokenizers import Tokenizer

            spec = json.loads(self.library.to_str())
            suffix = spec["model"].get("end_of_word_suffix") or ""
            final = self.library.model
            spec["model"]["end_of_word_suffix"] = None
            inner = Tokenizer.from_str(json.dumps(spec)).model
            self.tree = TreeEncoder(
                lambda s: [t.value for t in inner.tokenize(s)], lambda s: [t.value for t in final.tokenize(s)], suffix,
            )
        return self.tree

    def runs(self, word: str) -> Iterator[tuple[int, str]]:
        """The unsplit runs of a word in order, as (-1, symbols), and its special tokens, as (id, "")."""
        for part in self.cut.split(word):
            if part in self.special:
                yield self.special[part], ""
            elif part:
                normal = self.library.normalizer.normalize_str(part) if self.library.normalizer else part
                for run, _ in self.library.pre_tokenizer.pre_tokenize_str(normal):
                    yield -1, run

    def long_word(self, word: str) -> tuple[int, ...]:
        """Ids of a word of any length, its unsplit runs encoded as trees."""
        ids: list[int] = []
        for special, run in self.runs(word):
            ids += [special] if special >= 0 else self.numbers(self.load_tree().encode(run))
        return tuple(ids)

    def numbers(self, tokens: Sequence[str]) -> list[int]:
        return list(map(self.library.model.token_to_id, tokens))

    def library_ids(self, words: Sequence[str]) -> list[tuple[int, ...]]:
        return [tuple(e.ids) for e in self.library.encode_batch_fast(list(words), add_special_tokens=False)]

    def core_ids(self, core: str) -> tuple[int, ...]:
        """Ids of lower-case letters or of marks: one pre-token, so the library's model alone is asked."""
        found = self.cores.get(core)
        if found is None:
            if len(self.cores) > self.most_cores:
                self.cores = {}
            symbols = core if core.isascii() else "".join([BYTE_SYMBOLS[x] for x in core.encode()])
            found = self.cores[core] = tuple([t.id for t in self.library.model.tokenize(symbols)])
        return found

    def ids(self, words: Sequence[bytes]) -> list[tuple[int, ...]]:
        """Ids of each word; a word has no ASCII white space in it."""
        out: list[tuple[int, ...]] = []
        later: list[tuple[int, str]] = []
        for word in words:
            text = word.decode("utf-8", "replace")
            found = LETTERS_MARKS.fullmatch(text) if len(word) <= 64 else None
            if found:
                core, marks = found.groups()
                ids = self.core_ids(core.lower())
                out.append(ids + self.core_ids(marks) if marks else ids)
            elif len(word) <= LONG_BYTES:
                later.append((len(out), text))
                out.append(())
            else:
                out.append(self.long_word(text))
        for (i, _), ids in zip(later, self.library_ids([t for _, t in later]), strict=True):
            out[i] = ids
        return out

    def packed(self, words: Sequence[bytes]) -> list[bytes]:
        """As ``ids``, the ids of a word as unsigned 32-bit numbers in native order; white space has none."""
        out = [b""] * len(words)
        later: list[int] = []
        match, tokenize = LETTERS.fullmatch, self.library.model.tokenize
        for i, word in enumerate(words):
            if len(word) <= 64 and match(word):
                # one pre-token, so the library's model alone is asked
                symbols = word.decode() if word.isascii() else word.decode("latin-1").translate(SYMBOLS)
                out[i] = array("I", [t.id for t in tokenize(symbols)]).tobytes()
            elif not word.isspace():
                later.append(i)
        for i, ids in zip(later, self.ids([words[i] for i in later]), strict=True):
            out[i] = array("I", ids).tobytes()
        return out

    def word_cache(self, most: int) -> WordCache:
        """The packed ids of the last ``most`` to twice as many words, kept from task to task of a worker."""
        if self.kept is None:
            self.kept = WordCache(self.packed, most)
        self.kept.cap = self.most_cores = most
        return self.kept

    def cut_words(self, data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The bytes of texts, A-Z in lower case, and where to cut them into words, white space and marks behind letters.

        ``starts`` are cut too. The ids of the parts, one after the other, are those of the whole: no pre-token crosses such a cut. Where a
        special token or a combining mark (U+0300 to U+036F, which make other letters of upper case than of lower) is among the texts,
        they keep their case, with a special token also their marks.
        """
        kinds = _CLASS[data]
        lower = _LOWER[data]
        raw = lower.tobytes()
        special = any(token.lower().encode() in raw for token in self.special)
        if special:
            kinds = np.where(kinds == 0, kinds, 3)
        if special or b"\xcc" in raw or b"\xcd" in raw:
            lower = data
        edge = np.ones(len(data) + 1, bool)
        edge[1:-1] = _CUTS[(kinds[:-1] << 2) | kinds[1:]]
        edge[starts] = True
        return lower, np.flatnonzero(edge)

    def packed_texts(self, column: pa.Array, cache: WordCache) -> Iterator[bytes]:
        """The ids of each text in order, packed as those of ``packed``, which makes the values of ``cache``; null is empty.

        Arrow numbers the different words of about ``CUT_BYTES`` of texts, so that a word is looked up once for all its places there.
        """
        column = pa.array([b""] * len(column), pa.binary()) if pa.types.is_null(column.type) else column.cast(pa.binary()).fill_null(b"")
        _, offsets, values = column.buffers()
        ends = np.frombuffer(offsets, np.int32)[column.offset:column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int32)
        first = 0
        while first < len(column):
            last = max(first + 1, int(np.searchsorted(ends, int(ends[first]) + CUT_BYTES, "right")) - 1)
            starts = ends[first:last + 1] - ends[first]
            first, size, at = last, int(starts[-1]), int(ends[first])
            if not size:
                yield from [b""] * (len(starts) - 1)
                continue
            data, bounds = self.cut_words(np.frombuffer(values, np.uint8, size, at), starts)
            parts = pa.Array.from_buffers(
                pa.binary(), len(bounds) - 1, [None, pa.py_buffer(bounds.astype(np.int32)), pa.py_buffer(data)],
            ).dictionary_encode()
            number = parts.indices.to_numpy()
            found = cache.values([slices(parts.dictionary)])[0]
            many = np.fromiter(map(len, found), np.int64, len(found)) >> 2
            begin = np.cumsum(many) - many
            flat = np.frombuffer(b"".join(found), np.uint32)
            rows = []
            for i in range(0, len(number), ROW_WORDS):
                some = number[i:i + ROW_WORDS]
                n = many[some]
                rows.append(flat[np.repeat(begin[some] - (np.cumsum(n) - n), n) + np.arange(n.sum())].tobytes())
            ids = b"".join(rows)
            before = np.concatenate(([0], np.cumsum(many[number])))
            place = (4 * before[np.searchsorted(bounds, starts)]).tolist()
            yield from [ids[a:b] for a, b in zip(place, place[1:])]

    def decode(self, ids: Sequence[int]) -> str:
        """What the library's decode gives: without a decoder in the file, the tokens joined by spaces."""
        if self.library.decoder is not None:
            return self.library.decode(list(ids), skip_special_tokens=False)
        return " ".join(self.strings[i] for i in ids)


_LOADED: dict[str, Bpe] = {}


def load(path: str) -> Bpe:
    """The encoder of a file, one for each Python worker."""
    if path not in _LOADED:
        _LOADED[path] = Bpe(path)
    return _LOADED[path]


def slices(strings: pa.BinaryArray) -> list[bytes]:
    """The values of an array without nulls, faster than one by one through Arrow's scalars."""
    _, offsets, data = strings.buffers()
    ends = np.frombuffer(offsets, np.int32)[strings.offset:strings.offset + len(strings) + 1].tolist()
    raw = data.to_pybytes()
    return [raw[a:b] for a, b in zip(ends, ends[1:])]


def sized(docs: DataFrame, large: bool) -> DataFrame:
    """Documents above or up to ``LARGE_BYTES``; null texts are small."""
    above = F.coalesce(F.octet_length("text") > LARGE_BYTES, F.lit(False))
    return docs.where(above if large else ~above).select("doc_id", "text")


def encode(docs: DataFrame, path: str) -> DataFrame:
    """(doc_id, ids array<int>) of every whole text, a row for each row; null and empty texts give no ids.

    Tokens of these vocabularies never cross ASCII white space, so a text is cut there, which is
    exact, and each word is encoded once for each task's cache; runs longer than ``LONG_BYTES`` go through
    ``TreeEncoder``, and texts above ``LARGE_BYTES`` are encoded by many tasks. Repeated rows give repeated results; other columns of
    ``docs`` are not read.
    """

    def make():
        cache = WordCache(load(path).ids)

        def run(texts):
            words = [t.split() for t in texts]
            known = cache.of(words)
            return [[[i for w in ws for i in known[w]] for ws in words]]

        return run

    return map_texts(sized(docs, False), make, "ids array<int>").unionByName(encode_large(sized(docs, True), path))


def fragments(bpe: Bpe, text: bytes, most: int) -> Iterator[tuple[str, bool, bool]]:
    """(content, joins, ends) of a large text in order, each of about ``most`` bytes or symbols.

    Words come as text; special tokens as their ids; an unsplit run as fragments of its symbols, of which all but the first join the one before
    and only the last ends the run. A first letter tells the kinds apart: w, s, r.
    """
    held: list[bytes] = []
    size = 0
    for word in text.split():
        if len(word) <= most:
            held.append(word)
            size += len(word) + 1
        if held and (size > most or len(word) > most):
            yield "w" + b" ".join(held).decode("utf-8", "replace"), False, True
            held, size = [], 0
        if len(word) > most:
            for special, run in bpe.runs(word.decode("utf-8", "replace")):
                if special >= 0:
                    yield f"s{special}", False, True
                for i in range(0, len(run), most):
                    yield "r" + run[i:i + most], i > 0, i + most >= len(run)
    if held:
        yield "w" + b" ".join(held).decode("utf-8", "replace"), False, True


def encode_large(docs: DataFrame, path: str, most: int = FRAGMENT) -> DataFrame:
    """(doc_id, ids) of large texts. Their fragments are rows that many tasks encode; one task joins the ids of a text.

    A join encodes only windows around the seams, so what a single task does to a whole text is linear and small.
    """
    id_field = docs.schema["doc_id"]
    id_type = id_field.dataType.simpleString()

    def cut(batches):
        bpe = load(path)
        for batch in batches:
            for i, text in zip(range(len(batch)), raw_texts(batch.column(1))):
                rows = list(fragments(bpe, text, most)) or [("w", False, True)]
                n = len(rows)
                content, joins, ends = zip(*rows, strict=True)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([uuid.uuid4().hex] * n), batch.column(0).take(pa.array([i] * n)), pa.array(range(n), pa.int32()),
                     pa.array(content), pa.array(joins), pa.array(ends)],
                    names=["text_key", "doc_id", "seq", "content", "joins", "ends"],
                )

    # written, as the keys of a text are drawn when it is cut
    rows = stage(docs.mapInArrow(cut, f"text_key string, doc_id {id_type}, seq int, content string, joins boolean, ends boolean"), "fragments")

    def encode_rows(batches):
        bpe = load(path)
        for batch in batches:
            out = []
            for content, ends in zip(batch.column("content").to_pylist(), batch.column("ends").to_pylist()):
                kind, body = content[:1], content[1:]
                if kind == "r":
                    out.append(bpe.numbers(bpe.load_tree().encode(body, ends=ends)))
                elif kind == "s":
                    out.append([int(body)])
                else:
                    out.append([i for ids in bpe.ids(body.encode().split()) for i in ids])
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(n) for n in ("text_key", "doc_id", "seq", "joins", "ends")), pa.array(out, pa.list_(pa.int32()))],
                names=["text_key", "doc_id", "seq", "joins", "ends", "ids"],
            )

    encoded = spread(rows).mapInArrow(
        encode_rows, f"text_key string, doc_id {id_type}, seq int, joins boolean, ends boolean, ids array<int>",
    )

    def join(group):
        bpe = load(path)
        group = group.sort_by("seq")
        ids: list[int] = []
        open_run: list[list[str]] = []
        for part, joins, ends in zip(*(group.column(n).to_pylist() for n in ("ids", "joins", "ends"))):
            if not joins and ends:
                ids += part
                continue
            open_run.append([bpe.strings[i] for i in part])
            if ends:
                ids += bpe.numbers(bpe.load_tree().concatenate(open_run))
                open_run = []
        return pa.table({"doc_id": group.column("doc_id").slice(0, 1), "ids": pa.array([ids], pa.list_(pa.int32()))})

    return encoded.groupBy("text_key").applyInArrow(join, f"doc_id {id_type}, ids array<int>")


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """(doc_id, text) of the ids of ``encode``; null ids give an empty text."""
    from pyspark.sql.types import StringType, StructField, StructType

    out = StructType([encoded.schema["doc_id"], StructField("text", StringType())])

    def run(batches):
        bpe = load(path)
        for batch in batches:
            texts = [bpe.decode(ids or []) for ids in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, out)


def round_trip(docs: DataFrame, path: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of every whole text, encoded as ``encode`` and decoded as ``decode``.

    The digests are those of the decimal ids joined by spaces and of the decoded text in UTF-8; a null
    or empty text has 0 tokens and the digests of the empty string. Only digests leave the task.
    """

    def make():
        bpe = load(path)
        words_decode = bpe.library.decoder is None

        def value(words):
            return [
                (" ".join(map(str, ids)), bpe.decode(ids) if words_decode else ids) for ids in bpe.ids(words)
            ]

        cache = WordCache(value, 60_000)

        def run(texts):
            words = [t.split() for t in texts]
            known = cache.of(words)
            counts, encoded, decoded = [], [], []
            for ws in words:
                values = [v for v in map(known.__getitem__, ws) if v[0]]
                line = " ".join([v[0] for v in values])
                text = " ".join([v[1] for v in values]) if words_decode else bpe.decode(list(map(int, line.split())))
                counts.append(line.count(" ") + 1 if line else 0)
                encoded.append(hashlib.sha256(line.encode()).hexdigest())
                decoded.append(hashlib.sha256(text.encode()).hexdigest())
            return [counts, encoded, decoded]

        return run

    def digest(batches):
        bpe = load(path)
        for batch in batches:
            ids = batch.column(1).to_pylist()
            lines, texts = [" ".join(map(str, i)) for i in ids], [bpe.decode(i) for i in ids]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(list(map(len, ids)), pa.int64()),
                 *(pa.array([hashlib.sha256(x.encode()).hexdigest() for x in column], pa.string()) for column in (lines, texts))],
                names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    ddl = "n_tokens bigint, ids_sha256 string, decoded_sha256 string"
    large = encode_large(sized(docs, True), path).mapInArrow(digest, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, {ddl}")
    return map_texts(sized(docs, False), make, ddl).unionByName(large)
