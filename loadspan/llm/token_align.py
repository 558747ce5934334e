"""Alignment of the tokens of two tokenizers over the same text: a byte-level BPE (A) and a sentencepiece model (B)."""

from __future__ import annotations

import gc
import hashlib
import re
from array import array
from collections.abc import Sequence
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from loadspan.llm.bpe_tree import BYTE_SYMBOLS, library_threads_off
from loadspan.llm.common import WordCache, chunks, raw_texts, stage

#: Pairs of a document and an id pair that a shard holds before it is closed; a longer document is a shard of its own.
SHARD_PAIRS = 1 << 20
#: Different units of text, and parts of units, that a task keeps the alignments of. Parts are dear to align, units are put together from them.
UNITS = 100_000
PARTS_KEPT = 300_000
#: Units and parts below so many characters are encoded many at a time, as one text.
SHORT = 100
RUN = 256

#: A text is cut before a space or a line end that follows anything but white space.
UNIT = re.compile(r"\s*\S+(?:(?![ \n])\s+\S*)*|\s+")
#: A unit of letters, with marks behind them and a line end before them, is cut once more.
PARTS = re.compile(r"(\n?)( ?[A-Za-zÀ-ÖØ-öø-ÿ]+)([.,!?;:|#$%&*]*)")

#: Tokens and byte ends of both sides: (a ids, a ends, b ids, b ends).
Spans = tuple[list[int], list[int], list[int], list[int]]
#: (tokens of A, tokens of B, groups as text, links as 64-bit codes a << 32 | b in native bytes).
Aligned = tuple[int, int, str, bytes]


class Aligner:
    """Tokens of both vocabularies with the bytes at which they end.

    The spans that the libraries give are coarse: characters of A's offsets, bytes of B's proto spans. They hold
    where every token is whole characters. Where one is not, as a part of a character of several bytes or a
    fallback byte, the decoded bytes of the tokens say where each ends.

    Neither vocabulary has a token that goes on over a space or line end behind another character (checked
    here for B; A's pre-tokenizer cuts there), so a text is encoded unit by unit, which gives the tokens of the whole text.
    """

    def __init__(self, path_a: str, path_b: str, units: int = UNITS, parts: int = PARTS_KEPT) -> None:
        library_threads_off()
        from sentencepiece import SentencePieceProcessor, sentencepiece_model_pb2
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(path_a)
        self.a.no_truncation()
        self.a.no_padding()
        self.a.encode_special_tokens = True
        spec = sentencepiece_model_pb2.ModelProto()
        with open(path_b, "rb") as f:
            spec.ParseFromString(f.read())
        # units bring their own space, the first one too
        spec.normalizer_spec.add_dummy_prefix = False
        self.b = SentencePieceProcessor(model_proto=spec.SerializeToString())

        byte = {symbol: b for b, symbol in BYTE_SYMBOLS.items()}
        vocab = self.a.get_vocab(with_added_tokens=True)
        self.a_bytes = [b""] * (max(vocab.values()) + 1)
        for token, i in vocab.items():
            shown = all(c in byte for c in token)
            self.a_bytes[i] = bytes([byte[c] for c in token]) if shown else token.encode()
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.b_bytes = [
            bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)
        ]
        self.a_part = [partial(x) for x in self.a_bytes]
        self.b_part = [partial(x) for x in self.b_bytes]
        normal = [p for i, p in enumerate(pieces) if not (self.b.is_byte(i) or self.b.is_control(i))]
        if any(re.search("[^▁\n][▁\n]|\n▁|▁\n", p) for p in normal):
            raise ValueError("the sentencepiece model has pieces across spaces or line ends")
        self.split = not any(re.search("[A-Za-zÀ-ÖØ-öø-ÿ][.,!?;:|#$%&*]|\n.", p) for p in normal)
        self.names = [str(i) for i in range(max(len(self.a_bytes), len(self.b_bytes)))]
        self.shown = [name + mark for mark in ",|;\n" for name in self.names]
        self.known = WordCache(self._parts, parts)
        self.cache = WordCache(self._units, units)

    def spans(self, parts: Sequence[str]) -> list[Spans | bool]:
        """Tokens and their byte ends of each text part, encoded as it stands; False if a side does not give the bytes back."""
        out: list[Spans | bool] = []
        a_all = self.a.encode_batch(list(parts), add_special_tokens=False)
        b_all = self.b.encode(list(parts), return_type="proto", num_threads=1)
        a_bytes, b_bytes = self.a_bytes, self.b_bytes
        for text, a, b in zip(parts, a_all, b_all, strict=True):
            raw = text.encode("utf-8", "surrogatepass")
            a_ids, pieces = a.ids, list(b.pieces)
            b_ids = [p.id for p in pieces]
            if not raw or b"".join([a_bytes[i] for i in a_ids]) != raw or b"".join([b_bytes[i] for i in b_ids]) != raw:
                out.append(False)
                continue
            a_ends, b_ends = [end for _, end in a.offsets], [p.end for p in pieces]
            if len(raw) > len(text):
                place = np.append(np.flatnonzero(np.frombuffer(raw, np.uint8) & 0xC0 != 0x80), len(raw))
                a_ends = refine(place[a_ends].tolist(), a_ids, a_bytes, self.a_part)
                b_ends = refine(b_ends, b_ids, b_bytes, self.b_part)
            out.append((a_ids, a_ends, b_ids, b_ends))
        return out

    def _parts(self, parts: list[str]) -> list[Aligned | bool]:
        joined = [p for p in parts if len(p) < SHORT and p[0] in " \n" and not p[-1].isspace()]
        found = dict(zip(joined, self._runs(joined), strict=True))
        alone = [p for p in parts if p not in found]
        found.update(zip(alone, self._alone(alone), strict=True))
        return [found[p] for p in parts]

    def _alone(self, parts: list[str]) -> list[Aligned | bool]:
        return [s and links(*s, self.names) for s in self.spans(parts)]

    def _runs(self, parts: list[str], size: int = RUN) -> list[Aligned | bool]:
        """Alignments of parts that may stand behind each other, as neither side has tokens across their starts.

        They are encoded ``size`` at a time. Where one is not given back, its run is encoded again in shorter ones, then part by part.
        """
        runs = [parts[i:i + size] for i in range(0, len(parts), size)]
        out: list[Aligned | bool] = []
        for run, spans in zip(runs, self.spans(["".join(run) for run in runs]), strict=True):
            found = spans and run_links(*spans, run, self.shown)
            if not found:
                found = self._runs(run, size // 16) if size > 16 else self._alone(run)
            out += found
        return out

    def _units(self, units: list[str]) -> list[Aligned | bool]:
        cut: list[list[str]] = []
        for unit in units:
            found = PARTS.fullmatch(unit) if self.split and len(unit) < SHORT else None
            cut.append([p for p in found.groups() if p] if found else [unit])
        found, at = self.known.values([[p for parts in cut for p in parts]])[0], 0
        out = []
        for parts in cut:
            n = len(parts)
            out.append(found[at] if n == 1 else merge(found[at:at + n]))
            at += n
        return out

    def aligned(self, texts: Sequence[str]) -> list[list[Aligned] | bool]:
        """Alignments of the units of a space and each text; False without tokens."""
        found = self.cache.values([UNIT.findall(" " + t) if t else [] for t in texts])
        return [got if got and False not in got else False for got in found]


def partial(token: bytes) -> bool:
    """Whether a token's bytes are not whole characters."""
    try:
        token.decode()
    except UnicodeDecodeError:
        return True
    return False


def refine(coarse: list[int], ids: list[int], raw: list[bytes], part: list[bool]) -> list[int]:
    """Byte ends of tokens: the library's spans if all tokens are whole characters, else the ends of their decoded bytes."""
    if any([part[i] for i in ids]):
        return list(accumulate([len(raw[i]) for i in ids]))
    return coarse


def links(a_ids: list[int], a_ends: list[int], b_ids: list[int], b_ends: list[int], names: Sequence[str]) -> Aligned:
    """Groups between common ends and all overlapping pairs, by one walk over both sides; ``names`` has the numbers as text."""
    a, b = [names[i] for i in a_ids], [names[i] for i in b_ids]
    if len(a) == 1 or len(b) == 1:
        codes = [i << 32 | j for i in a_ids for j in b_ids]
        return len(a), len(b), ",".join(a) + "|" + ",".join(b), array("q", codes).tobytes()
    i = j = 0
    groups, codes = [], []
    first_a = first_b = 0
    while True:
        codes.append(a_ids[i] << 32 | b_ids[j])
        at_a, at_b = a_ends[i], b_ends[j]
        i += at_a <= at_b
        j += at_b <= at_a
        if at_a == at_b:
            groups.append(",".join(a[first_a:i]) + "|" + ",".join(b[first_b:j]))
            first_a, first_b = i, j
            if i == len(a):
                return i, j, ";".join(groups), array("q", codes).tobytes()


def run_links(a_ids: list[int], a_ends: list[int], b_ids: list[int], b_ends: list[int], parts: Sequence[str],
              shown: Sequence[str]) -> list[Aligned] | None:
    """What :func:`links` gives for each of ``parts``, from the tokens of all as one text; None if a part does not end with tokens of both sides.

    Each place where a token ends closes one link, between the two tokens before it. ``shown`` has the numbers as text
    with a comma, then all with a bar, a semicolon and a line end.
    """
    a, at_a, b, at_b = (np.array(x, np.int64) for x in (a_ids, a_ends, b_ids, b_ends))
    stops = np.cumsum([len(p.encode("utf-8", "surrogatepass")) for p in parts])
    cuts = np.union1d(at_a, at_b)
    of_a, of_b = np.searchsorted(at_a, cuts), np.searchsorted(at_b, cuts)
    both = cuts[(at_a[of_a] == cuts) & (at_b[of_b] == cuts)]
    rising = all((np.diff(x, prepend=0) > 0).all() for x in (at_a, at_b))
    if not rising or not np.isin(stops, both).all():
        return None
    codes = (a[of_a] << 32 | b[of_b]).tobytes()
    upto_a, upto_b = np.searchsorted(at_a, both, "right"), np.searchsorted(at_b, both, "right")
    group_a, group_b = np.searchsorted(both, at_a), np.searchsorted(both, at_b)
    width = len(shown) // 4
    text = np.empty(len(a) + len(b), np.int64)
    text[np.arange(len(a)) + np.append(0, upto_b)[group_a]] = a + width * (at_a == both[group_a])
    text[np.arange(len(b)) + upto_a[group_b]] = b + width * (2 * (at_b == both[group_b]) + np.isin(at_b, stops))
    groups = "".join([shown[i] for i in text.tolist()]).split("\n")[:-1]
    last = np.searchsorted(both, stops)
    n_a, n_b = np.diff(upto_a[last], prepend=0).tolist(), np.diff(upto_b[last], prepend=0).tolist()
    ends = (8 * np.searchsorted(cuts, stops) + 8).tolist()
    return list(zip(n_a, n_b, groups, [codes[s:e] for s, e in zip([0, *ends], ends)], strict=True))


def merge(parts: Sequence[Aligned | bool]) -> Aligned | bool:
    """Alignment of neighbouring parts as one."""
    if False in parts:
        return False
    a, b, groups, codes = zip(*parts, strict=True)
    return sum(a), sum(b), ";".join(groups), b"".join(codes)


_LOADED: dict[tuple[str, str], Aligner] = {}


def load(path_a: str, path_b: str) -> Aligner:
    """The aligner of two files, one for each Python worker."""
    if (path_a, path_b) not in _LOADED:
        _LOADED[path_a, path_b] = Aligner(path_a, path_b)
    return _LOADED[path_a, path_b]


def decoded(column: pa.Array) -> list[str]:
    return [t.decode("utf-8", "replace") for t in raw_texts(column)]


def align(docs: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """(doc_id, a_ids, a_ends, b_ids, b_ends) of a space and each text: tokens of both sides and the bytes at which they end.

    A group of tokens ends where both lists have the same end; tokens link where their byte ranges overlap. Texts
    that are null or empty, or that a side does not give back byte for byte, have null lists. Rows are kept as they are, repeated ones
    and null ids too; other columns are not read.
    """
    lists = "a_ids array<int>, a_ends array<bigint>, b_ids array<int>, b_ends array<bigint>"
    out = StructType([docs.schema["doc_id"], *StructType.fromDDL(lists).fields])

    def run(batches):
        aligner = load(path_a, path_b)
        for batch in batches:
            columns: list[list] = [[], [], [], []]
            for text in decoded(batch.column(1)):
                units = UNIT.findall(" " + text) if text else []
                spans = aligner.spans(units)
                whole = None if not units or False in spans else spans
                base = [0, *accumulate(len(u.encode()) for u in units)]
                for k, column in enumerate(columns):
                    shift = base if k % 2 else [0] * len(base)
                    column.append(whole and [x + at for s, at in zip(whole, shift) for x in s[k]])
            kinds = (pa.int32(), pa.int64(), pa.int32(), pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array(c, pa.list_(k)) for c, k in zip(columns, kinds))],
                names=["doc_id", "a_ids", "a_ends", "b_ids", "b_ends"],
            )

    return docs.select("doc_id", "text").mapInArrow(run, out)


def packed(values: np.ndarray) -> bytes:
    """Numbers in the fewest of 1, 2, 4 or 8 bytes each, that width first."""
    top = int(values.max()) if len(values) else 0
    width = next(w for w in (1, 2, 4, 8) if top < 1 << 8 * w)
    return bytes([width]) + values.astype(f"<u{width}").tobytes()


def unpacked(data: bytes) -> np.ndarray:
    return np.frombuffer(data, f"<u{data[0]}", offset=1).astype(np.int64)


def shards(docs: DataFrame, path_a: str, path_b: str, most: int) -> DataFrame:
    """Rows of documents, and rows of the id pairs of their shards, which have ``a``.

    A task closes a shard when its documents hold ``most`` pairs. A document keeps the places of its different pairs in the sorted list
    of its shard, as steps, and how often it has each.
    """
    own = docs.schema["doc_id"]
    fields = "n_a bigint, n_b bigint, n_groups bigint, n_links bigint, groups_sha256 string, places binary, times binary, a int, b int, n bigint"
    out = StructType([StructField("shard", LongType()), own, *StructType.fromDDL(fields).fields])

    def run(batches):
        from pyspark.sql.pandas.types import to_arrow_schema

        schema = to_arrow_schema(out)
        aligner = load(path_a, path_b)
        number = TaskContext.get().partitionId() << 32
        held: list[tuple] = []
        size = 0
        # the caches hold very many tuples and no cycles: collections would pass over them again and again
        gc.disable()

        def close():
            every = np.concatenate([h[-2] for h in held])
            codes, place, n = np.unique(every, return_inverse=True, return_counts=True)
            steps = np.split(place, np.cumsum([len(h[-2]) for h in held])[:-1])
            ids = pa.concat_arrays([h[0] for h in held])
            rows = [
                (*h[1:6], packed(np.diff(s, prepend=0)), packed(h[-1])) for h, s in zip(held, steps)
            ]
            columns = [pa.array(c, schema.field(k + 2).type) for k, c in enumerate(zip(*rows, strict=True))]
            null = [pa.nulls(len(held), schema.field(k).type) for k in (9, 10, 11)]
            yield pa.RecordBatch.from_arrays([pa.array([number] * len(held), pa.int64()), ids, *columns, *null], schema=schema)
            if len(codes):
                null = [pa.nulls(len(codes), schema.field(k).type) for k in range(1, 9)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(codes), number)), *null, pa.array((codes >> 32).astype(np.int32)),
                     pa.array((codes & 0xFFFFFFFF).astype(np.int32)), pa.array(n.astype(np.int64))], schema=schema,
                )

        try:
            for batch in batches:
                at = 0
                ids = batch.column(0).cast(schema.field(1).type)
                for texts in chunks(decoded(batch.column(1))):
                    for got in aligner.aligned(texts):
                        if not got:
                            row = (0, 0, 0, 0, "")
                            codes, times = np.zeros(0, np.int64), np.zeros(0, np.int64)
                        else:
                            a, b, groups, linked = zip(*got, strict=True)
                            every = np.frombuffer(b"".join(linked), np.int64)
                            codes, times = np.unique(every, return_counts=True)
                            text = ";".join(groups)
                            row = (sum(a), sum(b), text.count(";") + 1, len(every), hashlib.sha256(text.encode()).hexdigest())
                        held.append((ids.slice(at, 1), *row, codes, times))
                        at += 1
                        size += len(codes) + 1
                        if size >= most:
                            yield from close()
                            held, size, number = [], 0, number + 1
            if held:
                yield from close()
        finally:
            gc.enable()
        pa.default_memory_pool().release_unused()

    return docs.select("doc_id", "text").mapInArrow(run, out)


def measure(docs: DataFrame, path_a: str, path_b: str, most: int = SHARD_PAIRS) -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256) of each text's alignment.

    The texts are encoded once. A shard of documents sends its different id pairs to be counted and gets back the counts of just these; so
    neither the table of pairs nor a pair's documents ever meet in one task. A pair has at most one row for each shard.
    A null or empty text, and one that a side does not give back byte for byte, has zeros and an empty digest. Repeated rows count as
    documents of their own; a null id keeps its row; an empty table gives an empty one; other columns are not read.
    """
    staged = stage(shards(docs, path_a, path_b, most), "aligned")
    pairs = staged.where("a IS NOT NULL").select("shard", "a", "b", "n")
    counts = stage(pairs.groupBy("a", "b").agg(F.sum("n").alias("count")), "pair-counts")
    table = counts.join(counts.groupBy("a").agg(F.max("count").alias("most")), "a").select(
        "a", "b", "count", (F.col("count") == F.col("most")).alias("best"),
    )
    back = pairs.join(table, ["a", "b"]).select(F.col("shard").alias("of"), "a", "b", "count", "best")
    rows = staged.where("a IS NULL").drop("a", "b", "n")
    names = ["doc_id", "n_a", "n_b", "n_groups", "n_links"]
    out = StructType([rows.schema[n] for n in names] + StructType.fromDDL("n_best bigint, count_sum bigint, groups_sha256 string").fields)

    def total(left: pa.Table, right: pa.Table) -> pa.Table:
        right = right.sort_by([("a", "ascending"), ("b", "ascending")])
        count = right.column("count").to_numpy()
        best = right.column("best").to_numpy().astype(bool)
        n_best, count_sum = [], []
        for places, times in zip(left.column("places").to_pylist(), left.column("times").to_pylist()):
            at, n = np.cumsum(unpacked(places)), unpacked(times)
            n_best.append(int(n[best[at]].sum()))
            count_sum.append(int((n * count[at]).sum()))
        kept = left.select([*names, "groups_sha256"])
        return kept.add_column(5, "n_best", pa.array(n_best, pa.int64())).add_column(6, "count_sum", pa.array(count_sum, pa.int64()))

    return rows.groupBy("shard").cogroup(back.groupBy("of")).applyInArrow(total, out)
