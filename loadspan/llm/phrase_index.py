"""Phrases whose words go together, found with an FM-index over word ids in each shard of the texts."""

from __future__ import annotations

import zlib
from array import array
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loadspan.llm.common import CHUNK_BYTES, raw_texts, stage
from loadspan.plans.skew import salted_join
from loadspan.session import shuffle_width

#: Words of a shard: its index takes some 100 bytes a word.
SHARD_WORDS = 1 << 21
LEAST = 100
LONGEST = 5
TOP = 2000
SALTS = 16
#: Words for each part of the counts, if that makes more parts than the shuffle has.
PART_WORDS = 1 << 22

#: A-Z in lower case, line ends and marks as full stops, tabs as spaces.
FOLD = bytes(
    x + 32 if 0x41 <= x <= 0x5A else 0x2E if x in b".,;:!?\n\x0b\x0c\r" else 0x20 if x == 0x09 else x for x in range(256)
)
STOP = b"."


def slices(text: bytes, limit: int = CHUNK_BYTES) -> Iterator[bytes]:
    """A folded text in slices of about ``limit`` bytes, cut at full stops alone."""
    start = 0
    while start < len(text):
        end = text.find(STOP, start + limit)
        end = len(text) if end < 0 else end + 1
        yield text[start:end]
        start = end


class Numbers(dict):
    """Numbers of the words of a language, new ones counted on over all languages of a shard."""

    def __init__(self, count: Iterator[int]) -> None:
        super().__init__({STOP: 0})
        self.count = count

    def __missing__(self, word: bytes) -> int:
        self[word] = n = next(self.count)
        return n


def deflated(values: np.ndarray) -> bytes:
    """Numbers from 0 in the fewest of 1, 2, 4 or 8 bytes each, that width first, compressed."""
    top = int(values.max(initial=0))
    width = next(w for w in (1, 2, 4, 8) if top < 1 << 8 * w)
    return bytes([width]) + zlib.compress(values.astype(f"<u{width}").tobytes(), 1)


def inflated(data: bytes) -> np.ndarray:
    return np.frombuffer(zlib.decompress(data[1:]), f"<u{data[0]}").astype(np.int64)


def shards(docs: DataFrame, most: int = SHARD_WORDS) -> DataFrame:
    """Words of the texts in shards of about ``most``: (shard, n, tokens, words, counts, langs, sizes).

    ``tokens`` are word numbers with 0 between pieces and texts; ``words`` has the shard's different words, each with its
    language, in the order of their numbers from 1, which is that of their checksums; ``counts`` how often each occurs; ``langs`` and
    ``sizes`` the languages with all their words. A shard ends between pieces, so a text of any length is cut.
    """

    def run(batches):
        number = TaskContext.get().partitionId() << 32

        def close():
            ids = np.frombuffer(tokens, np.int32)
            counts = np.bincount(ids)
            keys = [(named(lang) + b"\t" + w, n) for lang, known in words.items() for w, n in known.items() if n]
            order = sorted(range(len(keys)), key=lambda i: (zlib.crc32(keys[i][0]), keys[i][0]))
            old = np.array([keys[i][1] for i in order], np.int64)
            place = np.zeros(len(counts), np.int64)
            place[old] = np.arange(1, len(old) + 1)
            sizes = {lang: int(counts[[n for n in known.values() if n]].sum()) for lang, known in words.items()}
            return pa.RecordBatch.from_pylist([{
                "shard": number, "n": int(counts[1:].sum()), "tokens": deflated(place[ids]), "words": zlib.compress(b"\n".join([keys[i][0] for i in order]), 1),
                "counts": deflated(counts[old]), "langs": list(sizes), "sizes": list(sizes.values()),
            }], schema=schema)

        def fresh():
            count = iter(range(1, 1 << 31))
            return array("i", [0]), defaultdict(lambda: Numbers(count))

        schema = pa.schema([
            ("shard", pa.int64()), ("n", pa.int64()), ("tokens", pa.binary()), ("words", pa.binary()), ("counts", pa.binary()),
            ("langs", pa.list_(pa.string())), ("sizes", pa.list_(pa.int64())),
        ])
        tokens, words = fresh()
        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), raw_texts(batch.column(1))):
                for part in slices(text.translate(FOLD)):
                    known = words[lang]
                    tokens.extend([known[w] for w in part.replace(STOP, b" . ").split()])
                    tokens.append(0)
                    if len(tokens) >= most:
                        yield close()
                        tokens, words = fresh()
                        number += 1
        if len(tokens) > 1:
            yield close()
        pa.default_memory_pool().release_unused()

    source = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), "text")
    return source.mapInArrow(run, "shard bigint, n bigint, tokens binary, words binary, counts binary, langs array<string>, sizes array<bigint>")


def named(lang: str) -> bytes:
    """A language's name without tabs and line ends."""
    return lang.encode("unicode_escape")


def squeezed(text: np.ndarray, apart: np.ndarray | None = None) -> np.ndarray:
    """Symbols that have a neighbour, one 0 before each run and one at the end; ``apart[i]`` cuts between i and i + 1."""
    joined = (text[:-1] > 0) & (text[1:] > 0)
    if apart is not None:
        joined &= ~apart
    before, after = np.append(False, joined), np.append(joined, False)
    kept = np.flatnonzero(before | after)
    starts = ~before[kept]
    out = np.zeros(len(kept) + int(starts.sum()) + 1, text.dtype)
    out[np.arange(len(kept)) + np.cumsum(starts)] = text[kept]
    return out


class FmIndex:
    """Backward search over a text of symbols, whose suffixes are sorted by their first ``depth`` symbols.

    The interval of a phrase of up to ``depth`` symbols is exact: rows of the symbols before an interval's suffixes
    keep the order of these suffixes as far as ``depth`` tells them apart. The text starts with 0, so that it can be read as a ring.
    """

    def __init__(self, text: np.ndarray, sigma: int, depth: int) -> None:
        rank, span = text.astype(np.int64), 1
        while span < depth:
            step = min(span, depth - span)
            rank = rank * (int(rank.max(initial=0)) + 1) + np.roll(rank, -step)
            rank = np.unique(rank, return_inverse=True)[1].astype(np.int64)
            span += step
        order = np.argsort(rank, kind="stable")
        self.size, self.sigma = len(text), sigma
        self.before = text[order - 1].astype(np.int64)
        # row of the i-th suffix that has the symbol c before it: place of (c, i) among all of them
        self.rows = np.sort(self.before * self.size + np.arange(self.size))

    def symbols(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Symbols above 0 that occur, with the starts and sizes of their intervals."""
        counts = np.bincount(self.before, minlength=self.sigma)
        found = np.flatnonzero(counts[1:]) + 1
        return found, (np.cumsum(counts) - counts)[found], counts[found]

    def extend(self, start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Every symbol above 0 before each interval, as (interval, symbol, start, size, rows of smaller symbols)."""
        owner = np.repeat(np.arange(len(size)), size)
        row = np.arange(len(owner)) + np.repeat(start - (np.cumsum(size) - size), size)
        code, count = np.unique(owner * self.sigma + self.before[row], return_counts=True)
        owner, symbol = np.divmod(code, self.sigma)
        earlier = np.cumsum(count) - count
        smaller = earlier - earlier[np.searchsorted(owner, owner)]
        found = symbol > 0
        owner, symbol, count, smaller = owner[found], symbol[found], count[found], smaller[found]
        return owner, symbol, np.searchsorted(self.rows, symbol * self.size + start[owner]), count, smaller


@dataclass
class Phrases:
    """Phrases of one length: their symbols, starts in the index and in that of the reversed text, and counts."""

    grams: np.ndarray
    start: np.ndarray
    turned: np.ndarray
    count: np.ndarray


class Shard:
    """Both indexes of a text of symbols 1 to ``sigma - 1``; phrases grow by a symbol on either side."""

    def __init__(self, text: np.ndarray, sigma: int, depth: int) -> None:
        self.ahead = FmIndex(text, sigma, depth)
        # reversed, with its 0 first again
        self.back = FmIndex(text[::-1], sigma, depth)

    def words(self) -> Phrases:
        symbol, start, count = self.ahead.symbols()
        return Phrases(symbol[:, None], start, start, count)

    def left(self, p: Phrases) -> Phrases:
        """Each phrase with each symbol before it; the start in the reversed text moves past the smaller symbols."""
        owner, symbol, start, count, smaller = self.ahead.extend(p.start, p.count)
        return Phrases(np.column_stack([symbol, p.grams[owner]]), start, p.turned[owner] + smaller, count)

    def right(self, p: Phrases) -> Phrases:
        owner, symbol, turned, count, smaller = self.back.extend(p.turned, p.count)
        return Phrases(np.column_stack([p.grams[owner], symbol]), p.start[owner] + smaller, turned, count)


def pairs(text: np.ndarray, sigma: int) -> Phrases:
    """All pairs of neighbours in the order of the index, which is the same each time."""
    index = FmIndex(text, sigma, 1)
    symbol, start, count = index.symbols()
    owner, left, start, count, _ = index.extend(start, count)
    return Phrases(np.column_stack([left, symbol[owner]]), start, start, count)


def longer(text: np.ndarray, sigma: int, frequent: np.ndarray, longest: int) -> list[Phrases]:
    """Phrases of 3 to ``longest`` symbols whose pairs of neighbours all are among the codes ``frequent`` (first * sigma + second).

    They grow from pairs, to the left and to the right in turn.
    """
    wide = text.astype(np.int64)
    text = squeezed(text, ~np.isin(wide[:-1] * sigma + wide[1:], frequent))
    if len(text) < 4:
        return []
    shard = Shard(text, sigma, longest - 1)
    # neighbours are frequent pairs wherever the text has no 0 between them
    phrases, out = shard.left(shard.words()), []
    for length in range(3, longest + 1):
        phrases = shard.left(phrases) if length % 2 else shard.right(phrases)
        out.append(phrases)
    return out


def cut_words(words: bytes, parts: int) -> Iterator[tuple[int, int, int, list[bytes]]]:
    """(part, start, end, words) of a shard's words; a part is a stretch of their order."""
    keys = zlib.decompress(words).split(b"\n")
    part = np.array([zlib.crc32(k) for k in keys], np.int64) * parts >> 32
    for start, end in stretches(part):
        yield int(part[start]), start, end, keys[start:end]


def stretches(values: np.ndarray) -> Iterator[tuple[int, int]]:
    """(start, end) of runs of equal values."""
    edges = np.flatnonzero(np.diff(values)) + 1
    yield from zip([0, *edges.tolist()], [*edges.tolist(), len(values)]) if len(values) else ()


def part_of(grams: np.ndarray, parts: int) -> np.ndarray:
    """The part that counts a gram: a mix of its numbers, so that a frequent word's grams are dealt out."""
    mixed = np.zeros(len(grams), np.uint64)
    for column in grams.T:
        mixed = (mixed ^ column.astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
        mixed ^= mixed >> np.uint64(29)
    return ((mixed >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)).astype(np.int64)


def cut_grams(grams: np.ndarray, parts: int) -> tuple[np.ndarray, Iterator[tuple[int, int, int]]]:
    """The order of grams by part and number, and the (part, start, end) of its stretches."""
    part = part_of(grams, parts)
    order = np.lexsort((*grams.T[::-1], part))
    return order, ((int(part[order[start]]), start, end) for start, end in stretches(part[order]))


def rows_of(schema: pa.Schema, rows: list[tuple]) -> pa.RecordBatch:
    columns = zip(*rows, strict=True) if rows else [()] * len(schema)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)


ASKED = pa.schema([("shard", pa.int64()), ("part", pa.int32()), ("keys", pa.binary()), ("counts", pa.binary())])
ASKED_DDL = "shard bigint, part int, keys binary, counts binary"


def ask_words(staged: DataFrame, parts: int) -> DataFrame:
    """(shard, part, keys, counts): each shard's words of each part."""

    def run(batches):
        for batch in batches:
            for shard, words, counts in zip(*(batch.column(k).to_pylist() for k in range(3))):
                n = inflated(counts)
                yield rows_of(ASKED, [
                    (shard, part, zlib.compress(b"\n".join(keys), 1), deflated(n[start:end])) for part, start, end, keys in cut_words(words, parts)
                ])

    return staged.where("n > 0").select("shard", "words", "counts").mapInArrow(run, ASKED_DDL)


def count_words(asked: DataFrame, parts: int, least: int) -> DataFrame:
    """Rows (id, lang, word, a) of the words of a part that occur ``least`` times, and an answer (shard, part, ids) for every row asked: 0 for other words."""
    schema = pa.schema([
        ("shard", pa.int64()), ("part", pa.int32()), ("ids", pa.binary()), ("id", pa.int64()), ("lang", pa.string()), ("word", pa.string()), ("a", pa.int64()),
    ])

    def run(key, group):
        part = key[0].as_py()
        keys = [zlib.decompress(k).split(b"\n") for k in group.column("keys").to_pylist()]
        total: dict[bytes, int] = defaultdict(int)
        for words, counts in zip(keys, group.column("counts").to_pylist()):
            for word, n in zip(words, inflated(counts).tolist()):
                total[word] += n
        # numbers from 1, different in every part
        number = {word: i * parts + part + 1 for i, word in enumerate(sorted(w for w, n in total.items() if n >= least))}
        rows = [(shard, part, deflated(np.array([number.get(w, 0) for w in words], np.int64)), None, None, None, None)
                for shard, words in zip(group.column("shard").to_pylist(), keys)]
        for word, i in number.items():
            lang, text = word.split(b"\t", 1)
            rows.append((None, None, None, i, lang.decode("unicode_escape"), text.decode("utf-8", "replace"), total[word]))
        return pa.Table.from_batches([rows_of(schema, rows)])

    return asked.groupBy("part").applyInArrow(run, "shard bigint, part int, ids binary, id bigint, lang string, word string, a bigint")


def frequent_text(staged: DataFrame, answers: DataFrame) -> DataFrame:
    """(shard, tokens, ids): texts of frequent words that have a frequent neighbour, numbered anew within the shard."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        rows = []
        if len(left) and len(right):
            right = right.sort_by("part")
            id_of = np.concatenate([np.zeros(1, np.int64), *map(inflated, right.column("ids").to_pylist())])
            ids, number = np.unique(np.append(0, id_of), return_inverse=True)
            text = squeezed(number[1:][inflated(left.column("tokens")[0].as_py())])
            rows = [(left.column("shard")[0].as_py(), deflated(text), deflated(ids))]
        return pa.Table.from_batches([rows_of(pa.schema([("shard", pa.int64()), ("tokens", pa.binary()), ("ids", pa.binary())]), rows)])

    texts = staged.where("n > 0").select("shard", "tokens")
    given = answers.select(F.col("shard").alias("of"), "part", "ids")
    return texts.groupBy("shard").cogroup(given.groupBy("of")).applyInArrow(run, "shard bigint, tokens binary, ids binary")


def asked_grams(shard: int, grams: np.ndarray, counts: np.ndarray, parts: int) -> pa.RecordBatch:
    """(shard, part, keys, counts) of the grams of a shard: their columns one after the other, the first as steps."""
    order, cut = cut_grams(grams, parts)
    grams, counts = grams[order], counts[order]
    rows = []
    for part, start, end in cut:
        some = grams[start:end].copy()
        some[1:, 0] = np.diff(grams[start:end, 0])
        rows.append((shard, part, deflated(some.T.ravel()), deflated(counts[start:end])))
    return rows_of(ASKED, rows)


def given_grams(keys: bytes, counts: np.ndarray) -> np.ndarray:
    grams = inflated(keys).reshape(-1, len(counts)).T.copy()
    grams[:, 0] = np.cumsum(grams[:, 0])
    return grams


def ask_pairs(texts: DataFrame, parts: int) -> DataFrame:
    """(shard, part, keys, counts) of the pairs of neighbours in each shard."""

    def run(batches):
        for batch in batches:
            for shard, tokens, ids in zip(*(batch.column(k).to_pylist() for k in range(3))):
                number = inflated(ids)
                found = pairs(inflated(tokens), len(number))
                yield asked_grams(shard, number[found.grams], found.count, parts)

    return texts.mapInArrow(run, ASKED_DDL)


COUNTED = pa.schema([("shard", pa.int64()), ("part", pa.int32()), ("frequent", pa.binary()), ("gram", pa.list_(pa.int64())), ("a", pa.int64())])


def count_grams(asked: DataFrame, least: int, answer: bool, keys: tuple[str, ...] = ("part",)) -> DataFrame:
    """Rows (gram, a) of the grams of a part that occur ``least`` times, and with ``answer`` a bit for each gram of every row asked."""

    def run(_, group):
        counts = [inflated(c) for c in group.column("counts").to_pylist()]
        grams = np.concatenate([given_grams(k, c) for k, c in zip(group.column("keys").to_pylist(), counts)])
        order = np.lexsort(grams.T[::-1])
        new = np.append(True, (grams[order[1:]] != grams[order[:-1]]).any(1))
        total = np.add.reduceat(np.concatenate(counts)[order], np.flatnonzero(new))
        kept = total >= least
        out = []
        if answer:
            bit = np.zeros(len(grams), bool)
            bit[order] = kept[np.cumsum(new) - 1]
            at = np.cumsum([0, *map(len, counts)])
            out.append(rows_of(COUNTED, [
                (shard, part, np.packbits(bit[at[i]:at[i + 1]]).tobytes(), None, None)
                for i, (shard, part) in enumerate(zip(group.column("shard").to_pylist(), group.column("part").to_pylist()))
            ]))
        found = grams[order[new]][kept]
        flat = pa.ListArray.from_arrays(pa.array(np.arange(len(found) + 1, dtype=np.int32) * grams.shape[1]), pa.array(found.ravel()))
        null = [pa.nulls(len(found), COUNTED.field(k).type) for k in range(3)]
        out.append(pa.RecordBatch.from_arrays([*null, flat.cast(COUNTED.field(3).type), pa.array(total[kept].astype(np.int64))], schema=COUNTED))
        return pa.Table.from_batches(out)

    return asked.groupBy(*keys).applyInArrow(run, "shard bigint, part int, frequent binary, gram array<bigint>, a bigint")


def ask_longer(texts: DataFrame, answers: DataFrame, parts: int, longest: int) -> DataFrame:
    """(shard, part, keys, counts, width) of phrases of three words and more, all of whose pairs are frequent."""
    schema = ASKED.append(pa.field("width", pa.int32()))

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        out = [rows_of(schema, [])]
        if len(left) and len(right):
            number, text = inflated(left.column("ids")[0].as_py()), inflated(left.column("tokens")[0].as_py())
            found = pairs(text, len(number)).grams
            order, cut = cut_grams(number[found], parts)
            bits = dict(zip(right.column("part").to_pylist(), right.column("frequent").to_pylist()))
            told = [np.unpackbits(np.frombuffer(bits[part], np.uint8), count=end - start) for part, start, end in cut]
            frequent = found[order[np.concatenate(told).astype(bool)]]
            shard = left.column("shard")[0].as_py()
            for p in longer(text, len(number), frequent[:, 0] * len(number) + frequent[:, 1], longest):
                batch = asked_grams(shard, number[p.grams], p.count, parts)
                out.append(batch.append_column("width", pa.array([p.grams.shape[1]] * len(batch), pa.int32())))
        return pa.Table.from_batches(out)

    given = answers.select(F.col("shard").alias("of"), "part", "frequent")
    return texts.groupBy("shard").cogroup(given.groupBy("of")).applyInArrow(run, f"{ASKED_DDL}, width int")


def phrase_counts(docs: DataFrame, least: int = LEAST, longest: int = LONGEST, shard_words: int = SHARD_WORDS) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Exact counts of phrases: (gram array of word ids, a), (id, lang, word, a), and (lang, n) of all words.

    Every phrase of up to ``longest`` words within a piece that occurs at least ``least`` times in its language is there, with all its occurrences.
    Each shard enumerates its phrases by extending intervals of its index, and counts are summed over shards. Only what
    can still be frequent is enumerated: pairs of frequent words, then phrases all of whose pairs are frequent. A shard sends what it
    has in ``parts`` compressed blocks, dealt by a hash; the task of a part sums the blocks of all shards and tells each which of its words or
    pairs are frequent. Parts grow with the words, so the memory of a task doesn't.
    """
    staged = stage(shards(docs, shard_words), "phrase-shards")
    sizes = staged.select(F.explode(F.arrays_zip("langs", "sizes")).alias("x")).groupBy(F.col("x.langs").alias("lang")).agg(F.sum("x.sizes").alias("n"))
    totals = stage(sizes.where("n > 0"), "phrase-totals")
    every = staged.agg(F.sum("n")).first()[0] or 0
    parts = max(shuffle_width(docs.sparkSession), every // PART_WORDS)
    told = stage(count_words(ask_words(staged, parts), parts, least), "phrase-words")
    words = told.where("word IS NOT NULL").select("id", "lang", "word", "a")
    singles = words.select(F.array("id").alias("gram"), "a")
    if longest < 2:
        return singles, words, totals
    texts = stage(frequent_text(staged, told.where("shard IS NOT NULL")), "phrase-texts")
    paired = stage(count_grams(ask_pairs(texts, parts), least, True), "phrase-pairs")
    counted = singles.unionByName(paired.where("gram IS NOT NULL").select("gram", "a"))
    if longest > 2:
        many = ask_longer(texts, paired.where("shard IS NOT NULL"), parts, longest)
        counted = counted.unionByName(count_grams(many, least, False, ("part", "width")).select("gram", "a"))
    return stage(counted, "phrase-counts"), words, totals


def collocations(
    docs: DataFrame, least: int = LEAST, longest: int = LONGEST, top: int = TOP, shard_words: int = SHARD_WORDS,
) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the ``top`` phrases of each language that hold together best.

    Words are what stands between spaces and tabs, pieces what stands between line ends and ``.,;:!?``; A-Z are lower-cased. A candidate has 2 to
    ``longest`` words and ``a`` occurrences, at least ``least``. Cutting it in two parts that occur ``l`` and ``r`` times gives
    the score floor(1000 * a * n / (l * r)) with the ``n`` words of the language, in exact decimals; the lowest cut counts, the
    earliest of equal ones. A candidate that occurs only inside one longer candidate is dropped: a longer one that has all its
    occurrences exists if and only if one with a word more on either side does.

    A null language is ``und``; null and empty texts have no words; repeated rows count as often as they occur; ties are
    ordered by count, then by the bytes of the phrase; an empty table gives an empty result. Other columns are not read.
    """
    freq, words, totals = phrase_counts(docs, least, longest, shard_words)
    size = F.size("gram")
    candidates = freq.where(size >= 2)
    inside = freq.where(size >= 3).select(
        "a", F.explode(F.array(F.slice("gram", 1, size - 1), F.slice("gram", 2, size - 1))).alias("gram"),
    )
    kept = candidates.join(inside, ["gram", "a"], "left_anti")
    cuts = kept.select("gram", "a", F.explode(F.sequence(F.lit(1), size - 1)).alias("k")).select(
        "*", F.slice("gram", F.lit(1), F.col("k")).alias("head"), F.slice("gram", F.col("k") + 1, F.size("gram")).alias("tail"),
    )
    cuts = salted_join(cuts, freq.select(F.col("gram").alias("head"), F.col("a").alias("l")), ["head"], ["gram"], salts=SALTS)
    cuts = salted_join(cuts, freq.select(F.col("gram").alias("tail"), F.col("a").alias("r")), ["tail"], ["gram"], salts=SALTS)
    spelled = salted_join(
        kept.select("gram", F.posexplode("gram").alias("at", "id")), words.select("id", "lang", "word"), ["id"], ["gram"], salts=SALTS,
    ).groupBy("gram").agg(
        F.first("lang").alias("lang"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "word"))), lambda x: x.word), " ").alias("phrase"),
    )
    known = salted_join(spelled, totals, ["lang"], ["gram"], salts=SALTS)
    exact = F.expr("(cast(1000 as decimal(4,0)) * cast(a as decimal(17,0)) * cast(n as decimal(17,0))) div (cast(l as decimal(19,0)) * cast(r as decimal(19,0)))")
    lowest = cuts.join(known, "gram").withColumn("score", exact).groupBy("gram").agg(
        F.min(F.struct("score", "k", "l", "r")).alias("cut"), *[F.first(c).alias(c) for c in ("lang", "phrase", "a", "n")],
    ).select("lang", "phrase", "a", "cut.l", "cut.r", "n", "cut.score")
    best = [F.col("score").desc(), F.col("a").desc(), F.col("phrase")]
    salt = F.pmod(F.xxhash64("phrase"), F.lit(SALTS))
    first = lowest.withColumn("rank", F.row_number().over(Window.partitionBy("lang", salt).orderBy(*best))).where(F.col("rank") <= top)
    ranked = first.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*best)).cast("bigint"))
    return ranked.where(F.col("rank") <= top).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def oracle(least: int = LEAST, longest: int = LONGEST, top: int = TOP) -> str:
    """DuckDB SQL for ``collocations`` of the documents."""
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return rf"""WITH pieces AS (SELECT coalesce(lang, 'und') AS lang, regexp_extract_all(body, '[^\x20\x09]+') AS ws FROM (
        SELECT lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), '{upper}', '{lower}'), '[.,;:!?\x0A-\x0D]')) AS body FROM documents) d),
    grams AS (SELECT lang, k, array_to_string(ws[i:i + k - 1], ' ') AS phrase FROM (
        SELECT lang, ws, k, unnest(range(1, len(ws) - k + 2)) AS i FROM pieces CROSS JOIN (SELECT unnest(range(1, {longest + 1})) AS k) ks) g),
    totals AS (SELECT lang, count(*) AS n FROM grams WHERE k = 1 GROUP BY lang),
    freq AS (SELECT lang, k, phrase, count(*) AS a FROM grams GROUP BY lang, k, phrase HAVING count(*) >= {least}),
    kept AS (SELECT c.* FROM freq c WHERE c.k > 1 AND NOT EXISTS (SELECT 1 FROM freq x WHERE x.lang = c.lang AND x.k > c.k
        AND 100 * x.a >= 100 * c.a AND contains(' ' || x.phrase || ' ', ' ' || c.phrase || ' '))),
    cuts AS (SELECT lang, phrase, a, j, array_to_string(ws[1:j], ' ') AS head, array_to_string(ws[j + 1:k], ' ') AS tail FROM (
        SELECT *, string_split(phrase, ' ') AS ws, unnest(range(1, k)) AS j FROM kept) c),
    scored AS (SELECT c.lang, c.phrase, c.a, c.j, l.a AS l, r.a AS r, t.n,
        (1000::HUGEINT * c.a * t.n) // (l.a::HUGEINT * r.a) AS score
        FROM cuts c JOIN freq l ON l.lang = c.lang AND l.phrase = c.head JOIN freq r ON r.lang = c.lang AND r.phrase = c.tail JOIN totals t ON t.lang = c.lang),
    lowest AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, j) = 1)
    SELECT lang, CAST(rank AS BIGINT) AS rank, phrase, CAST(a AS BIGINT) AS a, CAST(l AS BIGINT) AS l, CAST(r AS BIGINT) AS r, CAST(n AS BIGINT) AS n,
        CAST(score AS BIGINT) AS score FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM lowest) q
    WHERE rank <= {top}"""
