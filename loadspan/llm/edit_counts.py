"""Token counts of documents that are edited: a segment tree of pre-tokens, of which only touched regions are encoded again."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from loadspan.llm.bpe_tree import BYTE_SYMBOLS, library_threads_off
from loadspan.llm.common import raw_texts

#: The published pattern of this family of byte-level vocabularies (fixed value).
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
PRETOKEN = regex.compile(PATTERN)
#: A match looks at no more than so many characters behind its end.
AHEAD = 2
#: Pre-tokens of a leaf of the tree.
LEAF = 64

Edit = tuple[int, int, str]


class Counter:
    """Tokens of pre-tokens, counted by the library's model once for each pre-token of a bounded cache."""

    def __init__(self, path: str, cap: int = 150_000) -> None:
        library_threads_off()
        from tokenizers import Tokenizer

        self.model = Tokenizer.from_file(path).model
        self.cap, self.known = cap, {}
        self.encoded = 0

    def of(self, pretokens: Sequence[str]) -> list[int]:
        """Tokens of each pre-token; the strings of special tokens are ordinary text."""
        self.encoded += len(pretokens)
        if len(self.known) > self.cap:
            self.known = {}
        known, tokenize = self.known, self.model.tokenize
        for part in set(pretokens).difference(known):
            known[part] = len(tokenize("".join([BYTE_SYMBOLS[x] for x in part.encode("utf-8", "surrogatepass")])))
        return [known[p] for p in pretokens]


@dataclass
class Tree:
    """Leaves with the lengths of their pre-tokens in characters, and sums of characters and tokens up to the root.

    ``chars`` and ``tokens`` are Fenwick trees over the leaves: an update or a search touches the logarithm of their number.
    """

    text: str
    leaves: list[list[int]]
    chars: list[int]
    tokens: list[int]
    count: list[int]

    @property
    def total(self) -> int:
        return sum(self.count)


def sums(values: Sequence[int]) -> list[int]:
    out = [0, *values]
    for i in range(1, len(out)):
        up = i + (i & -i)
        if up < len(out):
            out[up] += out[i]
    return out


def add(tree: list[int], leaf: int, delta: int) -> None:
    i = leaf + 1
    while i < len(tree):
        tree[i] += delta
        i += i & -i


def prefix(tree: list[int], leaves: int) -> int:
    out = 0
    while leaves:
        out += tree[leaves]
        leaves &= leaves - 1
    return out


def search(tree: list[int], value: int) -> tuple[int, int]:
    """The leaf that holds the character ``value``, the last one if none does, and where it begins."""
    leaves = len(tree) - 1
    at = before = 0
    step = 1 << leaves.bit_length()
    while step:
        if at + step <= leaves and before + tree[at + step] <= value:
            at += step
            before += tree[at]
        step >>= 1
    if at == leaves:
        at -= 1
        before = prefix(tree, at)
    return at, before


def cut(text: str, at: int = 0) -> Iterator[str]:
    for match in PRETOKEN.finditer(text, at):
        yield match[0]


def grouped(parts: Sequence[str], counter: Counter) -> tuple[list[list[int]], list[int]]:
    """Leaves of pre-tokens: their lengths, and the tokens of each leaf."""
    sizes, counts = list(map(len, parts)), counter.of(parts)
    starts = range(0, len(parts), LEAF)
    return [sizes[i:i + LEAF] for i in starts], [sum(counts[i:i + LEAF]) for i in starts]


def build(text: str, counter: Counter) -> Tree:
    leaves, count = grouped(PRETOKEN.findall(text), counter)
    return Tree(text, leaves, sums(list(map(sum, leaves))), sums(count), count)


def edit(tree: Tree, start: int, end: int, new: str, counter: Counter) -> Tree:
    """The tree after characters ``start`` to ``end`` have become ``new``.

    A match of the pattern depends only on the text from its start on, and on ``AHEAD`` characters behind its end at most. So
    pre-tokens that end so far before the edit stay; from there the text is matched again until, behind the edit, a match ends
    where an old pre-token ended: all that follows is as it was. Only the pre-tokens between are encoded.
    """
    start = max(0, min(start, len(tree.text)))
    end = max(start, min(end, len(tree.text)))
    text = tree.text[:start] + new + tree.text[end:]
    if not tree.leaves:
        return build(text, counter)
    first, at = search(tree.chars, max(0, start - 1))
    while first > 0 and at > max(0, start - AHEAD):
        first -= 1
        at -= sum(tree.leaves[first])
    kept: list[int] = []
    for size in tree.leaves[first]:
        if at + size + AHEAD > start:
            break
        kept.append(size)
        at += size
    last, old = search(tree.chars, max(0, min(end, len(tree.text) - 1)))
    shift = len(new) - (end - start)
    ends: dict[int, int] = {}
    place = old
    made: list[str] = []
    bounds: set[int] = set()
    nxt = last
    for part in cut(text, at):
        made.append(part)
        at += len(part)
        old_at = at - shift
        if old_at < end:
            continue
        while nxt < len(tree.leaves) and place <= old_at:
            for k, size in enumerate(tree.leaves[nxt]):
                place += size
                bounds.add(place)
                ends[place] = (nxt << 32) | (k + 1)
            nxt += 1
        if old_at in bounds:
            break
    else:
        old_at = len(tree.text)
    where = ends.get(old_at)
    if where is None:
        tail_leaf, tail = len(tree.leaves), []
    else:
        tail_leaf, k = where >> 32, where & 0xFFFFFFFF
        tail = tree.leaves[tail_leaf][k:]
        tail_leaf += 1
    head = kept
    head_text = text[at - sum(map(len, made)) - sum(kept):at - sum(map(len, made))]
    tail_text = text[at:at + sum(tail)]
    region = [*pieces(head_text, head), *made, *pieces(tail_text, tail)]
    # leaves at the rim are counted as a whole
    new_leaves, new_count = grouped(region, counter)
    if len(new_leaves) == tail_leaf - first:
        # as many leaves as before: only sums on the way to the root change
        chars, tokens, count, leaves = tree.chars, tree.tokens, tree.count, tree.leaves
        for i, (sizes, n) in enumerate(zip(new_leaves, new_count), first):
            add(chars, i, sum(sizes) - sum(leaves[i]))
            add(tokens, i, n - count[i])
            leaves[i], count[i] = sizes, n
        return Tree(text, leaves, chars, tokens, count)
    leaves = tree.leaves[:first] + new_leaves + tree.leaves[tail_leaf:]
    count = tree.count[:first] + new_count + tree.count[tail_leaf:]
    return Tree(text, leaves, sums(list(map(sum, leaves))), sums(count), count)


def pieces(text: str, sizes: Sequence[int]) -> Iterator[str]:
    at = 0
    for size in sizes:
        yield text[at:at + size]
        at += size


#: Spans that the redaction replaces: mail addresses and IPv4 addresses.
PRIVATE = regex.compile(r"[\w.+-]+@[\w-]+(?:\.[\w-]+)+|\b\d{1,3}(?:\.\d{1,3}){3}\b")


def redactions(text: str, source: str | None) -> list[Edit]:
    """Edits of a clean-up: private spans become ``[private]``, from the last to the first, then a line naming the source comes in front."""
    edits = [(m.start(), m.end(), "[private]") for m in PRIVATE.finditer(text)][::-1]
    return [*edits, (0, 0, f"[{source or ''}]\n")]


def count_edits(
    docs: DataFrame, path: str, edits_of: Callable[[str, str | None], list[Edit]] = redactions, note_column: str | None = "source",
) -> DataFrame:
    """(doc_id, n_tokens, n_edits, n_tokens_edited, n_pretokens, n_reencoded) of every whole text, a row for each row.

    ``n_tokens`` are those of the text and ``n_tokens_edited`` those after its edits in turn, with special tokens as ordinary text;
    ``n_reencoded`` of the ``n_pretokens`` of the text were encoded again. A null text is empty. A span beyond the text is cut to
    it; a reversed one is an insertion.
    """
    id_field = docs.schema["doc_id"]
    out = StructType([id_field, *StructType.fromDDL(
        "n_tokens bigint, n_edits bigint, n_tokens_edited bigint, n_pretokens bigint, n_reencoded bigint",
    ).fields])
    note = F.col(note_column).cast("string") if note_column else F.lit(None).cast("string")

    def run(batches):
        counter = Counter(path)
        for batch in batches:
            rows = []
            for raw, said in zip(raw_texts(batch.column(1)), batch.column(2).to_pylist()):
                text = raw.decode("utf-8", "replace")
                tree = build(text, counter)
                before, size = tree.total, sum(map(len, tree.leaves))
                edits = edits_of(text, said)
                encoded = counter.encoded
                for start, end, new in edits:
                    tree = edit(tree, start, end, new, counter)
                rows.append((before, len(edits), tree.total, size, counter.encoded - encoded))
            columns = zip(*rows, strict=True) if rows else [[]] * 5
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, pa.int64()) for c in columns)], names=out.names)

    return docs.select("doc_id", "text", note.alias("_note")).mapInArrow(run, out)
