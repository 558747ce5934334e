"""Quality rules: counts of words and lines, then the fertility of a public tokenizer with bands for each script."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import StructType

from loadspan.llm.common import WordCache, chunks, map_texts, raw_texts

MIN_WORDS = 50
SYMBOLS = b"#*$%&|<>"
SPACES = b" \t\n\r\x0b\x0c"
P1, P2, P3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9)

COLUMNS = (
    "n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, "
    "n_tokens bigint, chars_per_token double, tokens_per_word double, fallback_share double, token_entropy double, "
    "script string, "
    "base_failed boolean, kept boolean"
)


@dataclass(frozen=True)
class Band:
    """What a document of a script may have."""

    least_chars_per_token: float
    most_chars_per_token: float
    most_tokens_per_word: float
    most_fallback_share: float
    least_entropy: float


#: First code points of scripts and their names; other letters are "other".
SCRIPTS = ((0x41, "latin"), (0x370, "greek"), (0x400, "cyrillic"), (0x530, "other"), (0x590, "semitic"), (0x800, "indic"),
           (0xE00, "other"), (0x3040, "kana"), (0x3100, "other"), (0x3400, "han"), (0xA000, "other"), (0xAC00, "hangul"),
           (0xD7B0, "other"))

#: Bands by script. The vocabulary was made from Latin text, so other scripts take more tokens and bytes.
BANDS: Mapping[str, Band] = {
    "latin": Band(1.3, 8.0, 3.2, 0.02, 5.2),
    "greek": Band(0.6, 4.0, 9.0, 0.30, 4.0),
    "cyrillic": Band(0.9, 6.0, 6.0, 0.10, 4.5),
    "semitic": Band(0.4, 4.0, 12.0, 0.70, 4.0),
    "indic": Band(0.3, 4.0, 25.0, 0.90, 3.5),
    "han": Band(0.3, 2.5, float("inf"), 0.80, 3.5),
    "kana": Band(0.3, 3.0, float("inf"), 0.60, 3.5),
    "hangul": Band(0.3, 3.0, 15.0, 0.90, 3.5),
    "other": Band(0.2, 8.0, float("inf"), 1.00, 3.5),
}


def collision_entropy(counts: np.ndarray) -> float:
    """Bits of -log2 of the chance that two tokens of the text are equal; 64 if no token occurs twice, 0 below 2 tokens.

    Unlike the entropy of shares, it does not grow with the length of the text.
    """
    n = float(counts.sum())
    if n < 2:
        return 0.0
    pairs = float((counts * (counts - 1.0)).sum())
    return float(np.log2(n * (n - 1)) - np.log2(pairs)) if pairs else 64.0


def repeated_words(words: list[bytes]) -> int:
    """Words that lie in a window of three that is found twice or more in the text."""
    n = len(words)
    if n < 4:
        return 0
    ids = np.fromiter(map(hash, words), np.int64, n).view(np.uint64)
    with np.errstate(over="ignore"):
        windows = ids[:-2] * P1 + ids[1:-1] * P2 + ids[2:] * P3
    order = np.argsort(windows, kind="stable")
    ranked = windows[order]
    same = ranked[1:] == ranked[:-1]
    if not same.any():
        return 0
    again = np.zeros(n - 2, bool)
    again[order[1:][same]] = True
    again[order[:-1][same]] = True
    inside = np.zeros(n, bool)
    for k in range(3):
        inside[k:n - 2 + k] |= again
    return int(inside.sum())


def duplicate_lines(text: bytes) -> int:
    """Lines with a word that equal an earlier line."""
    if b"\n" not in text:
        return 0
    lines = [x for x in text.split(b"\n") if x.strip(SPACES)]
    return len(lines) - len(set(lines))


def main_script(text: bytes) -> str:
    """The script of most letters of a text; ties go to the first of ``SCRIPTS``; without letters "other"."""
    if text.isascii():
        return "latin" if any(65 <= b <= 90 or 97 <= b <= 122 for b in text) else "other"
    points = np.frombuffer(text.decode("utf-8", "replace").encode("utf-32-le"), np.uint32)
    letters = points[((points | 32) >= 97) & ((points | 32) <= 122) | (points >= 0xC0)]
    if not len(letters):
        return "other"
    which = np.bincount(np.searchsorted([s for s, _ in SCRIPTS], letters, "right") - 1, minlength=len(SCRIPTS))
    return SCRIPTS[int(which.argmax())][1]


class Rules:
    """Columns of ``COLUMNS`` of texts. Words are tokenised one by one."""

    def __init__(self, model_path: str, bands: Mapping[str, Band] = BANDS) -> None:
        import sentencepiece

        self.pieces = sentencepiece.SentencePieceProcessor(model_file=model_path)
        self.bands = bands
        size = self.pieces.get_piece_size()
        self.is_byte = np.array([self.pieces.is_byte(i) or self.pieces.is_unknown(i) for i in range(size)])
        self.cache = WordCache(self.encode, 50_000)

    def encode(self, words: list[bytes]) -> list[bytes]:
        ids = self.pieces.encode([w.decode("utf-8", "replace") for w in words], num_threads=1)
        return [np.array(i, "<u2").tobytes() for i in ids]

    def columns(self, texts: list[bytes]) -> list[list]:
        rows = []
        split = [t.split() for t in texts]
        known = self.cache.of(split)
        for text, words in zip(texts, split):
            n = len(words)
            points = len(text) if text.isascii() else len(text.decode("utf-8", "replace"))
            chars = points - sum(map(text.count, (b" ", b"\t", b"\n", b"\r", b"\x0b", b"\x0c")))
            symbols = sum(text.count(bytes([s])) for s in SYMBOLS)
            repeats = repeated_words(words)
            ids = np.frombuffer(b"".join([known[w] for w in words]), "<u2")
            tokens = len(ids)
            fallback = entropy = fertility = 0.0
            if tokens:
                counts = np.bincount(ids, minlength=len(self.is_byte))
                fallback = float(counts[self.is_byte].sum() / tokens)
                fertility = chars / tokens
                entropy = collision_entropy(counts)
            failed = n < MIN_WORDS or 100 * repeats > 50 * n
            script = main_script(text)
            band = self.bands.get(script, self.bands["other"])
            kept = (
                not failed and band.least_chars_per_token <= fertility <= band.most_chars_per_token
                and tokens <= band.most_tokens_per_word * n
                and fallback <= band.most_fallback_share and entropy >= band.least_entropy
            )
            rows.append((n, chars, symbols, duplicate_lines(text), repeats, tokens, fertility,
                         tokens / n if n else 0.0, fallback, entropy, script, failed, kept))
        return [list(c) for c in zip(*rows, strict=True)]


def measure(docs: DataFrame, model_path: str, bands: Mapping[str, Band] = BANDS) -> DataFrame:
    """(doc_id, columns of ``COLUMNS``) of every whole text, a row for each row of ``docs``.

    Null and empty texts have no words: they fail the base rule. Texts are read in whole and no other column
    is. The measures of a document depend on its text alone.
    """
    return map_texts(docs, lambda: Rules(model_path, bands).columns, COLUMNS)


def keep(docs: DataFrame, model_path: str, bands: Mapping[str, Band] = BANDS) -> DataFrame:
    """The rows of ``docs`` that the rules keep, with all their columns, in one pass without a join."""

    at = docs.columns.index("text")

    def run(batches):
        rules = Rules(model_path, bands)
        for batch in batches:
            mask: list[bool] = []
            for part in chunks(raw_texts(batch.column(at))):
                mask += rules.columns(part)[-1]
            yield batch.filter(pa.array(mask, pa.bool_()))

    return docs.mapInArrow(run, StructType(docs.schema.fields))
