"""URL filters: glob rules packed into multiword Shift-And masks, matched over all URLs of a batch at once."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import StructType

ALLOW, BLOCK = "allow", "block"
ONE = np.uint64(1)


@dataclass(frozen=True)
class Rule:
    """A host with all its subdomains and the beginning of a path."""

    host: str
    path: str
    verdict: str

    @property
    def name(self) -> str:
        return self.host + self.path


#: The rules of the filter; the longest that fits decides.
RULES = (
    Rule("com", "/", ALLOW), Rule("example.com", "/en/", BLOCK), Rule("www.example.com", "/en/", ALLOW),
    Rule("net", "/es/", BLOCK), Rule("net", "/fr/", BLOCK),
)

#: Globs over ``host/path`` for URLs that no rule fits: names of spam and of adult, gambling and malware sites.
GLOBS = (
    "*casino*", "*bets*", "*pills*", "*poker*", "*viagra*", "*xxx*", "*porn*", "*warez*", "*torrent*", "*phish*",
    "*adult*", "*spam*", "*.ads.*", "*.ads-*", "*/ads/*", "*.exe", "*.apk",
)


class Automaton:
    """All globs as one bit vector of as many 64-bit words as they need.

    A bit stands for a literal byte or ``?`` of a pattern; ``*`` adds no bit but lets the bit before it stay set (a self loop).
    Each pattern begins with a bit that is set at the start of the text. For each byte the vector
    shifts by one, is masked by the byte's mask, and gets the self loops back. A pattern fits the text if its last bit is
    set at the end.
    """

    def __init__(self, globs: Sequence[str]) -> None:
        literal: list[tuple[int, int | None]] = []
        starts, loops, ends = [], [], []
        at = 0
        for glob in globs:
            starts.append(at)
            for byte in glob.encode():
                if byte == 42:
                    loops.append(at)
                else:
                    at += 1
                    literal.append((at, None if byte == 63 else byte))
            ends.append(at)
            at += 1
        self.words = max(1, -(-at // 64))
        self.ends = np.array(ends, np.int64)
        self.start = self.mask(starts)
        self.loops = self.mask(loops)
        self.masks = np.zeros((256, self.words), np.uint64)
        for bit, byte in literal:
            for b in range(256) if byte is None else (byte,):
                self.masks[b, bit >> 6] |= ONE << np.uint64(bit & 63)

    def mask(self, bits: Sequence[int]) -> np.ndarray:
        out = np.zeros(self.words, np.uint64)
        for bit in bits:
            out[bit >> 6] |= ONE << np.uint64(bit & 63)
        return out

    def matches(self, texts: Sequence[bytes]) -> np.ndarray:
        """A boolean for each text and glob. The longest texts go on alone, so a very long one costs its own length."""
        n = len(texts)
        out = np.zeros((n, len(self.ends)), bool)
        if not n or not len(self.ends):
            return out
        sizes = np.fromiter(map(len, texts), np.int64, n)
        order = np.argsort(-sizes, kind="stable")
        ranked = sizes[order]
        data = np.frombuffer(b"".join([texts[i] for i in order]), np.uint8)
        first = np.concatenate(([0], ranked.cumsum()[:-1]))
        state = np.tile(self.start, (n, 1))
        # longest first: after byte k only the first `live` texts still have bytes
        lives = np.searchsorted(-ranked, -np.arange(ranked[0] if n else 0), "left")
        for k, live in enumerate(lives.tolist()):
            now = state[:live]
            shifted = now << ONE
            shifted[:, 1:] |= now[:, :-1] >> np.uint64(63)
            state[:live] = (shifted & self.masks[data[first[:live] + k]]) | (now & self.loops)
        out[order] = (state[:, self.ends >> 6] >> (self.ends & 63).astype(np.uint64)) & ONE > 0
        return out


def canonical(url: str | None) -> tuple[str, str]:
    """Host and path. The host: after the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z in lower case; the path: up to
    ``?``, ``#`` or the end. Null, or no ``://``: both empty."""
    if not url:
        return "", ""
    _, found, rest = url.partition("://")
    if not found:
        return "", ""
    rest = rest.partition("#")[0].partition("?")[0]
    host, slash, path = rest.partition("/")
    return host.encode().lower().decode(), slash + path


def rule_globs(rules: Sequence[Rule]) -> list[str]:
    """Two globs for each rule over ``.host`` and the path: a subdomain's label always ends with a dot."""
    return [f"*.{r.host}{r.path}*" for r in rules]


class Filter:
    def __init__(self, rules: Sequence[Rule] = RULES, globs: Sequence[str] = GLOBS) -> None:
        # longest name first, ties by name: the first rule that fits is the one that counts
        self.rules = sorted(rules, key=lambda r: (-len(r.name), r.name))
        self.n = len(self.rules)
        self.automaton = Automaton([*rule_globs(self.rules), *globs])

    def judge(self, urls: Sequence[str | None]) -> list[list]:
        """Columns host, path, rule, verdict."""
        parts = [canonical(u) for u in urls]
        found = self.automaton.matches([f".{h}{p}".encode("utf-8", "surrogatepass") for h, p in parts])
        rules, verdicts = [], []
        for (host, path), hits in zip(parts, found):
            fit = next((r for r, hit in zip(self.rules, hits[: self.n].tolist()) if hit and confirmed(r, host, path)), None)
            rules.append(fit.name if fit else None)
            verdicts.append(fit.verdict if fit else BLOCK if hits[self.n:].any() else ALLOW)
        return [[h for h, _ in parts], [p for _, p in parts], rules, verdicts]


def confirmed(rule: Rule, host: str, path: str) -> bool:
    """An exact check: a glob may have found the host's text inside the path."""
    return path.startswith(rule.path) and ("." + host).endswith("." + rule.host)


def judge(pages: DataFrame, rules: Sequence[Rule] = RULES, globs: Sequence[str] = GLOBS, id_column: str = "page_id",
          url_column: str = "url") -> DataFrame:
    """(page_id, host, path, rule, verdict) of every URL, a row for each row.

    ``rule`` is the longest rule that fits, as host and path, else null; its verdict decides, else that of the globs: block
    if one fits ``.host/path``, allow otherwise. A null URL or one without ``://`` has an empty host and path and is allowed. Other
    columns are not read.
    """
    out = StructType([pages.schema[id_column], *StructType.fromDDL("host string, path string, rule string, verdict string").fields])

    def run(batches):
        found = Filter(rules, globs)
        for batch in batches:
            columns = found.judge(batch.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array(c, pa.string()) for c in columns)], names=out.names,
            )

    return pages.select(id_column, url_column).mapInArrow(run, out)


def oracle(rules: Sequence[Rule] = RULES, globs: Sequence[str] = GLOBS) -> str:
    """DuckDB SQL for the rows of ``judge`` on ``pages``."""
    cases = " ".join(
        f"WHEN ('.' || host) LIKE '%.{r.host}' AND starts_with(path, '{r.path}') THEN '{r.name}'"
        for r in sorted(rules, key=lambda r: (-len(r.name), r.name))
    )
    verdicts = " ".join(f"WHEN '{r.name}' THEN '{r.verdict}'" for r in rules)
    any_glob = " OR ".join(f"('.' || host || path) GLOB '{g}'" for g in globs) or "false"
    return f"""
        WITH cut AS (
            SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN
                regexp_extract(substr(url, instr(url, '://') + 3), '^[^?#]*') ELSE '' END AS rest FROM pages
        ), parts AS (
            SELECT page_id,
                translate(regexp_extract(rest, '^[^/]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
                CASE WHEN instr(rest, '/') > 0 THEN substr(rest, instr(rest, '/')) ELSE '' END AS path FROM cut
        ), ruled AS (SELECT *, CASE {cases} END AS rule FROM parts)
        SELECT page_id, host, path, rule,
            CASE WHEN rule IS NOT NULL THEN CASE rule {verdicts} END WHEN {any_glob} THEN '{BLOCK}' ELSE '{ALLOW}' END AS verdict
        FROM ruled
    """
