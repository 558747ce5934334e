"""Licence scan: matching statistics of texts in a suffix automaton of licence templates, chained into template spans."""

from __future__ import annotations

import bisect
from collections import defaultdict
from collections.abc import Iterator, Mapping, Sequence

import numpy as np
from pyspark.sql import DataFrame

from loadspan.llm.common import CHUNK_BYTES, map_texts

#: Phrases that give their label wherever their words stand consecutively.
PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}

#: Notices and statements by label, in the public wording of the licences.
TEMPLATES: dict[str, list[str]] = {
    "mit": [
        'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), '
        "to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, "
        "and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: "
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. "
        'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, '
        "FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER "
        "LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS "
        "IN THE SOFTWARE.",
    ],
    "apache": [
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy '
        "of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the "
        'License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific '
        "language governing permissions and limitations under the License.",
    ],
    "gpl": [
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free "
        "Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be "
        "useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public "
        "License for more details.",
    ],
    "bsd": [
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: "
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary "
        "form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials "
        "provided with the distribution. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products "
        "derived from this software without specific prior written permission.",
        "licensed under the BSD license", "released under the BSD license",
    ],
    "isc": [
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above "
        "copyright notice and this permission notice appear in all copies.",
    ],
    "mpl": [
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can "
        "obtain one at http://mozilla.org/MPL/2.0/.",
        "licensed under the Mozilla Public License",
    ],
    "unlicense": [
        "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this "
        "software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
    ],
    "cc-by": ["licensed under CC BY 4.0", "licensed under a Creative Commons Attribution 4.0 International License"],
    "cc-by-sa": ["licensed under CC BY-SA 4.0", "licensed under a Creative Commons Attribution-ShareAlike 4.0 International License"],
    "cc-by-nc": ["licensed under CC BY-NC 4.0", "licensed under a Creative Commons Attribution-NonCommercial 4.0 International License"],
    "cc-by-nc-sa": ["licensed under CC BY-NC-SA 4.0"],
    "cc-by-nc-nd": ["licensed under CC BY-NC-ND 4.0"],
}

#: Least words of a match that goes into a chain.
LEAST = 4
#: Words that a chain may skip between two matches, in the text and in the template.
GAP = 24
#: Share of a template that its chain must cover for the label.
SHARE = 0.6

#: A-Z in lower case; ASCII that is neither a letter nor a digit as spaces; other bytes belong to words.
FOLD = bytes(
    x + 32 if 0x41 <= x <= 0x5A else x if x >= 0x80 or 0x30 <= x <= 0x39 or 0x61 <= x <= 0x7A else 0x20 for x in range(256)
)

Span = tuple[str, int, int, float]


def words_of(text: bytes, limit: int = CHUNK_BYTES) -> Iterator[list[bytes]]:
    """Words of a text, those of about ``limit`` bytes at a time."""
    folded, start = text.translate(FOLD), 0
    while start < len(folded):
        end = folded.find(b" ", start + limit)
        end = len(folded) if end < 0 else end
        yield folded[start:end].split()
        start = end


class Automaton:
    """Generalised suffix automaton of token sequences: every state is a set of substrings with the same ends in all sequences."""

    def __init__(self, sequences: Sequence[Sequence[int]]) -> None:
        self.next: list[dict[int, int]] = [{}]
        self.link = [-1]
        self.length = [0]
        self.ends: list[list[tuple[int, int]]] = [[]]
        for number, sequence in enumerate(sequences):
            last = 0
            for i, token in enumerate(sequence):
                last = self._add(last, token)
                self.ends[last].append((number, i))
        # ends of a state are those of the states that it is a suffix of, too
        for state in sorted(range(1, len(self.link)), key=lambda s: -self.length[s]):
            if self.link[state] > 0:
                self.ends[self.link[state]] += self.ends[state]

    def _state(self, length: int) -> int:
        self.next.append({})
        self.link.append(0)
        self.length.append(length)
        self.ends.append([])
        return len(self.link) - 1

    def _split(self, above: int, token: int) -> int:
        """The state of the longest string of ``above`` with ``token`` behind it, parted from longer ones if need be."""
        target = self.next[above][token]
        if self.length[target] == self.length[above] + 1:
            return target
        copy = self._state(self.length[above] + 1)
        self.next[copy] = dict(self.next[target])
        self.link[copy], self.link[target] = self.link[target], copy
        while above >= 0 and self.next[above].get(token) == target:
            self.next[above][token] = copy
            above = self.link[above]
        return copy

    def _add(self, last: int, token: int) -> int:
        if token in self.next[last]:
            return self._split(last, token)
        new = self._state(self.length[last] + 1)
        at = last
        while at >= 0 and token not in self.next[at]:
            self.next[at][token] = new
            at = self.link[at]
        self.link[new] = 0 if at < 0 else self._split(at, token)
        return new

    def find(self, sequence: Sequence[int]) -> int:
        state = 0
        for token in sequence:
            state = self.next[state][token]
        return state

    def statistics(self, tokens: Sequence[int]) -> tuple[list[int], list[int]]:
        """State and length of the longest substring of the sequences that ends at each token."""
        states, lengths = [], []
        state = length = 0
        step, link, longest = self.next, self.link, self.length
        for token in tokens:
            while state and token not in step[state]:
                state = link[state]
                length = longest[state]
            if token in step[state]:
                state = step[state][token]
                length += 1
            states.append(state)
            lengths.append(length)
        return states, lengths


class Scanner:
    """Phrases and templates in one automaton; texts run through it as word numbers."""

    def __init__(self, phrases: Mapping[str, str], templates: Mapping[str, Sequence[str]], least: int, gap: int, share: float) -> None:
        self.least, self.gap, self.share = least, gap, share
        self.vocab: dict[bytes, int] = {}
        self.phrases = [(self.numbers(p), label) for p, label in phrases.items()]
        known = [(self.numbers(t), label) for label, texts in templates.items() for t in texts]
        if any(len(p) < 2 for p, _ in self.phrases + known):
            raise ValueError("a phrase or template has at least two words")
        self.templates = known
        self.size = len(self.vocab) + 1
        sequences = [t for t, _ in known] + [p for p, _ in self.phrases]
        self.automaton = Automaton(sequences)
        self.pairs = np.unique([a * self.size + b for s in sequences for a, b in zip(s, s[1:])])
        # phrases that end where a state ends: its own and those of the states it goes back to
        own = defaultdict(list)
        for number, (phrase, _) in enumerate(self.phrases):
            own[self.automaton.find(phrase)].append((number, len(phrase)))
        self.found: list[list[tuple[int, int]]] = [[] for _ in self.automaton.link]
        for state in sorted(range(1, len(self.found)), key=self.automaton.length.__getitem__):
            self.found[state] = own.get(state, []) + self.found[self.automaton.link[state]]
        # where a match ends in templates; phrases are no templates
        self.places = [
            [(t, e) for t, e in sorted(ends) if t < len(known)] if length >= least else []
            for ends, length in zip(self.automaton.ends, self.automaton.length)
        ]

    def numbers(self, text: str) -> list[int]:
        return [self.vocab.setdefault(w, len(self.vocab) + 1) for part in words_of(text.encode()) for w in part]

    def ids(self, text: bytes) -> np.ndarray:
        """Numbers of the words, 0 for words that no template has."""
        get = self.vocab.get
        parts = [np.array([get(w, 0) for w in words], np.int64) for words in words_of(text)]
        return np.concatenate(parts) if parts else np.zeros(0, np.int64)

    def regions(self, ids: np.ndarray) -> list[tuple[int, int]]:
        """Stretches of words whose neighbours are neighbours in a template; a match of two words or more is inside of one."""
        valid = np.zeros(len(ids) + 1, bool)
        if len(ids) > 1:
            code = ids[:-1] * self.size + ids[1:]
            code[(ids[:-1] == 0) | (ids[1:] == 0)] = -1
            place = np.minimum(np.searchsorted(self.pairs, code), len(self.pairs) - 1)
            valid[1:-1] = self.pairs[place] == code if len(self.pairs) else False
        edge = np.diff(valid.astype(np.int8))
        return list(zip(np.flatnonzero(edge == 1).tolist(), (np.flatnonzero(edge == -1) + 1).tolist()))

    def scan(self, ids: np.ndarray) -> tuple[list[tuple[int, str]], list[Span]]:
        """Places of phrases as (first word, label), and the best chains as (label, first word, last word, share of the template)."""
        phrases: list[tuple[int, str]] = []
        matches: dict[int, list[tuple[int, int, int]]] = defaultdict(list)
        for start, end in self.regions(ids):
            states, lengths = self.automaton.statistics(ids[start:end].tolist())
            for i, (state, length) in enumerate(zip(states, lengths)):
                for number, words in self.found[state]:
                    if words <= length:
                        phrases.append((start + i - words + 1, self.phrases[number][1]))
                if length >= self.least and (i + 1 == len(lengths) or lengths[i + 1] <= length):
                    for template, last in self.places[state]:
                        matches[template].append((start + i - length + 1, last - length + 1, length))
        spans = []
        for template, found in sorted(matches.items()):
            tokens, label = self.templates[template]
            spans += [(label, first, last, covered / len(tokens)) for first, last, covered in chains(found, self.gap)]
        return phrases, spans


def chains(matches: list[tuple[int, int, int]], gap: int) -> list[tuple[int, int, int]]:
    """Disjoint chains of matches (word, template word, length) that go on in both, as (first word, last word, covered words).

    A match follows another that ends later in neither and at most ``gap`` words before it in both; it adds the words
    by which it goes further in both. Only matches that near are looked at, so a long text takes linear time.
    """
    matches = sorted(matches, key=lambda m: (m[0] + m[2], m[1] + m[2]))
    ends = [m[0] + m[2] for m in matches]
    best: list[int] = []
    before: list[int] = []
    for k, (word, at, length) in enumerate(matches):
        top, chosen = length, -1
        for j in range(bisect.bisect_left(ends, word - gap), k):
            w, t, n = matches[j]
            gain = min(length, word + length - w - n, at + length - t - n)
            if w < word and t < at and at - t - n <= gap and gain > 0 and best[j] + gain > top:
                top, chosen = best[j] + gain, j
        best.append(top)
        before.append(chosen)
    used: set[int] = set()
    out = []
    for k in sorted(range(len(matches)), key=lambda k: (-best[k], k)):
        path, at = [], k
        while at >= 0 and at not in used:
            path.append(at)
            at = before[at]
        if at < 0:
            used.update(path)
            out.append((matches[path[-1]][0], matches[k][0] + matches[k][2] - 1, best[k]))
    return out


SPANS = "array<struct<label: string, first: bigint, last: bigint, share: double>>"
COLUMNS = f"n_words bigint, n_base bigint, first_word bigint, last_word bigint, base_labels string, labels string, score double, spans {SPANS}"


def scan(
    docs: DataFrame, phrases: Mapping[str, str] = PHRASES, templates: Mapping[str, Sequence[str]] = TEMPLATES, least: int = LEAST,
    gap: int = GAP, share: float = SHARE,
) -> DataFrame:
    """Licences of every whole text: its words, places and labels of phrases, labels of templates, a score and the template spans.

    Words are runs of digits, ASCII letters in lower case and characters beyond ASCII. ``n_base`` counts the places of all
    phrases, ``first_word`` and ``last_word`` are the smallest and largest word at which one starts, null without any. A span is a chain of
    matches of at least ``least`` words that covers ``share`` of a template or more; ``labels`` has the labels of phrases and spans,
    sorted and joined by commas, empty without any. ``score`` is 1 with a phrase, else the largest share of a template that any chain covers.

    Texts stream through the automaton in the tasks that read them, long ones in slices; nothing is shuffled. Null and empty texts have no words and
    score 0; rows are kept as they are, repeated ones and null ids too; an empty table gives an empty one; other columns are not read.
    """
    phrases, templates = dict(phrases), {k: list(v) for k, v in templates.items()}

    def make():
        scanner = Scanner(phrases, templates, least, gap, share)

        def run(texts):
            columns: list[list] = [[] for _ in range(8)]
            for text in texts:
                ids = scanner.ids(text)
                base, chained = scanner.scan(ids)
                spans = [s for s in chained if s[3] >= share]
                named = sorted({label for _, label in base})
                row = (
                    len(ids), len(base), min(base)[0] if base else None, max(base)[0] if base else None, ",".join(named),
                    ",".join(sorted({*named, *(s[0] for s in spans)})), 1.0 if base else max((s[3] for s in chained), default=0.0),
                    [dict(zip(("label", "first", "last", "share"), s)) for s in sorted(spans, key=lambda s: (s[1], s[0]))],
                )
                for column, value in zip(columns, row):
                    column.append(value)
            return columns

        return run

    return map_texts(docs, make, COLUMNS)
