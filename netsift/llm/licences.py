"""Licence scans by a generalised suffix automaton of licence tokens."""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterable
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .words import word_blocks, words_of

# The phrases of the contract, and the label of each.
PHRASES = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}

_AS_IS = """THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE
WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT
HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM,
OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
_BSD = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following
conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following
disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following
disclaimer in the documentation and/or other materials provided with the distribution."""
# Public notices and short statements, with the label of the licence.
TEMPLATES = (
    ("MIT", """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation
files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify,
merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to
do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or
substantial portions of the Software. """ + _AS_IS),
    ("BSD-2-Clause", _BSD),
    ("BSD-3-Clause", _BSD + """ Neither the name of the copyright holder nor the names of its contributors may be used to endorse or
promote products derived from this software without specific prior written permission."""),
    ("ISC", """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted,
provided that the above copyright notice and this permission notice appear in all copies."""),
    ("Apache-2.0", """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with
the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or
agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF
ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."""),
    ("GPL", """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License
as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is
distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS
FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details."""),
    ("MPL-2.0", """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not
distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."""),
    ("Unlicense", """This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish,
use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or
non-commercial, and by any means."""),
    ("Apache-2.0", "licensed under the Apache License, Version 2.0"),
    ("GPL-2.0", "licensed under the GNU General Public License, version 2"),
    ("GPL-3.0", "licensed under the GNU General Public License, version 3"),
    ("MIT", "released under the MIT License"),
    ("MIT", "licensed under the MIT License"),
    ("CC-BY-4.0", "licensed under CC BY 4.0"),
    ("CC-BY-SA-4.0", "licensed under CC BY-SA 4.0"),
    ("CC-BY-NC-4.0", "licensed under CC BY-NC 4.0"),
    ("CC-BY-4.0", "licensed under a Creative Commons Attribution 4.0 International License"),
)


class Automaton:
    """The suffix automaton of several token sequences, each with the places where its states' strings end.

    A state stands for the token strings that end at the same places;
    ``links`` leads to the longest suffix with more places. The work and
    memory are those of the templates, not of the texts.
    """

    def __init__(self, phrases: dict[str, str], templates: Iterable[tuple[str, str]]):
        self.labels = [label for label, _ in templates]
        cut = [words_of(text.encode()) for _, text in templates]
        named = [words_of(p.encode()) for p in phrases]
        self.sizes = [len(c) for c in cut]
        self.vocabulary: dict[bytes, int] = {}
        for word in (w for c in (*cut, *named) for w in c):
            self.vocabulary.setdefault(word, len(self.vocabulary) + 1)
        self.steps: list[dict[int, int]] = [{}]
        self.links, self.lengths = [-1], [0]
        self.places: list[set[tuple[int, int]]] = [set()]
        codes = [[self.vocabulary[w] for w in c] for c in (*cut, *named)]
        for t, sequence in enumerate(codes):
            last = 0
            for i, c in enumerate(sequence):
                last = self._extend(last, c)
                if t < len(cut):
                    self.places[last].add((t, i + 1))
        # a suffix ends wherever the longer string does
        for s in sorted(range(1, len(self.links)), key=lambda s: -self.lengths[s]):
            self.places[self.links[s]] |= self.places[s]
        self.places[0] = set()
        self.phrases: list[tuple[tuple[int, str], ...]] = [()] * len(self.links)
        ends: dict[int, list[tuple[int, str]]] = {}
        for sequence, label in zip(codes[len(cut) :], phrases.values()):
            s = 0
            for c in sequence:
                s = self.steps[s][c]
            ends.setdefault(s, []).append((len(sequence), label))
        for s in sorted(range(1, len(self.links)), key=lambda s: self.lengths[s]):
            self.phrases[s] = (*ends.get(s, ()), *self.phrases[self.links[s]])
        self.width = len(self.vocabulary) + 1
        self.pairs = np.unique(np.array([a * self.width + b for sequence in codes for a, b in zip(sequence, sequence[1:])], np.int64))

    def _add(self, length: int, link: int, steps: dict[int, int]) -> int:
        self.lengths.append(length)
        self.links.append(link)
        self.steps.append(steps)
        self.places.append(set())
        return len(self.links) - 1

    def _split(self, p: int, c: int) -> int:
        """The state of the string of ``p`` and then ``c``, split off where its state holds longer strings as well."""
        q = self.steps[p][c]
        if self.lengths[q] == self.lengths[p] + 1:
            return q
        twin = self._add(self.lengths[p] + 1, self.links[q], dict(self.steps[q]))
        self.links[q] = twin
        while p != -1 and self.steps[p].get(c) == q:
            self.steps[p][c] = twin
            p = self.links[p]
        return twin

    def _extend(self, last: int, c: int) -> int:
        if c in self.steps[last]:  # another sequence has this string already
            return self._split(last, c)
        new, p = self._add(self.lengths[last] + 1, 0, {}), last
        while p != -1 and c not in self.steps[p]:
            self.steps[p][c] = new
            p = self.links[p]
        if p != -1:
            self.links[new] = self._split(p, c)
        return new


def chain(matches: list[tuple[int, int, int]], size: int, need: int, max_gap: int) -> list[tuple[int, int, int]]:
    """``start, end, matched`` of the spans of one template: matches ``(start, at, length)`` in order of both text and template.

    Each match goes on from the best one that ends at most ``max_gap`` words
    before it and earlier in the template; what overlaps counts once. Of
    chains with ``need`` words or more those of most words are taken, as far
    as they do not overlap.
    """
    best: list[tuple[int, int]] = []  # words matched, first match
    low = 0
    reach = max_gap + size
    for j, (start, at, length) in enumerate(matches):
        while matches[low][0] + reach < start:
            low += 1
        top = (length, j)
        for i in range(low, j):
            s, a, n = matches[i]
            over = max(0, s + n - start, a + n - at)
            if s < start and a < at and over < length and start - (s + n) <= max_gap:
                top = max(top, (best[i][0] + length - over, best[i][1]), key=lambda x: x[0])
        best.append(top)
    ends: dict[int, tuple[int, int]] = {}
    for (words, root), (start, _, length) in zip(best, matches):
        if words >= need and words > ends.get(root, (0,))[0]:
            ends[root] = (words, start + length)
    taken: list[tuple[int, int, int]] = []
    for root, (words, end) in sorted(ends.items(), key=lambda x: (-x[1][0], x[0])):
        k = bisect_left(taken, (matches[root][0],))
        if (k == 0 or taken[k - 1][1] <= matches[root][0]) and (k == len(taken) or end <= taken[k][0]):
            taken.insert(k, (matches[root][0], end, words))
    return taken


def scan(body: bytes | None, a: Automaton, *, min_run: int, min_share: float, short: int, max_gap: int) -> tuple:
    """``words, places, spans, share`` of one text.

    ``places`` are (start, label) of the phrases, ``spans`` (template, start,
    end, matched). The text streams through the automaton block by block. A
    word pair that no template holds ends every match, so only runs of known
    pairs are walked; the state is carried over the blocks' edges.
    """
    n, before, s, length = 0, 0, 0, 0
    places: list[tuple[int, str]] = []
    found: dict[int, list[tuple[int, int, int]]] = {}
    steps, links, lengths, phrases = a.steps, a.links, a.lengths, a.phrases

    def close(end: int) -> None:
        """A match that the next word does not go on with."""
        if length >= min_run:
            for t, e in a.places[s]:
                found.setdefault(t, []).append((end - length, e - length, length))

    for words in word_blocks(body):
        if not words:
            continue
        codes = np.fromiter(map(a.vocabulary.get, words, repeat(0)), np.int64, len(words))
        codes = np.concatenate([[before], codes])
        pair = codes[:-1] * a.width + codes[1:]
        known = a.pairs[np.minimum(np.searchsorted(a.pairs, pair), len(a.pairs) - 1)] == pair if len(a.pairs) else np.zeros(len(pair), bool)
        edge = np.diff(known.astype(np.int8), prepend=0, append=0)
        if not known[0]:
            close(n)
            s, length = 0, 0
        for first, last in zip(np.flatnonzero(edge == 1).tolist(), np.flatnonzero(edge == -1).tolist()):
            run = codes[first : last + 1].tolist()
            if first or not length:  # the carried state has read the first word already
                s, length = steps[0][run[0]], 1
            for i, c in enumerate(run[1:], n + first):
                if c not in steps[s]:
                    close(i)
                    while c not in steps[s]:
                        s = links[s]
                    length = lengths[s]
                s = steps[s][c]
                length += 1
                for size, label in phrases[s]:
                    if length >= size:
                        places.append((i + 1 - size, label))
            if last < len(known):
                close(n + last)
                s, length = 0, 0
        before = int(codes[-1])
        if not known[-1]:
            s, length = (steps[0][before], 1) if before else (0, 0)
        n += len(words)
    close(n)
    spans, share = [], 1.0 if places else 0.0
    for t, matches in sorted(found.items()):
        size = a.sizes[t]
        need = size if size < short else int(np.ceil(min_share * size))
        matches.sort()
        for start, end, matched in chain(matches, size, min(need, min_run), max_gap):
            share = max(share, matched / size)
            if matched >= need:
                spans.append((t, start, end, matched))
    return n, places, spans, min(share, 1.0)


SPANS = "array<struct<label:string,start:long,end:long,matched:int,size:int>>"


def scan_licences(docs: DataFrame, *, phrases: dict[str, str] = PHRASES, templates: Iterable[tuple[str, str]] = TEMPLATES, min_run: int = 3, min_share: float = 0.6, short: int = 20, max_gap: int = 30, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_words, places, spans, score`` for every row.

    Words are runs of ASCII letters and digits and of non-ASCII characters,
    A-Z lower-cased. ``places`` holds ``start, label`` of every place of a
    phrase, ``spans`` the covered ``start, end`` (in words) of the templates,
    with the words ``matched`` of ``size``: matches of ``min_run`` words or more, chained
    over gaps of up to ``max_gap`` words. A span counts if it covers
    ``min_share`` of its template, all of it where that has fewer than
    ``short`` words. ``score`` is the largest share of a template that a
    chain covers, 1 where a phrase stands.

    The broadcast automaton is as large as the templates; nothing is
    shuffled. Null and empty texts have no words and score 0; repeated rows
    and null ids are scanned like any. An empty table gives no rows; other
    columns are not read.
    """
    shared = docs.sparkSession.sparkContext.broadcast(Automaton(phrases, tuple(templates)))

    def run(batches):
        a = shared.value
        for batch in batches:
            out = [scan(t.as_py(), a, min_run=min_run, min_share=min_share, short=short, max_gap=max_gap) for t in batch.column(1)]
            places = [[{"start": s, "label": x} for s, x in sorted(p)] for _, p, _, _ in out]
            spans = [[{"label": a.labels[t], "start": s, "end": e, "matched": m, "size": a.sizes[t]} for t, s, e, m in sorted(found, key=lambda x: (x[1], x[0]))] for _, _, found, _ in out]
            place_type = pa.list_(pa.struct([("start", pa.int64()), ("label", pa.string())]))
            span_type = pa.list_(pa.struct([("label", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("matched", pa.int32()), ("size", pa.int32())]))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([o[0] for o in out], pa.int64()), pa.array(places, place_type), pa.array(spans, span_type), pa.array([o[3] for o in out], pa.float64())], names=["doc_id", "n_words", "places", "spans", "score"])

    read = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("binary").alias("body"))
    return read.mapInArrow(run, f"doc_id long, n_words long, places array<struct<start:long,label:string>>, spans {SPANS}, score double")


def digest(found: DataFrame) -> DataFrame:
    """``doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score`` of scanned rows."""
    base = F.transform("places", lambda p: p["label"])
    joined = lambda x: F.array_join(F.array_sort(F.array_distinct(x)), ",")
    return found.select(
        "doc_id", "n_words", F.size("places").cast("long").alias("n_base"),
        F.array_min(F.transform("places", lambda p: p["start"])).alias("first_word"), F.array_max(F.transform("places", lambda p: p["start"])).alias("last_word"),
        joined(base).alias("base_labels"), joined(F.concat(base, F.transform("spans", lambda s: s["label"]))).alias("labels"), "score",
    )
