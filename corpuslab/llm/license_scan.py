"""License scans by patience alignment of texts with license templates.

Words that occur once in the text and once in the template are anchors; the longest
increasing subsequence of their places is kept, and the gaps between kept anchors are
aligned in the same way. Coverage is the share of template words that are matched.

A notice may be repeated in a text, so windows of the text are aligned. Any copy that
covers the required share of a template holds one of its ``n - least + 1`` rarest words,
so a window around each place of those words misses none.
"""

from __future__ import annotations

import bisect
import math
import re

from pyspark.sql import DataFrame, types as T

from corpuslab.llm.common import map_text

COVERAGE = 0.8
WORD = re.compile(r"[a-z0-9]+(?:[.-][a-z0-9]+)*")

# fixed values: license names and the words of their notices
TEMPLATES = {
    "apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "cc-by-nc-4.0": "Licensed under CC BY-NC 4.0.",
    "gpl-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "mit": "Released under the MIT License.",
    "apache-2.0-header": (
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with '
        "the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by "
        "applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, "
        "WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language "
        "governing permissions and limitations under the License."),
    "gpl-3.0-notice": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public "
        "License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later "
        "version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the "
        "implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE."),
    "mit-text": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
        'documentation files (the "Software"), to deal in the Software without restriction, including without limitation the '
        "rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit "
        "persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and "
        "this permission notice shall be included in all copies or substantial portions of the Software."),
}


def words(text: str) -> list[str]:
    return WORD.findall(text.lower())


def increasing(values: list[int]) -> list[int]:
    """Places of a longest increasing subsequence, by patience sorting with back links."""
    tops: list[int] = []
    piles: list[int] = []
    link = [-1] * len(values)
    for i, v in enumerate(values):
        at = bisect.bisect_left(tops, v)
        if at:
            link[i] = piles[at - 1]
        if at == len(tops):
            tops.append(v)
            piles.append(i)
        else:
            tops[at], piles[at] = v, i
    out = []
    i = piles[-1] if piles else -1
    while i >= 0:
        out.append(i)
        i = link[i]
    return out[::-1]


def once(items: list[str], low: int, high: int) -> dict[str, int]:
    places: dict[str, int] = {}
    for i in range(low, high):
        places[items[i]] = -1 if items[i] in places else i
    return {w: i for w, i in places.items() if i >= 0}


def patience(a: list[str], b: list[str]) -> list[tuple[int, int]]:
    """Matched places (in a, in b), increasing in both."""
    out = []
    todo = [(0, len(a), 0, len(b))]
    while todo:
        a0, a1, b0, b1 = todo.pop()
        while a0 < a1 and b0 < b1 and a[a0] == b[b0]:
            out.append((a0, b0))
            a0, b0 = a0 + 1, b0 + 1
        while a0 < a1 and b0 < b1 and a[a1 - 1] == b[b1 - 1]:
            a1, b1 = a1 - 1, b1 - 1
            out.append((a1, b1))
        if a0 == a1 or b0 == b1:
            continue
        in_b = once(b, b0, b1)
        shared = [(i, in_b[w]) for w, i in sorted(once(a, a0, a1).items(), key=lambda x: x[1]) if w in in_b]
        kept = [shared[i] for i in increasing([j for _, j in shared])]
        if not kept:
            continue
        out += kept
        edges = [(a0 - 1, b0 - 1), *kept, (a1, b1)]
        todo += [(i + 1, k, j + 1, m) for (i, j), (k, m) in zip(edges, edges[1:])]
    return sorted(out)


class Template:
    def __init__(self, name: str, text: str, coverage: float):
        self.name, self.words = name, words(text)
        if not self.words:
            raise ValueError(f"template {name} has no words")
        self.least = max(1, math.ceil(coverage * len(self.words)))
        self.counts: dict[str, int] = {}
        for w in self.words:
            self.counts[w] = self.counts.get(w, 0) + 1
        self.slack = max(2, len(self.words) // 4)

    def found(self, text: list[str], places: dict[str, list[int]]) -> list[tuple[float, int, int]]:
        """(coverage, first word, last word) of the best copies that do not overlap, by place."""
        n = len(self.words)
        if sum(min(c, len(places.get(w, ()))) for w, c in self.counts.items()) < self.least:
            return []
        rare: set[str] = set()
        held = 0
        for w in sorted(self.counts, key=lambda w: (len(places.get(w, ())), w)):
            if held > n - self.least:
                break
            rare.add(w)
            held += self.counts[w]
        starts = sorted({p - i for i, w in enumerate(self.words) if w in rare for p in places.get(w, ())})
        hits = []
        for s in starts:
            low, high = max(0, s - self.slack), min(len(text), s + n + self.slack)
            pairs = patience(text[low:high], self.words)
            if len(pairs) >= self.least:
                hits.append((-len(pairs), pairs[-1][0] - pairs[0][0], low + pairs[0][0], low + pairs[-1][0]))
        out: list[tuple[float, int, int]] = []
        taken: list[tuple[int, int]] = []
        for size, _, first, last in sorted(set(hits)):
            at = bisect.bisect_left(taken, (first, last))
            if (at == 0 or taken[at - 1][1] < first) and (at == len(taken) or last < taken[at][0]):
                taken.insert(at, (first, last))
                out.append((-size / n, first, last))
        return sorted(out, key=lambda h: h[1])


def scan(
    docs: DataFrame, text: str = "text", templates: dict[str, str] = TEMPLATES, coverage: float = COVERAGE, keep: list[str] | None = None
) -> DataFrame:
    """Add ``license``, ``coverage``, ``n_notices`` and ``notices`` (license, coverage, start, end).

    Starts and ends are code points of the text in lower case, ends exclusive. ``license`` is that of
    the highest coverage, then of the most template words, then first by name; it is null, with
    coverage 0, where no template is covered to the required share, as in null and empty texts.
    """
    notice = T.StructType([
        T.StructField("license", T.StringType()), T.StructField("coverage", T.DoubleType()),
        T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())])
    fields = [T.StructField("license", T.StringType()), T.StructField("coverage", T.DoubleType()),
              T.StructField("n_notices", T.LongType()), T.StructField("notices", T.ArrayType(notice))]

    def make():
        known = [Template(n, t, coverage) for n, t in sorted(templates.items())]
        wanted = frozenset(w for t in known for w in t.counts)
        # a covered template has at least so many different words in the text
        different = min((math.ceil(t.least / max(t.counts.values())) for t in known), default=1)

        def work(texts):
            rows = []
            for t in texts:
                lower = (t or "").lower()
                tokens = WORD.findall(lower)
                hits = []
                if len(wanted.intersection(tokens)) >= different:
                    places: dict[str, list[int]] = {}
                    for i, w in enumerate(tokens):
                        if w in wanted:
                            places.setdefault(w, []).append(i)
                    hits = [(k, h) for k in known for h in k.found(tokens, places)]
                if hits:
                    spans = [m.span() for m in WORD.finditer(lower)]
                    best = min(hits, key=lambda x: (-x[1][0], -len(x[0].words), x[0].name))
                    listed = sorted((spans[first][0], k.name, c, spans[last][1]) for k, (c, first, last) in hits)
                    rows.append((best[0].name, best[1][0], len(hits),
                                 [{"license": n, "coverage": c, "start": s, "end": e} for s, n, c, e in listed]))
                else:
                    rows.append((None, 0.0, 0, []))
            return [list(c) for c in zip(*rows)] if rows else [[], [], [], []]

        return work

    return map_text(docs, text, fields, make, keep)


def op1_license_scan(spark, sf_dir):
    return scan(spark.read.parquet(f"{sf_dir}/documents.parquet"), keep=["doc_id"])
