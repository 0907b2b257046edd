"""Licence scanning by patience alignment of texts with licence templates.

Words are lowered (A-Z) runs of ASCII letters and digits or any non-ASCII signs.  A
template's coverage is the share of its words that align, in order, with a stretch of
the text: words unique to both sides anchor the alignment, the longest increasing
subsequence of anchors is kept, and the gaps between them are aligned in the same way;
equal words at both ends of a gap are matched first.

A template may have naming phrases, the words that tell its licence from another with
the same frame ("mit", "gnu general public license", "version 3").  Each must stand in
the text unbroken and aligned, with at most 2 g + 1 words between two that have g words
between them in the template.  The first is searched in the text, and at every place of
it the template's words before and after are aligned with the words before and after, in
a stretch as long as theirs and one of twice the template's length; the better counts.

A template without naming phrases is aligned on stretches of twice its length, half
overlapping, so each stretch of text as long as the template lies in one and long texts
stay linear.  A stretch is aligned only if it holds enough of the template's words at all,
which is a condition of the coverage asked for, so nothing that could reach it is passed over.

There is no shuffle; the templates are a constant of the operator, or the caller's.
Defined cases: null or empty texts have no licence; every template that reaches the
coverage gives a row, with its best stretch (ties: the first), so a versioned short notice
gives one for its version and one for its licence; rows that share a doc_id give rows of
their own; extra columns are ignored; a template without words, a naming phrase without
words or one that its template does not hold, in order, is an error.
"""

from __future__ import annotations

from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import sparkkit
from . import textkit as tk

COVERAGE = 0.8
#: Published licence notices and grants; fixed texts.
TEMPLATES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0",
    "CC-BY-4.0": "Licensed under CC BY 4.0",
    "CC-BY-SA-4.0": "Licensed under CC BY-SA 4.0",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0",
    "CC-BY-ND-4.0": "Licensed under CC BY-ND 4.0",
    "CC0-1.0": "This work is dedicated to the public domain under CC0 1.0 Universal",
    "CC-BY-NC-SA-4.0": "Licensed under CC BY-NC-SA 4.0",
    "CC-BY-NC-ND-4.0": "Licensed under CC BY-NC-ND 4.0",
    "MIT-notice": "Licensed under the MIT License",
    "MIT-release": "Released under the MIT License",
    "GPL-short": "Licensed under the GNU General Public License",
    "GPL-3.0-short": "Licensed under the GNU General Public License, version 3",
    "GPL-2.0-short": "Licensed under the GNU General Public License, version 2",
    "LGPL-short": "Licensed under the GNU Lesser General Public License",
    "LGPL-3.0-short": "Licensed under the GNU Lesser General Public License, version 3",
    "LGPL-2.1-short": "Licensed under the GNU Lesser General Public License, version 2.1",
    "AGPL-short": "Licensed under the GNU Affero General Public License",
    "AGPL-3.0-short": "Licensed under the GNU Affero General Public License, version 3",
    "AGPL-3.0-notice": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "GPL-3.0-notice": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "GPL-2.0-notice": "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
    "LGPL-notice": "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation",
    "LGPL-2.0-notice": "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Library General Public License as published by the Free Software Foundation",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
    "MIT": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "BSD": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
    "Unlicense": "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software",
    "All-rights-reserved": "All rights reserved. No part of this publication may be reproduced without prior written permission",
    "All-rights-reserved-short": "All rights reserved",
}
#: The phrases that name a template's licence, in the template's order.
NAMING = {
    "Apache-2.0": ("apache license", "2"),
    "CC-BY-4.0": ("cc by 4.0",),
    "CC-BY-SA-4.0": ("cc by sa 4.0",),
    "CC-BY-NC-4.0": ("cc by nc 4.0",),
    "CC-BY-ND-4.0": ("cc by nd 4.0",),
    "CC-BY-NC-SA-4.0": ("cc by nc sa 4.0",),
    "CC-BY-NC-ND-4.0": ("cc by nc nd 4.0",),
    "CC0-1.0": ("cc0",),
    "MIT-notice": ("mit",),
    "MIT-release": ("mit",),
    "GPL-short": ("gnu general public license",),
    "GPL-3.0-short": ("gnu general public license", "version 3"),
    "GPL-2.0-short": ("gnu general public license", "version 2"),
    "LGPL-short": ("gnu lesser general public license",),
    "LGPL-3.0-short": ("gnu lesser general public license", "version 3"),
    "LGPL-2.1-short": ("gnu lesser general public license", "version 2.1"),
    "AGPL-short": ("gnu affero general public license",),
    "AGPL-3.0-short": ("gnu affero general public license", "version 3"),
    "AGPL-3.0-notice": ("gnu affero general public license", "version 3"),
    "GPL-3.0-notice": ("gnu general public license", "version 3"),
    "GPL-2.0-notice": ("gnu general public license", "version 2"),
    "LGPL-notice": ("gnu lesser general public license",),
    "LGPL-2.0-notice": ("gnu library general public license",),
    "MPL-2.0": ("mozilla public license",),
    "All-rights-reserved-short": ("all rights reserved",),
}
_ROWS = "doc_id long, license string, coverage double, word_start long, word_end long"


def rising(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The longest subsequence that rises on both sides; pairs come sorted by the first."""
    piles: list[int] = []
    tops: list[int] = []
    back: list[int] = []
    for k, (_, b) in enumerate(pairs):
        i = bisect_left(tops, b)
        back.append(piles[i - 1] if i else -1)
        if i == len(tops):
            tops.append(b)
            piles.append(k)
        else:
            tops[i], piles[i] = b, k
    out, k = [], piles[-1] if piles else -1
    while k >= 0:
        out.append(pairs[k])
        k = back[k]
    return out[::-1]


def align(a: list, b: list) -> list[tuple[int, int]]:
    """Patience alignment: places of equal words in a and b, rising on both sides."""
    out, todo = [], [(0, len(a), 0, len(b))]
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
        in_a, in_b = Counter(a[a0:a1]), Counter(b[b0:b1])
        at_b = {w: j for j, w in enumerate(b[b0:b1], b0) if in_b[w] == 1}
        anchors = rising([(i, at_b[w]) for i, w in enumerate(a[a0:a1], a0) if in_a[w] == 1 and w in at_b])
        if not anchors:
            continue
        out += anchors
        ends = [(a0 - 1, b0 - 1), *anchors, (a1, b1)]
        todo += [(i + 1, k, j + 1, m) for (i, j), (k, m) in zip(ends, ends[1:], strict=False)]
    return sorted(out)


class Templates:
    def __init__(self, texts: dict[str, str], coverage: float, naming: dict[str, tuple[str, ...]] | None = None):
        self.names, self.coverage = list(texts), coverage
        h, self.words = self._hashed(list(texts.values()))
        if not all(self.words):
            raise ValueError("a template has no words")
        self.naming = [self._places(w, (naming or {}).get(x, ())) for x, w in zip(self.names, self.words, strict=True)]
        self.vocab = np.unique(h)
        self.has = np.stack([np.isin(self.vocab, np.array(w, tk.U64)) for w in self.words])
        self.least = [coverage * len(w) - 1e-9 for w in self.words]

    @staticmethod
    def _hashed(texts: list[str]) -> tuple[np.ndarray, list[list[int]]]:
        data, off = tk.buffers(pa.array(texts, pa.string()))
        s, e, limits = tk.words(data, off, tk.PLAIN)
        h = tk.word_hashes(data, s, e, lower=True)
        return h, [h[a:b].tolist() for a, b in zip(limits[:-1], limits[1:], strict=True)]

    @classmethod
    def _places(cls, words: list[int], phrases: tuple[str, ...]) -> list[tuple[int, int]]:
        """Where the phrases stand in a template: first word, last word + 1."""
        out, at = [], 0
        for p in cls._hashed(list(phrases))[1] if phrases else []:
            u = next((i for i in range(at, len(words) - len(p) + 1) if words[i : i + len(p)] == p), None)
            if not p or u is None:
                raise ValueError("a template lacks a naming phrase")
            at = u + len(p)
            out.append((u, at))
        return out

    def _named(self, t: int, h: np.ndarray, limits: np.ndarray, hits: np.ndarray) -> Iterator[tuple[int, list[tuple[int, int]]]]:
        """Row and alignment (places in template and batch) at every place of a template's first naming phrase."""
        words, least, (u, v) = self.words[t], self.least[t], self.naming[t][0]
        n, m = len(words), v - u
        if len(h) < m:
            return
        same = np.ones(len(h) - m + 1, bool)
        for k in range(m):
            same &= h[k : len(h) - m + 1 + k] == tk.U64(words[u + k])
        at = np.flatnonzero(same)
        rows = np.searchsorted(limits, at, side="right") - 1
        for j, r in zip(at.tolist(), rows.tolist(), strict=True):
            first, last = int(limits[r]), int(limits[r + 1])
            if j + m > last:
                continue
            best: list[tuple[int, int]] = []
            for before, after in ((u, n - v), (2 * n, 2 * n)):
                a, z = max(first, j - before), min(last, j + m + after)
                if hits[z] - hits[a] < least:
                    continue
                pairs = [(i, a + k) for i, k in align(words[:u], h[a:j].tolist())]
                pairs += [(u + k, j + k) for k in range(m)]
                pairs += [(v + i, j + m + k) for i, k in align(words[v:], h[j + m : z].tolist())]
                to = dict(pairs)
                whole = all(x in to and to[x] == to.get(p, -1) + x - p for p, q in self.naming[t][1:] for x in range(p, q))
                near = zip(self.naming[t], self.naming[t][1:], strict=False)
                if whole and all(to[p] - to[q - 1] - 1 <= 2 * (p - q) + 1 for (_, q), (p, _) in near) and len(pairs) > len(best):
                    best = pairs
            if len(best) >= least:
                yield r, best

    def scan(self, h: np.ndarray, limits: np.ndarray) -> Iterator[tuple[int, str, float, int, int]]:
        at = np.searchsorted(self.vocab, h)
        at[at == len(self.vocab)] = 0
        known = self.vocab[at] == h if len(h) else np.zeros(0, bool)
        for t, (name, words) in enumerate(zip(self.names, self.words, strict=True)):
            n = len(words)
            hits = np.zeros(len(h) + 1, np.int64)
            np.cumsum(known & self.has[t][at], out=hits[1:])
            best: dict[int, tuple[float, int, int]] = {}
            if self.naming[t]:
                for r, pairs in self._named(t, h, limits, hits):
                    if r not in best or len(pairs) / n > best[r][0]:
                        best[r] = (len(pairs) / n, pairs[0][1] - int(limits[r]), pairs[-1][1] + 1 - int(limits[r]))
                for r, (c, a, z) in best.items():
                    yield r, name, c, a, z
                continue
            size = 2 * n
            n_pass = np.maximum(-(-np.diff(limits) // n), 0)
            row = np.repeat(np.arange(len(n_pass)), n_pass)
            lo = limits[row] + (np.arange(len(row)) - np.repeat(np.cumsum(n_pass) - n_pass, n_pass)) * n
            hi = np.minimum(lo + size, limits[row + 1])
            for k in np.flatnonzero(hits[hi] - hits[lo] >= self.least[t]).tolist():
                part = h[lo[k] : hi[k]].tolist()
                if sum((Counter(part) & Counter(words)).values()) < self.least[t]:
                    continue
                pairs = align(words, part)
                if len(pairs) >= self.least[t]:
                    r = int(row[k])
                    found = (len(pairs) / n, int(lo[k] - limits[r]) + pairs[0][1], int(lo[k] - limits[r]) + pairs[-1][1] + 1)
                    if r not in best or found[0] > best[r][0]:
                        best[r] = found
            for r, (c, a, z) in best.items():
                yield r, name, c, a, z


def find_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates: dict[str, str] | None = None, coverage: float = COVERAGE, naming: dict[str, tuple[str, ...]] | None = None) -> DataFrame:
    """One row per document row and covered template: doc_id, license, coverage, word_start, word_end.

    ``naming`` gives naming phrases of the caller's templates; the built-in ones have theirs.
    """
    tpl = Templates(templates or TEMPLATES, coverage, naming if templates else NAMING)
    src = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, off = tk.buffers(batch.column(1))
            rows = []
            for a, z in tk.slices(data, off):
                d = data[off[a] : off[z]]
                s, e, limits = tk.words(d, off[a : z + 1] - off[a], tk.PLAIN)
                rows += [(a + r, *x) for r, *x in tpl.scan(tk.word_hashes(d, s, e, lower=True), limits)]
            cols = list(zip(*rows, strict=True)) if rows else [[]] * 5
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(cols[0], pa.int64())), pa.array(cols[1], pa.string()), pa.array(cols[2], pa.float64()), pa.array(cols[3], pa.int64()), pa.array(cols[4], pa.int64())], names=["doc_id", "license", "coverage", "word_start", "word_end"])

    return src.mapInArrow(run, _ROWS)


def op8_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_licenses(sparkkit.table(spark, sf_dir, "documents"))
