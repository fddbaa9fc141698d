"""License scans: winnowed template fingerprints pick candidates, banded alignment confirms them.

Words are lower-cased and stripped of outer punctuation, quotes and comment marks. Every
``width``-word gram of a template is hashed and winnowed (the smallest hash of each
``window`` neighbours), and an inverted index maps a fingerprint to its templates and
places. Where a gram of a text is in the index, the text may hold that template along
that diagonal; neighbouring diagonals make one candidate. A banded alignment of the
whole template against the text around it counts the template words that it matches,
and gives the first and last matched word: coverage is their share of the template.
Candidates of one template are also chained where they follow one another in text and template, ``gap`` template lengths apart at most, and aligned in a
band that holds them all: so foreign words in the middle of a notice do not hide it.

The index depends on the templates only, so it is small at every size of the corpus.

Defined results: null and empty texts have no matches; texts of any length are scanned
whole; repeated rows give repeated results; an empty table gives no rows; further columns
of the input are not read. A match needs ``width + window - 1`` template words in a row
somewhere, as winnowing promises a fingerprint only there; words that an insertion beyond
the band cuts off count if they have such a run. Equal alignments give the
tightest span, the later one of equally tight ones. Matches of one template do not overlap;
those of several templates may.
"""

from __future__ import annotations

from bisect import bisect_left
from itertools import groupby

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

from spanloom.llm.common import codes, map_slices, split_words, table, text_bytes
from spanloom.llm.registry import QUERIES
from spanloom.llm.xxh import xxh64

PUNCTUATION = "\"'`.,;:!?()[]{}<>#*|~=_/\\"

#: fixed values: public notices and license texts
TEMPLATES: dict[str, str] = {
    "notice-apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "notice-mit": "Released under the MIT License.",
    "notice-cc-by-nc-4.0": "Licensed under CC BY-NC 4.0.",
    "notice-gpl-3": "This work is licensed under the GNU General Public License, version 3.",
    "mit": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation "
        "files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, "
        "modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software "
        "is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be "
        "included in all copies or substantial portions of the Software."
    ),
    "isc": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, "
        "provided that the above copyright notice and this permission notice appear in all copies."
    ),
    "bsd": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following "
        "conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the "
        "following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and "
        "the following disclaimer in the documentation and/or other materials provided with the distribution."
    ),
    "apache-2.0": (
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the "
        "License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law "
        "or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR "
        "CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and "
        "limitations under the License."
    ),
    "gpl-3.0-or-later": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as "
        "published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program "
        "is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of "
        "MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details."
    ),
    "mpl-2.0": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed "
        "with this file, You can obtain one at http://mozilla.org/MPL/2.0/."
    ),
    "unlicense": (
        "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, "
        "sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or "
        "non-commercial, and by any means."
    ),
}

SCHEMA = "doc_id long, template string, start long, end long, matched_words long, template_words long, coverage double"


def plain_words(kinds: pa.Array) -> pa.Array:
    return pc.ascii_trim(pc.ascii_lower(kinds), PUNCTUATION)


def gram_hashes(ids: np.ndarray, width: int) -> np.ndarray:
    """Hash of each run of ``width`` word numbers."""
    if len(ids) < width:
        return np.zeros(0, np.uint64)
    grams = np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(ids.astype("<i4"), width))
    return xxh64(grams.view(np.uint8).ravel(), np.arange(len(grams)) * 4 * width, np.full(len(grams), 4 * width), 3)


def winnow(hashes: np.ndarray, window: int) -> np.ndarray:
    """Places of the fingerprints: the rightmost smallest hash of each ``window`` neighbours."""
    if len(hashes) <= window:
        return np.array([len(hashes) - 1 - int(np.argmin(hashes[::-1]))]) if len(hashes) else np.zeros(0, int)
    view = np.lib.stride_tricks.sliding_window_view(hashes, window)
    return np.unique(np.arange(len(view)) + window - 1 - np.argmin(view[:, ::-1], axis=1))


class Index:
    """Inverted index from fingerprints to templates and places in them."""

    def __init__(self, templates: dict[str, str], width: int = 3, window: int = 2) -> None:
        self.names = list(templates)
        words = [[w for w in plain_words(pa.array(templates[k].split())).to_pylist() if w] for k in self.names]
        self.vocabulary = pa.array(sorted({w for x in words for w in x}), pa.string())
        place = {w: k + 1 for k, w in enumerate(self.vocabulary.to_pylist())}
        self.words = [np.array([place[w] for w in x]) for x in words]
        self.width = width
        found = []
        for t, ids in enumerate(self.words):
            hashes = gram_hashes(ids, width)
            found += [(int(hashes[k]), t, k) for k in winnow(hashes, window)]
        found.sort()
        self.hash = np.array([x[0] for x in found], np.uint64)
        self.template = np.array([x[1] for x in found])
        self.place = np.array([x[2] for x in found])

    def probe(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pairs (place among ``hashes``, row of the index)."""
        lo, hi = np.searchsorted(self.hash, hashes, "left"), np.searchsorted(self.hash, hashes, "right")
        hit = np.flatnonzero(hi > lo)
        n = hi[hit] - lo[hit]
        return np.repeat(hit, n), np.repeat(lo[hit], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)


def align(template: np.ndarray, text: np.ndarray, low: int, high: int) -> tuple[int, int, int]:
    """Most template words matched in order, with text place minus template place in [low, high].

    Returns the number of matches and the first and last matched place of ``text`` (-1 if
    none). Ties prefer the later first place, then the earlier last place: the tightest span.
    One band row a template word: a state is the number (matches, first place + 1, places
    behind the last), so that the best state is the greatest number.
    """
    base = len(text) + 2
    unit = base * base
    none = len(text)  # no match, no first place, last place -1
    diagonal = np.arange(low, high + 1)
    before = np.full(len(diagonal), none, np.int64)
    for i, word in enumerate(template.tolist()):
        now = np.r_[before[1:], none]  # this template word stays unmatched
        j = diagonal + i
        met = np.flatnonzero((j >= 0) & (j < len(text)))
        met = met[text[j[met]] == word]
        if len(met):
            n, first = before[met] // unit, before[met] % unit // base
            first = np.where(n > 0, first, j[met] + 1)
            now[met] = np.maximum(now[met], (n + 1) * unit + first * base + len(text) - 1 - j[met])
        before = np.maximum.accumulate(now)  # a text word stays unmatched
    best = int(before.max(initial=none))
    return best // unit, best % unit // base - 1, len(text) - 1 - best % base


def chains(at: np.ndarray, place: np.ndarray, wide: int, most: int) -> list[tuple[int, int]]:
    """Lowest and highest diagonal of disjoint chains of hits in the order of text and template, longest first.

    Neighbours of a chain are at most ``most`` words of text apart; a chain loses half a hit
    where its diagonal moves by more than ``wide``. Chains that never do are left out.
    """
    by = np.lexsort((place, at))
    at, place = at[by], place[by]
    diagonal = at - place
    total, back = np.ones(len(by)), np.full(len(by), -1)
    low = 0
    for k in range(1, len(by)):
        while at[low] + most < at[k]:
            low += 1
        move = np.abs(diagonal[low:k] - diagonal[k])
        value = total[low:k] - 0.5 * (move > wide) - 1e-9 * move
        value[(place[low:k] >= place[k]) | (at[low:k] >= at[k])] = 0
        if len(value) and value.max() > 0:
            back[k] = low + int(np.argmax(value))
            total[k] += value.max()
    out, used = [], np.zeros(len(by), bool)
    for k in np.argsort(-total, kind="stable").tolist():
        chain = []
        while k >= 0 and not used[k]:
            used[k] = True
            chain.append(k)
            k = int(back[k])
        own = diagonal[chain]
        if len(chain) > 1 and (np.abs(np.diff(own)) > wide).any():
            out.append((int(own.min()), int(own.max())))
    return out


def matches(texts: pa.Array, index: Index, min_coverage: float, slack: float = 0.2, gap: float = 1.0) -> list[tuple[int, int, int, int, int]]:
    """``(text, template, first word, last word, matched words)`` of every match, by text."""
    rows, words = split_words(texts)
    code, kinds = codes(words)
    plain = plain_words(kinds)
    known = pc.fill_null(pc.index_in(plain, index.vocabulary), -1).to_numpy(zero_copy_only=False).astype(np.int64) + 1
    blank = pc.equal(pc.binary_length(plain), 0).to_numpy(zero_copy_only=False)
    keep = ~blank[code] if len(code) else np.zeros(0, bool)
    rows, ids, which = rows[keep], known[code[keep]], np.flatnonzero(keep)
    w = index.width
    full = np.flatnonzero((np.convolve(ids > 0, np.ones(w), "valid") == w) & (rows[w - 1 :] == rows[: len(rows) - w + 1])) if len(ids) >= w else np.zeros(0, int)
    if not len(full):
        return []
    grams = np.ascontiguousarray(ids[full[:, None] + np.arange(w)].astype("<i4"))
    hashes = xxh64(grams.view(np.uint8).ravel(), np.arange(len(grams)) * 4 * w, np.full(len(grams), 4 * w), 3)
    hit, entry = index.probe(hashes)
    if not len(hit):
        return []
    at, template, place = full[hit], index.template[entry], index.place[entry]
    diagonal, row = at - place, rows[at]
    size = np.array([len(x) for x in index.words])
    wide = np.maximum(2, (slack * size).astype(np.int64))
    order = np.lexsort((diagonal, template, row))
    at, template, place, diagonal, row = at[order], template[order], place[order], diagonal[order], row[order]
    new_pair = np.r_[True, (row[1:] != row[:-1]) | (template[1:] != template[:-1])]
    cuts = np.flatnonzero(new_pair | np.r_[True, np.diff(diagonal) > wide[template[1:]]])
    ends = np.searchsorted(rows, np.arange(len(texts) + 1))
    out: list[tuple[int, int, int, int, int]] = []

    def settle(r: int, t: int, lo: int, hi: int) -> None:
        lo, hi = lo - int(wide[t]), hi + int(wide[t])
        base, stop = max(int(ends[r]), lo), min(int(ends[r + 1]), hi + int(size[t]))
        n, first, last = align(index.words[t], ids[base:stop], lo - base, hi - base)
        if n >= min_coverage * size[t]:
            out.append((r, t, int(which[base + first]), int(which[base + last]), n))

    for s, e in zip(cuts.tolist(), [*cuts[1:].tolist(), len(at)]):  # neighbouring diagonals make one candidate
        settle(int(row[s]), int(template[s]), int(diagonal[s]), int(diagonal[e - 1]))
    edges = np.flatnonzero(new_pair)
    for s, e in zip(edges.tolist(), [*edges[1:].tolist(), len(at)]):  # what a longer insertion has split
        if diagonal[e - 1] - diagonal[s] > wide[template[s]]:
            r, t = int(row[s]), int(template[s])
            for lo, hi in chains(at[s:e], place[s:e], int(wide[t]), int((1 + gap) * size[t])):
                settle(r, t, lo, hi)
    return apart(out)


def apart(found: list[tuple[int, int, int, int, int]]) -> list[tuple[int, int, int, int, int]]:
    """Of each template the matches that do not overlap and have the most words together, in the narrowest spans."""
    kept: list[tuple[int, int, int, int, int]] = []
    for _, own in groupby(sorted(set(found)), lambda x: x[:2]):
        mine = sorted(own, key=lambda x: (x[3], x[2]))
        ends = [x[3] for x in mine]
        best: list[tuple[tuple[int, int], int, bool]] = [((0, 0), 0, False)]  # words and minus span, where it goes on, whether taken
        for k, x in enumerate(mine):
            before = bisect_left(ends, x[2], 0, k)
            words, span = best[before][0]
            take = (words + x[4], span - (x[3] - x[2] + 1))
            best.append((take, before, True) if take > best[k][0] else (best[k][0], k, False))
        k, chosen = len(mine), []
        while k:
            _, before, taken = best[k]
            chosen += [mine[k - 1]] if taken else []
            k = before
        kept += chosen[::-1]
    return kept


def license_scan(docs: DataFrame, templates: dict[str, str] | None = None, min_coverage: float = 0.8, width: int = 3, window: int = 2) -> DataFrame:
    """One row per match: template, code-point span of the matched words, and coverage."""
    index = Index(TEMPLATES if templates is None else templates, width, window)

    def f(part: pa.RecordBatch) -> dict:
        texts = part.column("text")
        found = matches(texts, index, min_coverage)
        raw, at = text_bytes(texts)
        all_rows = split_words(texts)[0]
        word_base = np.searchsorted(all_rows, np.arange(len(texts) + 1))
        rows, spans = [], []
        for row, own in groupby(found, lambda x: x[0]):
            body = raw[at[row] : at[row + 1]]
            space = np.isin(body, np.frombuffer(b" \t\n\v\f\r", np.uint8))
            start = np.flatnonzero(~space & np.r_[True, space[:-1]])
            stop = np.flatnonzero(~space & np.r_[space[1:], True]) + 1
            point = np.r_[0, np.cumsum((body & 0xC0) != 0x80)]
            base = word_base[row]
            for _, t, first, last, n in own:
                size = len(index.words[t])
                rows.append(row)
                spans.append((index.names[t], int(point[start[first - base]]), int(point[stop[last - base]]), n, size, n / size))
        columns = list(zip(*spans)) or [()] * 6
        kinds = (pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.float64())
        names = ("template", "start", "end", "matched_words", "template_words", "coverage")
        return {"doc_id": part.column("doc_id").take(pa.array(rows, pa.int64()))} | {k: pa.array(c, x) for k, c, x in zip(names, columns, kinds)}

    return map_slices(docs, ["doc_id", "text"], f, SCHEMA)


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan(table(spark, sf_dir, "documents"))


QUERIES["op3_license_scan"] = op3_license_scan
