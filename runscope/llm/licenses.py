"""License scan by patience alignment.

Words that are unique both in a stretch of text and in a template are anchors.
Their longest increasing subsequence is fixed, and the gaps between anchors are
aligned in the same way; gaps without anchors match equal words at their ends.
Coverage is the share of template words that are matched.

A place may have words between those of the template: words with a digit (line
numbers, dates, sizes) count for nothing, of all others there may be ``FOREIGN``
times as many as the template has words, so ordinary sentences that happen to use
the words of a short notice are no place. No more than the length of the template,
or ``GAP`` words, may lie between two words that count.

A place with the wanted coverage holds at least one of the template's rarest words
(so many of them that the rest alone would not be enough). Windows start around
those words and reach as far as a place can, so the cost of a text grows with its
length and not faster.

Defined results: a null, empty or license-free text gives no row; a license
that stands in a text several times gives a row for each place, places of one
license do not overlap; repeated rows are scanned row by row; an empty table
gives an empty table.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator, Mapping

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from runscope.llm.common import ship

COVERAGE = 0.8
GAP = 12
FOREIGN = 0.65      # other words in a place, as a share of the template's words
DOCS_A_BATCH = 512
WORD = re.compile(r"\w+")
DIGIT = re.compile(r"\d")

# Notices as they stand in public licenses and file headers (fixed texts).
TEMPLATES = {
    "apache-2.0-line": "Licensed under the Apache License, Version 2.0.",
    "apache-2.0-header": (
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except '
        "in compliance with the License. You may obtain a copy of the License at "
        "http://www.apache.org/licenses/LICENSE-2.0"),
    "gpl-3.0-line": "This work is licensed under the GNU General Public License, version 3.",
    "gpl-3.0-header": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU "
        "General Public License as published by the Free Software Foundation, either version 3 of the License, "
        "or (at your option) any later version."),
    "cc-by-nc-4.0-line": "Licensed under CC BY-NC 4.0.",
    "mit-line": "Released under the MIT License.",
    "mit-grant": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and "
        'associated documentation files (the "Software"), to deal in the Software without restriction'),
    "bsd-conditions": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted "
        "provided that the following conditions are met"),
    "all-rights-reserved": "All rights reserved.",
}


def words_of(text: str | None) -> list[str]:
    return WORD.findall(text.lower()) if text else []


def _increasing(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Longest subsequence of pairs (sorted by the first part) that increases in the second: patience piles."""
    tops: list[int] = []
    at: list[int] = []
    before = [-1] * len(pairs)
    for k, (_, b) in enumerate(pairs):
        pile = bisect_left(tops, b)
        if pile:
            before[k] = at[pile - 1]
        if pile == len(tops):
            tops.append(b)
            at.append(k)
        else:
            tops[pile], at[pile] = b, k
    out, k = [], at[-1] if at else -1
    while k >= 0:
        out.append(pairs[k])
        k = before[k]
    return out[::-1]


def align(text: list[str], template: list[str]) -> list[tuple[int, int]]:
    """Matched ``(text, template)`` positions, increasing in both."""
    matched: list[tuple[int, int]] = []
    gaps = [(0, len(text), 0, len(template))]
    while gaps:
        a, b, c, d = gaps.pop()
        while a < b and c < d and text[a] == template[c]:
            matched.append((a, c))
            a, c = a + 1, c + 1
        while a < b and c < d and text[b - 1] == template[d - 1]:
            b, d = b - 1, d - 1
            matched.append((b, d))
        if a == b or c == d:
            continue
        ours, theirs = Counter(text[a:b]), Counter(template[c:d])
        place = {w: c + k for k, w in enumerate(template[c:d]) if theirs[w] == 1 and ours.get(w) == 1}
        anchors = _increasing([(a + k, place[w]) for k, w in enumerate(text[a:b]) if w in place])
        if not anchors:
            continue
        matched.extend(anchors)
        for (p, q), (r, s) in zip([(a - 1, c - 1), *anchors], [*anchors, (b, d)]):
            if p + 1 < r and q + 1 < s:
                gaps.append((p + 1, r, q + 1, s))
    return sorted(matched)


def _around(words: list[str], at: int, left: int, right: int, want: Mapping[str, int], gap: int) -> list[int]:
    """Places of up to ``left`` and ``right`` words that count on both sides of ``at``, up to a wide gap."""
    out = [at]
    for step, limit in ((-1, left), (1, right)):
        k = last = at
        side = []
        while len(side) < limit and 0 <= (k := k + step) < len(words) and abs(k - last) <= gap + 1:
            if words[k] in want or not DIGIT.search(words[k]):
                side.append(k)
                last = k
        out = side[::-1] + out if step < 0 else out + side
    return out


def _best_run(words: list[str], own: list[int], pairs: list[tuple[int, int]], need: int,
              foreign: int) -> tuple[int, int, int] | None:
    """``(matched, first word, last word)`` of the longest run of pairs without too many other words in it."""
    costs = [0]
    for k in own:
        costs.append(costs[-1] + (DIGIT.search(words[k]) is None))
    taken = [0]
    for k, _ in pairs:
        taken.append(taken[-1] + costs[k + 1] - costs[k])
    for n in range(len(pairs), need - 1, -1):
        best = None
        for first in range(len(pairs) - n + 1):
            a, b = pairs[first][0], pairs[first + n - 1][0]
            other = costs[b + 1] - costs[a] - (taken[first + n] - taken[first])
            if other <= foreign and (best is None or own[b] - own[a] < best[2] - best[1]):
                best = n, own[a], own[b]
        if best:
            return best
    return None


def scan(words: list[str], templates: Mapping[str, list[str]], vocabulary: set[str],
         coverage: float = COVERAGE) -> list[tuple[str, float, int, int]]:
    """``(license, coverage, first word, end word)`` of all places in one text."""
    places: dict[str, list[int]] = {}
    for k, w in enumerate(words):
        if w in vocabulary:
            places.setdefault(w, []).append(k)
    out = []
    for name, template in templates.items():
        m = len(template)
        need = -(-int(round(coverage * m * 1000)) // 1000)
        want = Counter(template)
        if sum(min(n, len(places.get(w, ()))) for w, n in want.items()) < need:
            continue
        rare = sorted(range(m), key=lambda i: (len(places.get(template[i], ())), i))[:m - need + 1]
        foreign, gap = int(FOREIGN * m), max(m, GAP)
        found = []
        for i in rare:
            for p in places.get(template[i], ()):
                for slack in sorted({min(max(2, m // 4), foreign), foreign}):   # close by first, so that the shortest place wins
                    own = _around(words, p, i + slack, m - i - 1 + slack, want, gap)
                    run = None
                    if len(own) >= need:
                        pairs = align([words[k] for k in own], template)
                        run = _best_run(words, own, pairs, need, foreign) if len(pairs) >= need else None
                    if run:
                        found.append((-run[0], run[2] - run[1], run[1], run[2] + 1))
                        if run[0] == m:
                            break
        taken: list[tuple[int, int]] = []
        for hits, _, start, end in sorted(set(found)):
            at = bisect_left(taken, (start, start))
            if (at < len(taken) and taken[at][0] < end) or (at and taken[at - 1][1] > start):
                continue
            taken.insert(at, (start, end))
            out.append((name, -hits / m, start, end))
    return sorted(out, key=lambda r: (r[2], r[0]))


def license_places(docs: DataFrame, templates: Mapping[str, str] = TEMPLATES, coverage: float = COVERAGE,
                   doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, license, coverage, start_word, end_word``; a narrow step over whole texts."""
    split = {name: words_of(body) for name, body in templates.items()}
    if not all(split.values()):
        raise ValueError("a template has no words")
    vocabulary = {w for own in split.values() for w in own}
    schema = pa.schema([("doc_id", pa.int64()), ("license", pa.string()), ("coverage", pa.float64()),
                        ("start_word", pa.int32()), ("end_word", pa.int32())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for big in batches:
            for at in range(0, big.num_rows, DOCS_A_BATCH):
                batch = big.slice(at, DOCS_A_BATCH)
                rows = [(doc, *place) for doc, body in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())
                        for place in scan(words_of(body), split, vocabulary, coverage)]
                columns = list(zip(*rows)) or [[]] * len(schema)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(columns, schema.types)], schema=schema)

    ship(docs.sparkSession)
    return docs.select(F.col(doc_id).cast("long"), F.col(text)).mapInArrow(
        run, "doc_id long, license string, coverage double, start_word int, end_word int")
