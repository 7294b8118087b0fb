"""License scans by patience alignment of texts with templates.

Words are compared in lower case without punctuation. Every window of
``1 + slack`` template lengths (shorter where the text ends) is a candidate; it
matches when its alignment covers at least ``coverage`` of the template's words,
in order. Of overlapping matches with one template the best covered stays, the
leftmost, then the shortest among equals.

Two bounds spare windows, none of them a match: it must hold one of the
template's key words (enough of its words, the longest first, that without them
the coverage could not be reached), and enough words in common whatever their
order, which is counted while the window slides. The others are aligned: words
unique on both sides are anchors, the longest increasing run of anchors stays,
and the gaps between them are aligned in the same way.

Defined results: null and empty texts have no match; templates without words
never match; every row is scanned whole and alone; other columns are not read.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from docketry.llm.common import Words, narrow, slices
from docketry.shipping import ship_with_tasks

ship_with_tasks(__name__)

# Public license texts and customary notices.
TEMPLATES = {
    "mit-notice": "Released under the MIT License.",
    "apache-2.0-notice": "Licensed under the Apache License, Version 2.0.",
    "gpl-3.0-notice": "This work is licensed under the GNU General Public License, version 3.",
    "cc-by-nc-4.0-notice": "Licensed under CC BY-NC 4.0.",
    "mit": """
        Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated
        documentation files (the "Software"), to deal in the Software without restriction, including without limitation
        the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and
        to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above
        copyright notice and this permission notice shall be included in all copies or substantial portions of the
        Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT
        LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.""",
    "isc": """
        Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby
        granted, provided that the above copyright notice and this permission notice appear in all copies.""",
    "apache-2.0-header": """
        Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance
        with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless
        required by applicable law or agreed to in writing, software distributed under the License is distributed on an
        "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.""",
    "gpl-3.0-header": """
        This program is free software: you can redistribute it and/or modify it under the terms of the GNU General
        Public License as published by the Free Software Foundation, either version 3 of the License, or (at your
        option) any later version.""",
    "lgpl-2.1-header": """
        This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser
        General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at
        your option) any later version.""",
    "mpl-2.0-header": """
        This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was
        not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.""",
    "bsd-2-clause": """
        Redistribution and use in source and binary forms, with or without modification, are permitted provided that
        the following conditions are met: Redistributions of source code must retain the above copyright notice, this
        list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above
        copyright notice, this list of conditions and the following disclaimer in the documentation and/or other
        materials provided with the distribution.""",
    "unlicense": """
        This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish,
        use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any
        purpose, commercial or non-commercial, and by any means.""",
    "cc-by-4.0-notice": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "cc-by-sa-4.0-notice": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
}

_PLAIN = re.compile(r"[\W_]+")


def plain_word(word: str) -> str:
    return _PLAIN.sub("", word.lower())


def plain_words(text: str) -> list[str]:
    return [p for p in map(plain_word, re.split("[\x20\x09-\x0d]+", text)) if p]


def increasing(values: list[int]) -> list[int]:
    """Places of a longest increasing subsequence of distinct values, by patience sorting."""
    tops: list[int] = []
    piles: list[int] = []
    before = [-1] * len(values)
    for i, v in enumerate(values):
        k = bisect_left(tops, v)
        before[i] = piles[k - 1] if k else -1
        tops[k : k + 1], piles[k : k + 1] = [v], [i]
    out, i = [], piles[-1] if piles else -1
    while i >= 0:
        out.append(i)
        i = before[i]
    return out[::-1]


def align(text: list, template: list) -> list[tuple[int, int]]:
    """Pairs of equal words in order, by anchors and the gaps between them."""
    pairs: list[tuple[int, int]] = []
    gaps = [(0, len(text), 0, len(template))]
    while gaps:
        a, b, c, d = gaps.pop()
        while a < b and c < d and text[a] == template[c]:
            pairs.append((a, c))
            a, c = a + 1, c + 1
        while a < b and c < d and text[b - 1] == template[d - 1]:
            pairs.append((b - 1, d - 1))
            b, d = b - 1, d - 1
        if a >= b or c >= d:
            continue
        here, there = Counter(text[a:b]), Counter(template[c:d])
        place = {w: j for j, w in enumerate(template[c:d], c) if there[w] == 1}
        anchors = [(i, place[w]) for i, w in enumerate(text[a:b], a) if w in place and here[w] == 1]
        chosen = [anchors[k] for k in increasing([j for _, j in anchors])]
        if not chosen:
            continue
        pairs += chosen
        ends = [(a - 1, c - 1), *chosen, (b, d)]
        gaps += [(i + 1, k, j + 1, m) for (i, j), (k, m) in zip(ends, ends[1:])]
    return sorted(pairs)


@dataclass(frozen=True)
class Template:
    name: str
    words: tuple[str, ...]
    keys: frozenset[str]


def make_template(name: str, text: str, coverage: float) -> Template:
    words = plain_words(text)
    keys, held = set(), 0
    for w in sorted(set(words), key=lambda w: (-len(w), w)):
        if held > (1 - coverage) * len(words) + 1e-9:
            break
        keys.add(w)
        held += words.count(w)
    return Template(name, tuple(words), frozenset(keys))


def candidate_windows(words: list[str], hits: list[int], wanted: Counter, longest: int, need: float) -> Iterator[int]:
    """Starts of the windows of ``longest`` words with a key word and ``need`` words of the template, in any order."""
    last, held, common = -2, Counter(), 0
    for hit in hits:
        for low in range(max(hit - longest + 1, last + 1, 0), hit + 1):
            if low != last + 1:  # not next to the window before: count anew
                held = Counter(w for w in words[low : low + longest] if w in wanted)
                common = sum(min(n, wanted[w]) for w, n in held.items())
            else:
                gone = words[low - 1]
                if gone in wanted:
                    held[gone] -= 1
                    common -= held[gone] < wanted[gone]
                if low + longest <= len(words) and (new := words[low + longest - 1]) in wanted:
                    held[new] += 1
                    common += held[new] <= wanted[new]
            last = low
            if common >= need:
                yield low


def match_template(words: list[str], hits: list[int], template: Template, coverage: float, slack: float) -> list[tuple]:
    """Matches in one text: start and end word, covered template words. ``hits``: where key words are, ascending."""
    size = len(template.words)
    need, longest, wanted = coverage * size - 1e-9, size + int(slack * size), list(template.words)
    found = set()
    for low in candidate_windows(words, hits, Counter(wanted), longest, need):
        at = [low + i for i, _ in align(words[low : low + longest], wanted)]
        if len(at) >= need:
            found.add((-len(at), at[0], at[-1] + 1))
    out: list[tuple] = []
    for n, a, b in sorted(found):
        if all(b <= x or y <= a for x, y, _ in out):
            out.append((a, b, -n))
    return sorted(out)


_MATCHES = ["id", "license", "start_word", "end_word", "covered_words", "coverage"]


def scan_licenses(
    docs: DataFrame, templates: dict[str, str] | None = None, coverage: float = 0.8, slack: float = 0.5,
    id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """One row per match: ``id, license, start_word, end_word, covered_words, coverage``. No shuffle."""
    made = [make_template(n, t, coverage) for n, t in (TEMPLATES if templates is None else templates).items()]
    made = [t for t in made if t.words]
    keys: dict[str, list[int]] = {}  # key word to the templates that have it
    for k, t in enumerate(made):
        for w in t.keys:
            keys.setdefault(w, []).append(k)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1):
            words = Words(batch.column(1).cast(pa.string()))
            forms = [plain_word(w) for w in words.distinct.to_pylist()]
            is_key = np.array([f in keys for f in forms], bool)
            empty = np.array([not f for f in forms], bool)
            ids, rows = batch.column(0), []
            ends = np.cumsum(words.per_doc)
            for doc in np.unique(words.doc[is_key[words.codes]]).tolist() if len(words.doc) else []:
                codes = words.codes[ends[doc] - words.per_doc[doc] : ends[doc]]
                codes = codes[~empty[codes]]
                text = [forms[c] for c in codes.tolist()]
                hits: dict[int, list[int]] = {}
                for p in np.flatnonzero(is_key[codes]).tolist():
                    for k in keys[text[p]]:
                        hits.setdefault(k, []).append(p)
                for k, at in sorted(hits.items()):
                    t = made[k]
                    for a, b, n in match_template(text, at, t, coverage, slack):
                        rows.append((ids[doc].as_py(), t.name, a, b, n, n / len(t.words)))
            kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.float64()]
            columns = list(zip(*rows)) if rows else [[]] * len(kinds)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=_MATCHES)

    schema = "id long, license string, start_word long, end_word long, covered_words long, coverage double"
    return narrow(docs, id_col, text_col).mapInArrow(run, schema)
