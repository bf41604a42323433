"""License scan: fuzzy search for short notices.

A notice may differ in up to ``edits`` insertions, deletions or substitutions (case aside). Cut into one piece more than that,
at least one piece must then be found unchanged, so an automaton over all pieces of all notices locates candidates exactly.
In the stretch around a piece, the fewest edits that end at each place are counted; if they are few enough, the regex library's bounded-error
matching, bounded by them, verifies the match and reports its span and edits.

Defined results: a null or empty text has no notices; any length is searched whole; repeated rows give their spans once for
each row; a null doc_id is kept as null; an empty table gives no rows; other columns are ignored. Matches of one notice that
overlap are one: the one of fewest edits, then the first (its span is what the regex library reports as its best match); so are
those of several notices: the fewest edits, then the longest, then the first by name. A notice whose pieces would have fewer
than ``SHORTEST`` characters, as an empty one, raises a ValueError when the scan is planned. Spans count characters of the text; white space in a notice stands for any run of white space.
"""

from __future__ import annotations

import heapq
from bisect import bisect_right

import ahocorasick
import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docquery.llm.common import lean

#: Notice by licence. The edits allowed are a tenth of the length.
NOTICES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0",
    "MIT": "Released under the MIT License",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3",
    "GPL-2.0": "This work is licensed under the GNU General Public License, version 2",
    "LGPL-3.0": "licensed under the GNU Lesser General Public License",
    "AGPL-3.0": "licensed under the GNU Affero General Public License",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0",
    "CC-BY-SA-4.0": "Licensed under CC BY-SA 4.0",
    "CC-BY-4.0": "Licensed under CC BY 4.0",
    "CC0-1.0": "dedicated to the public domain under CC0 1.0 Universal",
    "BSD": "Redistribution and use in source and binary forms, with or without modification, are permitted",
    "MPL-2.0": "subject to the terms of the Mozilla Public License",
    "MIT-text": "Permission is hereby granted, free of charge, to any person obtaining a copy",
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any purpose",
    "LGPL-2.1": "licensed under the GNU Lesser General Public License, version 2.1",
    "GFDL-1.3": "licensed under the GNU Free Documentation License, Version 1.3",
    "GPL-header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License",
    "LGPL-header": "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License",
    "CC-BY-4.0-long": "licensed under a Creative Commons Attribution 4.0 International License",
    "CC-BY-SA-4.0-long": "licensed under a Creative Commons Attribution-ShareAlike 4.0 International License",
    "CC-BY-NC-4.0-long": "licensed under a Creative Commons Attribution-NonCommercial 4.0 International License",
    "CC-BY-ND-4.0-long": "licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License",
    "CC-BY-SA-3.0": "licensed under the Creative Commons Attribution-ShareAlike 3.0 Unported License",
    "EPL-2.0": "made available under the terms of the Eclipse Public License 2.0",
    "CDDL-1.0": "subject to the terms of the Common Development and Distribution License",
    "EUPL-1.2": "Licensed under the European Union Public Licence",
    "BSL-1.0": "Distributed under the Boost Software License, Version 1.0",
    "Unlicense": "This is free and unencumbered software released into the public domain",
    "Zlib": "This software is provided 'as-is', without any express or implied warranty",
    "WTFPL": "Do What The Fuck You Want To Public License",
    "Artistic-2.0": "licensed under the terms of the Artistic License 2.0",
    "OFL-1.1": "licensed under the SIL Open Font License, Version 1.1",
    "PSF-2.0": "licensed under the Python Software Foundation License",
    "PHP-3.01": "This source file is subject to version 3.01 of the PHP license",
    "OSL-3.0": "Licensed under the Open Software License version 3.0",
    "MS-PL": "licensed under the Microsoft Public License",
    "BSD-style": "Use of this source code is governed by a BSD-style license",
    "public-domain": "This work is hereby released into the public domain",
    "SPDX-Apache-2.0": "SPDX-License-Identifier: Apache-2.0",
    "SPDX-MIT": "SPDX-License-Identifier: MIT",
    "SPDX-BSD-3-Clause": "SPDX-License-Identifier: BSD-3-Clause",
    "SPDX-GPL-2.0": "SPDX-License-Identifier: GPL-2.0",
    "SPDX-GPL-3.0": "SPDX-License-Identifier: GPL-3.0",
    "SPDX-MPL-2.0": "SPDX-License-Identifier: MPL-2.0",
    "all-rights": "All rights reserved",
    "all-rights-reserved": "All rights reserved. No part of this publication may be reproduced",
}
SHORTEST = 4


def edits_for(notice: str) -> int:
    return len(notice) // 10


def pieces(notice: str, edits: int) -> list[tuple[str, int]]:
    """The notice in edits + 1 parts of about equal length, with the place of each."""
    n, k = len(notice), edits + 1
    cuts = [i * n // k for i in range(k + 1)]
    return [(notice[a:b], a) for a, b in zip(cuts, cuts[1:])]


class Notice:
    """A notice, how many edits it may have, and where its pieces end."""

    def __init__(self, text: str, edits: int):
        self.text, self.edits = text, edits
        self.ends = {a: a + len(p) for p, a in pieces(text, edits)}
        self.places: dict[str, int] = {}
        for i, c in enumerate(text):
            self.places[c] = self.places.get(c, 0) | 1 << i
        self.patterns: dict[int, regex.Pattern] = {}

    def pattern(self, edits: int) -> regex.Pattern:
        """Bounded by the fewest edits that a match is known to have, which the regex library finds far sooner than a looser bound."""
        if edits not in self.patterns:
            self.patterns[edits] = regex.compile(f"(?:{regex.escape(self.text, literal_spaces=True)}){{e<={edits}}}", regex.BESTMATCH)
        return self.patterns[edits]

    def ends_at(self, text: str, a: int, b: int) -> list[tuple[int, int]]:
        """(end, fewest edits) of every place between ``a`` and ``b`` where a match may end, by bit-parallel dynamic programming."""
        m = len(self.text)
        mask, high = (1 << m) - 1, 1 << (m - 1)
        up, down, score, most, out = mask, 0, m, self.edits, []
        places = self.places
        for i in range(a, b):
            equal = places.get(text[i], 0)
            vertical = equal | down
            horizontal = (((equal & up) + up) ^ up) | equal
            rise, fall = (down | ~(horizontal | up)) & mask, up & horizontal
            if rise & high:
                score += 1
            elif fall & high:
                score -= 1
            if score <= most:
                out.append((i + 1, score))
            rise, fall = rise << 1 & mask, fall << 1 & mask
            up, down = (fall | ~(vertical | rise)) & mask, rise & vertical
        return out

    def distance(self, stretch: str) -> int:
        """The fewest edits of the notice anywhere in the stretch, or one more than are allowed."""
        return min((e for _, e in self.ends_at(stretch, 0, len(stretch))), default=self.edits + 1)


class Scanner:
    def __init__(self, notices: dict[str, str]):
        self.automaton = ahocorasick.Automaton()
        self.notices = {}
        for name, notice in notices.items():
            notice = " ".join(notice.lower().split())
            k = edits_for(notice)
            if len(notice) // (k + 1) < SHORTEST:  # the shortest of pieces()
                raise ValueError(f"{name}: pieces of fewer than {SHORTEST} characters")
            self.notices[name] = Notice(notice, k)
            for piece, at in pieces(notice, k):
                self.automaton.add_word(piece, [*self.automaton.get(piece, []), (name, at)])
        self.automaton.make_automaton()

    def scan(self, text: str) -> list[tuple[str, int, int, int, str]]:
        """licence, start, end, edits and the matched text, for every notice found anywhere in the text."""
        folded, places = fold(text)
        near: dict[str, list[tuple[int, int]]] = {}
        for end, hits in self.automaton.iter(folded):
            for name, at in hits:
                n = self.notices[name]
                begin = end + 1 - n.ends[at]
                near.setdefault(name, []).append((max(0, begin - n.edits), min(len(folded), begin + len(n.text) + n.edits)))
        found = []
        for name, stretches in near.items():
            for a, b in _joined(stretches):
                found += [(name, *m) for m in matches(self.notices[name], folded, a, b)]
        kept: list[tuple[str, int, int, int]] = []
        for m in sorted(found, key=lambda m: (m[3], m[1] - m[2], m[0], m[1])):
            i = bisect_right(kept, m[1], key=lambda k: k[1])
            if (not i or kept[i - 1][2] <= m[1]) and (i == len(kept) or m[2] <= kept[i][1]):
                kept.insert(i, m)
        return [(name, places(a), places(b), e, text[places(a) : places(b)]) for name, a, b, e in kept]


def fold(text: str):
    """Lower case with each run of white space as one space, and from its places to those of the text."""
    low = text.lower()
    if len(low) != len(text):  # a few characters have longer lower case; they stay as they are
        low = "".join(c if len(c.lower()) != 1 else c.lower() for c in text)
    runs = [(m.start(), m.end()) for m in regex.finditer(r"\s{2,}|[^\S ]", low)]
    if not runs:
        return low, lambda i: i
    parts, shifts, at, lost = [], [(0, 0)], 0, 0
    for a, b in runs:
        parts += [low[at:a], " "]
        at, lost = b, lost + b - a - 1
        if b - a > 1:
            shifts.append((b - lost, lost))
    parts.append(low[at:])
    keys = [s for s, _ in shifts]

    def places(i: int) -> int:
        return i + shifts[bisect_right(keys, i) - 1][1]

    return "".join(parts), places


def _joined(stretches: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for a, b in sorted(stretches):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def _taken(taken: list[tuple[int, int, int]], end: int) -> tuple[int, bool]:
    """Where the last taken match before ``end`` ends, and whether one covers ``end``. Taken matches are in order and disjoint."""
    i = bisect_right(taken, end, key=lambda t: t[0] + 1)  # the first that starts at end or later
    before = taken[i - 1][1] if i else 0
    return before, before >= end


def matches(notice: Notice, folded: str, a: int, b: int) -> list[tuple[int, int, int]]:
    """start, end and edits of the matches in a stretch that don't overlap: the fewest edits first, then the first.

    One pass counts the fewest edits of a match that ends at each place. Places are then taken from the best on; the regex
    library verifies each in the bounded stretch before it. Where an earlier match cuts that stretch short, the edits are
    counted anew in what is left, and the place waits for its turn. So the work grows with the stretch, not with its square.
    """
    n = len(notice.text)
    queue = [(e, end) for end, e in notice.ends_at(folded, a, b)]
    heapq.heapify(queue)
    taken: list[tuple[int, int, int]] = []
    while queue:
        edits, end = heapq.heappop(queue)
        before, covered = _taken(taken, end)
        if covered:
            continue
        low = max(a, before, end - n - notice.edits)
        left = next((e for at, e in notice.ends_at(folded, low, end) if at == end), None) if low > max(a, end - n - edits) else edits
        if left is None:
            continue
        if left > edits:
            heapq.heappush(queue, (left, end))
            continue
        m = notice.pattern(edits).search(folded, low, end)
        if m is not None:
            taken.insert(bisect_right(taken, m.start(), key=lambda t: t[0]), (m.start(), m.end(), sum(m.fuzzy_counts)))
    return taken


def scan(docs: DataFrame, notices: dict[str, str] | None = None) -> DataFrame:
    """doc_id, licence, start, end, edits, matched: every notice in every document."""
    chosen = dict(NOTICES if notices is None else notices)
    Scanner(chosen)  # notices that can't be searched for are an error here, not in a task
    made: list[Scanner] = []

    @F.pandas_udf("array<struct<licence:string,start:int,end:int,edits:int,matched:string>>")
    def find(texts: pd.Series) -> pd.Series:
        if not made:
            made.append(Scanner(chosen))
        return texts.map(lambda t: made[0].scan(t) or None)

    lean(docs.sparkSession)
    found = docs.where(F.length("text") > 0).select("doc_id", find("text").alias("found"))
    return found.select("doc_id", F.inline("found"))
