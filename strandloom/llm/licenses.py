"""License scans by patience alignment.

Words of a text and of a license template are aligned by patience: words that are unique in both are anchors,
the longest increasing subsequence of their places is kept, and the gaps between anchors are aligned in the
same way (common words at a gap's ends first).  Coverage is the share of the template's words that are matched.

Templates that differ from a sister license by a few words have *names* (``NAMES``): phrases such as "GNU General
Public License" and "version 3" that a match must hold whole and in order, whatever its coverage.  No word but
``FILLERS`` may stand inside a name, so "GNU Lesser General ..." or "Attribution-ShareAlike 4.0" is no match for
the license without that word; hyphens and spaces inside a name do not count ("Non-Commercial").  Every place
where a text holds a template's first name is an anchor; the next names are the nearest after it, and the
template's other words are aligned between, before and after them.

A match of a template without names lacks at most (1 - threshold) of its words, so it holds at least one of any
larger choice of them; a template's longest words are that choice, and every place where the text has one is an
anchor.  What lies beside an anchor is aligned in three surroundings: those that the template's words fill first,
those of its length and a little more, and those with room for ``INSERTED`` words of the text's own (half the
template's number if that is more).  So whole texts are searched, and no match with as many inserted words at most
is passed over for lack of a window; words of the text's own beyond that are no part of a notice.  Of overlapping
matches the best stands: higher coverage, then more words, then the license id in order, then the shorter one.

Defined results: null and empty texts hold no license; repeated rows give repeated rows; ids may be null; a
license that stands several times in a text gives a row each; columns of ``docs`` beside id and text are not read,
whatever their names.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WORD = re.compile(r"[^\W_]+")
#: Words of the text's own that a match may hold, as a holder's name and years.
INSERTED = 12

#: Words that may stand inside a name, or be left out of it.
FILLERS = frozenset("the a v version".split())

# Public license notices.
TEMPLATES = {
    "AGPL-3.0": "This work is licensed under the GNU Affero General Public License, version 3.",
    "AGPL-3.0-header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "Apache-1.1": "Licensed under the Apache License, Version 1.1.",
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0-header": 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0',
    "BSD": "Released under the BSD License.",
    "BSD-2-Clause": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    "BSD-2-Clause-name": "Released under the BSD 2-Clause License.",
    "BSD-3-Clause": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    "BSD-3-Clause-name": "Released under the BSD 3-Clause License.",
    "BSD-opening": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
    "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-4.0-code": "Licensed under CC BY 4.0.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC-BY-NC-4.0-notice": "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
    "CC-BY-NC-ND-4.0": "Licensed under CC BY-NC-ND 4.0.",
    "CC-BY-NC-ND-4.0-notice": "This work is licensed under a Creative Commons Attribution-NonCommercial-NoDerivatives 4.0 International License.",
    "CC-BY-NC-SA-4.0": "Licensed under CC BY-NC-SA 4.0.",
    "CC-BY-NC-SA-4.0-notice": "This work is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License.",
    "CC-BY-ND-4.0": "Licensed under CC BY-ND 4.0.",
    "CC-BY-ND-4.0-notice": "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License.",
    "CC-BY-SA-4.0": "Licensed under CC BY-SA 4.0.",
    "CC-BY-SA-4.0-notice": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "CC0-1.0": "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
    "GPL-2.0": "This work is licensed under the GNU General Public License, version 2.",
    "GPL-2.0-header": "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-3.0-header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "LGPL-2.1": "This work is licensed under the GNU Lesser General Public License, version 2.1.",
    "LGPL-2.1-header": "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
    "LGPL-3.0": "This work is licensed under the GNU Lesser General Public License, version 3.",
    "LGPL-3.0-header": "This library is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "MIT": "Released under the MIT License.",
    "MIT-text": 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software',
    "MPL-1.1": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 1.1.",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "Proprietary": "Copyright. All rights reserved.",
    "Proprietary-notice": "All rights reserved.",
}

# What tells these notices from their sisters, in the order in which it stands in them.
NAMES = {
    "AGPL-3.0": ["GNU Affero General Public License, version 3"],
    "AGPL-3.0-header": ["GNU Affero General Public License", "3 of the License"],
    "Apache-1.1": ["Apache License, Version 1.1"],
    "Apache-2.0": ["Apache License, Version 2.0"],
    "Apache-2.0-header": ["Apache License, Version 2.0"],
    "BSD": ["BSD License"],
    "BSD-2-Clause-name": ["BSD 2-Clause"],
    "BSD-3-Clause": ["endorse or promote products derived from this software"],
    "BSD-3-Clause-name": ["BSD 3-Clause"],
    "CC-BY-4.0": ["Creative Commons Attribution 4.0"],
    "CC-BY-4.0-code": ["CC BY 4.0"],
    "CC-BY-NC-4.0": ["CC BY-NC 4.0"],
    "CC-BY-NC-4.0-notice": ["Creative Commons Attribution-NonCommercial 4.0"],
    "CC-BY-NC-ND-4.0": ["CC BY-NC-ND 4.0"],
    "CC-BY-NC-ND-4.0-notice": ["Creative Commons Attribution-NonCommercial-NoDerivatives 4.0"],
    "CC-BY-NC-SA-4.0": ["CC BY-NC-SA 4.0"],
    "CC-BY-NC-SA-4.0-notice": ["Creative Commons Attribution-NonCommercial-ShareAlike 4.0"],
    "CC-BY-ND-4.0": ["CC BY-ND 4.0"],
    "CC-BY-ND-4.0-notice": ["Creative Commons Attribution-NoDerivatives 4.0"],
    "CC-BY-SA-4.0": ["CC BY-SA 4.0"],
    "CC-BY-SA-4.0-notice": ["Creative Commons Attribution-ShareAlike 4.0"],
    "GPL-2.0": ["GNU General Public License, version 2"],
    "GPL-2.0-header": ["GNU General Public License", "2 of the License"],
    "GPL-3.0": ["GNU General Public License, version 3"],
    "GPL-3.0-header": ["GNU General Public License", "3 of the License"],
    "LGPL-2.1": ["GNU Lesser General Public License, version 2.1"],
    "LGPL-2.1-header": ["GNU Lesser General Public License", "2.1 of the License"],
    "LGPL-3.0": ["GNU Lesser General Public License, version 3"],
    "LGPL-3.0-header": ["GNU Lesser General Public License", "3 of the License"],
    "MIT": ["MIT License"],
    "MPL-1.1": ["Mozilla Public License, v. 1.1"],
    "MPL-2.0": ["Mozilla Public License, v. 2.0"],
    "Proprietary": ["All rights reserved"],
    "Proprietary-notice": ["All rights reserved"],
}


def longest_increasing(places: list[int]) -> list[int]:
    """Indexes of a longest increasing subsequence."""
    tails: list[int] = []
    tops: list[int] = []
    before: list[int] = []
    for i, p in enumerate(places):
        k = bisect_left(tails, p)
        before.append(tops[k - 1] if k else -1)
        if k == len(tails):
            tails.append(p)
            tops.append(i)
        else:
            tails[k], tops[k] = p, i
    out, i = [], tops[-1] if tops else -1
    while i >= 0:
        out.append(i)
        i = before[i]
    return out[::-1]


def patience(a: list[str], b: list[str]) -> list[tuple[int, int]]:
    """Matched places (in a, in b), in order."""
    out, gaps = [], [(0, len(a), 0, len(b))]
    while gaps:
        a0, a1, b0, b1 = gaps.pop()
        while a0 < a1 and b0 < b1 and a[a0] == b[b0]:
            out.append((a0, b0))
            a0, b0 = a0 + 1, b0 + 1
        while a0 < a1 and b0 < b1 and a[a1 - 1] == b[b1 - 1]:
            a1, b1 = a1 - 1, b1 - 1
            out.append((a1, b1))
        if a0 == a1 or b0 == b1:
            continue
        in_a, in_b = Counter(a[a0:a1]), Counter(b[b0:b1])
        where = {w: j for j, w in enumerate(b[b0:b1], b0) if in_b[w] == 1}
        pairs = [(i, where[w]) for i, w in enumerate(a[a0:a1], a0) if in_a[w] == 1 and w in where]
        anchors = [pairs[k] for k in longest_increasing([j for _, j in pairs])]
        if not anchors:
            continue
        out += anchors
        ends = [(a0 - 1, b0 - 1), *anchors, (a1, b1)]
        gaps += [(i + 1, k, j + 1, m) for (i, j), (k, m) in zip(ends, ends[1:], strict=False)]
    return sorted(out)


@dataclass(frozen=True)
class Match:
    license_id: str
    coverage: float
    matched: int
    words: int
    start: int  # characters
    end: int


def bare(word: str) -> str:
    """A word as it counts in a name: nothing for fillers, "3" for "v3"."""
    return "" if word in FILLERS else word[1:] if word[0] == "v" and word[1:].isdigit() else word


@dataclass(frozen=True)
class Name:
    """A phrase of a template that a match must hold."""

    start: int  # words of the template
    end: int
    letters: str

    def end_in(self, words: list[str], p: int) -> int:
        """Where the name ends that begins with word ``p``, or 0."""
        if not bare(words[p]):
            return 0
        held = ""
        for q in range(p, len(words)):
            held += bare(words[q])
            if held == self.letters:
                return q + 1
            if not self.letters.startswith(held):
                return 0
        return 0


class Scanner:
    def __init__(self, templates: dict[str, str], threshold: float, names: dict[str, list[str]]):
        self.threshold = threshold
        self.templates = {k: [m[0] for m in WORD.finditer(v.lower())] for k, v in templates.items()}
        self.keys: dict[str, list[tuple[str, int]]] = {}
        self.firsts: dict[str, list[str]] = {}  # a word that a first name may begin with -> templates
        self.names: dict[str, list[Name]] = {}
        for name, words in self.templates.items():
            if name in names:
                self.names[name] = self.placed(words, names[name])
                letters = self.names[name][0].letters
                for begin in {letters[:k] for k in range(1, len(letters) + 1)}:
                    for word in (begin, "v" + begin) if begin.isdigit() else (begin,):
                        self.firsts.setdefault(word, []).append(name)
                continue
            lacking = int(len(words) * (1 - threshold) + 1e-9)
            for i in sorted(range(len(words)), key=lambda i: (-len(words[i]), i))[: lacking + 1]:
                self.keys.setdefault(words[i], []).append((name, i))

    @staticmethod
    def placed(template: list[str], phrases: list[str]) -> list[Name]:
        out, at = [], 0
        for phrase in phrases:
            words = [m[0] for m in WORD.finditer(phrase.lower())]
            at = next(i for i in range(at, len(template)) if template[i : i + len(words)] == words)
            out.append(Name(at, at + len(words), "".join(map(bare, words))))
            at += len(words)
        return out

    @staticmethod
    def filled(side: list[str], words: list[str], places: range, start: int) -> int:
        """The last of ``places`` that a word of ``side`` needs, or ``start``."""
        lacking, last = Counter(side), start
        for j in places:
            if not lacking:
                break
            if words[j] in lacking:
                last = j
                lacking[words[j]] -= 1
                lacking += Counter()
        return last

    def windows(self, template: list[str], i: int, words: list[str], p: int) -> Iterator[tuple[int, int]]:
        """Surroundings of place ``p`` that may hold the template with its word ``i`` there."""
        room, slack, n = max(INSERTED, len(template) // 2), max(2, len(template) // 4), len(words)
        first = self.filled(template[:i], words, range(p - 1, max(-1, p - i - room - 1), -1), p)
        last = self.filled(template[i + 1 :], words, range(p + 1, min(n, p - i + len(template) + room)), p)
        yield first, last + 1
        for more in (slack, room):
            yield max(0, p - i - more), min(n, p - i + len(template) + more)

    def named(self, name: str, words: list[str], p: int, spots: list[tuple[int, int]]) -> Match | None:
        """The match of a template whose first name begins with word ``p``."""
        template, parts = self.templates[name], self.names[name]
        room, slack, n = max(INSERTED, len(template) // 2), max(2, len(template) // 4), len(words)
        end = parts[0].end_in(words, p)
        if not end:
            return None
        held = [(p, end)]
        for a, b in zip(parts, parts[1:], strict=False):
            near = range(held[-1][1], min(n, held[-1][1] + b.start - a.end + room + 1))
            p = next((q for q in near if b.end_in(words, q)), -1)
            if p < 0:
                return None
            held.append((p, b.end_in(words, p)))
        first, last = held[0][0], held[-1][1]
        left, right = template[: parts[0].start], template[parts[-1].end :]
        before = [first - len(left) - more for more in (slack, room)] + [self.filled(left, words, range(first - 1, max(-1, first - len(left) - room - 1), -1), first)]
        after = [last + len(right) + more for more in (slack, room)] + [self.filled(right, words, range(last, min(n, last + len(right) + room)), last - 1) + 1]
        # most words, then the shortest surroundings
        heads = [(a, patience(left, words[a:first])) for a in {max(0, a) for a in before}]
        tails = [(b, patience(right, words[last:b])) for b in {min(n, b) for b in after}]
        a, head = max(heads, key=lambda x: (len(x[1]), x[0]))
        b, tail = max(tails, key=lambda x: (len(x[1]), -x[0]))
        matched = len(head) + len(tail)
        for k, (x, (s, e)) in enumerate(zip(parts, held, strict=True)):
            own = template[x.start : x.end]
            matched += max(len(patience(own, words[s:e])), sum(1 for w in own if bare(w)))
            if k:
                matched += len(patience(template[parts[k - 1].end : x.start], words[held[k - 1][1] : s]))
        if matched < self.threshold * len(template):
            return None
        start = a + head[0][1] if head else first
        stop = last + tail[-1][1] + 1 if tail else last
        return Match(name, matched / len(template), matched, len(template), spots[start][0], spots[stop - 1][1])

    def scan(self, text: str) -> list[Match]:
        low = text.lower()
        if len(low) != len(text):  # lower case may be longer for a few letters; keep offsets of the text
            low = "".join(c.lower() if len(c.lower()) == 1 else c for c in text)
        spots = [m.span() for m in WORD.finditer(low)]
        words = [low[s:e] for s, e in spots]
        keys = self.keys
        tried, found = set(), []
        for p in [i for i, w in enumerate(words) if w in self.firsts]:
            for name in self.firsts[words[p]]:
                m = self.named(name, words, p, spots)
                if m:
                    found.append(m)
        for p in [i for i, w in enumerate(words) if w in keys]:
            for name, i in keys[words[p]]:
                template = self.templates[name]
                room = max(INSERTED, len(template) // 2)
                if sum((Counter(template) & Counter(words[max(0, p - i - room) : p - i + len(template) + room])).values()) < self.threshold * len(template):
                    continue
                for a, b in self.windows(template, i, words, p):
                    if (name, a, b) in tried:
                        continue
                    tried.add((name, a, b))
                    pairs = patience(template, words[a:b])
                    if len(pairs) >= self.threshold * len(template):
                        found.append(Match(name, len(pairs) / len(template), len(pairs), len(template), spots[a + pairs[0][1]][0], spots[a + pairs[-1][1]][1]))
                    if len(pairs) == len(template):
                        break
        kept: list[Match] = []
        for m in sorted(found, key=lambda m: (-m.coverage, -m.matched, m.license_id, m.end - m.start, m.start)):
            if all(m.end <= k.start or k.end <= m.start for k in kept):
                kept.append(m)
        return sorted(kept, key=lambda m: m.start)


def scan(docs: DataFrame, templates: dict[str, str] | None = None, names: dict[str, list[str]] | None = None, threshold: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a license found: id, license_id, coverage, matched_words, template_words, char_start, char_end.  No shuffle.

    Own ``templates`` have the ``names`` given with them (template -> phrases in their order), or none.
    """
    wanted, told = (TEMPLATES, NAMES if names is None else names) if templates is None else (templates, names or {})

    def fn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(wanted, threshold, told)
        for b in batches:
            found = [(i, m) for i, text in enumerate(b.column(1).to_pylist()) if text for m in scanner.scan(text)]
            ids = b.column(0).take(pa.array([i for i, _ in found], pa.int64()))
            ms = [m for _, m in found]
            yield pa.RecordBatch.from_arrays(
                [ids, pa.array([m.license_id for m in ms], pa.string()), pa.array([m.coverage for m in ms], pa.float64()), pa.array([m.matched for m in ms], pa.int32()), pa.array([m.words for m in ms], pa.int32()), pa.array([m.start for m in ms], pa.int64()), pa.array([m.end for m in ms], pa.int64())],
                ["id", "license_id", "coverage", "matched_words", "template_words", "char_start", "char_end"])

    kept = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    return kept.mapInArrow(fn, f"id {kept.schema['id'].dataType.simpleString()}, license_id string, coverage double, matched_words int, template_words int, char_start bigint, char_end bigint").withColumnRenamed("id", id_col)
