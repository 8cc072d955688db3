"""License scans: patience alignment of texts with license templates, and the share of a template's words that it covers."""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections import Counter, defaultdict
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from millrace.llm._common import PUNCTUATION, arrow_map, buffer_of, id_type, pick, word_hashes

#: The least coverage of a template that counts.
COVERAGE = 0.8
#: Foreign words in a stretch at the most, all its gaps together, and words of a template from which stretches with more foreign words than a quarter of its own are sought.
GAP, LONG = 1200, 20

#: License templates by name (public license texts and usual notices), their words in order.
TEMPLATES = {
    "MIT-notice": "Released under the MIT License",
    "MIT": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    "Apache-2.0-notice": "Licensed under the Apache License, Version 2.0",
    "Apache-2.0": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
    "GPL-3.0-notice": "This work is licensed under the GNU General Public License, version 3",
    "GPL-3.0": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "BSD-2-Clause": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    "BSD-3-Clause": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
    "CC0-1.0-notice": "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work",
    "CC0-1.0-line": "Licensed under CC0 1.0",
    "All-Rights-Reserved": "All rights reserved",
}
CC_KINDS = {"BY": "Attribution", "BY-SA": "Attribution-ShareAlike", "BY-NC": "Attribution-NonCommercial", "BY-ND": "Attribution-{}", "BY-NC-SA": "Attribution-NonCommercial-ShareAlike", "BY-NC-ND": "Attribution-NonCommercial-{}"}
CC_VERSIONS = {"4.0": ("International", "NoDerivatives"), "3.0": ("Unported", "NoDerivs"), "2.5": ("Generic", "NoDerivs"), "2.0": ("Generic", "NoDerivs"), "1.0": ("Generic", "NoDerivs")}
for _kind, _title in CC_KINDS.items():
    for _version, (_area, _none) in CC_VERSIONS.items():
        TEMPLATES[f"CC-{_kind}-{_version}-notice"] = f"This work is licensed under the Creative Commons {_title.format(_none)} {_version} {_area} License"
        TEMPLATES[f"CC-{_kind}-{_version}-line"] = f"Licensed under CC {_kind} {_version}"
#: Templates whose names begin alike differ in a few words or hold one another: of their stretches that overlap, only the nearest is the text's license.
FAMILIES = ("CC", "BSD-")


def family(name: str) -> str:
    return next((f for f in FAMILIES if name.startswith(f)), name)


def increasing(values: list[int]) -> list[int]:
    """Indexes of a longest strictly increasing subsequence, by patience piles with links to the pile before."""
    tops: list[int] = []
    at: list[int] = []
    back: list[int] = []
    for i, v in enumerate(values):
        pile = bisect_left(tops, v)
        back.append(at[pile - 1] if pile else -1)
        if pile == len(tops):
            tops.append(v)
            at.append(i)
        else:
            tops[pile], at[pile] = v, i
    out, i = [], at[-1] if at else -1
    while i >= 0:
        out.append(i)
        i = back[i]
    return out[::-1]


def patience(a: list, b: list) -> list[tuple[int, int]]:
    """Matched positions of two sequences: common ends, then words that each has once, then the gaps between those in the same way."""
    found: list[tuple[int, int]] = []
    todo = [(0, len(a), 0, len(b))]
    while todo:
        a0, a1, b0, b1 = todo.pop()
        while a0 < a1 and b0 < b1 and a[a0] == b[b0]:
            found.append((a0, b0))
            a0, b0 = a0 + 1, b0 + 1
        while a0 < a1 and b0 < b1 and a[a1 - 1] == b[b1 - 1]:
            a1, b1 = a1 - 1, b1 - 1
            found.append((a1, b1))
        if a0 == a1 or b0 == b1:
            continue
        once: list[dict] = []
        for seq, lo, hi in ((a, a0, a1), (b, b0, b1)):
            where: dict = {}
            for i in range(lo, hi):
                where[seq[i]] = -1 if seq[i] in where else i
            once.append(where)
        pairs = [(i, j) for w, i in once[0].items() if i >= 0 and (j := once[1].get(w, -1)) >= 0]
        pairs = [pairs[k] for k in increasing([j for _, j in pairs])]
        if not pairs:
            continue
        found += pairs
        edges = [(a0 - 1, b0 - 1), *pairs, (a1, b1)]
        todo += [(p + 1, r, q + 1, s) for (p, q), (r, s) in zip(edges[:-1], edges[1:], strict=True)]
    return sorted(found)


class Taken:
    """Stretches that don't overlap, in order, to be looked up in logarithmic time."""

    def __init__(self):
        self.starts: list[int] = []
        self.ends: list[int] = []

    def add(self, lo: int, hi: int) -> bool:
        """Takes a stretch unless it overlaps one that is taken; tells whether it did."""
        at = bisect_left(self.starts, hi)
        if at and self.ends[at - 1] > lo:
            return False
        self.starts.insert(at, lo)
        self.ends.insert(at, hi)
        return True


class Templates:
    """The templates' word hashes and, for each word that a match can't do without all of, where it is in which template.

    A text that covers a template holds at least one of any (words that may miss + 1) of its words; the longest are taken, as long words are rare.
    """

    def __init__(self, templates: tuple[tuple[str, str], ...], coverage: float, gap: int = GAP):
        self.gap = gap
        self.words: dict[str, list[int]] = {}
        seeds: dict[int, list[tuple[str, int]]] = {}
        for name, text in templates:
            raw = np.frombuffer(text.encode(), np.uint8)
            h, start, end, _ = word_hashes(raw, np.array([0, len(raw)]), PUNCTUATION)
            self.words[name] = h.tolist()
            need = int(np.ceil(coverage * len(h) - 1e-9))
            for i in sorted(range(len(h)), key=lambda i: (start[i] - end[i], i))[: len(h) - need + 1]:
                seeds.setdefault(int(h[i]), []).append((name, i))
        self.seeds = seeds
        self.table = np.sort(np.array([*seeds], np.uint64))
        self.coverage = coverage

    def scan(self, words: list[int], hits: list[int]) -> list[tuple[str, float, int, int]]:
        """Name, coverage and bounds in words of each stretch that covers a template; ``hits`` are the positions of seed words."""
        tried: set[tuple[str, int]] = set()
        found: list[tuple[float, str, int, int]] = []
        for p in hits:
            for name, i in self.seeds[words[p]]:
                if (name, p - i) in tried:
                    continue
                tried.add((name, p - i))
                template = self.words[name]
                slack = len(template) // 4 + 2
                # the template's own length first: what is around may repeat its words, which then anchor nothing
                lo, got = 0, []
                for more in (0, slack):
                    at = max(0, p - i - more)
                    new = patience(template, words[at : p - i + len(template) + more])
                    if len(new) > len(got):
                        lo, got = at, new
                    if len(got) == len(template):
                        break
                if got and len(got) >= self.coverage * len(template) - 1e-9:
                    found.append((len(got) / len(template), name, lo + got[0][1], lo + got[-1][1] + 1))
        found += self.apart(words, hits, found)
        by_name, by_family = defaultdict(Taken), defaultdict(Taken)
        order = sorted(found, key=lambda x: (-x[0], x[3] - x[2], x[2], x[1]))
        each = [(name, cover, lo, hi) for cover, name, lo, hi in order if by_name[name].add(lo, hi)]
        out = [x for x in sorted(each, key=self.nearness, reverse=True) if by_family[family(x[0])].add(x[2], x[3])]
        return sorted(out, key=lambda x: (x[2], x[0]))

    def apart(self, words: list[int], hits: list[int], found: list[tuple[float, str, int, int]]) -> list[tuple[float, str, int, int]]:
        """Stretches of long templates with more foreign words inside, up to ``gap``, around seed words that are in no whole stretch of ``found``.

        A stretch of so many words can only cover a template if it has enough of its words, counted as often as the template has them. That number is kept while the stretch moves over
        the text; where it suffices, the words from there on are aligned, more and more of them, as what comes after a stretch may repeat its words. Every place of the text is aligned a bounded
        number of times.
        """
        spans = defaultdict(list)
        for cover, name, lo, hi in found:
            if cover == 1:
                spans[name].append((lo, hi))
        seen = {name: (sorted(x), [hi for _, hi in sorted(x)]) for name, x in spans.items()}
        left: dict[str, list[int]] = defaultdict(list)
        for p in hits:
            for name in {name for name, _ in self.seeds[words[p]]}:
                if len(self.words[name]) >= LONG:
                    inside = seen.get(name)
                    if inside is not None:
                        k = bisect_right(inside[0], (p, len(words)))
                        if any(lo <= p < hi for lo, hi in inside[0][max(0, k - 2) : k]):
                            continue
                    left[name].append(p)
        out = []
        for name, places in left.items():
            template = self.words[name]
            need = int(np.ceil(self.coverage * len(template) - 1e-9))
            size, have = len(template) + self.gap, Counter(template)
            # the text around seed words, as stretches that don't meet
            areas: list[list[int]] = []
            for p in places:
                lo, hi = max(0, p - size), min(len(words), p + size)
                if areas and lo <= areas[-1][1]:
                    areas[-1][1] = hi
                else:
                    areas.append([lo, hi])
            for lo, hi in areas:
                own = [p for p in range(lo, hi) if words[p] in have]
                out += self._moved(name, template, have, words, own, need, size)
        return out

    def _moved(self, name: str, template: list[int], have: Counter, words: list[int], own: list[int], need: int, size: int) -> list[tuple[float, str, int, int]]:
        out, count, enough, a, b, again = [], Counter(), 0, 0, 0, -1
        while a < len(own):
            while b < len(own) and own[b] < own[a] + size:
                w = words[own[b]]
                count[w] += 1
                enough += count[w] <= have[w]
                b += 1
            done = a + 1
            if enough >= need and own[a] > again:
                lo, more, got = own[a], len(template) // 4 + 2, []
                while len(got) < len(template) and more < 2 * self.gap:
                    hi = min(lo + len(template) + min(more, self.gap), own[b - 1] + 1)
                    new, more = patience(template, words[lo:hi]), 2 * more
                    got = new if len(new) > len(got) else got
                if len(got) >= need:
                    # what lies before and after the matched words is left out, and what is there is aligned anew
                    first, last = lo + got[0][1], lo + got[-1][1] + 1
                    better = patience(template, words[first:last])
                    got, lo = (better, first) if len(better) >= len(got) else (got, lo)
                    out.append((len(got) / len(template), name, lo + got[0][1], lo + got[-1][1] + 1))
                    done = max(done, bisect_left(own, out[-1][3]))
                else:
                    again = lo + size // 4
            for w in (words[p] for p in own[a:done]):
                enough -= count[w] <= have[w]
                count[w] -= 1
            a = done
            b = max(a, b)
        return out

    def nearness(self, stretch: tuple[str, float, int, int]) -> tuple[int, str]:
        """Words in common, without those that only the template or, up to an eighth of it, only the stretch has; then the name, for equal ones."""
        name, cover, lo, hi = stretch
        n = len(self.words[name])
        common = round(cover * n)
        return common - (n - common) - min(hi - lo - common, 2 + n // 8), name


@lru_cache(4)
def prepared(templates: tuple[tuple[str, str], ...], coverage: float, gap: int = GAP) -> Templates:
    return Templates(templates, coverage, gap)


def scan_licenses(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates: dict[str, str] | None = None, coverage: float = COVERAGE, gap: int = GAP) -> DataFrame:
    """doc_id, license, coverage, start, end (code points of the first and after the last matched word): a row for each stretch of each template.

    Words are runs of letters, digits and non-ASCII characters, A-Z lowered. One pass over whole texts, no shuffle. Null or empty texts give no rows; rows with
    null or repeated ids are scanned as any other. A stretch may have foreign words in it: a quarter of the template's words and two more before and after a seed word, and for templates of
    ``LONG`` words or more up to ``gap`` in any places; beyond that it isn't found. Shorter notices aren't sought over gaps, as their few words lie about in any long text. Stretches of one template don't overlap; those of several may (a notice lies in the header that begins with it),
    but of a family (Creative Commons, BSD) only the nearest.
    """
    spec = tuple((templates or TEMPLATES).items())

    def make():
        known = prepared(spec, coverage, gap)

        def part(batch: pa.RecordBatch) -> pa.RecordBatch:
            raw, offsets = buffer_of(batch.column("text"))
            h, start, end, first = word_hashes(raw, offsets, PUNCTUATION)
            at = np.searchsorted(known.table, h).clip(max=max(0, len(known.table) - 1))
            hits = np.flatnonzero(known.table[at] == h) if len(known.table) and len(h) else np.zeros(0, np.int64)
            rows, names, covers, starts, ends = [], [], [], [], []
            which = np.searchsorted(first, hits, "right") - 1
            for r, lo, hi in zip(*_runs(which), strict=True):
                a, b, o = first[r], first[r + 1], offsets[r]
                found = known.scan(h[a:b].tolist(), (hits[lo:hi] - a).tolist())
                if not found:
                    continue
                points = np.concatenate([[0], np.cumsum((raw[o : offsets[r + 1]] & 0xC0) != 0x80)])  # code points before each byte
                for name, cover, x, y in found:
                    rows.append(r)
                    names.append(name)
                    covers.append(round(cover, 6))
                    starts.append(int(points[start[a + x] - o]))
                    ends.append(int(points[end[a + y - 1] - o]))
            return pa.RecordBatch.from_arrays(
                [batch.column("doc_id").take(pa.array(rows, pa.int64())), pa.array(names, pa.string()), pa.array(covers, pa.float64()), pa.array(starts, pa.int64()), pa.array(ends, pa.int64())],
                ["doc_id", "license", "coverage", "start", "end"],
            )

        return part

    return arrow_map(pick(df, id_col, text_col), make, f"doc_id {id_type(df, id_col)}, license string, coverage double, start long, end long", "text")


def _runs(values: np.ndarray) -> tuple[list[int], list[int], list[int]]:
    """Each run of equal values: the value, its first index and the one after."""
    if not len(values):
        return [], [], []
    cut = np.flatnonzero(np.diff(values)) + 1
    lo = np.concatenate([[0], cut])
    return values[lo].tolist(), lo.tolist(), [*cut.tolist(), len(values)]
