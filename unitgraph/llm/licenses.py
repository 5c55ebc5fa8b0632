"""Licence notices in documents: MinHash bands over text windows, verified by shingle containment."""

from __future__ import annotations

import re
from bisect import bisect
from collections import Counter
from collections.abc import Iterator, Mapping
from dataclasses import dataclass
from math import ceil, log

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from unitgraph.llm.common import as_text
from unitgraph.llm.substring import grams, sliding_min

# The words of common licence notices and of short licences in full.
LICENSES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0",
    "Apache-2.0-notice": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at",
    "MIT": "Released under the MIT License",
    "MIT-permission": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction",
    "MIT-text": """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:
The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
    "ISC-text": """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.
THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.""",
    "BSD-redistribution": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    "BSD-2-Clause-text": """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:
1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.
THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.""",
    "Zlib-text": """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.
Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:
1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.
2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.
3. This notice may not be removed or altered from any source distribution.""",
    "Unlicense-text": """This is free and unencumbered software released into the public domain.
Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.
In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law.""",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3",
    "GPL-notice": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation",
    "GPL-warranty": "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.",
    "MPL-2.0-notice": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0",
    "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License",
    "all-rights-reserved": "All rights reserved",
}
SHINGLE = 5
#: The chance that no band retrieves a window that holds enough of a template.
MISS = 3e-8
TOKEN = re.compile(r"[^\W_]+(?:[.\-][^\W_]+)*")


def _words(text: str) -> tuple[list[tuple[int, int]], np.ndarray]:
    at = [m.span() for m in TOKEN.finditer(text)]
    return at, np.fromiter((xxhash.xxh3_64_intdigest(text[a:b].lower().encode()) for a, b in at), np.uint64, len(at))


def _permuted(g: np.ndarray, band: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (g ^ np.uint64(0x9E3779B97F4A7C15 * (band + 1) & (2**64 - 1))) * np.uint64(0xD6E8FEB86659FD93)
        return x ^ (x >> np.uint64(32))


@dataclass
class Template:
    name: str
    words: int  # of a shingle
    width: int  # of a window, in shingles
    need: int
    order: np.ndarray  # shingles as they follow each other
    shingles: np.ndarray  # distinct
    bands: list[np.uint64]


class Templates:
    """Every template's shingles and one-row bands, and a table of the shingles that stand for a band.

    A window is as many words as the template divided by ``least``, so that words may be put in. One with
    ``need`` or more of the template's shingles, that share of them, has a Jaccard similarity of
    need / (window + shingles - need) or more with it. There are as many bands of one row as miss it with
    a chance of 3e-8 at most: 19 to 43 for the built-in templates. A band is the template's least shingle
    in one order; a window can meet it only where that shingle stands, so the table finds the windows for
    which bands have to be worked out at all.
    """

    def __init__(self, templates: Mapping[str, str], least: float = 0.8) -> None:
        self.items: list[Template] = []
        for name, text in templates.items():
            _, h = _words(text)
            if len(h):
                k = min(SHINGLE, len(h))
                order = grams(h, k)
                g = np.unique(order)
                need = max(1, ceil(least * len(g) - 1e-9))
                width = max(len(h), ceil(len(h) / least - 1e-9)) - k + 1
                alike = need / (width + len(g) - need)
                bands = ceil(log(MISS) / log(1 - alike)) if alike < 1 else 1
                self.items.append(Template(name, k, width, need, order, g, [_permuted(g, b).min() for b in range(bands)]))
        self.sizes = sorted({t.words for t in self.items})
        self.table: dict[int, tuple[np.ndarray, list[list[int]]]] = {}
        for k in self.sizes:
            found: dict[int, set[int]] = {}
            for i, t in enumerate(self.items):
                if t.words == k:
                    for b in range(len(t.bands)):
                        found.setdefault(int(t.shingles[_permuted(t.shingles, b).argmin()]), set()).add(i)
            keys = sorted(found)
            self.table[k] = np.array(keys, np.uint64), [sorted(found[v]) for v in keys]

    def find(self, text: str) -> list[tuple[str, int, int, float]]:
        """(name, start, end, containment), code points; of overlapping passages of a template the best, then the shortest.

        A passage goes from the first to the last of the shingles it takes from the template.
        """
        at, h = _words(text)
        out = []
        for k in self.sizes:
            if len(h) < k:
                continue
            g = grams(h, k)
            keys, of = self.table[k]
            places = np.flatnonzero(np.isin(g, keys))
            met: dict[int, list[int]] = {}
            for p, v in zip(places.tolist(), np.searchsorted(keys, g[places]).tolist(), strict=True):
                for i in of[v]:
                    met.setdefault(i, []).append(p)
            for i, where in met.items():
                t = self.items[i]
                for lo, hi in _regions(np.array(where), t.width, len(g)):
                    for start, length, count in _passages(g[lo:hi], t):
                        out.append((t.name, at[lo + start][0], at[lo + start + length - 1][1], count / len(t.shingles)))
        out.sort(key=lambda x: (x[1], x[0]))
        return out


def _regions(places: np.ndarray, width: int, n: int) -> list[tuple[int, int]]:
    """Stretches of shingles in which windows over ``places`` lie; those that touch are one."""
    cut = np.flatnonzero(np.diff(places) >= 2 * width)
    first, last = places[np.concatenate([[0], cut + 1])], places[np.append(cut, len(places) - 1)]
    return list(zip(np.maximum(0, first - width + 1).tolist(), np.minimum(n, last + width).tolist(), strict=True))


def _passages(g: np.ndarray, t: Template) -> list[tuple[int, int, int]]:
    """(first word, words, distinct shingles) of the template's passages in a stretch of shingles."""
    mine = np.flatnonzero(np.isin(g, t.shingles))
    # Too few in the whole stretch are too few in each window.
    if len(np.unique(g[mine])) < t.need:
        return []
    width = min(t.width, len(g))
    hit = np.zeros(len(g) - width + 1, bool)
    for b, row in enumerate(t.bands):
        hit |= sliding_min(_permuted(g, b), width) == row
    starts = np.flatnonzero(hit)
    if not len(starts):
        return []
    # A verbatim copy is as good and as short as a passage can be, so it comes first.
    out, full = [], len(t.order) + t.words - 1
    free = 0
    for p in mine[(g[mine] == t.order[0]) & (mine + len(t.order) <= len(g))].tolist():
        if p >= free and np.array_equal(g[p : p + len(t.order)], t.order):
            out.append((p, full, len(t.shingles)))
            free = p + full
    edges = [0, *[x for p, n, _ in out for x in (p, p + n)], len(g) + t.words - 1]
    for a, b in zip(edges[::2], edges[1::2], strict=True):
        # Between two copies: the shingles whose words all lie there.
        part = mine[np.searchsorted(mine, a) : np.searchsorted(mine, b - t.words + 1)]
        if len(part) >= t.need:
            out += _changed(part, starts, width, g, t)
    return out


def _changed(places: np.ndarray, starts: np.ndarray, width: int, g: np.ndarray, t: Template) -> list[tuple[int, int, int]]:
    """Passages at ``places`` within the windows at ``starts`` that hold enough; of those that overlap the best."""
    lo, hi = np.searchsorted(places, starts), np.searchsorted(places, starts + width)
    # Windows that end at one shingle: the one that begins first holds the others.
    ends, first = np.unique(hi, return_index=True)
    found = set()
    for i, j in zip(lo[first].tolist(), ends.tolist(), strict=True):
        for a in range(i, j - t.need + 1):
            if (p := _passage(places[a:j], g, t.words, t.need)) is not None:
                found.add(p)
    begins: list[int] = []
    taken: list[tuple[int, int, int]] = []
    for count, length, i in sorted(found, key=lambda p: (-p[0], p[1], p[2])):
        at = bisect(begins, i)
        if (at == 0 or taken[at - 1][0] + taken[at - 1][1] <= i) and (at == len(begins) or i + length <= begins[at]):
            begins.insert(at, i)
            taken.insert(at, (i, length, count))
    return taken


def _passage(places: np.ndarray, g: np.ndarray, k: int, need: int) -> tuple[int, int, int] | None:
    """(distinct shingles, words, first word) of the template's shingles at ``places``, without repeats at the ends."""
    values = g[places].tolist()
    left = Counter(values)
    if len(left) < need:
        return None
    i, j = 0, len(values) - 1
    while left[values[j]] > 1:
        left[values[j]] -= 1
        j -= 1
    while left[values[i]] > 1:
        left[values[i]] -= 1
        i += 1
    return len(left), int(places[j] - places[i]) + k, int(places[i])


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text: str = "text", templates: Mapping[str, str] | None = None, least: float = 0.8) -> DataFrame:
    """One row per licence notice found: id, license, start, end (code points), containment.

    Words are compared without case and punctuation. A notice is a passage of at most the template's words
    divided by ``least`` that holds that share of its shingles, so words may be changed or put in. A text may
    hold notices of several templates at one place. Null and empty texts hold nothing; repeated rows give
    repeated results; texts are scanned whole; of passages that tie the first is taken; an empty table gives
    an empty result. Other columns play no part, whatever their names.
    """
    chosen = dict(templates if templates is not None else LICENSES)
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bank = Templates(chosen, least)
        for b in batches:
            which, rows = [], []
            for i, t in enumerate(as_text(b.column("_text"))):
                found = bank.find(t)
                which += [i] * len(found)
                rows += found
            if rows:
                name, start, end, share = zip(*rows, strict=True)
                yield pa.RecordBatch.from_arrays([b.column("_doc").take(pa.array(which)), pa.array(name), pa.array(start, pa.int64()), pa.array(end, pa.int64()), pa.array(share, pa.float64())], names=[id_col, "license", "start", "end", "containment"])

    return docs.select(F.col(id_col).alias("_doc"), F.col(text).alias("_text")).mapInArrow(run, f"`{id_col}` {kind}, license string, start long, end long, containment double")
