"""License scan: MinHash bands over overlapping windows of words retrieve templates, exact containment verifies them.

A template's shingles are its runs of ``k`` words (all its words, if it has fewer).  Windows of a text have as many
shingles as a template and start every eighth of that, so that they overlap.  MinHash bands of windows and templates
meet in a table.  A window that matters has a Jaccard similarity of at least ``jaccard`` with its template, and there
are enough bands of ``rows`` hashes that such a pair meets with a probability of at least ``sure``.  Each template
retrieved is verified by the exact share of its shingles that stand in the stretch around the window; ``least`` or
more is a match.  Windows without any shingle of a template share no minimum with one, so they are not hashed.

Everything is done where the text is: the templates are a fixed list, and no text is shuffled.

Defined cases: null and empty texts have no match; a text with fewer words than a template's shingle has none; every
occurrence of a template is reported: of matches that overlap, the best one, the first if several are equal; rows may
repeat and are reported once each; null ids stay null.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, released
from .neardup import MIX, STEP, mixed, text_hashes, word_hashes

#: Notices by which licenses are declared, as published by their stewards.
NOTICES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0-full": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
    "MIT": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction",
    "MIT-declared": "Released under the MIT License.",
    "BSD": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    "GPL-3.0-or-later": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "GPL-2.0-or-later": "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
    "GPL-3.0-declared": "This work is licensed under the GNU General Public License, version 3.",
    "LGPL": "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-SA-4.0": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC0-1.0": "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "Unlicense": "This is free and unencumbered software released into the public domain.",
    "EPL-2.0": "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0",
    "All-rights-reserved": "All rights reserved.",
}

_BSD_CLAUSES = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:
1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."""
_BSD_THIRD = "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."
_BSD_WARRANTY = """THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
#: Whole licenses, as published by their stewards, without names and years.
BODIES = {
    "MIT-text": """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:
The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
    "BSD-2-Clause-text": f"{_BSD_CLAUSES}\n{_BSD_WARRANTY}",
    "BSD-3-Clause-text": f"{_BSD_CLAUSES}\n{_BSD_THIRD}\n{_BSD_WARRANTY}",
    "ISC-text": """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.
THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.""",
    "Zlib-text": """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.
Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:
1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.
2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.
3. This notice may not be removed or altered from any source distribution.""",
}
TEMPLATES = NOTICES | BODIES


def shingles(words: np.ndarray, k: int) -> np.ndarray:
    n = len(words) - k + 1
    if n < 1:
        return np.zeros(0, np.uint64)
    h = np.zeros(n, np.uint64)
    for i in range(k):
        h = h * STEP + words[i : i + n]
    return mixed(h + np.uint64(k))


def band_count(rows: int, jaccard: float, sure: float) -> int:
    return int(np.ceil(np.log1p(-sure) / np.log1p(-(jaccard**rows))))


class Templates:
    """Templates by the length of their shingles and of their windows, with the band keys of each."""

    def __init__(self, texts: dict[str, str], k: int, rows: int, jaccard: float, sure: float, least: float):
        self.rows, self.bands, self.least = rows, band_count(rows, jaccard, sure), least
        self.seeds = mixed(np.arange(1, self.rows * self.bands + 1, dtype=np.uint64) * STEP)
        self.groups: dict[tuple[int, int], list[tuple[str, np.ndarray]]] = {}
        for name, text in texts.items():
            words = word_hashes(text)
            if len(words):
                size = min(k, len(words))
                h = shingles(words, size)
                self.groups.setdefault((size, len(h)), []).append((name, h))
        self.any = {size: np.unique(np.concatenate([h for (s, _), g in self.groups.items() if s == size for _, h in g])) for size, _ in self.groups}
        self.keys = {key: np.stack([self.band_keys(h[None, :])[0] for _, h in g]) for key, g in self.groups.items()}

    def band_keys(self, windows: np.ndarray) -> np.ndarray:
        """Of windows (number, shingles): (number, bands)."""
        out = np.zeros((len(windows), self.bands), np.uint64)
        for b in range(self.bands):
            for seed in self.seeds[b * self.rows : (b + 1) * self.rows]:
                x = (windows ^ seed) * MIX
                out[:, b] = mixed(out[:, b] * STEP + (x ^ (x >> np.uint64(32))).min(1))
        return out

    def scan(self, text: str | None) -> list[tuple[str, float, int, int]]:
        return self.scan_words(word_hashes(text))

    def scan_words(self, words: np.ndarray) -> list[tuple[str, float, int, int]]:
        """(template, containment, first word, words) of every occurrence, by template and place."""
        found: dict[str, list[tuple[float, int, int]]] = {}
        for size, known in self.any.items():
            h = shingles(words, size)
            hit = known[np.minimum(np.searchsorted(known, h), len(known) - 1)] == h
            if not hit.any():
                continue
            hits = np.concatenate([[0], np.cumsum(hit)])
            for (s, m), group in self.groups.items():
                if s != size:
                    continue
                step = max(1, m // 8)
                starts = np.unique(np.append(np.arange(0, max(1, len(h) - m + 1), step), max(0, len(h) - m)))
                starts = starts[hits[np.minimum(starts + m, len(h))] > hits[starts]]
                for at in range(0, len(starts), 4096):
                    some = starts[at : at + 4096]
                    keys = self.band_keys(h[np.minimum(some[:, None] + np.arange(m), len(h) - 1)])
                    for (name, own), template in zip(group, self.keys[s, m], strict=True):
                        n = len(np.unique(own))
                        for w in some[(keys == template).any(1)].tolist():
                            a, z = max(0, w - step), min(len(h), w + m + step)
                            inside = np.flatnonzero(np.isin(h[a:z], own))
                            share = len(np.unique(h[a:z][inside])) / n
                            if share >= self.least:
                                found.setdefault(name, []).append((share, a + int(inside[0]), int(inside[-1] - inside[0]) + size))
        return [(name, *m) for name in sorted(found) for m in apart(found[name])]


def apart(matches: list[tuple[float, int, int]]) -> list[tuple[float, int, int]]:
    """Of matches (share, first word, words) the best that do not overlap, by place."""
    kept: list[tuple[int, int, float]] = []
    for share, first, n in sorted(set(matches), key=lambda m: (-m[0], m[1], m[2])):
        i = bisect_left(kept, (first,))
        if (i == len(kept) or kept[i][0] >= first + n) and (i == 0 or kept[i - 1][0] + kept[i - 1][1] <= first):
            insort(kept, (first, n, share))
    return [(share, first, n) for first, n, share in kept]


def scan(docs: DataFrame, templates: dict[str, str] | None = None, k: int = 5, least: float = 0.8, rows: int = 2, jaccard: float = 0.5, sure: float = 0.9999, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, license, containment, first_word, n_words) of every occurrence of a template in a document."""
    kind = pa.struct([("license", pa.string()), ("containment", pa.float64()), ("first_word", pa.int32()), ("n_words", pa.int32())])

    @F.arrow_udf("array<struct<license: string, containment: double, first_word: int, n_words: int>>")
    def found(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        known = Templates(templates or TEMPLATES, k, rows, jaccard, sure, least)
        for texts in released(batches):
            yield pa.array([[dict(zip([f.name for f in kind], m, strict=True)) for m in known.scan_words(words)] for words in text_hashes(texts)], pa.list_(kind))

    bounded_batches(docs.sparkSession)
    rows_ = docs.select(F.col(id_col).alias("doc_id"), F.explode(found(F.col(text_col))).alias("m"))
    return rows_.select("doc_id", "m.*")
