"""Licence scans: normalised text against licence templates by the Dice coefficient over word bigrams.

Words are ASCII alphanumeric runs, lower-cased. A template of n bigrams is compared with the stretches of a
text, of every size, that begin and end with a common bigram. A stretch of m bigrams, c of them common, has
2 c / (m + n), and c <= m, so that c >= least / (2 - least) * n and m <= (2 - least) / least * n where it
reaches the wanted Dice; common bigrams are counted as often as the template has them.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from graphmill.llm.common import bounded_batches, slices, text_buffer
from graphmill.llm.minhash import _INVERSE, PRIME, U64, _powers, mix

DICE = 0.8

# fixed values: notices and texts by which licences are known
TEMPLATES = {
    "MIT": (
        "Released under the MIT License",
        "Licensed under the MIT License",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED AS IS, WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    ),
    "Apache-2.0": (
        "Licensed under the Apache License, Version 2.0",
        "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
        "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
    ),
    "GPL-3.0": (
        "This work is licensed under the GNU General Public License, version 3",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.",
    ),
    "GPL-2.0": (
        "This work is licensed under the GNU General Public License, version 2",
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.",
    ),
    "LGPL-2.1": ("This work is licensed under the GNU Lesser General Public License, version 2.1",),
    "AGPL-3.0": ("This work is licensed under the GNU Affero General Public License, version 3",),
    "BSD-2-Clause": (
        "Licensed under the BSD 2-Clause License",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS AS IS AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS AS IS AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.",
    ),
    "BSD-3-Clause": (
        "Licensed under the BSD 3-Clause License",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS AS IS AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS AS IS AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.",
    ),
    "ISC": (
        "Licensed under the ISC License",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED AS IS AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.",
    ),
    "MPL-2.0": ("This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0",),
    "CC-BY-4.0": ("Licensed under CC BY 4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    "CC-BY-SA-4.0": ("Licensed under CC BY-SA 4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License"),
    "CC-BY-NC-4.0": ("Licensed under CC BY-NC 4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License"),
    "CC0-1.0": ("To the extent possible under law, the author has dedicated all copyright to this work to the public domain",),
    "Unlicense": (
        "This is free and unencumbered software released into the public domain",
        "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
    ),
    "Zlib": ("This software is provided as-is, without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions",),
    "BSL-1.0": ("Distributed under the Boost Software License, Version 1.0",),
    "EPL-2.0": ("This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0",),
}

_FOLD = np.zeros(256, np.uint8)  # 0: no part of a word
for _c in "abcdefghijklmnopqrstuvwxyz":
    _FOLD[ord(_c)] = _FOLD[ord(_c) - 32] = ord(_c)
for _c in "0123456789":
    _FOLD[ord(_c)] = ord(_c)


def words(raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of the words of consecutive texts, each text's first word (n + 1), words' first bytes and ends."""
    text = _FOLD[raw]
    part = text > 0
    first = part.copy()
    first[1:] &= ~part[:-1]
    edge = at[1:-1]
    inner = edge[(edge > 0) & (edge < len(raw))]
    first[inner] = part[inner]
    last = part.copy()
    last[:-1] &= ~part[1:]
    last[inner - 1] = part[inner - 1]
    start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    sums = np.zeros(len(raw) + 1, U64)
    if len(raw):
        np.cumsum(text.astype(U64) * _powers(len(raw), int(PRIME)), out=sums[1:])
        hashes = mix((sums[end] - sums[start]) * _powers(len(raw), _INVERSE)[start] + (end - start).astype(U64))
    else:
        hashes = np.zeros(0, U64)
    return hashes, np.searchsorted(start, at), start, end


def bigrams(hashes: np.ndarray) -> np.ndarray:
    return mix(hashes[:-1] * PRIME + hashes[1:]) if len(hashes) > 1 else np.zeros(0, U64)


def dice(a: np.ndarray, b: np.ndarray) -> float:
    """Of two bags of bigrams; two empty bags have 0."""
    x, y = Counter(a.tolist()), Counter(b.tolist())
    both = sum((x & y).values())
    return 2 * both / (len(a) + len(b)) if len(a) + len(b) else 0.0


def stretches(common: np.ndarray, place: np.ndarray, template: np.ndarray, least: float) -> list[tuple[float, int, int]]:
    """(dice, first, end) of stretches that reach least: for each of a text's common bigrams the best that
    begins there, the longest of equals, and ends with another."""
    n = len(template)
    fewest, widest = least / (2 - least) * n * 0.999, (2 - least) / least * n * 1.001
    last = np.searchsorted(place, place + widest, "right")  # behind the last that may end a stretch
    out = []
    bag = Counter(template.tolist())
    for a in np.flatnonzero(last - np.arange(len(place)) >= fewest):
        left = dict(bag)
        both, i, best, end = 0, int(place[a]), 0.0, 0
        for x, p in zip(common[a : last[a]].tolist(), place[a : last[a]].tolist()):
            if left[x] > 0:
                left[x] -= 1
                both += 1
            s = 2 * both / (p + 1 - i + n)
            if s >= best:
                best, end = s, p + 1
        if best >= least:
            out.append((best, i, end))
    return out


class Templates:
    def __init__(self, templates: dict[str, tuple[str, ...]] = TEMPLATES):
        self.name, self.grams = [], []
        for name, texts in templates.items():
            for t in texts:
                raw = np.frombuffer(t.encode(), np.uint8)
                g = bigrams(words(raw, np.array([0, len(raw)]))[0])
                if len(g):
                    self.name.append(name)
                    self.grams.append(g)
        self.sets = [np.unique(g) for g in self.grams]
        self.every = np.unique(np.concatenate(self.sets)) if self.sets else np.zeros(0, U64)
        self.bitmap = np.zeros(1 << 16, bool)
        self.bitmap[(self.every >> U64(48)).astype(np.int64)] = True

    def _best(self, grams: np.ndarray, own: np.ndarray, low: int, high: int, least: float) -> list[tuple]:
        """Stretches of the bigrams from low to high, with common ones at `own`, best first without overlaps;
        what lies beside a chosen one is searched again by itself."""
        found = []
        for k, g in enumerate(self.grams):
            if len(own) < least / (2 - least) * len(g) * 0.999:
                continue  # too few common bigrams for this size
            mine = own[np.isin(grams[own], self.sets[k])]
            found += [(self.name[k], c, i, j) for c, i, j in stretches(grams[mine], mine, g, least)]
        found.sort(key=lambda f: (-f[1], -(f[3] - f[2]), f[2], f[0]))
        kept: list[tuple] = []
        taken, lost = np.zeros(high - low + 1, bool), np.zeros(high - low + 1, bool)
        taken[-1] = True
        for f in found:  # a stretch counts once, for its best licence
            if taken[f[2] - low : f[3] - low].any():
                lost[f[2] - low] = True
            else:
                taken[f[2] - low : f[3] - low] = True
                kept.append(f)
        lost &= ~taken
        if lost.any():
            edges = np.flatnonzero(np.diff(np.concatenate([[True], taken]).astype(np.int8)))
            for i, j in zip(edges[::2], edges[1::2]):
                if lost[i:j].any():
                    kept += self._best(grams, own[(own >= low + i) & (own < low + j)], low + int(i), low + int(j), least)
        return kept

    def matches(self, raw: np.ndarray, at: np.ndarray, least: float) -> list[tuple[int, str, float, int, int]]:
        """(text, licence, dice, first byte, end) of consecutive texts: for each licence the best stretch
        around each place, the earliest of equals."""
        hashes, of, start, end = words(raw, at)
        grams = bigrams(hashes)
        if not len(grams):
            return []
        joint = of[1:-1] - 1  # bigrams from one text into the next
        hit = self.bitmap[(grams >> U64(48)).astype(np.int64)]
        hit[joint[(joint >= 0) & (joint < len(grams))]] = False
        spots = np.flatnonzero(hit)
        spots = spots[np.isin(grams[spots], self.every)]
        out = []
        if not len(spots):
            return out
        texts = np.searchsorted(of, spots, "right") - 1
        for d in np.unique(texts):
            own = spots[texts == d]
            kept = self._best(grams, own, int(of[d]), int(of[d + 1]) - 1, least)
            out += [(int(d), name, s, int(start[i]), int(end[j])) for name, s, i, j in sorted(kept, key=lambda f: f[2])]
        return out


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates: dict[str, tuple[str, ...]] = TEMPLATES, least: float = DICE) -> DataFrame:
    """One row per licence found in a document row: id, licence, dice, start, end (code points).

    Overlapping stretches count once, for the higher Dice, then the longer, the earlier, the first by name.
    Null and empty texts have none; null ids stay null; repeated rows give their rows each; templates of
    under two words are ignored; other columns are not read."""
    spark = docs.sparkSession
    bounded_batches(spark)
    own = Templates(templates)
    rows = docs.select(id_col, text_col)

    def run(batches):
        for b in batches:
            raw, at = text_buffer(b.column(1))
            for i, j in slices(at):
                part, off = raw[at[i] : at[j]], at[i : j + 1] - at[i]
                got = own.matches(part, off, least) if len(part) else []
                if got:
                    d, name, s, low, high = zip(*got)
                    chars = [(part[off[x] : off[x + 1]] & 0xC0) != 0x80 for x in d]
                    yield pa.RecordBatch.from_arrays(
                        [
                            b.column(0).take(pa.array([i + x for x in d])),
                            pa.array(name, pa.string()),
                            pa.array(s, pa.float64()),
                            pa.array([int(c[: p - off[x]].sum()) for c, p, x in zip(chars, low, d)], pa.int64()),
                            pa.array([int(c[: p - off[x]].sum()) for c, p, x in zip(chars, high, d)], pa.int64()),
                        ],
                        names=[id_col, "licence", "dice", "start", "end"],
                    )

    return rows.mapInArrow(run, f"{id_col} {rows.schema[0].dataType.simpleString()}, licence string, dice double, start long, end long")
