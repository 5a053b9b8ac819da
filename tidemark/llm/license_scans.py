"""License scans: overlapping windows of documents against license templates.

Windows a quarter longer than a template, at every word, are compared with it by five-word shingles; the
text's end cuts them, so a text shorter than a template is a window too.
1. Only windows that hold as many shingles of templates of that size as containment asks for can contain
   one; the others are skipped by running counts over a membership test.
2. MinHash bands retrieve templates: ``BANDS`` bands of ``ROWS`` minima.  A window with 0.8 of a
   template's n shingles has 1.25 n at most, so Jaccard 0.8 / 1.45 or more with it; it
   shares a band with probability 1 - (1 - 0.55**2)**24 > 0.9998, and its neighbours that contain as much try again.
3. A retrieved template is verified by exact containment of its shingles in the window.  What is
   reported is the part of the window from its first to its last shingle of the template.

``TEMPLATES`` holds notices, file headers and whole texts of short licenses.  Map-only; templates are few and
broadcast up to ``TEMPLATE_WORDS`` words at once, more in blocks, each block one pass.

Defined results
---------------
* null or empty text: no row.  Null id: rows carry it.
* ties: per document and template the window of highest containment, then the leftmost, then the shortest.
* repeated rows: each gives its own rows.  Very long texts: whole, linear.
* empty table: empty result.  Extra columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .decontamination import Normal, _find
from .textops import U, grams, mix, ranges, small_batches, steps, text_bytes

WORDS, CONTAINMENT = 5, 0.8
BANDS, ROWS = 24, 2
TEMPLATE_WORDS = 1_000_000

#: Notices by which texts state their license (name, notice).
TEMPLATES = (
    ("MIT", "Released under the MIT License."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-2.0", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License version 2."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("BSD", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("MIT-text", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files."),
    ("Apache-2.0-header", '''Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.
        You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software
        distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License
        for the specific language governing permissions and limitations under the License.'''),
    ("GPL-3.0-header", """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by
        the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it
        will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General
        Public License for more details."""),
    ("LGPL-3.0-header", """This library is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as
        published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."""),
    ("AGPL-3.0-header", """This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as
        published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."""),
    ("EPL-2.0", "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/"),
    ("CC0-1.0", "To the extent possible under law, the author has dedicated all copyright and related and neighboring rights to this software to the public domain worldwide."),
    ("MIT-whole", """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"),
        to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
        copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this
        permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS
        OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR
        COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION
        WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""),
    ("ISC-whole", """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above
        copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS
        SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR
        CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS
        ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""),
    ("BSD-2-Clause-whole", """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:
        1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form
        must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the
        distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO,
        THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE
        FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES;
        LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING
        NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""),
    ("Zlib-whole", """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the
        use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it
        freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software.
        If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source versions must be
        plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution."""),
    ("Unlicense-whole", """This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute
        this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."""),
)


class Templates:
    def __init__(self, templates, words: int = WORDS, containment: float = CONTAINMENT):
        self.words, self.containment = words, containment
        self.names = [n for n, _ in templates]
        raw = [t.encode() for _, t in templates]
        w = Normal(np.frombuffer(b"".join(raw), np.uint8), np.concatenate(([0], np.cumsum([len(r) for r in raw]))).astype(np.int64))
        size = np.diff(w.first)
        if (size < words).any():
            raise ValueError(f"a template needs {words} words")
        self.size = size
        self.sets = [np.unique(grams(w.hash[a:b], words)) for a, b in zip(w.first[:-1], w.first[1:], strict=True)]
        #: by size: the size, shingles of its templates, and how many of them a window needs at least
        self.classes = []
        for n in np.unique(size).tolist():
            own = [s for s, k in zip(self.sets, size.tolist(), strict=True) if k == n]
            self.classes.append((n, np.unique(np.concatenate(own)), min(int(np.ceil(containment * len(s) - 1e-9)) for s in own)))
        keys = np.array([self.bands(s[None, :], np.array([n]))[0] for s, n in zip(self.sets, size, strict=True)], np.uint64).reshape(-1, BANDS)
        order = np.argsort(keys.ravel(), kind="stable")
        self.keys, self.owner = keys.ravel()[order], order // BANDS

    @staticmethod
    def bands(shingles: np.ndarray, size: np.ndarray) -> np.ndarray:
        """(rows, BANDS) keys of rows of shingles; windows of different size share no key."""
        out = np.empty((len(shingles), BANDS), np.uint64)
        with np.errstate(over="ignore"):
            for b in range(BANDS):
                k = mix(size.astype(np.uint64) * U(0x100000001B3) + U(b))
                for r in range(ROWS):
                    m = mix(shingles ^ U((b * ROWS + r + 1) * 0x9E3779B97F4A7C15 % 2**64)).min(1)
                    k = mix(k * U(0xD6E8FEB86659FD93) + m)
                out[:, b] = k
        return out

    def matches(self, raw: np.ndarray, off: np.ndarray) -> list[tuple[int, int, float, int, int]]:
        """(text, template, containment, byte from, byte to), one per text and template."""
        w = Normal(raw, off)
        g = grams(w.hash, self.words)
        last = np.repeat(w.first[1:], np.diff(w.first))[: len(g)]
        whole = last - np.arange(len(g)) >= self.words  # shingles within a text
        best: dict[tuple[int, int], tuple] = {}
        for n, own, least in self.classes:
            member = whole & (_find(own, g) < len(own))
            hit = np.flatnonzero(member)
            width = n + n // 4 - self.words + 1  # shingles of a window
            begin = np.unique(ranges(np.maximum(hit - width + 1, 0), hit - np.maximum(hit - width + 1, 0) + 1))
            begin = begin[whole[begin]]
            count = np.minimum(width, last[begin] - begin - self.words + 1)
            seen = np.concatenate(([0], np.cumsum(member)))
            enough = seen[begin + count] - seen[begin] >= least
            begin, count = begin[enough], count[enough]
            step = max(1, 1_000_000 // width)
            for part in range(0, len(begin), step):
                s, c = begin[part : part + step], count[part : part + step]
                windows = g[s[:, None] + np.minimum(np.arange(width), c[:, None] - 1)]  # a cut window repeats its last shingle
                b = self.bands(windows, np.full(len(s), n)).ravel()
                lo, hi = np.searchsorted(self.keys, b, "left"), np.searchsorted(self.keys, b, "right")
                pair = np.unique(np.repeat(np.repeat(np.arange(len(s)), BANDS), hi - lo) * len(self.names) + self.owner[ranges(lo, hi - lo)])
                for i, t in zip(*(x.tolist() for x in np.divmod(pair, len(self.names))), strict=True):
                    of = np.isin(windows[i], self.sets[t])
                    share = len(np.unique(windows[i][of])) / len(self.sets[t])
                    if share >= self.containment - 1e-12:
                        at = np.flatnonzero(of[: c[i]])
                        a, z = int(s[i] + at[0]), int(s[i] + at[-1] + self.words)
                        d = int(np.searchsorted(w.first, a, "right")) - 1
                        best[d, t] = min(best.get((d, t), (0.0, 0, 0)), (-share, a, z))
        return [(d, t, -c, int(w.start[a] - off[d]), int(w.end[z - 1] - off[d])) for (d, t), (c, a, z) in sorted(best.items())]


def _scan(shipped):
    names = ["doc_id", "license", "containment", "start_byte", "end_byte"]

    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = shipped.value
        for big in batches:
            for batch in steps(big):
                m = t.matches(*text_bytes(batch.column("text")))
                if m:
                    ids = batch.column("doc_id").take(pa.array([x[0] for x in m]))
                    cols = [pa.array([t.names[x[1]] for x in m]), pa.array([x[2] for x in m], pa.float64()), *[pa.array([x[i] for x in m], pa.int64()) for i in (3, 4)]]
                    yield pa.RecordBatch.from_arrays([ids, *cols], names)

    return f


def _blocks(templates) -> list[list]:
    """Templates in blocks of about TEMPLATE_WORDS words."""
    out, words = [[]], 0
    for name, text in templates:
        words += len(text.split())
        if words > TEMPLATE_WORDS and out[-1]:
            out.append([])
            words = len(text.split())
        out[-1].append((name, text))
    return out


def license_scan(df: DataFrame, templates=TEMPLATES, doc_id: str = "doc_id", text: str = "text", words: int = WORDS, containment: float = CONTAINMENT) -> DataFrame:
    """``doc_id, license, containment, start_byte, end_byte``: the best window of each document for each template it contains."""
    small_batches(df.sparkSession)
    rows = df.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    out = None
    for block in _blocks(templates):
        shipped = df.sparkSession.sparkContext.broadcast(Templates(block, words, containment))
        hits = rows.mapInArrow(_scan(shipped), "doc_id long, license string, containment double, start_byte long, end_byte long")
        out = hits if out is None else out.union(hits)
    return out if doc_id == "doc_id" else out.withColumnRenamed("doc_id", doc_id)
