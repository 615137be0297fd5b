"""License scan: segments of normalised text against licence templates by the Dice coefficient of word bigrams.

Segments are the lines, the paragraphs of several lines (two or more line feeds between words divide them),
whole texts of several paragraphs, and windows: as many words as a template has, from any word of a text on,
so that a template is found inside a longer line or beside other words. Normalised words are runs of digits, letters and characters beyond
ASCII, A-Z lower-cased. With a distinct bigrams in the segment, b in the template and c in both,
Dice = 2c / (a + b). It reaches t only if t/(2-t) * b <= a <= (2-t)/t * b, so the size prunes templates, and
segments without any template bigram are left at once. A window needs t/(2-t) * b template bigrams at least, which
running sums of the template's bigrams tell for all windows; only those that reach it are compared. Of windows that
overlap the one with the highest Dice stays (of equals the longer, then the first), and none that overlaps a
matching line, paragraph or text.
"""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terracast.llm import words as wd
from terracast.llm.storage import first_uid

DICE = 0.85

# ---- fixed values: notices by which licences are stated ------------------------------
TEMPLATES = [
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-2.0", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("AGPL-3.0", "This work is licensed under the GNU Affero General Public License, version 3."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."),
    ("BSD", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-ND-4.0", "Licensed under CC BY-ND 4.0."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    ("MIT", "This project is licensed under the terms of the MIT license."),
    ("MIT", "SPDX-License-Identifier: MIT"),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."),
    ("Apache-2.0", "SPDX-License-Identifier: Apache-2.0"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details."),
    ("GPL-2.0", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details."),
    ("BSD", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."),
]

#: bigrams of windows that are compared at a time
COMPARED = 1 << 20


def _bigrams(text: str) -> tuple[np.ndarray, int]:
    """(distinct bigrams, words) of a template."""
    data = np.frombuffer(text.encode(), dtype=np.uint8)
    w = wd.split(data, np.array([0, len(data)]), wd.ALNUM)
    return np.unique(wd.shingles(w.hashes(), w.row, 2)[1]), len(w.row)


def _matches(h: np.ndarray, segment: np.ndarray, known: np.ndarray, holds: np.ndarray, sizes: np.ndarray, dice: float) -> list[tuple[int, int, float]]:
    """(segment, template, dice) of every segment's best template at or above the limit; the first of equals."""
    at, value = wd.shingles(h, segment, 2)
    place = np.minimum(np.searchsorted(known, value), len(known) - 1)
    hit = known[place] == value
    touched = np.unique(segment[at[hit]])
    if not len(touched):
        return []
    some = np.isin(segment[at], touched)
    seg, val, where, in_any = segment[at][some], value[some], place[some], hit[some]
    order = np.lexsort((val, seg))
    seg, val, where, in_any = seg[order], val[order], where[order], in_any[order]
    new = np.concatenate([[True], (seg[1:] != seg[:-1]) | (val[1:] != val[:-1])])
    seg, where, in_any = np.searchsorted(touched, seg[new]), where[new], in_any[new]
    a = np.bincount(seg, minlength=len(touched))
    out = []
    # the size bound first: segments that no template can reach are left out
    fits = (a[:, None] >= dice / (2 - dice) * sizes - 1e-9) & (a[:, None] <= (2 - dice) / dice * sizes + 1e-9)
    keep = fits.any(axis=1)[seg] & in_any
    common = np.zeros((len(touched), len(sizes)), dtype=np.int64)
    np.add.at(common, seg[keep], holds[where[keep]])
    score = np.where(fits, 2 * common / (a[:, None] + sizes), 0)
    best = score.argmax(axis=1)
    for i in np.flatnonzero(score.max(axis=1) >= dice):
        out.append((int(touched[i]), int(best[i]), float(score[i, best[i]])))
    return out


def _distinct(values: np.ndarray) -> np.ndarray:
    """Different values in each row."""
    values = np.sort(values, axis=1)
    return 1 + (values[:, 1:] != values[:, :-1]).sum(axis=1)


def _windows(h: np.ndarray, row: np.ndarray, sets: list[np.ndarray], n_words: list[int], known: np.ndarray, dice: float) -> list[tuple[int, int, int, float]]:
    """(first word, last word, template, dice) of every window at or above the limit, the best first."""
    at, value = wd.shingles(h, row, 2)
    place = np.minimum(np.searchsorted(known, value), len(known) - 1)
    hit = known[place] == value
    at_hit, place = at[hit], place[hit]
    bigram = np.zeros(len(h), dtype=np.uint64)  # of each word and the next
    bigram[at] = value
    out = []
    for t, (own, size) in enumerate(zip(sets, n_words, strict=True)):
        inside = np.zeros(len(known) + 1, dtype=bool)
        inside[np.searchsorted(known, own)] = True
        hits = at_hit[inside[place]]
        need = int(np.ceil(dice / (2 - dice) * len(own) - 1e-9))
        if len(hits) < need or len(h) < size:
            continue
        # a window with enough hits ends at the need-th one after its first hit, or later
        near = hits[need - 1:] - hits[:len(hits) - need + 1] <= size - 2
        lo, hi = hits[need - 1:][near] - (size - 2), hits[:len(hits) - need + 1][near]
        lo, hi = np.clip(lo, 0, len(h) - size), np.clip(hi, -1, len(h) - size)
        mark = np.zeros(len(h) + 1, dtype=np.int64)
        some = lo <= hi
        np.add.at(mark, lo[some], 1)
        np.add.at(mark, hi[some] + 1, -1)
        starts = np.flatnonzero(np.cumsum(mark)[:-1] > 0)
        starts = starts[row[starts] == row[starts + size - 1]]
        span = np.arange(size - 1)
        step = max(1, COMPARED // size)
        for first in range(0, len(starts), step):
            begin = starts[first:first + step]
            held = bigram[begin[:, None] + span]
            spot = np.minimum(np.searchsorted(own, held), len(own) - 1)
            mine = np.where(own[spot] == held, spot, -1)
            common = _distinct(mine) - (mine < 0).any(axis=1)
            score = 2 * common / (_distinct(held) + len(own))
            out += [(int(begin[i]), int(begin[i]) + size - 1, t, float(score[i])) for i in np.flatnonzero(score >= dice)]
    return sorted(out, key=lambda x: (-x[3], x[0] - x[1], x[0], x[2]))


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", dice: float = DICE, templates: list[tuple[str, str]] | None = None) -> DataFrame:
    """One row per row of docs: doc_id, row, matches (array of license, dice, kind, start, end; offsets in UTF-8 bytes), in order of kind (line, paragraph, text, window) and place.

    A null or empty text has no match. Repeated rows each get a row; other columns don't matter.
    """
    texts = templates or TEMPLATES
    kind_of_id = docs.schema[id_col].dataType.simpleString()
    sets, n_words = zip(*(_bigrams(t) for _, t in texts), strict=True)
    known = np.unique(np.concatenate(sets))
    holds = np.stack([np.isin(known, s) for s in sets], axis=1).astype(np.int64)
    sizes, names = np.array([len(s) for s in sets]), [n for n, _ in texts]

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        uid = first_uid()
        for b in batches:
            for first, end, data, at in wd.runs(b.column(1)):
                w = wd.split(data, at, wd.ALNUM)
                h = w.hashes()
                found: list[list[dict]] = [[] for _ in range(w.rows)]
                feeds = np.concatenate([[0], np.cumsum(data == 10)])[w.start]
                gap = np.diff(feeds, prepend=0)
                other = np.diff(w.row, prepend=-1) != 0
                line, part = np.cumsum(other | (gap > 0)), np.cumsum(other | (gap > 1))
                several = lambda outer, inner: np.concatenate([[0], np.bincount(outer, np.diff(inner, prepend=-1) != 0)])[outer + 1] > 1 if len(outer) else np.zeros(0, bool)
                taken = np.zeros(len(h), dtype=bool)  # words in a match
                for kind, segment, chosen in (("line", line, np.ones(len(h), bool)), ("paragraph", part, several(part, line)), ("text", w.row, several(w.row, part))):
                    pick = np.flatnonzero(chosen)
                    if not len(pick):
                        continue
                    seg = segment[pick]
                    for s, t, score in _matches(h[pick], seg, known, holds, sizes, dice):
                        lo, hi = np.searchsorted(seg, s), np.searchsorted(seg, s, "right") - 1
                        r = int(w.row[pick[lo]])
                        taken[pick[lo]:pick[hi] + 1] = True
                        found[r].append({"license": names[t], "dice": score, "kind": kind, "start": int(w.start[pick[lo]] - at[r]), "end": int(w.end[pick[hi]] - at[r])})
                windows = []
                for lo, hi, t, score in _windows(h, w.row, sets, n_words, known, dice):
                    if not taken[lo:hi + 1].any():
                        taken[lo:hi + 1] = True
                        windows.append((lo, hi, t, score))
                for lo, hi, t, score in sorted(windows):
                    r = int(w.row[lo])
                    found[r].append({"license": names[t], "dice": score, "kind": "window", "start": int(w.start[lo] - at[r]), "end": int(w.end[hi] - at[r])})
                shape = pa.list_(pa.struct([("license", pa.string()), ("dice", pa.float64()), ("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
                yield pa.RecordBatch.from_arrays([b.column(0).slice(first, end - first), pa.array(np.arange(uid, uid + w.rows)), pa.array(found, shape)], names=["doc_id", "row", "matches"])
                uid += w.rows

    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(find, f"doc_id {kind_of_id}, row bigint, matches array<struct<license string, dice double, kind string, start bigint, end bigint>>")
