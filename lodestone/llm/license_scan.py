"""Licence scan: runs of normalised words against licence templates by the Dice coefficient of their word bigrams.

Texts are lower-cased and cut into words of letters and digits. A template of b distinct bigrams can match a run only if the run holds t / (2 - t) times as many of them and has at most (2 - t) / t times as many distinct ones; texts with too few of its bigrams are pruned before any run is looked at. Runs of every length are compared: those that begin and end with a bigram of the template which doesn't occur again inside them, since any other run holds one of these that is at least as alike. What is found is widened by the bigrams next to it that it holds already, which leaves the coefficient as it is.

A null or empty text has no words and no licence. Equal coefficients: the first template by name, the first place. Repeated rows are judged one by one; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from ._common import documents
from ._words import ALNUM_WORDS, runs, text_slices, words

LEAST_DICE = 0.8
# Notices and texts of public licences.
TEMPLATES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0-header": 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.',
    "BSD-2-Clause": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    "CC-BY-4.0": "Licensed under CC BY 4.0.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC-BY-SA-4.0": "Licensed under CC BY-SA 4.0.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-3.0-header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.",
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "MIT": "Released under the MIT License.",
    "MIT-text": 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.',
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
    "Zlib": "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.",
}
_BSD_END = "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
_BSD_3 = TEMPLATES["BSD-2-Clause"] + " 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."
_LESSER = "{0} is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version {1} of the License, or (at your option) any later version. {0} is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Lesser General Public License for more details."
# Other usual notices, and texts with their disclaimers.
TEMPLATES |= {
    "BSD-2-Clause-full": f"{TEMPLATES['BSD-2-Clause']} {_BSD_END}",
    "BSD-3-Clause": _BSD_3,
    "BSD-3-Clause-full": f"{_BSD_3} {_BSD_END}",
    "BSD-3-Clause-notice": "Licensed under the BSD 3-Clause License.",
    "CC-BY-4.0-notice": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-SA-4.0-notice": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "CC0-1.0-notice": "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
    "GPL-2.0": "This work is licensed under the GNU General Public License, version 2.",
    "GPL-2.0-header": TEMPLATES["GPL-3.0-header"].replace("version 3", "version 2"),
    "ISC-full": TEMPLATES["ISC"] + ' THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.',
    "LGPL-2.1-header": _LESSER.format("This library", "2.1"),
    "LGPL-3.0": "This work is licensed under the GNU Lesser General Public License, version 3.",
    "LGPL-3.0-header": _LESSER.format("This program", "3"),
    "MIT-full": TEMPLATES["MIT-text"] + ' THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.',
    "MIT-notice": "Licensed under the MIT License.",
    "Unlicense": "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
}
TABLE = 1 << 16


class Templates:
    def __init__(self, texts: dict[str, str], least: float = LEAST_DICE):
        self.least, self.names = least, sorted(texts)
        self.sets, self.table = [], np.zeros(TABLE, bool)
        for name in self.names:
            data = np.frombuffer(texts[name].encode(), np.uint8)
            h = words(data, np.array([0, len(data)]), ALNUM_WORDS)[0]
            b = runs(h, 2)
            self.sets.append(np.unique(b))
            self.table[(b & np.uint64(TABLE - 1)).astype(np.int64)] = True
        self.wants = [least * len(own) / (2 - least) - 1e-9 for own in self.sets]
        self.fewest = min(self.wants, default=0.0)

    def match(self, b: np.ndarray) -> list[tuple[float, str, int, int]]:
        """b: a text's bigrams. The best run of each template that is alike enough: Dice, name, first word, end."""
        found, places = [], None
        # bigrams without repeats are no more than bigrams, so a template that wants more is out before any is looked up
        if len(b) < self.fewest:
            return found
        near = np.flatnonzero(self.table[(b & np.uint64(TABLE - 1)).astype(np.int64)])
        if not len(near):
            return found
        for name, own, least in zip(self.names, self.sets, self.wants, strict=True):
            if not len(own) or len(near) < least:
                continue
            hits = near[np.isin(b[near], own)]
            if len(hits) < least or len(np.unique(b[hits])) < least:
                continue
            places = places or _places(b)
            best = self._best(hits, len(own), *places)
            if best:
                found.append((best[0], name, *_widened(b, *best[1:])))
        return found

    def _best(self, hits: np.ndarray, size: int, before: np.ndarray, after: np.ndarray) -> tuple[float, int, int] | None:
        """The best run that begins with a hit: Dice, first word, end. before and after: where each bigram last was, and next is."""
        least, most = self.least * size / (2 - self.least) - 1e-9, (2 - self.least) / self.least * size
        hit = np.zeros(len(before), bool)
        hit[hits] = True
        ends = after[hits]
        inside = np.searchsorted(hits, ends, "left") - np.arange(len(hits))
        best = None
        for at, end in zip(hits[inside >= least].tolist(), ends[inside >= least].tolist(), strict=True):
            width = int(most) + 2
            while True:
                new = before[at : min(end, at + width)] < at
                distinct = np.cumsum(new)
                if at + width >= end or distinct[-1] > most:
                    break
                width *= 2
            dice = 2 * np.cumsum(new & hit[at : at + len(new)]) / (distinct + size)
            k = int(dice.argmax())
            if dice[k] >= self.least and (best is None or dice[k] > best[0]):
                best = (float(dice[k]), at, at + k + 2)
                if dice[k] == 1:
                    break
        return best


def _widened(b: np.ndarray, first: int, end: int) -> tuple[int, int]:
    """The run of words from first to end, with the bigrams beside it that are in it."""
    held = set(b[first : end - 1].tolist())
    while first and int(b[first - 1]) in held:
        first -= 1
    while end <= len(b) and int(b[end - 1]) in held:
        end += 1
    return first, end


def _places(b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each bigram was last before a place, -1 if nowhere, and where it is next, the end if nowhere."""
    order = np.argsort(b, kind="stable")
    again = np.flatnonzero(b[order[1:]] == b[order[:-1]])
    before, after = np.full(len(b), -1), np.full(len(b), len(b))
    before[order[again + 1]], after[order[again]] = order[again], order[again + 1]
    return before, after


def load_templates(folder: str, most: int = 200) -> dict[str, str]:
    """Whole licence texts of a folder on the driver, such as /usr/share/common-licenses, by file name; links and files beyond `most` of them are an error or left out, never cut."""
    from pathlib import Path

    files = sorted(p for p in Path(folder).iterdir() if p.is_file() and not p.is_symlink())
    if len(files) > most:
        raise ValueError(f"{folder} has more than {most} files")
    return {p.name: p.read_text(encoding="utf-8", errors="replace") for p in files}


OUT = "license string, dice double, first_word long, end_word long, licenses string"


def scan_licenses(df: DataFrame, text: str = "text", templates: dict[str, str] = TEMPLATES, least: float = LEAST_DICE) -> DataFrame:
    """Replaces the text by the best licence of each row, its coefficient and place, and all licences found, sorted and comma-joined. Columns of those names are replaced."""
    own = [c for c in df.columns if c not in ("license", "dice", "first_word", "end_word", "licenses") or c == text]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Templates(templates, least)
        for batch in batches:
            best, every = [], []
            for row, end, data, offsets in text_slices(batch.column(text)):
                h, starts = words(data, offsets, ALNUM_WORDS)
                b = runs(h, 2)
                mask = known.table[(b & np.uint64(TABLE - 1)).astype(np.int64)]
                total = np.concatenate([[0], np.cumsum(mask)])
                for d in range(end - row):
                    lo, hi = starts[d], max(starts[d], starts[d + 1] - 1)
                    found = known.match(b[lo:hi]) if hi > lo and total[hi] > total[lo] else []
                    best.append(max(found, key=lambda f: (f[0], [-ord(c) for c in f[1]])) if found else (None, None, None, None))
                    every.append(",".join(sorted(f[1] for f in found)))
            kept = [batch.column(c) for c in own if c != text]
            columns = [pa.array([x[1] for x in best], pa.string()), pa.array([x[0] for x in best], pa.float64()), pa.array([x[2] for x in best], pa.int64()), pa.array([x[3] for x in best], pa.int64()), pa.array(every, pa.string())]
            yield pa.RecordBatch.from_arrays([*kept, *columns], [*[c for c in own if c != text], "license", "dice", "first_word", "end_word", "licenses"])

    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema if f.name in own and f.name != text] + [OUT])
    return df.select(*[f"`{c}`" for c in own]).mapInArrow(scan, schema)


def op8_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(documents(spark, sf_dir, "doc_id", "text"))
