"""Licence notices by Dice coefficient over word bigrams.

Texts and templates are normalised to lower-case words of letters and digits. Every window of a text that
has as many words as a template is compared with it by their sets of distinct bigrams. A template is a
candidate only for texts that hold enough of its bigrams for the coefficient to reach the threshold at
all; its windows are then counted in one pass, so time grows with the text and not with what repeats in it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickloom.llm.tables import bounded_batches
from tickloom.llm.textcodes import ALNUM, Texts, slices

THRESHOLD = 0.8

# fixed values: titles, notices and texts of public licences
_PERMITTED = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."
_UNENDORSED = "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."
_AS_IS = "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
_GNU_NOTICE = "{0} is free software{1} you can redistribute it and/or modify it under the terms of the {2} as published by the Free Software Foundation{3} either version {4} of the License, or (at your option) any later version. {0} is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the {2} for more details."
TEMPLATES = {
    "Apache-2.0": [
        "Apache License, Version 2.0",
        """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.""",
    ],
    "MIT": [
        "MIT License",
        """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
    ],
    "ISC": [
        "ISC License",
        """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.""",
    ],
    "BSD-2-Clause": ["BSD 2-Clause License", f"{_PERMITTED} {_AS_IS}"],
    "BSD-3-Clause": ["BSD 3-Clause License", f"{_PERMITTED} {_UNENDORSED} {_AS_IS}"],
    "GPL-2.0": ["GNU General Public License, version 2", _GNU_NOTICE.format("This program", ";", "GNU General Public License", ";", "2")],
    "GPL-3.0": ["GNU General Public License, version 3", _GNU_NOTICE.format("This program", ":", "GNU General Public License", ",", "3")],
    "LGPL-2.1": ["GNU Lesser General Public License, version 2.1", _GNU_NOTICE.format("This library", ";", "GNU Lesser General Public License", ";", "2.1")],
    "LGPL-3.0": ["GNU Lesser General Public License, version 3", _GNU_NOTICE.format("This library", ":", "GNU Lesser General Public License", ",", "3")],
    "AGPL-3.0": ["GNU Affero General Public License, version 3", _GNU_NOTICE.format("This program", ":", "GNU Affero General Public License", ",", "3")],
    "MPL-2.0": ["Mozilla Public License, version 2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."],
    "BSL-1.0": [
        "Boost Software License, version 1.0",
        """Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the "Software") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following: The copyright notices in the Software and this entire statement, including the above license grant, this restriction and the following disclaimer, must be included in all copies of the Software, in whole or in part, and all derivative works of the Software, unless such copies or derivative works are solely in the form of machine-executable object code generated by a source language processor.""",
    ],
    "Zlib": [
        "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution."
    ],
    "Unlicense": ["This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."],
    "CC0-1.0": ["CC0 1.0", "Creative Commons Zero 1.0 Universal"],
    "CC-BY-4.0": ["CC BY 4.0", "Creative Commons Attribution 4.0 International"],
    "CC-BY-SA-4.0": ["CC BY-SA 4.0", "Creative Commons Attribution-ShareAlike 4.0 International"],
    "CC-BY-NC-4.0": ["CC BY-NC 4.0", "Creative Commons Attribution-NonCommercial 4.0 International"],
    "CC-BY-ND-4.0": ["CC BY-ND 4.0", "Creative Commons Attribution-NoDerivatives 4.0 International"],
    "All-Rights-Reserved": ["All rights reserved"],
}


class _Templates:
    """Bigrams of the templates as numbers, and for each template which of them it has."""

    def __init__(self, templates: dict[str, list[str]]):
        pairs = [(name, text) for name, texts in sorted(templates.items()) for text in texts]
        words = Texts(pa.array([t for _, t in pairs], pa.string())).words(ALNUM)
        at, code = words.runs(2)
        cut = np.searchsorted(at, words.bounds)
        sets = [np.unique(code[cut[i] : cut[i + 1]]) for i in range(len(pairs))]
        keep = [i for i, s in enumerate(sets) if len(s)]
        self.names, self.words = [pairs[i][0] for i in keep], [int(words.bounds[i + 1] - words.bounds[i]) for i in keep]
        self.sizes = np.array([len(sets[i]) for i in keep], np.int64)
        self.any = np.unique(np.concatenate([sets[i] for i in keep])) if keep else np.zeros(0, np.uint64)
        self.has = np.array([np.isin(self.any, sets[i]) for i in keep]).reshape(len(keep), len(self.any))


def _scan(batches: Iterator[pa.RecordBatch], templates: _Templates, threshold: float) -> Iterator[pa.RecordBatch]:
    kind = pa.list_(pa.struct([("license", pa.string()), ("word", pa.int64()), ("n_words", pa.int64()), ("dice", pa.float64())]))
    # dice >= t with n bigrams in common needs n / size >= t / (2 - t)
    least = np.ceil(templates.sizes * threshold / (2 - threshold) - 1e-9)
    for batch in batches:
        for part in slices(batch, "text"):
            texts = Texts(part.column("text"))
            words = texts.words(ALNUM)
            at, code = words.runs(2)
            found: list[list[dict]] = [[] for _ in range(len(texts))]
            if len(templates.any) and len(code):
                number = np.minimum(np.searchsorted(templates.any, code), len(templates.any) - 1)
                number = np.where(templates.any[number] == code, number, -1)
                hit = np.flatnonzero(number >= 0)
                owner = np.searchsorted(words.bounds, at[hit], "right") - 1
                pairs = np.unique(owner * len(templates.any) + number[hit])
                doc, which = pairs // len(templates.any), pairs % len(templates.any)
                docs = np.unique(doc)
                place = np.searchsorted(docs, doc)
                enough = np.array([np.bincount(place[templates.has[k][which]], minlength=len(docs)) >= least[k] for k in range(len(least))])
                for j in np.flatnonzero(enough.any(0)):
                    own = slice(*np.searchsorted(at, words.bounds[docs[j] : docs[j] + 2]))
                    found[docs[j]] = _notices(code[own], number[own], templates, np.flatnonzero(enough[:, j]), threshold)
            yield pa.RecordBatch.from_arrays([part.column("id"), pa.array(found, kind)], ["id", "found"])


def _notices(code: np.ndarray, number: np.ndarray, templates: _Templates, candidates: np.ndarray, threshold: float) -> list[dict]:
    """Windows that reach the threshold; of windows that overlap the one with most bigrams in common stays."""
    n = len(code)
    order = np.argsort(code, kind="stable")
    same = np.append(False, code[order[1:]] == code[order[:-1]])
    before = np.full(n, -1)  # the place before where the same bigram stands
    before[order[same]] = order[np.flatnonzero(same) - 1]
    good = []
    for k in candidates.tolist():
        wide = min(templates.words[k] - 1, n)

        def distinct(rows: np.ndarray, wide: int = wide) -> np.ndarray:
            """Distinct bigrams, among the rows, of each window: a row counts for windows that begin after its like."""
            step = np.bincount(np.maximum(before[rows] + 1, rows - wide + 1).clip(0), minlength=n + 1) - np.bincount(rows + 1, minlength=n + 1)
            return np.cumsum(step)[: n - wide + 1]

        common = distinct(np.flatnonzero((number >= 0) & templates.has[k][number]))
        dice = 2 * common / (distinct(np.arange(n)) + templates.sizes[k])
        good += [(-int(common[p]), -float(dice[p]), p, k, wide) for p in np.flatnonzero(dice >= threshold - 1e-12).tolist()]
    taken, out = np.zeros(n + 1, bool), []
    for _, minus, p, k, wide in sorted(good):
        if not taken[p : p + wide + 1].any():
            taken[p : p + wide + 1] = True
            out.append({"license": templates.names[k], "word": p, "n_words": wide + 1, "dice": -minus})
    return sorted(out, key=lambda x: x["word"])


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates: dict[str, list[str]] | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """Licence notices of every document: id_col, n_found, licenses (distinct, sorted) and found.

    found lists license, word (from 0), n_words and dice of the windows that reach the threshold, in order. A window has
    as many words as its template, or all words of a shorter text. Of windows that share a word the one with more
    bigrams in common with its template stays; ties go to the larger coefficient, the earlier window, then by template.
    A template of one word has no bigram and matches nothing. A null or empty text has no notice. Repeated rows give a
    row each; an empty table gives no rows; texts are taken whole, and time is linear in their length.
    """
    bounded_batches(docs.sparkSession)
    own = _Templates(templates or TEMPLATES)
    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    kind = source.schema["id"].dataType.simpleString()
    out = source.mapInArrow(lambda it: _scan(it, own, threshold), f"id {kind}, found array<struct<license:string,word:long,n_words:long,dice:double>>")
    return out.select(F.col("id").alias(id_col), F.size("found").cast("long").alias("n_found"), F.array_sort(F.array_distinct("found.license")).alias("licenses"), "found")
