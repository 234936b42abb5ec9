"""License scans: winnowed fingerprints of templates pick candidates, banded alignment reports coverage and spans.

A template is a sequence of words. Of every WINDOW consecutive GRAM-word hashes the least is a fingerprint (the rightmost
of equals), so any run of WINDOW + GRAM - 1 words that a text shares with a template holds one. Fingerprints lie in an
inverted index, with all grams and pairs of words of templates shorter than two windows; each word of each document is looked up in it, and hits on near diagonals are aligned with the template
within a band about them. A match is reported when the equal words are at least `least` of the template's, with the span of
the text in code points. Of overlapping matches the one with more equal words, then greater coverage, then the first name
stays. The index has the templates only, so its size is fixed by them.

Defined results: null and empty texts have no match; several matches in a text give several rows; repeated rows repeat; a
template of fewer than GRAM words is its own fingerprint. An empty table gives an empty result. Further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm import words as wd
from millrace.llm.common import pick, prepare, table
from millrace.llm.passages import Passages, align, char_span, document_words, text_hashes

GRAM, WINDOW, LEAST = 3, 3, 0.8

#: Notices and license texts in general use, by SPDX name and form. Callers may pass others, of any length.
TEMPLATES = {
    "MIT/line": "Released under the MIT License.",
    "MIT/licensed": "Licensed under the MIT License.",
    "Apache-2.0/line": "Licensed under the Apache License, Version 2.0.",
    "GPL-3.0/line": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-2.0/line": "This work is licensed under the GNU General Public License, version 2.",
    "LGPL-3.0/line": "This work is licensed under the GNU Lesser General Public License, version 3.",
    "AGPL-3.0/line": "This work is licensed under the GNU Affero General Public License, version 3.",
    "CC-BY-NC-4.0/line": "Licensed under CC BY-NC 4.0.",
    "CC-BY-4.0/line": "Licensed under CC BY 4.0.",
    "CC-BY-SA-4.0/line": "Licensed under CC BY-SA 4.0.",
    "CC-BY-4.0/notice": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-SA-4.0/notice": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "CC-BY-NC-4.0/notice": "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
    "MPL-2.0/header": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
    "Apache-2.0/header": 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.',
    "GPL-3.0/header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.",
    "MIT/text": 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.',
    "GPL-2.0/header": "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.",
    "LGPL-2.1/header": "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version. This library is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Lesser General Public License for more details.",
    "LGPL-3.0/header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Lesser General Public License for more details.",
    "AGPL-3.0/header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Affero General Public License for more details.",
    "BSD-2-Clause/text": 'Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.',
    "BSD-3-Clause/text": 'Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.',
    "ISC/text": 'Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.',
    "Unlicense/text": 'This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means. In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.',
    "Zlib/text": "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution.",
    "BSL-1.0/line": "Distributed under the Boost Software License, Version 1.0.",
    "EPL-2.0/notice": "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/",
    "CC0-1.0/notice": "To the extent possible under law, the author has dedicated all copyright and related and neighboring rights to this work to the public domain worldwide. This work is distributed without any warranty.",
}

_DDL = "doc_id long, license string, template string, coverage double, matched_words long, template_words long, char_start long, char_end long"


def winnow(grams: np.ndarray, window: int = WINDOW) -> list[int]:
    """Places of the fingerprints."""
    if len(grams) <= window:
        return [len(grams) - 1 - int(np.argmin(grams[::-1]))] if len(grams) else []
    views = np.lib.stride_tricks.sliding_window_view(grams[::-1], window)[::-1]
    last = np.arange(len(views)) + window - 1
    return sorted({int(x) for x in last - views.argmin(axis=1)})


def fingerprints(templates: dict[str, str]) -> Passages:
    known = Passages()
    for (name, _), h in zip(sorted(templates.items()), text_hashes([t for _, t in sorted(templates.items())]), strict=True):
        for segment, part in known.add((name, len(h)), h):
            n = min(GRAM, len(part))
            grams = wd.shingles(part, n)[: len(part) - n + 1]
            short = len(part) < 2 * WINDOW
            for place in range(len(grams)) if short else winnow(grams):
                known.seed(n, int(grams[place]), segment, place)
            if short and len(part) > 2:  # an edit amid few words leaves no longer gram
                for place, pair in enumerate(wd.shingles(part, 2)[: len(part) - 1].tolist()):
                    known.seed(2, pair, segment, place)
    return known.freeze()


def _copies(a: np.ndarray, words: np.ndarray, least: float) -> Iterator[tuple[int, int, int]]:
    """Start, end and equal words of the copies of a in words, in windows that hold two, so that time is linear in words."""
    margin, need = 4 + len(a) // 8, max(1, least * len(a))
    at, width = 0, 2 * (len(a) + margin)
    while len(words) - at >= need:
        part = words[at : at + width]
        _, equal, _, _, x, y = align(a, part)
        if equal >= need:
            if x >= need:
                yield from ((at + i, at + j, k) for i, j, k in _copies(a, part[:x], least))
            yield at + x, at + y, equal
            at += y
        else:
            at += len(a) + margin


def _scan(known: Passages, least: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for first, h, at, s, e, own, part in document_words(b.column(1)):
                found: dict[int, dict] = {}
                for d, segment, low, high in known.clusters(h, at):
                    a, words = known.texts[segment], h[at[d] : at[d + 1]]
                    band = 4 + len(a) // 8 + (high - low)
                    lo = max(0, low - band)
                    hi = min(len(words), high + len(a) + band)
                    _, equal, _, _, x, y = align(a, words[lo:hi], (low + high) // 2 - lo, band)
                    if y > x:
                        found.setdefault(d, {}).setdefault(known.owners[segment], []).append((lo + x, lo + y, equal))
                        for base, rest in ((lo, words[lo : lo + x]), (lo + y, words[lo + y : hi])):  # further copies in the cluster
                            found[d][known.owners[segment]] += [(base + i, base + j, k) for i, j, k in _copies(a, rest, least)]
                for d, by in found.items():
                    matches = []
                    for (name, size), spans in by.items():
                        for start, end, equal in _chained(spans, size):
                            if equal >= least * size:
                                matches.append((-equal, -equal / size, name, start, end, size))
                    taken: list[tuple[int, int]] = []
                    for equal, cover, name, start, end, size in sorted(matches):
                        if all(end <= x or start >= y for x, y in taken):
                            taken.append((start, end))
                            span = char_span(own, int(part[d]), int(s[at[d] + start]), int(e[at[d] + end - 1]))
                            rows.append((b.column(0)[first + d].as_py(), name.partition("/")[0], name, round(-cover, 6), -equal, size, *span))
            if rows:
                kinds = [pa.int64(), pa.string(), pa.string(), pa.float64(), *[pa.int64()] * 4]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=[x.split()[0] for x in _DDL.split(", ")])

    return run


def _chained(spans: list[tuple[int, int, int]], size: int) -> list[tuple[int, int, int]]:
    """Spans of the segments of a template longer than one segment, joined where they lie near; other spans as they are."""
    out: list[list[int]] = []
    for start, end, equal in sorted(set(spans)):
        if out and start - out[-1][1] <= 8 and out[-1][2] + equal <= size and start >= out[-1][1]:
            out[-1][1], out[-1][2] = end, out[-1][2] + equal
        else:
            out.append([start, end, equal])
    return [tuple(x) for x in out]


def license_scan(docs: DataFrame, templates: dict[str, str] | None = None, least: float = LEAST, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """A row for each match: license, template, coverage, words and the span in code points."""
    prepare(docs.sparkSession)
    rows = pick(docs, doc_id=doc_id, text=text).select(F.col("doc_id").cast("long"), "text")
    return rows.mapInArrow(_scan(fingerprints(TEMPLATES if templates is None else templates), least), _DDL)


def op6_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan(table(spark, sf_dir, "documents"))
