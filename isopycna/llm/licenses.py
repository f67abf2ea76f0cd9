"""License scans: a trained paragraph classifier, confirmed against templates.

Words are runs of letters and digits, so comment marks and line ends don't count and
wrapped lines are joined by themselves.  A paragraph is what stands between blank
lines (lines without a letter or digit).  In it, a passage is a stretch of words in
which word pairs known from the templates follow each other at most ``GAP`` words apart;
passages with fewer known pairs than any template could be confirmed by are left.

Each passage is classified: features are hashed word 1- to 3-grams, the model a
multinomial logistic regression over the license families and ``unknown``, trained on
the templates below, cut, damaged and set in foreign words, against word salad, halves
of different templates and passages of template words.  Proximal steps leave most weights
zero, so the model is a short list; it is trained once by the driver and broadcast.  Its
temperature is fitted on examples of its own, so that a probability means what it says.
A passage is reported if its likeliest class is a family with at least ``SURE``, and of all
templates the one that agrees best is of that family and agrees to ``CONFIRM``.  That all
rights are reserved stands in free notices too, so these words alone are no family.

Nothing is learnt from the corpus, so the model is the same at every size.  The plan
has no shuffle.  Null and empty texts have no license and no paragraph; repeated rows
answer alike; texts are scanned whole, in time in proportion to their length; other
columns, of whatever names, are ignored or kept as asked; an empty table gives no rows.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import textkit
from .common import documents

# The paragraphs of public licenses and the notices by which they are applied, as published.
TEXTS = {
    "Apache": [
        "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
        "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/ TERMS AND CONDITIONS FOR USE, REPRODUCTION, AND DISTRIBUTION",
        "Licensed under the Apache License, Version 2.0.",
    ],
    "BSD": [
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
        "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
        "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS AS IS AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES",
        "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
        "All advertising materials mentioning features or use of this software must display the following acknowledgement: This product includes software developed by the organization.",
    ],
    "BSL": [
        "Distributed under the Boost Software License, Version 1.0. (See accompanying file LICENSE_1_0.txt or copy at https://www.boost.org/LICENSE_1_0.txt)",
        "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the Software) to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software",
    ],
    "CDDL": [
        "The contents of this file are subject to the terms of the Common Development and Distribution License (the License). You may not use this file except in compliance with the License.",
        "The contents of this file are subject to the terms of the Common Development and Distribution License, Version 1.0 only (the License). You may not use this file except in compliance with the License. You can obtain a copy of the license at usr/src/OPENSOLARIS.LICENSE or http://www.opensolaris.org/os/licensing. See the License for the specific language governing permissions and limitations under the License.",
    ],
    "EPL": [
        "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/",
        "All rights reserved. This program and the accompanying materials are made available under the terms of the Eclipse Public License v1.0 which accompanies this distribution, and is available at http://www.eclipse.org/legal/epl-v10.html",
    ],
    "ISC": [
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
        "THE SOFTWARE IS PROVIDED AS IS AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS",
    ],
    "MIT": [
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:",
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
        "THE SOFTWARE IS PROVIDED AS IS, WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
        "Licensed under the MIT license.",
    ],
    "MPL": [
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
        "The contents of this file are subject to the Mozilla Public License Version 1.1 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.mozilla.org/MPL/",
    ],
    "PostgreSQL": [
        "Permission to use, copy, modify, and distribute this software and its documentation for any purpose, without fee, and without a written agreement is hereby granted, provided that the above copyright notice and this paragraph and the following two paragraphs appear in all copies.",
    ],
    "WTFPL": [
        "DO WHAT THE FUCK YOU WANT TO PUBLIC LICENSE TERMS AND CONDITIONS FOR COPYING, DISTRIBUTION AND MODIFICATION",
        "Everyone is permitted to copy and distribute verbatim or modified copies of this license document, and changing it is allowed as long as the name is changed.",
        "You just DO WHAT THE FUCK YOU WANT TO.",
    ],
    "Zlib": [
        "This software is provided as-is, without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.",
        "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:",
        "The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.",
        "Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.",
    ],
    "proprietary": [
        "All rights reserved. Unauthorized copying of this file, via any medium is strictly prohibited. Proprietary and confidential.",
    ],
    "public-domain": [
        "This is free and unencumbered software released into the public domain.",
        "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
        "Released under CC0 1.0 Universal, dedicated to the public domain.",
        "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
        "This work is dedicated to the public domain.",
    ],
}
# Names that the notices use, and identifiers of the SPDX list.
NAMES = {
    "Apache": (["Apache"], ["Apache-2.0"]),
    "BSD": (["BSD", "BSD 3-Clause", "BSD 2-Clause"], ["BSD-2-Clause", "BSD-3-Clause", "BSD-4-Clause"]),
    "BSL": (["Boost Software"], ["BSL-1.0"]),
    "CDDL": (["Common Development and Distribution"], ["CDDL-1.0", "CDDL-1.1"]),
    "EPL": (["Eclipse Public"], ["EPL-1.0", "EPL-2.0"]),
    "ISC": (["ISC"], ["ISC"]),
    "MIT": (["MIT"], ["MIT"]),
    "MPL": (["Mozilla Public"], ["MPL-1.1", "MPL-2.0"]),
    "PostgreSQL": (["PostgreSQL"], ["PostgreSQL"]),
    "WTFPL": (["WTFPL"], ["WTFPL"]),
    "Zlib": (["zlib"], ["Zlib"]),
    "public-domain": ([], ["Unlicense", "CC0-1.0"]),
}
# The GNU licenses and the Creative Commons licenses differ in their names only.
GNU = {"GPL": "General", "LGPL": "Lesser General", "AGPL": "Affero General"}
GNU_TEXTS = [
    "This program is free software: you can redistribute it and/or modify it under the terms of the GNU {} Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "This program is free software; you can redistribute it and/or modify it under the terms of the GNU {} Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
    "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU {} Public License for more details.",
    "You should have received a copy of the GNU {} Public License along with this program. If not, see https://www.gnu.org/licenses/.",
    "This work is licensed under the GNU {} Public License, version 3.",
    "Licensed under the GNU {} Public License.",
]
CREATIVE = {
    "CC-BY": "Attribution",
    "CC-BY-NC": "Attribution-NonCommercial",
    "CC-BY-SA": "Attribution-ShareAlike",
    "CC-BY-ND": "Attribution-NoDerivatives",
    "CC-BY-NC-SA": "Attribution-NonCommercial-ShareAlike",
    "CC-BY-NC-ND": "Attribution-NonCommercial-NoDerivatives",
}
CREATIVE_TEXTS = ["Licensed under {code} 4.0.", "This work is licensed under a Creative Commons {name} 4.0 International License.", "Creative Commons {name} 4.0 International"]
# As earlier versions name them, which say NoDerivs for NoDerivatives.
CREATIVE_EARLIER = ["This work is licensed under a Creative Commons {name} 3.0 Unported License.", "Creative Commons {name} License 3.0", "Licensed under {code} 3.0."]


def _templates() -> dict[str, list[str]]:
    out = {name: list(texts) for name, texts in TEXTS.items()}
    for name, (called, ids) in NAMES.items():
        out[name] += [f"Released under the {x} License." for x in called] + [f"Licensed under the {x} License." for x in called]
        out[name] += [f"SPDX-License-Identifier: {x}" for x in ids]
    for name, word in GNU.items():
        out[name] = [t.format(word) for t in GNU_TEXTS] + [f"SPDX-License-Identifier: {name}-{v}.0-{w}" for v in (2, 3) for w in ("only", "or-later")]
    for name, word in CREATIVE.items():
        code = name.replace("-", " ", 1)
        out[name] = [t.format(code=code, name=word) for t in CREATIVE_TEXTS] + [t.format(code=code, name=word.replace("Derivatives", "Derivs")) for t in CREATIVE_EARLIER]
        out[name] += [f"SPDX-License-Identifier: {name}-{v}" for v in ("3.0", "4.0")]
    return out


TEMPLATES = _templates()
FAMILIES = ["unknown", *sorted(TEMPLATES)]
# Words so common that a pair of them tells nothing.
COMMON = "the of to and or in a an is for this that by with any be as it on at not from all are you may if".split()
BITS = 18
GAP = 6
SURE = 0.6
CONFIRM = 0.6
#: Known pairs by which a passage that is only a part of a template can be confirmed.
PART = 10
U64 = np.uint64


def _longer(h: np.ndarray, words: np.ndarray, k: int) -> np.ndarray:
    return textkit.mix(h[:-1] * U64(0x2545F4914F6CDD1D) + words[k:])


def pairs_of(words: np.ndarray) -> np.ndarray:
    """Hashes of the neighbouring pairs of a sequence of words."""
    return _longer(words, words, 1) if len(words) > 1 else np.zeros(0, np.uint64)


def features(words: np.ndarray) -> np.ndarray:
    """Coordinates of the distinct 1- to 3-grams of a sequence of words."""
    two = pairs_of(words)
    three = _longer(two, words, 2) if len(words) > 2 else two[:0]
    return np.unique((np.concatenate([words, two, three]) & U64((1 << BITS) - 1)).astype(np.int64))


def hashed(text: str) -> np.ndarray:
    return textkit.word_hashes(pa.array([text], pa.string()), 0, 1, textkit.MARKS)[0]


def _damaged(r: np.random.Generator, words: list[str], i: int, foreign) -> list[str]:
    """A template as it stands in the wild: cut at one end, with words lost, among other words."""
    w = list(words)
    if len(w) > 24 and i % 4 == 3:
        a = int(r.integers(0, len(w) // 2))
        w = w[a : a + max(14, len(w) // 2)]
    if i and len(w) > 6:
        w = [x for x in w if r.random() > 0.06 * (i % 3)]
    extra = int(r.integers(0, 4)) if i % 2 else 0
    return foreign(extra) + w + foreign(int(r.integers(0, 3)) if i % 2 else 0)


def _examples(seed: int, per_template: int = 12) -> tuple[list[str], np.ndarray]:
    r = np.random.default_rng(seed)
    letters = list("abcdefghiklmnoprstuvwéäñ")
    foreign = lambda n: ["".join(r.choice(letters, r.integers(2, 10))) for _ in range(n)]
    texts, labels = [], []
    split = [(label, t.split()) for label, name in enumerate(FAMILIES[1:], 1) for t in TEMPLATES[name]]
    vocabulary = sorted({w for _, t in split for w in t})
    for label, words in split:
        for i in range(per_template):
            texts.append(" ".join(_damaged(r, words, i, foreign)))
            labels.append(label)
    for i in range(len(texts)):
        kind = i % 3
        if kind == 0:
            share = (0.0, 0.5, 0.9)[i // 3 % 3]
            words = [r.choice(vocabulary) if r.random() < share else x for x in foreign(int(r.integers(2, 30)))]
        elif kind == 1:
            # Beginnings and ends that belong together in no license.
            (x, one), (y, two) = split[int(r.integers(len(split)))], split[int(r.integers(len(split)))]
            if x == y:
                continue
            words = one[: max(2, len(one) // 4)] + foreign(int(r.integers(0, 3))) + two[-max(2, len(two) // 4) :]
        else:
            words = list(split[int(r.integers(len(split)))][1])
            r.shuffle(words)
        texts.append(" ".join(words))
        labels.append(0)
    return texts, np.array(labels)


def _probabilities(scores: np.ndarray, temperature: float) -> np.ndarray:
    z = scores / temperature
    e = np.exp(z - z.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


class Model:
    """Weights of the coordinates that have any, intercepts, temperature, and the templates' pairs."""

    def __init__(self, at: np.ndarray, weights: np.ndarray, intercepts: np.ndarray, temperature: float):
        self.at, self.weights, self.intercepts, self.temperature = at, weights, intercepts, temperature
        self.templates = [(label, set(pairs_of(hashed(t)).tolist())) for label, name in enumerate(FAMILIES[1:], 1) for t in TEMPLATES[name]]
        common = hashed(" ".join(COMMON))
        idle = {int(p) for w in common for p in textkit.mix(np.full(len(common), w) * U64(0x2545F4914F6CDD1D) + common)}
        self.known = np.array(sorted(set().union(*(t for _, t in self.templates)) - idle), np.uint64)
        #: The least number of known pairs by which any template can be confirmed.
        self.least = max(2, min(math.ceil(CONFIRM * len(t)) - len(t & idle) for _, t in self.templates))

    def scores(self, words: np.ndarray) -> np.ndarray:
        f = features(words)
        i = np.minimum(np.searchsorted(self.at, f), len(self.at) - 1)
        return self.weights[i[self.at[i] == f]].sum(axis=0) + self.intercepts

    def judge(self, words: np.ndarray) -> tuple[int, float]:
        """Family (0: unknown) and probability of a passage."""
        p = _probabilities(self.scores(words), self.temperature)
        k = int(p.argmax())
        return (k, float(p[k])) if k and p[k] >= SURE and self.best_template(words) == k else (0, float(p[0]))

    def best_template(self, words: np.ndarray) -> int:
        """Family of the template that agrees best with a passage, 0 if none agrees to ``CONFIRM``."""
        have = set(pairs_of(words).tolist())
        best = (CONFIRM, 0, 0)
        for label, template in self.templates:
            both = len(template & have)
            share = max(both / len(template), both / len(have) if both >= PART else 0.0)
            best = max(best, (share, both, label))
        return best[2]


@functools.cache
def model() -> Model:
    texts, labels = _examples(1)
    sets = [features(hashed(t)) for t in texts]
    w, b = np.zeros((1 << BITS, len(FAMILIES))), np.zeros(len(FAMILIES))
    sums = np.full((1 << BITS, 1), 1e-2)
    r = np.random.default_rng(2)
    for _ in range(8):
        for i in r.permutation(len(sets)):
            at = sets[i]
            p = _probabilities(w[at].sum(axis=0) + b, 1.0)
            p[labels[i]] -= 1.0
            sums[at] += (p * p).sum()
            rate = 0.3 / np.sqrt(sums[at])
            moved = w[at] - rate * p
            w[at] = np.sign(moved) * np.maximum(np.abs(moved) - 1e-4 * rate, 0.0)
            b -= 0.01 * p
    at = np.flatnonzero(np.abs(w).max(axis=1) > 0.02)
    out = Model(at, w[at], b, 1.0)
    texts, labels = _examples(3, 4)
    scores = np.array([out.scores(hashed(t)) for t in texts])
    loss = lambda t: -np.log(np.maximum(_probabilities(scores, t)[np.arange(len(labels)), labels], 1e-12)).mean()
    out.temperature = min((0.25 * 1.25**k for k in range(16)), key=loss)
    return out


def _paragraphs(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, row: np.ndarray) -> np.ndarray:
    """The number of the paragraph of each word: it changes with the row and where two line ends stand between two words."""
    if not len(starts):
        return np.zeros(0, np.int64)
    lines = np.concatenate([[0], np.cumsum(raw == 10)])
    fresh = np.ones(len(starts), bool)
    fresh[1:] = (row[1:] != row[:-1]) | (lines[starts[1:]] - lines[ends[:-1]] >= 2)
    return np.cumsum(fresh) - 1


def passages(model: Model, texts: pa.Array, first: int, last: int) -> tuple[np.ndarray, list[tuple[int, int, int, int, float]]]:
    """Paragraphs of each row, and ``(row, start, end, family, probability)`` of each passage with a license; code points."""
    words, bounds, starts, ends = textkit.word_places(texts, first, last, textkit.MARKS)
    n = last - first
    row = np.repeat(np.arange(n), np.diff(bounds))
    offsets = textkit.offsets_of(texts)[first : last + 1]
    lo = int(offsets[0])
    data = texts.buffers()[2]
    size = int(offsets[-1]) - lo
    raw = np.frombuffer(data, np.uint8, size, lo) if data is not None and size else np.zeros(0, np.uint8)
    paragraph = _paragraphs(raw, starts, ends, row)
    counts = np.zeros(n, np.int64)
    if len(words):
        fresh = np.concatenate([[True], paragraph[1:] != paragraph[:-1]])
        counts += np.bincount(row[fresh], minlength=n)
    pair = pairs_of(words)
    i = np.minimum(np.searchsorted(model.known, pair), len(model.known) - 1)
    hits = np.flatnonzero((model.known[i] == pair) & (paragraph[:-1] == paragraph[1:])) if len(pair) else np.zeros(0, np.int64)
    found: list[tuple[int, int, int, int, float]] = []
    if len(hits):
        apart = np.flatnonzero((np.diff(hits) > GAP + 1) | (paragraph[hits[1:]] != paragraph[hits[:-1]])) + 1
        cuts = [0, *apart.tolist(), len(hits)]
        runs = [(a, b) for a, b in zip(cuts[:-1], cuts[1:]) if b - a >= model.least]
        letters = np.concatenate([[0], np.cumsum((raw & np.uint8(0xC0)) != 0x80)]) if runs else None
        for a, b in runs:
            x, y = int(hits[a]), int(hits[b - 1]) + 2
            family, p = model.judge(words[x:y])
            if family:
                r = int(row[x])
                base = letters[int(offsets[r]) - lo]
                found.append((r, int(letters[starts[x]] - base), int(letters[ends[y - 1]] - base), family, p))
    return counts, found


def scan(docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Columns ``keep`` of ``docs`` with ``n_paragraphs`` and ``licenses``: array of struct(family, probability, start, end), code points."""
    rows = docs.select(*keep, F.col(text).alias("_text"))
    # Some hundred thousand numbers, whatever the corpus.
    shared = docs.sparkSession.sparkContext.broadcast(model())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("family", pa.string()), ("probability", pa.float64()), ("start", pa.int32()), ("end", pa.int32())]))
        for batch in batches:
            texts = textkit.filled(batch.column(len(keep)))
            found: list[list[dict]] = [[] for _ in range(batch.num_rows)]
            counts = np.zeros(batch.num_rows, np.int64)
            for first, last in textkit.chunks(texts):
                counts[first:last], hits = passages(shared.value, texts, first, last)
                for row, start, end, family, p in hits:
                    found[first + row].append({"family": FAMILIES[family], "probability": p, "start": start, "end": end})
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], pa.array(counts), pa.array(found, kind)], [*keep, "n_paragraphs", "licenses"])

    fields = ", ".join(f"`{c}` {t}" for c, t in rows.dtypes[:-1])
    return rows.mapInArrow(textkit.lean(run), f"{fields}, n_paragraphs long, licenses array<struct<family:string,probability:double,start:int,end:int>>")


def op3_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = scan(documents(spark, sf_dir).select("doc_id", "text"))
    found = F.col("licenses")
    return out.select(
        "doc_id",
        "n_paragraphs",
        F.size(found).cast("long").alias("n_licenses"),
        F.array_join(F.array_sort(F.array_distinct(found["family"])), ",").alias("families"),
        F.array_max(found["probability"]).alias("probability"),
        F.array_join(F.transform(found, lambda x: F.concat_ws(":", x["family"], x["start"], x["end"])), ",").alias("spans"),
    )


QUERIES = {"op3_licenses": op3_licenses}
