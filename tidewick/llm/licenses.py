"""License scans: MinHash bands over overlapping windows retrieve templates, exact containment verifies.

Templates are grouped by length. For a group of up to L words, windows of 1.5 L words start every L / 2
words, so that each passage of L words lies whole in a window. A window's signature has ``HASHES``
MinHash values of its word shingles (5 words, or the template's length if that is less); bands of a
group have as many rows as still let a window with the least qualifying similarity collide with
probability ``CERTAIN``. Retrieved templates are verified by the exact share of their shingles that the
window has, at least ``CONTAINMENT``.

Defined cases: null text is empty and has no license; an empty template matches nothing; repeated rows give
repeated results; a license found several times in a text is one row with its best window; empty tables
give an empty result; extra columns are ignored.
"""

from __future__ import annotations

import functools
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import odd_numbers, shingle_hashes, text_of, word_hashes

CONTAINMENT = 0.8
HASHES = 32
CERTAIN = 0.999
_CHUNK = 1 << 13

#: fixed values: public license notices and whole texts
TEMPLATES = {
    "all-rights-reserved": "All rights reserved.",
    "apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "apache-2.0-notice": 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at',
    "bsd-notice": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
    "cc-by-4.0": "Licensed under CC BY 4.0.",
    "cc-by-nc-4.0": "Licensed under CC BY-NC 4.0.",
    "cc-by-sa-4.0": "Licensed under CC BY-SA 4.0.",
    "gpl-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "gpl-notice": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "isc-notice": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "mit": "Released under the MIT License.",
    "mit-notice": 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction',
    "bsd-2-clause-text": 'Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.',
    "bsd-3-clause-text": 'Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.',
    "isc-text": 'Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.',
    "mit-text": 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.',
}

_A = (odd_numbers(HASHES, 41) >> np.uint64(32)).astype(np.uint32) | np.uint32(1)
_B = (odd_numbers(HASHES, 42) >> np.uint64(32)).astype(np.uint32)


def band_rows(similarity: float) -> int:
    """The most rows for each band with which bands of HASHES values collide with probability CERTAIN at this similarity; ValueError if even single rows don't."""
    fits = [r for r in (1, 2, 4, 8) if 1 - (1 - similarity**r) ** (HASHES // r) >= CERTAIN]
    if not fits:
        raise ValueError(f"{HASHES} hash functions don't find windows of similarity {similarity:.3f} for certain")
    return max(fits)


def least_similarity(template: int, window: int) -> float:
    """The least similarity of a window of so many shingles that has enough of a template's."""
    enough = math.ceil(CONTAINMENT * template)
    return enough / (window + template - enough)


def _hashed(shingles: np.ndarray) -> np.ndarray:
    """HASHES values of each shingle, and a last column of largest values, as reduceat needs each index to be in range."""
    low, high = shingles.astype(np.uint32), (shingles >> np.uint64(32)).astype(np.uint32)
    x = np.full((HASHES, len(shingles) + 1), np.uint32(0xFFFFFFFF))
    own = x[:, :-1]
    with np.errstate(over="ignore"):
        for a, b, c, row in zip(_A, _B, np.roll(_A, 1), own):
            np.multiply(low, a, out=row)
            row += b
            row ^= row >> np.uint32(15)
            row += high * c
    return x


def _signatures(x: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """HASHES rows of minima over [start, end) of hashed shingles."""
    return np.minimum.reduceat(x, np.stack([starts, ends], axis=1).ravel(), axis=1)[:, ::2]


class Group:
    """Templates of like length, their windows and band tables."""

    def __init__(self, templates: list[tuple[object, np.ndarray]]):
        self.size = max(len(w) for _, w in templates)
        self.k = min(5, min(len(w) for _, w in templates))
        self.step = max(1, (self.size + 1) // 2)
        self.span = self.size + self.step - self.k + 1  # shingles in a window
        self.names = [n for n, _ in templates]
        self.sets = [np.unique(shingle_hashes(w, self.k)) for _, w in templates]
        self.rows = band_rows(min(least_similarity(len(s), self.span) for s in self.sets))
        sig = np.concatenate([_signatures(_hashed(s), np.array([0]), np.array([len(s)])) for s in self.sets], axis=1)
        self.bands = []
        for v in self.folded(sig):
            order = np.argsort(v, kind="stable")
            self.bands.append((v[order], order))

    def folded(self, sig: np.ndarray) -> np.ndarray:
        """A 64-bit value for each band and window."""
        x = sig.reshape(HASHES // self.rows, self.rows, -1).astype(np.uint64)
        with np.errstate(over="ignore"):
            return (x * odd_numbers(self.rows, 43)[None, :, None]).sum(axis=1)

    def retrieve(self, sig: np.ndarray) -> np.ndarray:
        """Distinct (window, template) pairs that share a band."""
        found = [np.empty((0, 2), np.int64)]
        for (values, order), v in zip(self.bands, self.folded(sig)):
            lo, hi = np.searchsorted(values, v, "left"), np.searchsorted(values, v, "right")
            hit = np.flatnonzero(hi > lo)
            if len(hit):
                n = (hi - lo)[hit]
                at = np.repeat(lo[hit] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
                found.append(np.stack([np.repeat(hit, n), order[at]], axis=1))
        return np.unique(np.concatenate(found), axis=0)


class Scanner:
    def __init__(self, templates: list[tuple[object, str]]):
        rest = sorted(((n, w) for n, w in ((n, word_hashes(t or "")) for n, t in templates) if len(w)), key=lambda x: (len(x[1]), str(x[0])))
        self.groups = []
        while rest:
            own = [x for x in rest if len(x[1]) <= 1.25 * len(rest[0][1]) and min(5, len(x[1])) == min(5, len(rest[0][1]))]
            rest = rest[len(own) :]
            self.groups.append(Group(own))

    def scan(self, texts: list[str]) -> list[list[tuple[object, float, int]]]:
        """For each text (template, containment, first word of the window), best windows only."""
        best: list[dict] = [{} for _ in texts]
        batch, held = [], 0
        for i, t in enumerate(texts):
            w = word_hashes(t)
            if len(w):
                batch.append((i, w))
                held += len(w)
            if held >= _CHUNK:
                self._scan(batch, best)
                batch, held = [], 0
        if batch:
            self._scan(batch, best)
        return [[(name, share, -at) for name, (share, at) in sorted(b.items(), key=lambda x: str(x[0]))] for b in best]

    def _scan(self, batch: list, best: list) -> None:
        hashed: dict[int, tuple] = {}  # by words in a shingle: groups share what doesn't depend on their windows
        for g in self.groups:
            if g.k not in hashed:
                own = [(i, shingle_hashes(w, g.k)) for i, w in batch if len(w) >= g.k]
                flat = np.concatenate([s for _, s in own] or [np.empty(0, np.uint64)])
                hashed[g.k] = own, flat, _hashed(flat), np.cumsum([0, *(len(s) for _, s in own)])
            own, flat, x, offsets = hashed[g.k]
            if not own:
                continue
            sizes = np.diff(offsets)
            many = np.maximum(1, -(-(sizes - g.span + g.step) // g.step))
            owner = np.repeat(np.arange(len(own)), many)
            first = g.step * (np.arange(len(owner)) - np.repeat(np.cumsum(many) - many, many))
            starts, ends = first + offsets[owner], np.minimum(first + g.span, sizes[owner]) + offsets[owner]
            for w, t in g.retrieve(_signatures(x, starts, ends)).tolist():
                share = float(np.isin(g.sets[t], flat[starts[w] : ends[w]]).mean())
                if share >= CONTAINMENT:
                    i, at = own[owner[w]][0], int(first[w])
                    best[i][g.names[t]] = max(best[i].get(g.names[t], (0.0, 0)), (share, -at))


@functools.lru_cache(2)
def _scanner(templates: tuple) -> Scanner:
    return Scanner(list(templates))


def scan(docs: DataFrame, templates: dict[str, str] | None = None) -> DataFrame:
    """doc_id, license_id, containment, start (word of the best window): a row for each license that a document has. Templates are the stated dictionary."""
    stated = tuple((TEMPLATES if templates is None else templates).items())

    def run(batches):
        scanner = _scanner(stated)
        for b in batches:
            rows = [(d, *hit) for d, hits in zip(b.column(0).to_pylist(), scanner.scan(text_of(b.column(1)))) for hit in hits]
            cols = list(zip(*rows)) if rows else [()] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (b.schema.field(0).type, pa.string(), pa.float64(), pa.int64()))], names=["doc_id", "license_id", "containment", "start"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", F.col("text")).mapInArrow(run, f"doc_id {kind}, license_id string, containment double, start long")


def op2_licenses(spark, sf_dir: str) -> DataFrame:
    return scan(spark.read.parquet(f"{sf_dir}/documents.parquet"))
