"""License scans: MinHash bands over overlapping windows retrieve templates, shingle containment verifies them.

A template of n words belongs to the smallest window size W with n <= W - S + 1, where windows start every
S = W / 4 words; each span of W - S + 1 words lies whole in some window. A span that holds the share
CONTAINED of a template's shingles gives its window a Jaccard similarity of at least CONTAINED (n - k + 1) /
(W + n); the number of bands (of one hash each, as the template table is small) is chosen so that such a
window is missed with a probability of MISSED at most. Retrieved windows are then searched exactly: a document
matches if a span of W - S + 1 words holds that share of the template's distinct shingles.

Templates under SHORT words have shingles of two words, as many are shorter than five; the rest of five.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wayspan.llm.common import ALNUM, chunked, pair_hash, utf8_view, word_hashes

CONTAINED = 0.8
MISSED = 1e-6
SHORT = 20
#: Window sizes in words, of which the templates choose: whole license texts fit too.
SIZES = tuple(4 << k for k in range(15))

# Notices as their licenses give them.
TEMPLATES = {
    "all-rights-reserved": "All rights reserved.",
    "mit-line": "Released under the MIT License.",
    "cc-by-nc-4.0-line": "Licensed under CC BY-NC 4.0.",
    "apache-2.0-line": "Licensed under the Apache License, Version 2.0.",
    "gpl-3.0-line": "This work is licensed under the GNU General Public License, version 3.",
    "cc-by-sa-4.0-line": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "mit": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    "apache-2.0": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
    "gpl-3.0": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "mpl-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
    "isc": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.",
    "bsd": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
}


def bands_for(similarity: float, missed: float = MISSED) -> int:
    """Bands of one hash each that miss a pair of this similarity with the given probability at most."""
    return max(1, math.ceil(math.log(missed) / math.log(1 - similarity)))


def _shingles(words: np.ndarray, size: int) -> np.ndarray:
    rolled = words
    for k in range(1, size):
        rolled = pair_hash(rolled[: max(0, len(rolled) - 1)], words[k:])
    return rolled


class Templates:
    """Templates by shingle and window size, with the smallest value of every hash."""

    def __init__(self, texts: dict[str, str]):
        names = sorted(texts)
        data, offsets = utf8_view(pa.array([texts[n] for n in names], pa.string()))
        words, _, _, bounds = word_hashes(data, offsets, ALNUM)
        self.classes: dict[tuple[int, int], list[tuple[str, np.ndarray]]] = {}
        self.bands: dict[tuple[int, int], int] = {}
        for name, a, b in zip(names, bounds[:-1], bounds[1:], strict=True):
            n, size = int(b - a), 2 if b - a < SHORT else 5
            if n < size:
                raise ValueError(f"the template {name} has fewer than {size} words")
            fits = [w for w in SIZES if n <= w - w // 4 + 1]
            if not fits:
                raise ValueError(f"the template {name} has more words than the largest window takes")
            key = (size, fits[0])
            self.classes.setdefault(key, []).append((name, np.unique(_shingles(words[a:b], size))))
            least = CONTAINED * (n - size + 1) / (fits[0] + n)
            self.bands[key] = max(self.bands.get(key, 1), bands_for(least))
        rng = np.random.default_rng(11)
        most = max(self.bands.values())
        self.scale = rng.integers(1, 1 << 32, most, dtype=np.uint32) | np.uint32(1)
        self.shift = rng.integers(0, 1 << 32, most, dtype=np.uint32)

    def hashed(self, shingles: np.ndarray, band: int) -> np.ndarray:
        return (shingles >> np.uint64(32)).astype(np.uint32) * self.scale[band] + self.shift[band]

    def scan(self, words: np.ndarray, bounds: np.ndarray) -> list[tuple[int, str, int, int, int]]:
        """(row, template, shingles found at most, shingles of the template, first word of the first span)."""
        ends = np.repeat(bounds[1:], np.diff(bounds))
        out: dict[tuple[int, str], tuple[int, int, int]] = {}
        for size in sorted({s for s, _ in self.classes}):
            shingles = _shingles(words, size)
            if not len(shingles):
                continue
            inside = np.arange(len(shingles)) + size <= ends[: len(shingles)]
            classes = [(w, self.classes[s, w], self.bands[s, w]) for s, w in self.classes if s == size]
            candidates: dict[str, list[np.ndarray]] = {}
            for band in range(max(b for _, _, b in classes)):
                value = np.where(inside, self.hashed(shingles, band), np.uint32(0xFFFFFFFF))
                for w, templates, bands in classes:
                    if band >= bands:
                        continue
                    step = w // 4
                    steps = -(-len(value) // step)
                    block = np.full(steps * step, 0xFFFFFFFF, np.uint32)
                    block[: len(value)] = value
                    least = block.reshape(steps, step).min(axis=1)
                    window = np.full(steps, 0xFFFFFFFF, np.uint32)
                    for k in range(4):
                        np.minimum(window[: steps - k], least[k:], out=window[: steps - k])
                    for name, own in templates:
                        hit = np.flatnonzero(window == self.hashed(own, band).min())
                        if len(hit):
                            candidates.setdefault(name, []).append(hit)
            for w, templates, _ in classes:
                for name, own in templates:
                    if name in candidates:
                        self._verify(name, own, w, size, np.unique(np.concatenate(candidates[name])) * (w // 4), shingles, inside, bounds, out)
        return [(row, name, *v) for (row, name), v in sorted(out.items())]

    @staticmethod
    def _verify(name, own, w, size, starts, shingles, inside, bounds, out) -> None:
        """Spans of the candidate windows that hold enough of the template's shingles, by document."""
        reach, need = w - w // 4 + 1, math.ceil(CONTAINED * len(own) - 1e-9)
        near = np.zeros(len(shingles) + 1, np.int32)
        np.add.at(near, starts, 1)
        np.add.at(near, np.minimum(starts + w, len(shingles)), -1)
        where = np.flatnonzero((np.cumsum(near[:-1]) > 0) & inside)
        code = np.minimum(np.searchsorted(own, shingles[where]), len(own) - 1)
        hit = own[code] == shingles[where]
        where, code = where[hit], code[hit]
        rows = np.searchsorted(bounds, where, "right") - 1
        for part in np.split(np.arange(len(where)), np.flatnonzero(np.diff(rows)) + 1) if len(where) else []:
            row = int(rows[part[0]])
            first, n = int(bounds[row]), int(bounds[row + 1] - bounds[row])
            at, codes = (where[part] - first).tolist(), code[part].tolist()
            # spans change only where a shingle leaves or enters: two pointers over the hits
            count, held, low, best, begun = [0] * len(own), 0, 0, 0, None
            for p, c in zip(at, codes, strict=True):
                count[c] += 1
                held += count[c] == 1
                while at[low] + reach < p + size:
                    count[codes[low]] -= 1
                    held -= count[codes[low]] == 0
                    low += 1
                if held >= need and begun is None:
                    begun = max(0, p + size - reach) if n > reach else 0
                best = max(best, held)
            if begun is not None:
                old = out.get((row, name), (0, len(own), begun))
                out[row, name] = (max(best, old[0]), len(own), min(begun, old[2]))


def license_matches(docs: DataFrame, templates: dict[str, str] | None = None, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, license, n_found and n_shingles (distinct shingles of the template, found in one span at most,
    and all) and first_word (where the first span that matches begins), a row for each document and template
    that match.

    Null, empty and short texts match nothing; repeated rows repeat their matches; extra columns are ignored;
    an empty table gives an empty one. Words are of a-z, 0-9 and letters beyond ASCII, A-Z as a-z.
    """
    sent = docs.sparkSession.sparkContext.broadcast(Templates(templates or TEMPLATES))  # a fixed table
    names = ["doc_id", "license", "n_found", "n_shingles", "first_word"]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = utf8_view(batch.column(1))
            for a, b in chunked(offsets):
                words, _, _, bounds = word_hashes(data, offsets[a : b + 1], ALNUM)
                found = sent.value.scan(words, bounds)
                if found:
                    rows, *rest = zip(*found, strict=True)
                    ids = batch.column(0).slice(a, b - a).take(pa.array(rows, pa.int64()))
                    yield pa.RecordBatch.from_arrays([ids, pa.array(rest[0], pa.string()), *(pa.array(x, pa.int64()) for x in rest[1:])], names)

    rows = docs.select(F.col(doc).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return rows.mapInArrow(scan, "doc_id long, license string, n_found long, n_shingles long, first_word long")


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_matches(spark.read.parquet(f"{sf_dir}/documents.parquet"))
