"""License texts in documents: MinHash bands over overlapping windows, confirmed by shingle containment.

Windows come in sizes that double.  A template is looked up in the windows of its own size class: a window is three
blocks long and the next one starts a block later, where a block holds the template, so one window
holds all of a match.  A window that holds 80 % of a template's shingles has a least similarity with the template, which
follows from the template's size and the window's.  With one row per band, a template is looked up in so many bands that all
miss such a window with a probability below ``MISSED``; one that would take more than ``BANDS`` is looked up by its shingles.
What the bands retrieve is confirmed exactly: the share of the template's distinct shingles that the window holds.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Mapping
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from webposture.llm.text import Words, chunks, mix, rolling, split

#: Words of a shingle; a shorter template is its own shingle.
SHINGLE = 5
BANDS = 96
#: Probability that a window that holds a template is not looked at.
MISSED = 2e-5
#: Share of a template's shingles that a match holds.
CONTAINED = 0.8
#: Shingles of the smallest block.
BLOCK = 4

# Notices and headers as their authors ask for them.
TEMPLATES: dict[str, str] = {
    "Apache-2.0-notice": "Licensed under the Apache License, Version 2.0.",
    "MIT-notice": "Released under the MIT License.",
    "GPL-3.0-notice": "This work is licensed under the GNU General Public License, version 3.",
    "CC-BY-NC-4.0-notice": "Licensed under CC BY-NC 4.0.",
    "CC-BY-4.0-notice": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-SA-4.0-notice": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "Apache-2.0-header": (
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the '
        "License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law "
        'or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR '
        "CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and "
        "limitations under the License."
    ),
    "MIT": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation "
        'files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, '
        "modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software "
        "is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be "
        "included in all copies or substantial portions of the Software."
    ),
    "GPL-3.0-header": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as "
        "published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."
    ),
    "BSD-redistribution": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following "
        "conditions are met:"
    ),
    "MPL-2.0-header": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed "
        "with this file, You can obtain one at https://mozilla.org/MPL/2.0/."
    ),
}

#: Bytes that end a word: all but ASCII letters, digits and the bytes of other scripts.
_BREAK = np.array([not (chr(b).isascii() and chr(b).isalnum() or b > 127) for b in range(256)])
_rng = np.random.default_rng(4)
_FACTOR = (_rng.integers(0, 2**32, BANDS, dtype=np.uint64) | np.uint64(1)).astype(np.uint32)
_SHIFT = _rng.integers(0, 2**32, BANDS, dtype=np.uint64).astype(np.uint32)
_NONE = np.uint32(2**32 - 1)


def _narrow(shingles: np.ndarray) -> np.ndarray:
    return (mix(shingles) >> np.uint64(32)).astype(np.uint32)


def _bands_for(shingles: int, window: int) -> int:
    """Bands after which a window that holds a template of so many shingles is missed with a probability below ``MISSED``."""
    held = math.ceil(CONTAINED * shingles - 1e-9)
    similarity = held / (window + shingles - held)
    return 1 if similarity >= 1 else math.ceil(math.log(MISSED) / math.log1p(-similarity))


@dataclass
class Index:
    """Templates by size class (blocks of ``BLOCK << class`` shingles) and their band values."""

    names: list[str]
    shingles: list[np.ndarray]  #: distinct ones of each template, in order
    size: list[int]  #: words of a shingle
    words: list[int]
    classes: dict[tuple[int, int], list[int]]  #: by (words of a shingle, class)
    bands: dict[tuple[int, int], list[tuple[np.ndarray, np.ndarray]]]  #: per band: values in order, their templates
    direct: dict[tuple[int, int], list[int]]  #: templates that are looked up by their shingles

    @classmethod
    def build(cls, templates: Mapping[str, str]) -> Index:
        out = cls([], [], [], [], {}, {}, {})
        for name, text in templates.items():
            data = np.frombuffer(text.encode(), np.uint8)
            hashes = split(data, np.array([0, len(data)]), 0, _BREAK).hashes(lower=True)
            if not len(hashes):
                continue
            size = min(SHINGLE, len(hashes))
            found = rolling(hashes, size)
            level = max(0, int(-(-len(found) // BLOCK) - 1).bit_length())
            out.classes.setdefault((size, level), []).append(len(out.names))
            out.names.append(name)
            out.shingles.append(np.unique(found))
            out.size.append(size)
            out.words.append(len(hashes))
        for key, members in out.classes.items():
            needed = {t: _bands_for(len(out.shingles[t]), 3 * (BLOCK << key[1])) for t in members}
            out.direct[key] = [t for t in members if needed[t] > BANDS]
            members = [t for t in members if needed[t] <= BANDS]
            out.bands[key] = []
            for band in range(max([needed[t] for t in members], default=0)):
                values = np.array([(_narrow(out.shingles[t]) * _FACTOR[band] + _SHIFT[band]).min() for t in members])
                order = np.argsort(values, kind="stable")
                out.bands[key].append((values[order], np.array(members)[order]))
        return out

    def matches(self, words: Words) -> list[tuple[int, int, float, int, int]]:
        """(document, template, containment, first word, last word) of each window that holds a template."""
        hashes, found = words.hashes(lower=True), set()
        for size in {s for s, _ in self.classes}:
            shingles = rolling(hashes, size)
            if not len(shingles):
                continue
            levels = sorted(level for s, level in self.classes if s == size)
            # Documents are laid out so that each begins with a block of every size.
            unit = BLOCK << levels[-1]
            count = np.maximum(np.diff(words.offsets) - size + 1, 0)
            room = -(-count // unit) * unit
            begin = np.concatenate([[0], np.cumsum(room)])
            to = np.arange(count.sum()) + np.repeat(begin[:-1] - (np.cumsum(count) - count), count)
            of = np.arange(count.sum()) + np.repeat(words.offsets[:-1] - (np.cumsum(count) - count), count)
            narrow = _narrow(shingles)[of]
            for level in levels:
                for t in self.direct[size, level]:
                    blocks = np.unique(to[np.isin(shingles[of], self.shingles[t])] // (BLOCK << level))
                    found.update((size, level, int(h), t) for b in blocks for h in range(max(0, b - 2), b + 1))
            for band in range(max(len(self.bands[size, level]) for level in levels)):
                values = np.full(begin[-1], _NONE)
                values[to] = narrow * _FACTOR[band] + _SHIFT[band]
                least = np.minimum.reduce([values[k::BLOCK] for k in range(BLOCK)])
                for level in range(levels[-1] + 1):
                    if band < len(self.bands.get((size, level), ())):
                        known, members = self.bands[size, level][band]
                        window = least.copy()
                        window[:-1] = np.minimum(window[:-1], least[1:])
                        window[:-2] = np.minimum(window[:-2], least[2:])
                        low = np.searchsorted(known, window)
                        hit = np.flatnonzero((low < len(known)) & (known[np.minimum(low, len(known) - 1)] == window))
                        for h in hit:
                            k = low[h]
                            while k < len(known) and known[k] == window[h]:
                                found.add((size, level, int(h), int(members[k])))
                                k += 1
                    if level < levels[-1]:
                        least = np.minimum(least[::2], least[1::2])
            begins = begin
            for s, level, block, template in [f for f in found if f[0] == size]:
                at = block * (BLOCK << level)
                doc = int(np.searchsorted(begins, at, "right")) - 1
                first = int(words.offsets[doc] + at - begins[doc])
                last = int(min(first + 3 * (BLOCK << level), words.offsets[doc] + count[doc]))
                held = np.isin(shingles[first:last], self.shingles[template])
                share = len(np.unique(shingles[first:last][held])) / len(self.shingles[template])
                if share >= CONTAINED:
                    places = np.flatnonzero(held) + first - words.offsets[doc]
                    yield doc, template, share, int(places[0]), int(places[-1]) + size - 1


def license_matches(docs: DataFrame, templates: Mapping[str, str] = TEMPLATES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document and license template in it: doc_id, license, containment, first_word, last_word, matches.

    ``containment`` is the greatest share of the template's shingles in one window, ``first_word`` and ``last_word`` what
    the matching windows hold of them, ``matches`` the number of windows.  Words are runs of letters and digits without
    regard to case.  Null and empty texts match nothing; rows that repeat an id are one document.  The templates
    are a short list, so each task has all of them and documents stay where they are; other columns are not read.
    """
    index = Index.build(templates)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for words in chunks(batch.column(1), _BREAK):
                found = list(index.matches(words))
                if found:
                    doc, template, share, first, last = zip(*found)
                    yield pa.RecordBatch.from_arrays(
                        [batch.column(0).take(pa.array([words.first + d for d in doc])), pa.array([index.names[t] for t in template]),
                         pa.array(share), pa.array(first, pa.int64()), pa.array(last, pa.int64())],
                        names=["doc_id", "license", "containment", "first_word", "last_word"],
                    )

    kind = docs.schema[id_col].dataType.simpleString()
    found = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(
        scan, f"doc_id {kind}, license string, containment double, first_word long, last_word long"
    )
    return found.groupBy("doc_id", "license").agg(
        F.max("containment").alias("containment"), F.min("first_word").alias("first_word"), F.max("last_word").alias("last_word"),
        F.count("*").alias("matches"),
    )
