"""License notices found by conditional compression.

Candidate blocks follow from the templates alone: places where enough pairs of
neighbouring words of one template lie within its length.  A block is
compressed plainly and with each template as a raw zstandard dictionary; the
template that saves most bytes explains the block best.  In that order they
are confirmed by exact wording: the template's words are aligned with the
block's, and what is missing, added or kept is counted.  What a confirmed
notice covers is cut out and the rest of the block is tried again, so several
notices in one place are all reported.

Candidates: a notice keeps at least ``min_equal`` of its template's words in
order and adds at most ``max_added`` of them, and a missing or added word
breaks two pairs at most.  Blocks ask for a fifth of the pairs less three, and
for one at least, which is the least that so many words, apart or together,
can leave.  Only where every second word of a short template was changed no
pair may be left.

Scale: one pass over the texts, nothing is shuffled; pairs are found with
whole-buffer operations, and only blocks, at most ``BLOCK_CHARS`` characters
each, are compressed, so the work grows with the notices, however many stand
in one text.  Templates are a parameter of fixed size.

Edge cases: null, empty and word-free texts have no notices; a very long line
or text is searched over its whole length; of templates that save as much the
first by name is tried first; repeated rows and repeated notices are each
reported, rows without id too; an empty table gives an empty result; other
columns, also of clashing names, are ignored.
"""

from __future__ import annotations

import difflib
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, functions as F

from . import textkernel as K
from .scratch import bound_batches

# The wordings of the notices.
TEMPLATES = {
    "apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "apache-2.0-header": 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0. Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.',
    "bsd-3-clause": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
    "cc-by-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "cc-by-nc-4.0": "Licensed under CC BY-NC 4.0.",
    "cc-by-sa-4.0": "Licensed under CC BY-SA 4.0.",
    "gpl-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "gpl-3.0-header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "mit": "Released under the MIT License.",
    "mit-header": 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software.',
    "mpl-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
}
MIN_EQUAL = 0.8
MAX_ADDED = 0.2
BLOCK_CHARS = 4096
LEVEL = 3
OUT = "doc_id long, begin long, end long, license string, rank int, plain_bytes long, saved_bytes long, n_words long, n_equal long, n_added long, n_missing long, exact boolean"
_WORDS = re.compile(r"[^\W_]+(?:[.\-][^\W_]+)*", re.UNICODE)


_TOKEN = np.zeros(256, dtype=bool)
_TOKEN[48:58] = _TOKEN[65:91] = _TOKEN[97:123] = _TOKEN[128:] = True


def _pairs(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash of every pair of neighbouring words (0 across texts), and where its first begins and its second ends."""
    starts, ends = K.runs(_TOKEN[data], offsets)
    h = K.span_hash(K.prefix_hash(K.lower(data)), starts, ends)
    doc = np.searchsorted(offsets, starts, side="right")
    pair = K.mix(h[:-1] * np.uint64(0x9E3779B97F4A7C15) + h[1:]) | np.uint64(1)
    return np.where(doc[1:] == doc[:-1], pair, np.uint64(0)), starts[:-1], ends[1:]


class Templates:
    def __init__(self, templates: dict[str, str]):
        self.words = {name: [w.lower() for w in _WORDS.findall(text)] for name, text in templates.items()}
        self.counts = {name: Counter(words) for name, words in self.words.items()}
        self.plain = zstandard.ZstdCompressor(level=LEVEL)
        self.by = {name: zstandard.ZstdCompressor(level=LEVEL, dict_data=zstandard.ZstdCompressionDict(text.encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT)) for name, text in templates.items()}
        self.pairs = {}
        for name, text in templates.items():
            raw = np.frombuffer(text.encode(), np.uint8)
            found = np.unique(_pairs(raw, np.array([0, len(raw)]))[0])
            self.pairs[name] = found, len(self.words[name]), max(1, int(0.2 * len(found)) - 3)
        self.every = np.unique(np.concatenate([p for p, _, _ in self.pairs.values()])) if templates else np.zeros(0, np.uint64)

    def candidates(self, data: np.ndarray, offsets: np.ndarray) -> list[tuple[int, int]]:
        """Byte ranges of a slice in which a notice may lie, in order and apart from each other, each within one text."""
        pair, begin, end = _pairs(data, offsets)
        if not len(pair) or not len(self.every):
            return []
        known = np.flatnonzero(self.every[np.minimum(np.searchsorted(self.every, pair), len(self.every) - 1)] == pair)
        found = []
        for wanted, n, least in self.pairs.values():
            at = known[wanted[np.minimum(np.searchsorted(wanted, pair[known]), len(wanted) - 1)] == pair[known]]
            if len(at) < least:
                continue
            reach = int(1.2 * n) + 2
            # A run of ``least`` pairs within reach makes all its places candidates.
            first = np.flatnonzero(at[least - 1 :] - at[: len(at) - least + 1] <= reach)
            near = np.unique(first[:, None] + np.arange(least)) if len(first) else first
            low, high = np.maximum(at[near] - reach, 0), np.minimum(at[near] + reach, len(pair) - 1)
            found += zip(begin[low].tolist(), end[high].tolist())
        out: list[list[int]] = []
        for b, e in sorted(found):
            if out and b <= out[-1][1]:
                out[-1][1] = max(out[-1][1], e)
            else:
                out.append([b, e])
        apart = []
        for b, e in out:
            doc = int(np.searchsorted(offsets, b, side="right")) - 1
            while b < e:  # a place near a text's end reaches into the next
                stop = min(e, int(offsets[doc + 1]))
                if stop > b:
                    apart.append((b, stop))
                b, doc = stop, doc + 1
        return apart

    def ranked(self, block: str) -> tuple[int, list[tuple[int, str]]]:
        """Plain size, and (bytes saved, template), most first."""
        raw = block.encode("utf-8", "surrogatepass")
        plain = len(self.plain.compress(raw))
        return plain, sorted(((plain - len(c.compress(raw)), name) for name, c in self.by.items()), key=lambda x: (-x[0], x[1]))

    def confirm(self, name: str, block: str):
        """(begin, end, equal, added, missing) of the template's wording in the block, or None."""
        found = list(_WORDS.finditer(block))
        words, wanted = [m.group().lower() for m in found], self.words[name]
        if not words:
            return None
        best = None
        # The place is where the longest common run lies; wording is compared there only.
        run = difflib.SequenceMatcher(None, wanted, words, autojunk=False).find_longest_match()
        if run.size:
            low = max(0, run.b - run.a - len(wanted) // 4)
            high = min(len(words), run.b - run.a + len(wanted) + len(wanted) // 4 + 1)
            same = [m for m in difflib.SequenceMatcher(None, wanted, words[low:high], autojunk=False).get_matching_blocks() if m.size]
            equal = sum(m.size for m in same)
            first, last = low + same[0].b, low + same[-1].b + same[-1].size
            added, missing = last - first - equal, len(wanted) - equal
            if equal >= MIN_EQUAL * len(wanted) and added <= MAX_ADDED * len(wanted) + 1:
                best = found[first].start(), found[last - 1].end(), equal, added, missing
        return best

    def notices(self, text: str):
        """(begin, end, template, rank, plain bytes, saved bytes, words, equal, added, missing, exact) of the notices in a candidate."""
        low = 0
        while low < len(text):
            high = min(len(text), low + BLOCK_CHARS)
            done = low
            for row in sorted(self._within(text, low, high)):
                # What lies behind the last notice of a block, or crosses its end, is in the next as well.
                if high == len(text) or row[1] < high:
                    yield row
                    done = max(done, row[1])
            if high == len(text):
                return
            low = max(done, high - BLOCK_CHARS // 2)

    def _within(self, text: str, low: int, high: int):
        todo = [(low, high)]
        while todo:
            begin, end = todo.pop()
            row = self._best(text, begin, end)
            if row is not None:
                yield row
                todo += [(begin, row[0]), (row[1], end)]

    def _best(self, text: str, begin: int, end: int):
        """The confirmed template that explains the block best, ranked in a place of its own length."""
        block = text[begin:end]
        counts = Counter(m.group().lower() for m in _WORDS.finditer(block))
        # No alignment keeps more words than both sides have.
        possible = [name for name, own in self.counts.items() if own and (own & counts).total() >= MIN_EQUAL * own.total()]
        if not possible:
            return None
        plain, ranked = self.ranked(block)
        for rank, (saved, name) in enumerate(ranked, 1):
            wording = self.confirm(name, block) if saved > 0 and name in possible else None
            if wording:
                first, last, equal, added, missing = wording
                return begin + first, begin + last, name, rank, plain, saved, len(self.words[name]), equal, added, missing, added == missing == 0
        return None


def _scanner(templates: dict[str, str]):
    def scan(batches):
        known = Templates(templates)
        for batch in batches:
            rows = []
            for part, data, offsets in K.slices(batch):
                ids = part.column(0).to_pylist()
                for b, e in known.candidates(data, offsets):
                    doc = int(np.searchsorted(offsets, b, side="right")) - 1
                    before = len(data[offsets[doc] : b].tobytes().decode("utf-8", "replace"))
                    rows += [(ids[doc], before + row[0], before + row[1], *row[2:]) for row in known.notices(data[b:e].tobytes().decode("utf-8", "replace"))]
            kinds = [pa.int64()] * 3 + [pa.string(), pa.int32()] + [pa.int64()] * 6 + [pa.bool_()]
            yield pa.record_batch([pa.array([r[i] for r in rows], kind) for i, kind in enumerate(kinds)], [c.split()[0] for c in OUT.split(", ")])

    return scan


def find_notices(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates: dict[str, str] | None = None) -> DataFrame:
    """One row for each confirmed notice: its document, its place in characters, the template and how the wording differs."""
    bound_batches(docs.sparkSession)
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return source.mapInArrow(_scanner(templates or TEMPLATES), OUT)
