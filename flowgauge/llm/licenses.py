"""License scans: MinHash bands over overlapping windows of a text retrieve templates, exact containment verifies them.

Templates and texts are sequences of words without marks at their ends, in lower case. A template of k shingles is looked for
in windows of 2s shingles that begin at every multiple of s, where s is the next power of two from k on; so whatever part of a
text is as long as the template lies whole in some window. A window that holds the asked part of a template's shingles has at
least a certain Jaccard similarity with it, and as many one-row bands are compared as make a miss less likely than MISS.
Whatever collides is held against the shingles themselves.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, functions as F, types as T

from flowgauge.llm import shingles, support

#: Part of a template's shingles that a window must hold, in percent; the chance to miss a window that just does.
CONTAINED, MISS = 75, 1e-6

#: Public license notices by SPDX identifier; fixed values.
TEMPLATES = (
    ("MIT", "Released under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
            "documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation "
            "the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Unless required by applicable law or agreed to in writing, software distributed under the License is "
                   "distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0-or-later", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU "
                         "General Public License as published by the Free Software Foundation, either version 3 of the License, "
                         "or (at your option) any later version."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided "
                     "that the following conditions are met:"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."),
)
_ENDS = re.compile(r"^[\x21-\x2F\x3A-\x40\x5B-\x60\x7B-\x7E]+|[\x21-\x2F\x3A-\x40\x5B-\x60\x7B-\x7E]+$")


def clean(word: str) -> str:
    return _ENDS.sub("", word)


@dataclass
class Group:
    """Templates that share a window step: their shingles, how many of them must be found, and their minima by band."""

    step: int
    bands: int
    templates: list[tuple[int, np.ndarray, int]]
    minima: np.ndarray


class Index:
    """Templates by band of their MinHash signatures."""

    def __init__(self, templates: tuple[tuple[str, str], ...], seed: int = 5):
        import pyarrow as pa

        random = np.random.default_rng(seed)
        self._a = random.integers(0, 1 << 31, 256, np.uint32) * np.uint32(2) + np.uint32(1)
        self._b = random.integers(0, 1 << 32, 256, np.uint32)
        by_step: dict[int, list] = {}
        #: By template: where each of its sorted shingles first stands in it.
        self.orders: list[np.ndarray] = []
        for number, (_, text) in enumerate(templates):
            words, _ = shingles.word_hashes(pa.array([text]), clean)
            own, order = np.unique(shingles.run_hashes(words), return_index=True)
            self.orders.append(order)
            if len(words) < shingles.WIDTH:
                raise ValueError(f"template {number} has fewer than {shingles.WIDTH} words")
            by_step.setdefault(1 << (len(own) - 1).bit_length(), []).append((number, own, -(-len(own) * CONTAINED // 100)))
        self.groups = []
        for step, members in sorted(by_step.items()):
            least = min(need / (2 * step + len(own) - need) for _, own, need in members)
            bands = math.ceil(math.log(MISS) / math.log(1 - least)) if least < 1 else 1
            minima = np.array([[self.hashed(own.astype(np.uint32), band).min() for band in range(bands)] for _, own, _ in members])
            self.groups.append(Group(step, bands, members, minima))

    def hashed(self, low: np.ndarray, band: int) -> np.ndarray:
        return low * self._a[band % 256] + self._b[band % 256]

    def candidates(self, low: np.ndarray, sizes: np.ndarray):
        """(group, template in it, window) for texts with ``sizes`` shingles each, whose low halves follow in ``low``.

        Windows are numbered by their first block of the group's step, through all texts.
        """
        if not len(low):
            return
        blocks = {1: np.arange(len(low))}
        last: dict[int, np.ndarray] = {}
        counts: dict[int, np.ndarray] = {}
        starts = np.cumsum(sizes) - sizes
        for group in self.groups:
            counts[group.step] = -(-sizes // group.step)
            per = counts[group.step]
            number = np.arange(per.sum()) - np.repeat(np.cumsum(per) - per, per)
            blocks[group.step] = np.repeat(starts, per) + number * group.step
            final = np.zeros(per.sum(), bool)
            final[(np.cumsum(per) - 1)[per > 0]] = True
            last[group.step] = final
        found: dict[int, set[tuple[int, int]]] = {group.step: set() for group in self.groups}
        for band in range(max(group.bands for group in self.groups)):
            finest = self.hashed(low, band)
            for group in self.groups:
                if band >= group.bands:
                    continue
                least = finest if group.step == 1 else np.minimum.reduceat(finest, blocks[group.step])
                window = least.copy()
                window[:-1] = np.where(last[group.step][:-1], least[:-1], np.minimum(least[:-1], least[1:]))
                wanted = group.minima[:, band]
                maybe = np.zeros(1 << 16, bool)
                maybe[wanted >> 16] = True
                at = np.flatnonzero(maybe[window >> np.uint32(16)])
                for member in range(len(wanted)):
                    found[group.step].update((member, w) for w in at[window[at] == wanted[member]].tolist())
        for group in self.groups:
            for member, window in sorted(found[group.step]):
                yield group, member, int(blocks[group.step][window])


def scanned(docs: DataFrame, templates: tuple[tuple[str, str], ...] = TEMPLATES, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """One row for each row of ``docs``: doc_id and matches, an array of (template, license, found, shingles, start, end,
    spans).

    A match tells of the window that holds most of a template's shingles, the first of those; ``start`` and ``end`` are the
    first and the last (exclusive) word of what is found, of words that are not marks alone. ``spans`` has every occurrence
    (found, start, end) in turn: runs of the template's shingles in its order with gaps of at most a window's step that hold
    the asked part of it, and what else a window holds of it in another order, overlapping windows as one. Null, empty and very short texts
    have no matches; a text of any length is read whole. Rows that repeat and rows without an id are scanned like others.
    Other columns are not read. No rows give no rows.
    """
    span = T.StructType([T.StructField("found", T.IntegerType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType())])
    one = T.StructType([T.StructField("template", T.IntegerType()), T.StructField("license", T.StringType()),
                        T.StructField("found", T.IntegerType()), T.StructField("shingles", T.IntegerType()),
                        T.StructField("start", T.LongType()), T.StructField("end", T.LongType()),
                        T.StructField("spans", T.ArrayType(span))])
    schema = T.StructType([T.StructField("doc_id", docs.schema[doc_id].dataType), T.StructField("matches", T.ArrayType(one))])

    def run(batches):
        import pyarrow as pa

        index = Index(templates)
        arrow = pa.list_(pa.struct([("template", pa.int32()), ("license", pa.string()), ("found", pa.int32()),
                                    ("shingles", pa.int32()), ("start", pa.int64()), ("end", pa.int64()),
                                    ("spans", pa.list_(pa.struct([("found", pa.int32()), ("start", pa.int64()), ("end", pa.int64())])))]))
        for batch in batches:
            matches = [m for part in shingles.parts(batch.column(1)) for m in _matches(index, part, templates)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(matches, arrow)], names=schema.names)

    return support.by_batch(docs.select(docs[doc_id].alias("doc_id"), docs[text].alias("text")), run, schema)


def _matches(index: Index, texts, templates) -> list[list[dict]]:
    words, bounds = shingles.word_hashes(texts, clean)
    counts = np.diff(bounds)
    sizes = np.maximum(counts - shingles.WIDTH + 1, 0)
    starts = np.cumsum(sizes) - sizes
    every = shingles.run_hashes(words) if len(words) >= shingles.WIDTH else np.zeros(0, np.uint64)
    offset = np.arange(sizes.sum()) - np.repeat(starts, sizes)
    own = every[np.repeat(bounds[:-1], sizes) + offset] if len(offset) else every[:0]
    ends = starts + sizes
    best: list[dict[int, dict]] = [{} for _ in range(len(texts))]
    windows: dict[tuple[int, int], list[np.ndarray]] = {}
    for group, member, place in index.candidates(own.astype(np.uint32), sizes):
        number, template, need = group.templates[member]
        doc = int(np.searchsorted(ends, place, side="right"))
        window = own[place : min(place + 2 * group.step, int(ends[doc]))]
        hit = np.flatnonzero(np.isin(window, template))
        held = len(np.unique(window[hit]))
        if held >= need:
            windows.setdefault((doc, number), []).append(place - int(starts[doc]) + hit)
        if held >= need and held > best[doc].get(number, {"found": 0})["found"]:
            first = place - int(starts[doc])
            best[doc][number] = {"template": number, "license": templates[number][0], "found": held, "shingles": len(template),
                                 "start": first + int(hit[0]), "end": first + int(hit[-1]) + shingles.WIDTH}
    members = {number: (template, need, group.step) for group in index.groups for number, template, need in group.templates}
    for (doc, number), hits in windows.items():
        text = own[int(starts[doc]) : int(ends[doc])]
        template, need, step = members[number]
        best[doc][number]["spans"] = [
            {"found": found, "start": first, "end": end} for found, first, end in _occurrences(text, index.orders[number], template, need, step, hits)]
    return [[found[n] for n in sorted(found)] for found in best]


def _occurrences(text: np.ndarray, order: np.ndarray, template: np.ndarray, need: int, step: int, windows: list[np.ndarray]) -> list[tuple[int, int, int]]:
    """(found, start, end) of each occurrence in ``windows``, the places of a template's shingles by verified window."""
    at = np.unique(np.concatenate(windows))
    place = order[np.searchsorted(template, text[at])]
    breaks = np.flatnonzero((np.diff(place) <= 0) | (np.diff(at) > step)) + 1
    runs = [run for run in np.split(at, breaks) if len(run) >= need]  # places ascend, so no shingle is there twice
    taken = np.concatenate(runs) if runs else at[:0]
    rest = []
    for hit in sorted(windows, key=lambda x: int(x[0])):
        left = np.setdiff1d(hit, taken)
        if len(np.unique(text[left])) < need:
            continue
        if rest and left[0] < rest[-1][-1] + shingles.WIDTH:
            rest[-1] = np.union1d(rest[-1], left)
        else:
            rest.append(left)
    return sorted(((len(np.unique(text[run])), int(run[0]), int(run[-1]) + shingles.WIDTH) for run in [*runs, *rest]), key=lambda x: x[1:])


@support.query("op8_license_scan")
def op8(spark, sf_dir):
    found = scanned(support.table(spark, sf_dir, "documents"))
    spans = F.flatten(F.transform("matches", lambda m: F.transform(m["spans"], lambda x: F.format_string(
        "%d:%s:%d/%d:%d:%d", m["template"], m["license"], x["found"], m["shingles"], x["start"], x["end"]))))
    return found.select("doc_id", F.size(spans).cast("long").alias("n_matches"),
                        F.array_join(F.array_sort(F.array_distinct("matches.license")), ",").alias("licenses"),
                        F.array_join(spans, ",").alias("spans"))
