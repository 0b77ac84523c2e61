"""License scan: MinHash bands over overlapping word windows, then exact containment.

Texts and templates are lower-cased words, stripped of marks at their ends, cut into
shingles of five words (a template of fewer words: of all its words). Each template is
looked for with windows as wide as itself, one at every word. A window is a candidate when
it agrees with the template on a band of its MinHash signature. A window that holds 0.8 of
the shingles has a Jaccard similarity of 2/3 at least, and sixteen bands of two rows find
that with probability 0.9999, each of the neighbouring windows with its own chance besides.
A candidate is then checked exactly: the share of the template's shingles it holds must
reach the threshold. Windows without any shingle of a template cannot agree on a band, so
they are not signed.

Edge cases. Null or empty text: no match. Texts shorter than a template have one window, the
text itself. Repeated rows are scanned row by row. An empty table, or no templates, gives an
empty result. Extra columns are not used; a null doc_id is kept as null.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tidewell.llm.textkit import Rolling, blocks, flat, mix, words

SHINGLE, BANDS, ROWS, CONTAINMENT = 5, 16, 2, 0.8
#: Bytes of all templates together, at most: they go to every task.
TEMPLATE_BYTES = 8 << 20

# Public short notices and grants by which licenses are stated in texts.
TEMPLATES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0",
    "Apache-2.0 notice": (
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance '
        "with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"
    ),
    "MIT": "Released under the MIT License",
    "MIT grant": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
        'documentation files (the "Software"), to deal in the Software without restriction, including without limitation '
        "the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software"
    ),
    "BSD-3-Clause": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that "
        "the following conditions are met"
    ),
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3",
    "GPL notice": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General "
        "Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version"
    ),
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0",
    "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License",
    "CC-BY-SA-4.0": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0",
}

_EDGE = np.zeros(256, bool)
_EDGE[np.frombuffer(b".,;:!?()[]{}\"'", np.uint8)] = True


def tokens(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes of a block, and the index of each document's first word."""
    data, offsets = flat(column)
    low = data | ((data >= 65) & (data <= 90)).astype(np.uint8) << 5
    starts, ends, _ = words(low, offsets)
    starts, ends = starts.copy(), ends.copy()
    if len(low):
        for side in (0, 1):
            while True:
                edge = low[starts] if side == 0 else low[ends - 1]
                more = np.flatnonzero(_EDGE[edge] & (ends - starts > 1))
                if not len(more):
                    break
                if side == 0:
                    starts[more] += 1
                else:
                    ends[more] -= 1
        bare = ~((ends - starts == 1) & _EDGE[low[starts]])
        starts, ends = starts[bare], ends[bare]
    return Rolling(low).span(starts, ends), np.searchsorted(starts, offsets)


@dataclass(frozen=True)
class Template:
    name: str
    n_words: int
    gram: int
    shingles: np.ndarray  # distinct
    bands: np.ndarray


def _signs(grams: np.ndarray, seeds: np.ndarray) -> Iterator[np.ndarray]:
    for seed in seeds:
        yield mix(grams ^ seed) >> np.uint64(32)


_SEEDS = mix(np.arange(1, BANDS * ROWS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def prepare_templates(texts: dict[str, str]) -> list[Template]:
    if sum(len(t.encode()) for t in texts.values()) > TEMPLATE_BYTES:
        raise ValueError("templates are larger than TEMPLATE_BYTES")
    out = []
    for name, text in texts.items():
        values, _ = tokens(pa.array([text]))
        if not len(values):
            continue
        gram = min(SHINGLE, len(values))
        grams = np.unique(Rolling(values, 1).grams(gram))
        signs = np.array([s.min() for s in _signs(grams, _SEEDS)])
        bands = signs.reshape(BANDS, ROWS)
        out.append(Template(name, len(values), gram, grams, bands))
    return out


def scan_words(values: np.ndarray, first: np.ndarray, template: Template) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, first word, containment) of each document's best window of a template."""
    none = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    if len(values) < template.gram:
        return none
    doc = np.repeat(np.arange(len(first) - 1), np.diff(first))
    grams = Rolling(values, 1).grams(template.gram)
    n = len(grams)
    valid = doc[:n] == doc[template.gram - 1 :]
    # Only windows with a template shingle can pass; their neighbourhoods are all that is signed.
    member = valid & np.isin(grams, template.shingles)
    if not member.any():
        return none
    width = template.n_words - template.gram + 1
    near = np.flatnonzero(member)
    window = np.unique((near[:, None] - np.arange(width)).ravel())
    window = window[window >= 0]
    # Windows that lie in one document; a shorter document has the window at its start.
    last = np.minimum(first[doc[window] + 1] - template.gram, window + width - 1)
    inside = (last >= window) & ((window + width - 1 <= first[doc[window] + 1] - template.gram) | (window == first[doc[window]]))
    window, last = window[inside], last[inside]
    if not len(window):
        return none
    # Signatures: least hash over the window's shingles, for each seed.
    pad = np.concatenate([grams, np.zeros(width, np.uint64)])
    spots = np.minimum(window[:, None] + np.arange(width), last[:, None])
    found = np.zeros(len(window), bool)
    for low in range(0, len(window), max(1, (1 << 20) // width)):
        part = slice(low, low + max(1, (1 << 20) // width))
        own = pad[spots[part]]
        for band in range(BANDS):
            seeds = _SEEDS[band * ROWS : (band + 1) * ROWS]
            same = np.ones(len(own), bool)
            for r, signs in enumerate(_signs(own, seeds)):
                same &= signs.min(1) == template.bands[band, r]
            found[part] |= same
    window, spots = window[found], spots[found]
    if not len(window):
        return none
    hit = np.searchsorted(template.shingles, pad[spots])
    hit = np.minimum(hit, len(template.shingles) - 1)
    right = template.shingles[hit] == pad[spots]
    row, column = np.nonzero(right)
    pairs = np.unique(row * len(template.shingles) + hit[row, column])
    share = np.bincount(pairs // len(template.shingles), minlength=len(window)) / len(template.shingles)
    order = np.lexsort((window, -share, doc[window]))
    best = order[np.concatenate([[True], doc[window][order][1:] != doc[window][order][:-1]])]
    best = best[share[best] >= CONTAINMENT]
    return doc[window[best]], window[best] - first[doc[window[best]]], share[best]


def scan(docs: DataFrame, templates: dict[str, str] | None = None) -> DataFrame:
    """doc_id, license, first_word, n_words, containment: each document's best match of each template."""
    known = prepare_templates(TEMPLATES if templates is None else templates)
    schema = pa.schema({"doc_id": pa.int64(), "license": pa.string(), "first_word": pa.int64(), "n_words": pa.int64(), "containment": pa.float64()})

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches, "text"):
            values, first = tokens(block.column("text"))
            for template in known:
                doc, at, share = scan_words(values, first, template)
                n = len(doc)
                yield pa.record_batch(
                    [block.column("doc_id").take(pa.array(doc)), pa.array([template.name] * n, pa.string()), pa.array(at, pa.int64()), pa.array([template.n_words] * n, pa.int64()), pa.array(share, pa.float64())],
                    schema=schema,
                )

    return docs.selectExpr("cast(doc_id as long) AS doc_id", "cast(text as string) AS text").mapInArrow(
        work, "doc_id long, license string, first_word long, n_words long, containment double"
    )
