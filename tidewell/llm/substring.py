"""Substring dedup on words: seed and extend.

Seeds are winnowed anchors of 18 words. Documents meet on an anchor; from there matches are
extended to the left and to the right, word by word, for all members of an anchor at once:
members that agree so far stay in one class, and a class that reaches 35 words with two
members or more is a repeat. Overlapping repeats merge into maximal ones, whose words are
removed at every place they occur.

Edge cases. Null or empty text: no words, nothing removed, `kept` is empty. Repeated rows are
texts of their own, so their windows repeat. Windows within one document count. A null
doc_id is an id like any other. An empty table gives an empty result. Extra columns are not
used. Equality of a seed, and of each extension, is that of 64-bit hashes over the words.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tidewell.llm.repeats import Search, Sequences
from tidewell.llm.textkit import Rolling, blocks, flat, mix, words

WINDOW, SEED_WORDS = 35, 18

_STEP = np.uint64(0x9E3779B97F4A7C15)


def read(docs: pa.Table) -> Sequences:
    """Word hashes of every document."""
    values, counts = [], []
    for block in blocks(docs.combine_chunks().to_batches(), "text"):
        data, offsets = flat(block.column("text"))
        starts, ends, first = words(data, offsets)
        values.append(Rolling(data).span(starts, ends))
        counts.append(np.diff(first))
    sizes = np.concatenate(counts) if counts else np.zeros(0, np.int64)
    return Sequences(
        np.concatenate(values) if values else np.zeros(0, np.uint64),
        np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64),
        np.zeros(len(sizes), np.int64),
    )


def extend(anchor: np.ndarray, lead: np.ndarray, place: np.ndarray, windows: np.ndarray, blob: np.ndarray, cuts: np.ndarray, window: int = WINDOW, seed: int = SEED_WORDS) -> np.ndarray:
    """Windows of each segment that another segment holds too, by extension on both sides."""
    values = blob.view(np.uint64)
    at = cuts[:-1] // 8 + place
    spare = window - seed
    base = Rolling(values, 1).span(at, at + seed) ^ anchor.astype(np.uint64)
    left, right = [base], [base]
    room_left, room_right = place.astype(np.int64), cuts[1:] // 8 - at - seed
    for step in range(1, spare + 1):
        for classes, room, where in ((left, room_left, at - step), (right, room_right, at + seed + step - 1)):
            word = values[np.clip(where, 0, len(values) - 1)]
            classes.append(mix(classes[-1] * _STEP + np.where(room >= step, word, np.uint64(0)) + np.uint64(step)))
    mask = np.zeros(len(anchor), np.uint64)
    for o in range(spare + 1):
        window_at = place.astype(np.int64) - o
        here = np.flatnonzero((window_at >= 0) & (window_at < windows))
        if not len(here):
            continue
        both = mix(left[o][here] * _STEP ^ right[spare - o][here])
        _, inverse, counts = np.unique(both, return_inverse=True, return_counts=True)
        hit = here[counts[inverse] > 1]
        mask[hit] |= np.uint64(1) << window_at[hit].astype(np.uint64)
    return mask


def _finish(docs: pa.Table, seq: Sequences, gone: np.ndarray) -> pa.Table:
    kept, at = [], 0
    for block in blocks(docs.combine_chunks().to_batches(), "text"):
        data, offsets = flat(block.column("text"))
        starts, ends, first = words(data, offsets)
        stay = ~gone[at : at + len(starts)]
        at += len(starts)
        # Kept words joined by one space, all documents in one buffer.
        sizes = (ends - starts)[stay] + 1
        inside = np.zeros(len(data) + 1, np.int8)
        inside[starts[stay]] += 1
        np.subtract.at(inside, ends[stay], 1)
        joined = np.full(int(sizes.sum()), 0x20, np.uint8)
        gap = np.zeros(len(joined), bool)
        gap[np.cumsum(sizes) - 1] = True
        joined[~gap] = data[np.cumsum(inside[:-1]) > 0]
        buffer = joined.tobytes()
        ends_at = np.concatenate([[0], np.cumsum(sizes)])[np.concatenate([[0], np.cumsum(stay)])[first]]
        kept += [buffer[i : max(i, j - 1)] for i, j in zip(ends_at[:-1].tolist(), ends_at[1:].tolist(), strict=True)]
    sums = np.concatenate([[0], np.cumsum(gone)])[seq.offsets]
    return pa.table({
        "doc_id": docs.column("doc_id"), "n_words": np.diff(seq.offsets), "n_removed": np.diff(sums), "kept": pa.array(kept, pa.binary()).cast(pa.string()),
    })


def remove_repeats(docs: DataFrame, window: int = WINDOW, seed: int = SEED_WORDS) -> DataFrame:
    """doc_id, n_words, n_removed, kept (words left, joined by one space) of every row."""

    def compare(*sent: np.ndarray) -> np.ndarray:
        return extend(*sent, window=window, seed=seed)

    search = Search(window, seed, False, read, compare)
    return search.run(docs, _finish, "doc_id long, n_words long, n_removed long, kept string", 0.25)
