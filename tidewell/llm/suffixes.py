"""Suffix-array dedup on bytes by prefix-free parsing.

A rolling hash over 20 bytes triggers where it is least among its neighbours and cuts each
text into phrases that overlap by 49 bytes, so every string of 50 bytes begins in exactly
one phrase and lies inside it. The distinct phrases are the dictionary. Dictionaries are kept
per trigger hash: a phrase found nowhere else stays at home, a phrase found again is one
entry whatever its number of copies, with the smallest document that holds it. The suffixes
of the entries are sorted to 50 bytes per bucket of trigger hashes.

The parse (the phrases in the order of the texts) and its suffix array are left out, so no
order of all suffixes of the corpus is made. They are not needed here: suffixes match when
their first 50 bytes are equal, equal ones lie in phrases of one trigger hash and so in one
bucket, and the smallest document of the entries says for each run of equal suffixes which
is first. Every suffix of a later document is covered.

Edge cases. Null or empty text: no bytes. Texts under 50 bytes lose nothing. Rows that share
a doc_id are one document and never match each other; a null id counts as the smallest. An
empty table gives an empty result. Extra columns are not used. Remaining bytes need not be
valid UTF-8, so they come as binary.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tidewell.llm.repeats import Search, Sequences, _groups, _starts
from tidewell.llm.textkit import flat, runs

LENGTH, TRIGGER = 50, 20


def read(docs: pa.Table) -> Sequences:
    data, offsets = flat(docs.column("text"))
    ids = docs.column("doc_id").fill_null(np.iinfo(np.int64).min).to_numpy()
    return Sequences(data, offsets, ids)


def suffix_order(data: np.ndarray, at: np.ndarray, length: int = LENGTH) -> tuple[np.ndarray, np.ndarray]:
    """Order of the suffixes at `at` to `length` bytes, and which differ from the one before."""
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    columns = []
    for step in [*range(0, length - 7, 8), *([length - 8] if length % 8 else [])]:
        eight = np.zeros(len(at), np.uint64)
        for k in range(8):
            eight = eight << np.uint64(8) | padded[at + step + k].astype(np.uint64)
        columns.append(eight)
    order = np.lexsort(columns[::-1])
    new = np.zeros(len(at), bool)
    new[_starts(*(c[order] for c in columns))] = True
    return order, new


def match_suffixes(anchor: np.ndarray, lead: np.ndarray, place: np.ndarray, windows: np.ndarray, blob: np.ndarray, cuts: np.ndarray) -> np.ndarray:
    """Suffixes of each dictionary entry that occur in an entry with a smaller document."""
    windows = windows.astype(np.int64)
    entry = np.repeat(np.arange(len(lead)), windows)
    inner = np.arange(len(entry)) - np.repeat(np.cumsum(windows) - windows, windows)
    order, new = suffix_order(blob, cuts[entry] + inner)
    run = np.flatnonzero(new)
    mask = np.zeros(len(lead), np.uint64)
    if not len(run):
        return mask
    docs = lead[entry[order]]
    later = order[docs > np.minimum.reduceat(docs, run)[_groups(run, len(order))]]
    np.bitwise_or.at(mask, entry[later], np.uint64(1) << inner[later].astype(np.uint64))
    return mask


def _finish(docs: pa.Table, seq: Sequences, gone: np.ndarray) -> pa.Table:
    sums = np.concatenate([[0], np.cumsum(gone)])[seq.offsets]
    begins, _ = runs(gone, seq.offsets)
    spans = np.diff(np.searchsorted(begins, seq.offsets))
    buffer = seq.values[~gone].tobytes()
    cuts = seq.offsets - sums
    kept = pa.array([buffer[i:j] for i, j in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)], pa.binary())
    return pa.table({"doc_id": docs.column("doc_id"), "n_bytes": np.diff(seq.offsets), "n_removed": np.diff(sums), "n_spans": spans, "kept": kept})


def remove_repeats(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept (bytes left) of every row."""
    search = Search(LENGTH, TRIGGER, True, read, match_suffixes)
    return search.run(docs, _finish, "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary", 0.4)
