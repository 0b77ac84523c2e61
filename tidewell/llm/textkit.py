"""Array helpers for work on texts inside Arrow tasks.

A block is half a megabyte of whole documents laid end to end as UTF-8 bytes. Words, lines
and hashes of a block are found with numpy; no helper ever looks across two documents
unless its caller asks for positions of the block as a whole.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

#: A word is a run of bytes other than space and 0x09 to 0x0D.
WORD = r"[^\x20\x09-\x0D]+"
BLOCK_BYTES = 1 << 19

IS_SPACE = np.zeros(256, bool)
IS_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True

_BASES = [np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)]
_TABLES: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def n_words(text: Column) -> Column:
    """Number of words of a text (null: 0), in the JVM."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def blocks(batches: Iterable[pa.RecordBatch], text: str, limit: int = BLOCK_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of whole rows with about `limit` bytes of text; a longer text comes alone."""
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False)
        ends = np.cumsum(sizes, dtype=np.int64)
        at = 0
        while at < batch.num_rows:
            base = ends[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(ends, base + limit, "right")))
            yield batch.slice(at, to - at)
            at = to


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a text column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary()).fill_null(b"")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    if column.buffers()[2] is None:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    data = np.frombuffer(column.buffers()[2], np.uint8)[offsets[0] : offsets[-1]]
    return data, offsets - offsets[0]


def runs(mask: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of True, cut at document bounds."""
    cut = np.zeros(len(mask) + 1, bool)
    cut[offsets] = True
    before = np.zeros(len(mask), bool)
    before[1:] = mask[:-1]
    after = np.zeros(len(mask), bool)
    after[:-1] = mask[1:]
    starts = np.flatnonzero(mask & (~before | cut[:-1]))
    ends = np.flatnonzero(mask & (~after | cut[1:])) + 1
    return starts, ends


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Word starts, word ends, and the index of the first word of each document (n + 1)."""
    starts, ends = runs(~IS_SPACE[data], offsets)
    return starts, ends, np.searchsorted(starts, offsets)


def _tables(n: int, which: int) -> tuple[np.ndarray, np.ndarray]:
    known = _TABLES.get(which)
    if known is None or len(known[0]) < n:
        size = 1 << max(16, int(n).bit_length())
        base = int(_BASES[which])
        up, down = np.full(size, base, np.uint64), np.full(size, pow(base, -1, 1 << 64), np.uint64)
        up[0] = down[0] = 1
        known = _TABLES[which] = (np.multiply.accumulate(up), np.multiply.accumulate(down))
    return known


def mix(x: np.ndarray) -> np.ndarray:
    """Bijective finish that spreads all 64 bits."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(33)
    return x


class Rolling:
    """64-bit polynomial hashes of any span of a sequence, each in constant time."""

    def __init__(self, values: np.ndarray, which: int = 0):
        self.up, down = _tables(len(values) + 1, which)
        self.sums = np.zeros(len(values) + 1, np.uint64)
        np.cumsum((values.astype(np.uint64) + np.uint64(1)) * down[: len(values)], out=self.sums[1:])

    def span(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        length = (ends - starts).astype(np.uint64)
        raw = (self.sums[ends] - self.sums[starts]) * self.up[starts]
        return mix(raw + length * np.uint64(0xA0761D6478BD642F))

    def grams(self, k: int) -> np.ndarray:
        """Hash of every run of `k` values."""
        n = len(self.sums) - 1 - k + 1
        if n <= 0:
            return np.zeros(0, np.uint64)
        return mix((self.sums[k:] - self.sums[:-k]) * self.up[:n] + np.uint64(k * 0xA0761D6478BD642F & (1 << 64) - 1))


def slide(x: np.ndarray, w: int, op: np.ufunc) -> np.ndarray:
    """`op` (minimum or maximum) over every window of `w` values, by doubling."""
    done, out = 1, x
    while done < w:
        step = min(done, w - done)
        out = op(out[:-step], out[step:])
        done += step
    return out


def winnow(hashes: np.ndarray, valid: np.ndarray, w: int) -> np.ndarray:
    """Positions whose hash is the least of some window of `w` neighbours.

    Every window of `w` valid hashes holds a chosen one, picked by its content alone; all
    of a tie are chosen.
    """
    top = np.uint64(0xFFFFFFFFFFFFFFFF)
    h = np.where(valid, hashes, top)
    pad = np.full(w - 1, top)
    least = slide(np.concatenate([pad, h, pad]), w, np.minimum)
    zero = np.where(least == top, np.uint64(0), least)
    return np.flatnonzero(valid & (slide(zero, w, np.maximum) == h))


def cover(n: int, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Mask of the positions inside any of the spans."""
    steps = np.zeros(n + 1, np.int64)
    np.add.at(steps, starts, 1)
    np.add.at(steps, ends, -1)
    return np.cumsum(steps[:-1]) > 0
