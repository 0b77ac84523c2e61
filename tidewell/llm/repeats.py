"""Equal windows of a sequence (words or bytes) all over a corpus.

Every window of `length` values holds the anchor of `gram` values with the least hash, the
last one of a tie; equal windows hold equal anchors at equal places. Neighbouring windows
with the same anchor form a segment, and segments are what the corpus is asked about:

1. Is this anchor found anywhere else? Most segments end here.
2. Is this whole segment found elsewhere, and do other segments share its anchor?
3. Of segments that share an anchor but differ, one of each kind is sent, and the caller's
   method finds which of its windows another kind holds too.

So copies of any number cost one segment per unit, and only the edges of repeats are
compared value by value.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tidewell.llm.exchange import Ask, Replies, Units
from tidewell.llm.textkit import BLOCK_BYTES, Rolling, cover, mix

BEATEN, WANTED = np.uint8(1), np.uint8(2)


@dataclass
class Sequences:
    """Values of all documents of a unit, laid end to end."""

    values: np.ndarray
    offsets: np.ndarray
    ids: np.ndarray


@dataclass
class Segments:
    """Runs of windows [first, last] around an anchor at `at`, with their document."""

    anchor: np.ndarray
    whole: np.ndarray
    doc: np.ndarray
    at: np.ndarray
    first: np.ndarray
    last: np.ndarray

    def take(self, i: np.ndarray) -> Segments:
        return Segments(*(getattr(self, f)[i] for f in ("anchor", "whole", "doc", "at", "first", "last")))


def _last_least(hashes: np.ndarray, w: int) -> np.ndarray:
    """Position of the least hash in every window of `w`, the last one of a tie."""
    value, place, done = hashes, np.arange(len(hashes), dtype=np.int32), 1
    while done < w:
        step = min(done, w - done)
        right = value[step:] <= value[:-step]
        value = np.where(right, value[step:], value[:-step])
        place = np.where(right, place[step:], place[:-step])
        done += step
    return place


def _block(seq: Sequences, low: int, high: int, length: int, gram: int) -> Segments | None:
    """Segments of documents low to high - 1."""
    base = seq.offsets[low]
    values = seq.values[base : seq.offsets[high]]
    n = len(values) - length + 1
    if n <= 0:
        return None
    doc = np.repeat(np.arange(low, high), np.diff(seq.offsets[low : high + 1]))
    rolling = Rolling(values)
    grams = rolling.grams(gram)
    at = _last_least(grams, length - gram + 1)
    good = doc[:n] == doc[length - 1 :]
    start = np.ones(n, bool)
    start[1:] = (at[1:] != at[:-1]) | ~good[:-1]
    first = np.flatnonzero(start & good)
    if not len(first):
        return None
    end = np.ones(n, bool)
    end[:-1] = start[1:] | ~good[1:]
    last = np.flatnonzero(end & good)
    at = at[first]
    anchor = mix(grams[at])  # least hashes are small ones; mixed again they spread over the buckets
    whole = Rolling(values, 1).span(first, last + length) ^ (at - first).astype(np.uint64)
    return Segments(anchor, whole, doc[first], at + base, first + base, last + base)


def segments(seq: Sequences, length: int, gram: int) -> Segments:
    """All segments of a unit in order of anchor and whole; worked through in blocks."""
    parts, low, n = [], 0, len(seq.offsets) - 1
    while low < n:
        limit = seq.offsets[low] + BLOCK_BYTES // seq.values.itemsize
        high = max(low + 1, int(np.searchsorted(seq.offsets, limit, "right")) - 1)
        part = _block(seq, low, min(high, n), length, gram)
        if part is not None:
            parts.append(part)
        low = high
    if not parts:
        none = np.zeros(0, np.int64)
        return Segments(none.astype(np.uint64), none.astype(np.uint64), none, none, none, none)
    got = Segments(*(np.concatenate([getattr(p, f) for p in parts]) for f in ("anchor", "whole", "doc", "at", "first", "last")))
    return got.take(np.lexsort((got.at, got.whole, got.anchor)))


def _starts(*columns: np.ndarray) -> np.ndarray:
    """Where a new combination begins in sorted columns."""
    new = np.zeros(len(columns[0]), bool)
    new[:1] = True
    for c in columns:
        new[1:] |= c[1:] != c[:-1]
    return np.flatnonzero(new)


def _groups(starts: np.ndarray, n: int) -> np.ndarray:
    mark = np.zeros(n, np.int64)
    mark[starts] = 1
    return np.cumsum(mark) - 1


@dataclass
class Search:
    """What is repeated: `other_doc` counts only windows of documents with a smaller id."""

    length: int
    gram: int
    other_doc: bool
    read: Callable[[pa.Table], Sequences]
    #: (anchor low bits, lead, place of the anchor, windows, blob, cuts) of the segments sent
    #: to one bucket -> mask of each one's windows that another one holds too.
    compare: Callable[..., np.ndarray]

    def _anchors(self, s: Segments, seq: Sequences) -> tuple[np.ndarray, np.ndarray]:
        """Start of each distinct anchor, and whether the unit itself repeats it."""
        starts = _starts(s.anchor)
        if not len(starts):
            return starts, np.zeros(0, bool)
        if self.other_doc:
            ids = seq.ids[s.doc]
            many = np.minimum.reduceat(ids, starts) != np.maximum.reduceat(ids, starts)
        else:
            many = np.diff(np.append(starts, len(s.anchor))) > 1
        return starts, many

    def _shared(self, docs: pa.Table, replies: Replies) -> tuple[Sequences, Segments]:
        """Segments whose anchor is found elsewhere too."""
        seq = self.read(docs)
        s = segments(seq, self.length, self.gram)
        starts, _ = self._anchors(s, seq)
        yes = replies[0].astype(bool) if 0 in replies else np.zeros(len(starts), bool)
        return seq, s.take(np.flatnonzero(yes[_groups(starts, len(s.anchor))]))

    def _kinds(self, s: Segments, seq: Sequences) -> tuple[np.ndarray, np.ndarray]:
        """Start of each distinct segment; its smallest id, or whether the unit repeats it."""
        starts = _starts(s.anchor, s.whole)
        if not len(starts):
            return starts, np.zeros(0, np.int64)
        if self.other_doc:
            return starts, np.minimum.reduceat(seq.ids[s.doc], starts)
        return starts, (np.diff(np.append(starts, len(s.anchor))) > 1).astype(np.int64)

    def ask_anchors(self, docs: pa.Table, replies: Replies) -> Ask:
        seq = self.read(docs)
        s = segments(seq, self.length, self.gram)
        starts, many = self._anchors(s, seq)
        low = s.anchor[starts] << np.uint64(1) | many.astype(np.uint64)
        return Ask(s.anchor[starts], [np.ascontiguousarray(low).view(np.uint8).reshape(-1, 8)[:, :5].copy().view("V5").ravel()])

    def answer_anchors(self, parts: list[Ask]) -> list[np.ndarray]:
        sizes = [len(p.columns[0]) for p in parts]
        wide = np.zeros((sum(sizes), 8), np.uint8)
        wide[:, :5] = np.concatenate([p.columns[0].view(np.uint8).reshape(-1, 5) for p in parts])
        key = wide.view(np.uint64).ravel()
        many, key = key & np.uint64(1), key >> np.uint64(1)
        _, inverse, counts = np.unique(key, return_inverse=True, return_counts=True)
        again = (counts > 1) | (np.bincount(inverse, many) > 0)
        return np.split(again[inverse].astype(np.uint8), np.cumsum(sizes)[:-1])

    def ask_kinds(self, docs: pa.Table, replies: Replies) -> Ask:
        seq, s = self._shared(docs, replies)
        starts, lead = self._kinds(s, seq)
        return Ask(s.anchor[starts], [s.anchor[starts].astype(np.uint32), s.whole[starts], lead])

    def answer_kinds(self, parts: list[Ask]) -> list[np.ndarray]:
        sizes = [len(p.columns[0]) for p in parts]
        anchor, whole, lead = (np.concatenate([p.columns[i] for p in parts]) for i in range(3))
        order = np.lexsort((whole, anchor))
        kinds = _starts(anchor[order], whole[order])
        kind = _groups(kinds, len(order))
        of_anchor = _groups(_starts(anchor[order]), len(order))
        first_kind, last_kind = kind[_starts(of_anchor)], kind[np.append(_starts(of_anchor)[1:], len(order)) - 1]
        mixed = (first_kind != last_kind)[of_anchor]
        lead = lead[order]
        if self.other_doc:
            least = np.minimum.reduceat(lead, kinds)[kind]
            beaten = least < lead
            wanted = mixed & ~beaten
        else:
            times = np.add.reduceat(1 + lead, kinds)[kind]
            beaten = times > 1
            holder = np.zeros(len(order), bool)
            holder[kinds] = True  # the first unit of each kind, as the sort is stable
            wanted = mixed & holder
        said = np.empty(len(order), np.uint8)
        said[order] = BEATEN * beaten + WANTED * wanted
        return np.split(said, np.cumsum(sizes)[:-1])

    def ask_windows(self, docs: pa.Table, replies: Replies) -> Ask:
        seq, s = self._shared(docs, replies)
        starts, lead = self._kinds(s, seq)
        said = replies.get(1, np.zeros(len(starts), np.uint8))
        sent = np.flatnonzero(said & WANTED)
        s, lead = s.take(starts[sent]), lead[sent]
        sizes = s.last + self.length - s.first
        cuts = np.concatenate([[0], np.cumsum(sizes)])
        inner = np.arange(cuts[-1]) - np.repeat(cuts[:-1] - s.first, sizes)
        blob = np.ascontiguousarray(seq.values[inner]).view(np.uint8)
        return Ask(
            s.anchor, [s.anchor.astype(np.uint32), lead, (s.at - s.first).astype(np.uint16), (s.last - s.first + 1).astype(np.uint16)],
            blob, cuts * seq.values.itemsize,
        )

    def answer_windows(self, parts: list[Ask]) -> list[np.ndarray]:
        sizes = [len(p.columns[0]) for p in parts]
        columns = [np.concatenate([p.columns[i] for p in parts]) for i in range(4)]
        blob = np.concatenate([p.blob for p in parts])
        lengths = np.concatenate([np.diff(p.cuts) for p in parts])
        mask = self.compare(*columns, blob, np.concatenate([[0], np.cumsum(lengths)]))
        return np.split(mask.astype("<u8"), np.cumsum(sizes)[:-1])

    def covered(self, docs: pa.Table, replies: Replies) -> tuple[Sequences, np.ndarray]:
        """Mask of the values inside a repeated window."""
        seq, s = self._shared(docs, replies)
        starts, lead = self._kinds(s, seq)
        kind = _groups(starts, len(s.anchor))
        said = replies.get(1, np.zeros(len(starts), np.uint8))
        whole = (said & BEATEN).astype(bool)[kind] if len(starts) else np.zeros(0, bool)
        if self.other_doc and len(starts):
            whole |= seq.ids[s.doc] > lead[kind]
        masks = np.zeros(len(starts), np.uint64)
        sent = np.flatnonzero(said & WANTED)
        if len(sent):
            masks[sent] = replies[2].view("<u8")
        low, high = s.first[whole], s.last[whole] + self.length
        part = np.flatnonzero(~whole & (masks[kind] > 0)) if len(starts) else np.zeros(0, np.int64)
        bits = np.unpackbits(masks[kind[part]].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little") if len(part) else np.zeros((0, 64), np.uint8)
        row, window = np.nonzero(bits)
        begin = s.first[part[row]] + window
        return seq, cover(len(seq.values), np.concatenate([low, begin]), np.concatenate([high, begin + self.length]))

    def run(self, docs: DataFrame, finish: Callable[[pa.Table, Sequences, np.ndarray], pa.Table], schema: str, piece_bytes: float) -> DataFrame:
        """`finish` over every unit, its sequences and the mask of repeated values."""
        units = Units(docs, piece_bytes)
        units.ask(self.ask_anchors, ["V5"], self.answer_anchors)
        units.ask(self.ask_kinds, [np.uint32, np.uint64, np.int64], self.answer_kinds)
        units.ask(self.ask_windows, [np.uint32, np.int64, np.uint16, np.uint16], self.answer_windows)
        return units.run(lambda d, r: finish(d, *self.covered(d, r)), schema)
