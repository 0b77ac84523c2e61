"""Line dedup: fuzzy lines by MinHash, one line kept per component.

A line is what stands between newlines; lines without a word take no part and are always
kept. Lines with the same text form one class. Of the distinct lines, sets of eight-character
shingles are signed by one-permutation MinHash, and lines that agree on all rows of a band
are candidates; pairs at a Jaccard similarity of 0.8 or more, computed exactly, are linked.
Union-find joins the links, and each component keeps its first line by (doc_id, line).

Ten bands of four rows find a pair at 0.8 with probability 0.995, at 0.9 with 0.9999.
Buckets with the same members are compared once; a bucket of more than GROUP lines is cut
into parts of GROUP / 2 by hash, and every two parts meet in a cell of their own, so that all
its pairs are compared. A cell gives a spanning forest of its links.

Edge cases. Null text: no lines. Lines shorter than a shingle are one shingle. Repeated rows
and ids: lines of rows that share an id count as lines of one document, equal ones in the
same place are all kept. A null doc_id comes first in order. An empty table gives an empty
result. Columns named like the added ones do not disturb; other columns pass through.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewell.llm.components import components, roots
from tidewell.llm.exchange import Ask, Replies, Units
from tidewell.llm.textkit import IS_SPACE, Rolling, blocks, flat, mix, runs
from tidewell.session import materialise

SHINGLE, BANDS, ROWS, SIMILARITY, GROUP = 8, 10, 4, 0.8, 512
_BINS = BANDS * ROWS
_NONE = np.uint32(0xFFFFFFFF)
_CELLS = 1 << 22
#: Bytes of a block of texts; its arrays of eight bytes a character stay in a core's cache.
_BLOCK = 1 << 17


def code_points(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Code points of texts laid end to end, and their offsets."""
    data, offsets = flat(column)
    inner = np.flatnonzero((data & 0xC0) == 0x80)
    if not len(inner):
        return data.astype(np.uint32), offsets
    points = np.frombuffer(data.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)
    return points, offsets - np.searchsorted(inner, offsets)


def shingle_hashes(rolling: Rolling, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all shingles of the given stretches, and the stretch of each, in order.

    A stretch shorter than a shingle is one shingle.
    """
    grams = rolling.grams(SHINGLE)
    mark = np.zeros(len(grams) + 1, np.int32)
    long = np.flatnonzero(ends - starts >= SHINGLE)
    np.add.at(mark, starts[long], 1)
    np.add.at(mark, ends[long] - SHINGLE + 1, -1)
    inside = np.cumsum(mark[:-1]) > 0
    line = np.repeat(long, (ends - starts)[long] - SHINGLE + 1)
    short = np.flatnonzero(ends - starts < SHINGLE)
    if not len(short):
        return grams[inside], line
    hashes, line = np.concatenate([grams[inside], rolling.span(starts[short], ends[short])]), np.concatenate([line, short])
    order = np.argsort(line, kind="stable")
    return hashes[order], line[order]


class Lines:
    """Lines with a word in a block of texts: row, number in the row, key, code points."""

    def __init__(self, column: pa.Array):
        self.points, offsets = code_points(column)
        starts, ends = runs(self.points != 0x0A, offsets)
        row = np.searchsorted(offsets, starts, "right") - 1
        newlines = np.flatnonzero(self.points == 0x0A)
        number = np.searchsorted(newlines, starts) - np.searchsorted(newlines, offsets[row])
        letter = ~IS_SPACE[np.minimum(self.points, 0x7F)]
        # From one start to the next stand the line and newlines, which are no letters.
        full = np.logical_or.reduceat(letter, starts) if len(starts) else np.zeros(0, bool)
        self.row, self.number, self.starts, self.ends = row[full], number[full], starts[full], ends[full]
        self.rolling = Rolling(self.points, 0)
        self.key = self.rolling.span(self.starts, self.ends)

    def keys(self) -> pa.Array:
        check = Rolling(self.points, 1).span(self.starts, self.ends)
        both = np.stack([self.key.byteswap(), check.byteswap()], 1).tobytes()
        return pa.FixedSizeBinaryArray.from_buffers(pa.binary(16), len(self.key), [None, pa.py_buffer(both)]).cast(pa.binary())

    def bands(self, of: np.ndarray | None = None) -> np.ndarray:
        """Band hashes, one row of BANDS per line of `of` (all, if not given)."""
        of = np.arange(len(self.key)) if of is None else of
        n = len(of)
        hashes, line = shingle_hashes(self.rolling, self.starts[of], self.ends[of])
        bin_ = ((hashes >> np.uint64(32)) * np.uint64(_BINS)) >> np.uint64(32)
        value = hashes.astype(np.uint32) & np.uint32(0xFFFFFFFE)
        least = np.full(n * _BINS, _NONE, np.uint32)
        np.minimum.at(least, line * _BINS + bin_.view(np.int64), value)
        least = least.reshape(n, _BINS)
        # An empty bin borrows from the next full one, marked with the distance; bins go round.
        empty, place = least == _NONE, np.arange(_BINS, dtype=np.int8)
        own = np.where(empty, np.int8(2 * _BINS), place)
        again = np.where(empty, np.int8(2 * _BINS), place + np.int8(_BINS))
        nearest = np.minimum.accumulate(np.concatenate([own, again], 1)[:, ::-1], 1)[:, ::-1][:, :_BINS]
        who, bin_ = np.nonzero(empty)
        source = nearest[who, bin_].astype(np.int64)
        sign = least.astype(np.uint64)
        sign[who, bin_] = mix(least[who, source % _BINS].astype(np.uint64) + ((source - bin_) << 33).view(np.uint64))
        out = np.zeros((n, BANDS), np.uint64)
        for b in range(BANDS):
            part = np.full(n, b + 1, np.uint64)
            for r in range(ROWS):
                part = mix(part * np.uint64(0x9E3779B97F4A7C15) + sign[:, b * ROWS + r])
            out[:, b] = part
        return out


def occurrences(docs: DataFrame) -> DataFrame:
    """doc_id, line, key of every line with a word."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches, "text", _BLOCK):
            found = Lines(block.column("text"))
            yield pa.record_batch(
                [block.column("doc_id").take(pa.array(found.row)), pa.array(found.number.astype(np.int32)), found.keys()],
                names=["doc_id", "line", "key"],
            )

    columns = [F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")]
    return docs.select(*columns).mapInArrow(work, "doc_id long, line int, key binary")


def _blocks(docs: pa.Table) -> Iterator[pa.Array]:
    for block in blocks(docs.combine_chunks().to_batches(), "text", _BLOCK):
        yield block.column("text")


class Signed(NamedTuple):
    """Band hashes of a unit's distinct lines, sorted, with the line of each; lines are numbered
    by first sight, and have a key and a stretch of the code points of a block."""

    bands: np.ndarray
    line: np.ndarray
    key: np.ndarray
    block: np.ndarray
    starts: np.ndarray
    ends: np.ndarray


def _signed(docs: pa.Table) -> Signed:
    seen: set[int] = set()
    bands, none = [np.zeros((0, BANDS), np.uint64)], np.zeros(0, np.int64)
    places = [(none.view(np.uint64), none, none, none)]
    for block, column in enumerate(_blocks(docs)):
        found = Lines(column)
        _, first = np.unique(found.key, return_index=True)
        new = np.array([i for i in np.sort(first).tolist() if int(found.key[i]) not in seen], np.int64)
        seen.update(found.key[new].tolist())
        bands.append(found.bands(new))
        places.append((found.key[new], np.full(len(new), block), found.starts[new], found.ends[new]))
    bands = np.concatenate(bands)
    line = np.repeat(np.arange(len(bands)), BANDS)
    order = np.argsort(bands.ravel(), kind="stable")
    return Signed(bands.ravel()[order], line[order], *(np.concatenate(p) for p in zip(*places, strict=True)))


def _texts(docs: pa.Table, signed: Signed, wanted: np.ndarray) -> tuple[list[bytes], list[str]]:
    """Keys and texts of the wanted lines; only blocks that hold one are looked at again."""
    keys, texts = [], []
    edges = np.searchsorted(signed.block[wanted], np.arange(int(signed.block[wanted[-1]]) + 2 if len(wanted) else 1))
    for block, column in enumerate(_blocks(docs)):
        if block + 1 >= len(edges):
            break
        own = wanted[edges[block] : edges[block + 1]]
        if not len(own):
            continue
        points, _ = code_points(column)
        lines = [points[i:j] for i, j in zip(signed.starts[own].tolist(), signed.ends[own].tolist(), strict=True)]
        ends = np.cumsum([len(p) for p in lines])
        check = Rolling(np.concatenate(lines), 1).span(np.append(0, ends[:-1]), ends)
        keys += [k.to_bytes(8, "big") + c.to_bytes(8, "big") for k, c in zip(signed.key[own].tolist(), check.tolist(), strict=True)]
        texts += [p.tobytes().decode("utf-32-le") for p in lines]
    return keys, texts


def _ask(docs: pa.Table, replies: Replies) -> Ask:
    signed = _signed(docs)
    low = np.ascontiguousarray(signed.bands).view(np.uint8).reshape(-1, 8)[:, :5].copy().view("V5").ravel()
    return Ask(signed.bands, [low, signed.key.astype(np.uint32)[signed.line]])


def _answer(parts: list[Ask]) -> list[np.ndarray]:
    """Which band hashes belong to more than one line of the corpus."""
    sizes = [len(p.columns[0]) for p in parts]
    wide = np.zeros((sum(sizes), 8), np.uint8)
    wide[:, :5] = np.concatenate([p.columns[0].view(np.uint8).reshape(-1, 5) for p in parts])
    band, line = wide.view(np.uint64).ravel(), np.concatenate([p.columns[1] for p in parts])
    order = np.argsort(band, kind="stable")
    band, line = band[order], line[order]
    starts = np.flatnonzero(np.concatenate([[True], band[1:] != band[:-1]]))
    many = np.minimum.reduceat(line, starts) != np.maximum.reduceat(line, starts)
    said = np.empty(len(order), np.uint8)
    said[order] = np.repeat(many, np.diff(np.append(starts, len(order))))
    return np.split(said, np.cumsum(sizes)[:-1])


def candidates(docs: DataFrame) -> DataFrame:
    """key, text and shared band hashes of the distinct lines that share one."""
    units = Units(docs, 0.4)
    units.ask(_ask, ["V5", np.uint32], _answer)

    def work(docs: pa.Table, replies: Replies) -> pa.Table:
        signed = _signed(docs)
        yes = np.flatnonzero(replies[0]) if 0 in replies else np.zeros(0, np.int64)
        order = yes[np.argsort(signed.line[yes], kind="stable")]
        wanted, first = np.unique(signed.line[order], return_index=True)
        shared = np.split(signed.bands[order].view(np.int64), first[1:]) if len(wanted) else []
        keys, texts = _texts(docs, signed, wanted)
        return pa.table({"key": pa.array(keys, pa.binary()), "text": pa.array(texts, pa.string()), "bands": pa.array([s.tolist() for s in shared], pa.list_(pa.int64()))})

    return units.run(work, "key binary, text string, bands array<long>")


def similar_pairs(texts: pa.Array, group: np.ndarray, similarity: float = SIMILARITY) -> tuple[np.ndarray, np.ndarray]:
    """Rows (a, b) that link the similar texts of each group; `group` is ascending.

    Groups of two are compared all at once. In a larger one, of bounded size, the shared
    shingles of all pairs are counted by a product of its 0/1 matrix with itself.
    """
    points, cuts = code_points(texts)
    hashes, row = shingle_hashes(Rolling(points), cuts[:-1], cuts[1:])
    first = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
    size = np.diff(np.append(first, len(group)))
    order = np.repeat(np.arange(len(first)), size)

    two = size[order[row]] == 2
    h, r = hashes[two], row[two]
    g = order[r]
    key = mix(h + g.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    by = np.argsort(key)
    key, side, g = key[by], (r - first[g])[by], g[by]
    runs_ = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
    a, b = [], []
    if len(runs_):
        low, high = np.minimum.reduceat(side, runs_), np.maximum.reduceat(side, runs_)
        both = np.bincount(g[runs_], low != high, len(first))
        every = np.bincount(g[runs_], minlength=len(first))
        close = np.flatnonzero((size == 2) & (both >= similarity * every))
        a, b = [first[close] + 1], [first[close]]

    ends = np.searchsorted(row, np.append(first, len(group)))
    for i in np.flatnonzero(size > 2).tolist():
        n, part = int(size[i]), slice(ends[i], ends[i + 1])
        kinds, column = np.unique(hashes[part], return_inverse=True)
        cell = np.unique((row[part] - first[i]) * len(kinds) + column)
        who, column = cell // len(kinds), cell % len(kinds)
        sizes = np.bincount(who, minlength=n)
        common = np.bincount(column, minlength=len(kinds)) > 1
        who, column = who[common[column]], (np.cumsum(common) - 1)[column[common[column]]]
        shared, wide = np.zeros((n, n), np.float32), max(1, _CELLS // n)
        for low in range(0, int(common.sum()), wide):
            here = (column >= low) & (column < low + wide)
            matrix = np.zeros((n, min(wide, int(common.sum()) - low)), np.float32)
            matrix[who[here], column[here] - low] = 1
            shared += matrix @ matrix.T
        x, y = np.nonzero(np.tril(shared >= similarity * (sizes[:, None] + sizes[None, :] - shared), -1))
        root = roots(n, x, y)
        tied = np.flatnonzero(root != np.arange(n))
        a.append(first[i] + tied)
        b.append(first[i] + root[tied])
    return (np.concatenate(a), np.concatenate(b)) if a else (np.zeros(0, np.int64), np.zeros(0, np.int64))


def links(lines: DataFrame, group: int | None = None) -> DataFrame:
    """(a, b) over keys: a spanning forest of the similar lines of every bucket; buckets of
    more than `group` (GROUP) lines are cut."""
    group = GROUP if group is None else group
    rows = lines.select("key", F.explode("bands").alias("band"))
    mark = F.xxhash64("key")
    buckets = rows.groupBy("band").agg(F.count("*").alias("n"), F.bit_xor(mark).alias("members"), F.min("key").alias("lead")).where("n > 1")
    once = buckets.groupBy("n", "members", "lead").agg(F.min("band").alias("band"))
    # A line goes to the cells of its part with every other part; of one part is one cell.
    parts = F.when(F.col("n") > group, F.ceil(F.col("n") * 2 / group)).otherwise(F.lit(1)).cast("long")
    own = rows.join(once, "band").select("band", "key", parts.alias("parts"), F.pmod(mark, parts).alias("own"))
    others = own.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("other"))
    cell = F.least("own", "other") * F.col("parts") + F.greatest("own", "other")
    placed = others.where("parts = 1 OR own <> other").select("band", "key", cell.alias("part"))

    def compare(rows: pa.Table) -> pa.RecordBatch:
        band, part = rows.column("band").to_numpy(), rows.column("part").to_numpy()
        new = np.concatenate([[True], (band[1:] != band[:-1]) | (part[1:] != part[:-1])])
        a, b = similar_pairs(rows.column("text").combine_chunks(), np.cumsum(new))
        keys = rows.column("key").combine_chunks()
        return pa.record_batch([keys.take(pa.array(a)), keys.take(pa.array(b))], names=["a", "b"])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            for block in blocks([batch], "text"):
                rows = pa.Table.from_batches([block])
                rows = rows if held is None else pa.concat_tables([held, rows])
                band, part = rows.column("band").to_numpy(), rows.column("part").to_numpy()
                # The last group may go on in the next block.
                end = int(np.flatnonzero((band == band[-1]) & (part == part[-1]))[0])
                held = rows.slice(end)
                if end:
                    yield compare(rows.slice(0, end))
        if held is not None:
            yield compare(held)

    together = placed.join(lines.select("key", "text"), "key").repartition("band", "part").sortWithinPartitions("band", "part", "key")
    return together.select("band", "part", "key", "text").mapInArrow(work, "a binary, b binary")


def classes(docs: DataFrame) -> DataFrame:
    """doc_id, line, class_doc, class_line of every line with a word; the class is its first line."""
    every = materialise(occurrences(docs))
    first = F.min(F.struct("doc_id", "line")).alias("first")
    exact = every.groupBy("key").agg(first, F.count("*").alias("n"))
    similar_lines = materialise(candidates(docs).groupBy("key").agg(F.first("text").alias("text"), F.first("bands").alias("bands")))
    joined = components(links(similar_lines)).withColumnRenamed("id", "key")
    exact = exact.join(joined, "key", "left").select("key", "first", "n", F.coalesce("component", "key").alias("component"))
    exact = materialise(exact)
    whole = exact.groupBy("component").agg(F.min("first").alias("class"), F.sum("n").alias("_n")).where("_n > 1")
    repeated = exact.join(whole, "component").select("key", "class")
    own = F.struct("doc_id", "line")
    got = every.join(repeated, "key", "left").withColumn("class", F.coalesce("class", own))
    return got.select("doc_id", "line", F.col("class.doc_id").alias("class_doc"), F.col("class.line").alias("class_line"))


def removed(docs: DataFrame) -> DataFrame:
    """doc_id and the numbers of its lines that go, of documents that lose any."""
    gone = classes(docs).where(~(F.col("doc_id").eqNullSafe(F.col("class_doc")) & (F.col("line") == F.col("class_line"))))
    return gone.groupBy("doc_id").agg(F.collect_set("line").alias("_gone"))


def keep_first(docs: DataFrame) -> DataFrame:
    """`docs` with the removed lines taken out of `text`; columns stay as they are."""
    gone = removed(docs).withColumnRenamed("doc_id", "_id")
    rows = docs.select(F.struct("*").alias("_row"))  # keeps names apart
    kept = F.filter(F.split(F.col("_row.text").cast("string"), "\n", -1), lambda x, i: ~F.array_contains("_gone", i))
    text = F.when(F.col("_gone").isNull(), F.col("_row.text")).otherwise(F.array_join(kept, "\n"))
    joined = rows.join(gone, F.col("_row.doc_id").cast("long").eqNullSafe(F.col("_id")), "left")
    return joined.select(*[text.alias(c) if c == "text" else F.col("_row")[c].alias(c) for c in docs.columns])
