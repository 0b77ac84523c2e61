"""Hard negatives by exact integer scores, looked up in tables of subset sums.

Components become floor(256 * x). A vector is kept as its bit planes in two's complement,
eight dimensions to a byte. For a block of anchors and every group of eight dimensions a
table holds the sums of all 256 subsets of the anchors' components (the Four-Russians
trick); a row's product with an anchor is then, plane by plane from the highest, twice what
is so far plus the table entries its bytes name. No component is multiplied and every score
is the full exact integer.

Anchors meet all rows in cells (`functions.grid`), twice: once for the best rows of the same
label, once, with those scores known, for the best rows of other labels in the window each
of them opens. A task gives the few best of its cell per anchor.

Edge cases. Rows with a null label, a null vector or a null or non-finite component take no
part. Shorter vectors count as filled up with zeros; an empty one scores 0. Rows with a null
id are never anchors and rank behind known ids. Equal rows are different rows: one is not its
own positive, but a copy of it is. An anchor without a row of its label, or a positive
without a row in its window, gives no row. Other columns are ignored. Should products pass
64 bits (components in the millions of millions), ValueError is raised before any work.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewell.functions import grid, ordered
from tidewell.session import materialise

SCALE = 256
N_POSITIVES, N_NEGATIVES = 5, 3
#: The window of a negative's score, in hundredths of the positive's.
LOW, HIGH = 50, 95
#: Anchors per table and rows per lookup: both stay in the cache of a core.
ANCHORS, ROWS = 64, 2048
CELL_ANCHORS = 4096


def subset_sums(anchors: np.ndarray, dtype: type = np.int64) -> np.ndarray:
    """(groups, 256, anchors): sums of the components each byte selects."""
    n, width = anchors.shape
    by_group = anchors.T.reshape(width // 8, 8, n).astype(dtype)
    table = np.zeros((width // 8, 256, n), dtype)
    for bit in range(8):
        half = 1 << bit
        table[:, half : 2 * half] = table[:, :half] + by_group[:, bit : bit + 1]
    return table


def pack(values: np.ndarray, planes: int) -> np.ndarray:
    """(rows, planes, groups) bytes: bit `p` of every component, eight to a byte."""
    bits = (values[:, None, :] >> np.arange(planes)[None, :, None]) & 1
    return np.packbits(bits.astype(np.uint8), axis=2, bitorder="little")


def unpack(packed: np.ndarray) -> np.ndarray:
    """Components from their planes; the highest plane is the sign."""
    bits = np.unpackbits(packed, axis=2, bitorder="little").astype(np.int64)
    weight = np.left_shift(np.int64(1), np.arange(packed.shape[1], dtype=np.int64))
    weight[-1] = -weight[-1]
    return np.einsum("rpd,p->rd", bits, weight)


def products(table: np.ndarray, packed: np.ndarray) -> np.ndarray:
    """(rows, anchors) exact inner products by shifts, lookups and sums."""
    rows, planes, groups = packed.shape
    total = np.zeros((rows, table.shape[2]), table.dtype)
    found = np.empty_like(total)
    for plane in range(planes - 1, -1, -1):
        np.add(total, total, out=total)
        for g in range(groups):
            np.take(table[g], packed[:, plane, g], axis=0, out=found, mode="clip")
            if plane == planes - 1:
                total -= found
            else:
                total += found
    return total


def _packed(column: pa.Array, planes: int) -> np.ndarray:
    rows = len(column)
    flat = np.frombuffer(b"".join(column.to_pylist()), np.uint8)
    return flat.reshape(rows, planes, -1)


def usable(rows: DataFrame) -> DataFrame:
    """vec_id, label, v: rows that take part, with their label as mined and integer components."""
    bad = F.exists("embedding", lambda x: x.isNull() | F.isnan(x.cast("double")) | (F.abs(x.cast("double")) == float("inf")))
    shifted = F.when(F.col("vec_id") % 7 == 0, (F.col("label").cast("long") + 1) % 10).otherwise(F.col("label").cast("long"))
    return rows.where(F.col("label").isNotNull() & F.col("embedding").isNotNull() & ~bad).select(
        F.col("vec_id").cast("long").alias("vec_id"),
        shifted.alias("label"),
        F.transform("embedding", lambda x: F.floor(x.cast("double") * SCALE)).alias("v"),
    )


def planed(rows: DataFrame) -> tuple[DataFrame, int, type]:
    """vec_id, label, planes, uid of every usable row; the number of planes; the table type.

    Equal rows are counted before the shuffle and numbered after it, which tells them apart
    by a `uid` that a rerun repeats.
    """
    v = usable(rows)
    peak = F.aggregate("v", F.lit(0.0), lambda a, x: F.greatest(a, F.abs(x.cast("double"))))
    found = v.agg(F.max(peak).alias("peak"), F.max(F.size("v")).alias("width")).first()
    peak, width = int(found["peak"] or 0) + 1, max(8, -(-(found["width"] or 1) // 8) * 8)
    if peak * peak * width >= 1 << 62:
        raise ValueError("inner products of these vectors do not fit into 64 bits")
    planes = peak.bit_length() + 1
    schema = "vec_id long, label long, planes binary"

    def to_planes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for low in range(0, whole.num_rows, ROWS):
                batch = whole.slice(low, ROWS)
                vectors = batch.column("v")
                sizes = vectors.value_lengths().to_numpy(zero_copy_only=False)
                values = np.zeros((len(sizes), width), np.int64)
                at = np.repeat(np.arange(len(sizes)), sizes)
                first = np.repeat(np.cumsum(sizes) - sizes, sizes)
                values[at, np.arange(len(at)) - first] = vectors.flatten().to_numpy(zero_copy_only=False)
                packed = [row.tobytes() for row in pack(values, planes)]
                yield pa.RecordBatch.from_arrays(
                    [batch.column("vec_id"), batch.column("label"), pa.array(packed, pa.binary())], ["vec_id", "label", "planes"]
                )

    alike = v.mapInArrow(to_planes, schema).groupBy("vec_id", "label", "planes").agg(F.count("*").alias("_n"))
    single = alike.select("vec_id", "label", "planes", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_n"))).alias("_copy"))
    uid = F.xxhash64("vec_id", "label", "planes", "_copy").alias("uid")
    stored = materialise(single.select("vec_id", "label", "planes", uid))
    return stored, planes, np.int32 if peak * peak * width < 1 << 31 else np.int64


class _Scored:
    """One cell: tables of its anchors, scores of each batch of rows given to `take`."""

    def __init__(self, anchors: pa.Table, planes: int, dtype: type):
        self.anchors = anchors.combine_chunks()
        self.uid = self.anchors["uid"].to_numpy()
        self.ids = self.anchors["vec_id"].to_numpy()
        self.label = self.anchors["label"].to_numpy()
        self.planes = planes
        values = unpack(_packed(self.anchors["planes"], planes))
        self.blocks = [
            (np.arange(low, min(low + ANCHORS, len(values))), subset_sums(values[low : low + ANCHORS], dtype))
            for low in range(0, len(values), ANCHORS)
        ]

    def feed(self, batch: pa.RecordBatch) -> None:
        for low in range(0, batch.num_rows, ROWS):
            part = batch.slice(low, ROWS)
            packed = _packed(part.column("planes"), self.planes)
            ids = part.column("vec_id")
            unknown = ids.is_null().to_numpy(zero_copy_only=False)
            ids = ids.fill_null(0).to_numpy(zero_copy_only=False)
            uid, label = (part.column(c).to_numpy(zero_copy_only=False) for c in ("uid", "label"))
            for who, table in self.blocks:
                scores = products(table, packed).T.astype(np.int64)
                self.take(who, scores, label[None, :] == self.label[who][:, None], [unknown, ids, uid])


_NONE = np.iinfo(np.int64).max


class _Positives(_Scored):
    """The best rows of each anchor's label, the anchor itself left out."""

    def __init__(self, anchors: pa.Table, planes: int, dtype: type):
        super().__init__(anchors, planes, dtype)
        self.best = grid.Best(len(self.ids), N_POSITIVES, _NONE, np.int64)

    def take(self, who: np.ndarray, scores: np.ndarray, same: np.ndarray, ties: list[np.ndarray]) -> None:
        unknown, ids, uid = ties
        itself = (uid[None, :] == self.uid[who][:, None]) & (ids[None, :] == self.ids[who][:, None]) & ~unknown[None, :]
        self.best.add(who, np.where(same & ~itself, -scores, _NONE), ties)

    def finish(self) -> Iterator[pa.RecordBatch]:
        found = self.best.rows()
        if found is not None:
            who, value, unknown, ids, uid = found
            columns = [self.uid[who], self.ids[who], pa.array(ids, mask=unknown), uid, -value]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["uid", "anchor_id", "other_id", "other_uid", "score"])


class _Negatives(_Scored):
    """The best rows of other labels in the window of each of an anchor's positives."""

    def __init__(self, anchors: pa.Table, planes: int, dtype: type):
        super().__init__(anchors, planes, dtype)
        scores = self.anchors["scores"].to_pylist()
        self.low, self.high = np.ones((len(scores), N_POSITIVES), np.int64), np.zeros((len(scores), N_POSITIVES), np.int64)
        for i, values in enumerate(scores):
            for p, s in enumerate(values):
                self.low[i, p], self.high[i, p] = -(-LOW * s // 100), HIGH * s // 100
        self.best = grid.Best(self.low.size, N_NEGATIVES, _NONE, np.int64)

    def take(self, who: np.ndarray, scores: np.ndarray, same: np.ndarray, ties: list[np.ndarray]) -> None:
        for p in range(N_POSITIVES):
            low, high = self.low[who, p][:, None], self.high[who, p][:, None]
            inside = ~same & (scores >= low) & (scores <= high)
            self.best.add(who * N_POSITIVES + p, np.where(inside, -scores, _NONE), ties)

    def finish(self) -> Iterator[pa.RecordBatch]:
        found = self.best.rows()
        if found is not None:
            slot, value, unknown, ids, uid = found
            who, place = np.divmod(slot, N_POSITIVES)
            columns = [self.uid[who], self.ids[who], (place + 1).astype(np.int32), pa.array(ids, mask=unknown), uid, -value]
            names = ["uid", "anchor_id", "place", "other_id", "other_uid", "score"]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names)


_FOUND = "uid long, anchor_id long, other_id long, other_uid long, score long"


def mine(rows: DataFrame, anchors: Column, cell_anchors: int = CELL_ANCHORS, cell_rows: int = grid.CELL_ROWS) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    rows: vec_id, label, embedding. `anchors` is a condition on vec_id.
    """
    stored, planes, dtype = planed(rows)
    asked = stored.where(anchors)
    best = [F.expr("-score"), F.col("other_id").asc_nulls_last(), F.col("other_uid")]

    def meet(queries: DataFrame, cell: type, schema: str) -> DataFrame:
        return grid.per_cell(
            queries, stored, [], F.xxhash64("uid"), F.xxhash64("uid"), lambda table: cell(table, planes, dtype),
            schema, cell_anchors, cell_rows,
        )

    near = meet(asked, _Positives, _FOUND)
    positives = materialise(ordered.newest(near, ["uid", "anchor_id"], best, N_POSITIVES, "place"))
    scores = positives.groupBy("uid", F.col("anchor_id").alias("vec_id")).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("place", "score"))), lambda s: s["score"]).alias("scores")
    )
    hard = meet(asked.join(scores, ["uid", "vec_id"]), _Negatives, _FOUND.replace("other_id", "place int, other_id"))
    top = ordered.newest(hard, ["uid", "anchor_id", "place"], best, N_NEGATIVES, "rank")
    named = positives.select("uid", "anchor_id", "place", F.col("other_id").alias("positive_id"), F.col("score").alias("positive_score"))
    return named.join(top, ["uid", "anchor_id", "place"]).select(
        "anchor_id", "positive_id", "rank", F.col("other_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score")
    )
