"""Questions between units of whole documents, in packed rows.

A unit is a few megabytes of documents that share a hash of their ids. Operators that look
for equal pieces all over a corpus would shuffle one row per piece. Here a unit packs the
hashes of its distinct pieces into one row per bucket of the hash space; each bucket, a
bounded share of all hashes, answers every unit in the order it asked, usually with one bit
per piece. A frequent piece counts once per unit, so it weighs no more than any other.

Documents are shuffled by unit once: every step reads the same exchange, which Spark reuses
inside the one query that the steps form. All steps are functions of a unit's documents in
the order of their ids, so a task that is run again asks and reads alike.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewell.session import prepare

#: A unit has between these bytes of text, growing with the root of the corpus.
UNIT_BYTES = (4 << 20, 128 << 20)
#: Bytes of packed pieces in one bucket.
BUCKET_BYTES = 6 << 20

SENT = "bucket int, unit long, body binary, lengths binary"
REPLY = "unit long, step int, bucket int, body binary"


class Ask(NamedTuple):
    """Pieces of one unit in ascending order of their hash: numpy columns of fixed width."""

    hashes: np.ndarray
    columns: list[np.ndarray]
    blob: np.ndarray | None = None  # bytes, cut by `cuts`
    cuts: np.ndarray | None = None  # n + 1 offsets


Documents = pa.Table
Replies = dict[int, np.ndarray]


def _frame(table: pa.Table) -> pa.Table:
    order = [("doc_id", "ascending"), ("text", "ascending")]
    return table.sort_by(order)


def _replies(table: pa.Table) -> Replies:
    out: Replies = {}
    for step in np.unique(table.column("step").to_numpy()).tolist():
        own = table.filter(pc.equal(table.column("step"), step)).sort_by("bucket")
        out[step] = np.concatenate([np.frombuffer(b, np.uint8) for b in own.column("body").to_pylist()])
    return out


class Units:
    """Documents in units, and the replies to what they have asked so far."""

    def __init__(self, docs: DataFrame, piece_bytes: float):
        """`piece_bytes`: bytes a step sends per byte of text, at most."""
        prepare(docs.sparkSession)
        docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
        total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
        size = min(max(128 * int(total**0.5), UNIT_BYTES[0]), UNIT_BYTES[1])
        self.units = max(1, -(-total // size))
        self.bits = max(0, int(np.ceil(np.log2(max(1.0, total * piece_bytes / BUCKET_BYTES)))))
        unit = F.pmod(F.xxhash64("doc_id"), F.lit(self.units)).alias("unit")
        self.docs = docs.select("doc_id", "text", unit)
        self.replies: DataFrame | None = None
        self.steps = 0

    def run(self, work: Callable[[Documents, Replies], pa.Table], schema: str) -> DataFrame:
        """`work` over every unit with all replies it has had."""
        grouped = self.docs.groupBy("unit")

        def alone(docs: pa.Table) -> pa.Table:
            pa.default_memory_pool().release_unused()  # two workers share an executor's memory
            return work(_frame(docs), {})

        def both(docs: pa.Table, replies: pa.Table) -> pa.Table:
            pa.default_memory_pool().release_unused()
            return work(_frame(docs), _replies(replies) if replies.num_rows else {})

        if self.replies is None:
            return grouped.applyInArrow(alone, schema)

        return grouped.cogroup(self.replies.groupBy("unit")).applyInArrow(both, schema)

    def ask(self, emit: Callable[[Documents, Replies], Ask], dtypes: list, answer: Callable[[list[Ask]], Iterable[np.ndarray]]) -> None:
        """Send what `emit` makes of each unit; keep what `answer` says to each of them."""
        shift, step = np.uint64(64 - self.bits), self.steps
        wide = [np.dtype(d) for d in dtypes]
        bits = self.bits

        def send(docs: pa.Table, replies: Replies) -> pa.Table:
            asked = emit(docs, replies)
            bucket = (asked.hashes >> shift).astype(np.int64) if bits else np.zeros(len(asked.hashes), np.int64)
            edges = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]])) if len(bucket) else np.zeros(0, int)
            unit = docs.column("unit")[0].as_py()
            rows = []
            for i, j in zip(edges.tolist(), [*edges[1:].tolist(), len(bucket)], strict=False):
                body = b"".join(np.ascontiguousarray(c[i:j], d).tobytes() for c, d in zip(asked.columns, wide, strict=True))
                lengths = None
                if asked.blob is not None:
                    body += asked.blob[asked.cuts[i] : asked.cuts[j]].tobytes()
                    lengths = np.diff(asked.cuts[i : j + 1]).astype(np.int32).tobytes()
                rows.append({"bucket": int(bucket[i]), "unit": unit, "body": body, "lengths": lengths})
            return pa.Table.from_pylist(rows, schema=pa.schema({"bucket": pa.int32(), "unit": pa.int64(), "body": pa.binary(), "lengths": pa.binary()}))

        def read(body: bytes, lengths: bytes | None) -> Ask:
            width = sum(d.itemsize for d in wide)
            cuts = None
            if lengths is not None:
                sizes = np.frombuffer(lengths, np.int32)
                cuts, n = np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)]), len(sizes)
            else:
                n = len(body) // width
            columns, at = [], 0
            for d in wide:
                columns.append(np.frombuffer(body, d, n, at))
                at += n * d.itemsize
            return Ask(np.zeros(0, np.uint64), columns, np.frombuffer(body, np.uint8, offset=at) if cuts is not None else None, cuts)

        def reply(table: pa.Table) -> pa.Table:
            table = table.sort_by("unit")
            parts = [read(b, s) for b, s in zip(table.column("body").to_pylist(), table.column("lengths").to_pylist(), strict=True)]
            said = [np.ascontiguousarray(x).tobytes() for x in answer(parts)]
            n = len(said)
            return pa.table({"unit": table.column("unit"), "step": pa.array([step] * n, pa.int32()), "bucket": table.column("bucket"), "body": pa.array(said, pa.binary())})

        sent = self.run(send, SENT)
        back = sent.groupBy("bucket").applyInArrow(reply, REPLY)
        self.replies = back if self.replies is None else self.replies.unionByName(back)
        self.steps += 1
