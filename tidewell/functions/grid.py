"""Every query of a group against every row of it, in cells of a bounded size.

A group with `nq` queries and `nr` rows is cut into ceil(nq / cell_queries) parts of queries
and ceil(nr / cell_rows) parts of rows; a cell is one part of each. Both sides are dealt by
a hash, so a group that holds a third of all rows is many cells of even size. A task reads
its cells as a sorted stream, the queries of a cell first, so it holds the queries of one
cell and one batch of rows, never a group. Neither side is broadcast or passes the driver.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Protocol

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewell.session import materialise

CELL_QUERIES = 8192
CELL_ROWS = 262_144
#: Small inputs are cut finer than that, down to this many rows, until every core has a cell.
LEAST_ROWS = 2048


class Cell(Protocol):
    """Work on one cell: `feed` per batch of rows, `finish` once."""

    def feed(self, batch: pa.RecordBatch) -> None: ...

    def finish(self) -> Iterator[pa.RecordBatch]: ...


def per_cell(
    queries: DataFrame,
    rows: DataFrame,
    groups: list[str],
    query_hash: Column,
    row_hash: Column,
    start: Callable[[pa.Table], Cell],
    schema: T.StructType | str,
    cell_queries: int = CELL_QUERIES,
    cell_rows: int = CELL_ROWS,
) -> DataFrame:
    """What `start(queries of a cell)` makes of the rows of each cell.

    Both sides hold the `groups` columns; a row whose group has a null column meets nobody.
    Other columns pass through; columns of one name must have one type. `query_hash` and
    `row_hash` deal the sides into parts and should differ between rows.
    """
    spark = queries.sparkSession
    plan, cells = _plan(queries, rows, groups, cell_queries, cell_rows)
    if cells == 0:
        return spark.createDataFrame([], schema)
    columns = list(dict.fromkeys([*queries.columns, *rows.columns]))

    def dealt(df: DataFrame, hashed: Column, own: str, other: str, kind: int) -> DataFrame:
        df = df.withColumn("_at", hashed)
        joined = df.join(plan, groups) if groups else df.withColumns(plan)
        mine = F.pmod("_at", F.col(own)).cast("int")
        out = joined.withColumn("_other", F.explode(F.sequence(F.lit(0), F.col(other).cast("int") - 1)))
        parts = (mine, F.col("_other")) if kind == 0 else (F.col("_other"), mine)
        name = F.concat_ws("/", *[p.cast("string") for p in parts], F.col("_group").cast("string"))
        return out.select(*[c for c in columns if c in df.columns], F.lit(kind).alias("_kind"), name.alias("_cell"))

    both = dealt(queries, query_hash, "_qp", "_rp", 0).unionByName(
        dealt(rows, row_hash, "_rp", "_qp", 1), allowMissingColumns=True
    )
    # Several cells to a partition, so that unlike cells even out; never fewer than cores.
    parts = int(min(cells, max(4 * spark.sparkContext.defaultParallelism, -(-cells // 4))))
    laid = both.repartition(parts, "_cell").sortWithinPartitions("_cell", "_kind")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, asked, cell = None, [], None
        for batch in batches:
            for part, kind, label in _runs(batch):
                if label != name:
                    if cell is not None:
                        yield from cell.finish()
                    name, asked, cell = label, [], None
                if kind == 0:
                    asked.append(part)
                    continue
                if cell is None and asked:
                    cell, asked = start(pa.Table.from_batches(asked)), []
                if cell is not None:
                    cell.feed(part)
        if cell is not None:
            yield from cell.finish()

    return laid.mapInArrow(run, schema)


def _plan(
    queries: DataFrame, rows: DataFrame, groups: list[str], cell_queries: int, cell_rows: int
) -> tuple[DataFrame | dict[str, Column], int]:
    """Parts of queries and rows per group that has both, and the number of cells.

    Without groups the plan is constants.
    """
    cores = queries.sparkSession.sparkContext.defaultParallelism
    if not groups:
        nq, nr = queries.count(), rows.count()
        qp, rp = -(-nq // cell_queries), -(-nr // _rows_of(nr, cell_rows, cores))
        return {"_qp": F.lit(qp), "_rp": F.lit(rp), "_group": F.lit("")}, qp * rp
    asked = queries.groupBy(*groups).agg(F.count("*").alias("_nq"))
    there = rows.groupBy(*groups).agg(F.count("*").alias("_nr"))
    both = materialise(asked.join(there, groups))
    total = both.agg(F.sum("_nr")).first()[0] or 0
    plan = both.select(
        *groups,
        F.ceil(F.col("_nq") / cell_queries).cast("long").alias("_qp"),
        F.ceil(F.col("_nr") / _rows_of(total, cell_rows, cores)).cast("long").alias("_rp"),
        F.to_json(F.struct(*groups)).alias("_group"),
    )
    return plan, plan.agg(F.sum(F.col("_qp") * F.col("_rp"))).first()[0] or 0


def _rows_of(total: int, cell_rows: int, cores: int) -> int:
    return min(cell_rows, max(LEAST_ROWS, -(-total // (2 * cores))))


def _runs(batch: pa.RecordBatch) -> Iterator[tuple[pa.RecordBatch, int, str]]:
    """Slices of one cell and one side, with the side and the cell's name."""
    n = batch.num_rows
    if n == 0:
        return
    codes = batch.column("_cell").dictionary_encode()
    at, kind = codes.indices.to_numpy(zero_copy_only=False), batch.column("_kind").to_numpy(zero_copy_only=False)
    ends = np.flatnonzero(np.append((at[1:] != at[:-1]) | (kind[1:] != kind[:-1]), True)) + 1
    low = 0
    for high in ends.tolist():
        yield batch.slice(low, high - low), int(kind[low]), codes.dictionary[int(at[low])].as_py()
        low = high


class Best:
    """The `k` least values of each of `n` queries with their tie columns, kept up by blocks.

    Values equal to `none` do not count. Ties are broken by the tie columns in order.
    """

    def __init__(self, n: int, k: int, none: float | int, dtype: type):
        self.k, self.none = k, none
        self.limit = np.full(n, none, dtype)
        self._kept: list[tuple[np.ndarray, ...]] = []
        self._pending = self._size = 0

    def add(self, who: np.ndarray, values: np.ndarray, ties: list[np.ndarray]) -> None:
        """values: one row per query of `who`, one column per entry of the tie columns."""
        limit = self.limit[who]
        # A value equal to the limit may still win by its tie columns.
        passes = (values <= limit[:, None]) & (values < self.none)
        if values.shape[1] > self.k and np.count_nonzero(passes) > 2 * self.k * len(who):
            least = np.partition(values, self.k - 1, axis=1)[:, self.k - 1]
            self.limit[who] = limit = np.fmin(limit, least)
            passes &= values <= limit[:, None]
        r, c = np.nonzero(passes)
        if len(r):
            self._kept.append((who[r], values[r, c], *[t[c] for t in ties]))
            self._pending += len(r)
        if self._pending > max(self._size, 1 << 16):
            self.rows()

    def rows(self) -> tuple[np.ndarray, ...] | None:
        """(query, value, tie columns) of what is kept, in order; None when there is nothing."""
        if not self._kept:
            return None
        columns = [np.concatenate(parts) for parts in zip(*self._kept)]
        order = np.lexsort(columns[::-1])
        columns = [c[order] for c in columns]
        who = columns[0]
        new = np.append(True, who[1:] != who[:-1])
        first = np.flatnonzero(new)
        place = np.arange(len(who)) - np.repeat(first, np.diff(np.append(first, len(who))))
        last = place == self.k - 1
        self.limit[who[last]] = columns[1][last]
        self._kept = [tuple(c[place < self.k] for c in columns)]
        self._pending, self._size = 0, len(self._kept[0][0])
        return self._kept[0]

