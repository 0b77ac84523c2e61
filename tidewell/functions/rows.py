"""Arrays to rows, and values bound once inside an expression."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def explode_rows(
    df: DataFrame, keep: list[str | Column], array: Column, value: str, pos: str = "pos"
) -> DataFrame:
    """One row per element with its position; rows with an empty array vanish.

    The outer form keeps the optimiser from adding a `size(array) > 0` filter below,
    which would compute a costly array a second time.
    """
    rows = df.select(*keep, F.posexplode_outer(array).alias(pos, value))
    return rows.where(F.col(pos).isNotNull())


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """`body(value)` with the value computed once however often the body uses it."""
    return F.get(F.transform(F.array(value), body), 0)
