"""Running totals per key that never gather one key in one task.

The caller names a bucket that grows with the order inside a key (for example
`floor(position / 8192)`). Bucket totals are combined map-side, so only one row
per (key, bucket) is summed along the key; inside a bucket a plain window runs.
"""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidewell.session import materialise

BUCKET_ROWS = 8192


def join_null_safe(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Inner join in which a null key meets a null key; `keys` appear once, from the left."""
    there = right.select([F.col(c).alias(f"_r_{c}") if c in keys else F.col(c) for c in right.columns])
    same = reduce(and_, [F.col(c).eqNullSafe(F.col(f"_r_{c}")) for c in keys])
    return left.join(there, same).drop(*[f"_r_{c}" for c in keys])


def running_sum(
    df: DataFrame, keys: list[str], order: list[str], value: Column, bucket: Column, out: str
) -> DataFrame:
    """Add `out`: sum of `value` over the rows before and up to this one."""
    staged = df.withColumn("_v", value).withColumn("_b", bucket)
    totals = staged.groupBy(*keys, "_b").agg(F.sum("_v").alias("_t"))
    before = W.partitionBy(*keys).orderBy("_b").rowsBetween(W.unboundedPreceding, -1)
    offsets = totals.select(
        *keys, "_b", F.coalesce(F.sum("_t").over(before), F.lit(0)).alias("_o")
    )
    inside = W.partitionBy(*keys, "_b").orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    local = staged.withColumn("_s", F.sum("_v").over(inside))
    return (
        join_null_safe(local, offsets, [*keys, "_b"])
        .withColumn(out, F.col("_s") + F.col("_o"))
        .drop("_v", "_b", "_s", "_o")
    )


def running_max(
    df: DataFrame, keys: list[str], order: list[str], value: Column, bucket: Column, out: str
) -> DataFrame:
    """Add `out`: largest `value` among the rows before and up to this one."""
    staged = df.withColumn("_v", value).withColumn("_b", bucket)
    totals = staged.groupBy(*keys, "_b").agg(F.max("_v").alias("_t"))
    before = W.partitionBy(*keys).orderBy("_b").rowsBetween(W.unboundedPreceding, -1)
    offsets = totals.select(*keys, "_b", F.max("_t").over(before).alias("_o"))
    inside = W.partitionBy(*keys, "_b").orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    local = staged.withColumn("_s", F.max("_v").over(inside))
    return (
        join_null_safe(local, offsets, [*keys, "_b"])
        .withColumn(out, F.greatest("_s", "_o"))
        .drop("_v", "_b", "_s", "_o")
    )


def row_number(
    df: DataFrame, keys: list[str], order: list[str], bucket: Column, out: str
) -> DataFrame:
    """Add `out`: 1, 2, 3, ... in `order` within `keys`."""
    return running_sum(df, keys, order, F.lit(1), bucket, out)


def number_lists(
    df: DataFrame, keys: list[str], order: list[str], bucket: Column, out: str, part: Column | None = None
) -> DataFrame:
    """`row_number` of lists that are mostly short; `df` is written once.

    `part` grows along a list and bounds it: rows of one part are few (`bucket` if not given).
    If all rows have the same part, every list is short and one window numbers it, with
    neither totals of buckets nor a join; else buckets are numbered as by `row_number`.
    """
    stored = materialise(df.withColumn("_part", bucket if part is None else part))
    ends = stored.agg(F.min("_part"), F.max("_part")).first()
    rows = stored.drop("_part")
    if ends[0] != ends[1]:
        return row_number(rows, keys, order, bucket, out)
    return rows.withColumn(out, F.row_number().over(W.partitionBy(*keys).orderBy(*order)).cast("long"))


def newest(df: DataFrame, keys: list[str], order: list[Column], n: int, out: str = "rn") -> DataFrame:
    """First `n` rows per key; the rank filter is cut before the shuffle."""
    return df.withColumn(out, F.row_number().over(W.partitionBy(*keys).orderBy(*order))).where(
        F.col(out) <= n
    )
