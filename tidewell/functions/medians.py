"""Exact medians by sketches and counts; no value is shuffled while many are left.

A mergeable sketch per key names cut values, exact counts between the cuts show where the
wanted rank lies, and the rows there are sketched again. The least and greatest value are
among the cuts, so the rows left shrink in every round whatever the sketch's error is; with
that error (1 / ACCURACY of the rows) a round keeps about one row in CUTS.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewell.functions.ordered import join_null_safe
from tidewell.session import materialise, release

CUTS = 64
ACCURACY = 1000
#: So many rows of a key are put in order; beyond that they are cut again.
FEW = 65_536


def _sketch(rows: DataFrame, names: list[str]) -> DataFrame:
    """names, _n, _cuts: how many rows a key has, and ascending values that part them evenly."""
    value = F.col("_v")
    if isinstance(rows.schema["_v"].dataType, (T.FloatType, T.DoubleType)):
        value = F.when(~F.isnan("_v"), F.col("_v"))
    inner = F.percentile_approx(value, [i / CUTS for i in range(1, CUTS)], ACCURACY)
    ends = F.array(F.min("_v"), F.max("_v"))
    cuts = F.array_distinct(F.array_sort(F.concat(ends, F.coalesce(inner, ends))))
    return rows.groupBy(*names).agg(F.count("*").alias("_n"), cuts.alias("_cuts"))


def _tallies(rows: DataFrame, asked: DataFrame, names: list[str]) -> DataFrame:
    """The slot of each key that holds its rank: on a cut (odd) or between two (even).

    At most 2 * CUTS + 3 rows per key are left after the map-side counts.
    """
    below = F.size(F.filter("_cuts", lambda c: c < F.col("_v")))
    placed = join_null_safe(rows, asked, names).withColumn("_below", below).withColumns(
        {
            "_slot": F.col("_below") * 2 + F.exists("_cuts", lambda c: c == F.col("_v")).cast("int"),
            "_low": F.get("_cuts", F.col("_below") - 1),
            "_high": F.get("_cuts", F.col("_below")),
        }
    )
    slots = placed.groupBy(*names, "_slot").agg(
        F.count("*").alias("_t"), *[F.min(c).alias(c) for c in ("_skip", "_low", "_high")]
    )
    so_far = W.partitionBy(*names).orderBy("_slot").rowsBetween(W.unboundedPreceding, 0)
    before = F.col("_upto") - F.col("_t")
    return (
        slots.withColumn("_upto", F.sum("_t").over(so_far))
        .where((F.col("_upto") > F.col("_skip")) & (before <= F.col("_skip")))
        .select(*names, "_slot", "_low", "_high", (F.col("_skip") - before).alias("_skip"))
    )


def _ordered(rows: DataFrame, asked: DataFrame, names: list[str]) -> DataFrame:
    """The value at rank `_skip` of keys with few rows."""
    few = join_null_safe(rows, asked.where(F.col("_n") <= FEW).select(*names, "_skip"), names)
    place = F.row_number().over(W.partitionBy(*names).orderBy("_v"))
    return few.withColumn("_rn", place).where(F.col("_rn") == F.col("_skip") + 1).select(*names, "_v")


def upper_median(df: DataFrame, value: str, keys: list[str], out: str) -> DataFrame:
    """sorted[n // 2] of the values of each key that are not null.

    NaN is the greatest value; a null key is a key; without keys there is one row, or none if
    there is no value. Runs at once; the result is a table in the checkpoint folder, what was
    written on the way is deleted.
    """
    names = keys or ["_all"]
    head = [F.col(k) for k in keys] or [F.lit(0).alias("_all")]
    rows = materialise(df.where(F.col(value).isNotNull()).select(*head, F.col(value).alias("_v")))
    asked = materialise(_sketch(rows, names).withColumn("_skip", F.floor(F.col("_n") / 2)))
    made, found = [rows, asked], []
    while True:
        found.append(_ordered(rows, asked, names))
        many = asked.where(F.col("_n") > FEW)
        if many.isEmpty():
            break
        chosen = materialise(_tallies(rows, many.select(*names, "_cuts", "_skip"), names))
        found.append(chosen.where("_slot % 2 = 1").select(*names, F.col("_high").alias("_v")))
        gaps = chosen.where("_slot % 2 = 0")
        inside = (F.col("_v") > F.col("_low")) & (F.col("_v") < F.col("_high"))
        rows = materialise(join_null_safe(rows, gaps, names).where(inside).select(*names, "_v"))
        asked = materialise(join_null_safe(_sketch(rows, names), gaps.select(*names, "_skip"), names))
        made += [chosen, rows, asked]
    result = materialise(reduce(DataFrame.unionByName, found).select(*keys, F.col("_v").alias(out)))
    release(*made)
    return result
