from __future__ import annotations

import math
import random
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from tidewell.functions import medians
from tidewell.functions.medians import upper_median


def _check(spark, rows, kind):
    df = spark.createDataFrame(rows, f"k string, v {kind}")
    want = {}
    for k, v in rows:
        if v is not None:
            want.setdefault(k, []).append(v)
    rank = lambda v: (isinstance(v, float) and math.isnan(v), v)
    want = {k: sorted(v, key=rank)[len(v) // 2] for k, v in want.items()}
    got = {r["k"]: r["m"] for r in upper_median(df, "v", ["k"], "m").collect()}
    assert {k: str(v) for k, v in got.items()} == {k: str(v) for k, v in want.items()}


@pytest.mark.parametrize("few", [2, 50])
def test_rounds_equal_a_sort(spark, monkeypatch, few):
    """Keys of all sizes, ties, outliers, nulls, NaN and a null key, through several rounds."""
    monkeypatch.setattr(medians, "FEW", few)
    monkeypatch.setattr(medians, "CUTS", 4)
    rng = random.Random(few)
    odd = [7.0, None, float("nan"), -1e300, 1e300, float("inf")]
    rows = [(k, rng.choice([rng.uniform(-5, 5), rng.choice(odd)])) for k in [*"abcd", None] for _ in range(rng.randint(1, 120))]
    rows += [("nan", float("nan"))] * 9 + [("one", 1.5), ("none", None)]
    _check(spark, rows, "double")


def test_other_types(spark, monkeypatch):
    """Longs beyond a double's precision and decimals come out unchanged."""
    monkeypatch.setattr(medians, "FEW", 2)
    monkeypatch.setattr(medians, "CUTS", 4)
    rng = random.Random(3)
    _check(spark, [("a", 2**60 + rng.randrange(12)) for _ in range(41)], "long")
    _check(spark, [("a", Decimal(rng.randrange(900)) / 100) for _ in range(40)], "decimal(9,2)")


def test_empty_table(spark):
    empty = spark.createDataFrame([], "k string, v double")
    assert upper_median(empty, "v", ["k"], "m").count() == 0 and upper_median(empty, "v", [], "m").count() == 0


@pytest.mark.parametrize("value", ["id / 1e6", "id * 1e6 + id % 7", "if(id % 3 = 0, id, 5)"])
def test_dense_sparse_and_tied_values(spark, monkeypatch, value):
    """A million values in one unit, over 10^12 units, or mostly equal; few rows are ever put in order."""
    seen, plain = [], medians._ordered

    def counted(rows, asked, names):
        seen.append((rows.count(), asked.agg(F.max("_n")).first()[0]))
        return plain(rows, asked, names)

    monkeypatch.setattr(medians, "_ordered", counted)
    df = spark.range(1_000_001).select(F.expr(value).cast("double").alias("v"))
    (row,) = upper_median(df.repartition(8), "v", [], "m").collect()
    want = df.sort("v").offset(500_000).first()["v"]
    assert row["m"] == want
    sizes = [n for n, _ in seen]
    assert len(sizes) <= 4 and all(b <= a / 30 for a, b in zip(sizes, sizes[1:], strict=False))


def test_no_window_over_all_values(spark):
    """Windows run over at most FEW rows or the slots of a key: the rows counted are grouped first."""
    rows = spark.range(100_000).select(F.lit(0).alias("k"), F.col("id").cast("double").alias("_v"))
    asked = medians._sketch(rows, ["k"]).withColumn("_skip", F.floor(F.col("_n") / 2))
    assert medians._ordered(rows, asked, ["k"]).count() == 0
    slots = medians._tallies(rows, asked, ["k"])._jdf.queryExecution().optimizedPlan().toString()
    assert slots.index("Window") < slots.index("Aggregate")


def test_intermediate_tables_are_deleted(spark, monkeypatch):
    import os

    kept = []
    monkeypatch.setattr(medians, "materialise", lambda df, plain=medians.materialise: kept.append(plain(df)) or kept[-1])
    monkeypatch.setattr(medians, "FEW", 10)
    upper_median(spark.range(1000), "id", [], "m")
    assert len(kept) >= 5 and [os.path.exists(t.stored_at.removeprefix("file:")) for t in kept] == [False] * (len(kept) - 1) + [True]
