from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewell.llm import negatives, queries

SCHEMA = "vec_id long, embedding array<float>, label int"
OUT = ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]


def brute(rows, is_anchor):
    """Rows of the result by definition; equal rows are different rows."""
    usable = []
    for vec_id, vector, label in rows:
        if label is None or vector is None or any(x is None or not math.isfinite(x) for x in vector):
            continue
        mined = int(math.fmod(label + 1, 10)) if vec_id is not None and vec_id % 7 == 0 else label
        usable.append((vec_id, mined, [math.floor(256 * float(np.float32(x))) for x in vector]))
    order = lambda t: (-t[0], t[1] is None, t[1] or 0)
    out = []
    for i, (vec_id, label, v) in enumerate(usable):
        if vec_id is None or not is_anchor(vec_id):
            continue
        scored = [(sum(a * b for a, b in zip(v, w)), other, m == label) for j, (other, m, w) in enumerate(usable) if j != i]
        for s, positive, _ in sorted([t for t in scored if t[2]], key=order)[:5]:
            inside = [t for t in scored if not t[2] and 50 * s <= 100 * t[0] <= 95 * s]
            for rank, (n, negative, _) in enumerate(sorted(inside, key=order)[:3], 1):
                out.append((vec_id, positive, rank, negative, s, n))
    return out


def key(row):
    return tuple((x is None, x or 0) for x in row)


def mined(spark, rows, is_anchor, **options):
    df = spark.createDataFrame(rows, SCHEMA)
    return sorted([tuple(r) for r in negatives.mine(df, is_anchor, **options).select(*OUT).collect()], key=key)


def vectors(n, dim, seed, spread=1.0):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(4, dim))
    return [(centres[i % 4] + spread * rng.normal(size=dim)).astype(np.float32).tolist() for i in range(n)]


@pytest.mark.parametrize("dim, cells", [(16, {}), (13, {"cell_anchors": 3, "cell_rows": 40})])
def test_equals_brute_force(spark, dim, cells):
    rows = [(i, v, i % 3) for i, v in enumerate(vectors(250, dim, dim, 0.4))]
    want = brute(rows, lambda i: i % 10 == 0)
    assert len(want) > 150
    assert mined(spark, rows, F.col("vec_id") % 10 == 0, **cells) == sorted(want, key=key)


def test_lookups_equal_products():
    rng = np.random.default_rng(3)
    a, c = rng.integers(-500, 500, (70, 24)), rng.integers(-512, 512, (300, 24))
    packed = negatives.pack(c, 11)
    assert (negatives.unpack(packed) == c).all()
    assert (negatives.products(negatives.subset_sums(a), packed) == c @ a.T).all()


def test_ties_copies_nulls_and_lengths(spark):
    v = vectors(30, 8, 5, 0.3)
    rows = [(i, v[i], i % 2) for i in range(30)]
    rows += [(40 + i, v[0], 1) for i in range(6)]  # ties of other labels and of the same
    rows += [(10, v[10], 0), (10, v[10], 0), (10, v[11], 1)]  # copies, and an id twice
    rows += [(None, v[1], 0), (None, v[2], 1), (None, v[2], 1)]
    rows += [(60, v[1][:5], 1), (70, v[3] + [9.0] * 4, 0), (80, [], 0), (90, [0.0] * 8, 1)]
    rows += [(100, None, 1), (110, v[1], None), (120, [float("nan")] * 8, 1), (130, [1.0, None], 1), (140, [float("-inf")], 0)]
    want = sorted(brute(rows, lambda i: i % 10 == 0), key=key)
    assert mined(spark, rows, F.col("vec_id") % 10 == 0) == want
    assert mined(spark, rows, F.col("vec_id") % 10 == 0, cell_anchors=2, cell_rows=16) == want


def test_empty_extra_columns_and_wide_values(spark):
    assert mined(spark, [], F.col("vec_id") % 10 == 0) == []
    rows = [(i, [x * 1000 for x in v], i % 2) for i, v in enumerate(vectors(60, 8, 9, 0.3))]
    want = sorted(brute(rows, lambda i: i % 10 == 0), key=key)
    df = spark.createDataFrame(rows, SCHEMA).withColumns({"uid": F.lit(1), "planes": F.lit("x"), "_kind": F.lit(2), "score": F.lit(0)})
    found = negatives.mine(df, F.col("vec_id") % 10 == 0).select(*OUT).collect()
    assert sorted([tuple(r) for r in found], key=key) == want
    with pytest.raises(ValueError):
        negatives.mine(spark.createDataFrame([(0, [1e30], 1)], SCHEMA), F.col("vec_id") % 10 == 0)


def test_query(spark):
    sf = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/embeddings.parquet").select("vec_id", "embedding", "label").collect()]
    found = queries.QUERIES["op12_hard_negatives"](spark, sf).select(*OUT).collect()
    assert sorted([tuple(r) for r in found], key=key) == sorted(brute(rows, lambda i: i % 50 == 0), key=key)
