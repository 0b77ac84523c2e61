from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from tidewell.llm import neighbour_votes as nv
from tidewell.llm import queries

SF = "/root/testdata/sf0.1"


def test_held_out_accuracy(spark):
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    found = queries.QUERIES["op11_neighbour_votes"](spark, SF).collect()
    assert len(found) == spark.read.parquet(f"{SF}/documents.parquet").count()
    right, bad = [], []
    for r in found:
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1)
        assert 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5)
        if r["held_out"] and r["doc_id"] in labels:
            right.append(r["predicted"] == labels[r["doc_id"]])
            if labels[r["doc_id"]] == 0:
                bad.append(r["predicted"] == 0)
    assert len(right) > 1000 and np.mean(right) > 0.97 and np.mean(bad) > 0.9


def test_vote_equals_plain_search():
    rng = np.random.default_rng(1)
    unit = lambda x: x / np.linalg.norm(x, axis=1, keepdims=True)
    model = nv.Model(None, None, unit(rng.normal(size=(200, 8))), (rng.random(200) < 0.6).astype(float))
    asked = unit(rng.normal(size=(40, 8)))
    for q, got in zip(asked, nv.vote(model, asked)):
        sims = [max(0.0, float(q @ v)) for v in model.voters]
        near = sorted(range(200), key=lambda i: -sims[i])[: nv.VOTERS]
        weight = [sims[i] ** nv.SHARPNESS for i in near]
        assert abs(got - sum(w * model.votes[i] for w, i in zip(weight, near)) / sum(weight)) < 1e-9


def test_counts_in_slices(monkeypatch):
    texts = ["abcabcabc", "", None, "é" * 50, "x", "some words and more words"]
    whole = nv._terms(pa.array(texts, pa.string()))
    monkeypatch.setattr(nv, "SLICE", 7)
    assert np.array_equal(whole, nv._terms(pa.array(texts, pa.string())))
    assert whole[0].sum() > 0 and np.array_equal(whole[1], whole[2])


def test_edges(spark, docs_of):
    good, bad = "The cat sat on the mat and looked at the dog. ", "BUY!! NOW!! "
    docs = docs_of([good * 5, bad * 9, good * 7, bad * 20, "", None, good * 3 + bad, "word " * 200_000, good * 5])
    rows = [(i, 0 if i in (1, 3, 4) else 1, 0) for i in range(9)] + [(None, 1, 0), (0, None, 0), (99, 0, 0), (2, 1, 1)]
    labels = spark.createDataFrame(rows, "doc_id long, quality int, toxic int")
    extra = docs.withColumns({"score": F.lit("s"), "_label": F.lit(1), "at": F.lit(2)}).unionByName(docs.limit(1), allowMissingColumns=True)
    found = nv.score(extra, nv.fit(extra, labels))
    out = [(r["doc_id"], r["score"]) for r in found.collect()]
    assert len(out) == 10 and all(0 <= s <= 1 for _, s in out) and "lang" in found.columns
    unlabelled = nv.score(docs, nv.fit(docs, labels.limit(0)), "s").collect()
    assert all(r["s"] == 0.5 for r in unlabelled)
    assert nv.score(docs.limit(0), nv.fit(docs.limit(0), labels), "s").count() == 0
