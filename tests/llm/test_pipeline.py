"""Stages of the corpus pipeline, each against a plain version on its own input."""

from __future__ import annotations

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tidewell.llm import quality

from .conftest import words
from .test_lines import brute_lines
from .test_near import fingerprint, groups
from .test_plain import stats

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def steps(spark, tmp_path_factory):
    """Rows before and after each stage."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = [docs]
    for name, stage in corpus_pipeline.STAGES:
        path = str(tmp_path_factory.mktemp("stage") / name)
        stage(spark, out[-1], SF).write.parquet(path)
        out.append(spark.read.parquet(path))
    return out


def test_columns(steps):
    assert [s.columns for s in steps[:-1]] == [steps[0].columns] * 5


def test_rules(spark, steps):
    kept = {r["doc_id"] for r in steps[1].collect()}
    rules = quality.fit_rules(steps[0], spark.read.parquet(f"{SF}/labels.parquet"))
    names = list(quality.features())
    feats = quality.statistics(steps[0]).select("doc_id", "text", *[c.alias(n) for n, c in quality.features("_quality").items()])
    import numpy as np

    for r in feats.collect():
        s = stats(r["text"])
        bad = s["n_words"] < 50 or 100 * s["n_repeat_words"] > 50 * s["n_words"]
        x = np.array([[r[n] for n in names]])
        learned = any(quality._covered(rule, x, names)[0] for rule in rules)
        assert (r["doc_id"] in kept) == (not bad and not learned)


def test_lines_stage(steps):
    rows = steps[1].orderBy("doc_id").collect()
    ids = [r["doc_id"] for r in rows]
    want, _ = brute_lines([r["text"] for r in rows])
    got = {r["doc_id"]: r["text"] for r in steps[2].collect()}
    wrong = 0
    for n, r in enumerate(rows):
        stay = [x for j, x in enumerate(r["text"].split("\n")) if want.get((n, j), (n, j)) == (n, j)]
        wrong += got[ids[n]] != "\n".join(stay)
    assert wrong <= 1 and len(got) == len(rows)


def test_groups_stage(steps):
    rows = steps[2].orderBy("doc_id").collect()
    prints = [fingerprint(r["text"]) for r in rows]
    root = groups(len(rows), [(i, j) for i in range(len(rows)) for j in range(i) if (prints[i] ^ prints[j]).bit_count() <= 3])
    want = [r["doc_id"] for i, r in enumerate(rows) if root[i] == i]
    assert sorted(r["doc_id"] for r in steps[3].collect()) == want


def test_mix_stage(steps):
    before, after = steps[3].collect(), steps[4].collect()
    assert {r["doc_id"] for r in after} <= {r["doc_id"] for r in before}
    assert max(Counter(r["doc_id"] for r in after).values()) <= 2
    size = lambda rows: sum(len(words(r["text"])) for r in rows)
    assert abs(size(after) - 1.5 * size(before)) < 0.01 * size(before)


def test_packing_stage(steps):
    mixed, pieces = steps[4].collect(), steps[5].collect()
    assert sum(r["n_tokens"] for r in pieces) == sum(len(words(r["text"])) for r in mixed)


def test_odd_rows(spark, docs_of, tmp_path):
    rng = random.Random(1)
    good = [" ".join("".join(rng.choices("abcdefghij", k=5)) for _ in range(80)) for _ in range(30)]
    docs = docs_of([None, "", *good, good[0], good[1].replace("a", "b", 1)])
    for c in ("_row", "size", "kept", "_gone", "component_id", "copies", "_quality", "unit"):
        docs = docs.withColumn(c, F.lit("x"))
    docs = docs.unionByName(docs.where("doc_id = 5"))
    docs = docs.unionByName(docs.where("doc_id = 6").withColumns({"doc_id": F.lit(None).cast("long"), "source": F.lit(None).cast("string")}))
    for table in (docs, docs.limit(0)):
        rows = table
        for name, stage in corpus_pipeline.STAGES:
            path = str(tmp_path / f"{name}-{table is docs}")
            stage(spark, rows, SF).write.parquet(path)
            got = spark.read.parquet(path)
            if name != "packing":
                assert got.columns == docs.columns
            rows = got
        assert (rows.count() > 0) == (table is docs)
