"""Substring and suffix dedup against brute force."""

from __future__ import annotations

import hashlib
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tidewell.llm import exchange, substring, suffixes
from tidewell.llm.queries import QUERIES

from .conftest import words

SF = "/root/testdata/sf0.001"


def brute_words(texts, n=35):
    lists = [words(t) for t in texts]
    seen = Counter(tuple(ws[i : i + n]) for ws in lists for i in range(len(ws) - n + 1))
    out = []
    for ws in lists:
        gone = set()
        for i in range(len(ws) - n + 1):
            if seen[tuple(ws[i : i + n])] > 1:
                gone.update(range(i, i + n))
        kept = " ".join(w for i, w in enumerate(ws) if i not in gone)
        out.append((len(ws), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return out


def brute_bytes(docs, n=50):
    """docs: (doc_id, text)."""
    first = {}
    data = [(-(1 << 63) if i is None else i, (t or "").encode()) for i, t in docs]
    for i, b in data:
        for p in range(len(b) - n + 1):
            s = b[p : p + n]
            first[s] = min(first.get(s, i), i)
    out = []
    for i, b in data:
        gone = bytearray(len(b))
        for p in range(len(b) - n + 1):
            if first[b[p : p + n]] < i:
                gone[p : p + n] = b"\1" * n
        spans = sum(1 for p in range(len(b)) if gone[p] and (p == 0 or not gone[p - 1]))
        out.append((len(b), sum(gone), spans, hashlib.sha256(bytes(c for c, g in zip(b, gone, strict=True) if not g)).hexdigest()))
    return out


@pytest.mark.parametrize("sf", [SF, "/root/testdata/sf0.01"])
def test_word_query(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").orderBy("doc_id").collect()
    got = {r["doc_id"]: tuple(r)[1:4] for r in QUERIES["op1_substring_dedup"](spark, sf).collect()}
    assert [got[r["doc_id"]] for r in docs] == brute_words([r["text"] for r in docs])


def test_byte_query(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").orderBy("doc_id").collect()
    got = {r["doc_id"]: tuple(r)[1:5] for r in QUERIES["op10_suffix_dedup"](spark, SF).collect()}
    assert [got[r["doc_id"]] for r in docs] == brute_bytes([(r["doc_id"], r["text"]) for r in docs])


def made(rng, n):
    """Texts cut and pasted from few passages, with short periods and edits."""
    vocabulary = [f"w{i}é" for i in range(30)]
    passages = [" ".join(rng.choices(vocabulary, k=rng.randint(20, 60))) for _ in range(8)]
    passages += ["x " * 80, "ab " * 50, "\n\t a b c " * 20]
    out = []
    for _ in range(n):
        parts = [rng.choice(passages) if rng.random() < 0.6 else " ".join(rng.choices(vocabulary, k=rng.randint(0, 40))) for _ in range(rng.randint(0, 6))]
        text = " ".join(parts)
        if text and rng.random() < 0.5:
            i = rng.randrange(len(text))
            text = text[:i] + "Z" + text[i + rng.randint(0, 9) :]
        out.append(text)
    return [*out, None, "", " \n", "x" * 3000, "x" * 49, "x" * 50, *out[:5]]


@pytest.mark.parametrize("seed", [1, 2])
def test_made_texts(spark, docs_of, monkeypatch, seed):
    monkeypatch.setattr(exchange, "UNIT_BYTES", (4000, 4000))
    monkeypatch.setattr(exchange, "BUCKET_BYTES", 1000)
    texts = made(random.Random(seed), 120)
    docs = docs_of(texts).withColumn("unit", F.lit("x")).withColumn("kept", F.lit(1))
    got = {r["doc_id"]: r for r in substring.remove_repeats(docs).collect()}
    assert len(got) == len(texts)
    hashed = lambda x: hashlib.sha256(x.encode() if isinstance(x, str) else bytes(x)).hexdigest()
    assert [(got[i]["n_words"], got[i]["n_removed"], hashed(got[i]["kept"])) for i in range(len(texts))] == brute_words(texts)
    got = {r["doc_id"]: r for r in suffixes.remove_repeats(docs).collect()}
    assert [(r["n_bytes"], r["n_removed"], r["n_spans"], hashed(r["kept"])) for r in (got[i] for i in range(len(texts)))] == brute_bytes(list(enumerate(texts)))


def test_odd_ids(spark, docs_of):
    text = "The quick brown fox jumps over the lazy dog and runs away from it again. " * 4
    docs = docs_of([text, text]).withColumn("doc_id", F.lit(5).cast("long")).unionByName(docs_of([text]).withColumn("doc_id", F.lit(None).cast("long")))
    rows = suffixes.remove_repeats(docs).collect()
    assert sorted((r["doc_id"] or -1, r["n_removed"]) for r in rows) == [(-1, 0), (5, len(text)), (5, len(text))]
    assert {r["n_removed"] for r in substring.remove_repeats(docs).collect()} == {60}
    assert suffixes.remove_repeats(docs.limit(0)).collect() == [] and substring.remove_repeats(docs.limit(0)).collect() == []


def test_texts_are_shuffled_once(spark):
    plan = QUERIES["op1_substring_dedup"](spark, SF)
    plan.collect()
    text = plan._jdf.queryExecution().executedPlan().toString()
    final = text.split("Initial Plan")[0]
    assert final.count("ReusedExchange") >= 3
