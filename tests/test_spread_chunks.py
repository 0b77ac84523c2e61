"""Chunks of long texts cut by many tasks, held against the fold inside one row."""

from __future__ import annotations

import random

import numpy as np
from pyspark.sql import functions as F

from tidewell.operators import chunking
from tidewell.operators import spread_chunks as sc


def _same(spark, docs, target, overlap, **how):
    blocks = spark.createDataFrame(docs, "document_id long, type string, content string")
    columns = ["document_id", "chunk_index", "type", "content", "token_count", "strategy"]
    want = chunking.semantic_chunks(blocks, target, overlap).select(columns).collect()
    got = sc.semantic_chunks_spread(blocks, target, overlap, **how).select(columns).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, want))
    return len(got)


def _text(rng, paragraphs, lengths):
    return "\n\n".join(
        " ".join(rng.choice(["ab", "c.", "d?", "e!", "."]) for _ in range(rng.choice(lengths))) for _ in range(paragraphs)
    )


def test_equal_to_the_fold_on_random_texts(spark):
    rng = random.Random(8)
    docs = [(i, "text", _text(rng, rng.randint(0, 90), [1, 2, 3, 5, 9])) for i in range(60)]
    docs += [(100 + i, "text", _text(rng, rng.randint(0, 60), [1, 3, 9, 30, 0])) for i in range(60)]
    docs += [(200 + i, "text", _text(rng, 70, [1])) for i in range(10)] + [(300, "text", None), (301, "text", ""), (302, "table", "a b " * 50)]
    for target, overlap in ((12, 4), (5, 5), (1, 1)):
        assert _same(spark, docs, target, overlap, long_chars=0, bucket_units=1) > 100
    _same(spark, docs, 12, 4, long_chars=150, bucket_units=16)


def test_tables_of_buckets_follow_the_walk():
    rng = np.random.default_rng(4)
    for _ in range(300):
        m, target, overlap = int(rng.integers(3, 60)), int(rng.integers(1, 9)), int(rng.integers(0, 6))
        halo = max(target, 2)
        n = rng.integers(1, 6, m)
        run = np.cumsum(rng.random(m) < 0.05)
        sentence = run % 2 == 0
        own = min(m, int(rng.integers(1, m + 1)) + halo)
        part = slice(0, min(m, own + halo))
        table = sc.bucket_table(n[part], run[part], sentence[part], own, halo, target, overlap)
        _, after = sc.successors(n[part], run[part], sentence[part], own, target, overlap)
        node = 2 * int(np.flatnonzero(run[:own] == run[own - 1])[0])
        while sc.END < node < 2 * own:
            node = int(after[node])
        crosses = own < m and run[own - 1] == run[own]
        want = 0 if not crosses else 1 + 2 * halo if node == sc.END else 1 + node - 2 * own
        assert table[0] == want


def test_a_long_text_is_many_tasks(spark):
    rng = random.Random(2)
    content = "\n\n".join("w " * rng.choice([1, 2, 3]) for _ in range(100_000))
    texts = spark.createDataFrame([(0, content)], "_bid long, content string")
    units = sc.text_units(texts, 8, "\n\n", 4096)
    spread = sc._in_buckets(units, 4096, 8).groupBy("_bid", "_b").count().agg(F.count("*"), F.max("count"), F.sum("count")).first()
    assert spread[0] == 25 and spread[1] <= 4096 + 8 and spread[2] <= 100_000 + 24 * 8
    entries = sc.entry_nodes(units, 8, 2, 4096, 8)
    cut = sc.cut_units(units, entries, 8, 2, 4096, 8).orderBy("_node").collect()
    n = [len(p.split()) for p in content.split("\n\n")]
    want, held, last = [], 0, None
    for x in n:
        if held and held + x > 8:
            want.append(held)
            held = last if last <= 2 else 0
        held, last = held + x, x
    assert [r["token_count"] for r in cut] == [*want, held]


def test_numbers_run_on_through_blocks(spark):
    rows = [(1, 0, "text", "a b\n\nc d\n\ne f", 7), (1, 1, "table", "x y", 8), (1, 2, "text", "g h\n\ni j", 9), (2, 0, "text", "k", 1)]
    blocks = spark.createDataFrame(rows, "document_id long, block_no int, type string, content string, page_number int")
    columns = ["document_id", "block_no", "chunk_index", "content", "token_count", "page_number"]
    want = chunking.semantic_chunks(blocks, 2, 0).select(columns).collect()
    got = sc.semantic_chunks_spread(blocks, 2, 0, long_chars=5).select(columns).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, want)) and len(got) == 7


def test_ingest_takes_the_spread_way(spark):
    from tests.test_operators import FILES, _file
    from tidewell.plans.ingest import ingest

    text = "\n\n".join(f"part {i} with some words" for i in range(400))
    files = spark.createDataFrame([_file(1, "a.txt", text), _file(2, "b.txt", "short"), _file(3, "c.html", "<p>x</p>", "hierarchical")], FILES)
    columns = ["document_id", "chunk_index", "chunk_id", "content", "token_count", "page_number"]
    want = ingest(files, dim=4).chunks.select(columns).collect()
    got = ingest(files, dim=4, long_chars=1000).chunks.select(columns).collect()
    assert sorted(map(repr, got)) == sorted(map(repr, want)) and len(got) > 5
