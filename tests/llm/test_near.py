"""SimHash groups, union-find and nearest neighbours against brute force."""

from __future__ import annotations

import random

import numpy as np
import xxhash
from pyspark.sql import functions as F

from tidewell.llm import components, neighbours, simhash
from tidewell.llm.queries import QUERIES

from .conftest import words

SF = "/root/testdata/sf0.01"


def fingerprint(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    ws = words(low)
    grams = [" ".join(ws[i : i + 3]) for i in range(max(1, len(ws) - 2))] if ws else []
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def groups(n, links):
    root = list(range(n))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


def test_components(spark):
    rng = random.Random(2)
    links = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(7, i) for i in range(300, 600)] + [(i, i + 1) for i in range(600, 700)]
    want = groups(701, links)
    df = spark.createDataFrame([*links, (None, 3), (4, 4)], "a long, b long")
    got = {r["id"]: r["component"] for r in components.components(df).collect()}
    for i in range(701):
        if i in got:
            assert got[i] == want[i]
        else:
            assert want.count(i) == 1
    assert components.components(df.limit(0)).collect() == []
    a, b = np.array(links).T
    assert components.roots(701, a, b).tolist() == want


def test_trees_lose_no_pair():
    rng = np.random.default_rng(4)
    base = rng.integers(0, 1 << 63, 600, dtype=np.int64)
    near = np.array([x ^ sum(1 << int(b) for b in rng.choice(63, 3, replace=False)) for x in base.tolist()], np.int64)
    values = np.unique(np.concatenate([base, near, [0]]))
    met = set()
    for half in simhash._halves(values):
        tree = simhash.grow_tree(half[:400], 32, 1)
        at, leaf, home = simhash.route(tree, half, 1)
        lives = {int(i): int(x) for i, x, h in zip(at, leaf, home, strict=True) if h}
        assert len(lives) == len(values) == home.sum()
        asks = {(int(i), int(x)) for i, x in zip(at, leaf, strict=True)}
        assert len(at) < 20 * len(values)
        x, y = np.nonzero(np.bitwise_count(values[:, None] ^ values[None, :]) <= 3)
        met |= {(i, j) for i, j in zip(x.tolist(), y.tolist(), strict=True) if (i, lives[j]) in asks}
        pairs = set(zip(x.tolist(), y.tolist(), strict=True))
    assert met == pairs


def test_simhash_query(spark, docs_of):
    texts = [r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").orderBy("doc_id").collect()]
    got = {r["doc_id"]: r for r in QUERIES["op6_simhash"](spark, SF).collect()}
    prints = [fingerprint(t) for t in texts]
    assert [got[i]["fingerprint"] for i in range(len(texts))] == [f"{p:016x}" for p in prints]
    links = [(i, j) for i in range(len(texts)) for j in range(i) if (prints[i] ^ prints[j]).bit_count() <= 3]
    assert [got[i]["component_id"] for i in range(len(texts))] == groups(len(texts), links)


def test_simhash_odd_rows(spark, docs_of, monkeypatch):
    monkeypatch.setattr(simhash, "PIECE", 2)
    texts = [None, "", " ", "a", "A", "a b", "É b C d", "a b c " * 40000, "a b c " * 40000]
    docs = docs_of(texts).unionByName(docs_of(["a"])).withColumn("fingerprint", F.lit("x")).withColumn("component_id", F.lit(1))
    docs = docs.unionByName(docs.where("doc_id = 3").withColumn("doc_id", F.lit(None).cast("long")))
    rows = simhash.near_duplicates(docs).collect()
    assert len(rows) == 11
    prints = {(r["doc_id"], r["fingerprint"] & (1 << 64) - 1) for r in rows}
    assert prints == {(i, fingerprint(t)) for i, t in [*enumerate(texts), (0, "a"), (None, "a")]}
    by_id = {(r["doc_id"], r["fingerprint"]): r["component_id"] for r in rows}
    assert all(c == 0 for (i, f), c in by_id.items() if f == 0)
    assert {c for (i, f), c in by_id.items() if f % (1 << 64) == fingerprint("a")} == {0}
    assert {c for (i, f), c in by_id.items() if i in (7, 8)} == {7}
    assert simhash.near_duplicates(docs.limit(0)).collect() == []


def brute(ids, x, k):
    out = {}
    for i in np.flatnonzero(ids % 20 == 0):
        s = (x * x[i]).sum(1)
        order = [j for j in np.lexsort((ids, -s)) if j != i][:k]
        out[int(ids[i])] = [(int(ids[j]), float(s[j])) for j in order]
    return out


def test_recall(spark):
    rows = spark.read.parquet(f"{SF}/../sf0.1/embeddings.parquet").orderBy("vec_id").collect()
    want = brute(np.array([r["vec_id"] for r in rows]), np.array([r["embedding"] for r in rows], float), 20)
    table = spark.read.parquet(f"{SF}/../sf0.1/embeddings.parquet")
    got = {}
    for r in neighbours.search(table, F.col("vec_id") % 20 == 0, leaf_rows=128).collect():
        got.setdefault(r["query_id"], {})[r["rank"]] = (r["vec_id"], r["score"])
    assert got.keys() == want.keys()
    hits = sum(len({v for v, _ in got[q].values()} & {v for v, _ in want[q]}) for q in want)
    assert hits / (20 * len(want)) >= 0.9
    for q, found in got.items():
        assert sorted(found) == list(range(1, 21))
        scores = dict(want[q])
        assert all(abs(scores.get(v, s) - s) < 1e-12 for v, s in found.values())


def test_leaves_of_a_cell_are_ranked_together():
    """One short list per query and cell, whatever the number of leaves; ties go to the smaller class."""
    rng = np.random.default_rng(5)
    x = rng.integers(-2, 3, size=(600, 3)).astype(float)
    leaf, own, q = rng.integers(0, 4, 600), rng.permutation(600), rng.normal(size=(700, 3))
    opened = rng.integers(0, 16, 700)
    most = np.sqrt((x * x).sum(1).max())
    leaves = [(bit, x[leaf == bit], own[leaf == bit]) for bit in range(4)]
    who, cid, score = neighbours.best_of_leaves(q, opened, leaves, 5, most)
    for i in range(700):
        there = np.flatnonzero(opened[i] >> leaf & 1)
        s = (x[there] * q[i]).sum(1)
        order = np.lexsort((own[there], -s))[:5]
        assert cid[who == i].tolist() == own[there][order].tolist()
        assert score[who == i].tolist() == s[order].tolist()


def test_neighbours_odd_rows(spark):
    rng = np.random.default_rng(0)
    good = [(i, rng.normal(size=4).tolist()) for i in range(40)]
    same = [(100 + i, [1.0, 2.0, 0.0, -1.0]) for i in range(60)]
    bad = [(200, None), (220, []), (240, [0.0] * 4), (260, [1.0, None, 0.0, 0.0]), (280, [float("nan")] * 4), (300, [float("inf")] * 4), (320, [1.0])]
    df = spark.createDataFrame([(*r, "x") for r in good + same + bad], "vec_id long, embedding array<double>, score string")
    got = {}
    for r in neighbours.search(df, F.col("vec_id") % 20 == 0, share=1.0, leaf_rows=16).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"]))
    ids = np.array([i for i, _ in good + same])
    want = brute(ids, np.array([v for _, v in good + same]), 20)
    assert {q: [v for _, v in sorted(x)] for q, x in got.items()} == {q: [v for v, _ in x] for q, x in want.items()}
    few = neighbours.search(df.where("vec_id in (0, 1, 2)"), F.col("vec_id") % 20 == 0).collect()
    assert len(few) == 2
    nameless = spark.createDataFrame([(None, [9.0, 9.0]), (None, [9.0, 9.0]), (None, [3.0, 0.0]), (5, [3.0, 0.0]), (20, [1.0, 1.0])], "vec_id long, embedding array<double>")
    found = neighbours.search(nameless, F.col("vec_id") % 20 == 0).orderBy("rank").collect()
    assert [(r["rank"], r["vec_id"], r["score"]) for r in found] == [(1, None, 18.0), (2, None, 18.0), (3, 5, 3.0), (4, None, 3.0)]
    assert neighbours.search(df.limit(0), F.col("vec_id") % 20 == 0).collect() == []


def test_neighbours_as_registered(spark):
    """Recall of the registered query with more than one leaf, in parts of large and small norms."""
    table = spark.read.parquet(f"{SF}/../sf0.1/embeddings.parquet")
    far = table.select((F.col("vec_id") + 10_000_000).alias("vec_id"), F.transform("embedding", lambda x: x * 1e6).alias("embedding"))
    near = table.select((F.col("vec_id") + 20_000_000).alias("vec_id"), F.transform("embedding", lambda x: -x).alias("embedding"))
    more = table.select("vec_id", "embedding").unionByName(far).unionByName(near)
    rows = more.orderBy("vec_id").collect()
    assert len(rows) > 2 * neighbours.LEAF_ROWS
    want = brute(np.array([r["vec_id"] for r in rows]), np.array([r["embedding"] for r in rows], float), 20)
    got = {}
    for r in neighbours.search(more, F.col("vec_id") % 20 == 0).collect():
        got.setdefault(r["query_id"], set()).add(r["vec_id"])
    assert got.keys() == want.keys() and all(len(x) == 20 for x in got.values())
    hits = sum(len(got[q] & {v for v, _ in want[q]}) for q in want)
    assert hits / (20 * len(want)) >= 0.9


def test_cells_do_not_follow_the_leaves():
    """With more leaves the cells grow, not the number of lists a query gets back."""
    for cores in (6, 8):
        for leaves in (24, 52, 260, 600):
            cells = -(-leaves // neighbours.leaves_of_cell(leaves, cores))
            assert cells <= 2 * cores
            assert neighbours.leaves_of_cell(leaves, cores) < 63
