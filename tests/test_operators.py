"""Chunking, retrieval, evaluation and stores against brute force and invariants."""

from __future__ import annotations

import random
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewell.functions import medians, ordered
from tidewell.operators import chunking, drift, evaluation, fusion, lifecycle
from tidewell.operators.dense import dense_topk
from tidewell.operators.embedding import embed_chunks
from tidewell.plans import search
from tidewell.plans.ingest import ingest
from tidewell.plans.store import KeyedStore


def pack(content, target, overlap):
    """Slow statement of the packing rules, chunk by chunk."""
    out, cur = [], []

    def total(parts):
        return sum(len(p.split()) for p in parts)

    for para in [p.strip() for p in content.split("\n\n") if p.strip()]:
        if total([para]) <= target:
            if total(cur) + total([para]) > target:
                out.append((total(cur), "\n\n".join(cur)))
                cur = [cur[-1]] if total(cur[-1:]) <= overlap else []
            cur.append(para)
            continue
        if cur:
            out.append((total(cur), "\n\n".join(cur)))
            cur = []
        some = []
        for mark in "?!":
            para = para.replace(mark, ".")
        for sentence in [s.strip() for s in para.split(".") if s.strip()]:
            if some and total(some) + total([sentence]) > target:
                out.append((total(some), ". ".join(some) + "."))
                some = some[-1:] if len(some) > 1 else []
            some.append(sentence)
        if some:
            out.append((total(some), ". ".join(some) + "."))
    if cur:
        out.append((total(cur), "\n\n".join(cur)))
    return out


def test_semantic_chunks_against_brute_force(spark):
    rng = random.Random(5)
    docs = []
    for i in range(150):
        paras = []
        for _ in range(rng.randint(0, 12)):
            n = rng.choice([1, 3, 5, 9, 30])
            paras.append(" ".join(rng.choice(["ab", "c.", "d?", "e!", "."]) for _ in range(n)))
        docs.append((i, "text", "\n\n".join(paras)))
    blocks = spark.createDataFrame(docs, "document_id long, type string, content string")
    got = {}
    rows = chunking.semantic_chunks(blocks, target=12, overlap=4).orderBy("document_id", "chunk_index").collect()
    for r in rows:
        got.setdefault(r["document_id"], []).append((r["token_count"], r["content"]))
    assert got == {i: pack(c, 12, 4) for i, _, c in docs if pack(c, 12, 4)}


def test_tables_stay_whole_and_numbering_runs_on(spark):
    rows = [
        (1, 0, "text", "Opening words.", 1), (1, 1, "table", "| a |\n|---|\n| 1 |", 2), (1, 2, "text", "Closing words.", 3),
    ]
    blocks = spark.createDataFrame(rows, "document_id long, block_no int, type string, content string, page_number int")
    got = chunking.semantic_chunks(blocks).orderBy("chunk_index").collect()
    assert [(r["chunk_index"], r["type"], r["page_number"]) for r in got] == [(0, "text", 1), (1, "table", 2), (2, "text", 3)]
    assert got[1]["content"] == "| a |\n|---|\n| 1 |"
    compat = chunking.semantic_chunks(blocks, compat_index=True).orderBy("block_no").collect()
    assert [r["chunk_index"] for r in compat] == [0, 0, 1]
    tree = chunking.hierarchical_chunks(blocks, child=1).orderBy("chunk_index").collect()
    assert [r["strategy"][13:] for r in tree] == ["parent", "child", "child", "parent", "parent", "child", "child"]
    linked = chunking.parent_of_child(chunking.hierarchical_chunks(blocks, child=1)).orderBy("chunk_index").collect()
    assert [r["parent_index"] for r in linked] == [0, 0, 0, 3, 4, 4, 4]


def test_unknown_strategy_is_named(spark):
    row = spark.range(1).select(chunking.route_strategy(F.lit("other")), chunking.strategy_error(F.lit("other"))).first()
    assert tuple(row) == (None, "unknown chunking strategy: other")


def test_running_sum_across_buckets(spark):
    df = spark.range(500).select((F.col("id") % 2).alias("k"), F.col("id").alias("o"))
    out = ordered.running_sum(df, ["k"], ["o"], F.col("o"), F.floor(F.col("o") / 7), "s").collect()
    want = {}
    for i in range(500):
        want[i] = want.get(i - 2, 0) + i
    assert {r["o"]: r["s"] for r in out} == want


def test_upper_median(spark):
    rng = random.Random(1)
    rows = [(k, rng.choice([rng.uniform(-500, 500), 7.0])) for k in "abc" for _ in range(rng.randint(1, 60))]
    df = spark.createDataFrame(rows, "k string, v double")
    got = {r["k"]: r["m"] for r in medians.upper_median(df, "v", ["k"], "m").collect()}
    values = {k: sorted(v for kk, v in rows if kk == k) for k in "abc"}
    assert got == {k: v[len(v) // 2] for k, v in values.items()}


@pytest.fixture(scope="module")
def vectors(spark):
    rng = np.random.default_rng(3)
    chunks = [(i, i % 3, rng.normal(size=8).tolist()) for i in range(300)]
    chunks += [(1000 + i, i % 3, chunks[i][2]) for i in range(30)]  # exact copies: ties
    chunks.append((2000, 0, [0.0] * 8))
    queries = [(i, i % 3, rng.normal(size=8).tolist()) for i in range(40)]
    return (
        spark.createDataFrame(queries, "query_id long, pipeline_id int, q_embedding array<double>"),
        spark.createDataFrame(chunks, "chunk_id long, pipeline_id int, embedding array<float>").repartition(5),
    )


def test_dense_paths_agree_with_brute_force(vectors):
    q, c = vectors
    want = set()
    rows = c.collect()
    for a in q.collect():
        x = np.array(a["q_embedding"])
        near = []
        for b in rows:
            y = np.array(b["embedding"], dtype=float)
            if b["pipeline_id"] == a["pipeline_id"] and np.linalg.norm(y) > 0:
                near.append((round(1 - x @ y / np.linalg.norm(x) / np.linalg.norm(y), 10), b["chunk_id"]))
        want |= {(a["query_id"], cid, i + 1) for i, (_, cid) in enumerate(sorted(near)[:15])}
    by_broadcast = {(r["query_id"], r["chunk_id"], r["rnk"]) for r in dense_topk(q, c, 15).collect()}
    by_tiles = {(r["query_id"], r["chunk_id"], r["rnk"]) for r in dense_topk(q, c, 15, cell_queries=3, cell_rows=16).collect()}
    assert by_broadcast == want
    assert by_tiles == want


def test_dense_text_ids(spark):
    q = spark.createDataFrame([("q", "p", [1.0, 0.0])], "query_id string, pipeline_id string, q_embedding array<double>")
    c = spark.createDataFrame([("a", "p", [0.0, 1.0]), ("b", "p", [1.0, 1.0])], "chunk_id string, pipeline_id string, embedding array<float>")
    assert [(r["chunk_id"], r["rnk"]) for r in dense_topk(q, c, 5).orderBy("rnk").collect()] == [("b", 1), ("a", 2)]


def test_rrf_is_symmetric(spark):
    a = spark.createDataFrame([(1, "x", 1), (1, "y", 2)], "query_id int, chunk_id string, rnk int")
    b = spark.createDataFrame([(1, "y", 1), (1, "z", 2)], "query_id int, chunk_id string, rnk int")
    one = sorted(map(tuple, fusion.rrf([a, b]).collect()))
    assert one == sorted(map(tuple, fusion.rrf([b, a]).collect()))
    assert max(one, key=lambda r: r[2])[1] == "y"


def test_hyde_merge_reaches_queries_without_hits(spark):
    top = spark.createDataFrame([], "query_id int, chunk_id string, rank int, score double, rrf_score double")
    extra = spark.createDataFrame([(1, "x", 1)], "query_id int, chunk_id string, rank int")
    (row,) = fusion.hyde_merge(top, extra).collect()
    assert (row["chunk_id"], row["pos"], row["hyde_applied"]) == ("x", 1, True)


def test_retrieval_scores(spark):
    ranked = spark.createDataFrame([(1, c, i + 1) for i, c in enumerate("abcd")] + [(2, "z", 1)], "q int, chunk_id string, rank int")
    expected = spark.createDataFrame([(1, "b"), (1, "d"), (1, "e"), (3, "m")], "q int, chunk_id string")
    got = {r["q"]: (r["recall"], r["precision"]) for r in evaluation.retrieval_scores(ranked, expected, ["q"]).collect()}
    assert got[1] == (pytest.approx(2 / 3), pytest.approx((1 / 2 + 2 / 4) / 3))
    assert got[2] == (0.0, 0.0) and 3 not in got


def test_running_hits_over_rank_buckets(spark):
    n = 3 * ordered.BUCKET_ROWS
    ranked = spark.range(n).select(F.lit(1).alias("q"), F.col("id").alias("chunk_id"), (F.col("id") + 1).alias("rank"))
    expected = ranked.where("chunk_id % 5 = 0").select("q", "chunk_id")
    row = evaluation.retrieval_scores(ranked, expected, ["q"]).first()
    hits = [i + 1 for i in range(n) if i % 5 == 0]
    assert row["precision"] == pytest.approx(sum((j + 1) / r for j, r in enumerate(hits)) / len(hits))


def test_stored_scores_are_decimals(spark):
    metrics = spark.createDataFrame(
        [(1, 1.0, 1.0, 1.0, 1.0, 0, 5, 1.0, 0, "n")],
        "run_id int, context_recall double, context_precision double, faithfulness double, relevancy double,"
        " median_ms long, n long, pass_rate double, fails long, judge_reasoning string",
    )
    row = evaluation.to_evaluation_rows(evaluation.decide(metrics)).first()
    assert str(row["unified_score"]) == "0.8500" and row["deploy_eligible"] and row["failure_reason"] is None


def test_single_score_never_drifts(spark):
    rows = [("p", 1, datetime(2024, 1, 1), 0.9), ("q", 2, datetime(2024, 1, 1), 0.9), ("q", 3, datetime(2024, 1, 2), 0.5)]
    df = spark.createDataFrame(rows, "pipeline_id string, run_id int, created_at timestamp_ntz, unified_score double")
    got = {r["pipeline_id"]: r["drift"] for r in drift.score_drift(df).collect()}
    assert got == {"q": True}


def test_activate_links_and_supersedes(spark):
    schema = "deployment_id int, pipeline_id int, run_id int, activated_at timestamp_ntz, status string, previous_deployment int, unified_score double"
    old = spark.createDataFrame([(1, 7, 1, datetime(2024, 1, 1), "active", None, 0.8)], schema)
    new = spark.createDataFrame([(2, 7, 2, datetime(2024, 1, 2), 0.9), (3, 8, 3, datetime(2024, 1, 2), 0.9)],
                                "deployment_id int, pipeline_id int, run_id int, activated_at timestamp_ntz, unified_score double")
    got = {r["deployment_id"]: (r["status"], r["previous_deployment"]) for r in lifecycle.activate(old, new).collect()}
    assert got == {1: ("superseded", None), 2: ("active", 1), 3: ("active", None)}


def test_audit_and_log_sinks(spark, tmp_path):
    events = spark.createDataFrame([("EVALUATION_STARTED", {"Email": "x", "k": "v"}), ("NOPE", {})], "event_type string, payload map<string,string>")
    lifecycle.append_audit(events, str(tmp_path / "ok"), str(tmp_path / "bad"))
    assert spark.read.parquet(str(tmp_path / "ok")).first()["payload"] == {"k": "v"}
    assert spark.read.parquet(str(tmp_path / "bad")).count() == 1
    lifecycle.append_query_log(spark.createDataFrame([("hi",)], "q string"), str(tmp_path / "log"))
    row = spark.read.parquet(str(tmp_path / "log")).first()
    assert row["query_hash"].startswith("8f434346648f6b96") and row["retrieval_k"] == 5 and "q" not in row.asDict()


def test_embedding_provider_gets_batches_in_order(spark):
    def lengths(texts):
        assert len(texts) <= 100
        return [[float(len(t)), float(len(texts))] for t in texts]

    df = spark.range(450).select("id", F.repeat(F.lit("x"), (F.col("id") % 9).cast("int")).alias("content")).coalesce(1)
    rows = embed_chunks(df, lengths, dim=2).collect()
    assert all(r["embedding"][0] == r["id"] % 9 for r in rows) and max(r["embedding"][1] for r in rows) == 100


def _file(i, name, body, strategy="auto", sensitive=False):
    return (i, "p", "o", strategy, name, None, sensitive, body.encode())


FILES = (
    "document_id long, pipeline_id string, organization_id string, chunking_strategy string, filename string,"
    " mime_type string, sensitive boolean, bytes binary"
)


def test_ingest_all_formats(spark):
    files = spark.createDataFrame(
        [
            _file(1, "a.txt", "One para.\n\nTwo with jo@example.com."),
            _file(2, "b.csv", "Widget,Stock\n" + "".join(f"Widget {i},{i}\n" for i in range(12))),
            _file(3, "c.html", "<p>Hello</p><ul><li>x</li></ul>", "hierarchical"),
            _file(4, "v.youtube", '[{"text": "hi", "start": 0, "duration": 2}]'),
            _file(5, "d.pdf", "binary"),
            _file(6, "e.txt", "  \n "),
            _file(7, "f.txt", "secret", sensitive=True),
        ],
        FILES,
    )
    replies = spark.createDataFrame([(7, 0, '{"masked_text": "[PII]", "extra_pii_count": 1}')], "document_id long, block_no int, reply string")
    out = ingest(files, replies=replies, dim=16)
    summary = {r["document_id"]: (r["status"], r["chunk_count"], r["pii_entities"]) for r in out.summary.collect()}
    assert summary == {
        1: ("completed", 1, 1), 2: ("completed", 2, 0), 3: ("completed", 4, 0), 4: ("completed", 1, 0),
        5: ("failed", None, None), 6: ("failed", None, None), 7: ("completed", 1, 1),
    }
    chunks = out.chunks.collect()
    csv = sorted((r["chunk_index"], r["content"]) for r in chunks if r["document_id"] == 2)
    assert "Widget 11" in csv[1][1] and [r["source_type"] for r in chunks if r["document_id"] == 2] == ["table", "table"]
    assert any("[EMAIL]" in r["content"] for r in chunks) and all(len(r["embedding"]) == 16 for r in chunks)
    assert {r["resource_id"] for r in out.audit.collect()} == {1, 2, 3, 4, 7}
    with_pdf = ingest(files, parsers={"pdf": lambda raw, name: F.when(raw.isNotNull(), F.array(F.struct(
        F.lit("text").alias("type"), raw.cast("string").alias("content"), F.lit(1).alias("page_number"),
        name.alias("media_path"), F.create_map(F.lit("a"), F.lit("b")).alias("metadata"))))}, dim=16)
    assert with_pdf.summary.where("document_id = 5").first()["status"] == "completed"


def test_store_replaces_by_key(spark, tmp_path):
    schema = "document_id long, chunk_index int, content string"
    store = KeyedStore(spark, str(tmp_path / "t"), spark.createDataFrame([], schema).schema, buckets=4)
    first = spark.createDataFrame([(i, j, f"{i}.{j}") for i in range(9) for j in range(3)], schema)
    store.replace(first)
    store.replace(first)
    assert store.read().count() == 27
    store.replace(spark.createDataFrame([(4, 0, "new")], schema))
    assert sorted(r["content"] for r in store.read().where("document_id = 4").collect()) == ["new"]
    everyone = store.read().select("document_id").distinct()
    store.replace(spark.createDataFrame([], schema), everyone)
    assert store.read().count() == 0


def test_iterative_search(spark):
    vec = {"a": [1.0, 0.0], "b": [0.0, 1.0], "c": [0.7, 0.7]}
    rows = [(f"{n}{i}", "p", f"d{n}", f"{n} word{i}", v, 1, i, "text", None) for n, v in vec.items() for i in range(3)]
    chunks = spark.createDataFrame(
        rows, "chunk_id string, pipeline_id string, document_id string, content string, embedding array<double>,"
        " page_number int, chunk_index int, source_type string, media_path string",
    )
    from tidewell.operators.postings import build_postings

    docs = spark.createDataFrame([("d" + n, "p", n + ".txt") for n in vec], "document_id string, pipeline_id string, filename string")
    corpus = search.Corpus(chunks, build_postings(chunks, keep=["pipeline_id"]), docs)
    queries = spark.createDataFrame(
        [(1, "p", "none", [1.0, 0.0], 2), (2, "p", "none", [1.0, 0.0], 2), (3, "p", "none", [1.0, 0.0], 20)],
        "query_id int, pipeline_id string, q string, q_embedding array<double>, top_k int",
    )
    decisions = spark.createDataFrame(
        [
            (1, 1, '{"decision": "answer"}', None),
            (2, 1, '{"decision": "search", "search_query": "b"}', [0.0, 1.0]),
            (3, 1, '{"decision": "read", "filename": "b.txt"}', None),
        ],
        "query_id int, step int, reply string, reply_embedding array<double>",
    )
    out = search.iterative_search(queries, corpus, decisions).orderBy("query_id", "new_rank").collect()
    steps = {r["query_id"]: r["steps"] for r in out}
    assert steps == {1: 1, 2: 2, 3: 2}
    assert [r["chunk_id"] for r in out if r["query_id"] == 1] == ["a0", "a1"]
    assert {r["chunk_id"]: r["rrf_score"] for r in out if r["query_id"] == 3}["b1"] == 0.5
    found = search.iterative_batch(queries, corpus, decisions)
    rows = found.hits.orderBy("query_id", "rank").collect()
    assert [(r["query_id"], r["chunk_id"], r["rank"], r["steps"]) for r in rows] == [(r["query_id"], r["chunk_id"], r["new_rank"], r["steps"]) for r in out]
    assert {(r["chunk_id"][0] + ".txt", r["content"].split()[0]) for r in rows} == {(r["filename"], r["chunk_id"][0]) for r in rows}
    contexts = {r["query_id"]: r["context"] for r in found.contexts.collect()}
    assert contexts[1] == "[1] (file: a.txt) a word0\n\n[2] (file: a.txt) a word1" and "(file: b.txt) b word1" in contexts[3]
    logs = {r["query_id"]: (r["chunks_retrieved"], r["retrieval_k"], r["rerank_applied"], r["hyde_applied"]) for r in found.logs.collect()}
    assert logs == {q: (sum(r["query_id"] == q for r in out), k, True, False) for q, k in ((1, 2), (2, 2), (3, 20))}


def test_reading_a_long_file_meets_each_query_with_its_first_chunks(spark):
    """Without scores the rows stay few per query, and the lists are those of the whole file."""
    from tidewell.operators.postings import build_postings

    rows = [(i, 0, i, f"word{i}", [1.0, i / 400], i % 7) for i in range(400)]
    chunks = spark.createDataFrame(rows, "chunk_id int, pipeline_id int, document_id int, content string, embedding array<double>, chunk_index int")
    docs = spark.createDataFrame([(i, 0, "long" if i % 2 else "else") for i in range(400)], "document_id int, pipeline_id int, filename string")
    queries = spark.createDataFrame([(q, 0, "none", [1.0, q / 60], 1 + q % 4) for q in range(60)], "query_id int, pipeline_id int, q string, q_embedding array<double>, top_k int")
    requests = queries.select("query_id", "pipeline_id", F.lit("long").alias("filename"), "top_k")
    had = spark.createDataFrame([(q, c) for q in range(60) for c in (399, 398)], "query_id int, chunk_id int")
    got = fusion.first_of_files(requests, had, chunks.drop("pipeline_id"), docs).collect()
    order = sorted((i for i in range(400) if i % 2), key=lambda i: (i % 7, i))
    for q in range(60):
        want = {*order[: 2 * (1 + q % 4)], 399}
        assert {(r["chunk_id"], r["rank"], r["rrf_score"]) for r in got if r["query_id"] == q} == {(c, c % 7 + 1, 0.5) for c in want}
    decisions = queries.select("query_id", F.lit(1).alias("step"), F.lit('{"decision": "read", "filename": "long"}').alias("reply"), "q_embedding")
    decisions = decisions.withColumnRenamed("q_embedding", "reply_embedding")
    corpus = search.Corpus(chunks, build_postings(chunks, keep=["pipeline_id"]), docs)
    none = spark.createDataFrame([], "query_id int, chunk_id int, relevance double")
    few, whole = (search.iterative_search(queries, corpus, decisions, scores).drop("score") for scores in (None, none))
    assert sorted(map(tuple, few.collect())) == sorted(map(tuple, whole.collect()))


def test_expansion_keeps_four_with_own_query_first(spark):
    queries = spark.createDataFrame([(1, "p", "q", [1.0])], "query_id int, pipeline_id string, q string, q_embedding array<double>")
    more = spark.createDataFrame([(1, i, f"e{i}", [1.0]) for i in range(5)], "query_id int, pos int, q string, q_embedding array<double>")
    got = search.expand_queries(queries, more).orderBy("list_no").collect()
    assert [r["q"] for r in got] == ["q", "e0", "e1", "e2"]
    same = spark.createDataFrame([(1, 0, "e0", [1.0]), (1, 1, "q", [1.0])], more.schema)
    assert [r["q"] for r in search.expand_queries(queries, same).orderBy("list_no").collect()] == ["e0", "q"]


def test_json_containment_by_type(spark):
    from tidewell.operators.filters import json_contains

    doc = '{"n": 42, "s": "42", "f": 1.0, "z": null, "b": true, "a.b": 1, "it\'s": 2, "l": [{"k": 1, "m": 2}, "x", null], "o": {"p": {"q": "r"}}}'
    yes = [{"n": 42}, {"n": 42.0}, {"s": "42"}, {"f": 1}, {"f": 1.0}, {"z": None}, {"b": True}, {"a.b": 1}, {"it's": 2},
           {"l": [{"k": 1}]}, {"l": ["x", None]}, {"o": {"p": {}}}, {"o": {"p": {"q": "r"}}}, {}]
    no = [{"n": "42"}, {"s": 42}, {"z": "null"}, {"missing": None}, {"b": "true"}, {"b": 1}, {"l": ["k"]}, {"l": [{"k": 2}]},
          {"l": [{"k": 1, "m": 1}]}, {"o": {"p": "r"}}, {"n": [42]}, {"n": {}}]
    df = spark.createDataFrame([(doc,), ("not json",)], "d string")
    cols = [json_contains(F.col("d"), w).alias(f"c{i}") for i, w in enumerate(yes + no)]
    good, broken = (tuple(r) for r in df.select(*cols).collect())
    assert good == (True,) * len(yes) + (False,) * len(no)
    assert broken == (False,) * (len(yes) - 1) + (True,) + (False,) * len(no)


def test_a_top_k_column_is_not_cut(spark):
    hits = spark.range(50).select(F.lit(1).alias("query_id"), F.col("id").alias("chunk_id"), (F.col("id") + 1).alias("rank"), F.lit(40).alias("k"))
    scores = hits.select("query_id", "chunk_id", (-F.col("chunk_id")).cast("double").alias("relevance"))
    assert fusion.rerank_topk(hits, scores, "k").count() == 40


def test_running_sum_keeps_null_keys(spark):
    df = spark.createDataFrame([(None, 1), (None, 2), ("a", None), ("a", 1)], "k string, o int")
    out = ordered.running_sum(df, ["k"], ["o"], F.lit(1), F.floor(F.col("o") / 8), "s").collect()
    assert sorted((r["k"] or "", r["o"] or 0, r["s"]) for r in out) == [("", 1, 1), ("", 2, 2), ("a", 0, 1), ("a", 1, 2)]


def test_failing_files_are_rows(spark):
    files = spark.createDataFrame(
        [
            _file(1, "a.txt", "One text."), _file(2, "b.html", "<![foo bar]><p>x</p>"), _file(3, "c.txt", "Two.", strategy="odd"),
            _file(4, "d.csv", "k,v\n1," + "x y " * 50_000), _file(5, "e.txt", " "),
        ],
        FILES,
    )
    from tidewell.plans.ingest import ingest

    got = {r["document_id"]: (r["status"], r["error"]) for r in ingest(files, dim=8).summary.collect()}
    assert got[1] == got[4] == ("completed", None)
    assert got[2][0] == "failed" and got[2][1].startswith("HTML: ")
    assert got[3] == ("failed", "unknown chunking strategy: odd")
    assert got[5] == ("failed", "No extractable text found in document.")


def test_positions_are_whole_unless_limits_are_asked(spark):
    from tidewell.operators.postings import build_postings

    df = spark.createDataFrame([(1, "zebra " * 300)], "chunk_id int, content string")
    sizes = [build_postings(df, positions=True, pg_limits=p).first()["positions"] for p in (False, True)]
    assert [len(s) for s in sizes] == [300, 256]


def test_short_lists_are_numbered_without_totals_of_buckets(spark):
    rows = [(q, c, r) for q in (1, 2, None) for r, c in enumerate("dbca", 1)]
    a = spark.createDataFrame(rows, "query_id int, chunk_id string, rank int")
    b = a.where("chunk_id > 'a'").withColumn("chunk_id", F.concat("chunk_id", F.lit("x")))
    merged = fusion.merge_first_wins([a, b])
    plan = merged._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and "Window" in plan
    cut = fusion.merge_first_wins([a, b], bucket_rows=2)
    order = ["query_id", "pos"]
    with_null = merged.where("query_id IS NULL").orderBy("pos").collect()
    assert [r["chunk_id"] for r in with_null] == ["d", "b", "c", "a", "dx", "bx", "cx"]
    assert merged.orderBy(*order).collect() == cut.orderBy(*order).collect()


def test_positions_are_gathered_text_by_text(spark):
    from collections import Counter

    from tidewell.operators.postings import build_postings

    long = " ".join(["a b"] * 300 + ["c"] * 16000 + ["a c"])
    texts = [(1, 7, "the A-b a"), (2, 7, None), (3, None, ""), (4, None, "x the x"), (5, 7, long), (5, 7, "c z"), (None, 1, "n n"), (None, 1, "n n")]
    chunks = spark.createDataFrame(texts, "chunk_id long, pipeline_id int, content string")
    for limits in (False, True):
        want, tf, sizes = {}, Counter(), {}
        for c, p, text in texts:
            found = (text or "").lower().replace("-", " ").split()
            for i, t in enumerate(found, 1):
                if t != "the":
                    want.setdefault((c, p, t), set()).add(min(i, 16383) if limits else i)
                    tf[c, p, t] += 1
                    sizes.setdefault((c, p, t), set()).add(len(found))
        for repeats in (True, False):
            some = chunks if repeats else chunks.where("chunk_id <= 4")
            built = build_postings(some, keep=["pipeline_id"], stop_words=["the"], positions=True, pg_limits=limits)
            got = {(r["chunk_id"], r["pipeline_id"], r["term"]): r for r in built.collect()}
            assert len(got) == built.count() and set(got) == {k for k in want if repeats or (k[0] or 9) <= 4}
            for k, r in got.items():
                assert r["positions"] == sorted(want[k])[: 256 if limits else None] and r["tf"] == tf[k] and r["n_terms"] in sizes[k]
            # No row is made per occurrence of a term, and nothing is put together where no chunk comes twice.
            plan = built._jdf.queryExecution().optimizedPlan().toString()
            assert "Generate" not in plan and ("Aggregate" in plan) == repeats
