"""Search options, optimisation rounds and source sync on small tables."""

from __future__ import annotations

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from tidewell import constants as K
from tidewell.operators.postings import build_postings
from tidewell.plans import optimise, search, sync


@pytest.fixture(scope="module")
def corpus(spark):
    vec = {"a": [1.0, 0.0], "b": [0.0, 1.0], "c": [0.7, 0.7]}
    rows = [
        (f"{n}{i}", "p", f"d{n}", f"{n} word{i}", v, 1, i, "text", None, {"kind": n}) for n, v in vec.items() for i in range(3)
    ]
    chunks = spark.createDataFrame(
        rows,
        "chunk_id string, pipeline_id string, document_id string, content string, embedding array<double>,"
        " page_number int, chunk_index int, source_type string, media_path string, metadata map<string,string>",
    )
    docs = spark.createDataFrame(
        [("d" + n, "p", n + ".txt") for n in vec], "document_id string, pipeline_id string, filename string"
    )
    return search.Corpus(chunks, build_postings(chunks, keep=["pipeline_id"]), docs)


QUERY = "query_id int, pipeline_id string, q string, q_embedding array<double>, top_k int"


def test_scores_order_and_degrade(spark, corpus):
    queries = spark.createDataFrame([(1, "p", "word1", [1.0, 0.0], 2), (2, "p", "word1", [1.0, 0.0], 2)], QUERY)
    scores = spark.createDataFrame(
        [(1, "b1", 0.9), (1, "c1", 0.95)], "query_id int, chunk_id string, relevance double"
    )
    found = search.search_batch(queries, corpus, scores=scores)
    hits = {(r["query_id"], r["rank"]): (r["chunk_id"], r["score"]) for r in found.hits.collect()}
    assert hits[1, 1] == ("c1", 0.95) and hits[1, 2] == ("b1", 0.9)
    # Without any score the fused order stays and the fused score is shown.
    assert hits[2, 1][0] == "a1" and hits[2, 1][1] == pytest.approx(2 / (K.RRF_K + 1), abs=0.001)
    contexts = {r["query_id"]: r["context"] for r in found.contexts.collect()}
    assert contexts[1] == "[1] c word1\n\n[2] b word1"
    log = found.logs.where("query_id = 1").first()
    assert (log["retrieval_k"], log["chunks_retrieved"], log["rerank_applied"]) == (2, 9, True)


def test_filter_and_method(spark, corpus):
    queries = spark.createDataFrame([(1, "p", "word2", [1.0, 0.0], 20)], QUERY)
    only_b = search.search_batch(queries, corpus, metadata_filter={"kind": "b"})
    assert {r["chunk_id"] for r in only_b.hits.collect()} == {"b0", "b1", "b2"}
    dense = search.search_batch(queries, corpus, method="dense").hits.where("rank = 1").first()
    assert dense["chunk_id"] == "a0"


def test_rewrite_only_for_unclear_queries(spark):
    long = "tell me everything there is about the word two and also three, four and five"
    queries = spark.createDataFrame([(1, "p", "word1", [1.0, 0.0], 2), (2, "p", long, [1.0, 0.0], 2)], QUERY)
    rewrites = spark.createDataFrame(
        [(1, "x", [0.0, 1.0]), (2, " word2 ", [0.0, 1.0])], "query_id int, rewritten string, rewritten_embedding array<double>"
    )
    got = {r["query_id"]: (r["q"], r["q_embedding"], r["rewrite_applied"]) for r in search.rewrite_queries(queries, rewrites).collect()}
    assert got == {1: ("word1", [1.0, 0.0], False), 2: ("word2", [0.0, 1.0], True)}


def test_hyde_adds_hits_for_weak_queries_only(spark, corpus):
    queries = spark.createDataFrame([(1, "p", "none", [1.0, 0.0], 3), (2, "p", "none", [1.0, 0.0], 3)], QUERY)
    passages = spark.createDataFrame([(1, [0.0, 1.0]), (2, [0.0, 1.0])], "query_id int, passage_embedding array<double>")
    strong = spark.createDataFrame(
        [(2, f"a{i}", 0.9 - i / 100) for i in range(3)], "query_id int, chunk_id string, relevance double"
    )
    found = search.search_batch(queries, corpus, scores=strong, passages=passages, method="hybrid_hyde")
    hits = {(r["query_id"], r["rank"]): r["chunk_id"] for r in found.hits.collect()}
    assert [hits[1, i] for i in range(1, 6)] == ["a0", "a1", "a2", "b0", "b1"]
    assert [hits[2, i] for i in range(1, 4)] == ["a0", "a1", "a2"] and (2, 4) not in hits
    flags = {r["query_id"]: r["hyde_applied"] for r in found.logs.collect()}
    assert flags == {1: True, 2: False}


def test_optimisation_rounds(spark):
    runs = spark.createDataFrame(
        [
            (1, "p1", {"top_k": "5"}, "human_in_loop"),  # blocked
            (2, "p2", {"top_k": "5"}, "human_in_loop"),  # good at once
            (3, "p3", {"top_k": "5"}, "human_in_loop"),  # top_k variant, then deployed
            (4, "p4", {"top_k": "5"}, "human_in_loop"),  # variant waits for approval
            (5, "p5", {"top_k": "5"}, "auto"),  # never good enough
            (6, "p6", {"top_k": "5"}, "mandatory_gate"),  # drifts although eligible
        ],
        "run_id int, pipeline_id string, config map<string,string>, approval_mode string",
    )

    def evaluate(rows, turn):
        top_k = F.col("config")["top_k"].cast("int")
        score = (
            F.when(F.col("run_id") == 1, 0.3)
            .when(F.col("run_id") == 2, 0.8)
            .when((F.col("run_id") == 3) & (top_k > 5), 0.8)
            .when(F.col("run_id") == 6, 0.75)
            .otherwise(0.65)
        )
        hints = F.when(F.col("run_id") == 4, F.array(F.lit(K.HINT_PRECISION))).otherwise(F.array(F.lit(K.HINT_RECALL)))
        return rows.select(
            "run_id", score.alias("unified_score"), F.lit(0.9).alias("faithfulness"),
            (score >= 0.72).alias("deploy_eligible"), hints.alias("diagnosis"),
        )

    history = spark.createDataFrame(
        [("p6", 90 + i, datetime(2024, 1, 1 + i), 0.9) for i in range(3)],
        "pipeline_id string, run_id int, created_at timestamp_ntz, unified_score double",
    )
    deployments = spark.createDataFrame(
        [(7, "p3", 0, datetime(2024, 1, 1), "active", None, 0.7)],
        "deployment_id long, pipeline_id string, run_id int, activated_at timestamp_ntz, status string,"
        " previous_deployment long, unified_score double",
    )
    out = optimise.evaluate_and_decide(runs, evaluate, history, deployments, max_rounds=2)
    got = {r["run_id"]: (r["outcome"], r["rounds"], r["step"]) for r in out.runs.collect()}
    assert got == {
        1: ("ended", 1, "END"), 2: ("ended", 1, "observer"), 3: ("deployed", 2, "deployer"),
        4: ("ended", 1, "improver"), 5: ("stopped", 2, "improver"), 6: ("ended", 1, "observer"),
    }
    experiments = {r["run_id"]: (r["improvement_type"], r["approval_tier"]) for r in out.experiments.collect()}
    assert experiments == {4: (K.HINT_PRECISION, "human_in_loop"), 6: (K.HINT_RECALL, "mandatory_gate")}
    table = {r["run_id"]: (r["status"], r["previous_deployment"]) for r in out.deployments.collect()}
    assert table == {0: ("superseded", None), 3: ("active", 7)}


def test_sync(spark):
    listing = spark.createDataFrame([("u1",), ("u2",)], "source_id string")
    docs = spark.createDataFrame([(1, "u1", 5), (2, "u9", 5), (3, "u8", 6)], "document_id int, source_id string, connector_id int")
    connectors = spark.createDataFrame([(5, "error", None), (6, "error", None)], "connector_id int, status string, last_synced_at timestamp")
    out = sync.sync_source(listing, docs, connectors, 5, datetime(2024, 1, 1))
    assert [r["source_id"] for r in out.to_ingest.collect()] == ["u2"]
    assert [r["document_id"] for r in out.to_delete.collect()] == [2]
    assert sorted(r["document_id"] for r in out.documents.collect()) == [1, 3]
    state = {r["connector_id"]: (r["status"], r["last_synced_at"] is not None) for r in out.connectors.collect()}
    assert state == {5: ("active", True), 6: ("error", False)}


def test_file_stream_ingests_each_file_once(spark, tmp_path):
    from tidewell.plans.ingest import ingest
    from tidewell.plans.store import KeyedStore
    from tidewell.sources.files import read_files, stream_files
    from tidewell.streaming.jobs import ingest_stream

    folder = tmp_path / "in"
    folder.mkdir()

    def described(files):
        return files.select(
            F.xxhash64("path").alias("document_id"), F.lit("p").alias("pipeline_id"), F.lit("o").alias("organization_id"),
            F.lit("auto").alias("chunking_strategy"), "filename", F.lit(None).cast("string").alias("mime_type"),
            F.lit(False).alias("sensitive"), "bytes", "modified",
        )

    (folder / "a.txt").write_text("One text.")
    (folder / "b.csv").write_text("k,v\n1,2")
    schema = ingest(described(read_files(spark, str(folder))), dim=8).chunks.schema
    store = KeyedStore(spark, str(tmp_path / "chunks"), schema, buckets=4)
    for extra in (None, "c.html"):
        if extra:
            (folder / extra).write_text("<p>Late page</p>")
        ingest_stream(described(stream_files(spark, str(folder))), store, str(tmp_path / "ckpt"), dim=8).awaitTermination()
    streamed = sorted(r["content"] for r in store.read().collect())
    batch = sorted(r["content"] for r in ingest(described(read_files(spark, str(folder))), dim=8).chunks.collect())
    assert streamed == batch == ["Late page", "One text.", "| k | v |\n| --- | --- |\n| 1 | 2 |"]


def test_stored_index_prunes_and_follows_documents(spark, tmp_path):
    from tidewell.operators.postings import bm25, build_postings
    from tidewell.plans.term_index import TermIndex

    texts = ["red fish swims", "blue fish sleeps", "red bird sings", "green tree"]
    chunks = spark.createDataFrame([(i, i, 1, t) for i, t in enumerate(texts)], "chunk_id int, document_id int, pipeline_id int, content string")
    queries = spark.createDataFrame([(1, 1, "red fish"), (2, 1, "fish"), (3, 1, "tree"), (4, 1, "fish")], "query_id int, pipeline_id int, q string")
    index = TermIndex(spark, str(tmp_path / "index"), buckets=64, document_buckets=4)

    def ranked(source):
        return sorted((r["query_id"], r["rnk"], r["chunk_id"], round(r["kw_score"], 9)) for r in bm25(queries, source, 10).collect())

    index.replace(chunks)
    assert ranked(index) == ranked(build_postings(chunks, keep=["pipeline_id"]))
    changed = spark.createDataFrame([(10, 0, 1, "old tree")], chunks.schema)
    index.replace(changed)
    index.delete(chunks.where("document_id = 1").select("document_id"))
    now = chunks.where("document_id > 1").unionByName(changed)
    want = ranked(build_postings(now, keep=["pipeline_id"]))
    assert ranked(index) == want and [w[2] for w in want if w[0] == 3] == [3, 10]
    plan = index.lookup(queries.select("pipeline_id", F.lit("tree").alias("term")).distinct())._jdf.queryExecution().toString()
    assert "term_bucket" in plan.split("PartitionFilters: ")[1][:80]
    index.compact()
    assert ranked(index) == want


def test_store_reads_touched_buckets_only(spark, tmp_path):
    from tidewell.plans.store import KeyedStore

    df = spark.range(100).select(F.col("id").alias("document_id"), F.lit("a").alias("v"))
    store = KeyedStore(spark, str(tmp_path / "s"), df.schema, buckets=16)
    store.replace(df)
    store.replace(df.where("document_id = 7").withColumn("v", F.lit("b")))
    assert store.read().where("v = 'b'").count() == 1 and store.read().count() == 100
    part = store.read(df.where("document_id = 7"))
    assert [tuple(r) for r in part.collect()] == [(7, "b")]
    assert "key_bucket" in part._jdf.queryExecution().toString().split("PartitionFilters: ")[1][:80]


def test_runs_without_a_score_stay_in_the_outcome(spark):
    runs = spark.createDataFrame([(1, "p", {"top_k": "5"}, "auto"), (2, "p", {"top_k": "18"}, "auto")], "run_id int, pipeline_id string, config map<string,string>, approval_mode string")

    def evaluate(rows, turn):
        return rows.where("run_id = 2").select(
            "run_id", F.lit(0.7).alias("unified_score"), F.lit(0.9).alias("faithfulness"), F.lit(False).alias("deploy_eligible"), F.array(F.lit(K.HINT_RECALL)).alias("diagnosis")
        )

    history = spark.createDataFrame([], "pipeline_id string, run_id int, created_at timestamp_ntz, unified_score double")
    deployments = spark.createDataFrame([], "deployment_id long, pipeline_id string, run_id int, activated_at timestamp_ntz, status string, previous_deployment long, unified_score double")
    out = optimise.evaluate_and_decide(runs, evaluate, history, deployments)
    assert {r["run_id"]: (r["outcome"], r["rounds"]) for r in out.runs.collect()} == {1: ("unscored", 1), 2: ("stopped", 2)}


def test_optimised_runs_go_on_to_the_fixed_point(spark, monkeypatch):
    from tidewell.catalog import jobs

    seen, decide = [], optimise.evaluate_and_decide

    def kept(*args, **kwargs):
        seen.append(decide(*args, **kwargs))
        return seen[-1]

    monkeypatch.setattr(jobs.optimise, "evaluate_and_decide", kept)
    jobs.optimised_runs(spark, "/root/testdata/sf0.001")
    rows = seen[0].runs.select("run_id", "rounds", "outcome", "config").collect()
    assert len({r["run_id"] for r in rows}) == len(rows) and max(r["rounds"] for r in rows) > 3
    assert {r["config"]["top_k"] for r in rows if r["outcome"] == "stopped"} <= {str(K.MAX_TOP_K)}


def test_sources_normalise_a_text_once_however_often_it_is_hit(spark, corpus):
    top = spark.createDataFrame(
        [(q, c, 1, 0.0, 0.5) for q in (1, 2, 3) for c in ("a0", "b0")],
        "query_id int, chunk_id string, new_rank int, score double, rrf_score double",
    )
    found = search.attach_sources(top, corpus)
    assert found.count() == 6 and found.columns[:2] == ["query_id", "chunk_id"]
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Join") < plan.index("regexp_replace")


def test_the_history_of_scores_is_read_once_for_all_rounds(spark, monkeypatch):
    schema = "run_id int, pipeline_id string, config map<string,string>, approval_mode string"
    runs = spark.createDataFrame([(1, "p", {"top_k": "5"}, "human_in_loop")], schema)
    history = spark.createDataFrame(
        [("p", 90 + i, datetime(2024, 1, 1 + i), 0.5) for i in range(3)],
        "pipeline_id string, run_id int, created_at timestamp_ntz, unified_score double",
    )
    deployments = spark.createDataFrame(
        [], "deployment_id long, pipeline_id string, run_id int, activated_at timestamp_ntz, status string,"
        " previous_deployment long, unified_score double",
    )

    def evaluate(rows, turn):
        return rows.select(
            "run_id", F.lit(0.55 + 0.1 * turn).alias("unified_score"), F.lit(0.9).alias("faithfulness"),
            F.lit(turn > 1).alias("deploy_eligible"), F.array(F.lit(K.HINT_RECALL)).alias("diagnosis"),
        )

    calls, real = [], optimise.drift.score_drift
    monkeypatch.setattr(optimise.drift, "score_drift", lambda *a: calls.append(1) or real(*a))
    out = optimise.evaluate_and_decide(runs, evaluate, history, deployments)
    assert [(r["outcome"], r["rounds"]) for r in out.runs.collect()] == [("deployed", 2)]
    assert len(calls) == 1


def test_a_batch_of_files_is_chosen_once_and_leaves_no_tables(spark, tmp_path, monkeypatch):
    from pathlib import Path

    from tidewell.catalog.jobs import document_files, files_per_batch
    from tidewell.plans import ingest
    from tidewell.plans.store import KeyedStore
    from tidewell.session import ensure_checkpoint_dir
    from tidewell.streaming.jobs import ingest_stream

    # The number of batches does not follow that of the files, up to four files a core.
    assert [-(-n // files_per_batch(n, 6)) for n in (8, 13, 128, 768)] == [8, 7, 8, 32]
    docs = spark.createDataFrame([(i % 12, f"text {i % 12}", "en", "s") for i in range(13)], "doc_id long, text string, lang string, source string")
    docs.write.parquet(str(tmp_path / "in"))
    shown = []
    whole = ingest.ingest
    monkeypatch.setattr(ingest, "ingest", lambda files, **o: shown.append(files._jdf.queryExecution().analyzed().toString()) or whole(files, **o))
    ensure_checkpoint_dir(spark)
    kept = Path(spark.sparkContext.getCheckpointDir().removeprefix("file:"))
    before = set(kept.iterdir())
    store = KeyedStore(spark, str(tmp_path / "c"), whole(document_files(docs.limit(0)), dim=8).chunks.schema)
    between = set(kept.iterdir())
    stream = document_files(spark.readStream.schema(docs.schema).parquet(str(tmp_path / "in")))
    ingest_stream(stream, store, str(tmp_path / "ckpt"), summary_path=str(tmp_path / "s"), dim=8).awaitTermination()
    assert len(between) > len(before) and set(kept.iterdir()) == between
    assert shown and not any("Aggregate" in plan for plan in shown)
    assert store.read().count() == 10 and spark.read.parquet(str(tmp_path / "s")).count() == 12


def test_an_expanded_search_is_made_once_per_list(spark, corpus, monkeypatch):
    queries = spark.createDataFrame([(1, "p", "none", [1.0, 0.0], 3), (2, "p", "word1", [0.0, 1.0], 3)], QUERY)
    expansions = spark.createDataFrame([(1, 0, "word2", [0.0, 1.0])], "query_id int, pos int, q string, q_embedding array<double>")
    passages = spark.createDataFrame([(1, [0.0, 1.0]), (2, [1.0, 0.0])], "query_id int, passage_embedding array<double>")
    searched = []
    whole = search.fusion.hybrid_search
    monkeypatch.setattr(search.fusion, "hybrid_search", lambda asked, *a, **o: searched.append((asked, whole(asked, *a, **o))) or searched[-1][1])
    merged = []
    join = search.fusion.hyde_merge
    monkeypatch.setattr(search.fusion, "hyde_merge", lambda top, extra: merged.append((top, extra)) or join(top, extra))
    found = search.search_batch(queries, corpus, expansions=expansions, passages=passages, method="hybrid_hyde")
    assert {(r["query_id"], r["rank"]) for r in found.hits.collect()} == {(q, n) for q in (1, 2) for n in range(1, 6)}

    def operators(df):
        return [n for n in df._jdf.queryExecution().optimizedPlan().toString().split() if n in ("Join", "Aggregate", "Window", "MapInArrow")]

    # What is searched, and both lists that are merged, are read from written tables.
    assert len(searched) == 2 and not any(operators(asked) for asked, _ in searched)
    assert len(merged) == 1 and not any(operators(x) for x in merged[0])


def test_contexts_normalise_a_text_once_however_often_it_is_hit(spark, corpus):
    tops = [(q, c, 0.1, 0.0, r) for q in range(20) for r, c in enumerate(("a0", "b1"), 1)]
    top = spark.createDataFrame(tops, "query_id int, chunk_id string, rrf_score double, score double, new_rank int")
    plan = search.contexts(top, corpus)._jdf.queryExecution().optimizedPlan().toString().splitlines()
    places = [i for i, line in enumerate(plan) if "regexp_replace" in line]
    # Below the join that gives each query its texts, and nowhere else.
    joins = [i for i, line in enumerate(plan) if "Join " in line]
    assert len(places) == 1 and joins[0] < places[0]
    for named in (False, True):
        got = {r["query_id"]: r["context"] for r in search.contexts(top, corpus, named).collect()}
        file = ("(file: a.txt) ", "(file: b.txt) ") if named else ("", "")
        assert got == {q: f"[1] {file[0]}a word0\n\n[2] {file[1]}b word1" for q in range(20)}


def test_an_iterative_search_ends_when_every_query_answers(spark, corpus, monkeypatch):
    queries = spark.createDataFrame([(1, "p", "word1", [1.0, 0.0], 2), (2, "p", "word2", [0.0, 1.0], 2)], QUERY)
    search_on = '{"decision": "search", "search_query": "word0"}'
    searched = []
    whole = search.retrieve
    monkeypatch.setattr(search, "retrieve", lambda *a, **o: searched.append(1) or whole(*a, **o))
    schema = "query_id int, step int, reply string, reply_embedding array<double>"
    # (replies, searches made, steps of each query)
    cases = [
        ([(1, 1, '{"decision": "answer"}', None)], 1, {1: 1, 2: 1}),
        ([(1, 1, search_on, [0.0, 1.0])], 2, {1: 2, 2: 1}),
        ([(1, 1, search_on, [0.0, 1.0]), (1, 2, search_on, [0.7, 0.7])], 3, {1: 2, 2: 1}),
    ]
    for replies, times, steps in cases:
        searched.clear()
        out = search.iterative_search(queries, corpus, spark.createDataFrame(replies, schema)).collect()
        assert len(searched) == times and {r["query_id"]: r["steps"] for r in out} == steps
        assert sorted((r["query_id"], r["new_rank"]) for r in out) == [(1, 1), (1, 2), (2, 1), (2, 2)]
