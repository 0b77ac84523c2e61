"""End-to-end jobs and streams over the given tables."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from tidewell import constants as K
from tidewell.catalog import fixtures as fx
from tidewell.catalog import parsing, retrieval, scoring, texts, upkeep
from tidewell.catalog.registry import query
from tidewell.operators import postings
from tidewell.operators.embedding import embed_chunks
from tidewell.plans import optimise, search, sync
from tidewell.plans.ingest import ingest
from tidewell.plans.store import KeyedStore
from tidewell.session import ensure_checkpoint_dir, materialise
from tidewell.sources import csv_lines
from tidewell.streaming import jobs as streams
from tidewell.streaming.drift import drift_stream


def scratch(spark) -> str:
    """A new folder beside the checkpoints, which all executors share."""
    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/run-{uuid.uuid4().hex}"


def document_files(docs):
    """The documents as raw files, kinds by language; one in eleven blank."""
    body = F.when(F.col("doc_id") % 11 == 0, F.lit(" \n ")).otherwise(F.col("text"))
    return docs.select(
        F.col("doc_id").alias("document_id"),
        F.col("lang").alias("pipeline_id"),
        F.lit("org").alias("organization_id"),
        F.when(F.col("lang") == "de", "hierarchical").otherwise("auto").alias("chunking_strategy"),
        F.concat("source", F.lit(".txt")).alias("filename"),
        F.lit(None).cast("string").alias("mime_type"),
        F.lit(False).alias("sensitive"),
        F.encode(body, "UTF-8").alias("bytes"),
    )


def _files(spark, sf):
    return document_files(fx.table(spark, sf, "documents"))


_INGESTED = texts._mask_sql() + f"""
SELECT doc_id AS document_id, CASE WHEN doc_id % 11 = 0 THEN 'failed' ELSE 'completed' END AS status,
       CASE WHEN doc_id % 11 <> 0 THEN CAST({texts._TOTAL} AS BIGINT) END AS pii_entities,
       CASE WHEN doc_id % 11 = 0 THEN 'No extractable text found in document.' END AS error FROM m5"""


@query("ingested_documents", _INGESTED)
def ingested_documents(spark, sf):
    return ingest(_files(spark, sf), dim=64).summary.drop("chunk_count")


def _masked(name: str, where: str) -> str:
    """The masked, non-blank documents of one kind under the columns of the chunk SQL."""
    return f"{name} AS (SELECT doc_id, t AS text, 'x' AS source FROM m5 WHERE doc_id % 11 <> 0 AND {where})"


# Masked documents cut by line: hierarchical where German, else packed.
_INGESTED_CHUNKS = (
    texts._mask_sql()
    + ","
    + _masked("packed", "lang <> 'de'")
    + ","
    + _masked("parted", "lang = 'de'")
    + " SELECT document_id, chunk_index, token_count, 'semantic' AS chunk_strategy, CAST(64 AS INTEGER) AS dim FROM ("
    + parsing._semantic_sql("chr(10)").replace("FROM documents", "FROM packed")
    + ") UNION ALL SELECT document_id, chunk_index, token_count, strategy, CAST(64 AS INTEGER) FROM ("
    + (parsing._HIERARCHY + " SELECT * FROM chunk").replace("FROM documents", "FROM parted")
    + ")"
)


@query("ingested_chunks", _INGESTED_CHUNKS)
def ingested_chunks(spark, sf):
    chunks = ingest(_files(spark, sf), dim=64, sep="\n").chunks
    return chunks.select("document_id", "chunk_index", "token_count", "chunk_strategy", F.size("embedding").alias("dim"))


@query(
    "embedded_documents",
    r"""
SELECT doc_id, CAST(64 AS INTEGER) AS dim, CASE WHEN len(regexp_extract_all(lower(text), '[\p{L}\p{Nd}]+')) > 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS length
FROM documents""",
)
def embedded_documents(spark, sf):
    docs = fx.table(spark, sf, "documents").withColumnRenamed("text", "content")
    vectors = embed_chunks(docs, dim=64)
    return vectors.select("doc_id", F.size("embedding").alias("dim"), F.round(F.aggregate(
        "embedding", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")), 4).alias("length"))


def corpus(spark, sf) -> search.Corpus:
    chunks = fx.chunks(spark, sf).withColumns(
        {
            "page_number": F.lit(1),
            "chunk_index": F.lit(0),
            "source_type": F.lit("text"),
            "media_path": F.lit(None).cast("string"),
        }
    )
    index = materialise(postings.build_postings(chunks, keep=["pipeline_id"]))
    documents = chunks.select("document_id", "pipeline_id", F.col("source").alias("filename"))
    return search.Corpus(chunks, index, documents)


def _queries(spark, sf):
    return fx.queries(spark, sf).withColumn("top_k", F.lit(K.DEFAULT_TOP_K))


_HITS = (
    "WITH " + retrieval._DENSE.replace("{cands}", "chunks") + "," + retrieval._keyword_sql(retrieval._BM25)
    + "," + retrieval._HYBRID
)


@query(
    "search_sources",
    _HITS + f"""
SELECT query_id, h.chunk_id, rank, round(rrf_score, 9) AS score, document_id, source AS filename, md5({texts._NORMAL}) AS content_md5
FROM hits h JOIN (SELECT *, content AS text FROM chunks) c ON c.chunk_id = h.chunk_id WHERE rank <= 5""",
)
def search_sources(spark, sf):
    found = search.search_batch(_queries(spark, sf), corpus(spark, sf))
    return found.hits.select(
        "query_id", "chunk_id", "rank", F.round("score", 9).alias("score"), "document_id", "filename",
        F.md5("content").alias("content_md5"),
    )


@query(
    "search_contexts",
    _HITS + f""",
scored AS (
  SELECT query_id, chunk_id, text, row_number() OVER (PARTITION BY query_id ORDER BY coalesce(quality, 0) DESC, rank, chunk_id) AS r
  FROM (SELECT query_id, h.chunk_id, rank, content AS text, quality, count(quality) OVER (PARTITION BY query_id) AS n
        FROM hits h LEFT JOIN labels l ON l.doc_id = h.chunk_id JOIN chunks c ON c.chunk_id = h.chunk_id)
  WHERE quality IS NOT NULL OR n = 0
)
SELECT query_id, md5(string_agg('[' || r || '] ' || {texts._NORMAL}, chr(10) || chr(10) ORDER BY r)) AS context_md5
FROM scored WHERE r <= 5 GROUP BY 1""",
)
def search_contexts(spark, sf):
    queries = _queries(spark, sf)
    labels = fx.table(spark, sf, "labels").select(
        F.col("doc_id").alias("chunk_id"), F.col("quality").cast("double").alias("relevance")
    )

    def scorer(pairs):
        return pairs.join(labels, "chunk_id").select("query_id", "chunk_id", "relevance")

    found = search.search_batch(queries, corpus(spark, sf), scores=scorer)
    return found.contexts.select("query_id", F.md5("context").alias("context_md5"))


@query(
    "search_log",
    _HITS + """
SELECT q.query_id, q.pipeline_id, sha256(array_to_string(qterms, ' ')) AS query_hash, false AS rewrite_applied, false AS hyde_applied,
       false AS compression_applied, CAST(5 AS INTEGER) AS retrieval_k, count(h.chunk_id) AS chunks_retrieved, count(h.chunk_id) > 0 AS rerank_applied
FROM query_text q LEFT JOIN hits h USING (query_id) GROUP BY 1, 2, 3""",
)
def search_log(spark, sf):
    return search.search_batch(_queries(spark, sf), corpus(spark, sf)).logs


def _model_tables(q):
    """Rewrites, expansions and passages made of neighbouring chunks of a pipeline."""
    shifted = q.select(
        (F.col("query_id") + 10).alias("query_id"), F.col("q").alias("other"), F.col("q_embedding").alias("other_embedding")
    )
    near = q.select("query_id").join(shifted, "query_id")
    expansions = near.select(
        "query_id", F.lit(0).alias("pos"), F.col("other").alias("q"), F.col("other_embedding").alias("q_embedding")
    )
    return expansions, near.select("query_id", F.col("other_embedding").alias("passage_embedding"))


@query("search_expanded")
def search_expanded(spark, sf):
    queries = _queries(spark, sf)
    expansions, passages = _model_tables(queries)
    found = search.search_batch(
        queries, corpus(spark, sf), expansions=expansions, passages=passages, method="hybrid_hyde"
    )
    return found.hits.select("query_id", "chunk_id", "rank", F.round("score", 9).alias("score"))


def _decisions(queries):
    """Of three queries one searches on with its neighbour's text, one reads a file, one answers."""
    expansions, _ = _model_tables(queries)
    kind = F.col("query_id") % 3
    ask = F.to_json(F.struct(F.lit("search").alias("decision"), F.col("q").alias("search_query")))
    read = F.to_json(F.struct(F.lit("read").alias("decision"), F.lit("src1").alias("filename")))
    return expansions.select(
        "query_id", F.lit(1).alias("step"),
        F.when(kind == 0, ask).when(kind == 1, read).otherwise('{"decision": "answer"}').alias("reply"),
        F.col("q_embedding").alias("reply_embedding"),
    )


@query("iterative_search")
def iterative_search(spark, sf):
    queries = _queries(spark, sf)
    out = search.iterative_search(queries, corpus(spark, sf), _decisions(queries))
    return out.select("query_id", "chunk_id", F.round("rrf_score", 9).alias("rrf_score"), "new_rank", "steps")


@query("iterative_sources")
def iterative_sources(spark, sf):
    queries = _queries(spark, sf)
    found = search.iterative_batch(queries, corpus(spark, sf), _decisions(queries))
    named = found.contexts.select("query_id", F.md5("context").alias("context_md5"))
    return found.hits.join(named, "query_id").select(
        "query_id", "chunk_id", "rank", F.round("score", 9).alias("score"), "document_id", "filename", "steps",
        F.md5("content").alias("content_md5"), "context_md5",
    )


@query("iterative_log")
def iterative_log(spark, sf):
    queries = _queries(spark, sf)
    return search.iterative_batch(queries, corpus(spark, sf), _decisions(queries)).logs


@query("optimised_runs")
def optimised_runs(spark, sf):
    """Every order a run; a variant gains a little on its round's score."""
    metrics = materialise(scoring._metrics(spark, sf))
    runs = fx.evaluations(spark, sf).select(
        "run_id", "pipeline_id", F.create_map(F.lit("top_k"), F.lit("5")).alias("config"),
        F.lit("human_in_loop").alias("approval_mode"),
    )

    def evaluate(rows, turn):
        from tidewell.functions import scoring as columns

        score = F.col("score") + 0.1 + 0.05 * (turn - 1)
        decision = columns.deploy_decision(score, F.col("faithfulness"), F.col("pass_rate"))
        return rows.select("run_id").join(metrics, "run_id").select(
            "run_id",
            score.alias("unified_score"),
            "faithfulness",
            (decision == "deploy").alias("deploy_eligible"),
            columns.diagnose(F.col("retrieval"), F.lit(1.0), F.lit(1.0), F.lit(1.0)).alias("diagnosis"),
        )

    out = optimise.evaluate_and_decide(runs, evaluate, fx.evaluations(spark, sf), fx.deployments(spark, sf))
    return out.runs.select("run_id", "step", "rounds", "outcome", F.round("unified_score", 9).alias("unified_score"))


@query(
    "synced_sources",
    "WITH " + upkeep._SOURCES + """
SELECT 'ingest' AS action, source_id FROM listing WHERE source_id NOT IN (SELECT source_id FROM docs WHERE connector_id = 1)
UNION ALL SELECT 'delete', source_id FROM docs WHERE connector_id = 1 AND source_id NOT IN (SELECT source_id FROM listing)""",
)
def synced_sources(spark, sf):
    listing, docs = upkeep.sources(spark, sf)
    connectors = docs.select("connector_id").distinct().select(
        "connector_id", F.lit("error").alias("status"), F.lit(None).cast("timestamp").alias("last_synced_at")
    )
    out = sync.sync_source(listing, docs, connectors, 1, "2024-02-01 00:00:00")
    return out.to_ingest.select(F.lit("ingest").alias("action"), "source_id").unionByName(
        out.to_delete.select(F.lit("delete").alias("action"), "source_id")
    )


@query(
    "csv_file_blocks",
    """
WITH r AS (
  SELECT CAST(regexp_extract(p_brand, '[0-9]+') AS BIGINT) AS brand, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) AS rn,
         '| ' || p_partkey || ' | ' || p_type || ',' || chr(10) || p_name || ' | ' || p_size || ' |' AS line FROM part
)
SELECT brand, CAST((rn - 1) // 10 AS INTEGER) AS block_no,
       '| p_partkey | label | p_size |' || chr(10) || '| --- | --- | --- |' || chr(10) || string_agg(line, chr(10) ORDER BY rn) AS content
FROM r GROUP BY 1, 2""",
)
def csv_file_blocks(spark, sf):
    """A CSV file per brand, with commas and line breaks inside quotes, read by its lines."""
    base = scratch(spark)
    brand = F.regexp_extract("p_brand", "[0-9]+", 0).cast("long").alias("brand")
    rows = fx.table(spark, sf, "part").select(
        brand, "p_partkey", F.concat_ws(",\n", "p_type", "p_name").alias("label"), "p_size"
    )
    files = rows.repartition("brand").sortWithinPartitions("brand", "p_partkey").write.partitionBy("brand")
    files.options(header=True, escape='"').csv(base)
    blocks = csv_lines.csv_line_blocks(csv_lines.file_lines(spark, base), "path")
    return blocks.select(
        F.regexp_extract("path", "brand=([0-9]+)", 1).cast("long").alias("brand"), "block_no", "content"
    )


@query(
    "streamed_drift",
    "WITH " + fx.EVALUATIONS + "," + scoring._DRIFT
    + " SELECT pipeline_id, n_scores, round(latest, 9) AS latest, round(prior_avg, 9) AS prior_avg, latest < prior_avg - 0.05 AS drift FROM drift",
)
def streamed_drift(spark, sf):
    """Scores arriving by order status in three batches; the last word per pipeline."""
    base = scratch(spark)
    columns = ["pipeline_id", "run_id", "created_at", "unified_score"]
    rows = fx.evaluations(spark, sf)
    schema = rows.select(*columns).schema
    for status in ("F", "O", "P"):
        part = rows.where(F.col("o_orderstatus") == status).select(*columns)
        part.write.mode("append").parquet(f"{base}/in")
        # Each delivery is one batch, however many files it has; the stream goes on with its state.
        stream = spark.readStream.schema(schema).parquet(f"{base}/in")
        drift_stream(stream, f"{base}/out", f"{base}/ckpt").awaitTermination()
    out = spark.read.parquet(f"{base}/out")
    last = out.groupBy("pipeline_id").agg(
        F.max_by(F.struct("n_scores", "latest", "prior_avg", "drift"), "step").alias("_r")
    )
    return last.select("pipeline_id", "_r.*").withColumns(
        {"latest": F.round("latest", 9), "prior_avg": F.round("prior_avg", 9)}
    )


#: Batches a delivery is dealt into, as long as a batch has no more files a core than `FILES_A_CORE`.
BATCHES, FILES_A_CORE = 8, 4


def files_per_batch(files: int, cores: int) -> int:
    """Files of one micro-batch: a batch costs many short jobs whatever it holds, so their number may not follow the input."""
    return max(1, min(-(-files // BATCHES), FILES_A_CORE * cores))


@query("streamed_ingest", _INGESTED)
def streamed_ingest(spark, sf):
    """The document table as a stream of files; summaries of all batches."""
    base = scratch(spark)
    docs = fx.table(spark, sf, "documents")
    docs.write.mode("append").parquet(f"{base}/in")
    files = fx.text_parts(spark, f"{sf}/documents.parquet")
    at_once = files_per_batch(files, spark.sparkContext.defaultParallelism)
    stream = spark.readStream.schema(docs.schema).option("maxFilesPerTrigger", at_once).parquet(f"{base}/in")
    one = ingest(document_files(docs.limit(0)), dim=64).chunks.schema
    store = KeyedStore(spark, f"{base}/chunks", one, buckets=8)
    streams.ingest_stream(
        document_files(stream), store, f"{base}/ckpt", summary_path=f"{base}/summary", dim=64
    ).awaitTermination()
    return spark.read.parquet(f"{base}/summary").drop("batch", "chunk_count")


@query(
    "streamed_due",
    """
WITH last AS (SELECT user_id, max(ts) AS ts FROM events GROUP BY 1)
SELECT user_id AS connector_id FROM last WHERE ts + 60 * (user_id % 500) * INTERVAL 1 MINUTE <= TIMESTAMP '2024-01-31 00:00:00'""",
)
def streamed_due(spark, sf):
    """Connectors due at each tick of the event stream."""
    base = scratch(spark)
    events = fx.table(spark, sf, "events")
    events.write.mode("append").parquet(f"{base}/in")

    def connectors():
        last = events.groupBy("user_id").agg(F.max("ts").alias("ts"))
        return last.select(
            F.col("user_id").alias("connector_id"),
            F.col("ts").alias("last_synced_at"),
            F.lit("active").alias("status"),
            (60 * (F.col("user_id") % 500)).alias("sync_interval_minutes"),
        )

    ticks = spark.readStream.schema(events.schema).parquet(f"{base}/in")
    streams.connector_due_stream(
        ticks, connectors, f"{base}/out", f"{base}/ckpt", now=F.to_timestamp(F.lit("2024-01-31T00:00:00Z")), every=None
    ).awaitTermination()
    return spark.read.parquet(f"{base}/out").select("connector_id").distinct()
