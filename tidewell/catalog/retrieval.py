"""Vector, keyword and hybrid retrieval queries."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from tidewell.catalog import fixtures as fx
from tidewell.catalog.registry import query
from tidewell.functions import vectors
from tidewell.functions.scoring import effective_score
from tidewell.operators import dense, filters, fusion, postings
from tidewell.operators.ranking import count_per_pipeline
from tidewell.plans.term_index import TermIndex
from tidewell.session import ensure_checkpoint_dir, materialise


@query("scan_chunks", "SELECT vec_id AS chunk_id, label AS pipeline_id FROM embeddings WHERE label = 3")
def scan_chunks(spark, sf):
    e = fx.table(spark, sf, "embeddings")
    named = e.select(F.col("vec_id").alias("chunk_id"), F.col("label").alias("pipeline_id"))
    return filters.scan_chunks(named, 3)


@query("chunk_counts", "SELECT label AS pipeline_id, count(*) AS n_chunks FROM embeddings GROUP BY 1")
def chunk_counts(spark, sf):
    return count_per_pipeline(fx.table(spark, sf, "embeddings").withColumnRenamed("label", "pipeline_id"))


@query(
    "cosine_distance",
    """
SELECT a.vec_id, round(1 - list_sum(list_transform(list_zip(a.embedding, b.embedding),
         lambda p: p[1]::DOUBLE * p[2]::DOUBLE))
       / (sqrt(list_sum(list_transform(a.embedding, lambda x: x::DOUBLE * x::DOUBLE)))
          * sqrt(list_sum(list_transform(b.embedding, lambda x: x::DOUBLE * x::DOUBLE)))), 6) AS distance
FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1""",
)
def cosine_distance(spark, sf):
    a = fx.table(spark, sf, "embeddings").select("vec_id", "embedding")
    b = a.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("other"))
    return a.join(b, "vec_id").select(
        "vec_id", F.round(vectors.cosine_distance(F.col("embedding"), F.col("other")), 6).alias("distance")
    )


def _entries(df, vector):
    return df.select("vec_id", F.posexplode(vector).alias("pos", "v")).select(
        "vec_id", "pos", F.round("v", 6).alias("value")
    )


_SCALED = """
WITH v AS (SELECT vec_id, list_transform({vec}, lambda x: x::DOUBLE) AS v FROM embeddings),
n AS (SELECT vec_id, v, sqrt(list_sum(list_transform(v, lambda x: x * x))) AS norm FROM v),
s AS (SELECT vec_id, generate_subscripts(v, 1) AS i, unnest(v) AS x, norm FROM n)
SELECT vec_id, CAST(i - 1 AS INTEGER) AS pos, round(CASE WHEN norm > 0 THEN x / norm ELSE x END, 6) AS value FROM s"""


@query("l2_normalize", _SCALED.format(vec="list_transform(embedding, lambda x: x::DOUBLE * label)"))
def l2_normalize(spark, sf):
    e = fx.table(spark, sf, "embeddings")
    scaled = e.withColumn("v", F.transform("embedding", lambda x: x.cast("double") * F.col("label")))
    return _entries(scaled, vectors.l2_normalize(F.col("v")))


@query("truncate_renorm", _SCALED.format(vec="embedding[1:32]"))
def truncate_renorm(spark, sf):
    return _entries(fx.table(spark, sf, "embeddings"), vectors.truncate_renorm(F.col("embedding"), 32))


@query(
    "fit_dim",
    """
WITH v AS (SELECT vec_id, CASE WHEN label < 5 THEN embedding[1:40]::DOUBLE[]
             ELSE embedding::DOUBLE[] END AS v FROM embeddings),
p AS (SELECT vec_id, v, unnest(range(0, 48)) AS i FROM v)
SELECT vec_id, CAST(i AS INTEGER) AS pos, round(coalesce(v[i + 1], 0.0), 6) AS value FROM p""",
)
def fit_dim(spark, sf):
    e = fx.table(spark, sf, "embeddings")
    mixed = e.withColumn(
        "v", F.when(F.col("label") < 5, F.slice("embedding", 1, 40)).otherwise(F.col("embedding"))
    )
    return _entries(mixed, vectors.fit_dim(F.col("v"), 48))


_DENSE = (
    fx.CHUNKS
    + ","
    + fx.QUERY_TEXT
    + """,
pairs AS (
  SELECT q.query_id, c.chunk_id,
         round(list_cosine_distance(q.q_embedding::DOUBLE[], c.embedding::DOUBLE[]), 10) AS distance
  FROM query_text q JOIN {cands} c USING (pipeline_id)
  WHERE q.q_embedding IS NOT NULL AND c.embedding IS NOT NULL
),
dense AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, chunk_id) AS rnk
                 FROM pairs) WHERE rnk <= 40
)"""
)

_POSTINGS = """
postings AS (
  SELECT chunk_id, pipeline_id, term, CAST(count(*) AS INTEGER) AS tf, any_value(n) AS n_terms
  FROM (SELECT chunk_id, pipeline_id, unnest(t) AS term, len(t) AS n
        FROM (SELECT chunk_id, pipeline_id,
                     regexp_extract_all(lower(content), '[\\p{L}\\p{Nd}]+') AS t FROM {cands}))
  WHERE term NOT IN ({stops}) GROUP BY 1, 2, 3
)""".replace("{stops}", fx.STOPS)

_KEYWORD = f"""
qt AS (
  SELECT query_id, pipeline_id, term, count(*) OVER (PARTITION BY query_id) AS n_q
  FROM (SELECT query_id, pipeline_id, unnest(qterms) AS term FROM query_text)
  WHERE term NOT IN ({fx.STOPS})
),
dfs AS (SELECT pipeline_id, term, count(*) AS df FROM postings GROUP BY 1, 2),
corpus AS (
  SELECT pipeline_id, count(*) AS n_chunks, avg(n_terms) AS avg_terms
  FROM (SELECT pipeline_id, chunk_id, any_value(n_terms) AS n_terms FROM postings GROUP BY 1, 2) GROUP BY 1
),
matched AS (
  SELECT qt.query_id, p.chunk_id, n_q, count(*) AS m, round(sum({{score}}), 9) AS kw_score
  FROM qt JOIN postings p USING (pipeline_id, term) JOIN dfs USING (pipeline_id, term)
       JOIN corpus USING (pipeline_id)
  GROUP BY 1, 2, 3
),
keyword AS (
  SELECT * FROM (SELECT query_id, chunk_id, kw_score,
                        row_number() OVER (PARTITION BY query_id ORDER BY kw_score DESC, chunk_id) AS rnk
                 FROM matched WHERE m = n_q) WHERE rnk <= 40
)"""
_BM25 = (
    "ln(1 + (n_chunks - df + 0.5) / (df + 0.5)) * tf * 2.2"
    " / (tf + 1.2 * (1 - 0.75 + 0.75 * n_terms / avg_terms))"
)


def _keyword_sql(score: str, cands: str = "chunks") -> str:
    return _POSTINGS.replace("{cands}", cands) + "," + _KEYWORD.format(score=score)


@query(
    "dense_topk",
    "WITH " + _DENSE.replace("{cands}", "chunks")
    + " SELECT query_id, chunk_id, round(distance, 6) AS distance, CAST(rnk AS INTEGER) AS rnk FROM dense",
)
def dense_topk(spark, sf):
    return dense.dense_topk(fx.queries(spark, sf), fx.chunks(spark, sf), 40).select(
        "query_id", "chunk_id", F.round("distance", 6).alias("distance"), "rnk"
    )


@query(
    "document_postings",
    f"""
SELECT chunk_id, term, CAST(count(*) AS INTEGER) AS tf, CAST(any_value(n) AS INTEGER) AS n_terms
FROM (SELECT chunk_id, unnest(t) AS term, len(t) AS n
      FROM (SELECT doc_id AS chunk_id, regexp_extract_all(lower(text), '[\\p{{L}}\\p{{Nd}}]+') AS t FROM documents))
WHERE term NOT IN ({fx.STOPS}) GROUP BY 1, 2""",
)
def document_postings(spark, sf):
    docs = fx.table(spark, sf, "documents").withColumnRenamed("doc_id", "chunk_id")
    return postings.build_postings(docs, "text")


def _postings(spark, sf):
    """Stored term index of the chunks."""
    return materialise(postings.build_postings(fx.chunks(spark, sf), keep=["pipeline_id"]))


@query(
    "keyword_topk",
    "WITH " + fx.CHUNKS + "," + fx.QUERY_TEXT + "," + _keyword_sql("tf")
    + " SELECT query_id, chunk_id, CAST(kw_score AS DOUBLE) AS kw_score, CAST(rnk AS INTEGER) AS rnk FROM keyword",
)
def keyword_topk(spark, sf):
    return postings.keyword_topk(fx.queries(spark, sf), _postings(spark, sf), 40, scorer="tf")


@query(
    "bm25_topk",
    "WITH " + fx.CHUNKS + "," + fx.QUERY_TEXT + "," + _keyword_sql(_BM25)
    + " SELECT query_id, chunk_id, round(kw_score, 6) AS kw_score, CAST(rnk AS INTEGER) AS rnk FROM keyword",
)
def bm25_topk(spark, sf):
    top = postings.bm25(fx.queries(spark, sf), _postings(spark, sf), 40)
    return top.withColumn("kw_score", F.round("kw_score", 6))


@query(
    "passage_topk",
    "WITH " + fx.CHUNKS + "," + fx.PASSAGES + "," + _keyword_sql(_BM25)
    + " SELECT query_id, chunk_id, round(kw_score, 6) AS kw_score, CAST(rnk AS INTEGER) AS rnk FROM keyword",
)
def passage_topk(spark, sf):
    """Documents that hold all terms of a benchmark passage."""
    top = postings.bm25(fx.passages(spark, sf), _postings(spark, sf), 40)
    return top.withColumn("kw_score", F.round("kw_score", 6))


_LIVE = """,
live AS (
  SELECT chunk_id, pipeline_id, CASE WHEN document_id % 7 = 0 THEN lang || ' ' || source ELSE content END AS content
  FROM chunks WHERE document_id % 11 <> 0
)"""


@query(
    "indexed_topk",
    "WITH " + fx.CHUNKS + "," + fx.QUERY_TEXT + _LIVE + "," + _keyword_sql(_BM25, "live")
    + " SELECT query_id, chunk_id, round(kw_score, 6) AS kw_score, CAST(rnk AS INTEGER) AS rnk FROM keyword",
)
def indexed_topk(spark, sf):
    """A stored index after documents were replaced and deleted."""
    ensure_checkpoint_dir(spark)
    index = TermIndex(spark, f"{spark.sparkContext.getCheckpointDir()}/index-{uuid.uuid4().hex}", buckets=16, document_buckets=8)
    chunk = fx.chunks(spark, sf)
    index.replace(chunk)
    index.replace(chunk.where("document_id % 7 = 0").withColumn("content", F.concat_ws(" ", "lang", "source")))
    index.delete(chunk.where("document_id % 11 = 0").select("document_id"))
    return postings.bm25(fx.queries(spark, sf), index, 40).withColumn("kw_score", F.round("kw_score", 6))


def _positions(spark, sf):
    """Stored term index with positions, at the limits of the text index it reproduces."""
    built = postings.build_postings(fx.chunks(spark, sf), keep=["pipeline_id"], positions=True, pg_limits=True)
    return materialise(built)


_TS_RANK = """
tokens AS (
  SELECT chunk_id, pipeline_id, unnest(t) AS term, least(generate_subscripts(t, 1), 16383) AS pos
  FROM (SELECT chunk_id, pipeline_id, regexp_extract_all(lower(content), '[\\p{L}\\p{Nd}]+') AS t FROM chunks)
),
postings AS (
  SELECT chunk_id, pipeline_id, term, list_sort(list(DISTINCT pos))[1:256] AS ps FROM tokens
  WHERE term NOT IN ({stops}) GROUP BY 1, 2, 3
),
qt AS (
  SELECT query_id, pipeline_id, term, count(*) OVER (PARTITION BY query_id) AS n_q
  FROM (SELECT query_id, pipeline_id, unnest(qterms) AS term FROM query_text) WHERE term NOT IN ({stops})
),
both_terms AS (
  SELECT query_id, chunk_id, n_q, list(ps ORDER BY term) AS l FROM qt JOIN postings USING (pipeline_id, term)
  GROUP BY 1, 2, 3 HAVING count(*) = n_q
),
scored AS (
  SELECT query_id, chunk_id, round(CASE WHEN n_q = 1
      THEN list_sum(list_transform(range(1, len(l[1]) + 1), lambda j: 0.1::DOUBLE / (j * j))) / 1.64493406685
      ELSE 1 - exp(list_sum(list_transform(l[1], lambda p: list_sum(list_transform(l[2], lambda q:
        CASE WHEN abs(p - q) BETWEEN 1 AND 100
             THEN ln(1 - 0.1::DOUBLE * sqrt(1 / (1.005 + 0.05 * exp(abs(p - q) / 1.5::DOUBLE - 2)))) ELSE 0 END))))) END, 9) AS kw_score
  FROM both_terms
),
keyword AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY kw_score DESC, chunk_id) AS rnk FROM scored) WHERE rnk <= 40
)""".replace("{stops}", fx.STOPS)


@query(
    "ts_rank_topk",
    "WITH " + fx.CHUNKS + "," + fx.QUERY_TEXT + "," + _TS_RANK
    + " SELECT query_id, chunk_id, round(kw_score, 6) AS kw_score, CAST(rnk AS INTEGER) AS rnk FROM keyword",
)
def ts_rank_topk(spark, sf):
    top = postings.keyword_topk(fx.queries(spark, sf), _positions(spark, sf), 40, scorer="ts_rank")
    return top.withColumn("kw_score", F.round("kw_score", 6))


@query("stemmed_topk")
def stemmed_topk(spark, sf):
    """Full text search: stems, stop words out, positional rank."""
    index = materialise(
        postings.build_postings(fx.chunks(spark, sf), keep=["pipeline_id"], stem=True, positions=True)
    )
    return postings.keyword_topk(fx.queries(spark, sf), index, 40, scorer="ts_rank", stem=True)


@query(
    "fused_ranks",
    "WITH " + _DENSE.replace("{cands}", "chunks") + "," + _keyword_sql(_BM25)
    + """
SELECT query_id, chunk_id, CAST(d.rnk AS INTEGER) AS dense_rnk, CAST(w.rnk AS INTEGER) AS keyword_rnk,
       round(coalesce(1.0::DOUBLE / (60 + d.rnk), 0) + coalesce(1.0::DOUBLE / (60 + w.rnk), 0), 9) AS rrf_score
FROM dense d FULL JOIN keyword w USING (query_id, chunk_id)""",
)
def fused_ranks(spark, sf):
    q = fx.queries(spark, sf)
    fused = fusion.fuse_full_outer(
        dense.dense_topk(q, fx.chunks(spark, sf), 40), postings.bm25(q, _postings(spark, sf), 40)
    )
    return fused.withColumn("rrf_score", F.round("rrf_score", 9))


_HYBRID = """
fused AS (
  SELECT query_id, chunk_id,
         round(coalesce(1.0::DOUBLE / (60 + d.rnk), 0) + coalesce(1.0::DOUBLE / (60 + w.rnk), 0), 12) AS rrf_score
  FROM dense d FULL JOIN keyword w USING (query_id, chunk_id)
),
hits AS (
  SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY rrf_score DESC, chunk_id) AS INTEGER) AS rank
                 FROM fused) WHERE rank <= 20
)"""
_HYBRID_OUT = """
SELECT query_id, h.chunk_id, round(rrf_score, 9) AS rrf_score, rank, md5(content) AS content_md5
FROM hits h JOIN chunks c ON c.chunk_id = h.chunk_id"""


def _hybrid_out(hits):
    return hits.select(
        "query_id", "chunk_id", F.round("rrf_score", 9).alias("rrf_score"), "rank",
        F.md5("content").alias("content_md5"),
    )


@query(
    "hybrid_search",
    "WITH " + _DENSE.replace("{cands}", "chunks") + "," + _keyword_sql(_BM25) + "," + _HYBRID + _HYBRID_OUT,
)
def hybrid_search(spark, sf):
    hits = fusion.hybrid_search(fx.queries(spark, sf), fx.chunks(spark, sf), _postings(spark, sf))
    return _hybrid_out(hits)


@query(
    "hybrid_text_rank",
    "WITH " + _DENSE.replace("{cands}", "chunks") + "," + _TS_RANK + "," + _HYBRID + _HYBRID_OUT,
)
def hybrid_text_rank(spark, sf):
    """Vectors fused with the positional text rank."""
    hits = fusion.hybrid_search(fx.queries(spark, sf), fx.chunks(spark, sf), _positions(spark, sf), scorer="ts_rank")
    return _hybrid_out(hits)


_EN = "english AS (SELECT * FROM chunks WHERE lang = 'en')"


@query(
    "hybrid_search_filtered",
    "WITH " + _DENSE.replace("{cands}", "english").replace(fx.CHUNKS, fx.CHUNKS + ", " + _EN)
    + "," + _keyword_sql(_BM25).replace("WHERE m = n_q", "WHERE m = n_q AND chunk_id IN (SELECT chunk_id FROM english)")
    + "," + _HYBRID + _HYBRID_OUT,
)
def hybrid_search_filtered(spark, sf):
    hits = fusion.hybrid_search(
        fx.queries(spark, sf), fx.chunks(spark, sf), _postings(spark, sf), metadata_filter={"lang": "en"}
    )
    return _hybrid_out(hits)


@query(
    "rrf_three_lists",
    "WITH " + fx.RANKINGS + """,
lists AS (
  SELECT query_id, chunk_id, rank AS rnk FROM rankings
  UNION ALL SELECT query_id, chunk_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) FROM rankings
  UNION ALL SELECT query_id, chunk_id, row_number() OVER (PARTITION BY query_id ORDER BY chunk_id) FROM rankings
),
fused AS (SELECT query_id, chunk_id, round(sum(1.0::DOUBLE / (60 + rnk)), 12) AS rrf_score FROM lists GROUP BY 1, 2),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rrf_score DESC, chunk_id) AS rank FROM fused)
SELECT query_id, chunk_id, round(rrf_score, 9) AS rrf_score, CAST(rank AS INTEGER) AS rank FROM ranked WHERE rank <= 20""",
)
def rrf_three_lists(spark, sf):
    from tidewell.functions import ordered

    base = fx.rankings(spark, sf)
    by_rank = base.withColumnRenamed("rank", "rnk")
    down = base.withColumn("down", -F.col("score"))
    by_score = ordered.row_number(down, ["query_id"], ["down", "chunk_id"], F.floor(F.col("down") * 100), "rnk")
    by_id = ordered.row_number(base, ["query_id"], ["chunk_id"], F.floor(F.col("chunk_id") / ordered.BUCKET_ROWS), "rnk")
    return fusion.rrf([by_rank, by_score, by_id]).withColumn("rrf_score", F.round("rrf_score", 9))


@query(
    "hits_with_metadata",
    "WITH " + fx.RANKINGS + """
SELECT r.query_id, r.chunk_id, CAST(r.rank AS BIGINT) AS rank, p.p_partkey AS document_id, p.p_size AS page_number, p.p_name AS filename
FROM rankings r LEFT JOIN (SELECT * FROM part WHERE p_size < 40) p ON p.p_partkey = r.chunk_id""",
)
def hits_with_metadata(spark, sf):
    part = fx.table(spark, sf, "part").where("p_size < 40")
    chunk = part.select(
        F.col("p_partkey").alias("chunk_id"),
        F.col("p_partkey").alias("document_id"),
        F.col("p_size").alias("page_number"),
        F.lit(0).alias("chunk_index"),
        F.lit("text").alias("source_type"),
        F.lit(None).cast("string").alias("media_path"),
    )
    docs = part.select(F.col("p_partkey").alias("document_id"), F.col("p_name").alias("filename"))
    return fusion.attach_metadata(fx.rankings(spark, sf), chunk, docs).select(
        "query_id", "chunk_id", F.col("rank").cast("long").alias("rank"), "document_id", "page_number", "filename"
    )


@query(
    "chunks_by_filename",
    """
SELECT d.lang AS pipeline_id, d.source AS filename, d.doc_id AS document_id, d.doc_id AS chunk_id,
       CAST(0 AS INTEGER) AS chunk_index, 0.5::DOUBLE AS rrf_score, md5(d.text) AS content_md5
FROM documents d JOIN (SELECT DISTINCT lang, source FROM documents JOIN labels USING (doc_id) WHERE toxic = 1) r
  ON r.lang = d.lang AND r.source = d.source""",
)
def chunks_by_filename(spark, sf):
    docs = fx.table(spark, sf, "documents")
    documents = docs.select(
        F.col("lang").alias("pipeline_id"), F.col("source").alias("filename"), F.col("doc_id").alias("document_id")
    )
    chunk = docs.select(
        F.col("doc_id").alias("document_id"), F.col("doc_id").alias("chunk_id"),
        F.col("text").alias("content"), F.lit(0).alias("chunk_index"),
    )
    toxic = fx.table(spark, sf, "labels").where("toxic = 1").withColumnRenamed("doc_id", "document_id")
    requests = documents.join(toxic, "document_id", "left_semi").select("pipeline_id", "filename").distinct()
    return fusion.chunks_by_filename(requests, chunk, documents).select(
        "pipeline_id", "filename", "document_id", "chunk_id", "chunk_index", "rrf_score",
        F.md5("content").alias("content_md5"),
    )


@query(
    "rerank_topk",
    "WITH " + fx.RANKINGS + """,
scored AS (
  SELECT query_id, chunk_id, rank, CASE WHEN query_id % 4 = 0 THEN 0.0 ELSE score END AS score
  FROM rankings
),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, rank, chunk_id) AS new_rank FROM scored
)
SELECT query_id, chunk_id, CAST(rank AS BIGINT) AS rank, score, CAST(new_rank AS INTEGER) AS new_rank
FROM ranked WHERE new_rank <= 5""",
)
def rerank_topk(spark, sf):
    hits = fx.rankings(spark, sf)
    scores = hits.where("query_id % 4 <> 0").select("query_id", "chunk_id", F.col("score").alias("relevance"))
    top = fusion.rerank_topk(hits.select("query_id", "chunk_id", "rank"), scores, 5)
    return top.select("query_id", "chunk_id", F.col("rank").cast("long").alias("rank"), "score", "new_rank")


@query(
    "effective_score",
    """
SELECT l_orderkey, l_linenumber, CASE WHEN l_discount <> 0 THEN l_discount ELSE l_tax END AS effective FROM lineitem""",
)
def effective(spark, sf):
    li = fx.table(spark, sf, "lineitem")
    return li.select(
        "l_orderkey", "l_linenumber", effective_score(F.col("l_discount"), F.col("l_tax")).alias("effective")
    )


_LISTS = """,
list_a AS (SELECT query_id, chunk_id, rank, score FROM rankings WHERE expected = 1),
list_b AS (SELECT query_id, chunk_id, rank, score * 10 AS score FROM rankings)"""


def _lists(spark, sf):
    r = fx.rankings(spark, sf)
    a = r.where("expected = 1").select("query_id", "chunk_id", "rank", "score")
    b = r.select("query_id", "chunk_id", "rank", (F.col("score") * 10).alias("score"))
    return a, b


@query(
    "merge_first_wins",
    "WITH " + fx.RANKINGS + _LISTS + """,
tagged AS (SELECT query_id, chunk_id, 0 AS list_no, rank FROM list_a UNION ALL SELECT query_id, chunk_id, 1, rank FROM list_b),
once AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id, chunk_id ORDER BY list_no, rank) AS n FROM tagged) WHERE n = 1
)
SELECT query_id, chunk_id, CAST(list_no AS INTEGER) AS list_no, CAST(rank AS BIGINT) AS rank,
       row_number() OVER (PARTITION BY query_id ORDER BY list_no, rank, chunk_id) AS pos
FROM once""",
)
def merge_first_wins(spark, sf):
    a, b = _lists(spark, sf)
    return fusion.merge_first_wins([a, b])


@query(
    "merge_last_wins",
    "WITH " + fx.RANKINGS + _LISTS + """,
tagged AS (SELECT query_id, chunk_id, 0 AS list_no, rank, score FROM list_a
           UNION ALL SELECT query_id, chunk_id, 1, rank, score FROM list_b),
once AS (
  SELECT query_id, chunk_id, arg_min(rank, list_no) AS rank, min(list_no) AS list_no, arg_max(score, list_no) AS score
  FROM tagged GROUP BY 1, 2
)
SELECT query_id, chunk_id, round(score, 6) AS score, CAST(list_no AS INTEGER) AS list_no, CAST(rank AS BIGINT) AS rank,
       row_number() OVER (PARTITION BY query_id ORDER BY list_no, rank, chunk_id) AS pos
FROM once""",
)
def merge_last_wins(spark, sf):
    a, b = _lists(spark, sf)
    return fusion.merge_last_wins(a, b).select(
        "query_id", "chunk_id", F.round("score", 6).alias("score"), "list_no",
        F.col("rank").cast("long").alias("rank"), "pos",
    )


_WEAK = """,
weak AS (
  SELECT query_id, CAST(sum(CASE WHEN (CASE WHEN s <> 0 THEN s ELSE r END) >= 0.7 THEN 1 ELSE 0 END) AS BIGINT) AS strong_hits
  FROM (SELECT query_id, score * 10 AS s, 1.0::DOUBLE / (60 + rank) AS r FROM rankings) GROUP BY 1
)"""


@query(
    "weak_queries",
    "WITH " + fx.RANKINGS + _WEAK + " SELECT query_id, strong_hits, strong_hits < 3 AS weak FROM weak",
)
def weak_queries(spark, sf):
    return filters.weak_queries(_hyde_top(spark, sf))


def _hyde_top(spark, sf):
    return fx.rankings(spark, sf).select(
        "query_id", "chunk_id", "rank", (F.col("score") * 10).alias("score"),
        (1.0 / (60 + F.col("rank"))).alias("rrf_score"),
    )


@query(
    "hyde_merge",
    "WITH " + fx.RANKINGS + _WEAK + """,
extra AS (SELECT query_id, chunk_id + 1 AS chunk_id, rank FROM rankings),
tagged AS (
  SELECT query_id, chunk_id, 0 AS list_no, rank FROM rankings
  UNION ALL SELECT query_id, chunk_id, 1, rank FROM extra JOIN weak USING (query_id) WHERE strong_hits < 3
),
once AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id, chunk_id ORDER BY list_no, rank) AS n FROM tagged) WHERE n = 1
),
placed AS (
  SELECT query_id, chunk_id, strong_hits,
         row_number() OVER (PARTITION BY query_id ORDER BY list_no, rank, chunk_id) AS pos,
         count(*) OVER (PARTITION BY query_id) AS n_all
  FROM once JOIN weak USING (query_id)
),
before AS (SELECT query_id, count(*) AS n_before FROM rankings GROUP BY 1)
SELECT query_id, chunk_id, pos, strong_hits < 3 AND least(n_all, 5) <> n_before AS hyde_applied
FROM placed JOIN before USING (query_id) WHERE strong_hits >= 3 OR pos <= 5""",
)
def hyde_merge(spark, sf):
    top = _hyde_top(spark, sf)
    extra = top.select("query_id", (F.col("chunk_id") + 1).alias("chunk_id"), "rank")
    return fusion.hyde_merge(top, extra)


@query(
    "set_overlap",
    "WITH " + fx.RANKINGS + """
SELECT query_id, CAST(sum(CASE WHEN rank <= 3 THEN 1 ELSE 0 END) AS BIGINT) AS n_retrieved,
       CAST(sum(expected) AS BIGINT) AS n_expected,
       CAST(sum(CASE WHEN rank <= 3 THEN expected ELSE 0 END) AS BIGINT) AS n_both
FROM rankings WHERE rank <= 3 OR expected = 1 GROUP BY 1""",
)
def set_overlap(spark, sf):
    r = fx.rankings(spark, sf)
    return fusion.set_overlap(r.where("rank <= 3"), fx.expected(r))


@query(
    "metadata_contains",
    """
SELECT event_id, json_extract_string(props, '$.k') = CAST(event_id % 100 AS VARCHAR) AS held FROM events""",
)
def metadata_contains(spark, sf):
    e = fx.table(spark, sf, "events")
    wanted = F.create_map(F.lit("k"), (F.col("event_id") % 100).cast("string"))
    return e.select(
        "event_id", filters.metadata_contains(F.from_json("props", "map<string,string>"), wanted).alias("held")
    )


@query(
    "json_contains",
    """
SELECT event_type, CAST(sum(CASE WHEN json_extract_string(props, '$.k') = '42' THEN 1 ELSE 0 END) AS BIGINT) AS held,
       count(*) AS n FROM events GROUP BY 1""",
)
def json_contains(spark, sf):
    e = fx.table(spark, sf, "events")
    doc = F.concat(F.lit('{"tags": ["x", "y"], "props": '), F.col("props"), F.lit("}"))
    held = filters.json_contains(doc, {"props": {"k": 42}, "tags": ["y"]})
    return e.groupBy("event_type").agg(F.sum(held.cast("long")).alias("held"), F.count("*").alias("n"))
