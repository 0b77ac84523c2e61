"""Fusing, merging and reordering of result lists."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidewell import constants as K
from tidewell.functions import ordered
from tidewell.functions.text import normalize_extracted
from tidewell.operators.dense import dense_topk
from tidewell.operators.filters import as_text, json_contains, metadata_contains, weak_queries
from tidewell.operators.postings import keyword_topk
from tidewell.session import materialise


def fuse_full_outer(dense: DataFrame, keyword: DataFrame, k: int = K.RRF_K) -> DataFrame:
    """query_id, chunk_id, dense_rnk, keyword_rnk, rrf_score; a missing side adds 0."""
    d = dense.select("query_id", "chunk_id", F.col("rnk").alias("dense_rnk"))
    w = keyword.select("query_id", "chunk_id", F.col("rnk").alias("keyword_rnk"))

    def share(rank: str) -> Column:
        return F.coalesce(1.0 / (k + F.col(rank)), F.lit(0.0))

    return d.join(w, ["query_id", "chunk_id"], "full").withColumn(
        "rrf_score", share("dense_rnk") + share("keyword_rnk")
    )


def rrf(lists: list[DataFrame], k: int = K.RRF_K, limit: int = K.CANDIDATE_LIMIT) -> DataFrame:
    """query_id, chunk_id, rrf_score, rank from any number of ranked lists.

    A union and one combined sum give what a full outer join of the lists would, with
    one shuffle of (query, chunk, rank) rows.
    """
    ranks = reduce(
        DataFrame.unionByName, [r.select("query_id", "chunk_id", "rnk") for r in lists]
    )
    fused = ranks.groupBy("query_id", "chunk_id").agg(
        F.sum(1.0 / (k + F.col("rnk"))).alias("_sum")
    )
    scored = fused.select("query_id", "chunk_id", F.round("_sum", 12).alias("rrf_score"))
    best = [F.col("rrf_score").desc(), F.col("chunk_id")]
    return ordered.newest(scored, ["query_id"], best, limit, "rank")


def attach_content(hits: DataFrame, chunks: DataFrame) -> DataFrame:
    return hits.join(chunks.select("chunk_id", "content"), "chunk_id")


def hit_texts(hits: DataFrame, chunks: DataFrame) -> DataFrame:
    """chunk_id, content: the text of each chunk that was hit, normalised once however often it was."""
    hit = chunks.select("chunk_id", "content").join(hits.select("chunk_id").distinct(), "chunk_id", "left_semi")
    return hit.withColumn("content", normalize_extracted(F.col("content")))


def attach_metadata(hits: DataFrame, chunks: DataFrame, documents: DataFrame) -> DataFrame:
    """Citation fields for hits; a hit without chunk or document keeps nulls."""
    fields = chunks.select(
        "chunk_id", "document_id", "page_number", "chunk_index", "source_type", "media_path"
    )
    wanted = fields.join(hits.select("chunk_id").distinct(), "chunk_id", "left_semi")
    cited = wanted.join(documents.select("document_id", "filename"), "document_id")
    return hits.join(cited, "chunk_id", "left")


def chunks_by_filename(requests: DataFrame, chunks: DataFrame, documents: DataFrame) -> DataFrame:
    """All chunks of the named file of a pipeline, in document order, at a fixed score."""
    named = requests.join(
        documents.select("pipeline_id", "filename", "document_id"), ["pipeline_id", "filename"]
    )
    return named.join(
        chunks.select("document_id", "chunk_id", "content", "chunk_index"), "document_id"
    ).withColumn("rrf_score", F.lit(K.FILENAME_HIT_SCORE))


def first_of_files(requests: DataFrame, hits: DataFrame, chunks: DataFrame, documents: DataFrame) -> DataFrame:
    """query_id, chunk_id, rrf_score, rank: of each file asked for, what can reach a list of `top_k`.

    requests: query_id, pipeline_id, filename, top_k. hits: query_id, chunk_id. Behind a list of
    at most `top_k` hits only the first 2 * top_k chunks of a file can come among the first
    `top_k`; hits that lie in the file are listed too, as they take its score. A file's chunks
    are put in order once, not once per query.
    """
    file = ["pipeline_id", "filename"]
    asked = requests.select("query_id", *file, "top_k").distinct()
    read = chunks_by_filename(asked.select(*file).distinct(), chunks, documents)
    listed = materialise(read.groupBy(*file, "chunk_id").agg((F.min("chunk_index") + 1).alias("rank")))
    most = asked.agg(F.max("top_k")).first()[0] or 0
    first = ordered.newest(listed, file, [F.col("rank"), F.col("chunk_id")], 2 * most, "_at")
    ahead = asked.join(first, file).where(F.col("_at") <= 2 * F.col("top_k"))
    inside = hits.select("query_id", "chunk_id").join(asked, "query_id").join(listed, [*file, "chunk_id"])
    found = ahead.select("query_id", "chunk_id", "rank").unionByName(inside.select("query_id", "chunk_id", "rank"))
    return found.distinct().withColumn("rrf_score", F.lit(K.FILENAME_HIT_SCORE))


def hybrid_search(
    queries: DataFrame,
    chunks: DataFrame,
    postings: DataFrame,
    limit: int = K.CANDIDATE_LIMIT,
    metadata_filter: dict | None = None,
    method: str = "hybrid",
    scorer: str = "bm25",
    with_content: bool = True,
    stem: bool = False,
) -> DataFrame:
    """query_id, chunk_id, rrf_score, rank[, content]: both rankings fused per query.

    queries: query_id, pipeline_id, q, q_embedding. `postings` is a table or a TermIndex.
    The metadata filter, nested where metadata is JSON text, is applied to both sides
    before they are ranked; content is joined only to what is left.
    """
    candidates = chunks
    allowed = None
    if metadata_filter:
        if chunks.schema["metadata"].dataType.simpleString() == "string":
            held = json_contains(F.col("metadata"), metadata_filter)
        else:
            wanted = [F.lit(v) for k, x in metadata_filter.items() for v in (k, None if x is None else as_text(x))]
            held = metadata_contains(F.col("metadata"), F.create_map(*wanted).cast("map<string,string>"))
        candidates = chunks.where(held)
        allowed = candidates.select("chunk_id")
    lists = [dense_topk(queries, candidates, 2 * limit)]
    if method != "dense":
        lists.append(
            keyword_topk(queries, postings, 2 * limit, scorer=scorer, stem=stem, allowed=allowed)
        )
    hits = rrf(lists, limit=limit)
    return attach_content(hits, chunks) if with_content else hits


def merge_first_wins(lists: list[DataFrame], bucket_rows: int = ordered.BUCKET_ROWS) -> DataFrame:
    """query_id, chunk_id, list_no, rank, pos: lists one after the other, first hit kept.

    Each list has query_id, chunk_id, rank. The first occurrence is a combined minimum
    and positions are counted per bucket, so a long list of one query spreads out.
    """
    tagged = reduce(
        DataFrame.unionByName,
        [
            r.select("query_id", "chunk_id", F.lit(i).alias("list_no"), F.col("rank").cast("long").alias("rank"))
            for i, r in enumerate(lists)
        ],
    )
    first = (
        tagged.groupBy("query_id", "chunk_id")
        .agg(F.min(F.struct("list_no", "rank")).alias("_at"))
        .select("query_id", "chunk_id", "_at.list_no", "_at.rank")
    )
    part = F.floor(F.col("rank") / bucket_rows).alias("part")
    return ordered.number_lists(
        first, ["query_id"], ["list_no", "rank", "chunk_id"], F.struct("list_no", part), "pos", part
    )


def merge_last_wins(first: DataFrame, second: DataFrame) -> DataFrame:
    """Values of the later list at the position of the earlier one.

    Both lists have query_id, chunk_id, rank, score.
    """
    tagged = first.withColumn("list_no", F.lit(0)).unionByName(second.withColumn("list_no", F.lit(1)))
    at = F.struct("list_no", "rank")
    merged = tagged.groupBy("query_id", "chunk_id").agg(
        F.min(at).alias("_at"), F.max_by("score", at).alias("score")
    )
    placed = merged.select(
        "query_id", "chunk_id", "score", F.col("_at.list_no").alias("list_no"), F.col("_at.rank").alias("rank")
    )
    part = F.floor(F.col("rank") / ordered.BUCKET_ROWS).alias("part")
    return ordered.number_lists(
        placed, ["query_id"], ["list_no", "rank", "chunk_id"], F.struct("list_no", part), "pos", part
    )


def hyde_merge(top: DataFrame, extra: DataFrame, n: int = K.DEFAULT_TOP_K) -> DataFrame:
    """Weak queries take extra hits behind their own, first n; strong ones stay as they are.

    top: query_id, chunk_id, rank, score, rrf_score. extra: query_id, chunk_id, rank.
    Adds hyde_applied, true when the number of hits changed.
    """
    strong = weak_queries(top).where(~F.col("weak")).select("query_id")
    sizes = top.groupBy("query_id").agg(F.count("*").alias("_before"))
    merged = (
        merge_first_wins([top, extra.join(strong, "query_id", "left_anti")])
        .join(strong.withColumn("_strong", F.lit(True)), "query_id", "left")
        .withColumn("_strong", F.coalesce("_strong", F.lit(False)))
    )
    # Weak queries keep as many hits as there are, up to n, so the merged lists are made once.
    kept = materialise(merged.where(F.col("_strong") | (F.col("pos") <= n)).select("query_id", "chunk_id", "pos", "_strong"))
    numbers = kept.groupBy("query_id", "_strong").agg(F.count("*").alias("_kept"))
    applied = ~F.col("_strong") & (F.col("_kept") != F.coalesce("_before", F.lit(0)))
    flags = numbers.join(sizes, "query_id", "left").select("query_id", applied.alias("hyde_applied"))
    return kept.select("query_id", "chunk_id", "pos").join(flags, "query_id")


def set_overlap(retrieved: DataFrame, expected: DataFrame) -> DataFrame:
    """query_id, n_retrieved, n_expected, n_both from (query_id, chunk_id) rows."""
    sides = retrieved.select("query_id", "chunk_id", F.lit(1).alias("r"), F.lit(0).alias("e")).unionByName(
        expected.select("query_id", "chunk_id", F.lit(0).alias("r"), F.lit(1).alias("e"))
    )
    per_chunk = sides.groupBy("query_id", "chunk_id").agg(F.max("r").alias("r"), F.max("e").alias("e"))
    return per_chunk.groupBy("query_id").agg(
        F.sum("r").alias("n_retrieved"),
        F.sum("e").alias("n_expected"),
        F.sum(F.col("r") * F.col("e")).alias("n_both"),
    )


def rerank_topk(hits: DataFrame, scores: DataFrame, top_k: int | str = K.DEFAULT_TOP_K) -> DataFrame:
    """Order by outside relevance scores; a query without any keeps its fused order, score 0.

    hits: query_id, chunk_id, rank. scores: query_id, chunk_id, relevance. `top_k` is a
    number or a column of `hits`. Adds score and new_rank.
    """
    has_scores = scores.select("query_id").distinct().withColumn("_scored", F.lit(True))
    joined = hits.join(scores, ["query_id", "chunk_id"], "left").join(has_scores, "query_id", "left")
    scored = F.coalesce("_scored", F.lit(False))
    score = F.when(scored, F.col("relevance")).otherwise(F.lit(0.0))
    usable = joined.where(~scored | F.col("relevance").isNotNull()).withColumn("score", score)
    ranking = W.partitionBy("query_id").orderBy(F.col("score").desc(), "rank", "chunk_id")
    limit = F.col(top_k) if isinstance(top_k, str) else F.lit(top_k)
    return (
        usable.withColumn("new_rank", F.row_number().over(ranking))
        .where(F.col("new_rank") <= limit)
        .drop("relevance", "_scored")
    )
