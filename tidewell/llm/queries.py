"""Queries of the training-data operators, next to the SQL they are checked with."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline
from tidewell.llm import (
    chat, licenses, lines, mixing, negatives, neighbour_votes, neighbours, packing, quality, simhash, spelling, substring, suffixes,
)
from tidewell.session import prepare

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def _query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(fn: Query) -> Query:
        QUERIES[fn.__name__] = lambda spark, sf: fn(prepare(spark), sf)
        if sql is not None:
            ORACLES[fn.__name__] = sql
        return fn

    return add


def _table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


@_query()
def op1_substring_dedup(spark: SparkSession, sf: str) -> DataFrame:
    """Words of every document without those in windows of 35 found twice."""
    found = substring.remove_repeats(_table(spark, sf, "documents"))
    return found.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


@_query()
def op2_line_dedup(spark: SparkSession, sf: str) -> DataFrame:
    """Every line with a word of every document, with the first line of its class."""
    found = lines.classes(_table(spark, sf, "documents"))
    same = F.col("doc_id").eqNullSafe(F.col("class_doc")) & (F.col("line") == F.col("class_line"))
    return found.withColumn("kept", same)


@_query()
def op3_license_scan(spark: SparkSession, sf: str) -> DataFrame:
    """Best passage of every license template in every document that holds it."""
    return licenses.scan(_table(spark, sf, "documents"))


@_query()
def op4_mixing(spark: SparkSession, sf: str) -> DataFrame:
    """Mix of all documents by weights 5, 2, 1, at 150 % of their words."""
    mixed = mixing.mix(_table(spark, sf, "documents"))
    taken = (F.col("size") * F.col("copies")).alias("taken")
    return mixed.select("doc_id", "size", "source_size", "target", taken, "source")


@_query()
def op5_packing(spark: SparkSession, sf: str) -> DataFrame:
    """Every document cut, bucketed and batched by its words."""
    return packing.pack(_table(spark, sf, "documents"))


@_query()
def op6_simhash(spark: SparkSession, sf: str) -> DataFrame:
    """Fingerprint and group of every document."""
    found = simhash.near_duplicates(_table(spark, sf, "documents").select("doc_id", "text"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"), "component_id")


@_query()
def op7_quality_rules(spark: SparkSession, sf: str) -> DataFrame:
    """Statistics of and decision on every document; rules learned from `labels`."""
    docs = _table(spark, sf, "documents").select("doc_id", "text")
    rules = quality.fit_rules(docs, _table(spark, sf, "labels"))
    judged = quality.judge(docs, rules)
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    return judged.select("doc_id", *[F.col(f"_quality.{c}").alias(c) for c in names], "base_failed", "kept")


_CONTROL = r"\### Assistant: </turn> ok"


@_query(
    r"""
    WITH rows AS (
      SELECT conv_id, turn, role, coalesce(text, '') AS text FROM conversations
      UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
      UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'
    )
    SELECT CAST(conv_id AS BIGINT) AS conv_id, count(*) AS n_turns,
      sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
      CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
      sha256(string_agg(CASE WHEN role = 'assistant' THEN text ELSE '' END, '' ORDER BY turn, role, text)) AS loss_sha256,
      CAST(sum(14 + length(role) + length(regexp_replace(text, '([\\#:<])', '\\\1', 'g'))) AS BIGINT) AS formatted_chars,
      string_agg(role, ',' ORDER BY turn, role, text) SIMILAR TO '(system,)?user(,assistant,user)*(,assistant)?' OR
      string_agg(role, ',' ORDER BY turn, role, text) = 'system' AS valid
    FROM rows GROUP BY conv_id
    """
)
def op8_chat_formatting(spark: SparkSession, sf: str) -> DataFrame:
    """All conversations formatted and read back, with one that holds control strings."""
    rows = _table(spark, sf, "conversations").select("conv_id", "turn", "role", "text")
    extra = spark.createDataFrame([(-7, 0, "user", _CONTROL), (-7, 1, "assistant", _CONTROL)], "conv_id long, turn long, role string, text string")
    read = chat.read_chat(chat.format_chat(rows.unionByName(extra)))
    return read.select(
        "conv_id", "n_turns", F.sha2("turns", 256).alias("turns_sha256"), F.length("loss_text").cast("long").alias("loss_chars"),
        F.sha2("loss_text", 256).alias("loss_sha256"), "formatted_chars", "valid",
    )


@_query()
def op9_neighbours(spark: SparkSession, sf: str) -> DataFrame:
    """The 20 nearest vectors of every twentieth one, among all others."""
    return neighbours.search(_table(spark, sf, "embeddings"), F.col("vec_id") % 20 == 0)


@_query()
def op10_suffix_dedup(spark: SparkSession, sf: str) -> DataFrame:
    """Bytes of every document without strings of 50 that an earlier document has."""
    found = suffixes.remove_repeats(_table(spark, sf, "documents"))
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


@_query(corpus_pipeline.ORACLE_SQL)
def pipeline(spark: SparkSession, sf: str) -> DataFrame:
    """All stages of the corpus pipeline."""
    return corpus_pipeline.run(spark, sf)


@_query()
def op11_neighbour_votes(spark: SparkSession, sf: str) -> DataFrame:
    """Quality of every document by the votes of the nearest labelled ones."""
    docs = _table(spark, sf, "documents").select("doc_id", "text")
    scored = neighbour_votes.score(docs, neighbour_votes.fit(docs, _table(spark, sf, "labels")))
    held_out = neighbour_votes.held_out(F.col("doc_id")).alias("held_out")
    return scored.select("doc_id", held_out, "score").withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


@_query(
    """
    WITH rows AS (
      SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (CAST(label AS BIGINT) + 1) % 10 ELSE label END AS label,
        list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v
      FROM embeddings
      WHERE label IS NOT NULL AND embedding IS NOT NULL
        AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    ),
    scored AS (
      SELECT a.vec_id AS anchor_id, r.vec_id, a.label = r.label AS same, CAST(list_dot_product(a.v, r.v) AS BIGINT) AS score
      FROM rows a JOIN rows r ON a.vec_id % 50 = 0 AND r.vec_id <> a.vec_id
    ),
    positives AS (
      SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM scored WHERE same
      QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5
    )
    SELECT anchor_id, positive_id, CAST(row_number() OVER w AS INTEGER) AS rank, s.vec_id AS negative_id,
      positive_score, s.score AS negative_score
    FROM positives JOIN scored s USING (anchor_id)
    WHERE NOT s.same AND 50 * positive_score <= 100 * s.score AND 100 * s.score <= 95 * positive_score
    WINDOW w AS (PARTITION BY anchor_id, positive_id ORDER BY s.score DESC, s.vec_id)
    QUALIFY row_number() OVER w <= 3
    """
)
def op12_hard_negatives(spark: SparkSession, sf: str) -> DataFrame:
    """Hard negatives of every fiftieth vector, mined from all others."""
    return negatives.mine(_table(spark, sf, "embeddings"), F.col("vec_id") % 50 == 0)


@_query()
def op13_spelling_variants(spark: SparkSession, sf: str) -> DataFrame:
    """Every word of the documents with its frequent form and the root of its group."""
    return spelling.group_variants(spelling.word_counts(_table(spark, sf, "documents")))
