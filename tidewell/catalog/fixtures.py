"""Inputs of the queries, derived from the given tables, and the same in SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewell import constants as K
from tidewell.functions.rows import let
from tidewell.functions.text import terms
from tidewell.session import materialise, stored_bytes


_TEXTS = ("documents", "pages", "conversations")
#: Stored bytes of texts in one partition, so that tasks stay alike however large a table is.
PART_BYTES = 8 << 20


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    """A given table; texts are spread evenly, as the given files may be one row group."""
    path = f"{sf}/{name}.parquet"
    df = spark.read.parquet(path)
    return df.repartition(text_parts(spark, path)) if name in _TEXTS else df


def text_parts(spark: SparkSession, path: str) -> int:
    """Partitions of a table of texts: by its stored size, and one a core at least."""
    return max(spark.sparkContext.defaultParallelism, -(-stored_bytes(spark, path) // PART_BYTES))


def sql_list(values: list[str]) -> str:
    return ", ".join("'" + v.replace("'", "''") + "'" for v in values)


STOPS = sql_list(K.STOP_WORDS)

# Chunks: all documents, with the vector of the same id where there is one; the label, or
# the last digit of the id, is the pipeline.
CHUNKS = """
chunks AS (
  SELECT d.doc_id AS chunk_id, CAST(coalesce(e.label, d.doc_id % 10) AS INTEGER) AS pipeline_id, d.doc_id AS document_id,
         d.text AS content, e.embedding, d.lang, d.source
  FROM documents d LEFT JOIN embeddings e ON d.doc_id = e.vec_id
)"""


def chunks(spark: SparkSession, sf: str) -> DataFrame:
    # Both sides are dealt by the id, so texts are shuffled once for the join and for what groups by chunk.
    path = f"{sf}/documents.parquet"
    parts = text_parts(spark, path)
    d = spark.read.parquet(path).repartition(parts, "doc_id")
    e = table(spark, sf, "embeddings").repartition(parts, "vec_id")
    return d.join(e, e.vec_id == d.doc_id, "left").select(
        F.col("doc_id").alias("chunk_id"),
        F.coalesce("label", F.col("doc_id") % 10).cast("int").alias("pipeline_id"),
        F.col("doc_id").alias("document_id"),
        F.col("text").alias("content"),
        "embedding",
        "lang",
        "source",
        F.create_map(F.lit("lang"), "lang", F.lit("source"), "source").alias("metadata"),
    )


# Queries: one per chunk; its vector, and of its text the longest term, mostly a rare one,
# with the shortest, mostly a frequent one. Every third query asks for the shortest alone.
QUERY_TEXT = f"""
query_text AS (
  SELECT chunk_id AS query_id, pipeline_id, embedding AS q_embedding,
         CASE WHEN len(t) = 0 THEN [] WHEN chunk_id % 3 = 0 OR len(t) = 1 THEN [t[1]] ELSE [t[-1], t[1]] END AS qterms
  FROM (
    SELECT chunk_id, pipeline_id, embedding, list_transform(list_sort(list_transform(list_filter(list_distinct(
             regexp_extract_all(lower(content), '[\\p{{L}}\\p{{Nd}}]+')), lambda t: length(t) > 1 AND t NOT IN ({STOPS})),
             lambda t: {{'n': length(t), 't': t}})), lambda s: s.t) AS t
    FROM chunks)
)"""


def queries(spark: SparkSession, sf: str) -> DataFrame:
    stops = F.array(*[F.lit(w) for w in K.STOP_WORDS])
    usable = F.filter(F.array_except(terms(F.col("content")), stops), lambda t: F.length(t) > 1)
    sized = F.transform(usable, lambda t: F.struct(F.length(t).alias("n"), t.alias("t")))

    def text(found: Column) -> Column:
        shortest, longest = F.array_min(found)["t"], F.array_max(found)["t"]
        one = (F.col("chunk_id") % 3 == 0) | (F.size(found) == 1)
        return F.when(F.size(found) == 0, "").when(one, shortest).otherwise(F.concat_ws(" ", longest, shortest))

    # The terms of a text are found once, however often they are used.
    asked = chunks(spark, sf).select(
        F.col("chunk_id").alias("query_id"), "pipeline_id", let(sized, text).alias("q"), F.col("embedding").alias("q_embedding")
    )
    return materialise(asked)


# Passages of the benchmark, asked of every pipeline.
PASSAGES = """
query_text AS (
  SELECT item_id * 10 + p AS query_id, CAST(p AS INTEGER) AS pipeline_id,
         list_distinct(regexp_extract_all(lower(text), '[\\p{L}\\p{Nd}]+')) AS qterms
  FROM benchmark, range(10) r(p)
)"""


def passages(spark: SparkSession, sf: str) -> DataFrame:
    dealt = table(spark, sf, "benchmark").withColumn("p", F.explode(F.sequence(F.lit(0), F.lit(9))))
    return dealt.select((F.col("item_id") * 10 + F.col("p")).alias("query_id"), F.col("p").alias("pipeline_id"), F.col("text").alias("q"))


# Rankings: the parts of an order by line number; expected are the returned ones.
RANKINGS = """
firsts AS (
  SELECT l_orderkey AS query_id, l_partkey AS chunk_id, min(l_linenumber) AS line,
         max(l_discount) AS score,
         max(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END) AS expected
  FROM lineitem GROUP BY 1, 2
),
rankings AS (
  SELECT query_id, chunk_id, score, expected,
         row_number() OVER (PARTITION BY query_id ORDER BY line, chunk_id) AS rank
  FROM firsts
)"""


def rankings(spark: SparkSession, sf: str) -> DataFrame:
    from tidewell.functions import ordered

    firsts = (
        table(spark, sf, "lineitem")
        .groupBy(F.col("l_orderkey").alias("query_id"), F.col("l_partkey").alias("chunk_id"))
        .agg(
            F.min("l_linenumber").alias("line"),
            F.max("l_discount").alias("score"),
            F.max((F.col("l_returnflag") == "R").cast("int")).alias("expected"),
        )
    )
    bucket = F.floor(F.col("line") / ordered.BUCKET_ROWS)
    ranked = ordered.number_lists(firsts, ["query_id"], ["line", "chunk_id"], bucket, "rank")
    return materialise(ranked.drop("line"))


def expected(rankings: DataFrame) -> DataFrame:
    return rankings.where("expected = 1").select("query_id", "chunk_id")


# Evaluations: one per order, scored from its price; the customer is the pipeline.
EVALUATIONS = """
evaluations AS (
  SELECT o_orderkey AS run_id, o_custkey AS pipeline_id, o_orderdate AS created_at,
         (CAST(floor(o_totalprice) AS BIGINT) % 1009) / 1009.0::DOUBLE AS unified_score,
         o_orderstatus, o_orderpriority
  FROM orders
)"""


def evaluations(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("run_id"),
        F.col("o_custkey").alias("pipeline_id"),
        F.col("o_orderdate").alias("created_at"),
        (F.floor("o_totalprice").cast("long") % 1009 / F.lit(1009.0)).alias("unified_score"),
        "o_orderstatus",
        "o_orderpriority",
    )


# Deployments: one per order; open orders are active and follow the customer's last one.
DEPLOYMENTS = """
deployments AS (
  SELECT o_orderkey AS deployment_id, o_custkey AS pipeline_id, o_orderkey AS run_id,
         o_orderdate AS activated_at,
         CASE WHEN o_orderstatus = 'O' THEN 'active' ELSE 'superseded' END AS status,
         CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE o_orderkey - 1 END AS previous_deployment,
         (CAST(floor(o_totalprice) AS BIGINT) % 1009) / 1009.0::DOUBLE AS unified_score
  FROM orders
)"""


def deployments(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("deployment_id"),
        F.col("o_custkey").alias("pipeline_id"),
        F.col("o_orderkey").alias("run_id"),
        F.col("o_orderdate").alias("activated_at"),
        F.when(F.col("o_orderstatus") == "O", "active").otherwise("superseded").alias("status"),
        F.when(F.col("o_orderkey") % 3 != 0, F.col("o_orderkey") - 1).alias("previous_deployment"),
        (F.floor("o_totalprice").cast("long") % 1009 / F.lit(1009.0)).alias("unified_score"),
    )


# Answers: conversation turns with citations and some refusals worked in.
ANSWERS = """
answers AS (
  SELECT conv_id, turn, conv_id * 1000 + turn AS answer_id, role,
         CASE WHEN turn % 3 = 1 THEN 'Based on the provided context, ' ELSE '' END
         || replace(text, '. ', ' ' || (turn % 9 + 1) || (conv_id % 9 + 1) || '. ')
         || CASE WHEN (conv_id + turn) % 4 = 0 THEN ' I cannot answer.' ELSE '' END AS answer
  FROM conversations
)"""


def answers(spark: SparkSession, sf: str) -> DataFrame:
    marks = F.concat(
        F.lit(" "), (F.col("turn") % 9 + 1).cast("string"), (F.col("conv_id") % 9 + 1).cast("string"), F.lit(". ")
    )
    opening = F.when(F.col("turn") % 3 == 1, "Based on the provided context, ").otherwise("")
    ending = F.when((F.col("conv_id") + F.col("turn")) % 4 == 0, " I cannot answer.").otherwise("")
    return table(spark, sf, "conversations").select(
        "conv_id",
        "turn",
        (F.col("conv_id") * 1000 + F.col("turn")).alias("answer_id"),
        "role",
        F.concat(opening, F.replace("text", F.lit(". "), marks), ending).alias("answer"),
    )
