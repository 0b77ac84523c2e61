"""Frozen question sets."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewell import constants as K
from tidewell.functions.replies import qa_or_fallback
from tidewell.operators.ranking import sample_chunks


def build_golden_set(
    chunks: DataFrame, existing: DataFrame, replies: DataFrame, n: int = K.GOLDEN_SAMPLE
) -> DataFrame:
    """Golden rows of all pipelines: sets that exist stay untouched, others are made once.

    chunks: chunk_id, pipeline_id, content. replies: chunk_id, reply, where a missing or
    unreadable reply falls back to the chunk's own words. A new set has `n` sampled
    chunks and the fixed anchors; set_key numbers its rows.
    """
    fresh = chunks.join(existing.select("pipeline_id").distinct(), "pipeline_id", "left_anti")
    picked = sample_chunks(fresh, n).join(replies, "chunk_id", "left")
    qa = qa_or_fallback(F.coalesce("reply", F.lit("")), F.col("content"))
    synthetic = picked.withColumn("_qa", qa).select(
        "pipeline_id",
        F.col("pick").cast("int").alias("set_key"),
        F.col("_qa.question").alias("question"),
        F.col("_qa.expected_answer").alias("expected_answer"),
        F.array(F.col("chunk_id").cast("string")).alias("expected_chunks"),
        F.lit("synthetic").alias("question_type"),
        F.lit(1).alias("set_version"),
    )
    anchors = F.array(*[F.lit(q) for q in K.ANCHOR_QUESTIONS])
    fixed = (
        fresh.select("pipeline_id")
        .distinct()
        .select("pipeline_id", F.posexplode(anchors).alias("_i", "question"))
        .select(
            "pipeline_id",
            (F.col("_i") + n + 1).alias("set_key"),
            "question",
            F.lit(None).cast("string").alias("expected_answer"),
            F.array().cast("array<string>").alias("expected_chunks"),
            F.lit("adversarial_fixed").alias("question_type"),
            F.lit(1).alias("set_version"),
        )
    )
    return existing.unionByName(synthetic).unionByName(fixed)


def golden_set_id(golden: DataFrame) -> DataFrame:
    """The id of a set is that of its first row."""
    return golden.groupBy("pipeline_id").agg(F.min("set_key").alias("golden_set_id"))
