"""Newest rows, run lists, trends and samples."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidewell import constants as K
from tidewell.functions import ordered


def latest_per_key(df: DataFrame, key: str, ts: str, tie: str) -> DataFrame:
    """Newest row per key by a combined maximum; ties go to the larger `tie`."""
    rest = [c for c in df.columns if c != key]
    newest = df.groupBy(key).agg(F.max_by(F.struct(*rest), F.struct(ts, tie)).alias("_row"))
    return newest.select(key, "_row.*")


def recent_n(df: DataFrame, key: str, ts: str, tie: str, n: int = K.RECENT_RUNS) -> DataFrame:
    """Newest `n` rows per key with their position, newest first."""
    return ordered.newest(df, [key], [F.col(ts).desc(), F.col(tie).desc()], n)


def eval_scores(evaluations: DataFrame, runs: DataFrame, n: int = 20) -> DataFrame:
    """Newest `n` scores per pipeline: pipeline_id, run_id, unified_score, created_at, rn."""
    joined = evaluations.join(runs.select("run_id", "pipeline_id"), "run_id")
    return recent_n(joined, "pipeline_id", "created_at", "run_id", n)


def experiments_by_pipeline(experiments: DataFrame, runs: DataFrame) -> DataFrame:
    """Experiments with the pipeline of their run."""
    return experiments.join(runs.select("run_id", "pipeline_id"), "run_id")


def runs_with_latest_eval(runs: DataFrame, evaluations: DataFrame, n: int = K.RECENT_RUNS) -> DataFrame:
    """Newest `n` runs per pipeline, each with its latest score or null and false."""
    recent = recent_n(runs, "pipeline_id", "created_at", "run_id", n)
    latest = evaluations.groupBy("run_id").agg(
        F.max_by(
            F.struct("unified_score", "deploy_eligible"), F.struct("evaluated_at", "evaluation_id")
        ).alias("_e")
    )
    return recent.join(latest, "run_id", "left").select(
        *recent.columns,
        F.col("_e.unified_score").alias("unified_score"),
        F.coalesce(F.col("_e.deploy_eligible"), F.lit(False)).alias("deploy_eligible"),
    )


def _recent_scores(runs: DataFrame, n: int) -> DataFrame:
    scored = runs.where(F.col("unified_score").isNotNull())
    return ordered.newest(scored, ["pipeline_id"], [F.col("created_at").desc(), F.col("run_id").desc()], n)


def score_trend(runs: DataFrame) -> DataFrame:
    """pipeline_id, change, is_positive: latest against previous score in points."""
    top = _recent_scores(runs, 2)
    pair = top.groupBy("pipeline_id").agg(
        F.max(F.when(F.col("rn") == 1, F.col("unified_score") * 100)).alias("latest"),
        F.max(F.when(F.col("rn") == 2, F.col("unified_score") * 100)).alias("previous"),
    )
    diff = F.round(F.col("latest") - F.col("previous"), 1)
    return pair.where(F.col("previous").isNotNull()).select(
        "pipeline_id", F.abs(diff).alias("change"), (diff >= 0).alias("is_positive")
    )


def sparkline(runs: DataFrame, n: int = 10) -> DataFrame:
    """pipeline_id, points: last `n` scores scaled to 0..1, oldest first."""
    kept = _recent_scores(runs, n).groupBy("pipeline_id").agg(
        F.array_sort(F.collect_list(F.struct((-F.col("rn")).alias("at"), (F.col("unified_score") * 100).alias("v")))).alias("_h")
    )
    values = F.transform("_h", lambda h: h["v"])
    lo, hi = F.array_min("_v"), F.array_max("_v")
    span = F.when(hi - lo == 0, 1.0).otherwise(hi - lo)
    return kept.select("pipeline_id", values.alias("_v")).select(
        "pipeline_id", F.transform("_v", lambda v: (v - lo) / span).alias("points")
    )


def sample_chunks(chunks: DataFrame, n: int = K.GOLDEN_SAMPLE, seed: str = "") -> DataFrame:
    """`n` chunks per pipeline in an order fixed by the hash of id and seed."""
    draw = F.md5(F.concat(F.col("chunk_id").cast("string"), F.lit(seed)))
    return ordered.newest(
        chunks.withColumn("_draw", draw), ["pipeline_id"], [F.col("_draw"), F.col("chunk_id")], n, "pick"
    ).drop("_draw")


def activity_feed(pipelines: DataFrame, documents: DataFrame, runs: DataFrame) -> DataFrame:
    """First six of: all pipelines, five newest documents, five newest runs."""

    def entries(df: DataFrame, kind: str, part: int, limit: int) -> DataFrame:
        top = df.orderBy(F.col("created_at").desc(), F.col("id").desc()).limit(limit)
        at = W.partitionBy(F.lit(part)).orderBy(F.col("created_at").desc(), F.col("id").desc())
        return top.select(
            F.lit(kind).alias("kind"),
            F.col("id"),
            F.col("status"),
            F.lit(part).alias("part"),
            F.row_number().over(at).alias("at"),
        )

    feed = (
        entries(pipelines, "pipeline", 0, 6)
        .unionByName(entries(documents, "document", 1, 5))
        .unionByName(entries(runs, "evaluation", 2, 5))
    )
    return feed.orderBy("part", "at").limit(6)


def count_per_pipeline(chunks: DataFrame) -> DataFrame:
    return chunks.groupBy("pipeline_id").agg(F.count("*").alias("n_chunks"))
