"""Scoring of runs against golden sets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidewell.functions import ordered, scoring
from tidewell.functions.medians import upper_median
from tidewell.functions.text import is_refusal


def retrieval_scores(rankings: DataFrame, expected: DataFrame, keys: list[str]) -> DataFrame:
    """keys, n_ranked, n_expected, hits, recall, precision for every ranked query.

    rankings: keys, chunk_id, rank (1-based). Recall is hits / max(expected, 1). Precision
    is average precision: hits so far / rank summed over the hits, divided by the number
    expected, at most 1, and 0 without expectations. Hit ranks are gathered per bucket of
    ranks only and carry on from the counts of earlier buckets, so one long ranking
    spreads over tasks.
    """
    seen = rankings.select(*keys, "chunk_id", "rank", F.lit(0).alias("_e")).unionByName(
        expected.select(*keys, "chunk_id", F.lit(None).cast("long").alias("rank"), F.lit(1).alias("_e"))
    )
    chunks = seen.groupBy(*keys, "chunk_id").agg(F.min("rank").alias("rank"), F.max("_e").alias("_e"))
    bucket = F.coalesce(F.floor(F.col("rank") / ordered.BUCKET_ROWS), F.lit(-1))
    hit = (F.col("_e") == 1) & F.col("rank").isNotNull()
    parts = chunks.groupBy(*keys, bucket.alias("_bucket")).agg(
        F.count("rank").alias("_ranked"),
        F.sum("_e").alias("_expected"),
        F.array_sort(F.collect_list(F.when(hit, F.col("rank")))).alias("_ranks"),
    )
    before = W.partitionBy(*keys).orderBy("_bucket").rowsBetween(W.unboundedPreceding, -1)
    carried = parts.withColumn("_before", F.coalesce(F.sum(F.size("_ranks")).over(before), F.lit(0)))
    shares = F.transform("_ranks", lambda r, i: (F.col("_before") + i + 1) / r)
    summed = F.aggregate(shares, F.lit(0.0), lambda acc, x: acc + x)
    totals = carried.groupBy(*keys).agg(
        F.sum("_ranked").alias("n_ranked"),
        F.sum("_expected").alias("n_expected"),
        F.sum(F.size("_ranks")).alias("hits"),
        F.sum(summed).alias("_ap"),
    )
    size = F.greatest("n_expected", F.lit(1))
    return totals.where(F.col("n_ranked") > 0).select(
        *keys,
        "n_ranked",
        "n_expected",
        "hits",
        (F.col("hits") / size).alias("recall"),
        F.least(F.col("_ap") / size, F.lit(1.0)).alias("precision"),
    )


def context_recall(rankings: DataFrame, expected: DataFrame, keys: list[str]) -> DataFrame:
    return retrieval_scores(rankings, expected, keys).select(*keys, "recall")


def context_precision(rankings: DataFrame, expected: DataFrame, keys: list[str]) -> DataFrame:
    return retrieval_scores(rankings, expected, keys).select(*keys, "precision")


def adversarial_rate(answers: DataFrame, keys: list[str]) -> DataFrame:
    """keys, n, passes, pass_rate, fails over adversarial_fixed answers."""
    adversarial = F.col("question_type") == "adversarial_fixed"
    n = F.sum(adversarial.cast("long"))
    passes = F.sum((adversarial & F.coalesce(is_refusal(F.col("answer")), F.lit(False))).cast("long"))
    return (
        answers.groupBy(*keys)
        .agg(n.alias("n"), passes.alias("passes"))
        .withColumns(
            {
                "pass_rate": F.col("passes") / F.greatest("n", F.lit(1)),
                "fails": F.col("n") - F.col("passes"),
            }
        )
    )


def judge_notes(reasonings: DataFrame, keys: list[str], order: str, n: int = 3) -> DataFrame:
    """keys, judge_reasoning: the first `n` notes joined by `; `."""
    first = ordered.newest(reasonings, keys, [F.col(order)], n)
    notes = F.transform(F.array_sort(F.collect_list(F.struct("rn", "reasoning"))), lambda s: s["reasoning"])
    return first.groupBy(*keys).agg(F.array_join(notes, "; ").alias("judge_reasoning"))


def evaluate_runs(
    runs: DataFrame, golden: DataFrame, rankings: DataFrame, expected: DataFrame, answers: DataFrame
) -> DataFrame:
    """One evaluation row per run.

    runs: run_id. golden: run_id, query_id, question_type. rankings: run_id, query_id,
    chunk_id, rank. expected: run_id, query_id, chunk_id. answers: run_id, query_id,
    answer, latency_ms, faithfulness, relevancy, reasoning.
    """
    by_query = ["run_id", "query_id"]
    asked = answers.join(golden.select(*by_query, "question_type"), by_query)
    retrieved = retrieval_scores(rankings, expected, by_query).select(*by_query, "recall", "precision")
    synthetic = F.col("question_type") == "synthetic"
    adversarial = F.col("question_type") == "adversarial_fixed"
    refused = adversarial & F.coalesce(is_refusal(F.col("answer")), F.lit(False))

    def mean(value) -> Column:
        return F.coalesce(F.avg(F.when(synthetic, value)), F.lit(0.0))

    scored = asked.join(retrieved, by_query, "left").groupBy("run_id").agg(
        mean(F.coalesce("recall", F.lit(0.0))).alias("context_recall"),
        mean(F.coalesce("precision", F.lit(0.0))).alias("context_precision"),
        mean(F.col("faithfulness")).alias("faithfulness"),
        mean(F.col("relevancy")).alias("relevancy"),
        F.sum(adversarial.cast("long")).alias("n"),
        F.sum(refused.cast("long")).alias("passes"),
    )
    answered = asked.where(synthetic)
    latency = upper_median(answered, "latency_ms", ["run_id"], "median_ms")
    notes = judge_notes(answered, ["run_id"], "query_id")
    base = runs.select("run_id")
    for part in (scored, latency, notes):
        base = base.join(part, "run_id", "left")
    zero = ["context_recall", "context_precision", "faithfulness", "relevancy", "median_ms", "n", "passes"]
    filled = base.fillna(0, subset=zero).fillna("", subset=["judge_reasoning"]).withColumns(
        {
            "pass_rate": F.col("passes") / F.greatest("n", F.lit(1)),
            "fails": F.col("n") - F.col("passes"),
        }
    )
    return decide(filled)


def decide(metrics: DataFrame) -> DataFrame:
    """Score, decision and diagnosis from averaged metrics; gates see unrounded doubles."""
    staged = metrics.withColumns(
        {
            "retrieval_score": F.col("context_recall"),
            "quality_score": scoring.quality(F.col("relevancy"), F.col("context_precision")),
            "latency_penalty": scoring.latency_penalty(F.col("median_ms")),
            "cost_penalty": F.lit(0.0),
        }
    )
    staged = staged.withColumn(
        "unified_score",
        scoring.unified_score(
            F.col("retrieval_score"), F.col("quality_score"), F.col("faithfulness"),
            F.col("latency_penalty"), F.col("cost_penalty"),
        ),
    )
    decision = scoring.deploy_decision(F.col("unified_score"), F.col("faithfulness"), F.col("pass_rate"))
    staged = staged.withColumn("decision", decision)
    return staged.withColumns(
        {
            "deploy_eligible": F.col("decision") == "deploy",
            "failure_reason": F.when(F.col("decision").startswith("blocked"), F.col("decision")),
            "diagnosis": scoring.diagnose(
                F.col("context_recall"), F.col("context_precision"), F.col("faithfulness"), F.col("pass_rate")
            ),
        }
    )


def to_evaluation_rows(evaluated: DataFrame) -> DataFrame:
    """Stored form: scores as DECIMAL(5,4)."""
    scores = {
        "unified_score": "unified_score",
        "retrieval_score": "retrieval_score",
        "quality_score": "quality_score",
        "faithfulness_score": "faithfulness",
        "latency_penalty": "latency_penalty",
        "cost_penalty": "cost_penalty",
        "context_precision": "context_precision",
        "context_recall": "context_recall",
        "answer_relevancy": "relevancy",
        "adversarial_pass_rate": "pass_rate",
    }
    return evaluated.select(
        "run_id",
        *[F.col(src).cast("decimal(5,4)").alias(name) for name, src in scores.items()],
        F.col("fails").alias("adversarial_fail_count"),
        "deploy_eligible",
        "failure_reason",
        "judge_reasoning",
    )
