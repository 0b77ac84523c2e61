"""Score, gate and policy columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidewell import constants as K
from tidewell.functions.rows import let


def latency_penalty(median_ms: Column) -> Column:
    return (
        F.when(median_ms <= K.LATENCY_GOOD_MS, 0.0)
        .when(median_ms <= K.LATENCY_OK_MS, 0.5)
        .otherwise(1.0)
    )


def quality(relevancy: Column, precision: Column) -> Column:
    return (relevancy + precision) / 2


def unified_score(
    retrieval: Column, quality: Column, faithfulness: Column, latency: Column, cost: Column
) -> Column:
    return (
        K.WEIGHT_RETRIEVAL * retrieval
        + K.WEIGHT_QUALITY * quality
        + K.WEIGHT_FAITHFULNESS * faithfulness
        - K.WEIGHT_LATENCY * latency
        - K.WEIGHT_COST * cost
    )


def deploy_decision(score: Column, faithfulness: Column, adversarial: Column) -> Column:
    """The two hard gates come before the score bands."""
    return (
        F.when(faithfulness < K.FAITHFULNESS_GATE, "blocked_faithfulness")
        .when(adversarial < K.ADVERSARIAL_GATE, "blocked_adversarial")
        .when(score >= K.DEPLOY_SCORE, "deploy")
        .when(score >= K.IMPROVE_SCORE, "improve")
        .otherwise("blocked_score")
    )


def diagnose(recall: Column, precision: Column, faithfulness: Column, adversarial: Column) -> Column:
    """Hints in a fixed order; a missing recall or precision counts as perfect."""
    return F.array_compact(
        F.array(
            F.when(F.coalesce(recall, F.lit(1.0)) < 0.7, K.HINT_RECALL),
            F.when(F.coalesce(precision, F.lit(1.0)) < 0.7, K.HINT_PRECISION),
            F.when(faithfulness < 0.9, K.HINT_FAITHFULNESS),
            F.when(adversarial < 0.9, K.HINT_REFUSAL),
        )
    )


def effective_score(score: Column, rrf_score: Column) -> Column:
    return F.when(score != 0, score).otherwise(rrf_score)


def config_diff(variant: Column, baseline: Column) -> Column:
    """Sorted keys whose values differ; a missing key counts as null."""
    keys = F.array_sort(F.array_union(F.map_keys(variant), F.map_keys(baseline)))
    return F.filter(
        keys,
        lambda k: ~F.try_element_at(variant, k).eqNullSafe(F.try_element_at(baseline, k)),
    )


def approval_tier(variant: Column, baseline: Column, mode: Column) -> Column:

    def by_changes(changed: Column) -> Column:
        low = (F.size(changed) > 0) & F.forall(changed, lambda k: k.isin(*K.LOW_RISK_KEYS))
        return (
            F.when(F.arrays_overlap(changed, F.array(*map(F.lit, K.HIGH_RISK_KEYS))), "mandatory_gate")
            .when(F.arrays_overlap(changed, F.array(*map(F.lit, K.MEDIUM_RISK_KEYS))), "human_in_loop")
            .when(low, "auto")
            .otherwise("human_in_loop")
        )

    return F.when(mode.isin("auto", "mandatory_gate"), mode).otherwise(
        let(config_diff(variant, baseline), by_changes)
    )


def propose_variant(config: Column, diagnosis: Column) -> Column:
    """Next configuration (map<string,string>) for a list of hints."""
    top_k = F.coalesce(F.try_element_at(config, F.lit("top_k")).try_cast("int"), F.lit(K.DEFAULT_TOP_K))

    def top_k_plus(step: int) -> Column:
        return F.create_map(F.lit("top_k"), F.least(top_k + step, F.lit(K.MAX_TOP_K)).cast("string"))

    def hint_set(hint: str, entry: Column) -> Column:
        empty = F.map_from_arrays(
            F.array().cast("array<string>"), F.array().cast("array<string>")
        )
        return F.when(F.array_contains(diagnosis, hint), entry).otherwise(empty)

    def flag(key: str) -> Column:
        return F.create_map(F.lit(key), F.lit("true"))

    changes = F.map_concat(
        hint_set(K.HINT_RECALL, top_k_plus(3)),
        hint_set(K.HINT_PRECISION, flag("rerank_enabled")),
        hint_set(K.HINT_FAITHFULNESS, flag("grounding_strict")),
        hint_set(K.HINT_REFUSAL, flag("refusal_instruction")),
    )
    return let(
        let(changes, lambda made: overlay(config, made)),
        lambda variant: F.when(F.size(config_diff(variant, config)) > 0, variant).otherwise(
            overlay(config, top_k_plus(2))
        ),
    )


def overlay(base: Column, changes: Column) -> Column:
    """Map update: entries of `changes` replace those of `base`."""
    return F.map_concat(F.map_filter(base, lambda k, _: ~F.map_contains_key(changes, k)), changes)


def after_evaluator(
    score: Column, faithfulness: Column, eligible: Column, has_variant: Column
) -> Column:
    low = (F.coalesce(faithfulness, F.lit(0.0)) < K.FAITHFULNESS_GATE) | (
        F.coalesce(score, F.lit(0.0)) < K.IMPROVE_SCORE
    )
    return (
        F.when(low, "END")
        .when(eligible & has_variant, "deployer")
        .when(eligible, "observer")
        .otherwise("improver")
    )


def after_observer(drift: Column) -> Column:
    return F.when(drift, "improver").otherwise("END")


def after_improver(has_variant: Column) -> Column:
    return F.when(has_variant, "evaluator").otherwise("END")


def next_step(
    stage: Column,
    score: Column,
    faithfulness: Column,
    eligible: Column,
    has_variant: Column,
    drift: Column,
) -> Column:
    return (
        F.when(stage == "evaluator", after_evaluator(score, faithfulness, eligible, has_variant))
        .when(stage == "observer", after_observer(drift))
        .when(stage == "improver", after_improver(has_variant))
        .when(stage == "deployer", "observer")
    )
