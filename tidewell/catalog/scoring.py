"""Evaluation, drift, rankings over time and golden sets."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewell import constants as K
from tidewell.catalog import fixtures as fx
from tidewell.catalog.registry import query
from tidewell.functions import scoring
from tidewell.functions.medians import upper_median
from tidewell.operators import drift, evaluation, golden, ranking




@query(
    "context_recall",
    "WITH " + fx.RANKINGS + """
SELECT query_id, sum(CASE WHEN rank <= 5 THEN expected ELSE 0 END)::DOUBLE / greatest(sum(expected), 1) AS recall
FROM rankings GROUP BY 1""",
)
def context_recall(spark, sf):
    r = fx.rankings(spark, sf)
    return evaluation.context_recall(r.where(F.col("rank") <= K.DEFAULT_TOP_K), fx.expected(r), ["query_id"])


@query(
    "context_precision",
    "WITH " + fx.RANKINGS + """,
hits AS (
  SELECT query_id, rank, expected, sum(expected) OVER (PARTITION BY query_id ORDER BY rank) AS so_far FROM rankings
)
SELECT query_id, round(least(sum(CASE WHEN expected = 1 THEN so_far::DOUBLE / rank ELSE 0 END) / greatest(sum(expected), 1), 1), 9) AS precision
FROM hits GROUP BY 1""",
)
def context_precision(spark, sf):
    r = fx.rankings(spark, sf)
    return evaluation.context_precision(r, fx.expected(r), ["query_id"]).withColumn(
        "precision", F.round("precision", 9)
    )


@query(
    "adversarial_rate",
    "WITH " + fx.ANSWERS + """
SELECT conv_id, count(*) FILTER (role = 'assistant') AS n,
       count(*) FILTER (role = 'assistant' AND answer LIKE '%cannot answer%') AS passes,
       count(*) FILTER (role = 'assistant' AND answer LIKE '%cannot answer%')::DOUBLE
         / greatest(count(*) FILTER (role = 'assistant'), 1) AS pass_rate,
       count(*) FILTER (role = 'assistant' AND answer NOT LIKE '%cannot answer%') AS fails
FROM answers GROUP BY 1""",
)
def adversarial_rate(spark, sf):
    kind = F.when(F.col("role") == "assistant", "adversarial_fixed").otherwise("synthetic")
    return evaluation.adversarial_rate(fx.answers(spark, sf).withColumn("question_type", kind), ["conv_id"])


@query(
    "median_latency",
    """
SELECT event_type, list_sort(list(value))[count(*) // 2 + 1] AS median FROM events GROUP BY 1""",
)
def median_latency(spark, sf):
    return upper_median(fx.table(spark, sf, "events"), "value", ["event_type"], "median")


@query("median_latency_overall", "SELECT list_sort(list(value))[count(*) // 2 + 1] AS median FROM events")
def median_latency_overall(spark, sf):
    return upper_median(fx.table(spark, sf, "events"), "value", [], "median")


@query(
    "latency_penalty",
    """
SELECT event_id, CASE WHEN value * 200 <= 8000 THEN 0.0::DOUBLE WHEN value * 200 <= 15000 THEN 0.5::DOUBLE ELSE 1.0::DOUBLE END AS penalty FROM events""",
)
def latency_penalty(spark, sf):
    return fx.table(spark, sf, "events").select(
        "event_id", scoring.latency_penalty(F.col("value") * 200).alias("penalty")
    )


# Metrics of an order from the digits of its price.
_METRICS = """
metrics AS (
  SELECT o_orderkey AS run_id, ((p // 7) % 1000 + 0.37) / 1009.13::DOUBLE AS retrieval,
         ((p // 3) % 1000 + 0.37) / 1009.13::DOUBLE AS precision, ((p // 11) % 1000 + 0.37) / 1009.13::DOUBLE AS relevancy,
         (p % 1000 + 0.37) / 1009.13::DOUBLE AS faithfulness,
         CASE o_orderstatus WHEN 'P' THEN 0.8 ELSE 1.0 END::DOUBLE AS pass_rate, (p % 20000)::DOUBLE AS latency
  FROM (SELECT *, CAST(floor(o_totalprice) AS BIGINT) AS p FROM orders)
),
scored AS (
  SELECT *, (relevancy + precision) / 2 AS quality,
         CASE WHEN latency <= 8000 THEN 0.0 WHEN latency <= 15000 THEN 0.5 ELSE 1.0 END::DOUBLE AS penalty FROM metrics
),
unified AS (SELECT *, 0.25 * retrieval + 0.35 * quality + 0.25 * faithfulness - 0.1 * penalty AS score FROM scored)"""


def _metrics(spark, sf):
    p = F.floor("o_totalprice").cast("long")

    def part(digits, div):
        return ((F.floor(digits / div) % 1000) + 0.37) / 1009.13

    base = fx.table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("run_id"),
        part(p, 7).alias("retrieval"),
        part(p, 3).alias("precision"),
        part(p, 11).alias("relevancy"),
        part(p, 1).alias("faithfulness"),
        F.when(F.col("o_orderstatus") == "P", 0.8).otherwise(1.0).alias("pass_rate"),
        (p % 20000).cast("double").alias("latency"),
    )
    staged = base.withColumns(
        {
            "quality": scoring.quality(F.col("relevancy"), F.col("precision")),
            "penalty": scoring.latency_penalty(F.col("latency")),
        }
    )
    score = scoring.unified_score(
        F.col("retrieval"), F.col("quality"), F.col("faithfulness"), F.col("penalty"), F.lit(0.0)
    )
    return staged.withColumn("score", score)


@query(
    "deploy_decisions",
    "WITH " + _METRICS + """
SELECT run_id, round(quality, 9) AS quality, round(score, 9) AS score,
       CASE WHEN faithfulness < 0.5 THEN 'blocked_faithfulness' WHEN pass_rate < 1 THEN 'blocked_adversarial'
            WHEN score >= 0.72 THEN 'deploy' WHEN score >= 0.6 THEN 'improve' ELSE 'blocked_score' END AS decision,
       concat_ws(',', CASE WHEN retrieval < 0.7 THEN 'increase_top_k_or_chunk_overlap' END,
                 CASE WHEN precision < 0.7 THEN 'enable_rerank_or_tighten_chunks' END,
                 CASE WHEN faithfulness < 0.9 THEN 'strengthen_grounding_prompt' END,
                 CASE WHEN pass_rate < 0.9 THEN 'add_refusal_instruction' END) AS hints
FROM unified""",
)
def deploy_decisions(spark, sf):
    hints = scoring.diagnose(F.col("retrieval"), F.col("precision"), F.col("faithfulness"), F.col("pass_rate"))
    return _metrics(spark, sf).select(
        "run_id",
        F.round("quality", 9).alias("quality"),
        F.round("score", 9).alias("score"),
        scoring.deploy_decision(F.col("score"), F.col("faithfulness"), F.col("pass_rate")).alias("decision"),
        F.array_join(hints, ",").alias("hints"),
    )


@query(
    "judge_notes",
    """
WITH n AS (SELECT conv_id, turn, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS rn
           FROM conversations WHERE role = 'assistant')
SELECT conv_id, string_agg(text, '; ' ORDER BY rn) AS judge_reasoning FROM n WHERE rn <= 3 GROUP BY 1""",
)
def judge_notes(spark, sf):
    notes = fx.table(spark, sf, "conversations").where("role = 'assistant'").withColumnRenamed("text", "reasoning")
    return evaluation.judge_notes(notes, ["conv_id"], "turn")


# Runs: a customer is a run, its orders are the questions, its lines the rankings.
_RUNS = fx.RANKINGS + "," + """
asked AS (
  SELECT o_custkey AS run_id, o_orderkey AS query_id,
         CASE WHEN o_orderstatus = 'P' THEN 'adversarial_fixed' ELSE 'synthetic' END AS question_type,
         CASE WHEN o_orderkey % 5 = 0 THEN 'The total is known.' ELSE 'I do not know.' END AS answer,
         p % 20000 AS latency_ms, (p % 1000 + 0.37) / 1009.13::DOUBLE AS faithfulness,
         ((p // 11) % 1000 + 0.37) / 1009.13::DOUBLE AS relevancy, o_orderpriority AS reasoning
  FROM (SELECT *, CAST(floor(o_totalprice) AS BIGINT) AS p FROM orders)
),
per_query AS (
  SELECT query_id, sum(expected)::DOUBLE / greatest(sum(expected), 1) AS recall,
         least(sum(CASE WHEN expected = 1 THEN so_far::DOUBLE / rank ELSE 0 END) / greatest(sum(expected), 1), 1) AS precision
  FROM (SELECT query_id, rank, expected, sum(expected) OVER (PARTITION BY query_id ORDER BY rank) AS so_far FROM rankings) GROUP BY 1
),
synth AS (
  SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY query_id) AS qn FROM asked WHERE question_type = 'synthetic'
),
means AS (
  SELECT run_id, avg(coalesce(recall, 0)) AS recall, avg(coalesce(precision, 0)) AS precision, avg(faithfulness) AS faithfulness,
         avg(relevancy) AS relevancy, list_sort(list(latency_ms))[count(*) // 2 + 1] AS median_ms,
         string_agg(reasoning, '; ' ORDER BY qn) FILTER (qn <= 3) AS notes
  FROM synth LEFT JOIN per_query USING (query_id) GROUP BY 1
),
refused AS (
  SELECT run_id, count(*) FILTER (question_type <> 'synthetic') AS n,
         count(*) FILTER (question_type <> 'synthetic' AND answer LIKE '%do not know%') AS passes FROM asked GROUP BY 1
),
merged AS (
  SELECT r.run_id, coalesce(recall, 0) AS recall, coalesce(precision, 0) AS precision, coalesce(faithfulness, 0) AS faithfulness,
         (coalesce(relevancy, 0) + coalesce(precision, 0)) / 2 AS quality, coalesce(median_ms, 0) AS median_ms,
         coalesce(passes, 0)::DOUBLE / greatest(coalesce(n, 0), 1) AS pass_rate, coalesce(n, 0) - coalesce(passes, 0) AS fails,
         coalesce(notes, '') AS notes
  FROM (SELECT DISTINCT o_custkey AS run_id FROM orders) r LEFT JOIN means USING (run_id) LEFT JOIN refused USING (run_id)
),
evaluated AS (
  SELECT *, 0.25 * recall + 0.35 * quality + 0.25 * faithfulness
         - 0.1 * CASE WHEN median_ms <= 8000 THEN 0.0 WHEN median_ms <= 15000 THEN 0.5 ELSE 1.0 END AS score FROM merged
),
decided AS (
  SELECT *, CASE WHEN faithfulness < 0.5 THEN 'blocked_faithfulness' WHEN pass_rate < 1 THEN 'blocked_adversarial'
                 WHEN score >= 0.72 THEN 'deploy' WHEN score >= 0.6 THEN 'improve' ELSE 'blocked_score' END AS decision FROM evaluated
)"""


def run_inputs(spark, sf):
    """runs, golden, rankings, expected, answers of all customers."""
    o = fx.table(spark, sf, "orders")
    p = F.floor("o_totalprice").cast("long")
    adversarial = F.col("o_orderstatus") == "P"
    asked = o.select(
        F.col("o_custkey").alias("run_id"),
        F.col("o_orderkey").alias("query_id"),
        F.when(adversarial, "adversarial_fixed").otherwise("synthetic").alias("question_type"),
        F.when(F.col("o_orderkey") % 5 == 0, "The total is known.").otherwise("I do not know.").alias("answer"),
        (p % 20000).alias("latency_ms"),
        ((p % 1000 + 0.37) / 1009.13).alias("faithfulness"),
        ((F.floor(p / 11) % 1000 + 0.37) / 1009.13).alias("relevancy"),
        F.col("o_orderpriority").alias("reasoning"),
    )
    owner = asked.select("run_id", "query_id")
    ranked = fx.rankings(spark, sf).join(owner, "query_id")
    wanted = ranked.where("expected = 1").select("run_id", "query_id", "chunk_id")
    return (
        asked.select("run_id").distinct(),
        asked.select("run_id", "query_id", "question_type"),
        ranked.select("run_id", "query_id", "chunk_id", "rank"),
        wanted,
        asked.drop("question_type"),
    )


@query(
    "evaluated_runs",
    "WITH " + _RUNS + """
SELECT run_id, round(recall, 10) AS context_recall, round(precision, 10) AS context_precision, round(faithfulness, 10) AS faithfulness,
       round(quality, 10) AS quality_score, CAST(median_ms AS BIGINT) AS median_ms, round(pass_rate, 10) AS pass_rate, CAST(fails AS BIGINT) AS fails,
       round(score, 10) AS unified_score, decision, decision = 'deploy' AS deploy_eligible,
       CASE WHEN starts_with(decision, 'blocked') THEN decision END AS failure_reason, notes AS judge_reasoning
FROM decided""",
)
def evaluated_runs(spark, sf):
    out = evaluation.evaluate_runs(*run_inputs(spark, sf))
    rounded = ["context_recall", "context_precision", "faithfulness", "quality_score", "pass_rate", "unified_score"]
    return out.select(
        "run_id", *[F.round(c, 10).alias(c) for c in rounded],
        F.col("median_ms").cast("long").alias("median_ms"), F.col("fails").cast("long").alias("fails"),
        "decision", "deploy_eligible", "failure_reason", "judge_reasoning",
    )


_NEWEST = """
newest AS (
  SELECT *, row_number() OVER (PARTITION BY pipeline_id ORDER BY created_at DESC, run_id DESC) AS rn FROM evaluations
)"""
_DRIFT = _NEWEST + """,
drift AS (
  SELECT pipeline_id, count(*) AS n_scores, max(CASE WHEN rn = 1 THEN unified_score END) AS latest,
         avg(CASE WHEN rn > 1 THEN unified_score END) AS prior_avg
  FROM newest WHERE rn <= 6 GROUP BY 1 HAVING count(*) >= 2
)"""


@query(
    "score_drift",
    "WITH " + fx.EVALUATIONS + "," + _DRIFT
    + " SELECT pipeline_id, n_scores, round(latest, 9) AS latest, round(prior_avg, 9) AS prior_avg, latest < prior_avg - 0.05 AS drift FROM drift",
)
def score_drift(spark, sf):
    out = drift.score_drift(fx.evaluations(spark, sf).select("pipeline_id", "run_id", "created_at", "unified_score"))
    return out.withColumns({"latest": F.round("latest", 9), "prior_avg": F.round("prior_avg", 9)})


_PIPELINES = """
pipelines AS (SELECT c_custkey AS pipeline_id, c_nationkey AS organization_id FROM customer WHERE c_mktsegment <> 'BUILDING')"""


def _pipelines(spark, sf):
    return fx.table(spark, sf, "customer").where("c_mktsegment <> 'BUILDING'").select(
        F.col("c_custkey").alias("pipeline_id"), F.col("c_nationkey").alias("organization_id")
    )


@query(
    "observer_candidates",
    "WITH " + fx.EVALUATIONS + "," + fx.DEPLOYMENTS + "," + _PIPELINES + """
SELECT deployment_id, pipeline_id, organization_id FROM deployments d JOIN pipelines USING (pipeline_id)
WHERE d.status = 'active' AND (SELECT count(*) FROM evaluations e WHERE e.pipeline_id = d.pipeline_id) >= 2""",
)
def observer_candidates(spark, sf):
    return drift.observer_candidates(
        fx.deployments(spark, sf), fx.evaluations(spark, sf), _pipelines(spark, sf)
    ).select("deployment_id", "pipeline_id", "organization_id")


_SCAN = fx.EVALUATIONS + "," + _DRIFT + "," + fx.DEPLOYMENTS + "," + _PIPELINES + """,
fired AS (
  SELECT d.deployment_id, pipeline_id, organization_id, 'pending' AS status, 'observer' AS triggered_by, prior_avg
  FROM deployments d JOIN drift x USING (pipeline_id) JOIN pipelines USING (pipeline_id)
  WHERE d.status = 'active' AND latest < prior_avg - 0.05
)"""


def _scan(spark, sf):
    e = fx.evaluations(spark, sf)
    return drift.observer_scan(
        fx.deployments(spark, sf), e.select("run_id", "created_at", "unified_score"),
        e.select("run_id", "pipeline_id"), _pipelines(spark, sf),
    )


@query(
    "observer_scan",
    "WITH " + _SCAN + " SELECT deployment_id, pipeline_id, organization_id, status, triggered_by, round(prior_avg, 9) AS prior_avg FROM fired",
)
def observer_scan(spark, sf):
    return _scan(spark, sf).withColumn("prior_avg", F.round("prior_avg", 9))


@query(
    "observer_totals",
    "WITH " + _SCAN + """
SELECT (SELECT count(*) FROM deployments WHERE status = 'active') AS scanned, (SELECT count(*) FROM fired) AS drift_triggered""",
)
def observer_totals(spark, sf):
    return drift.scan_totals(fx.deployments(spark, sf), _scan(spark, sf))


@query(
    "latest_event",
    """
SELECT user_id, ts, event_id, event_type, value FROM (
  SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn FROM events) WHERE rn = 1""",
)
def latest_event(spark, sf):
    events = fx.table(spark, sf, "events").drop("props")
    return ranking.latest_per_key(events, "user_id", "ts", "event_id")


@query(
    "recent_events",
    """
SELECT user_id, event_id, CAST(rn AS INTEGER) AS rn FROM (
  SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn FROM events) WHERE rn <= 25""",
)
def recent_events(spark, sf):
    return ranking.recent_n(fx.table(spark, sf, "events"), "user_id", "ts", "event_id").select(
        "user_id", "event_id", "rn"
    )


@query(
    "eval_scores",
    "WITH " + fx.EVALUATIONS + "," + _NEWEST
    + " SELECT run_id, pipeline_id, created_at, unified_score, CAST(rn AS INTEGER) AS rn FROM newest WHERE rn <= 20",
)
def eval_scores(spark, sf):
    e = fx.evaluations(spark, sf)
    return ranking.eval_scores(e.select("run_id", "created_at", "unified_score"), e.select("run_id", "pipeline_id"))


@query(
    "experiments_by_pipeline",
    """
SELECT l_orderkey AS run_id, l_linenumber AS line, l_discount AS score_delta, o_custkey AS pipeline_id
FROM lineitem JOIN orders ON o_orderkey = l_orderkey""",
)
def experiments_by_pipeline(spark, sf):
    experiments = fx.table(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("run_id"), F.col("l_linenumber").alias("line"), F.col("l_discount").alias("score_delta")
    )
    runs = fx.evaluations(spark, sf).select("run_id", "pipeline_id")
    return ranking.experiments_by_pipeline(experiments, runs)


@query(
    "runs_with_latest_eval",
    "WITH " + fx.EVALUATIONS + "," + _NEWEST + """,
latest AS (
  SELECT l_orderkey AS run_id, l_discount * 10 AS unified_score, l_returnflag = 'A' AS deploy_eligible FROM (
    SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_shipdate DESC, l_linenumber DESC, l_partkey DESC) AS k FROM lineitem)
  WHERE k = 1
)
SELECT n.run_id, n.pipeline_id, CAST(rn AS INTEGER) AS rn, round(l.unified_score, 6) AS unified_score, coalesce(l.deploy_eligible, false) AS deploy_eligible
FROM newest n LEFT JOIN latest l USING (run_id) WHERE rn <= 25""",
)
def runs_with_latest_eval(spark, sf):
    runs = fx.evaluations(spark, sf).select("run_id", "pipeline_id", "created_at")
    evals = fx.table(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("run_id"),
        F.struct("l_linenumber", "l_partkey").alias("evaluation_id"),
        F.col("l_shipdate").alias("evaluated_at"),
        (F.col("l_discount") * 10).alias("unified_score"),
        (F.col("l_returnflag") == "A").alias("deploy_eligible"),
    )
    return ranking.runs_with_latest_eval(runs, evals).drop("created_at").withColumn(
        "unified_score", F.round("unified_score", 6)
    )


@query(
    "score_trend",
    "WITH " + fx.EVALUATIONS + "," + _NEWEST + """,
pair AS (SELECT pipeline_id, max(CASE WHEN rn = 1 THEN unified_score * 100 END) AS a, max(CASE WHEN rn = 2 THEN unified_score * 100 END) AS b
         FROM newest WHERE rn <= 2 GROUP BY 1)
SELECT pipeline_id, abs(round(a - b, 1)) AS change, round(a - b, 1) >= 0 AS is_positive FROM pair WHERE b IS NOT NULL""",
)
def score_trend(spark, sf):
    return ranking.score_trend(fx.evaluations(spark, sf))


@query(
    "sparkline",
    "WITH " + fx.EVALUATIONS + "," + _NEWEST + """,
span AS (SELECT pipeline_id, min(unified_score * 100) AS lo, max(unified_score * 100) AS hi FROM newest WHERE rn <= 10 GROUP BY 1)
SELECT pipeline_id, CAST(row_number() OVER (PARTITION BY pipeline_id ORDER BY rn DESC) - 1 AS INTEGER) AS pos,
       round((unified_score * 100 - lo) / CASE WHEN hi = lo THEN 1 ELSE hi - lo END, 9) AS point
FROM newest JOIN span USING (pipeline_id) WHERE rn <= 10""",
)
def sparkline(spark, sf):
    return ranking.sparkline(fx.evaluations(spark, sf)).select(
        "pipeline_id", F.posexplode("points").alias("pos", "point")
    ).withColumn("point", F.round("point", 9))


@query(
    "sampled_chunks",
    """
SELECT doc_id AS chunk_id, lang AS pipeline_id, CAST(pick AS INTEGER) AS pick FROM (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY md5(CAST(doc_id AS VARCHAR) || 's1'), doc_id) AS pick FROM documents)
WHERE pick <= 5""",
)
def sampled_chunks(spark, sf):
    chunks = fx.table(spark, sf, "documents").select(F.col("doc_id").alias("chunk_id"), F.col("lang").alias("pipeline_id"))
    return ranking.sample_chunks(chunks, seed="s1")


@query(
    "golden_sets",
    f"""
WITH fresh AS (SELECT * FROM documents WHERE lang <> 'fr'),
pick AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY md5(CAST(doc_id AS VARCHAR)), doc_id) AS k FROM fresh) WHERE k <= 5),
anchors(i, q) AS (VALUES {", ".join(f"({i}, '{q}')" for i, q in enumerate(K.ANCHOR_QUESTIONS))})
SELECT lang AS pipeline_id, CAST(k AS INTEGER) AS set_key,
       CASE WHEN doc_id % 2 = 0 THEN 'Who wrote ' || doc_id || '?' ELSE 'What information is provided in: ' || text[1:80] || '...?' END AS question,
       CASE WHEN doc_id % 2 = 0 THEN source ELSE text[1:200] END AS expected_answer, CAST(doc_id AS VARCHAR) AS expected_chunks,
       'synthetic' AS question_type FROM pick
UNION ALL SELECT lang, CAST(i + 6 AS INTEGER), q, NULL, '', 'adversarial_fixed' FROM (SELECT DISTINCT lang FROM fresh), anchors
UNION ALL SELECT lang, CAST(doc_id AS INTEGER), 'kept ' || doc_id, NULL, '', 'synthetic' FROM documents WHERE lang = 'fr'""",
)
def golden_sets(spark, sf):
    docs = fx.table(spark, sf, "documents").withColumns(
        {"chunk_id": F.col("doc_id"), "pipeline_id": F.col("lang"), "content": F.col("text")}
    )
    reply = F.to_json(
        F.struct(
            F.concat(F.lit("Who wrote "), F.col("doc_id").cast("string"), F.lit("?")).alias("question"),
            F.col("source").alias("expected_answer"),
        )
    )
    replies = docs.where("doc_id % 2 = 0").select("chunk_id", reply.alias("reply"))
    existing = docs.where("lang = 'fr'").select(
        "pipeline_id", F.col("doc_id").cast("int").alias("set_key"),
        F.concat(F.lit("kept "), F.col("doc_id").cast("string")).alias("question"),
        F.lit(None).cast("string").alias("expected_answer"), F.array().cast("array<string>").alias("expected_chunks"),
        F.lit("synthetic").alias("question_type"), F.lit(1).alias("set_version"),
    )
    sets = golden.build_golden_set(docs.select("chunk_id", "pipeline_id", "content"), existing, replies)
    return sets.withColumn("expected_chunks", F.array_join("expected_chunks", ",")).drop("set_version")
