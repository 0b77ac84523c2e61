"""Tables over time: re-ingest, deployments, approvals, synchronisation."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewell import constants as K
from tidewell.catalog import fixtures as fx
from tidewell.catalog.registry import query
from tidewell.functions import scoring
from tidewell.operators import filters, lifecycle, optimise, ranking


@query(
    "tenant_filter",
    "SELECT c_custkey, c_name, c_nationkey FROM customer WHERE c_mktsegment = 'BUILDING'",
)
def tenant_filter(spark, sf):
    customers = fx.table(spark, sf, "customer")
    return filters.tenant_filter(customers, "BUILDING", "c_mktsegment").select("c_custkey", "c_name", "c_nationkey")


@query(
    "retryable_documents",
    "SELECT o_orderkey AS document_id, CASE o_orderstatus WHEN 'O' THEN 'queued' WHEN 'F' THEN 'failed' ELSE 'completed' END AS status"
    " FROM orders WHERE o_orderpriority <> '1-URGENT'",
)
def retryable_documents(spark, sf):
    status = (
        F.when(F.col("o_orderpriority") == "1-URGENT", "processing")
        .when(F.col("o_orderstatus") == "O", "queued")
        .when(F.col("o_orderstatus") == "F", "failed")
        .otherwise("completed")
    )
    docs = fx.table(spark, sf, "orders").select(F.col("o_orderkey").alias("document_id"), status.alias("status"))
    return filters.retryable(docs)


@query(
    "due_connectors",
    """
WITH last AS (SELECT user_id, max(ts) AS ts, count(*) AS n FROM events GROUP BY 1),
c AS (SELECT user_id AS connector_id, CASE WHEN user_id % 7 = 0 THEN NULL ELSE ts END AS ts, user_id % 7 = 1 AS bad,
             CASE WHEN user_id % 5 = 0 THEN 'error' ELSE 'active' END AS status,
             CASE WHEN user_id % 3 = 0 THEN 60 ELSE 60 * (user_id % 500) END AS minutes FROM last)
SELECT connector_id FROM c WHERE status = 'active' AND NOT bad
  AND (ts IS NULL OR ts + minutes * INTERVAL 1 MINUTE <= TIMESTAMP '2024-01-31 00:00:00')""",
)
def due_connectors(spark, sf):
    last = fx.table(spark, sf, "events").groupBy("user_id").agg(F.max("ts").alias("ts"))
    user = F.col("user_id")
    text = (
        F.when(user % 7 == 0, F.lit(None).cast("string"))
        .when(user % 7 == 1, "not a time")
        .otherwise(F.concat(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), F.when(user % 2 == 0, "Z").otherwise("")))
    )
    connectors = last.select(
        user.alias("connector_id"),
        text.alias("last_synced_at"),
        F.when(user % 5 == 0, "error").otherwise("active").alias("status"),
        F.when(user % 3 != 0, 60 * (user % 500)).alias("sync_interval_minutes"),
    )
    return filters.due_connectors(connectors, F.to_timestamp(F.lit("2024-01-31T00:00:00Z"))).select("connector_id")


@query(
    "replaced_chunks",
    """
SELECT doc_id AS document_id, 0 AS chunk_index, md5(text) AS content_md5 FROM documents
WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE quality = 1)
UNION ALL
SELECT doc_id, i, md5(text || i) FROM documents JOIN labels USING (doc_id), (VALUES (0), (1)) v(i) WHERE quality = 1""",
)
def replaced_chunks(spark, sf):
    docs = fx.table(spark, sf, "documents")
    existing = docs.select(F.col("doc_id").alias("document_id"), F.lit(0).alias("chunk_index"), F.col("text").alias("content"))
    good = fx.table(spark, sf, "labels").where("quality = 1").select(F.col("doc_id").alias("document_id"))
    new = (
        existing.join(good, "document_id", "left_semi")
        .withColumn("chunk_index", F.explode(F.array(F.lit(0), F.lit(1))))
        .withColumn("content", F.concat("content", F.col("chunk_index").cast("string")))
    )
    return lifecycle.replace_document_chunks(existing, new).select(
        "document_id", "chunk_index", F.md5("content").alias("content_md5")
    )


_AUDIT_TYPES = ["PIPELINE_CREATED", "INGESTION_COMPLETED", "CONNECTOR_ADDED", "APPROVAL_GRANTED", "pipeline_created"]


@query(
    "audit_rows",
    f"""
SELECT event_id, ([{fx.sql_list(_AUDIT_TYPES)}])[event_id % 5 + 1] AS event_type,
       'k=' || json_extract_string(props, '$.k') || ',kind=' || event_type AS payload, event_id % 5 IN (0, 1, 3) AS accepted
FROM events""",
)
def audit_rows(spark, sf):
    e = fx.table(spark, sf, "events")
    payload = F.map_concat(
        F.from_json("props", "map<string,string>"),
        F.create_map(
            F.lit("kind"), "event_type", F.lit("Email"), F.lit("x@y.z"), F.lit("IP"), F.col("user_id").cast("string"),
            F.lit("query"), F.lit("q"),
        ),
    )
    kind = F.get(F.array(*map(F.lit, _AUDIT_TYPES)), (F.col("event_id") % 5).cast("int"))
    checked = lifecycle.check_audit(e.select("event_id", kind.alias("event_type"), payload.alias("payload")))
    pairs = F.transform(F.array_sort(F.map_entries("payload")), lambda p: F.concat(p["key"], F.lit("="), p["value"]))
    return checked.withColumn("payload", F.array_join(pairs, ","))


@query(
    "registered_documents",
    """
SELECT doc_id AS document_id, source || '.txt' AS filename, 'org/' || doc_id || '/' || lang AS storage_path, n_chars AS file_size,
       CASE WHEN lang = 'de' THEN 'processing' ELSE 'queued' END AS status FROM documents""",
)
def registered_documents(spark, sf):
    nul = F.lit(lifecycle.NUL)
    files = fx.table(spark, sf, "documents").select(
        F.col("doc_id").alias("document_id"),
        F.concat("source", nul, F.lit(".txt"), nul).alias("filename"),
        F.concat(F.lit("org/"), nul, F.col("doc_id").cast("string"), F.lit("/"), "lang").alias("storage_path"),
        F.col("n_chars").alias("file_size"),
        F.when(F.col("lang") == "de", "processing").alias("status"),
    )
    return lifecycle.register_documents(files)


@query(
    "ingest_summary",
    """
WITH b AS (SELECT l_orderkey AS document_id, count(*) AS n, CAST(sum(l_linenumber) AS BIGINT) AS pii FROM lineitem GROUP BY 1),
c AS (SELECT l_orderkey AS document_id, count(*) AS n FROM lineitem WHERE l_linestatus = 'F' GROUP BY 1)
SELECT o_orderkey AS document_id,
       CASE WHEN b.n IS NULL OR c.n IS NULL THEN 'failed' ELSE 'completed' END AS status,
       CASE WHEN b.n IS NOT NULL AND c.n IS NOT NULL THEN c.n END AS chunk_count,
       CASE WHEN b.n IS NOT NULL AND c.n IS NOT NULL THEN b.pii END AS pii_entities,
       CASE WHEN b.n IS NULL THEN 'No extractable text found in document.'
            WHEN c.n IS NULL THEN 'Document yielded 0 chunks after splitting.' END AS error
FROM orders LEFT JOIN b ON b.document_id = o_orderkey LEFT JOIN c ON c.document_id = o_orderkey""",
)
def ingest_summary(spark, sf):
    documents = fx.table(spark, sf, "orders").select(F.col("o_orderkey").alias("document_id"))
    blocks = fx.table(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("document_id"), F.col("l_linenumber").alias("pii_count"), "l_linestatus"
    )
    return lifecycle.ingest_summary(documents, blocks, blocks.where("l_linestatus = 'F'"))


@query(
    "merged_status",
    """
SELECT d.doc_id AS document_id, CASE WHEN l.quality = 1 THEN 'completed' WHEN l.quality = 0 THEN 'failed' ELSE 'queued' END AS status,
       CASE WHEN l.quality = 0 THEN 'toxic ' || l.toxic WHEN d.lang = 'fr' THEN 'old' END AS error,
       CASE WHEN l.quality = 1 THEN CAST(d.doc_id % 9 AS INTEGER) ELSE CAST(1 AS INTEGER) END AS chunk_count,
       CASE WHEN l.toxic = 1 THEN CAST(4 AS INTEGER) ELSE CAST(0 AS INTEGER) END AS pii_entities
FROM documents d LEFT JOIN labels l USING (doc_id)""",
)
def merged_status(spark, sf):
    docs = fx.table(spark, sf, "documents").select(
        F.col("doc_id").alias("document_id"),
        F.lit("queued").alias("status"),
        F.when(F.col("lang") == "fr", "old").alias("error"),
        F.lit(1).alias("chunk_count"),
        F.lit(0).alias("pii_entities"),
    )
    good = F.col("quality") == 1
    updates = fx.table(spark, sf, "labels").select(
        F.col("doc_id").alias("document_id"),
        F.when(good, "completed").otherwise("failed").alias("status"),
        F.when(~good, F.concat(F.lit("toxic "), F.lit(lifecycle.NUL), F.col("toxic").cast("string"))).alias("error"),
        F.when(good, (F.col("doc_id") % 9).cast("int")).alias("chunk_count"),
        F.when(F.col("toxic") == 1, 4).alias("pii_entities"),
    )
    return lifecycle.merge_status(docs, updates)


@query(
    "cascade_delete",
    """
WITH gone AS (SELECT c_custkey AS pipeline_id FROM customer WHERE c_mktsegment = 'MACHINERY'),
runs AS (SELECT o_orderkey AS run_id FROM orders WHERE o_custkey IN (SELECT pipeline_id FROM gone))
SELECT 'pipelines' AS tab, count(*) AS n, CAST(sum(c_custkey) AS BIGINT) AS keys FROM customer WHERE c_custkey NOT IN (SELECT pipeline_id FROM gone)
UNION ALL SELECT 'runs', count(*), CAST(sum(o_orderkey) AS BIGINT) FROM orders WHERE o_orderkey NOT IN (SELECT run_id FROM runs)
UNION ALL SELECT 'evaluations', count(*), CAST(sum(l_orderkey) AS BIGINT) FROM lineitem WHERE l_orderkey NOT IN (SELECT run_id FROM runs)
UNION ALL SELECT 'experiments', count(*), CAST(sum(l_orderkey) AS BIGINT) FROM lineitem
  WHERE l_orderkey NOT IN (SELECT run_id FROM runs) AND l_orderkey + 1 NOT IN (SELECT run_id FROM runs)""",
)
def cascade_delete(spark, sf):
    gone = fx.table(spark, sf, "customer").where("c_mktsegment = 'MACHINERY'").select(F.col("c_custkey").alias("pipeline_id"))
    lines = fx.table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("run_id"))
    left = lifecycle.cascade_delete(
        {
            "pipelines": fx.table(spark, sf, "customer").select(F.col("c_custkey").alias("pipeline_id")),
            "runs": fx.evaluations(spark, sf).select("run_id", "pipeline_id"),
            "evaluations": lines,
            "experiments": lines.withColumn("parent_run_id", F.col("run_id") + 1),
        },
        gone,
    )
    keys = {"pipelines": "pipeline_id", "runs": "run_id", "evaluations": "run_id", "experiments": "run_id"}
    counted = [
        left[name].agg(F.count("*").alias("n"), F.sum(key).alias("keys")).select(F.lit(name).alias("tab"), "n", "keys")
        for name, key in keys.items()
    ]
    return counted[0].unionByName(counted[1]).unionByName(counted[2]).unionByName(counted[3])


_SOURCES = """
listing AS (SELECT url AS source_id FROM pages WHERE html LIKE '%lang="en"%' OR html LIKE '%lang="fr"%'),
docs AS (SELECT page_id AS document_id, url AS source_id, page_id % 3 AS connector_id FROM pages WHERE html NOT LIKE '%lang="fr"%')"""


def sources(spark, sf):
    pages = fx.table(spark, sf, "pages")
    en, fr = F.col("html").contains('lang="en"'), F.col("html").contains('lang="fr"')
    listing = pages.where(en | fr).select(F.col("url").alias("source_id"))
    docs = pages.where(~fr).select(
        F.col("page_id").alias("document_id"), F.col("url").alias("source_id"), (F.col("page_id") % 3).alias("connector_id")
    )
    return listing, docs


@query(
    "new_source_items",
    "WITH " + _SOURCES + " SELECT source_id FROM listing WHERE source_id NOT IN (SELECT source_id FROM docs)",
)
def new_source_items(spark, sf):
    return lifecycle.new_source_items(*sources(spark, sf))


@query(
    "vanished_documents",
    "WITH " + _SOURCES + """
SELECT document_id, source_id, connector_id FROM docs WHERE connector_id = 1 AND source_id NOT IN (SELECT source_id FROM listing)""",
)
def vanished_documents(spark, sf):
    listing, docs = sources(spark, sf)
    return lifecycle.vanished_documents(docs, listing, connector_id=1)


_ACTIVE = """
active AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY pipeline_id ORDER BY activated_at DESC, deployment_id DESC) AS rn
                 FROM deployments WHERE status = 'active') WHERE rn = 1
)"""


@query(
    "rollback_targets",
    "WITH " + fx.DEPLOYMENTS + "," + _ACTIVE + """
SELECT a.pipeline_id, deployment_id, 'rolled_back' AS status, c_mktsegment AS rollback_reason,
       coalesce(previous_deployment, a.deployment_id) AS active_version
FROM active a JOIN customer ON c_custkey = a.pipeline_id WHERE c_acctbal < 5000""",
)
def rollback_targets(spark, sf):
    deployments = fx.deployments(spark, sf)
    current = lifecycle.active_deployments(deployments).select("pipeline_id", F.col("deployment_id").alias("active_version"))
    customers = fx.table(spark, sf, "customer").where("c_acctbal < 5000")
    requests = customers.select(
        F.col("c_custkey").alias("pipeline_id"), F.col("c_mktsegment").alias("reason")
    ).join(current, "pipeline_id")
    return lifecycle.rollback_target(deployments, requests)


@query(
    "activated_deployments",
    "WITH " + fx.DEPLOYMENTS + "," + _ACTIVE + """,
cand AS (SELECT c_custkey AS pipeline_id, c_custkey + 100000000 AS deployment_id FROM customer WHERE c_acctbal > 0)
SELECT d.deployment_id, d.pipeline_id, CASE WHEN a.deployment_id IS NOT NULL AND c.pipeline_id IS NOT NULL THEN 'superseded' ELSE d.status END AS status,
       d.previous_deployment
FROM deployments d LEFT JOIN active a ON a.deployment_id = d.deployment_id LEFT JOIN cand c ON c.pipeline_id = d.pipeline_id
UNION ALL
SELECT c.deployment_id, c.pipeline_id, 'active', a.deployment_id FROM cand c LEFT JOIN active a USING (pipeline_id)""",
)
def activated_deployments(spark, sf):
    deployments = fx.deployments(spark, sf)
    candidates = fx.table(spark, sf, "customer").where("c_acctbal > 0").select(
        F.col("c_custkey").alias("pipeline_id"),
        (F.col("c_custkey") + 100000000).alias("deployment_id"),
        F.col("c_custkey").alias("run_id"),
        F.lit("2030-01-01").cast("timestamp_ntz").alias("activated_at"),
        F.lit(0.8).alias("unified_score"),
    )
    return lifecycle.activate(deployments, candidates).select(
        "deployment_id", "pipeline_id", "status", "previous_deployment"
    )


# Configurations: baseline and variant of an order, differing by the digits of its key.
_CONFIG_KEYS = ["llm_judge", "retrieval_method", "temperature", "top_k", "rerank_enabled"]
_CONFIGS = """
configs AS (
  SELECT o_orderkey AS run_id, o_orderpriority, o_orderkey % 2 = 0 AS d_top_k, o_orderkey % 7 = 0 AS d_judge,
         o_orderkey % 5 = 0 AS d_method, o_orderkey % 3 = 0 AS d_temp, o_orderkey % 11 = 0 AS d_rerank,
         CASE o_orderkey % 13 WHEN 0 THEN 'auto' WHEN 1 THEN 'mandatory_gate' ELSE 'human_in_loop' END AS mode FROM orders
)"""


def _configs(spark, sf):
    key = F.col("o_orderkey")

    def entry(name, changed, old, new):
        return F.create_map(F.lit(name), F.when(changed, new).otherwise(old))

    variant = F.map_concat(
        entry("top_k", key % 2 == 0, "5", "8"),
        entry("llm_judge", key % 7 == 0, "a", "b"),
        entry("retrieval_method", key % 5 == 0, "hybrid", "dense"),
        entry("temperature", key % 3 == 0, "0.0", "0.5"),
    )
    rerank = F.create_map(F.lit("rerank_enabled"), F.lit("true"))
    baseline = F.create_map(
        *[F.lit(x) for x in ("top_k", "5", "llm_judge", "a", "retrieval_method", "hybrid", "temperature", "0.0")]
    )
    mode = F.when(key % 13 == 0, "auto").when(key % 13 == 1, "mandatory_gate").otherwise("human_in_loop")
    return fx.table(spark, sf, "orders").select(
        key.alias("run_id"),
        F.when(key % 11 == 0, F.map_concat(variant, rerank)).otherwise(variant).alias("variant"),
        baseline.alias("baseline"),
        mode.alias("mode"),
    )


@query(
    "config_diff",
    "WITH " + _CONFIGS + """
SELECT run_id, concat_ws(',', CASE WHEN d_judge THEN 'llm_judge' END, CASE WHEN d_rerank THEN 'rerank_enabled' END,
         CASE WHEN d_method THEN 'retrieval_method' END, CASE WHEN d_temp THEN 'temperature' END, CASE WHEN d_top_k THEN 'top_k' END) AS changed
FROM configs""",
)
def config_diff(spark, sf):
    changed = scoring.config_diff(F.col("variant"), F.col("baseline"))
    return _configs(spark, sf).select("run_id", F.array_join(changed, ",").alias("changed"))


@query(
    "approval_tiers",
    "WITH " + _CONFIGS + """
SELECT run_id, CASE WHEN mode <> 'human_in_loop' THEN mode WHEN d_judge THEN 'mandatory_gate' WHEN d_method THEN 'human_in_loop'
       WHEN (d_top_k OR d_temp) AND NOT d_rerank THEN 'auto' ELSE 'human_in_loop' END AS tier FROM configs""",
)
def approval_tiers(spark, sf):
    tier = scoring.approval_tier(F.col("variant"), F.col("baseline"), F.col("mode"))
    return _configs(spark, sf).select("run_id", tier.alias("tier"))


# Diagnosed runs: hints by the digits of the order key, top_k set for most.
_DIAGNOSED = """
diagnosed AS (
  SELECT o_orderkey AS run_id, o_orderkey % 2 = 0 AS h1, o_orderkey % 3 = 0 AS h2, o_orderkey % 5 = 0 AS h3, o_orderkey % 7 = 0 AS h4,
         CASE WHEN o_orderkey % 11 = 0 THEN NULL ELSE o_orderkey % 20 + 1 END AS top_k, o_orderkey % 4 = 0 AS strict FROM orders
),
varied AS (
  SELECT *, CASE WHEN h1 THEN least(coalesce(top_k, 5) + 3, 20)
                 WHEN NOT h2 AND NOT (h3 AND NOT strict) AND NOT h4 THEN least(coalesce(top_k, 5) + 2, 20) ELSE top_k END AS t0 FROM diagnosed
),
final AS (
  SELECT *, CASE WHEN h1 AND coalesce(t0 = top_k, false) AND NOT h2 AND NOT (h3 AND NOT strict) AND NOT h4
            THEN least(top_k + 2, 20) ELSE t0 END AS t FROM varied
)"""


def _diagnosed(spark, sf):
    key = F.col("o_orderkey")
    empty = F.from_json(F.lit("{}"), "map<string,string>")
    top_k = F.when(key % 11 != 0, F.create_map(F.lit("top_k"), (key % 20 + 1).cast("string"))).otherwise(empty)
    strict = F.when(key % 4 == 0, F.create_map(F.lit("grounding_strict"), F.lit("true"))).otherwise(empty)
    hints = F.array_compact(
        F.array(
            F.when(key % 2 == 0, K.HINT_RECALL), F.when(key % 3 == 0, K.HINT_PRECISION),
            F.when(key % 5 == 0, K.HINT_FAITHFULNESS), F.when(key % 7 == 0, K.HINT_REFUSAL),
        )
    )
    return fx.table(spark, sf, "orders").select(
        key.alias("run_id"), F.map_concat(top_k, strict).alias("config"), hints.alias("diagnosis"),
        F.lit("human_in_loop").alias("approval_mode"),
    )


def _variant_columns(variant):
    return [
        F.try_element_at(variant, F.lit(k)).alias(k)
        for k in ("top_k", "rerank_enabled", "grounding_strict", "refusal_instruction")
    ]


_VARIANT_SQL = """CAST(t AS VARCHAR) AS top_k, CASE WHEN h2 THEN 'true' END AS rerank_enabled,
       CASE WHEN h3 OR strict THEN 'true' END AS grounding_strict, CASE WHEN h4 THEN 'true' END AS refusal_instruction"""


@query("proposed_variants", "WITH " + _DIAGNOSED + f" SELECT run_id, {_VARIANT_SQL} FROM final")
def proposed_variants(spark, sf):
    return optimise.propose_variants(_diagnosed(spark, sf)).select("run_id", *_variant_columns(F.col("variant")))


@query(
    "pending_experiments",
    "WITH " + _DIAGNOSED + f"""
SELECT run_id, {_VARIANT_SQL}, CASE WHEN h1 THEN '{K.HINT_RECALL}' WHEN h2 THEN '{K.HINT_PRECISION}' WHEN h3 THEN '{K.HINT_FAITHFULNESS}'
       WHEN h4 THEN '{K.HINT_REFUSAL}' ELSE 'general' END AS improvement_type, 'human_in_loop' AS approval_tier, 'pending' AS approval_status
FROM final WHERE h2 OR (h3 AND NOT strict) OR h4 OR t IS NOT DISTINCT FROM top_k""",
)
def pending_experiments(spark, sf):
    out = optimise.experiments_from_runs(_diagnosed(spark, sf))
    return out.select(
        "run_id", *_variant_columns(F.col("variant_config")), "improvement_type", "approval_tier", "approval_status"
    )


@query(
    "workflow_steps",
    """
WITH s AS (
  SELECT o_orderkey AS run_id, (['evaluator', 'observer', 'improver', 'deployer'])[o_orderkey % 4 + 1] AS stage,
         (p % 1000 + 0.37) / 1009.13::DOUBLE AS score, CASE WHEN p % 9 = 0 THEN NULL ELSE ((p // 3) % 1000 + 0.37) / 1009.13::DOUBLE END AS faith,
         p % 2 = 0 AS eligible, p % 3 = 0 AS variant, p % 5 = 0 AS drift FROM (SELECT *, CAST(floor(o_totalprice) AS BIGINT) AS p FROM orders)
)
SELECT run_id, stage, CASE stage
  WHEN 'evaluator' THEN CASE WHEN coalesce(faith, 0) < 0.5 OR score < 0.6 THEN 'END' WHEN eligible AND variant THEN 'deployer'
                             WHEN eligible THEN 'observer' ELSE 'improver' END
  WHEN 'observer' THEN CASE WHEN drift THEN 'improver' ELSE 'END' END
  WHEN 'improver' THEN CASE WHEN variant THEN 'evaluator' ELSE 'END' END ELSE 'observer' END AS next_step FROM s""",
)
def workflow_steps(spark, sf):
    p = F.floor("o_totalprice").cast("long")
    stages = F.array(*map(F.lit, ["evaluator", "observer", "improver", "deployer"]))
    runs = fx.table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("run_id"),
        F.get(stages, (F.col("o_orderkey") % 4).cast("int")).alias("stage"),
        ((p % 1000 + 0.37) / 1009.13).alias("unified_score"),
        F.when(p % 9 != 0, (F.floor(p / 3) % 1000 + 0.37) / 1009.13).alias("faithfulness"),
        (p % 2 == 0).alias("deploy_eligible"),
        (p % 3 == 0).alias("has_variant"),
        (p % 5 == 0).alias("drift"),
    )
    return optimise.next_steps(runs).select("run_id", "stage", "next_step")


@query(
    "applied_approvals",
    """
SELECT o_orderkey AS experiment_id,
       CASE WHEN o_custkey % 3 = 0 THEN 'approved' WHEN o_custkey % 3 = 1 THEN 'rejected' ELSE 'pending' END AS approval_status,
       CASE WHEN o_custkey % 3 < 2 THEN CASE WHEN o_custkey % 2 = 0 THEN o_custkey END ELSE -1 END AS approved_by FROM orders""",
)
def applied_approvals(spark, sf):
    o = fx.table(spark, sf, "orders")
    cust = F.col("o_custkey")
    experiments = o.select(
        F.col("o_orderkey").alias("experiment_id"), F.lit("pending").alias("approval_status"), F.lit(-1).cast("long").alias("approved_by")
    )
    decisions = o.where(cust % 3 < 2).select(
        F.col("o_orderkey").alias("experiment_id"), (cust % 3 == 0).alias("approve"), F.when(cust % 2 == 0, cust).alias("reviewer_id")
    )
    return lifecycle.apply_approvals(experiments, decisions)


@query(
    "deployable_runs",
    """
WITH latest AS (
  SELECT l_orderkey AS run_id, l_discount AS score, l_returnflag = 'A' AS ok FROM (
    SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_shipdate DESC, l_linenumber DESC, l_partkey DESC) AS k FROM lineitem) WHERE k = 1
)
SELECT o_orderkey AS run_id, CASE WHEN ok THEN score END AS unified_score, CASE WHEN coalesce(ok, false) THEN NULL ELSE 'ERR_EVAL_HARD_GATE' END AS error
FROM orders LEFT JOIN latest ON run_id = o_orderkey""",
)
def deployable_runs(spark, sf):
    evals = fx.table(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("run_id"),
        F.struct("l_linenumber", "l_partkey").alias("evaluation_id"),
        F.col("l_shipdate").alias("evaluated_at"),
        F.col("l_discount").alias("unified_score"),
        (F.col("l_returnflag") == "A").alias("deploy_eligible"),
    )
    return lifecycle.deployable_runs(fx.evaluations(spark, sf).select("run_id"), evals)


@query(
    "activity_feed",
    """
WITH p AS (SELECT 'pipeline' AS kind, c_custkey AS id, c_mktsegment AS status, CAST(0 AS INTEGER) AS part,
                  row_number() OVER (ORDER BY c_acctbal DESC, c_custkey DESC) AS at_ FROM customer WHERE c_mktsegment = 'BUILDING'),
d AS (SELECT 'document', o_orderkey, o_orderstatus, 1, row_number() OVER (ORDER BY o_orderdate DESC, o_orderkey DESC) AS k FROM orders),
r AS (SELECT 'evaluation', l_orderkey, l_returnflag, 2, row_number() OVER (ORDER BY l_shipdate DESC, l_orderkey DESC) AS k FROM lineitem),
every AS (SELECT * FROM p UNION ALL SELECT * FROM d WHERE k <= 5 UNION ALL SELECT * FROM r WHERE k <= 5)
SELECT kind, id, status, part, CAST(at_ AS INTEGER) AS "at" FROM every ORDER BY part, at_ LIMIT 6""",
)
def activity_feed(spark, sf):
    pipelines = fx.table(spark, sf, "customer").where("c_mktsegment = 'BUILDING'").select(
        F.col("c_custkey").alias("id"), F.col("c_mktsegment").alias("status"), F.col("c_acctbal").alias("created_at")
    )
    documents = fx.table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("status"), F.col("o_orderdate").alias("created_at")
    )
    runs = fx.table(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("id"), F.col("l_returnflag").alias("status"), F.col("l_shipdate").alias("created_at")
    )
    return ranking.activity_feed(pipelines, documents, runs)
