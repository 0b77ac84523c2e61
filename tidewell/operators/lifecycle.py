"""Table maintenance, deployment lineage and source synchronisation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewell import constants as K
from tidewell.operators.ranking import latest_per_key

NUL = "\u0000"


def replace_document_chunks(existing: DataFrame, new: DataFrame) -> DataFrame:
    """Chunk table after re-ingest: all old chunks of a document give way to its new ones."""
    replaced = new.select("document_id").distinct()
    return existing.join(replaced, "document_id", "left_anti").unionByName(new)


def check_audit(events: DataFrame) -> DataFrame:
    """Audit rows with personal keys taken out of the payload and the event type checked."""
    payload = F.map_filter(
        F.coalesce(F.col("payload"), F.from_json(F.lit("{}"), "map<string,string>")),
        lambda k, _: ~F.lower(k).isin(*K.AUDIT_PII_KEYS),
    )
    return events.withColumns(
        {
            "payload": payload,
            "accepted": F.coalesce(F.col("event_type").isin(*K.AUDIT_EVENTS), F.lit(False)),
        }
    )


def append_audit(events: DataFrame, path: str, error_path: str) -> None:
    """Append accepted events; those of unknown type go to the error table."""
    checked = check_audit(events)
    checked.where("accepted").drop("accepted").write.mode("append").parquet(path)
    checked.where("NOT accepted").drop("accepted").write.mode("append").parquet(error_path)


# Defaults of a query log row
_LOG_DEFAULTS = {
    "rewrite_applied": False,
    "hyde_applied": False,
    "compression_applied": False,
    "retrieval_k": K.DEFAULT_TOP_K,
    "chunks_retrieved": 0,
    "rerank_applied": False,
}


def query_log_rows(rows: DataFrame) -> DataFrame:
    """Log rows: the query text becomes its hash, missing flags their defaults."""
    text_hash = F.sha2(F.coalesce(F.col("q"), F.lit("")), 256)
    given = F.nullif(F.col("query_hash"), F.lit("")) if "query_hash" in rows.columns else None
    out = rows.withColumn("query_hash", text_hash if given is None else F.coalesce(given, text_hash))
    for name, default in _LOG_DEFAULTS.items():
        value = F.coalesce(F.col(name), F.lit(default)) if name in rows.columns else F.lit(default)
        out = out.withColumn(name, value)
    return out.drop("q")


def append_query_log(rows: DataFrame, path: str) -> None:
    query_log_rows(rows).write.mode("append").parquet(path)


def _clean(text: Column) -> Column:
    return F.replace(text, F.lit(NUL), F.lit(""))


def register_documents(files: DataFrame) -> DataFrame:
    """New document rows: NUL characters out, status queued unless given."""
    status = F.col("status") if "status" in files.columns else F.lit(None).cast("string")
    return files.withColumns(
        {
            "filename": _clean(F.col("filename")),
            "storage_path": _clean(F.col("storage_path")),
            "status": F.coalesce(status, F.lit("queued")),
        }
    )


def ingest_summary(
    documents: DataFrame, blocks: DataFrame, chunks: DataFrame, errors: DataFrame | None = None
) -> DataFrame:
    """document_id, status, chunk_count, pii_entities, error for every document.

    blocks: document_id, pii_count of non-blank masked blocks. A failed document keeps
    no counts, as nothing of it is stored. errors: document_id, problem of documents that
    could not be read or cut.
    """
    per_doc = blocks.groupBy("document_id").agg(
        F.count("*").alias("_blocks"), F.sum("pii_count").cast("long").alias("_pii")
    )
    counted = chunks.groupBy("document_id").agg(F.count("*").alias("_chunks"))
    documents = documents.select("document_id")
    if errors is None:
        documents = documents.withColumn("problem", F.lit(None).cast("string"))
    else:
        documents = documents.join(errors.groupBy("document_id").agg(F.min("problem").alias("problem")), "document_id", "left")
    error = (
        F.when(F.col("problem").isNotNull(), F.col("problem"))
        .when(F.coalesce("_blocks", F.lit(0)) == 0, "No extractable text found in document.")
        .when(F.coalesce("_chunks", F.lit(0)) == 0, "Document yielded 0 chunks after splitting.")
    )
    joined = (
        documents.join(per_doc, "document_id", "left")
        .join(counted, "document_id", "left")
        .withColumn("error", error)
    )
    ok = F.col("error").isNull()
    return joined.select(
        "document_id",
        F.when(ok, "completed").otherwise("failed").alias("status"),
        F.when(ok, F.col("_chunks")).alias("chunk_count"),
        F.when(ok, F.col("_pii")).alias("pii_entities"),
        "error",
    )


def merge_status(documents: DataFrame, updates: DataFrame) -> DataFrame:
    """Status replaced; null error, count and findings keep the old value."""
    new = updates.select(
        "document_id",
        F.col("status").alias("_status"),
        _clean(F.nullif(F.col("error"), F.lit(""))).alias("_error"),
        F.col("chunk_count").alias("_chunks"),
        F.col("pii_entities").alias("_pii"),
    )
    return (
        documents.join(new, "document_id", "left")
        .withColumns(
            {
                "status": F.coalesce("_status", "status"),
                "error": F.coalesce("_error", "error"),
                "chunk_count": F.coalesce("_chunks", "chunk_count"),
                "pii_entities": F.coalesce("_pii", "pii_entities"),
            }
        )
        .drop("_status", "_error", "_chunks", "_pii")
    )


# Tables that carry pipeline_id themselves
_OWNED = (
    "deployments", "query_logs", "golden_datasets", "chunks", "documents", "runs", "pipelines",
)


def cascade_delete(tables: dict[str, DataFrame], pipeline_ids: DataFrame) -> dict[str, DataFrame]:
    """What is left of each table once pipelines and all that points at them are gone."""
    gone = pipeline_ids.select("pipeline_id").distinct()
    left = dict(tables)
    if "runs" in tables:
        runs = tables["runs"].join(gone, "pipeline_id", "left_semi").select("run_id").distinct()
        if "evaluations" in tables:
            left["evaluations"] = tables["evaluations"].join(runs, "run_id", "left_anti")
        if "experiments" in tables:
            kept = tables["experiments"].join(runs, "run_id", "left_anti")
            parents = runs.withColumnRenamed("run_id", "parent_run_id")
            left["experiments"] = kept.join(parents, "parent_run_id", "left_anti")
    for name in _OWNED:
        if name in tables:
            left[name] = tables[name].join(gone, "pipeline_id", "left_anti")
    return left


def new_source_items(listing: DataFrame, documents: DataFrame, connector_id=None) -> DataFrame:
    """Listed items the connector has not ingested yet."""
    return listing.join(_ingested(documents, connector_id).select("source_id"), "source_id", "left_anti")


def vanished_documents(documents: DataFrame, listing: DataFrame, connector_id=None) -> DataFrame:
    """Ingested documents whose source item is no longer listed."""
    return _ingested(documents, connector_id).join(
        listing.select("source_id").distinct(), "source_id", "left_anti"
    )


def _ingested(documents: DataFrame, connector_id) -> DataFrame:
    known = documents.where(F.col("source_id").isNotNull() & (F.col("source_id") != ""))
    return known if connector_id is None else known.where(F.col("connector_id") == connector_id)


def active_deployments(deployments: DataFrame) -> DataFrame:
    """Latest active deployment per pipeline."""
    active = deployments.where(F.col("status") == "active")
    return latest_per_key(active, "pipeline_id", "activated_at", "deployment_id")


def rollback_target(deployments: DataFrame, requests: DataFrame) -> DataFrame:
    """pipeline_id, deployment_id, status, rollback_reason, active_version.

    requests: pipeline_id, reason, active_version. The active version moves to the
    previous deployment and stays when there is none.
    """
    return (
        active_deployments(deployments)
        .join(requests, "pipeline_id")
        .select(
            "pipeline_id",
            "deployment_id",
            F.lit("rolled_back").alias("status"),
            F.col("reason").alias("rollback_reason"),
            F.coalesce("previous_deployment", "active_version").alias("active_version"),
        )
    )


def activate(deployments: DataFrame, candidates: DataFrame) -> DataFrame:
    """Deployment table after activating one candidate per pipeline.

    candidates: deployment_id, pipeline_id, run_id, activated_at, unified_score. The
    latest active row is superseded and linked from the new one.
    """
    previous = active_deployments(deployments).select(
        "pipeline_id", F.col("deployment_id").alias("_previous")
    )
    linked = candidates.join(previous, "pipeline_id", "left")
    retired = linked.where(F.col("_previous").isNotNull()).select(
        F.col("_previous").alias("deployment_id"), F.lit("superseded").alias("_status")
    )
    kept = (
        deployments.join(retired, "deployment_id", "left")
        .withColumn("status", F.coalesce("_status", "status"))
        .drop("_status")
    )
    added = linked.withColumns(
        {"previous_deployment": F.col("_previous"), "status": F.lit("active")}
    ).drop("_previous")
    return kept.unionByName(added.select(*kept.columns))


def apply_approvals(experiments: DataFrame, decisions: DataFrame) -> DataFrame:
    """decisions: experiment_id, approve, reviewer_id."""
    made = decisions.select(
        "experiment_id",
        F.when(F.col("approve"), "approved").otherwise("rejected").alias("_status"),
        F.col("reviewer_id").alias("_by"),
    )
    return (
        experiments.join(made, "experiment_id", "left")
        .withColumns(
            {
                "approval_status": F.coalesce("_status", "approval_status"),
                "approved_by": F.when(F.col("_status").isNotNull(), F.col("_by")).otherwise(
                    F.col("approved_by")
                ),
            }
        )
        .drop("_status", "_by")
    )


def deployable_runs(requests: DataFrame, evaluations: DataFrame) -> DataFrame:
    """Each request with its run's latest evaluation, or the error that stops it."""
    latest = evaluations.groupBy("run_id").agg(
        F.max_by(
            F.struct("unified_score", "deploy_eligible"), F.struct("evaluated_at", "evaluation_id")
        ).alias("_e")
    )
    ok = F.coalesce(F.col("_e.deploy_eligible"), F.lit(False))
    return requests.join(latest, "run_id", "left").select(
        *requests.columns,
        F.when(ok, F.col("_e.unified_score")).alias("unified_score"),
        F.when(~ok, "ERR_EVAL_HARD_GATE").alias("error"),
    )


