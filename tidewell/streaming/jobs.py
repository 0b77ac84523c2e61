"""Continuous ingest and connector polling; the drift watch is in `streaming/drift.py`.

Each micro-batch runs the same DataFrame code as the batch jobs inside foreachBatch.
Every write is keyed by document, pipeline or batch number, so a batch that is run again
after a failure leaves the same tables.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tidewell.operators.filters import due_connectors
from tidewell.operators.ranking import latest_per_key
from tidewell.plans.ingest import ingest_to_store
from tidewell.plans.store import KeyedStore
from tidewell.session import materialise, passing_tables

POLL_SECONDS = 300
SCAN_MINUTES = 60


def _start(
    stream: DataFrame, run: Callable[[DataFrame, int], None], checkpoint: str, every: str | None
) -> StreamingQuery:
    """Run `run` per batch: once through what is there, or `every` interval."""
    writer = stream.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint)
    trigger = {"processingTime": every} if every else {"availableNow": True}
    return writer.trigger(**trigger).start()


def ingest_stream(
    files: DataFrame,
    store: KeyedStore,
    checkpoint: str,
    summary_path: str | None = None,
    every: str | None = None,
    **options,
) -> StreamingQuery:
    """Chunks of arriving files; a file delivered twice replaces its own chunks.

    files: a stream with the columns `ingest` takes, e.g. `stream_files` joined to the
    document table. Of several deliveries in one batch the last by `modified` counts; where
    there is no such column, one chosen by the hash of its bytes, so a replay chooses alike.
    The chosen files are written once, as ingest reads them several times; what a batch writes
    on the way is deleted behind it.
    """

    def run(batch: DataFrame, number: int) -> None:
        if "modified" in batch.columns:
            one = latest_per_key(batch, "document_id", "modified", "modified")
        else:
            one = latest_per_key(batch.withColumn("_h", F.xxhash64("bytes")), "document_id", "_h", "_h").drop("_h")
        with passing_tables(batch.sparkSession):
            result = ingest_to_store(materialise(one), store, **options)
            if summary_path:
                result.summary.write.mode("overwrite").parquet(f"{summary_path}/batch={number}")

    return _start(files, run, checkpoint, every)


def connector_due_stream(
    ticks: DataFrame,
    connectors: Callable[[], DataFrame],
    out_path: str,
    checkpoint: str,
    now: Column | None = None,
    every: str | None = f"{POLL_SECONDS} seconds",
) -> StreamingQuery:
    """Due connectors at every trigger; `connectors` reads the table afresh each time."""

    def run(_: DataFrame, number: int) -> None:
        at = F.current_timestamp() if now is None else now
        due_connectors(connectors(), at).write.mode("overwrite").parquet(f"{out_path}/batch={number}")

    return _start(ticks, run, checkpoint, every)
