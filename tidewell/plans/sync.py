"""One pass of a source connector."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewell.operators import lifecycle


@dataclass
class Synced:
    to_ingest: DataFrame
    to_delete: DataFrame
    documents: DataFrame
    connectors: DataFrame


def sync_source(
    listing: DataFrame, documents: DataFrame, connectors: DataFrame, connector_id, now
) -> Synced:
    """Items to fetch, documents to drop, and the tables afterwards.

    listing: source_id of every item seen. documents: document_id, source_id,
    connector_id. The connector ends active with last_synced_at at `now`.
    """
    new = lifecycle.new_source_items(listing, documents, connector_id)
    gone = lifecycle.vanished_documents(documents, listing, connector_id)
    kept = documents.join(gone.select("document_id"), "document_id", "left_anti")
    mine = F.col("connector_id") == connector_id
    stamped = connectors.withColumns(
        {
            "status": F.when(mine, "active").otherwise(F.col("status")),
            "last_synced_at": F.when(mine, F.lit(now).cast("timestamp")).otherwise(
                F.col("last_synced_at")
            ),
        }
    )
    return Synced(new, gone, kept, stamped)
