"""Scans and row filters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewell import constants as K
from tidewell.functions.scoring import effective_score
from tidewell.functions.text import is_blank


def scan_chunks(chunks: DataFrame, pipeline_id) -> DataFrame:
    return chunks.where(F.col("pipeline_id") == pipeline_id)


def tenant_filter(df: DataFrame, organization, column: str = "organization_id") -> DataFrame:
    return df.where(F.col(column) == organization)


def metadata_contains(metadata: Column, wanted: Column) -> Column:
    """True when the map holds every entry of `wanted`; null or empty means no filter."""
    held = F.forall(
        F.map_entries(wanted),
        lambda e: F.map_contains_key(metadata, e["key"])
        & F.try_element_at(metadata, e["key"]).eqNullSafe(e["value"]),
    )
    return F.when(wanted.isNull() | (F.size(wanted) <= 0), True).otherwise(
        F.coalesce(held, F.lit(False))
    )


def json_contains(document: Column, wanted: dict) -> Column:
    """Containment of a nested filter in JSON text: objects by key, lists by element.

    Values are compared by type: numbers by value, so 1 equals 1.0, and never with strings;
    null only with null. An element of a wanted list may match any element of the list.
    """

    def held(value: Column, want) -> Column:
        kind = F.coalesce(F.schema_of_variant(value), F.lit(""))
        if isinstance(want, dict):
            out = kind.startswith("OBJECT")
            for key, inner in want.items():
                quote = '"' if "'" in key else "'"
                path = f"$[{quote}{key}{quote}]"
                out = out & held(F.try_variant_get(value, path, "variant"), inner)
            return out
        if isinstance(want, list):
            have = F.try_variant_get(value, "$", "array<variant>")
            out = kind.startswith("ARRAY")
            for inner in want:
                out = out & F.coalesce(F.exists(have, holds(inner)), F.lit(False))
            return out
        if want is None:
            return F.coalesce(F.is_variant_null(value), F.lit(False))
        if isinstance(want, bool):
            same = F.try_variant_get(value, "$", "boolean") == F.lit(want)
            return F.coalesce((kind == "BOOLEAN") & same, F.lit(False))
        if isinstance(want, int | float):
            number = kind.rlike("^(BIGINT|DECIMAL|DOUBLE|FLOAT)")
            return F.coalesce(number & (F.try_variant_get(value, "$", "double") == F.lit(float(want))), F.lit(False))
        return F.coalesce((kind == "STRING") & (F.try_variant_get(value, "$", "string") == F.lit(want)), F.lit(False))

    def holds(want) -> Callable[[Column], Column]:
        return lambda element: held(element, want)

    return held(F.try_parse_json(document), wanted) if wanted else F.lit(True)


def as_text(v) -> str:
    """A filter value as metadata maps hold it."""
    return str(v).lower() if isinstance(v, bool) else str(v)


def drop_blank_blocks(blocks: DataFrame, content: str = "content") -> DataFrame:
    return blocks.where(~is_blank(F.col(content)))


def retryable(docs: DataFrame) -> DataFrame:
    return docs.where(F.col("status").isin(*K.RETRYABLE_STATUS))


def due_connectors(connectors: DataFrame, now: Column) -> DataFrame:
    """Active connectors never synced, or last synced at least their interval ago.

    last_synced_at may be a timestamp or ISO text; times without a zone are UTC, and text
    that is no timestamp leaves the connector out. `now` is a timestamp.
    """
    kind = connectors.schema["last_synced_at"].dataType.simpleString()
    synced = F.col("last_synced_at")
    if kind == "string":
        # Text that already names a zone does not parse with another one behind it.
        at = F.unix_micros(
            F.coalesce(F.try_to_timestamp(F.concat(synced, F.lit("Z"))), F.try_to_timestamp(synced))
        )
    elif kind == "timestamp_ntz":
        epoch = F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")
        at = F.timestamp_diff("MICROSECOND", epoch, synced)
    else:
        at = F.unix_micros(synced)
    interval = F.coalesce(F.col("sync_interval_minutes"), F.lit(60))
    waited = F.unix_micros(now) - at
    due = synced.isNull() | (waited >= interval.cast("long") * 60_000_000)
    return connectors.where((F.col("status") == "active") & due)


def weak_queries(hits: DataFrame) -> DataFrame:
    """query_id, strong_hits, weak: fewer than three hits at 0.7 or above."""
    strong = effective_score(F.col("score"), F.col("rrf_score")) >= K.STRONG_HIT
    return (
        hits.groupBy("query_id")
        .agg(F.sum(strong.cast("long")).alias("strong_hits"))
        .withColumn("weak", F.col("strong_hits") < K.MIN_STRONG_HITS)
    )
