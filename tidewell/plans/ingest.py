"""Files to stored chunks."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import partial

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewell.functions.replies import apply_second_pass
from tidewell.functions.rows import explode_rows
from tidewell.operators import chunking, lifecycle, pii
from tidewell.operators.embedding import Provider, embed_chunks
from tidewell.operators.filters import drop_blank_blocks
from tidewell.operators.spread_chunks import semantic_chunks_spread
from tidewell.plans.store import KeyedStore
from tidewell.plans.term_index import TermIndex
from tidewell.session import materialise
from tidewell.sources import files as file_source
from tidewell.sources import tabular, transcripts
from tidewell.sources.html import html_blocks

BLOCK = (
    "struct<type:string,content:string,page_number:int,media_path:string,metadata:map<string,string>>"
)
BlockParser = Callable[[Column, Column], Column]


@dataclass
class Ingested:
    chunks: DataFrame
    summary: DataFrame
    audit: DataFrame


def _block(kind: Column, content: Column, media: Column) -> Column:
    none = F.from_json(F.lit("{}"), "map<string,string>")
    return F.struct(
        kind.alias("type"),
        content.alias("content"),
        F.lit(1).alias("page_number"),
        media.cast("string").alias("media_path"),
        none.alias("metadata"),
    ).cast(BLOCK)


def parse_files(files: DataFrame, parsers: dict[str, BlockParser] | None = None) -> DataFrame:
    """Blocks of every file: document_id, ..., block_no, type, content, page_number,
    media_path, metadata.

    files: document_id, filename, mime_type, bytes and any further columns. `parsers`
    maps a format to a function of (bytes, filename) giving array<BLOCK>; binary formats
    need one, as a file without blocks fails later on. A block of type `error` holds what is
    wrong with a file that could not be read. Every file is read in one pass; a
    parser sees null for files of other formats.
    """
    routed = file_source.route_format(files).withColumn(
        "_text", file_source.decode_text(F.col("bytes"))
    )

    def only(fmt: str) -> Column:
        return F.when(F.col("format") == fmt, F.col("_text"))

    staged = tabular.csv_tables(routed.withColumn("_csv_text", only("csv")), "_csv_text")
    staged = staged.withColumn("_html", html_blocks(only("html")))
    media = F.col("filename")
    by_format = {
        "csv": F.when(F.col("csv_error").isNotNull(), F.array(_block(F.lit("error"), F.col("csv_error"), media))).otherwise(
            F.transform("tables", lambda t: _block(F.lit("table"), t, media))
        ),
        "html": F.transform("_html", lambda b: _block(b["type"], b["content"], media)),
        "youtube": transcripts.transcript_blocks(
            transcripts.segments_from_json(F.col("_text")),
            transcripts.video_id_from_filename(F.col("filename")),
        ).cast(f"array<{BLOCK}>"),
        "text": F.array(_block(F.lit("text"), F.col("_text"), F.lit(None))),
    }
    for fmt, parser in (parsers or {}).items():
        raw = F.when(F.col("format") == fmt, F.col("bytes"))
        by_format[fmt] = parser(raw, F.col("filename")).cast(f"array<{BLOCK}>")
    blocks = F.lit(None).cast(f"array<{BLOCK}>")
    for fmt, column in by_format.items():
        blocks = F.when(F.col("format") == fmt, column).otherwise(blocks)
    keep = [c for c in files.columns if c != "bytes"]
    return explode_rows(staged, keep, blocks, "_b", "block_no").select(*keep, "block_no", "_b.*")


def mask_blocks(blocks: DataFrame, replies: DataFrame | None = None) -> DataFrame:
    """Non-blank blocks, masked, with pii_count.

    replies: document_id, block_no, reply of a second masker, used for blocks whose
    `sensitive` column is true.
    """
    masked = pii.mask_pii(drop_blank_blocks(blocks), "content").drop("content")
    masked = masked.withColumnRenamed("masked", "content")
    if replies is None:
        # Masking never empties a block, so there is nothing to drop afterwards.
        return masked
    joined = masked.join(replies, ["document_id", "block_no"], "left")
    second = apply_second_pass(
        F.col("content"), F.col("pii_count"), F.col("reply"), F.col("sensitive")
    )
    merged = joined.withColumn("_s", second).withColumns(
        {"content": F.col("_s.masked"), "pii_count": F.col("_s.pii_count")}
    )
    return drop_blank_blocks(merged.drop("_s", "reply"))


def chunk_id(document_id: Column, chunk_index: Column) -> Column:
    return F.sha2(F.concat_ws(":", document_id.cast("string"), chunk_index.cast("string")), 256)


def ingest(
    files: DataFrame,
    parsers: dict[str, BlockParser] | None = None,
    replies: DataFrame | None = None,
    provider: Provider | None = None,
    dim: int = 768,
    sep: str = chunking.BLANK_LINE,
    long_chars: int | None = None,
) -> Ingested:
    """Parse, mask, chunk and embed files; a failing file is a row of the summary.

    With `long_chars`, packed blocks of more characters are cut by many tasks.

    files: document_id, pipeline_id, organization_id, chunking_strategy, filename,
    mime_type, sensitive, bytes. Masked blocks are written out once, as the summary and
    the chunks both read them.
    """
    every = materialise(mask_blocks(parse_files(files, parsers), replies))
    unread = every.where("type = 'error'").select("document_id", F.col("content").alias("problem"))
    uncut = files.select("document_id", chunking.strategy_error(F.col("chunking_strategy")).alias("problem"))
    errors = unread.unionByName(uncut.where("problem IS NOT NULL"))
    blocks = every.where("type <> 'error'")
    packer = chunking.semantic_chunks if long_chars is None else partial(semantic_chunks_spread, long_chars=long_chars)
    cut = chunking.chunk_by_strategy(blocks.drop("pii_count", "sensitive", "mime_type"), sep=sep, semantic=packer)
    named = cut.select(
        chunk_id(F.col("document_id"), F.col("chunk_index")).alias("chunk_id"),
        "document_id",
        "pipeline_id",
        "organization_id",
        "chunk_index",
        "token_count",
        "content",
        "page_number",
        F.col("strategy").alias("chunk_strategy"),
        F.col("type").alias("source_type"),
        "media_path",
        "metadata",
    )
    chunks = materialise(embed_chunks(named, provider, dim=dim))
    summary = lifecycle.ingest_summary(files, blocks, chunks, errors)
    return Ingested(chunks, summary, ingest_audit(summary, files))


def ingest_audit(summary: DataFrame, files: DataFrame) -> DataFrame:
    """INGESTION_COMPLETED events of the documents that went through."""
    owners = files.select("document_id", "organization_id")
    done = summary.where("status = 'completed'").join(owners, "document_id")
    events = done.select(
        "organization_id",
        F.lit("INGESTION_COMPLETED").alias("event_type"),
        F.lit("document").alias("resource_type"),
        F.col("document_id").alias("resource_id"),
        F.create_map(
            F.lit("chunks"), F.col("chunk_count").cast("string"),
            F.lit("pii_entities"), F.col("pii_entities").cast("string"),
        ).alias("payload"),
    )
    return lifecycle.check_audit(events)


def ingest_to_store(
    files: DataFrame, store: KeyedStore, index: TermIndex | None = None, **options
) -> Ingested:
    """Ingest and replace the documents that went through; failed ones keep old chunks.

    The term index, where given, is kept up with the chunks.
    """
    result = ingest(files, **options)
    result = Ingested(result.chunks, materialise(result.summary), result.audit)
    done = result.summary.where("status = 'completed'").select("document_id")
    through = result.chunks.join(done, "document_id", "left_semi")
    store.replace(through, done)
    if index is not None:
        index.replace(through, done)
    return result
