"""Block-tree pages and file listings of document services."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_TEXT = "struct<rich_text:array<struct<plain_text:string>>>"
_KINDS = (
    "paragraph", "heading_1", "heading_2", "heading_3", "bulleted_list_item", "numbered_list_item",
)
PAGE_BLOCKS = "array<struct<type:string," + ",".join(f"{k}:{_TEXT}" for k in _KINDS) + ">>"
UNTITLED = "Untitled Page"


def _plain(rich: Column) -> Column:
    parts = F.transform(rich, lambda t: F.coalesce(t["plain_text"], F.lit("")))
    return F.coalesce(F.array_join(parts, ""), F.lit(""))


def page_text(blocks_json: Column, title: Column) -> Column:
    """Markdown of one page; block kinds without text are dropped."""
    blocks = F.from_json(blocks_json, PAGE_BLOCKS)

    def line(b: Column) -> Column:
        out = F.lit(None).cast("string")
        for kind in _KINDS:
            text = _plain(b[kind]["rich_text"])
            if kind.startswith("heading_"):
                text = F.concat(F.lit("#" * (int(kind[-1]) + 1) + " "), text)
            elif kind != "paragraph":
                text = F.concat(F.lit("- "), text)
            out = F.when(b["type"] == kind, text).otherwise(out)
        return out

    lines = F.filter(F.transform(blocks, line), lambda s: s.isNotNull())
    head = F.concat(F.lit("# "), _title(title), F.lit("\n"))
    return F.array_join(F.concat(F.array(head), F.coalesce(lines, F.array().cast("array<string>"))), "\n\n")


def _title(title: Column) -> Column:
    return F.when(title.isNull(), UNTITLED).otherwise(title)


def page_blocks_to_text(pages: DataFrame, blocks_json: str, title: str) -> DataFrame:
    return pages.withColumns(
        {
            "content": page_text(F.col(blocks_json), F.col(title)),
            "filename": F.concat(_title(F.col(title)), F.lit(".md")),
        }
    )


# Workspace kinds
_FOLDER = "application/vnd.google-apps.folder"
_WORKSPACE = "application/vnd.google-apps."
_DOCUMENT = "application/vnd.google-apps.document"
_SHEET = "application/vnd.google-apps.spreadsheet"


def select_exportable(items: DataFrame, scheme: str) -> DataFrame:
    """Files of a listing that can be fetched, with their export type and source id.

    Expects item_id, name, mime_type, is_folder, has_link. Folders, workspace kinds
    without an export and items without a link are dropped.
    """
    mime = F.col("mime_type")
    export = F.when(mime == _DOCUMENT, "text/plain").when(mime == _SHEET, "text/csv")
    suffix = F.when(mime == _DOCUMENT, ".txt").when(mime == _SHEET, ".csv").otherwise("")
    usable = (
        ~F.col("is_folder")
        & (mime != _FOLDER)
        & F.col("has_link")
        & (~mime.startswith(_WORKSPACE) | export.isNotNull())
    )
    return items.where(usable).select(
        F.concat(F.lit(f"{scheme}://"), F.col("item_id").cast("string")).alias("source_id"),
        F.concat("name", suffix).alias("filename"),
        F.coalesce(export, mime).alias("mime_type"),
    )
