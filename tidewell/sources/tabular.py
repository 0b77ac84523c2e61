"""Tables to markdown blocks of a few rows, each repeating the header."""

from __future__ import annotations

import csv
import io
import sys

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewell import constants as K
from tidewell.functions import ordered
from tidewell.functions.rows import explode_rows
from tidewell.functions.text import strip


def _line(cells: Column) -> Column:
    return F.concat(F.lit("| "), F.array_join(cells, " | "), F.lit(" |"))


def _rule(n: Column) -> Column:
    return _line(F.array_repeat(F.lit("---"), n))


_READ = T.StructType(
    [
        T.StructField("rows", T.ArrayType(T.ArrayType(T.StringType()))),
        T.StructField("error", T.StringType()),
    ]
)


@F.pandas_udf(_READ)
def csv_rows(texts: pd.Series) -> pd.DataFrame:
    """Cells of each file, or what keeps it from being read as CSV; null text has neither."""

    csv.field_size_limit(sys.maxsize)

    def read(text):
        if text is None:
            return None, None
        try:
            return list(csv.reader(io.StringIO(text, newline=""))), None
        except csv.Error as problem:
            return None, f"CSV: {problem}"

    return pd.DataFrame([read(t) for t in texts], columns=["rows", "error"])


def table_text(header: Column, rows: Column) -> Column:
    """A markdown table; rows are padded or cut to the header's width."""
    width = F.size(header)

    def fit(row: Column) -> Column:
        pad = F.array_repeat(F.lit(""), F.greatest(width - F.size(row), F.lit(0)))
        return F.concat(F.slice(row, F.lit(1), F.least(F.size(row), width)), pad)

    body = F.transform(rows, lambda r: _line(fit(r)))
    return F.array_join(F.concat(F.array(_line(header), _rule(width)), body), "\n")


def csv_tables(files: DataFrame, text: str, n: int = K.ROWS_PER_TABLE) -> DataFrame:
    """Add `tables`: one markdown table per `n` data rows of each file's text.

    Rows are padded or cut to the header's width. No table when the header is empty;
    a bare header gives one table. `csv_error` says why a file could not be read.
    """
    trimmed = strip(F.regexp_replace(F.col(text), "\r\n?", "\n"))
    rows = F.transform("_csv.rows", lambda r: F.transform(r, lambda cell: strip(cell)))
    staged = files.withColumn("_csv", csv_rows(trimmed)).withColumns({"_rows": rows, "csv_error": F.col("_csv.error")})
    staged = staged.withColumn("_header", F.get("_rows", 0))
    header = F.col("_header")
    groups = F.sequence(F.lit(2), F.greatest(F.size("_rows"), F.lit(2)), F.lit(n))

    def table(first: Column) -> Column:
        return table_text(header, F.slice(F.col("_rows"), first, n))

    empty = header.isNull() | F.forall(header, lambda h: h == "")
    tables = F.when(empty, F.array().cast("array<string>")).otherwise(F.transform(groups, table))
    return staged.withColumn("tables", tables).drop("_csv", "_rows", "_header")


def csv_to_blocks(files: DataFrame, text: str, n: int = K.ROWS_PER_TABLE) -> DataFrame:
    """One row per table block: block_no, type, content, page_number."""
    keep = [c for c in files.columns if c != text]
    rows = explode_rows(csv_tables(files, text, n), keep, F.col("tables"), "content", "block_no")
    return rows.withColumns({"type": F.lit("table"), "page_number": F.lit(1)})


def rows_to_markdown(
    df: DataFrame,
    keys: list[str],
    order: str,
    cols: list[str],
    n: int = K.ROWS_PER_TABLE,
    title: str | None = None,
    bucket: Column | None = None,
) -> DataFrame:
    """Tables of `n` rows per key for rows that are already tabular.

    Rows that are null throughout are left out. With `title` each table starts with
    `Sheet: <title>`. `bucket` must grow with `order` (default: the order column, taken
    as a number, in steps of 8,192), so that a large sheet spreads over tasks.
    """
    kept = df.where(F.coalesce(*[F.col(c).cast("string") for c in cols]).isNotNull())
    cells = F.array(*[strip(F.coalesce(F.col(c).cast("string"), F.lit(""))) for c in cols])
    spread = F.floor(F.col(order) / ordered.BUCKET_ROWS) if bucket is None else bucket
    numbered = ordered.row_number(
        kept.select(*keys, order, _line(cells).alias("_line"), spread.alias("_spread")),
        keys,
        [order],
        F.col("_spread"),
        "_rn",
    )
    head = [F.concat(F.lit("Sheet: "), F.col(title))] if title else []
    names = F.array(*[F.lit(c) for c in cols])
    head += [_line(names), _rule(F.lit(len(cols)))]
    lines = F.transform(F.array_sort(F.collect_list(F.struct("_rn", "_line"))), lambda r: r["_line"])
    return (
        numbered.groupBy(*keys, F.floor((F.col("_rn") - 1) / n).cast("int").alias("block_no"))
        .agg(lines.alias("_lines"))
        .select(
            *keys,
            "block_no",
            F.lit("table").alias("type"),
            F.array_join(F.concat(F.array(*head), F.col("_lines")), "\n").alias("content"),
        )
    )
