"""CSV files cut anywhere: each line says what it does to the quote state, a prefix scan joins them.

A line either keeps the state (inside or outside a quoted field), sets it, or swaps it. The state
after a line is that of the last setting line, swapped as often as lines after it say, so two
running totals over buckets of lines give it for all lines of a file at once, whichever tasks
read them. Lines that end outside quotes end a record.
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewell import constants as K
from tidewell.functions import ordered
from tidewell.functions.text import strip
from tidewell.sources.tabular import csv_rows, table_text

KEEP, OUTSIDE, INSIDE, SWAP = 0, 1, 2, 3

# What follows an opening quote up to the closing one; a doubled quote stands for itself.
_BODY = re.compile(r'[^"]*+(?:""[^"]*+)*+')


def _ends_inside(line: str, inside: bool) -> bool:
    """Whether a quoted field is open after `line`, if one was open before or not."""
    at = 0
    while True:
        if not inside:
            # A quote opens a field only as its first character.
            opening = 0 if at == 0 and line.startswith('"') else line.find(',"', at) + 1
            if opening == 0 and not (at == 0 and line.startswith('"')):
                return False
            at = opening + 1
        at = _BODY.match(line, at).end()
        if at >= len(line):
            return True
        inside, at = False, at + 1


@F.pandas_udf(T.IntegerType())
def _quote_effect(lines: pd.Series) -> pd.Series:
    kinds = {(False, True): KEEP, (False, False): OUTSIDE, (True, True): INSIDE, (True, False): SWAP}
    return pd.Series(
        [KEEP if t is None else kinds[(_ends_inside(t, False), _ends_inside(t, True))] for t in lines], dtype="int32"
    )


def file_lines(spark: SparkSession, paths: str | list[str], **options) -> DataFrame:
    """path, part, line_no, line of text files; a large file is read by many tasks.

    `part` is the byte a split begins at, `line_no` grows within a part.
    """
    rows = spark.read.options(**options).text(paths)
    return rows.select(
        F.col("_metadata.file_path").alias("path"),
        F.col("_metadata.file_block_start").alias("part"),
        F.monotonically_increasing_id().alias("line_no"),
        F.col("value").alias("line"),
    )


def text_lines(files: DataFrame, text: str, key: str) -> DataFrame:
    """key, part, line_no, line of texts held in a column."""
    lines = F.split(F.regexp_replace(F.col(text), "\r\n?", "\n"), "\n", -1)
    return files.select(key, F.posexplode(lines).alias("line_no", "line")).select(
        key, F.lit(0).cast("long").alias("part"), F.col("line_no").cast("long").alias("line_no"), "line"
    )


def _without_blank_ends(lines: DataFrame, key: str) -> DataFrame:
    """Lines from the first to the last that is not blank, without white space at the file's ends."""
    at = F.struct("part", "line_no")
    written = lines.where(strip(F.col("line")) != "")
    ends = written.groupBy(key).agg(F.min(at).alias("_first"), F.max(at).alias("_last"))
    kept = ordered.join_null_safe(lines, ends, [key]).where((at >= F.col("_first")) & (at <= F.col("_last")))
    line, blanks = F.col("line"), F.lit(K.WHITESPACE)
    begun = F.when(at == F.col("_first"), F.ltrim(line, blanks)).otherwise(line)
    kept = kept.withColumn("line", begun)
    ended = F.when(at == F.col("_last"), F.rtrim(line, blanks)).otherwise(line)
    return kept.withColumn("line", ended).drop("_first", "_last")


def record_numbers(lines: DataFrame, key: str) -> DataFrame:
    """Add `record`: 1, 2, 3, ... per file; lines of one quoted field share the number."""
    bucket = F.struct("part", F.floor(F.col("line_no") / ordered.BUCKET_ROWS).alias("stretch"))
    order = ["line_no"]
    # Lines without a quote reach Python as nulls.
    staged = lines.withColumn("_effect", _quote_effect(F.when(F.contains("line", F.lit('"')), F.col("line"))))
    staged = ordered.running_sum(staged, [key], order, (F.col("_effect") == SWAP).cast("long"), bucket, "_swaps")
    sets = F.col("_effect").isin(OUTSIDE, INSIDE)
    # The state a file starts in, or the one last set, as it is if later swaps are counted from the start.
    anchored = (F.col("_effect") == INSIDE).cast("long").bitwiseXOR(F.col("_swaps") % 2)
    mark = F.when(sets, F.struct("part", "line_no", anchored.alias("state")))
    staged = ordered.running_max(staged, [key], order, mark, bucket, "_set")
    inside = F.coalesce(F.col("_set.state"), F.lit(0)).bitwiseXOR(F.col("_swaps") % 2)
    staged = staged.withColumn("_ends", (inside == 0).cast("long"))
    staged = ordered.running_sum(staged, [key], order, F.col("_ends"), bucket, "_closed")
    return staged.withColumn("record", F.col("_closed") - F.col("_ends") + 1).drop("_effect", "_swaps", "_set", "_ends", "_closed")


def csv_line_blocks(lines: DataFrame, key: str, n: int = K.ROWS_PER_TABLE) -> DataFrame:
    """key, block_no, type, content, page_number: one markdown table per `n` data records.

    lines: key, part, line_no, line, as `file_lines` and `text_lines` give them. Equals
    `csv_to_blocks` on the whole text, but no task holds more than the records of one table;
    a quote that is never closed makes the rest of its file one record, and so one task's.
    """
    rows = record_numbers(_without_blank_ends(lines, key), key)
    group = F.floor((F.col("record") - 2) / n).cast("int")
    sorted_lines = F.array_sort(F.collect_list(F.struct("part", "line_no", "line")))
    texts = rows.groupBy(key, group.alias("block_no")).agg(
        F.array_join(F.transform(sorted_lines, lambda r: F.concat(r["line"], F.lit("\n"))), "").alias("_text")
    )
    cells = F.transform("_csv.rows", lambda r: F.transform(r, lambda cell: strip(cell)))
    parsed = texts.withColumn("_csv", csv_rows("_text")).select(key, "block_no", cells.alias("_rows"))
    heads = parsed.where("block_no = -1").select(key, F.get("_rows", 0).alias("_header"))
    heads = heads.where(F.exists("_header", lambda h: h != ""))
    bodies = parsed.where("block_no >= 0")
    # A bare header is a table too: block 0 without records.
    lone = heads.select(key, F.lit(0).alias("block_no"), F.array().cast("array<array<string>>").alias("_rows"))
    firsts = lone.join(bodies.where("block_no = 0").select(F.col(key).alias("_k")), F.col(key).eqNullSafe(F.col("_k")), "left_anti")
    tables = ordered.join_null_safe(bodies.unionByName(firsts), heads, [key])
    return tables.select(
        key, "block_no", F.lit("table").alias("type"), table_text(F.col("_header"), F.col("_rows")).alias("content"), F.lit(1).alias("page_number")
    )
