"""Raw files to rows: read, route by format, decode."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewell.functions.urls import file_format


def read_files(spark: SparkSession, path: str, glob: str | None = None) -> DataFrame:
    """path, size, modified, content of every file under `path`."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    return _files(reader.load(path))


def stream_files(spark: SparkSession, path: str, max_files: int = 1000) -> DataFrame:
    """The same rows for files that keep arriving."""
    reader = (
        spark.readStream.format("binaryFile")
        .schema("path string, modificationTime timestamp, length long, content binary")
        .option("recursiveFileLookup", "true")
        .option("maxFilesPerTrigger", max_files)
    )
    return _files(reader.load(path))


def _files(raw: DataFrame) -> DataFrame:
    return raw.select(
        "path",
        F.substring_index("path", "/", -1).alias("filename"),
        F.col("length").alias("file_size"),
        F.col("modificationTime").alias("modified"),
        F.col("content").alias("bytes"),
    )


def route_format(df: DataFrame, filename: str = "filename", mime: str = "mime_type") -> DataFrame:
    return df.withColumn("format", file_format(F.col(filename), F.col(mime)))


def decode_text(raw: Column) -> Column:
    """UTF-8 where valid, else Latin-1."""
    return F.when(F.is_valid_utf8(raw.cast("string")), raw.cast("string")).otherwise(
        F.decode(raw, "ISO-8859-1")
    )


def text_to_blocks(files: DataFrame, raw: str = "bytes") -> DataFrame:
    return files.withColumn(
        "blocks",
        F.array(
            F.struct(
                F.lit("text").alias("type"),
                decode_text(F.col(raw)).alias("content"),
                F.lit(1).alias("page_number"),
                F.lit(None).cast("string").alias("media_path"),
                F.map_from_arrays(
                    F.array().cast("array<string>"), F.array().cast("array<string>")
                ).alias("metadata"),
            )
        ),
    )
