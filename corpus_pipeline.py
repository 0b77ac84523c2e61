"""Corpus pipeline: rules, lines, near-duplicates, mix, packing.

STAGES are applied in order; each reads what the one before has written. A stage works on
all rows it is given. All but the last return the columns they are given.

Edge cases are those of the operators: null and empty texts fail the quality rules, rows
that share an id are judged together in the near-duplicate and line stages, extra columns
pass through whatever their names, an empty table runs through.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidewell.llm import lines, mixing, packing, quality, simhash
from tidewell.llm.textkit import n_words
from tidewell.session import ensure_checkpoint_dir, prepare

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]

#: Learned rules, fuzzy lines and Hamming groups have no plain SQL form.
ORACLE_SQL = None


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that neither the base rules nor the learned list reject."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    rules = quality.fit_rules(docs, labels)
    rows = docs.select(F.struct("*").alias("_row")).withColumn("text", F.col("_row.text"))
    return quality.judge(rows, rules).where("kept").select("_row.*")


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without lines whose component has an earlier line."""
    return lines.keep_first(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each SimHash group of op 6 (three words, distance 3).

    Most pairs at a five-word Jaccard similarity of 0.8 are farther apart and stay; the README
    has the shares.
    """
    return simhash.keep_first(docs)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows as often as the mix takes them; rows of one id share its copies out."""
    keys = ["doc_id", "source", "size"]
    slim = docs.select("doc_id", "source", n_words(F.col("text").cast("string")).alias("size"))
    taken = mixing.mix(slim, size=F.col("size")).groupBy(*keys).agg(F.sum("copies").alias("_all"), F.count("*").alias("_rows"))
    taken = taken.where("_all > 0").select(*[F.col(k).alias(f"_{k}") for k in keys], "_all", "_rows")
    rows = docs.select(F.struct("*").alias("_row"))
    same = (
        F.col("_row.doc_id").eqNullSafe(F.col("_doc_id"))
        & F.col("_row.source").eqNullSafe(F.col("_source"))
        & (n_words(F.col("_row.text").cast("string")) == F.col("_size"))
    )
    joined = rows.join(taken, same)
    number = F.row_number().over(W.partitionBy("_doc_id", "_source", "_size").orderBy(F.xxhash64("_row.text")))
    copies = F.floor(F.col("_all") / F.col("_rows")) + F.when(number <= F.col("_all") % F.col("_rows"), 1).otherwise(0)
    counted = joined.withColumn("_copies", copies).where("_copies > 0")
    return counted.select("_row", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_copies")))).select("_row.*")


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the mix with their length bucket, batch and slot."""
    return packing.pack(docs)


STAGES: list[tuple[str, Stage]] = [
    ("quality_rules", quality_rules),
    ("line_dedup", line_dedup),
    ("near_duplicates", near_duplicates),
    ("source_mix", source_mix),
    ("packing", packed),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each result is written to the shared folder and reread."""
    prepare(spark)
    ensure_checkpoint_dir(spark)
    folder = f"{spark.sparkContext.getCheckpointDir()}/pipeline-{uuid.uuid4().hex}"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for number, (name, stage) in enumerate(STAGES):
        path = f"{folder}/{number}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
