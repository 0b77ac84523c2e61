"""Session defaults and lineage cutting."""

from __future__ import annotations

import tempfile
import threading
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

#: Bytes of one Arrow batch of texts.
BATCH_BYTES = 4 << 20


def get_spark(app: str = "tidewell", master: str | None = None, conf: dict | None = None) -> SparkSession:
    """Session with the settings the operators rely on; `conf` overrides them."""
    settings = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        # Keeps rows without a partner out of the shuffle when few hits meet all chunks.
        "spark.sql.optimizer.runtime.bloomFilter.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        **(conf or {}),
    }
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in settings.items():
        builder = builder.config(key, value)
    return prepare(builder.getOrCreate())


def prepare(spark: SparkSession) -> SparkSession:
    """Settings results depend on, for a session made elsewhere.

    Spark 4.1 lets a union claim its inputs' partitioning; under adaptive execution the
    claim can be wrong and a join above fails on unequal partition counts.
    """
    spark.conf.set("spark.sql.unionOutputPartitioning", "false")
    return spark


def prepare_texts(spark: SparkSession) -> SparkSession:
    """Settings for work on texts; no result depends on them."""
    prepare(spark)
    # A batch handed to Python is bounded by its bytes, not only by 10,000 rows of any length.
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the shared folder named by the cluster; a local folder only in local mode."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is not None:
        return
    configured = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if configured:
        sc.setCheckpointDir(configured)
    elif sc.master.startswith("local"):
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="tidewell-ckpt-"))
    else:
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")


def materialise(df: DataFrame) -> DataFrame:
    """Write `df` once as a table in the shared checkpoint folder and read it from there.

    The table cuts the lineage and outlives lost executors; read back as Parquet it also
    has true sizes for join planning and is pruned by column.
    """
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    path = f"{spark.sparkContext.getCheckpointDir()}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    table = spark.read.schema(df.schema).parquet(path)
    table.stored_at = path
    if (written := _written.get(threading.get_ident())) is not None:
        written.append(table.stored_at)
    return table


#: Paths written by the threads that are inside `passing_tables`; plain values, as functions are pickled with it.
_written: dict[int, list[str]] = {}


@contextmanager
def passing_tables(spark: SparkSession) -> Iterator[None]:
    """Tables `materialise` writes inside are deleted at the end; nothing that is read later may rest on them."""
    me = threading.get_ident()
    before, _written[me] = _written.get(me), []
    try:
        yield
    finally:
        paths = _written.pop(me)
        if before is not None:
            _written[me] = before
        for path in paths:
            _delete(spark, path)


def release(*tables: DataFrame) -> None:
    """Delete tables `materialise` has written, once nothing reads them any more."""
    for table in tables:
        _delete(table.sparkSession, table.stored_at)


def _delete(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def stored_bytes(spark: SparkSession, path: str) -> int:
    """Size of a file or folder in whatever store its path names."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()).getContentSummary(where).getLength()
