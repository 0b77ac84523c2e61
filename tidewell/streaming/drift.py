"""Score drift as a stateful stream: the newest scores of a pipeline live in the state store.

State is kept by Spark per key, checkpointed with the offsets and restored on another executor
after a loss; a micro-batch touches only the pipelines it holds scores of.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from tidewell import constants as K
from tidewell.operators.drift import is_drift

_STORE = "spark.sql.streaming.stateStore.providerClass"
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def _micros(df: DataFrame, name: str) -> Column:
    """A time as microseconds, whatever the session's time zone makes of it."""
    if isinstance(df.schema[name].dataType, T.TimestampNTZType):
        return F.timestamp_diff("MICROSECOND", F.lit("1970-01-01").cast("timestamp_ntz"), F.col(name))
    return F.unix_micros(F.col(name))


def _age(score: tuple) -> tuple:
    """Order of scores by time, then run; a missing time or run is the oldest."""
    run, at, _ = score
    return (at is not None, at or 0, run is not None, run if run is not None else 0)


def _better(old: tuple | None, new: tuple) -> tuple:
    """Of two deliveries of a run in one batch the later time, then the higher score."""
    def rank(score: tuple) -> tuple:
        _, at, value = score
        return (at is not None, at or 0, value is not None, value or 0.0)

    return new if old is None or rank(new) > rank(old) else old


def newest_scores(known: list[tuple], fresh: Iterator[tuple], n: int) -> list[tuple]:
    """The `n` newest of (run, time, score), newest first; a fresh delivery of a run wins.

    Holds at most 2 n scores at a time besides the runs of `known`, however many come.
    """
    held: dict = {run: None for run, _, _ in known}
    again: set = set()
    best: dict = {}
    for score in fresh:
        run = score[0]
        if run in held:
            again.add(run)
        best[run] = _better(best.get(run), score)
        if len(best) >= 2 * n:
            best = {s[0]: s for s in sorted(best.values(), key=_age, reverse=True)[:n]}
    rows = [s for s in known if s[0] not in again] + list(best.values())
    return sorted(rows, key=_age, reverse=True)[:n]


class DriftProcessor(StatefulProcessor):
    """Keeps the newest scores of a pipeline as one state value and lets out one row per batch.

    With `forget_ms` a timer per pipeline empties its state when no score has come for so long.
    """

    def __init__(self, run_type: T.DataType, n: int, forget_ms: int | None) -> None:
        score = T.StructType(
            [T.StructField("run_id", run_type), T.StructField("at", T.LongType()), T.StructField("score", T.DoubleType())]
        )
        # One value per pipeline: each access to the state is a round trip of the worker.
        self.held_type = T.StructType([T.StructField("step", T.LongType()), T.StructField("scores", T.ArrayType(score))])
        self.n = n
        self.forget_ms = forget_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getValueState("held", self.held_type)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        last, scores = self.held.get() or (-1, [])
        known = [tuple(s) for s in scores]
        kept = newest_scores(known, ((r["run_id"], r["at"], r["score"]) for r in rows), self.n)
        step = last + 1
        self.held.update((step, kept))
        if self.forget_ms is not None:
            for timer in list(self.handle.listTimers()):
                self.handle.deleteTimer(timer)
            self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.forget_ms)
        if len(kept) >= 2:
            prior = [s for _, _, s in kept[1:] if s is not None]
            mean = sum(prior) / len(prior) if prior else None
            yield Row(pipeline_id=key[0], step=step, n_scores=len(kept), latest=kept[0][2], prior_avg=mean)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        self.held.update((self.held.get()[0], []))
        return iter(())

    def close(self) -> None:
        pass


def drift_rows(
    evaluations: DataFrame,
    n: int = K.DRIFT_WINDOW,
    threshold: float = K.DRIFT_DROP,
    forget_ms: int | None = None,
) -> DataFrame:
    """pipeline_id, step, n_scores, latest, prior_avg, drift as a streaming table.

    evaluations: a stream of pipeline_id, run_id, created_at, unified_score. Per micro-batch
    one row for each pipeline with new scores and at least two in all; `step` counts the batches
    a pipeline had scores in. Late scores take their place by created_at if they are still
    among the newest `n`. A null score counts as a score and is left out of the mean.
    """
    run_type = evaluations.schema["run_id"].dataType
    slim = evaluations.select(
        "pipeline_id",
        "run_id",
        _micros(evaluations, "created_at").alias("at"),
        F.col("unified_score").cast("double").alias("score"),
    )
    out = T.StructType(
        [
            T.StructField("pipeline_id", evaluations.schema["pipeline_id"].dataType),
            T.StructField("step", T.LongType()),
            T.StructField("n_scores", T.LongType()),
            T.StructField("latest", T.DoubleType()),
            T.StructField("prior_avg", T.DoubleType()),
        ]
    )
    rows = slim.groupBy("pipeline_id").transformWithState(
        DriftProcessor(run_type, n, forget_ms), out, "Append", "None" if forget_ms is None else "ProcessingTime"
    )
    return rows.withColumn("drift", is_drift(F.col("latest"), F.col("prior_avg"), threshold))


def drift_stream(
    evaluations: DataFrame,
    out_path: str,
    checkpoint: str,
    n: int = K.DRIFT_WINDOW,
    every: str | None = None,
    forget_ms: int | None = None,
) -> StreamingQuery:
    """Drift of every pipeline that got new scores, appended to a Parquet table once per batch.

    Runs once through what is there, or at `every` interval. Started again on the same
    checkpoint it goes on with the state it had; the table's log leaves out the files of a
    batch that did not end. State lives in RocksDB, the only store with list state and timers.
    `forget_ms` needs `every`: a stream with timers has always another batch to run.
    """
    if forget_ms is not None and not every:
        raise ValueError("forget_ms needs a stream that keeps running: give every")
    spark = evaluations.sparkSession
    spark.conf.set(_STORE, _ROCKS)
    writer = drift_rows(evaluations, n, forget_ms=forget_ms).writeStream.outputMode("append").format("parquet")
    writer = writer.option("checkpointLocation", checkpoint).option("path", out_path)
    trigger = {"processingTime": every} if every else {"availableNow": True}
    return writer.trigger(**trigger).start()


def drift_state(spark: SparkSession, checkpoint: str) -> DataFrame:
    """pipeline_id, run_id, at (microseconds), score: the scores held after the last batch."""
    rows = spark.read.format("statestore").option("path", checkpoint).option("stateVarName", "held").load()
    return rows.select("key.pipeline_id", F.explode("value.scores").alias("_s")).select("pipeline_id", "_s.*")
