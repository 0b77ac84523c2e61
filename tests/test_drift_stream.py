from __future__ import annotations

import random
import time
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tidewell.operators.drift import score_drift
from tidewell.streaming.drift import drift_rows, drift_state, drift_stream, newest_scores

SCHEMA = "pipeline_id string, run_id int, created_at timestamp_ntz, unified_score double"
START = datetime(2024, 1, 1)


class Feed:
    """A folder of scores, its drift stream and what came out."""

    def __init__(self, spark, base, **options):
        self.spark, self.base, self.options = spark, base, options

    def deliver(self, rows):
        """One file, one batch; the stream is started anew on its checkpoint each time."""
        self.spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(f"{self.base}/in")
        stream = self.spark.readStream.schema(SCHEMA).parquet(f"{self.base}/in")
        drift_stream(stream, f"{self.base}/out", f"{self.base}/ckpt", **self.options).awaitTermination()

    def rows(self):
        out = self.spark.read.parquet(f"{self.base}/out").collect()
        return {(r["pipeline_id"], r["step"]): r for r in out}

    def held(self):
        rows = drift_state(self.spark, f"{self.base}/ckpt").collect()
        return sorted((r["pipeline_id"], r["run_id"], r["score"]) for r in rows)


@pytest.fixture
def feed(spark, tmp_path):
    return lambda **options: Feed(spark, str(tmp_path), **options)


def test_late_scores_take_their_place(feed):
    one = feed()
    one.deliver([("p", 1, START, 0.9), ("p", 2, START + timedelta(days=2), 0.8)])
    one.deliver([("p", 3, START + timedelta(days=1), 0.95), ("p", 2, START + timedelta(days=2), 0.8)])
    last = one.rows()[("p", 1)]
    assert (last["n_scores"], last["latest"], last["drift"]) == (3, 0.8, True)
    assert last["prior_avg"] == pytest.approx(0.925)


def test_newer_delivery_of_a_run_wins(feed):
    one = feed()
    for score in (0.2, 0.7):
        one.deliver([("p", 1, START, 0.9), ("p", 2, START + timedelta(days=1), score)])
    assert one.held() == [("p", 1, 0.9), ("p", 2, 0.7)]


def test_every_step_after_restarts_equals_the_batch_operator(spark, feed):
    """Four runs of the stream, late and equal times among them, against A14 on all rows so far."""
    rng, one, all_rows = random.Random(4), feed(), []
    runs = iter(range(1, 10_000))
    steps = dict.fromkeys("abc", -1)
    for _ in range(4):
        rows = [(p, next(runs), START + timedelta(hours=rng.randrange(60)), round(rng.random(), 3)) for p in "abc" for _ in range(rng.randrange(5))]
        if not rows:
            continue
        one.deliver(rows)
        all_rows += rows
        want = {r["pipeline_id"]: r for r in score_drift(spark.createDataFrame(all_rows, SCHEMA)).collect()}
        got = one.rows()
        for p in {r[0] for r in rows}:
            steps[p] += 1
            if p not in want:
                assert (p, steps[p]) not in got
                continue
            row = got[(p, steps[p])]
            assert (row["n_scores"], row["latest"], row["drift"]) == (want[p]["n_scores"], want[p]["latest"], want[p]["drift"])
            assert row["prior_avg"] == pytest.approx(want[p]["prior_avg"])
    assert max(steps.values()) >= 2


def test_batch_run_again_after_a_failure(spark, feed):
    """A batch whose commit is lost runs again: from the state before it, rows once."""
    import os

    one = feed()
    one.deliver([("p", 1, START, 0.9)])
    one.deliver([("p", 2, START + timedelta(days=1), 0.5)])
    before = one.rows()
    for mark in ("1", ".1.crc"):
        os.unlink(f"{one.base}/ckpt/commits/{mark}")
    one.deliver([("q", 1, START, 0.1)])
    assert one.rows() == before and ("p", 2, 0.5) in one.held() and len(one.held()) == 3


def test_null_and_single_scores(feed):
    one = feed()
    one.deliver([("p", 1, START, None), ("p", 2, START + timedelta(days=1), 0.5), ("q", 1, None, 0.3), (None, 1, START, 0.3), (None, 2, START, 0.1)])
    got = {p: (r["n_scores"], r["latest"], r["prior_avg"], r["drift"]) for (p, _), r in one.rows().items()}
    assert got == {"p": (2, 0.5, None, False), None: (2, 0.1, 0.3, True)}


def test_silent_pipelines_are_forgotten(spark, tmp_path):
    def deliver(rows):
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))

    def wait_for(total):
        end = time.time() + 60
        while sum(p["numInputRows"] for p in running.recentProgress) < total:
            assert running.isActive and time.time() < end
            time.sleep(0.3)

    deliver([("p", 1, START, 0.9), ("p", 2, START + timedelta(days=1), 0.8)])
    stream = spark.readStream.schema(SCHEMA).parquet(str(tmp_path / "in"))
    running = drift_stream(stream, str(tmp_path / "out"), str(tmp_path / "ckpt"), every="1 second", forget_ms=1000)
    try:
        wait_for(2)
        time.sleep(6)
        deliver([("p", 3, START + timedelta(days=2), 0.7)])
        wait_for(3)
    finally:
        running.stop()
    assert [(r["step"], r["n_scores"]) for r in spark.read.parquet(str(tmp_path / "out")).collect()] == [(0, 2)]
    with pytest.raises(ValueError, match="every"):
        drift_stream(stream, str(tmp_path / "out"), str(tmp_path / "other"), forget_ms=1000)


def test_newest_scores_holds_few_and_equals_a_sort():
    rng = random.Random(9)
    for n in (1, 3, 6):
        known = [(i, rng.randrange(50), rng.random()) for i in range(n)]
        fresh = [(rng.randrange(40), rng.choice([None, *range(50)]), rng.random()) for _ in range(200)]
        best = {}
        for run, at, score in fresh:
            rank = (at is not None, at or 0, score)
            best[run] = max(best.get(run, rank), rank)
        rows = [(r, k[1] if k[0] else None, k[2]) for r, k in best.items()] + [s for s in known if s[0] not in best]
        want = sorted(rows, key=lambda s: (s[1] is not None, s[1] or 0, s[0]), reverse=True)[:n]
        assert newest_scores(known, iter(fresh), n) == want


def test_only_slim_rows_are_shuffled(spark, tmp_path):
    wide = spark.createDataFrame([("p", 1, START, 0.5)], SCHEMA).withColumn("notes", F.lit("x" * 100))
    wide.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(wide.schema).parquet(str(tmp_path / "in"))
    plan = drift_rows(stream)._jdf.queryExecution().analyzed().toString()
    assert "TransformWithState" in plan and "notes" not in plan[plan.index("TransformWithState"):].split("Project")[1].split("\n")[0]


def test_a_delivery_of_many_files_is_one_batch(spark, tmp_path, monkeypatch):
    from pyspark.sql import functions as F

    from tidewell.catalog import jobs

    orders = spark.range(0, 60, 1, 4).select(
        F.col("id").alias("o_orderkey"), (F.col("id") % 5).alias("o_custkey"),
        F.expr("timestamp_ntz'2024-01-01 00:00:00' + make_dt_interval(cast(id as int))").alias("o_orderdate"),
        (F.col("id") * 37.5).alias("o_totalprice"), F.element_at(F.array(F.lit("F"), F.lit("O"), F.lit("P")), (F.col("id") % 3 + 1).cast("int")).alias("o_orderstatus"),
        F.lit("1").alias("o_orderpriority"),
    )
    orders.write.parquet(f"{tmp_path}/orders.parquet")
    monkeypatch.setattr(jobs, "scratch", lambda _: f"{tmp_path}/base")
    assert jobs.streamed_drift(spark, str(tmp_path)).count() == 5
    assert len(list((tmp_path / "base" / "in").glob("*.parquet"))) > 3
    assert sorted(p.name for p in (tmp_path / "base" / "ckpt" / "commits").iterdir() if p.name.isdigit()) == ["0", "1", "2"]
