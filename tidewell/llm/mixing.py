"""Mixing sources to target weights by fitting subset sums.

Sizes are counted per source and exact length. A source's target is a whole number of
passes over all its documents plus a remainder; the remainder is spread over the lengths in
proportion, and what is then left of the budget is met by a bounded-knapsack dynamic program
over the lengths that still have documents. Which documents of a length are taken is decided
by a seeded hash.

Edge cases. Null text: size 0. A null source is a source of its own, last in order. Sources
without words get the target 0. Documents of size 0 are taken as often as the whole passes.
Repeated rows are separate documents; rows of one id are told apart by their text. An empty table gives an empty result. Columns named
like the added ones (`size`, `copies`, `target`, `source_size`) are replaced.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewell.functions.ordered import BUCKET_ROWS, join_null_safe, row_number
from tidewell.llm.textkit import n_words

WEIGHTS = (5.0, 2.0, 1.0)
#: Words the dynamic program may have to fit; a larger rest is spread over the lengths first.
DP_WORDS = 1 << 16


def share_out(sizes: list[int], weights: list[float], total: float, most: float = 2.0) -> list[float]:
    """Split `total` by weight; no part exceeds `most` times its size, the excess is reshared."""
    out, open_, left = [0.0] * len(sizes), list(range(len(sizes))), total
    while open_ and left > 0:
        rate = left / sum(weights[i] for i in open_)
        full = [i for i in open_ if rate * weights[i] > most * sizes[i]]
        if not full:
            for i in open_:
                out[i] = rate * weights[i]
            break
        for i in full:
            out[i] = most * sizes[i]
            left -= out[i]
        open_ = [i for i in open_ if i not in set(full)]
    return out


def fit_counts(lengths: np.ndarray, counts: np.ndarray, budget: int, seed: int) -> np.ndarray:
    """How many documents of each length to take so that their words come nearest `budget`."""
    total = int((lengths * counts).sum())
    taken = np.zeros(len(lengths), np.int64)
    if budget <= 0 or total == 0:
        return taken
    if budget >= total:
        return np.where(lengths > 0, counts, 0)
    taken = np.where(lengths > 0, np.floor(counts * (budget / total)), 0).astype(np.int64)
    left = budget - int((taken * lengths).sum())
    order = np.random.default_rng(seed).permutation(np.flatnonzero(lengths > 0))

    # One more document of each length in seeded order, as long as more than DP_WORDS are left.
    while left > DP_WORDS:
        free = order[(taken[order] < counts[order]) & (lengths[order] <= left)]
        sums = np.cumsum(lengths[free])
        k = int(np.searchsorted(sums, left - DP_WORDS, "left")) + 1
        k = min(k, int(np.searchsorted(sums, left, "right")), len(free))
        if k <= 0:
            break
        taken[free[:k]] += 1
        left -= int(sums[k - 1])

    # Bounded knapsack: each length in lots of 1, 2, 4, ... documents; `by` holds the lot that
    # first made a sum reachable, so that walking back uses every lot once.
    cap = left + min(left, int(lengths.max()))
    by = np.full(cap + 1, -1, np.int64)
    by[0] = 0
    lots: list[tuple[int, int]] = [(0, 0)]
    for i in order:
        free, lot = int(counts[i] - taken[i]), 1
        while free > 0 and by[left] < 0:
            lot = min(lot, free)
            weight = lot * int(lengths[i])
            if weight > cap:
                break
            new = np.flatnonzero((by[: cap + 1 - weight] >= 0) & (by[weight:] < 0)) + weight
            by[new] = len(lots)
            lots.append((int(i), lot))
            free, lot = free - lot, lot * 2
        if by[left] >= 0:
            break
    reached = np.flatnonzero(by >= 0)
    at = int(reached[np.argmin(np.abs(reached - left))])
    while at:
        i, lot = lots[by[at]]
        taken[i] += lot
        at -= lot * int(lengths[i])
    return taken


def mix(docs: DataFrame, epochs: float = 1.5, weights: tuple[float, ...] = WEIGHTS, most: float = 2.0, seed: int = 13, size=None) -> DataFrame:
    """Add size, source_size, target and copies (0, 1, 2) to every row.

    Only one row per source is brought to the driver, to share the budget out; the counts
    by length stay in Spark, and each source's dynamic program sees its distinct lengths only.
    """
    sized = docs.withColumn("size", n_words(F.col("text").cast("string")) if size is None else size)
    sized = sized.drop("copies", "target", "source_size")
    told = ["doc_id", "text"] if "text" in docs.columns else ["doc_id"]
    sized = sized.withColumn("_mark", F.xxhash64(F.lit(seed), *told))
    histogram = sized.groupBy("source", "size").agg(F.count("*").alias("_n"))
    totals = histogram.groupBy("source").agg(F.sum(F.col("size") * F.col("_n")).alias("s")).collect()
    totals = sorted(totals, key=lambda r: (r["source"] is None, r["source"] or ""))
    sizes = [int(r["s"]) for r in totals]
    targets = share_out(sizes, [weights[i % len(weights)] for i in range(len(sizes))], epochs * sum(sizes), most)
    spark = docs.sparkSession
    plan = spark.createDataFrame(
        [(r["source"], s, float(t)) for r, s, t in zip(totals, sizes, targets, strict=True)],
        "source string, source_size bigint, target double",
    )

    def fit(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("size")
        whole, target = int(part["source_size"].iloc[0]), float(part["target"].iloc[0])
        passes = int(target // whole) if whole else 0
        lengths, counts = part["size"].to_numpy(np.int64), part["_n"].to_numpy(np.int64)
        extra = fit_counts(lengths, counts, round(target - passes * whole), seed)
        return part.assign(_passes=passes, _extra=extra)[["source", "size", "source_size", "target", "_n", "_passes", "_extra"]]

    fitted = (
        join_null_safe(histogram, F.broadcast(plan), ["source"])
        .groupBy("source")
        .applyInPandas(fit, "source string, size bigint, source_size bigint, target double, _n bigint, _passes int, _extra bigint")
    )
    planned = join_null_safe(sized, fitted, ["source", "size"])

    # Ranks by seeded hash inside a length; a frequent length is cut into ranges of the hash.
    parts = F.ceil(F.col("_n") / BUCKET_ROWS)
    ranked = row_number(
        planned, ["source", "size"], ["_mark", "doc_id"],
        F.floor((F.shiftright(F.col("_mark"), 32) + F.lit(1 << 31)) * parts / F.lit(1 << 32)), "_rank",
    )
    copies = F.col("_passes") + F.when(F.col("_rank") <= F.col("_extra"), 1).otherwise(0)
    return ranked.withColumn("copies", copies.cast("int")).drop("_n", "_passes", "_extra", "_mark", "_rank")


def repeat_rows(mixed: DataFrame, columns: list[str]) -> DataFrame:
    """The mix itself: each row as often as its copies say."""
    return mixed.where("copies > 0").withColumn("_i", F.explode(F.sequence(F.lit(1), F.col("copies")))).select(*columns)
