"""Packing into optimal length buckets.

Texts longer than the longest sequence are cut into pieces of that length, so that the
histogram of lengths has a fixed bound. A dynamic program over the whole histogram chooses
the bucket bounds that waste the fewest padding tokens; inside a bucket, pieces fill batches
up to the token budget.

Edge cases. Null or empty text: one piece of length 0 in the first bucket. Repeated rows are
packed as rows of their own. An empty table gives an empty result. Columns named like the
added ones are replaced.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewell.functions.ordered import BUCKET_ROWS, row_number
from tidewell.llm.textkit import n_words

MAX_TOKENS, BUCKETS, BATCH_TOKENS, SEED = 2048, 12, 32_768, 29


def best_bounds(counts: np.ndarray, buckets: int) -> list[int]:
    """Upper bounds of at most `buckets` length ranges with the least padding.

    `counts[n]` is the number of sequences of length n; a sequence is padded to the bound
    of its range. Bounds are lengths that occur; the last one is the greatest.
    """
    lengths = np.flatnonzero(counts)
    if not len(lengths):
        return []
    n = counts[lengths].astype(np.int64)
    rows = np.concatenate([[0], np.cumsum(n)])
    tokens = np.concatenate([[0], np.cumsum(n * lengths)])
    k = len(lengths)
    # cost[i, j]: padding of lengths i..j-1 in one bucket
    cost = (rows[None, 1:] - rows[:-1, None]) * lengths[None, :] - (tokens[None, 1:] - tokens[:-1, None])
    far = np.int64(1) << np.int64(61)
    cost = np.where(np.arange(k)[:, None] <= np.arange(k)[None, :], cost, far)
    best, came = cost[0].copy(), []
    for _ in range(1, min(buckets, k)):
        through = best[:-1, None] + cost[1:, :]
        at = np.argmin(through, axis=0)
        least = through[at, np.arange(k)]
        better = least < best
        came.append(np.where(better, at, -1))
        best = np.where(better, least, best)
    bounds, j = [int(lengths[-1])], k - 1
    for step in reversed(came):
        if step[j] >= 0:
            j = int(step[j])
            bounds.append(int(lengths[j]))
    return bounds[::-1]


def pack(
    docs: DataFrame, max_tokens: int = MAX_TOKENS, buckets: int = BUCKETS, batch_tokens: int = BATCH_TOKENS,
    tokens: Column | None = None, seed: int = SEED,
) -> DataFrame:
    """One row per piece: doc_id, piece, first_token, n_tokens, bucket_tokens, batch, slot, padding.

    Only the histogram, of `max_tokens` + 1 numbers at most, reaches the driver. Rows are
    numbered per bucket in ranges of a seeded hash, so no bucket is gathered in one task.
    """
    sized = docs.select("doc_id", (n_words(F.col("text").cast("string")) if tokens is None else tokens).alias("_all"))
    pieces = sized.select(
        "doc_id", "_all", F.explode(F.sequence(F.lit(0), F.greatest(F.ceil(F.col("_all") / max_tokens) - 1, F.lit(0)).cast("int"))).alias("piece")
    ).select(
        "doc_id", "piece", (F.col("piece").cast("long") * max_tokens).alias("first_token"),
        F.least(F.col("_all") - F.col("piece").cast("long") * max_tokens, F.lit(max_tokens)).cast("int").alias("n_tokens"),
    )
    counts = np.zeros(max_tokens + 1, np.int64)
    for row in pieces.groupBy("n_tokens").count().collect():
        counts[row["n_tokens"]] = row["count"]
    bounds = best_bounds(counts, buckets)
    held = {b: int(counts[(bounds[i - 1] + 1 if i else 0) : b + 1].sum()) for i, b in enumerate(bounds)}
    bound, parts = F.lit(None).cast("int"), F.lit(1)
    for b in reversed(bounds):
        bound = F.when(F.col("n_tokens") <= b, F.lit(b)).otherwise(bound)
        parts = F.when(F.col("n_tokens") <= b, F.lit(-(-held[b] // BUCKET_ROWS))).otherwise(parts)
    mark = F.xxhash64(F.lit(seed), F.col("doc_id"), F.col("piece"))
    numbered = row_number(
        pieces.withColumns({"bucket_tokens": bound, "_parts": parts, "_mark": mark}), ["bucket_tokens"], ["_mark", "doc_id", "piece"],
        F.floor((F.shiftright(F.col("_mark"), 32) + F.lit(1 << 31)) * F.col("_parts") / F.lit(1 << 32)), "_number",
    )
    room = F.greatest(F.floor(F.lit(batch_tokens) / F.greatest(F.col("bucket_tokens"), F.lit(1))), F.lit(1))
    return numbered.select(
        "doc_id", "piece", "first_token", "n_tokens", "bucket_tokens",
        F.floor((F.col("_number") - 1) / room).alias("batch"), ((F.col("_number") - 1) % room).cast("int").alias("slot"),
        (F.col("bucket_tokens") - F.col("n_tokens")).alias("padding"),
    )
