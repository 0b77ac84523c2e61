"""Semantic chunks of very long texts, spread over tasks.

Where a greedy chunk ends depends on where it began, so packing is a walk along the units of
a text. A place on the walk is a node (unit, kept): `kept` says that the unit closed the chunk
before and opens this one. Each node has one successor. Units lie in buckets of a fixed
number; a bucket turns the node a walk enters by into the node it leaves by, which is a small
table of numbers. These tables are composed by pointer doubling over buckets, so the node by
which the walk enters each bucket is known after a logarithmic number of rounds, most often
one or two, as walks from different nodes soon meet. Then all buckets are cut side by side.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidewell import constants as K
from tidewell.functions import ordered
from tidewell.functions.rows import explode_rows
from tidewell.functions.text import strip, word_count
from tidewell.operators.chunking import BLANK_LINE, semantic_chunks, sentences
from tidewell.session import materialise, release

#: Texts with more characters are cut as rows of units, others inside their row.
LONG_CHARS = 1 << 20
#: Units of one text that are cut in one task.
BUCKET_UNITS = 4096
#: Entry codes: nothing enters (the first unit opens a run), then 1 + 2 * offset + kept.
FRESH, END = 0, -1


def text_units(texts: DataFrame, target: int, sep: str, bucket: int) -> DataFrame:
    """Stored rows (_bid, i, run, sentence, n, text) of texts (_bid, content).

    A run is a stretch of ordinary paragraphs or the sentences of one paragraph of more than
    `target` words; runs are numbered, chunks never cross them.
    """
    raw = explode_rows(texts, ["_bid"], F.split("content", sep), "p", "pos")
    raw = raw.withColumn("_b", F.floor(F.col("pos") / bucket)).repartition("_bid", "_b")
    counted = raw.withColumn("p", strip(F.col("p"))).where("p <> ''").withColumn("n", word_count(F.col("p")))
    unit = lambda t, n: F.struct(t.alias("text"), n.alias("n"))
    long = F.col("n") > target
    parts = F.when(long, F.transform(sentences(F.col("p")), lambda s: unit(s, word_count(s)))).otherwise(
        F.array(unit(F.col("p"), F.col("n")))
    )
    pieces = materialise(counted.select("_bid", "_b", "pos", parts.alias("parts"), long.cast("int").alias("long")))
    totals = pieces.groupBy("_bid", "_b").agg(F.sum(F.size("parts")).alias("k"), F.sum("long").alias("l"))
    before = W.partitionBy("_bid").orderBy("_b").rowsBetween(W.unboundedPreceding, -1)
    ahead = totals.select("_bid", "_b", *[F.coalesce(F.sum(c).over(before), F.lit(0)).alias(f"_{c}") for c in "kl"])
    inside = W.partitionBy("_bid", "_b").orderBy("pos").rowsBetween(W.unboundedPreceding, 0)
    placed = pieces.withColumns({"k": F.sum(F.size("parts")).over(inside), "l": F.sum("long").over(inside)}).join(ahead, ["_bid", "_b"])
    first = F.col("k") + F.col("_k") - F.size("parts")
    run = 2 * (F.col("l") + F.col("_l")) - F.col("long")
    rows = explode_rows(
        placed, ["_bid", first.alias("_first"), run.alias("run"), (F.col("long") == 1).alias("sentence")], F.col("parts"), "u", "_at"
    )
    units = materialise(rows.select("_bid", (F.col("_first") + F.col("_at")).alias("i"), "run", "sentence", "u.n", "u.text"))
    release(pieces)
    return units


def _in_buckets(units: DataFrame, bucket: int, halo: int) -> DataFrame:
    """Units with their bucket _b; the first `halo` units of a bucket also go to the one before."""
    b, at = F.floor(F.col("i") / bucket), F.col("i") % bucket
    places = F.when((at < halo) & (b > 0), F.array(b, b - 1)).otherwise(F.array(b))
    return units.withColumn("_b", F.explode(places))


def _sorted(part: pa.Table, bucket: int) -> tuple[pa.Table, list[np.ndarray], int]:
    """Units of a bucket and its halo in order, their n, run and sentence, and how many are its own."""
    part = part.sort_by("i")
    own = int((part["i"].to_numpy() // bucket == part["_b"][0].as_py()).sum())
    return part, [part[c].to_numpy() for c in ("n", "run", "sentence")], own


def successors(n: np.ndarray, run: np.ndarray, sentence: np.ndarray, own: int, target: int, overlap: int) -> tuple[np.ndarray, np.ndarray]:
    """Chunk end and next node of each node 2 * unit + kept of a bucket; END where a run is used up."""
    m = len(n)
    ends = np.cumsum(n)
    lo = np.arange(own)
    borders = np.flatnonzero(np.append(run[1:] != run[:-1], True)) + 1
    run_end = borders[np.searchsorted(borders, lo, "right")]
    fits = np.searchsorted(ends, ends[:own] - n[:own] + target, "right")
    hi = np.minimum(run_end[:, None], np.maximum(fits[:, None], lo[:, None] + [1, 2]))
    keep = np.where(sentence[:own, None], hi - lo[:, None] > 1, n[hi - 1] <= overlap)
    after = np.where(hi == run_end[:, None], END, np.where(keep, 2 * (hi - 1) + 1, 2 * hi))
    assert m >= own
    return hi.ravel(), after.ravel()


def _exits(after: np.ndarray, own: int) -> np.ndarray:
    """Where the walk from each node leaves the bucket: a node of the halo, or END."""
    stop = 2 * own
    jump = np.where(after == END, stop, after)
    out = np.append(after, END)
    while (jump < stop).any():
        moving = jump < stop
        out[:-1][moving] = out[jump[moving]]
        jump = np.where(moving, np.append(jump, stop)[np.minimum(jump, stop)], jump)
    return out[:-1]


def bucket_table(n: np.ndarray, run: np.ndarray, sentence: np.ndarray, own: int, halo: int, target: int, overlap: int) -> np.ndarray:
    """Exit code for each entry code; one number if they are all equal.

    Codes: FRESH, 1 + 2 * offset + kept for a node among the first `halo` units, and
    1 + 2 * halo if the first run of the bucket is covered by the chunk before.
    """
    covered = 1 + 2 * halo
    if own == len(n) or run[own - 1] != run[own]:
        return np.array([FRESH])
    _, after = successors(n, run, sentence, own, target, overlap)
    leave = _exits(after, own)
    codes = np.where(leave == END, covered, 1 + leave - 2 * own)
    start = int(np.flatnonzero(run[:own] == run[own - 1])[0])
    table = np.full(covered + 1, codes[2 * start])
    if start == 0:
        table[1:covered] = np.append(codes, np.full(2 * halo, codes[0]))[: 2 * halo]
    return table[:1] if (table == table[0]).all() else table


def entry_nodes(units: DataFrame, target: int, overlap: int, bucket: int, halo: int) -> DataFrame:
    """Stored rows (_bid, _b, code): how the walk enters each bucket after the first."""

    def build(part: pa.Table) -> pa.Table:
        part, facts, own = _sorted(part, bucket)
        bid, b = part["_bid"][0].as_py(), part["_b"][0].as_py()
        table = bucket_table(*facts, own, halo, target, overlap)
        # Nothing enters the first bucket, so its table is one number.
        table = table[:1] if b == 0 else table
        return pa.table([[bid], [b], [b], [table.tolist()]], schema=built)

    built = pa.schema({"_bid": pa.int64(), "_b": pa.int64(), "_lo": pa.int64(), "f": pa.list_(pa.int32())})
    slim = _in_buckets(units.select("_bid", "i", "run", "sentence", "n"), bucket, halo)
    tables = materialise(slim.groupBy("_bid", "_b").applyInArrow(build, "_bid long, _b long, _lo long, f array<int>"))
    while True:
        open_ = tables.where(F.size("f") > 1)
        if open_.isEmpty():
            break
        before = tables.select("_bid", (F.col("_b") + 1).alias("_lo"), F.col("_lo").alias("_from"), F.col("f").alias("g"))
        composed = F.transform("g", lambda x: F.get(F.col("f"), x))
        flat = F.when(F.array_min("h") == F.array_max("h"), F.slice("h", 1, 1)).otherwise(F.col("h"))
        joined = open_.join(before, ["_bid", "_lo"]).withColumn("h", composed)
        longer = joined.select("_bid", "_b", F.col("_from").alias("_lo"), flat.alias("f"))
        grown = materialise(tables.where(F.size("f") == 1).unionByName(longer))
        release(tables)
        tables = grown
    entries = materialise(tables.select("_bid", (F.col("_b") + 1).alias("_b"), F.get("f", F.lit(0)).alias("code")))
    release(tables)
    return entries


def cut_units(units: DataFrame, entries: DataFrame, target: int, overlap: int, bucket: int, halo: int) -> DataFrame:
    """Rows (_bid, _node, content, token_count) of all chunks; _node puts those of a text in order."""
    covered = 1 + 2 * halo

    made = pa.schema({"_bid": pa.int64(), "_node": pa.int64(), "content": pa.string(), "token_count": pa.int32()})

    def cut(part: pa.Table, entry: pa.Table) -> pa.Table:
        if not len(part):
            return made.empty_table()
        part, (n, run, sentence), own = _sorted(part, bucket)
        text, bid, first = part["text"].to_pylist(), part["_bid"][0].as_py(), part["i"][0].as_py()
        hi, after = successors(n, run, sentence, own, target, overlap)
        starts = [2 * int(i) for i in np.flatnonzero(run[1:own] != run[: own - 1]) + 1]
        code = entry["code"][0].as_py() if len(entry) else FRESH
        if code != covered:
            starts.insert(0, 0 if code == FRESH else code - 1)
        nodes, contents, counts = [], [], []
        for node in starts:
            while END < node < 2 * own:
                lo, end = node // 2, int(hi[node])
                contents.append(". ".join(text[lo:end]) + "." if sentence[lo] else BLANK_LINE.join(text[lo:end]))
                nodes.append(2 * first + node)
                counts.append(int(n[lo:end].sum()))
                node = int(after[node])
        return pa.table([[bid] * len(nodes), nodes, contents, counts], schema=made)

    left = _in_buckets(units, bucket, halo).groupBy("_bid", "_b")
    return left.cogroup(entries.groupBy("_bid", "_b")).applyInArrow(cut, "_bid long, _node long, content string, token_count int")


def semantic_chunks_spread(
    blocks: DataFrame,
    target: int = K.TARGET_WORDS,
    overlap: int = K.OVERLAP_WORDS,
    sep: str = BLANK_LINE,
    long_chars: int = LONG_CHARS,
    bucket_units: int = BUCKET_UNITS,
) -> DataFrame:
    """The rows of `semantic_chunks`, with texts of over `long_chars` characters cut by many tasks.

    Expects what `semantic_chunks` expects. Null contents give no chunks, tables stay whole
    at any length, and a unit has at least one word. With block_no, numbers run on through a
    document's blocks, which must be unique.
    """
    halo = max(target, 2)
    bucket = max(bucket_units, halo)
    long = F.coalesce((F.col("type") != "table") & (F.length("content") > long_chars), F.lit(False))
    numbered = "block_no" in blocks.columns
    kept = [c for c in blocks.columns if c != "content"]
    few = blocks.where(~long).withColumnRenamed("block_no", "_block_no")
    few = semantic_chunks(few, target, overlap, sep).withColumnRenamed("_block_no", "block_no")

    texts = materialise(blocks.where(long).withColumn("_bid", F.monotonically_increasing_id()))
    units = text_units(texts.select("_bid", "content"), target, sep, bucket)
    entries = entry_nodes(units, target, overlap, bucket, halo)
    cuts = materialise(cut_units(units, entries, target, overlap, bucket, halo))
    release(units, entries)
    placed = ordered.row_number(cuts, ["_bid"], ["_node"], F.floor(F.col("_node") / (2 * bucket)), "_rn")
    many = texts.select("_bid", *kept).join(placed, "_bid").select(
        *kept, (F.col("_rn") - 1).cast("int").alias("chunk_index"), "content", "token_count", F.lit("semantic").alias("strategy")
    )
    chunks = few.select(many.columns).unionByName(many)
    return _number(chunks) if numbered else chunks


def _number(chunks: DataFrame) -> DataFrame:
    """chunk_index counted on through the blocks of a document."""
    chunks = materialise(chunks)
    keys = ["document_id", "block_no"]
    sizes = chunks.groupBy(*keys).agg(F.count("*").alias("_n"))
    bucket: Column = F.floor(F.col("block_no") / ordered.BUCKET_ROWS)
    firsts = ordered.running_sum(sizes, ["document_id"], ["block_no"], F.col("_n"), bucket, "_upto")
    joined = ordered.join_null_safe(chunks, firsts, keys)
    index = (F.col("chunk_index") + F.col("_upto") - F.col("_n")).cast("int")
    return joined.withColumn("chunk_index", index).select(chunks.columns)
