"""Quality by the votes of the nearest labelled documents in a latent-semantic space.

A text becomes weights of terms: hashed runs of three bytes, case kept, and marks of its
form (how long it is, how its words, lines and signs are spread, each cut into steps).
Counts are damped and weighed by how rare a term is over all documents. The latent space is
spanned by the leading directions of a bounded sample of labelled documents; their vectors,
a matrix of at most `SAMPLE_ROWS` x `LATENT` floats, are broadcast. Every document is then
compared with every one of them, in blocks of exact cosine products, and the nearest vote
with their similarity.

Document frequencies come from every document. Only the labelled sample is bounded.

Edge cases. Null and empty texts have marks of form and are scored like others. Null labels,
null ids and labels without a document are ignored; of several labels of an id the least
counts, of several texts the one with the least hash. Without labelled documents every score
is 0.5; a document unlike all labelled ones gets their share of good ones. Texts of any
length are read whole, a slice at a time. Other columns pass through; one named like the
result is replaced.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from tidewell.llm.quality import _measure as measure
from tidewell.llm.textkit import blocks, flat

#: Labelled documents the space and the voters are taken from, at most.
SAMPLE_ROWS = 6_000
#: Buckets of byte runs; marks of form follow them.
GRAM_TERMS = 1 << 11
LATENT, VOTERS, SHARPNESS = 64, 25, 8
#: Weight of the marks of form beside the byte runs: the best of 0.5, 1, 1.5 and 2 when two
#: halves of the learned rows judge each other (held-out rows had shown 0.5 to be too low).
FORM_WEIGHT = 1.0
SLICE = 1 << 22

_STEPS = 16
_FORMS = ["length", "word_length", "symbols", "upper", "punct", "digits", "repeats", "dup_lines", "line_length"]
TERMS = GRAM_TERMS + _STEPS * len(_FORMS)
_MULTIPLIER = np.uint32(2654435761)


def _gram_counts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """(documents, GRAM_TERMS) counts of hashed byte runs; no run crosses documents."""
    n = len(offsets) - 1
    counts = np.zeros(n * GRAM_TERMS, np.int64)
    for low in range(0, max(len(data) - 2, 0), SLICE):
        part = data[low : low + SLICE + 2].astype(np.uint32)
        runs = part[:-2] | part[1:-1] << np.uint32(8) | part[2:] << np.uint32(16)
        bucket = (runs * _MULTIPLIER >> np.uint32(32 - GRAM_TERMS.bit_length() + 1)).astype(np.int64)
        at = np.arange(low, low + len(runs))
        doc = np.searchsorted(offsets, at, "right") - 1
        inside = at + 3 <= offsets[doc + 1]
        first, last = int(doc[0]), int(doc[-1]) + 1
        found = np.bincount((doc[inside] - first) * GRAM_TERMS + bucket[inside], minlength=(last - first) * GRAM_TERMS)
        counts[first * GRAM_TERMS : last * GRAM_TERMS] += found
    return counts.reshape(n, GRAM_TERMS)


def _forms(text: pa.Array) -> np.ndarray:
    """(documents, marks): one step set per statistic, its neighbours half."""
    m = {name: np.asarray(values, float) for name, values in measure(text).items()}
    share = lambda a, b: np.divide(m[a], m[b], out=np.zeros_like(m[a]), where=m[b] > 0)
    root = lambda x: np.sqrt(np.clip(x, 0, 1)) * (_STEPS - 1)
    level = {
        "length": np.log2(m["n_words"] + 1) / 1.5,
        "word_length": share("word_chars", "n_words"),
        "symbols": root(share("n_symbols", "word_chars")),
        "upper": root(share("n_upper", "word_chars")),
        "punct": root(share("n_punct", "word_chars")),
        "digits": root(share("n_digits", "word_chars")),
        "repeats": root(share("n_repeat_words", "n_words")),
        "dup_lines": root(share("n_dup_lines", "n_lines")),
        "line_length": np.log2(share("n_words", "n_lines") + 1) * 2,
    }
    out = np.zeros((len(text), len(_FORMS), _STEPS), np.float32)
    rows = np.arange(len(text))
    for j, name in enumerate(_FORMS):
        step = np.clip(level[name], 0, _STEPS - 1).astype(int)
        out[rows, j, step] = 1.0
        out[rows, j, np.maximum(step - 1, 0)] += 0.5
        out[rows, j, np.minimum(step + 1, _STEPS - 1)] += 0.5
    return out.reshape(len(text), -1)


def _terms(text: pa.Array) -> np.ndarray:
    """(documents, TERMS) damped counts, before rarity weighs them."""
    data, offsets = flat(text)
    grams = np.log1p(_gram_counts(data, offsets)).astype(np.float32)
    return np.hstack([grams, _forms(text)])


def _weighted(terms: np.ndarray, rarity: np.ndarray) -> np.ndarray:
    """Rows of unit length: byte runs and marks of form each scaled on their own."""

    def unit(x: np.ndarray) -> np.ndarray:
        length = np.sqrt((x * x).sum(axis=1, keepdims=True))
        return x / np.where(length > 0, length, 1)

    x = terms * rarity
    return unit(np.hstack([unit(x[:, :GRAM_TERMS]), FORM_WEIGHT * unit(x[:, GRAM_TERMS:])]))


@dataclass(frozen=True)
class Model:
    rarity: np.ndarray  # per term
    space: np.ndarray  # TERMS x latent
    voters: np.ndarray  # unit rows in the latent space
    votes: np.ndarray  # 0 or 1 per voter


def held_out(doc_id: Column) -> Column:
    """Ids whose labels are never learned from."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def rarity(docs: DataFrame) -> np.ndarray:
    """Weight of each term by the number of all documents that hold it."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(TERMS + 1, np.int64)
        for block in blocks(batches, "text"):
            total[:TERMS] += (_terms(block.column(0)) > 0).sum(axis=0)
            total[TERMS] += block.num_rows
        yield pa.record_batch([pa.array(np.arange(TERMS + 1)), pa.array(total)], names=["term", "docs"])

    held = docs.select(F.col("text").cast("string").alias("text")).mapInArrow(count, "term long, docs long")
    # One row per term, whatever the number of documents.
    rows = held.groupBy("term").agg(F.sum("docs").alias("docs")).collect()
    total = np.zeros(TERMS + 1)
    for r in rows:
        total[r["term"]] = r["docs"]
    return np.log1p((total[TERMS] + 1) / (total[:TERMS] + 1)).astype(np.float32)


def _sample(docs: DataFrame, labels: DataFrame, sample_rows: int) -> tuple[np.ndarray, np.ndarray]:
    """Terms and label of at most `sample_rows` labelled documents, one row an id."""
    chosen = (
        labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
        .groupBy("doc_id")
        .agg(F.min("quality").alias("_label"))
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(sample_rows)
    )

    def sparse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches, "text"):
            at, values = [], []
            for row in _terms(block.column("text")):
                held = np.flatnonzero(row)
                at.append(held.astype(np.uint16).tobytes())
                values.append(row[held].astype(np.float16).tobytes())
            columns = [block.column("doc_id"), block.column("_label"), block.column("_hash"), pa.array(at, pa.binary()), pa.array(values, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "_label", "_hash", "at", "value"])

    texts = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    known = texts.join(F.broadcast(chosen), "doc_id").withColumn("_hash", F.xxhash64("text"))
    known = known.select(F.col("doc_id").cast("string").alias("doc_id"), F.col("_label").cast("long").alias("_label"), "_hash", "text")
    found = known.mapInArrow(sparse, "doc_id string, _label long, _hash long, at binary, value binary")
    one = found.groupBy("doc_id").agg(F.min(F.struct("_hash", "_label", "at", "value")).alias("s")).select("doc_id", "s.*")
    rows = sorted(one.collect(), key=lambda r: r["doc_id"])
    x = np.zeros((len(rows), TERMS), np.float32)
    for i, r in enumerate(rows):
        x[i, np.frombuffer(r["at"], np.uint16)] = np.frombuffer(r["value"], np.float16)
    return x, np.array([r["_label"] >= 1 for r in rows], np.float32)


def _latent(x: np.ndarray, space: np.ndarray) -> np.ndarray:
    y = x @ space
    length = np.sqrt((y * y).sum(axis=1, keepdims=True))
    return y / np.where(length > 0, length, 1)


def fit(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> Model:
    """Space and voters from at most `sample_rows` labelled documents, rarity from all."""
    weight = rarity(docs)
    terms, votes = _sample(docs, labels, sample_rows)
    if len(votes) == 0:
        return Model(weight, np.zeros((TERMS, 1), np.float32), np.zeros((0, 1), np.float32), votes)
    x = _weighted(terms, weight)
    values, vectors = np.linalg.eigh((x.T @ x).astype(np.float64))
    space = np.ascontiguousarray(vectors[:, ::-1][:, : min(LATENT, len(x))].astype(np.float32))
    return Model(weight, space, _latent(x, space), votes)


def vote(model: Model, vectors: np.ndarray, voters: int = VOTERS) -> np.ndarray:
    """Share of good among the nearest labelled vectors, weighed by similarity."""
    if len(model.votes) == 0:
        return np.full(len(vectors), 0.5)
    near = np.clip(vectors @ model.voters.T, 0, 1)
    k = min(voters, near.shape[1])
    at = np.argpartition(-near, k - 1, axis=1)[:, :k]
    weight = np.take_along_axis(near, at, axis=1).astype(np.float64) ** SHARPNESS
    total = weight.sum(axis=1)
    share = (weight * model.votes[at]).sum(axis=1) / np.where(total > 0, total, 1)
    return np.clip(np.where(total > 0, share, model.votes.mean()), 0, 1)


def score(docs: DataFrame, model: Model, out: str = "score") -> DataFrame:
    """Add `out`, the score of each whole text, 0 to 1."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf(DoubleType())
    def scored(text: pa.Array) -> pa.Array:
        known, parts = shared.value, []
        for block in blocks([pa.record_batch([text], names=["text"])], "text"):
            vectors = _latent(_weighted(_terms(block.column(0)), known.rarity), known.space)
            parts.append(vote(known, vectors))
        return pa.array(np.concatenate(parts) if parts else [], pa.float64())

    # A filter above must not make Spark score twice.
    return docs.withColumn(out, scored.asNondeterministic()(F.col("text").cast("string")))
