"""Term postings and keyword ranking."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewell import constants as K
from tidewell.functions import ordered
from tidewell.functions.rows import explode_rows
from tidewell.functions.stem import stem_words
from tidewell.functions.text import terms
from tidewell.session import materialise

K1 = 1.2
B = 0.75

#: What a block of postings keeps of its entries to bound their scores.
BOUNDS = ["max_tf", "min_terms"]
#: Blocks of the lead term that every query reads.
FIRST_BLOCKS = 4
#: Postings of one block, where a plain table of postings is cut into blocks.
BLOCK_ROWS = 64
#: Marks of asked terms that postings are held against before they are shuffled, a power of two.
MARKS = 1 << 25
#: Frequent words whose stems are kept at hand, at most.
STEM_WORDS = 262_144

# Limits and weights of the text-search rank
PG_MAX_POSITION = 16383
PG_MAX_POSITIONS = 256
TERM_WEIGHT = 0.1
SQUARES_LIMIT = 1.64493406685
FAR = 100


def _lexeme_rows(
    df: DataFrame, keep: list, text: Column, stop_words: list[str], stem: bool
) -> DataFrame:
    """keep..., pos, term, n_terms: terms without stop words, stemmed on request.

    Positions count every term of the text, stop words too, from 1.
    """
    listed = df.select(*keep, terms(text).alias("_terms"))
    rows = explode_rows(listed, [*keep, F.size("_terms").alias("n_terms")], F.col("_terms"), "term")
    if stop_words:
        rows = rows.where(~F.col("term").isin(*stop_words))
    if stem:
        rows = _stemmed(rows)
    return rows.withColumn("pos", F.col("pos") + 1)


def _stemmed(rows: DataFrame) -> DataFrame:
    """`term` replaced by its stem; rows are not shuffled for it.

    A stem costs far more than a lookup. The `STEM_WORDS` most frequent words, less those
    that tie below, are stemmed once and broadcast; others are stemmed as met.
    """
    counts = materialise(rows.groupBy("term").agg(F.count("*").alias("_n")))
    total = counts.agg(F.sum("_n")).first()[0] or 0
    # At most `STEM_WORDS` words have such a share of all rows, so only smaller counts are looked at.
    sure = total // max(STEM_WORDS, 1) + 1
    sizes = counts.groupBy(F.least("_n", F.lit(sure)).alias("n")).agg(F.count("*").alias("words"))
    least, room = sure, STEM_WORDS
    for n, words in sorted(sizes.collect(), reverse=True):
        room -= words
        if room < 0:
            break
        least = n
    often = counts.where(F.col("_n") >= least).select("term")
    stems = materialise(stem_words(often, "term", "_often"))
    met = rows.join(F.broadcast(stems), "term", "left")
    met = met.withColumn("_rare", F.when(F.col("_often").isNull(), F.col("term")))
    done = stem_words(met, "_rare", "_stem").withColumn("term", F.coalesce("_often", "_stem"))
    return done.drop("_often", "_rare", "_stem")


def build_postings(
    chunks: DataFrame,
    text: str = "content",
    stop_words: list[str] = K.STOP_WORDS,
    keep: list[str] = (),
    stem: bool = False,
    positions: bool = False,
    pg_limits: bool = False,
) -> DataFrame:
    """chunk_id, keep..., term, tf, n_terms[, positions].

    Counts are combined before the shuffle. Positions are needed by the `ts_rank` scorer.
    With `pg_limits` they go up to 16,383 and number at most 256 per term, as in the text
    index whose rank they reproduce; tf counts every occurrence either way. Without stems they
    are gathered text by text, and only chunks that come more than once are put together.
    """
    if positions and not stem:
        return _text_postings(chunks, ["chunk_id", *keep], F.col(text), stop_words, pg_limits)
    rows = _lexeme_rows(chunks, ["chunk_id", *keep], F.col(text), stop_words, stem)
    found = [F.count("*").cast("int").alias("tf"), F.first("n_terms").alias("n_terms")]
    if positions:
        at = F.col("pos")
        if pg_limits:
            at = F.least(at, F.lit(PG_MAX_POSITION))
        listed = F.array_distinct(F.array_sort(F.collect_list(at)))
        found.append((F.slice(listed, 1, PG_MAX_POSITIONS) if pg_limits else listed).alias("positions"))
    return rows.groupBy("chunk_id", *keep, "term").agg(*found)


def _text_postings(df: DataFrame, keys: list[str], text: Column, stop_words: list[str], pg_limits: bool) -> DataFrame:
    """Postings with positions, from the terms of each text at once instead of a row per term.

    The lists of positions of a partition are too many for a hash table, and sorting all its
    terms with their keys costs far more than the order of a batch of texts.
    """
    schema = T.StructType([
        *[T.StructField(c, df.schema[c].dataType) for c in keys],
        T.StructField("term", T.StringType()), T.StructField("tf", T.IntegerType()),
        T.StructField("n_terms", T.IntegerType()), T.StructField("positions", T.ArrayType(T.IntegerType(), False)),
    ])
    listed = df.select(*keys, terms(text).alias("_terms"))
    stops, last, most = list(stop_words), PG_MAX_POSITION if pg_limits else None, PG_MAX_POSITIONS if pg_limits else None
    built = listed.mapInArrow(lambda batches: _gather_positions(batches, keys, stops, last, most), schema)
    if df.groupBy(*keys).count().where("count > 1").isEmpty():
        return built
    every = F.array_distinct(F.array_sort(F.flatten(F.collect_list("positions"))))
    whole = F.slice(every, 1, most) if pg_limits else every
    return built.groupBy(*keys, "term").agg(
        F.sum("tf").cast("int").alias("tf"), F.first("n_terms").alias("n_terms"), whole.alias("positions")
    )


def _gather_positions(
    batches: Iterator[pa.RecordBatch], keys: list[str], stops: list[str], last: int | None, most: int | None
) -> Iterator[pa.RecordBatch]:
    """A row per text and term; positions up to `last`, the first `most` of each term."""
    for batch in batches:
        listed = batch.column("_terms")
        size = pc.fill_null(pc.list_value_length(listed), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        coded = listed.flatten().dictionary_encode()
        words = coded.dictionary
        if len(words) == 0:
            continue
        code = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        row = np.repeat(np.arange(len(size)), size)
        at = np.arange(1, len(code) + 1) - np.repeat(np.cumsum(size) - size, size)
        wanted = ~pc.is_in(words, value_set=pa.array(stops, words.type)).to_numpy(zero_copy_only=False)[code]
        code, row, at = code[wanted], row[wanted], at[wanted]
        if len(code) == 0:
            continue
        key = row * len(words) + code
        order = np.argsort(key, kind="stable")
        key, row, code, at = key[order], row[order], code[order], at[order]
        first = np.append(True, key[1:] != key[:-1])
        starts = np.flatnonzero(first)
        tf = np.diff(np.append(starts, len(key)))
        if last is not None:
            at = np.minimum(at, last)
            kept = first | np.append(True, at[1:] != at[:-1])
            kept &= np.arange(len(at)) - np.repeat(starts, tf) < most
            at, ends = at[kept], np.cumsum(kept)[starts + tf - 1]
        else:
            ends = starts + tf
        offsets = pa.array(np.append(0, ends).astype(np.int32))
        texts = pa.array(row[starts])
        yield pa.RecordBatch.from_arrays(
            [
                *[batch.column(c).take(texts) for c in keys], words.take(pa.array(code[starts])),
                pa.array(tf.astype(np.int32)), pa.array(size[row[starts]].astype(np.int32)),
                pa.ListArray.from_arrays(offsets, pa.array(at.astype(np.int32))),
            ],
            [*keys, "term", "tf", "n_terms", "positions"],
        )


def query_terms(
    queries: DataFrame, stop_words: list[str] = K.STOP_WORDS, stem: bool = False
) -> DataFrame:
    """query_id, pipeline_id, term, n_q: distinct terms; none for a stop-word-only query."""
    rows = _lexeme_rows(queries, ["query_id", "pipeline_id"], F.col("q"), stop_words, stem)
    distinct = rows.groupBy("query_id", "pipeline_id").agg(F.collect_set("term").alias("_t"))
    keep = ["query_id", "pipeline_id", F.size("_t").alias("n_q")]
    return explode_rows(distinct, keep, F.col("_t"), "term").drop("pos")


def keyword_topk(
    queries: DataFrame,
    postings: DataFrame,
    k: int,
    scorer: str = "bm25",
    stop_words: list[str] = K.STOP_WORDS,
    corpus: DataFrame | None = None,
    stem: bool = False,
    allowed: DataFrame | None = None,
) -> DataFrame:
    """query_id, chunk_id, kw_score, rnk: the k best chunks holding all terms of a query.

    `scorer` is bm25, tf, or ts_rank, which ranks as the text search of PostgreSQL does
    and needs postings with positions. `stem` must match how the postings were built.

    postings: chunk_id, pipeline_id, term, tf, n_terms, best read from a written table.
    They are read once: the rows of query terms are written out and all else runs on
    them. A TermIndex reads the blocks of these terms only, brings its own corpus
    statistics. Queries of a pipeline with the same terms are ranked once. Candidates come from
    the rarest term of a set only, cut to the chunk_ids of `allowed` where given, and
    the other terms are looked up by (chunk, term), so a term found in most chunks costs
    nothing extra. A set of one term is scored without any lookup. Of a longer rarest term's
    list only blocks that can reach the k-th score are read, except for ts_rank. A set with a
    term the corpus lacks drops out before any lookup. `corpus`
    (n_chunks, avg_terms per pipeline_id) is a second read of the postings when not given.
    """
    terms_of = query_terms(queries, stop_words, stem)
    sets = terms_of.groupBy("query_id", "pipeline_id").agg(F.array_sort(F.collect_list("term")).alias("_t"))
    sets = materialise(sets.withColumn("_set", F.array_join("_t", " ")))
    # From here on a query is a distinct set of terms of a pipeline.
    distinct = sets.select(F.struct("pipeline_id", "_set").alias("query_id"), "pipeline_id", "_t").distinct()
    qt = distinct.select("query_id", "pipeline_id", F.size("_t").cast("long").alias("n_q"), F.explode("_t").alias("term"))
    vocabulary = qt.select("pipeline_id", "term").distinct()
    blocks = None
    if isinstance(postings, DataFrame):
        hits = materialise(of_terms(postings, vocabulary))
    else:
        corpus = materialise(postings.stats() if corpus is None else corpus)
        stored = postings.blocks(vocabulary)
        hits = materialise(postings.live_entries(stored))
        blocks = materialise(stored.select("pipeline_id", "term", "block", "n", *BOUNDS))
    stats = None
    if scorer == "bm25":
        stats = materialise(corpus_stats(postings)) if corpus is None else corpus
    elif scorer not in ("tf", "ts_rank"):
        raise ValueError(f"unknown scorer: {scorer}")
    df = hits.groupBy("pipeline_id", "term").agg(F.count("*").alias("df"))
    weighed = qt.join(df, ["pipeline_id", "term"])
    complete = (
        weighed.groupBy("query_id", "pipeline_id", "n_q")
        .agg(
            F.count("*").alias("found"),
            F.min_by("term", F.struct("df", "term")).alias("lead"),
            F.min("df").alias("lead_df"),
        )
        .where(F.col("found") == F.col("n_q"))
    )

    def ranked_of(lead_hits: DataFrame) -> DataFrame:
        """Scores of the chunks that hold all terms, from (query_id, chunk_id) of the lead term."""
        candidates = lead_hits if allowed is None else lead_hits.join(allowed, "chunk_id", "left_semi")
        wanted = candidates.join(weighed, "query_id")
        matched = wanted.join(hits, ["pipeline_id", "chunk_id", "term"])
        score = F.col("tf").cast("double")
        if stats is not None:
            matched = matched.join(stats, "pipeline_id")
            score = bm25_weight(
                F.col("tf"), F.col("df"), F.col("n_terms"), F.col("n_chunks"), F.col("avg_terms")
            )
        total = F.sum(score)
        if scorer == "ts_rank":
            # One list of positions per term meets per set and chunk.
            total = F.transform(
                F.array_sort(F.collect_list(F.struct("term", "positions"))), lambda s: s["positions"]
            )
        return (
            matched.groupBy("query_id", "chunk_id", "n_q")
            .agg(F.count("*").alias("_m"), total.alias("_total"))
            .withColumn("kw_score", F.round(ts_rank(F.col("_total")) if scorer == "ts_rank" else F.col("_total"), 9))
            .where(F.col("_m") == F.col("n_q"))
            .select("query_id", "chunk_id", "kw_score")
        )

    def whole_lead(of: DataFrame) -> DataFrame:
        lead = hits.select("pipeline_id", F.col("term").alias("lead"), "chunk_id")
        return ranked_of(of.join(lead, ["pipeline_id", "lead"]).select("query_id", "chunk_id"))

    if scorer == "ts_rank":
        ranked = whole_lead(complete)
    else:
        weighed, complete = materialise(weighed), materialise(complete)
        several = complete.where("n_q > 1")
        ranked = _one_term(complete.where("n_q = 1"), hits, stats, allowed)
        if blocks is None:
            # Only a long list of candidates is worth cutting into blocks.
            short = F.col("lead_df") <= FIRST_BLOCKS * BLOCK_ROWS
            ranked = ranked.unionByName(whole_lead(several.where(short)))
            several = several.where(~short)
        if not several.isEmpty():
            listed = hits
            most = _weights(hits, stats)
            if blocks is None:
                listed, blocks = _cut(hits, several, stats)
            else:
                most = _bounds(blocks, stats)
            bounded = block_bounds(several, weighed, most, blocks, stats)
            ranked = ranked.unionByName(best_first(bounded, lambda b: ranked_of(_lead_hits(b, listed)), k))
    best = [F.col("kw_score").desc(), F.col("chunk_id")]
    top = ordered.newest(ranked, ["query_id"], best, k, "rnk").select(
        F.col("query_id.pipeline_id").alias("pipeline_id"), F.col("query_id._set").alias("_set"), "chunk_id", "kw_score", "rnk"
    )
    return sets.select("query_id", "pipeline_id", "_set").join(top, ["pipeline_id", "_set"]).select(
        "query_id", "chunk_id", "kw_score", "rnk"
    )


def of_terms(rows: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """The `rows` whose pipeline_id and term are in `vocabulary`.

    Most rows are of other terms. They are left out before the shuffle of the join by `MARKS`
    bits, one per hash of an asked pair, that are broadcast 64 to a row; terms whose hashes
    meet go on to the join, which decides.
    """
    keys = ["pipeline_id", "term"]
    # Equal numbers of unlike types have unlike hashes, but meet in a join.
    same = rows.schema["pipeline_id"].dataType == vocabulary.schema["pipeline_id"].dataType
    slot = F.xxhash64(*(keys if same else ["term"])).bitwiseAND(F.lit(MARKS - 1))
    bit = F.expr("shiftleft(1L, cast(_slot & 63 AS int))")
    word = F.shiftright("_slot", 6).alias("_word")
    asked = vocabulary.select(slot.alias("_slot")).select(word, bit.alias("_bit"))
    marks = materialise(asked.groupBy("_word").agg(F.bit_or("_bit").alias("_bits")))
    held = rows.withColumn("_slot", slot).withColumn("_word", word).join(F.broadcast(marks), "_word")
    there = held.where(F.col("_bits").bitwiseAND(bit) != 0).select(*rows.columns)
    # A semi join would be moved below the join with the marks, before any row is left out.
    return there.join(vocabulary.select(*keys).distinct(), keys).select(*rows.columns)


def _weights(hits: DataFrame, stats: DataFrame | None) -> DataFrame:
    """`hits` with `_part`, the share of a score that does not depend on how many chunks hold the term."""
    if stats is None:
        return hits.withColumn("_part", F.col("tf").cast("double"))
    of_length = length_weight(F.col("tf"), F.col("n_terms"), F.col("avg_terms"))
    return hits.join(stats, "pipeline_id").withColumn("_part", of_length)


def _bounds(blocks: DataFrame, stats: DataFrame | None) -> DataFrame:
    """`blocks` with `_part`, the most an entry of the block can have."""
    return _weights(blocks.withColumnsRenamed({"max_tf": "tf", "min_terms": "n_terms"}), stats)


def _whole(part: str, stats: DataFrame | None) -> Column:
    """A score from `_part`, df and n_chunks."""
    if stats is None:
        return F.col(part)
    return idf(F.col("df"), F.col("n_chunks")) * F.col(part)


def _one_term(sets: DataFrame, hits: DataFrame, stats: DataFrame | None, allowed: DataFrame | None) -> DataFrame:
    """Scores of the chunks of sets of one term; each is scored from its one posting."""
    found = _weights(hits if allowed is None else hits.join(allowed, "chunk_id", "left_semi"), stats)
    asked = sets.select("query_id", "pipeline_id", F.col("lead").alias("term"), F.col("lead_df").alias("df"))
    score = F.round(_whole("_part", stats), 9).alias("kw_score")
    return found.where(F.col("chunk_id").isNotNull()).join(asked, ["pipeline_id", "term"]).select("query_id", "chunk_id", score)


def _cut(hits: DataFrame, sets: DataFrame, stats: DataFrame | None) -> tuple[DataFrame, DataFrame]:
    """The lead postings of `sets` with a `block`, some `BLOCK_ROWS` of like weight, and the blocks."""
    leads = sets.select("pipeline_id", F.col("lead").alias("term")).distinct()
    own = _weights(hits.join(leads, ["pipeline_id", "term"], "left_semi"), stats).withColumn("_down", -F.col("_part"))
    bucket = F.floor(F.col("_down") * 1024)
    placed = ordered.row_number(own, ["pipeline_id", "term"], ["_down", "chunk_id"], bucket, "_at")
    listed = materialise(
        placed.select("pipeline_id", "term", "chunk_id", "_part", F.floor((F.col("_at") - 1) / BLOCK_ROWS).alias("block"))
    )
    return listed, listed.groupBy("pipeline_id", "term", "block").agg(F.max("_part").alias("_part"))


def block_bounds(sets: DataFrame, weighed: DataFrame, most: DataFrame, blocks: DataFrame, stats: DataFrame | None) -> DataFrame:
    """query_id, pipeline_id, lead, block, bound: what a chunk of each lead block can score at most.

    The block's own best plus the best the query's other terms have anywhere. The best of a
    term, from the `_part` of `most`, is found once, not once per query.
    """
    of_term = most.groupBy("pipeline_id", "term").agg(F.max("_part").alias("_best"))
    asked = weighed.join(sets.select("query_id", F.col("lead")), "query_id").join(of_term, ["pipeline_id", "term"])
    if "_part" not in blocks.columns:
        blocks = _bounds(blocks, stats)
    own = blocks.select("pipeline_id", F.col("term").alias("lead"), "block", "_part")
    if stats is not None:
        asked = asked.join(stats.select("pipeline_id", "n_chunks"), "pipeline_id")
        chunks_of = stats.select("pipeline_id", "n_chunks")
        own = own.join(chunks_of, "pipeline_id")
    others = asked.where("term <> lead").groupBy("query_id").agg(F.sum(_whole("_best", stats)).alias("_others"))
    leading = sets.select("query_id", "pipeline_id", "lead", F.col("lead_df").alias("df")).join(others, "query_id", "left")
    bound = (_whole("_part", stats) + F.coalesce("_others", F.lit(0.0))).alias("bound")
    return leading.join(own, ["pipeline_id", "lead"]).select("query_id", "pipeline_id", "lead", "block", bound)


def _lead_hits(chosen: DataFrame, hits: DataFrame) -> DataFrame:
    there = hits.select("pipeline_id", F.col("term").alias("lead"), "block", "chunk_id")
    return chosen.join(there, ["pipeline_id", "lead", "block"]).select("query_id", "chunk_id")


def worth_reading(bounded: DataFrame, first: DataFrame, ranked: DataFrame, k: int) -> DataFrame:
    """Blocks beyond the first ones that may still hold one of a query's k best."""
    best = [F.col("kw_score").desc(), F.col("chunk_id")]
    kth = ordered.newest(ranked, ["query_id"], best, k, "_rn").where(F.col("_rn") == k)
    rest = bounded.join(first.select("query_id", "block"), ["query_id", "block"], "left_anti")
    # Scores are rounded to nine digits before they are compared.
    return rest.join(kth.select("query_id", "kw_score"), "query_id", "left").where(
        F.col("kw_score").isNull() | (F.col("bound") >= F.col("kw_score") - 1e-8)
    ).drop("kw_score")


def best_first(bounded: DataFrame, ranked_of: Callable[[DataFrame], DataFrame], k: int) -> DataFrame:
    """Scores from the most promising blocks of each query, then from those that can beat them."""
    bounded = materialise(bounded)
    top = [F.col("bound").desc(), F.col("block")]
    first = materialise(ordered.newest(bounded, ["query_id"], top, FIRST_BLOCKS, "_rn").drop("_rn"))
    ranked = materialise(ranked_of(first))
    more = worth_reading(bounded, first, ranked, k)
    return ranked.unionByName(ranked_of(more))


def corpus_stats(postings: DataFrame) -> DataFrame:
    """n_chunks and avg_terms per pipeline."""
    return (
        postings.groupBy("pipeline_id", "chunk_id")
        .agg(F.first("n_terms").alias("n_terms"))
        .groupBy("pipeline_id")
        .agg(F.count("*").alias("n_chunks"), F.avg("n_terms").alias("avg_terms"))
    )


def bm25_weight(tf: Column, df: Column, n_terms: Column, n_chunks: Column, avg_terms: Column) -> Column:
    """Robertson and Zaragoza 2009, with the idf kept positive."""
    return idf(df, n_chunks) * length_weight(tf, n_terms, avg_terms)


def idf(df: Column, n_chunks: Column) -> Column:
    return F.log(1 + (n_chunks - df + 0.5) / (df + 0.5))


def length_weight(tf: Column, n_terms: Column, avg_terms: Column) -> Column:
    """Share of a term's weight; grows with tf and falls with the text's length."""
    return tf * (K1 + 1) / (tf + K1 * (1 - B + B * n_terms / avg_terms))


def ts_rank(positions: Column) -> Column:
    """Rank of a text holding all terms, from the positions of each term.

    One term: its weight times the sum of 1/j^2 over its occurrences, scaled. Several:
    1 - product of (1 - closeness) over all position pairs of different terms, where
    closeness falls with the distance and is nothing beyond 100 terms.
    """

    def total(values: Column) -> Column:
        return F.aggregate(values, F.lit(0.0), lambda acc, x: acc + x)

    def far_apart(p: Column, q: Column) -> Column:
        gap = F.abs(p - q)
        near = TERM_WEIGHT * F.sqrt(1.0 / (1.005 + 0.05 * F.exp(gap / 1.5 - 2)))
        return F.when((gap == 0) | (gap > FAR), 0.0).otherwise(F.log1p(-near))

    def between(a: Column, b: Column) -> Column:
        return total(F.transform(a, lambda p: total(F.transform(b, lambda q: far_apart(p, q)))))

    pairs = F.transform(
        positions,
        lambda a, i: total(
            F.transform(F.slice(positions, i + 2, F.size(positions)), lambda b: between(a, b))
        ),
    )
    single = total(
        F.transform(F.get(positions, 0), lambda _, j: F.lit(TERM_WEIGHT) / ((j + 1) * (j + 1)))
    )
    return F.when(F.size(positions) == 1, single / SQUARES_LIMIT).otherwise(1 - F.exp(total(pairs)))


def bm25(queries: DataFrame, postings: DataFrame, k: int, **options) -> DataFrame:
    return keyword_topk(queries, postings, k, scorer="bm25", **options)
