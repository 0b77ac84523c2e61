"""Blocks to chunks. A block is cut inside its own row; only counts cross rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewell import constants as K
from tidewell.functions import ordered
from tidewell.functions.rows import explode_rows
from tidewell.functions.text import strip, word_count, words
from tidewell.session import materialise

BLANK_LINE = "\n\n"


def paragraphs(content: Column, sep: str = BLANK_LINE) -> Column:
    pieces = F.transform(F.split(content, sep), strip)
    return F.filter(pieces, lambda p: p != "")


def sentences(paragraph: Column) -> Column:
    """Split at `.`, `?` and `!`; the marks themselves are lost."""
    pieces = F.transform(F.split(paragraph, "[.?!]"), strip)
    return F.filter(pieces, lambda s: s != "")


def route_strategy(strategy: Column) -> Column:
    """`auto` means semantic; null for an unknown strategy."""
    return F.when(strategy == "auto", "semantic").when(strategy.isin("semantic", "hierarchical"), strategy)


def strategy_error(strategy: Column) -> Column:
    """What is wrong with a strategy, null if nothing."""
    named = F.concat(F.lit("unknown chunking strategy: "), F.coalesce(strategy, F.lit("none")))
    return F.when(route_strategy(strategy).isNull(), named)


def _units(target: int, sep: str) -> Column:
    """Paragraphs, with those over `target` words replaced by their sentences."""

    def unit(text: Column, n: Column, at: Column, sentence: bool) -> Column:
        return F.struct(
            text.alias("text"), n.alias("n"), at.alias("at"), F.lit(sentence).alias("sentence")
        )

    counted = F.transform(
        paragraphs(F.col("content"), sep), lambda p: F.struct(p.alias("p"), word_count(p).alias("n"))
    )
    return F.flatten(
        F.transform(
            counted,
            lambda c, i: F.when(
                c["n"] > target,
                F.transform(sentences(c["p"]), lambda s: unit(s, word_count(s), i, True)),
            ).otherwise(F.array(unit(c["p"], c["n"], i, False))),
        )
    )


def _bounds(target: int, overlap: int) -> Column:
    """Greedy packing of `_units` into slices: array<struct<lo, hi, n>>.

    The fold carries word counts only. A chunk never crosses a run, which is a
    stretch of ordinary paragraphs or the sentences of one long paragraph. When a
    chunk is full its last unit opens the next one: a paragraph if it is short, a
    sentence if it was not alone.
    """
    size = "struct<lo:int,at:int,n:int,last:int,done:array<struct<lo:int,hi:int,n:int>>>"

    def state(lo: Column, at: Column, n: Column, last: Column, done: Column) -> Column:
        return F.struct(
            lo.alias("lo"), at.alias("at"), n.alias("n"), last.alias("last"), done.alias("done")
        )

    def closed(s: Column, hi: Column) -> Column:
        piece = F.struct(s["lo"].alias("lo"), hi.alias("hi"), s["n"].alias("n"))
        return F.concat(s["done"], F.array(piece))

    def step(s: Column, u: Column) -> Column:
        i, unit = u["i"], u["u"]
        prev = F.get(F.col("_units"), i - 1)
        same_run = (
            (i > 0)
            & (prev["sentence"] == unit["sentence"])
            & F.when(unit["sentence"], prev["at"] == unit["at"]).otherwise(
                prev["at"] + 1 == unit["at"]
            )
        )
        keep_last = F.when(unit["sentence"], i - s["lo"] > 1).otherwise(s["last"] <= overlap)
        return (
            F.when(
                i == 0, state(i, unit["at"], unit["n"], unit["n"], s["done"])
            )
            .when(
                ~same_run, state(i, unit["at"], unit["n"], unit["n"], closed(s, i))
            )
            .when(
                s["n"] + unit["n"] <= target,
                state(s["lo"], unit["at"], s["n"] + unit["n"], unit["n"], s["done"]),
            )
            .when(
                keep_last,
                state(i - 1, unit["at"], s["last"] + unit["n"], unit["n"], closed(s, i)),
            )
            .otherwise(state(i, unit["at"], unit["n"], unit["n"], closed(s, i)))
        )

    zero = F.lit(0)
    start = state(zero, zero, zero, zero, F.array().cast("array<struct<lo:int,hi:int,n:int>>"))
    slim = F.transform(
        F.col("_units"),
        lambda u, i: F.struct(
            i.alias("i"),
            F.struct(u["n"].alias("n"), u["at"].alias("at"), u["sentence"].alias("sentence")).alias("u"),
        ),
    )
    folded = F.aggregate(slim, start.cast(size), lambda s, u: step(s, u).cast(size))
    last = F.struct(
        folded["lo"].alias("lo"), F.size("_units").alias("hi"), folded["n"].alias("n")
    )
    return F.when(F.size("_units") > 0, F.concat(folded["done"], F.array(last))).otherwise(
        folded["done"]
    )


def _whole(strategy: str) -> Column:
    return F.array(
        F.struct(
            F.col("content").alias("content"),
            word_count(F.col("content")).alias("token_count"),
            F.lit(strategy).alias("strategy"),
        )
    )


def semantic_chunks(
    blocks: DataFrame,
    target: int = K.TARGET_WORDS,
    overlap: int = K.OVERLAP_WORDS,
    sep: str = BLANK_LINE,
    compat_index: bool = False,
) -> DataFrame:
    """Pack paragraphs (or sentences of long ones) up to `target` words; tables stay whole.

    Expects document_id, type, content and, where documents have several blocks,
    block_no; passes other columns through.
    `compat_index` repeats the index of a block's last chunk in the next block.
    """
    staged = blocks.withColumn("_units", _units(target, sep)).withColumn(
        "_bounds", _bounds(target, overlap)
    )
    texts = F.transform(F.col("_units"), lambda u: u["text"])
    cut = F.transform(
        F.col("_bounds"),
        lambda b: F.struct(
            F.when(
                F.get(F.col("_units"), b["lo"])["sentence"],
                F.concat(
                    F.array_join(F.slice(texts, b["lo"] + 1, b["hi"] - b["lo"]), ". "), F.lit(".")
                ),
            )
            .otherwise(F.array_join(F.slice(texts, b["lo"] + 1, b["hi"] - b["lo"]), BLANK_LINE))
            .alias("content"),
            b["n"].alias("token_count"),
            F.lit("semantic").alias("strategy"),
        ),
    )
    pieces = F.when(F.col("type") == "table", _whole("semantic")).otherwise(cut)
    step = F.size("_pieces")
    if compat_index:
        # The last flush of a text block does not move the index on, unless the block
        # ended in a long paragraph.
        last = F.try_element_at(paragraphs(F.col("content"), sep), F.lit(-1))
        ends_long = word_count(last) > target
        held = (F.col("type") != "table") & ~ends_long & (F.size("_units") > 0)
        step = step - held.cast("int")
    return _explode_chunks(staged.withColumn("_pieces", pieces), step)


def hierarchical_chunks(
    blocks: DataFrame, child: int = K.CHILD_WORDS, sep: str = BLANK_LINE
) -> DataFrame:
    """Each paragraph as a parent followed by its `child`-word pieces; tables are parents only."""

    def piece(content: Column, n: Column, strategy: str) -> Column:
        return F.struct(
            content.alias("content"), n.alias("token_count"), F.lit(strategy).alias("strategy")
        )

    def family(p: Column, w: Column) -> Column:
        starts = F.sequence(F.lit(1), F.size(w), F.lit(child))
        children = F.transform(
            starts,
            lambda s: piece(
                F.array_join(F.slice(w, s, child), " "),
                F.least(F.lit(child), F.size(w) - s + 1),
                "hierarchical_child",
            ),
        )
        return F.concat(F.array(piece(p, F.size(w), "hierarchical_parent")), children)

    split = F.transform(
        paragraphs(F.col("content"), sep), lambda p: F.struct(p.alias("p"), words(p).alias("w"))
    )
    staged = blocks.withColumn("_paras", F.filter(split, lambda e: F.size(e["w"]) > 0))
    families = F.flatten(F.transform(F.col("_paras"), lambda e: family(e["p"], e["w"])))
    pieces = F.when(F.col("type") == "table", _whole("hierarchical_parent")).otherwise(families)
    return _explode_chunks(staged.withColumn("_pieces", pieces), F.size("_pieces"))


def _explode_chunks(staged: DataFrame, step: Column) -> DataFrame:
    """One row per piece. Without block_no a row is a whole document and numbering is
    local to it. With block_no it continues through the document's blocks, by running
    counts; the cut blocks are written out first, as counts and rows both read them."""
    keep = [c for c in staged.columns if c not in ("content", "_pieces", "_units", "_bounds", "_paras")]
    if "block_no" in staged.columns:
        numbered = ordered.running_sum(
            materialise(staged.select(*keep, "_pieces", step.alias("_step"))),
            ["document_id"],
            ["block_no"],
            F.col("_step"),
            F.floor(F.col("block_no") / ordered.BUCKET_ROWS),
            "_upto",
        ).withColumn("_first", F.col("_upto") - F.col("_step"))
    else:
        numbered = staged.withColumn("_first", F.lit(0))
    rows = explode_rows(numbered, [*keep, "_first"], F.col("_pieces"), "_piece", "_pos")
    return rows.select(
        *keep,
        (F.col("_first") + F.col("_pos")).cast("int").alias("chunk_index"),
        F.col("_piece.content").alias("content"),
        F.col("_piece.token_count").alias("token_count"),
        F.col("_piece.strategy").alias("strategy"),
    )


def chunk_by_strategy(blocks: DataFrame, strategy: str = "chunking_strategy", **options) -> DataFrame:
    """Send each block to the chunker its strategy column names; unknown ones give no chunks.

    Options: sep, and `semantic`, a function to use in place of `semantic_chunks`.
    """
    routed = blocks.withColumn("_route", route_strategy(F.col(strategy)))
    sep = options.get("sep", BLANK_LINE)
    parts = [
        options.get("semantic", semantic_chunks)(routed.where(F.col("_route") == "semantic"), sep=sep),
        hierarchical_chunks(routed.where(F.col("_route") == "hierarchical"), sep=sep),
    ]
    return parts[0].unionByName(parts[1]).drop("_route")


def parent_of_child(chunks: DataFrame) -> DataFrame:
    """Add parent_index: the last parent at or before each chunk of its document.

    Parents open a stretch of the index, so the parent is the largest parent index
    seen so far; stretches are found per index bucket and joined back.
    """
    bucket = F.floor(F.col("chunk_index") / ordered.BUCKET_ROWS)
    is_parent = F.col("strategy") == "hierarchical_parent"
    return ordered.running_max(
        chunks,
        ["document_id"],
        ["chunk_index"],
        F.when(is_parent, F.col("chunk_index")),
        bucket,
        "parent_index",
    )
