r"""Spelling variants: words that differ by one code point, found by pivotal grams.

Two words one edit apart share all but a few bigrams. Bigrams are ordered by how few words
hold them. Of each word the three rarest are its prefix, and two of these that do not
overlap, chosen by dynamic programming for the least total count, are its pivots: one edit
leaves one of the two whole. With the order's last prefix gram the smaller of the two words
(ties: either), that pivot lies in the prefix of the other word. So pivots are looked up in
the prefixes of the other words only.

Position limits: an edit behind a gram leaves all before it in place, an edit before it
leaves all behind it. A pivot therefore meets a prefix gram only at the same distance from
the word's start or end, where the words also agree from there to the gram; where that piece
is short, two more letters that the edit cannot have touched must agree. What is met is
verified by its edit distance.

Nothing is gathered per gram or word: candidates come from an equi-join on hashes of these
pieces, four letters at least, and all counts are combined before they are shuffled. The
table of bigrams is bounded by the alphabet: 90 letters, 8,100 bigrams.

Edge cases. A null text has no words; a null id is written as nothing before the colon.
Empty and very long texts are ordinary. Equal rows count as often as they come. Without two
words there is no pair; other columns are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewell.session import materialise

#: Words are runs of these, at least this long, found at least so often.
LETTERS, LEAST_LENGTH, LEAST_COUNT = r"A-Za-zÀ-ÿ", 7, 2
#: One in so many runs loses a code point.
NOISE = 31
#: A form is so many times as frequent as its variant.
FORM_FACTOR = 10
#: q * edits + 1 grams are a prefix, edits + 1 of them pivots.
GRAM, PREFIX, PIVOTS = 2, 3, 2

_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def noisy(doc_id: Column, run: Column) -> Column:
    """The run, without one code point if its hash with the id says so."""
    h = F.crc32(F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(":"), run).cast("binary"))
    at = (h % F.length(run)).cast("int")
    cut = F.concat(F.substring(run, F.lit(1), at), F.substring(run, at + 2, F.length(run)))
    return F.when(h % NOISE == 0, cut).otherwise(run)


def word_counts(docs: DataFrame) -> DataFrame:
    """word, n: words of all texts with their occurrences."""
    # A run shorter than a word cannot become one: noise only shortens.
    pattern = F.lit(f"[{LETTERS}]{{{LEAST_LENGTH},}}")
    runs = F.regexp_extract_all(F.col("text").cast("string"), pattern, F.lit(0))
    # The outer form: the filter inferred for the inner one runs the pattern twice.
    found = docs.select("doc_id", F.explode_outer(runs).alias("_run"))
    lower = found.select("doc_id", F.translate("_run", _UPPER, _UPPER.lower()).alias("_run"))
    words = lower.select(noisy(F.col("doc_id"), F.col("_run")).alias("word"))
    return (
        words.where(F.length("word") >= LEAST_LENGTH).groupBy("word")
        .agg(F.count("*").alias("n")).where(F.col("n") >= LEAST_COUNT)
    )


def _grams(word: Column) -> Column:
    return F.transform(
        F.sequence(F.lit(0), F.length(word) - GRAM),
        lambda i: F.struct(F.substring(word, i + 1, F.lit(GRAM)).alias("gram"), i.alias("at")),
    )


def _pivots(prefix: Column) -> Column:
    """Two grams of the prefix that do not overlap, of least total count.

    A fold over the grams by position keeps, as in any such program, the cheapest gram that
    ends before the next one starts, the one just passed, and the cheapest pair so far.
    """
    gram = "struct<at:int,rank:bigint,gram:string,count:bigint>"
    start = F.struct(
        F.lit(None).cast(f"array<{gram}>").alias("passed"),
        F.lit(None).cast(gram).alias("one"),
        F.lit(None).cast("bigint").alias("cost"),
        F.lit(None).cast(f"array<{gram}>").alias("pair"),
    )

    def cheaper(a: Column, b: Column) -> Column:
        return F.when(a.isNull() | (b["count"] < a["count"]), b).otherwise(a)

    def step(acc: Column, g: Column) -> Column:
        # Grams passed that end where `g` starts, or before, may now be paired.
        passed = F.coalesce(acc["passed"], F.array().cast(f"array<{gram}>"))
        free = F.filter(passed, lambda p: p["at"] + GRAM <= g["at"])
        one = F.aggregate(free, acc["one"], cheaper)
        waiting = F.filter(passed, lambda p: p["at"] + GRAM > g["at"])
        cost = one["count"] + g["count"]
        better = one.isNotNull() & (acc["cost"].isNull() | (cost < acc["cost"]))
        return F.struct(
            F.concat(waiting, F.array(g)).alias("passed"),
            one.alias("one"),
            F.when(better, cost).otherwise(acc["cost"]).alias("cost"),
            F.when(better, F.array(one, g)).otherwise(acc["pair"]).alias("pair"),
        )

    by_place = F.transform(prefix, lambda g: F.struct(g["at"], g["rank"], g["gram"], g["count"]).cast(gram))
    return F.aggregate(F.array_sort(by_place), start, step, lambda acc: acc["pair"])


def with_prefixes(words: DataFrame) -> DataFrame:
    """Add `prefix` and `pivots` (rank, gram, at, count) and `last`, the rank the prefix ends at.

    All places of the last gram are kept in the prefix, so that the order of equal grams
    never matters.
    """
    in_word = F.array_distinct(F.transform(_grams(F.col("word")), lambda g: g["gram"]))
    holders = words.select(F.explode(in_word).alias("gram")).groupBy("gram").agg(F.count("*").alias("count"))
    listed = words.select("word", F.length("word").alias("len"), F.explode(_grams(F.col("word"))).alias("g"))
    grams = listed.select("word", "len", "g.gram", "g.at")
    # At most 8,100 rows whatever the corpus: one task may order them, every task may hold them.
    table = materialise(holders)
    order = F.array_sort(F.collect_list(F.struct("count", "gram")))
    ranked = table.agg(order.alias("o")).select(F.posexplode("o").alias("rank", "s")).select(
        F.col("rank").cast("long").alias("rank"), "s.gram", "s.count"
    )
    known = grams.join(F.broadcast(ranked), "gram").groupBy("word", "len").agg(
        F.array_sort(F.collect_list(F.struct("rank", "gram", "at", "count"))).alias("all")
    )
    last = F.element_at("all", PREFIX)["rank"]
    kept = known.withColumn("last", last).withColumn("prefix", F.filter("all", lambda g: g["rank"] <= F.col("last")))
    return kept.withColumn("pivots", _pivots(F.slice("all", 1, PREFIX))).drop("all")


#: Characters that a short piece takes on beyond its gram, and from the word's other end.
_LONGER = [(2, 0), (1, 1), (0, 2)]
#: Letters beyond the gram from which a piece may stand alone, and from which it always does.
LEAST, SHORT = 2, 4
#: Words that look for one key in one task, at most; what they look for goes to all of these.
ASKED_ROWS = 256


def _key(side: str, near: Column, far: Column | None = None) -> Column:
    return F.xxhash64(F.lit(side), near, F.lit("") if far is None else far)


def _head(word: Column, at: Column, more: int = 0) -> Column:
    return F.substring(word, F.lit(1), at + GRAM + more)


def _tail(word: Column, at: Column, more: int = 0) -> Column:
    return F.substring(word, at + 1 - more, F.length(word))


def _first(word: Column, n: int) -> Column:
    return F.substring(word, F.lit(1), F.lit(n))


def _last(word: Column, n: int) -> Column:
    return F.substring(word, F.length(word) + 1 - n, F.lit(n))


def _index_keys(word: Column, at: Column) -> Column:
    """Keys a prefix gram is found by: its head and its tail, short ones with more letters."""
    heads = [_key(f"head{k}{c}", _head(word, at, k), _last(word, c)) for k, c in _LONGER]
    tails = [_key(f"tail{k}{c}", _tail(word, at, k), _first(word, c)) for k, c in _LONGER]
    behind, none = F.length(word) - GRAM - at, F.array().cast("array<bigint>")
    return F.concat(
        F.when(at >= LEAST, F.array(_key("head", _head(word, at)))).otherwise(none),
        F.when(at < SHORT, F.array(*heads)).otherwise(none),
        F.when(behind >= LEAST, F.array(_key("tail", _tail(word, at)))).otherwise(none),
        F.when(behind < SHORT, F.array(*tails)).otherwise(none),
    )


def _probe_keys(word: Column, p: Column, q: Column) -> Column:
    """Keys under which the pivots at `p` < `q` look for every word one edit away.

    Edit before the first pivot: the tail from it stays. Behind the second: the head up to
    it. Between them: the head up to the first and the last two letters stay. On a pivot: the
    other one stays, with all between it and the pivot hit and all beyond that pivot. A piece
    of five letters or less takes two of those letters on where there are two; a piece of
    three or less always finds them, as words have seven.
    """
    between, behind = q - p - GRAM, F.length(word) - GRAM - q

    def longer(side: str, piece, at: Column, far, room: Column) -> Column:
        keys = {(k, c): _key(f"{side}{k}{c}", piece(word, at, k), far(word, c)) for k, c in _LONGER}
        return F.when(room >= 2, keys[0, 2]).when(between >= 2, keys[2, 0]).otherwise(keys[1, 1])

    ends = F.array(_key("tail", _tail(word, p)), _key("head", _head(word, q)))
    second_hit = longer("head", _head, p, _last, behind)
    short_head = F.array(_key("head02", _head(word, p), _last(word, 2)), second_hit)
    first_hit = F.array(longer("tail", _tail, q, _first, p))
    plain_head = (p >= SHORT) | (between + behind < 2)
    plain_tail = (behind >= SHORT) | (between + p < 2)
    head = F.when(plain_head, F.array(_key("head", _head(word, p)))).otherwise(short_head)
    tail = F.when(plain_tail, F.array(_key("tail", _tail(word, q)))).otherwise(first_hit)
    return F.array_distinct(F.concat(ends, head, tail))


def near_pairs(words: DataFrame) -> DataFrame:
    """a, b: every two words one inserted, deleted or replaced code point apart, a < b."""
    known = materialise(with_prefixes(words))
    word, pivots = F.col("word"), F.col("pivots")
    probes = _probe_keys(word, F.get(pivots, F.lit(0))["at"], F.get(pivots, F.lit(1))["at"])
    asked = known.select(word.alias("s"), F.col("last").alias("s_last"), F.explode(probes).alias("key"))
    entries = F.array_distinct(F.flatten(F.transform("prefix", lambda g: _index_keys(word, g["at"]))))
    there = known.select(word.alias("r"), F.col("last").alias("r_last"), F.explode(entries).alias("key"))
    # A key many words ask for is dealt over parts, its entries are sent to each of them.
    parts = F.ceil(F.col("_n") / ASKED_ROWS).cast("int").alias("_parts")
    hot = materialise(asked.groupBy("key").agg(F.count("*").alias("_n")).where(F.col("_n") > ASKED_ROWS).select("key", parts))
    of = F.coalesce("_parts", F.lit(1))
    asked = asked.join(hot, "key", "left").withColumn("_part", F.pmod(F.xxhash64("s"), of)).drop("_parts")
    there = there.join(hot, "key", "left").withColumn("_part", F.explode(F.sequence(F.lit(0), of - 1))).drop("_parts")
    met = asked.join(there.withColumn("_part", F.col("_part").cast("long")), ["key", "_part"]).where((F.col("s_last") <= F.col("r_last")) & (F.col("s") != F.col("r")))
    near = met.where((F.abs(F.length("s") - F.length("r")) <= 1) & (F.levenshtein("s", "r", 1) == 1))
    return near.select(F.least("s", "r").alias("a"), F.greatest("s", "r").alias("b")).distinct()


def group_variants(words: DataFrame) -> DataFrame:
    """word, form, root, n, n_near, form_n of every row of `words` (word, n).

    A form has at least ten times its variant's count, so no chain of forms is longer than
    the digits of the greatest count; its end is reached by doubling.
    """
    words = materialise(words)
    pairs = materialise(near_pairs(words))
    both = pairs.select(F.col("a").alias("word"), F.col("b").alias("other")).unionByName(
        pairs.select(F.col("b").alias("word"), F.col("a").alias("other"))
    )
    counted = both.join(words.select(F.col("word").alias("other"), F.col("n").alias("other_n")), "other")
    near = counted.groupBy("word").agg(
        F.count("*").alias("n_near"), F.min(F.struct((-F.col("other_n")).alias("down"), "other")).alias("best")
    )
    joined = words.join(near, "word", "left")
    is_form = -F.col("best.down") >= FORM_FACTOR * F.col("n")
    formed = materialise(
        joined.select(
            "word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"),
            F.when(is_form, F.col("best.other")).alias("form"), F.when(is_form, -F.col("best.down")).alias("form_n"),
        )
    )
    links = formed.where(F.col("form").isNotNull()).select("word", F.col("form").alias("root"))
    most = words.agg(F.max("n")).first()[0] or 1
    for _ in range(math.ceil(math.log2(max(1, math.log10(most)))) if most >= FORM_FACTOR else 0):
        on = links.select(F.col("word").alias("root"), F.col("root").alias("_next"))
        links = materialise(links.join(on, "root", "left").select("word", F.coalesce("_next", "root").alias("root")))
    return formed.join(links, "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n"
    )
