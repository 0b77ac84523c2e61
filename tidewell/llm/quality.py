"""Learned decision lists over document statistics.

`statistics` measures every text. `fit_rules` learns an ordered list of rules from labelled
statistics by sequential covering: each rule is a conjunction of thresholds grown on two
thirds of the rows and pruned on the last third. `verdict` turns the list into one ordered
Spark conditional expression.

Edge cases. Null or empty text: all statistics 0, which fails the base rules. Null labels
and labels without a document are ignored; without usable labels the list is empty and only
the base rules decide. Repeated rows are judged row by row. Other columns pass through
untouched; a column named `_quality` is replaced.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from tidewell.llm.textkit import IS_SPACE, Rolling, blocks, flat, runs, words

STATS = [
    "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
    "n_lines", "n_upper", "n_punct", "n_digits",
]
STATS_TYPE = StructType([StructField(c, LongType()) for c in STATS])

#: Labelled rows the rules are fitted on, at most.
SAMPLE_ROWS = 20_000
#: A rule must be right this often on the rows it is pruned on.
MIN_PRECISION = 0.95
MAX_RULES, MAX_CONDITIONS, THRESHOLDS = 16, 4, 48

_SYMBOLS = np.zeros(256, bool)
_SYMBOLS[np.frombuffer(b"#*$%&|<>", np.uint8)] = True
_PUNCT = np.zeros(256, bool)
_PUNCT[[c for c in range(33, 127) if not chr(c).isalnum()]] = True


def _measure(text: pa.Array) -> dict[str, np.ndarray]:
    data, offsets = flat(text)
    n = len(offsets) - 1

    def per_document(mask: np.ndarray) -> np.ndarray:
        return np.diff(np.concatenate([[0], np.cumsum(mask)])[offsets])

    starts, ends, first = words(data, offsets)
    word_doc = np.repeat(np.arange(n), np.diff(first))
    rolling = Rolling(data)

    # Words in a three-word window that is found twice or more in its document.
    ids = Rolling(rolling.span(starts, ends), 1)
    grams = ids.grams(3)
    inside = np.flatnonzero(word_doc[: len(grams)] == word_doc[2 : 2 + len(grams)])
    order = inside[np.lexsort((grams[inside], word_doc[inside]))]
    same = (grams[order][1:] == grams[order][:-1]) & (word_doc[order][1:] == word_doc[order][:-1])
    twice = np.zeros(len(order), bool)
    twice[1:] |= same
    twice[:-1] |= same
    repeated = np.zeros(len(starts) + 2, bool)
    for shift in range(3):
        repeated[order[twice] + shift] = True
    repeat_words = np.diff(np.concatenate([[0], np.cumsum(repeated[: len(starts)])])[first])

    # Lines with a word that equal an earlier line of their document.
    line_starts, line_ends = runs(data != 0x0A, offsets)
    line_doc = np.searchsorted(offsets, line_starts, "right") - 1
    full = np.searchsorted(starts, line_ends) > np.searchsorted(starts, line_starts)
    line_starts, line_ends, line_doc = line_starts[full], line_ends[full], line_doc[full]
    lines = rolling.span(line_starts, line_ends)
    order = np.lexsort((lines, line_doc))
    again = (lines[order][1:] == lines[order][:-1]) & (line_doc[order][1:] == line_doc[order][:-1])

    letters = ~IS_SPACE[data]
    return {
        "n_words": np.diff(first),
        "word_chars": per_document(letters & ((data & 0xC0) != 0x80)),
        "n_symbols": per_document(_SYMBOLS[data]),
        "n_dup_lines": np.bincount(line_doc[order][1:][again], minlength=n),
        "n_repeat_words": repeat_words,
        "n_lines": np.bincount(line_doc, minlength=n),
        "n_upper": per_document((data >= 65) & (data <= 90)),
        "n_punct": per_document(_PUNCT[data]),
        "n_digits": per_document((data >= 48) & (data <= 57)),
    }


@F.arrow_udf(STATS_TYPE)
def _statistics(text: pa.Array) -> pa.Array:
    fields = [pa.field(c, pa.int64()) for c in STATS]
    parts = []
    for block in blocks([pa.record_batch([text], names=["text"])], "text"):
        found = _measure(block.column(0))
        parts.append(pa.StructArray.from_arrays([pa.array(found[c], pa.int64()) for c in STATS], fields=fields))
    return pa.concat_arrays(parts) if parts else pa.array([], pa.struct(fields))


_once = _statistics.asNondeterministic()  # a filter above must not make Spark measure twice


def statistics(docs: DataFrame, out: str = "_quality") -> DataFrame:
    """Add `out`, the statistics of each whole text, as a struct."""
    return docs.withColumn(out, _once(F.col("text").cast("string")))


def features(stats: str | None = None) -> dict[str, Column]:
    """Shares the rules test, by name, over the statistics in struct `stats`."""
    at = (lambda c: F.col(f"{stats}.{c}")) if stats else F.col
    share = lambda a, b: F.when(at(b) > 0, at(a) / at(b)).otherwise(F.lit(0.0))
    return {
        "words": at("n_words").cast("double"),
        "word_length": share("word_chars", "n_words"),
        "symbol_share": share("n_symbols", "word_chars"),
        "dup_line_share": share("n_dup_lines", "n_lines"),
        "repeat_share": share("n_repeat_words", "n_words"),
        "line_length": share("n_words", "n_lines"),
        "upper_share": share("n_upper", "word_chars"),
        "punct_share": share("n_punct", "word_chars"),
        "digit_share": share("n_digits", "word_chars"),
    }


def base_failed(stats: str) -> Column:
    n = F.col(f"{stats}.n_words")
    return (n < 50) | (100 * F.col(f"{stats}.n_repeat_words") > 50 * n)


@dataclass(frozen=True)
class Condition:
    feature: str
    above: bool
    threshold: float

    def holds(self, x: np.ndarray, names: Sequence[str]) -> np.ndarray:
        column = x[:, list(names).index(self.feature)]
        return column >= self.threshold if self.above else column <= self.threshold


#: A rule rejects a document that meets all its conditions.
Rule = tuple[Condition, ...]


def _covered(rule: Rule, x: np.ndarray, names: Sequence[str]) -> np.ndarray:
    mask = np.ones(len(x), bool)
    for condition in rule:
        mask &= condition.holds(x, names)
    return mask


def _grow(x: np.ndarray, bad: np.ndarray, names: Sequence[str]) -> Rule:
    rule: list[Condition] = []
    inside = np.ones(len(x), bool)
    while len(rule) < MAX_CONDITIONS and (~bad[inside]).any():
        p0, n0 = bad[inside].sum(), (~bad[inside]).sum()
        best, gain = None, 1e-9
        for j, name in enumerate(names):
            column = x[:, j]
            cuts = np.unique(np.quantile(column[inside & bad], np.linspace(0, 1, THRESHOLDS)))
            good, poor = np.sort(column[inside & ~bad]), np.sort(column[inside & bad])
            for above in (True, False):
                if above:
                    p = len(poor) - np.searchsorted(poor, cuts, "left")
                    n = len(good) - np.searchsorted(good, cuts, "left")
                else:
                    p, n = np.searchsorted(poor, cuts, "right"), np.searchsorted(good, cuts, "right")
                with np.errstate(divide="ignore", invalid="ignore"):
                    score = np.where(p > 0, p * (np.log2(p / (p + n)) - np.log2(p0 / (p0 + n0))), 0)
                at = int(np.argmax(score))
                if score[at] > gain:
                    best, gain = Condition(name, above, float(cuts[at])), score[at]
        if best is None:
            break
        rule.append(best)
        inside &= best.holds(x, names)
    return tuple(rule)


def _prune(rule: Rule, x: np.ndarray, bad: np.ndarray, names: Sequence[str]) -> tuple[Rule, float]:
    """The prefix of the rule that is best on held-out rows, and its precision there."""
    best, worth, precision = (), -np.inf, 0.0
    for k in range(1, len(rule) + 1):
        mask = _covered(rule[:k], x, names)
        p, n = bad[mask].sum(), (~bad[mask]).sum()
        if p + n and (p - n) / (p + n) > worth:
            best, worth, precision = rule[:k], (p - n) / (p + n), p / (p + n)
    return best, precision


def learn(x: np.ndarray, bad: np.ndarray, names: Sequence[str], seed: int = 7) -> list[Rule]:
    """Sequential covering; rows a rule covers leave before the next one is grown."""
    side = np.random.default_rng(seed).random(len(x)) < 2 / 3
    rules: list[Rule] = []
    while len(rules) < MAX_RULES and bad[side].any():
        grown = _grow(x[side], bad[side], names)
        rule, precision = _prune(grown, x[~side], bad[~side], names)
        if not rule or precision < MIN_PRECISION:
            break
        rules.append(rule)
        left = ~_covered(rule, x, names)
        x, bad, side = x[left], bad[left], side[left]
    return rules


def fit_rules(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> list[Rule]:
    """Learn from at most `sample_rows` labelled documents, chosen by a hash of their id.

    The chosen ids are bounded by `sample_rows`, so the join that reads their texts
    broadcasts them; nothing else is collected.
    """
    chosen = (
        labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull())
        .groupBy("doc_id")
        .agg(F.min("quality").alias("_label"))
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(sample_rows)
    )
    known = statistics(docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id"))
    columns = features("_quality")
    rows = known.where(~base_failed("_quality")).select("doc_id", "_label", *[c.alias(n) for n, c in columns.items()]).toPandas()
    rows = rows.sort_values(["doc_id", "_label"])
    x = rows[list(columns)].to_numpy(float).reshape(-1, len(columns))
    return learn(x, rows["_label"].to_numpy() == 0, list(columns))


def verdict(rules: list[Rule], stats: str) -> Column:
    """Ordered conditional: false at the first rule that holds, true if none does."""
    columns, out = features(stats), None
    for rule in rules:
        test = F.lit(True)
        for c in rule:
            test = test & (columns[c.feature] >= c.threshold if c.above else columns[c.feature] <= c.threshold)
        out = F.when(test, False) if out is None else out.when(test, False)
    return F.lit(True) if out is None else out.otherwise(True)


def describe(rules: list[Rule]) -> list[str]:
    return [" and ".join(f"{c.feature} {'>=' if c.above else '<='} {c.threshold:.4g}" for c in r) for r in rules]


def judge(docs: DataFrame, rules: list[Rule], out: str = "_quality") -> DataFrame:
    """Add the statistics and, in `kept`, the decision on each row."""
    measured = statistics(docs, out)
    failed = base_failed(out)
    return measured.withColumns({"base_failed": failed, "kept": ~failed & verdict(rules, out)})
