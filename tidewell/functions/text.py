"""Text columns: word counts, clean-up, citations, query shape."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidewell import constants as K
from tidewell.functions.rows import let

# White space as Python sees it: Unicode White_Space plus the four separators.
_WS = r"[\s\x1c-\x1f]"
_NOT_WS = r"[^\s\x1c-\x1f]"


def strip(text: Column) -> Column:
    return F.trim(text, F.lit(K.WHITESPACE))


def is_blank(text: Column) -> Column:
    return F.coalesce(strip(text), F.lit("")) == ""


def word_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(rf"(?U){_NOT_WS}+"))


def words(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(rf"(?U){_NOT_WS}+"), F.lit(0))


def terms(text: Column) -> Column:
    """Lower-case runs of letters and digits."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{Nd}]+"), F.lit(0))


def rewrite_matches(text: Column, pattern: str, rewrite: Callable[[Column], Column]) -> Column:
    """Replace every match of `pattern` by `rewrite(match)`, leaving the rest as it is."""
    gaps = F.split(text, pattern, -1)
    hits = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    pieces = F.transform(
        gaps, lambda gap, i: F.concat(gap, F.coalesce(rewrite(F.get(hits, i)), F.lit("")))
    )
    return F.when(text.rlike(pattern), F.array_join(pieces, "")).otherwise(text)


def normalize_extracted(text: Column) -> Column:
    """Repair extraction artefacts; the order of the steps matters."""
    out = F.regexp_replace(text, rf"(?U)(\w)-{_WS}*\n{_WS}*(\w)", "$1$2")
    out = F.regexp_replace(out, rf"(?U)(\d)\.{_WS}+(\d)", "$1.$2")
    out = F.regexp_replace(out, rf"(?U),\.{_WS}*,", ", ...,")
    out = F.regexp_replace(out, rf"(?U)\.{_WS}+,", ",")
    out = F.regexp_replace(out, r"(?U)[\s\x1c-\x1f&&[^\n]]+", " ")
    out = F.regexp_replace(out, r"\n{3,}", "\n\n")
    return strip(out)


def strip_boilerplate(text: Column) -> Column:
    """Cut the first opening that matches, then start with a capital."""
    out = strip(text)
    cut = F.lit(None).cast("string")
    for prefix in reversed(K.BOILERPLATE_PREFIXES):
        cut = F.when(out.startswith(prefix), F.substr(out, F.lit(len(prefix) + 1))).otherwise(cut)
    out = F.coalesce(cut, out)
    first = F.left(out, F.lit(1))
    lower = (F.upper(first) != first) & (F.lower(first) == first)
    return F.when(lower, F.concat(F.upper(first), F.substr(out, F.lit(2)))).otherwise(out)


_BARE_CITATION = rf"(?U)(?<=[a-zA-Z]){_WS}+([1-9]{{1,3}})([.,;:])"


def bracket_citations(text: Column, max_source: Column) -> Column:
    """`claim 15.` -> `claim [1][5].` when every digit names one of the sources."""

    def rewrite(hit: Column) -> Column:
        digits = F.regexp_extract(hit, r"([1-9]+)", 1)
        known = F.array_max(F.split(digits, "")).cast("int") <= max_source
        cited = F.concat(F.lit(" "), F.regexp_replace(digits, "(.)", "[$1]"), F.right(hit, F.lit(1)))
        return F.when(known, cited).otherwise(hit)

    return F.when(max_source <= 0, text).otherwise(rewrite_matches(text, _BARE_CITATION, rewrite))


def clean_answer(text: Column, max_source: Column) -> Column:
    return bracket_citations(strip_boilerplate(text), max_source)


def is_refusal(answer: Column) -> Column:
    lower = F.lower(answer)
    found = F.lit(False)
    for phrase in K.REFUSAL_PHRASES:
        found = found | lower.contains(phrase)
    return found


def is_simple_query(q: Column) -> Column:
    """True when a query needs no rewrite."""
    n = word_count(q)
    lower = strip(F.lower(q))
    starts_clear = F.lit(False)
    for starter in K.CLEAR_STARTERS:
        starts_clear = starts_clear | lower.startswith(starter)
    commas = F.regexp_count(q, F.lit(","))
    marks = F.regexp_count(q, F.lit(r"\?"))
    return (n <= 6) | (starts_clear & (n <= 14)) | ((n <= 8) & (commas == 0) & (marks <= 1))


def dedupe_queries(lines: Column, q: Column) -> Column:
    """Expansion text -> at most four queries, the original among them."""
    stripped = F.transform(F.split(lines, "\n"), strip)
    bare = F.transform(stripped, lambda s: F.ltrim(s, F.lit("0123456789.-*• ")))
    kept = F.filter(bare, lambda s: s != "")
    full = F.when(F.array_contains(kept, q), kept).otherwise(F.concat(F.array(q), kept))
    return F.slice(full, 1, K.MAX_EXPANSIONS)


def _first_line_word(content: Column) -> Column:
    line = strip(F.substring_index(strip(content), "\n", 1))
    return F.lower(strip(F.regexp_replace(line, "[#*]", "")))


def excerpt_heading(content: Column) -> Column:
    word = _first_line_word(content)
    return (
        F.when(word == "abstract", "Abstract")
        .when(word == "introduction", "Introduction")
        .otherwise("Excerpt")
    )


def excerpt_body(content: Column) -> Column:
    body = strip(content)
    headed = _first_line_word(content).isin("abstract", "introduction") & body.contains("\n")
    return F.when(headed, strip(F.substr(body, F.instr(body, "\n") + 1))).otherwise(body)


def answer_blocks(answer: Column) -> Column:
    """Markdown answer -> array<struct<type, items>>; adjacent list lines share a block.

    Lines and starts are bound by `let`: named again inside a lambda they would be found
    anew for every line, which grows with the square of an answer's lines.
    """
    ul, ol = r"(?U)^[*-]\s+", r"(?U)^[0-9]+\.\s+"
    line = F.transform(F.split(answer, "\n"), strip)
    typed = F.transform(
        line,
        lambda s: F.struct(
            F.when(s == "", "blank").when(s.rlike(ul), "ul").when(s.rlike(ol), "ol").otherwise("p").alias("type"),
            s.alias("text"),
        ),
    )

    def starts(typed: Column) -> Column:
        """Start of a block: any paragraph, or a list line whose predecessor is of another type."""
        marked = F.transform(
            typed,
            lambda t, i: F.when(
                (t["type"] == "p")
                | (
                    t["type"].isin("ul", "ol")
                    & ((i == 0) | (F.get(typed, i - 1)["type"] != t["type"]))
                ),
                i,
            ),
        )
        return F.filter(marked, lambda i: i.isNotNull())

    def item(t: Column) -> Column:
        kind, text = t["type"], t["text"]
        return (
            F.when(kind == "ul", F.regexp_replace(text, ul, ""))
            .when(kind == "ol", F.regexp_replace(text, ol, ""))
            .otherwise(text)
        )

    def block(typed: Column, at: Column, end: Column) -> Column:
        lines = F.filter(F.slice(typed, at + 1, end - at), lambda t: t["type"] != "blank")
        return F.struct(F.get(typed, at)["type"].alias("type"), F.transform(lines, item).alias("items"))

    def cut(typed: Column) -> Column:
        def blocks(starts: Column) -> Column:
            return F.transform(
                starts, lambda at, j: block(typed, at, F.coalesce(F.get(starts, j + 1), F.size(typed)))
            )

        return let(starts(typed), blocks)

    return let(typed, cut)
