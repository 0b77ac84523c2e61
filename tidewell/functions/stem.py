"""English stems by the published Snowball English rules (Porter 2), as columns.

The rules run as projections over a column of lower-case words, one per step, so nothing
leaves the JVM. Regions R1 and R2 are kept as positions, which no step moves.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Words with a stem of their own, and words left alone
_SPECIAL = {
    "skis": "ski",
    "skies": "sky",
    "dying": "die",
    "lying": "lie",
    "tying": "tie",
    "idly": "idl",
    "gently": "gentl",
    "ugly": "ugli",
    "early": "earli",
    "only": "onli",
    "singly": "singl",
    "sky": "sky",
    "news": "news",
    "howe": "howe",
    "atlas": "atlas",
    "cosmos": "cosmos",
    "bias": "bias",
    "andes": "andes",
}
_DONE_AFTER_PLURAL = ["inning", "outing", "canning", "herring", "earring", "proceed", "exceed", "succeed"]

# Suffixes rewritten in R1 by the second step
_STEP2 = {
    "tional": "tion",
    "enci": "ence",
    "anci": "ance",
    "abli": "able",
    "entli": "ent",
    "izer": "ize",
    "ization": "ize",
    "ational": "ate",
    "ation": "ate",
    "ator": "ate",
    "alism": "al",
    "aliti": "al",
    "alli": "al",
    "fulness": "ful",
    "ousli": "ous",
    "ousness": "ous",
    "iveness": "ive",
    "iviti": "ive",
    "biliti": "ble",
    "bli": "ble",
    "ogi": "og",
    "fulli": "ful",
    "lessli": "less",
    "li": "",
}

# Suffixes rewritten in R1 by the third step
_STEP3 = {
    "tional": "tion",
    "ational": "ate",
    "alize": "al",
    "icate": "ic",
    "iciti": "ic",
    "ical": "ic",
    "ful": "",
    "ness": "",
    "ative": "",
}

# Suffixes dropped in R2 by the fourth step
_STEP4 = [
    "al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ism", "ate",
    "iti", "ous", "ive", "ize", "ion",
]

_V = "[aeiouy]"
_C = "[^aeiouy]"
_REGION = f"^{_C}*{_V}+{_C}"
_SHORT_END = rf"({_C}{_V}[^aeiouywxY]|^{_V}{_C})$"


def _cut(w: Column, suffix: str, new: str = "") -> Column:
    return F.concat(F.left(w, F.length(w) - len(suffix)), F.lit(new))


def _longest(w: Column, rules: dict[str, Column]) -> Column:
    """The rule of the longest suffix the word has; no other rule is tried."""
    out = w
    for suffix in sorted(rules, key=len):
        out = F.when(w.endswith(suffix), rules[suffix]).otherwise(out)
    return out


def stem_words(df: DataFrame, word: str, out: str) -> DataFrame:
    """Add `out`, the stem of each lower-case word; other scripts pass through."""
    w, p1, p2 = F.col("_w"), F.col("_p1"), F.col("_p2")

    def region(suffix: str, start: Column) -> Column:
        return F.length(w) - len(suffix) >= start

    def end_of(text: Column) -> Column:
        found = F.length(F.regexp_extract(text, _REGION, 0))
        return F.when(found > 0, found).otherwise(F.length(text))

    # y counts as a consonant, written Y, at the start and after a vowel.
    marked = F.regexp_replace(F.col(word), "(^y|(?<=[aeiouy])y)", "Y")
    first = F.regexp_extract(w, "^(gener|commun|arsen)", 1)
    steps: list[dict[str, Column]] = [
        {"_w": marked},
        {"_p1": F.when(first != "", F.length(first)).otherwise(end_of(w))},
        {"_p2": p1 + end_of(F.substr(w, p1 + 1))},
    ]
    plural = _longest(
        w,
        {
            "sses": _cut(w, "es"),
            "ied": F.when(F.length(w) > 4, _cut(w, "ed")).otherwise(_cut(w, "d")),
            "ies": F.when(F.length(w) > 4, _cut(w, "es")).otherwise(_cut(w, "s")),
            "us": w,
            "ss": w,
            "s": F.when(w.rlike(f"{_V}.+s$"), _cut(w, "s")).otherwise(w),
        },
    )
    steps += [{"_w": plural}, {"_stop": w.isin(*_DONE_AFTER_PLURAL)}]

    def dropped(suffix: str) -> Column:
        rest = _cut(w, suffix)
        short = rest.rlike(_SHORT_END) & (F.length(rest) <= p1)
        tidy = (
            F.when(rest.rlike("(at|bl|iz)$"), F.concat(rest, F.lit("e")))
            .when(rest.rlike("(bb|dd|ff|gg|mm|nn|pp|rr|tt)$"), F.left(rest, F.length(rest) - 1))
            .when(short, F.concat(rest, F.lit("e")))
            .otherwise(rest)
        )
        return F.when(rest.rlike(_V), tidy).otherwise(w)

    past = {s: F.when(region(s, p1), _cut(w, s, "ee")).otherwise(w) for s in ("eed", "eedly")}
    past |= {s: dropped(s) for s in ("ed", "edly", "ing", "ingly")}
    final_y = F.when(w.rlike(f".{_C}[yY]$"), _cut(w, "y", "i")).otherwise(w)

    second = {}
    for suffix, new in _STEP2.items():
        ok = region(suffix, p1)
        if suffix == "ogi":
            ok = ok & w.endswith("logi")
        if suffix == "li":
            ok = ok & w.rlike("[cdeghkmnrt]li$")
        second[suffix] = F.when(ok, _cut(w, suffix, new)).otherwise(w)
    third = {
        s: F.when(region(s, p1) & (region(s, p2) if s == "ative" else F.lit(True)), _cut(w, s, new)).otherwise(w)
        for s, new in _STEP3.items()
    }
    fourth = {
        s: F.when(region(s, p2) & (w.rlike("[st]ion$") if s == "ion" else F.lit(True)), _cut(w, s)).otherwise(w)
        for s in _STEP4
    }
    before_e = _cut(w, "e")
    drop_e = region("e", p2) | (region("e", p1) & ~before_e.rlike(_SHORT_END))
    fifth = (
        F.when(w.endswith("e"), F.when(drop_e, before_e).otherwise(w))
        .when(w.endswith("ll") & region("l", p2), _cut(w, "l"))
        .otherwise(w)
    )
    later = [_longest(w, past), final_y, _longest(w, second), _longest(w, third), _longest(w, fourth), fifth]
    steps += [{"_w": F.when(F.col("_stop"), w).otherwise(step)} for step in later]

    special = F.create_map(*[F.lit(x) for pair in _SPECIAL.items() for x in pair])
    kept = F.length(word) <= 2
    stem = F.coalesce(
        F.try_element_at(special, F.col(word)),
        F.when(kept, F.col(word)).otherwise(F.replace(w, F.lit("Y"), F.lit("y"))),
    )
    staged = reduce(lambda d, s: d.withColumns(s), steps, df)
    return staged.withColumn(out, stem).drop("_w", "_p1", "_p2", "_stop")
