"""Masking of personal data, one projection per pattern so nothing is evaluated twice."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewell import constants as K
from tidewell.functions.rows import explode_rows
from tidewell.functions.text import rewrite_matches

LABELS = tuple(K.PII_PATTERNS)
#: What a text must hold for a pattern to match; looked for first, as patterns are slow.
NEEDS = {"email": "_at", "phone": "_digit", "ssn_aadhaar": "_digit", "credit_card": "_digit", "ip": "_digit"}


def _pattern(label: str) -> str:
    return "(?U)" + K.PII_PATTERNS[label]


def luhn_valid(number: Column) -> Column:
    """13 to 16 digits whose mod-10 checksum is zero; other characters are ignored."""
    digits = F.regexp_extract_all(number, F.lit(r"[0-9]"), F.lit(0))
    n = F.size(digits)
    doubled = F.transform(
        digits,
        lambda d, i: F.when(
            i % 2 == n % 2,
            d.cast("int") * 2 - F.when(d.cast("int") > 4, 9).otherwise(0),
        ).otherwise(d.cast("int")),
    )
    total = F.aggregate(doubled, F.lit(0), lambda acc, x: acc + x)
    return n.between(13, 16) & (total % 10 == 0)


def card_matches(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(_pattern("credit_card")), F.lit(0))


def mask_pii(
    df: DataFrame,
    text: str,
    masked: str = "masked",
    count: str = "pii_count",
    order: Sequence[str] = LABELS,
    per_label: bool = False,
) -> DataFrame:
    """Replace each finding by `[LABEL]`; later patterns see the text already masked.

    The default order lets the phone rule take most of a 16-digit card; pass
    `order` with `credit_card` first to keep cards whole. A card counts only when
    its checksum holds. `per_label` adds one `n_<label>` column per pattern.
    """
    # Masking adds no digit and no `@`, so what the text lacks from the start is never found later.
    out = df.withColumn(masked, F.col(text)).withColumn("_digit", F.col(masked).rlike(r"(?U)\d"))
    out = out.withColumn("_at", F.col(masked).contains("@"))
    for label in order:
        source, after = F.col(masked), F.col("_after")
        pattern = _pattern(label)
        token = f"[{label.upper()}]"
        if label == "credit_card":
            hits = F.size(F.filter(card_matches(source), luhn_valid))
            replaced = rewrite_matches(
                source, pattern, lambda m, t=token: F.when(luhn_valid(m), t).otherwise(m)
            )
        else:
            hits = F.regexp_count(source, F.lit(pattern))
            replaced = F.regexp_replace(source, pattern, token)
        # A finding never equals its token, so a text that stays as it is holds none to count.
        out = out.withColumn("_after", F.when(F.col(NEEDS[label]), replaced).otherwise(source))
        out = out.withColumns({f"n_{label}": F.when(after != source, hits).otherwise(0), masked: after})
    out = out.drop("_digit", "_at", "_after")
    total = sum((F.col(f"n_{label}") for label in order[1:]), F.col(f"n_{order[0]}"))
    out = out.withColumn(count, total)
    return out if per_label else out.drop(*[f"n_{label}" for label in order])


def pii_report(docs: DataFrame, text: str, keys: list[str]) -> DataFrame:
    """Documents and findings per key and label, long form."""
    counted = mask_pii(docs, text, per_label=True)
    pairs = F.array(
        *[
            F.struct(F.lit(label).alias("label"), F.col(f"n_{label}").alias("n"))
            for label in LABELS
        ]
    )
    return (
        explode_rows(counted, keys, pairs, "e")
        .groupBy(*keys, F.col("e.label").alias("label"))
        .agg(
            F.sum(F.col("e.n").cast("long")).alias("entities"),
            F.sum((F.col("e.n") > 0).cast("long")).alias("documents"),
        )
    )
