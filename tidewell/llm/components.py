"""Distributed union-find over links."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewell.session import materialise


def roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest index of each index's component, for the links of one task."""
    label = np.arange(n)
    while len(a):
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, label[a], low)
        np.minimum.at(new, label[b], low)
        while True:
            jumped = new[new]
            if (jumped == new).all():
                break
            new = jumped
        if (new == label).all():
            break
        label = new
    return label


def components(links: DataFrame) -> DataFrame:
    """(id, component) of every id in `links` (a, b); component is the smallest id.

    Large-star and small-star rounds turn each component into a star around its smallest
    id. A round combines minima before it shuffles and writes its links to the shared
    folder; its joins have one row per id on one side, so a hub is split by adaptive
    skew handling. Rounds end when nothing changes. Nulls and self-links are ignored.
    """
    star = materialise(
        links.where("a IS NOT NULL AND b IS NOT NULL AND a <> b")
        .select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        .distinct()
    )
    before = None
    while True:
        seen = star.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if seen == before:
            break
        before = seen
        both = star.unionByName(star.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("_m"))
        least = least.select(F.col("a"), F.least("a", "_m").alias("_m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("_m").alias("b")).distinct()
        low = large.groupBy("a").agg(F.min("b").alias("_m"))
        small = large.join(low, "a")
        star = materialise(
            small.where("b <> _m").select(F.col("b").alias("a"), F.col("_m").alias("b")).unionByName(low.select("a", F.col("_m").alias("b"))).distinct()
        )
    return star.select(F.col("a").alias("id"), F.col("b").alias("component")).unionByName(
        star.select(F.col("b").alias("id"), F.col("b").alias("component")).distinct()
    )
