"""Breadth-first link closure over a table of fetched pages."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewell.functions.rows import explode_rows

from tidewell.session import materialise
from tidewell.sources.html import html_links


def crawl_frontier(
    pages: DataFrame, seeds: DataFrame, max_depth: int = 3, url: str = "url", html: str = "html"
) -> DataFrame:
    """Visited urls with their depth and whether the page table holds them.

    Links stay on the host of their page. A page is expanded once, and only below
    `max_depth`. Each level joins the frontier with the links and drops what was
    visited; levels are written out so the plan does not grow with depth.
    """
    found = explode_rows(pages, [F.col(url).alias("_from")], html_links(url, html), "_to")
    links = materialise(found.drop("pos").distinct())
    known = pages.select(F.col(url).alias("url")).distinct().withColumn("fetched", F.lit(True))
    level = seeds.select("url").distinct().withColumn("depth", F.lit(0))
    visited = level
    for depth in range(1, max_depth + 1):
        found = level.join(links, level["url"] == links["_from"]).select(F.col("_to").alias("url")).distinct()
        level = materialise(
            found.join(visited, "url", "left_anti").withColumn("depth", F.lit(depth))
        )
        visited = visited.unionByName(level)
    return visited.join(known, "url", "left").withColumn(
        "fetched", F.coalesce("fetched", F.lit(False))
    )
