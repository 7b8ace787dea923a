"""Rounds of a crawl over stored pages: targets, the pages they match, and the targets that those pages lead to."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from brightloom.plans.shared import Scratch


def crawl(seeds: DataFrame, pages: DataFrame, links: DataFrame, depth: int, visited: DataFrame | None = None, links_per_page: int | None = None) -> DataFrame:
    """``entity, page, depth, priority, target`` of every page that an entity's crawl reaches.

    ``seeds(entity, target, priority)`` are asked first; ``pages(page, target)``
    says which targets a page answers; ``links(page, target, priority)`` what it
    leads to. A target is asked once for an entity, a page read once, in the
    round that reaches it first, by its target of the least priority (then the
    first by name). Pages of ``visited(entity, page)`` are not read again and
    lead nowhere. A round's follow-ups of a page are the first
    ``links_per_page`` by priority, if given. ``depth`` counts the rounds, seeds
    being the first. Nulls match nothing.
    """
    scratch = Scratch(seeds.sparkSession, "crawl")
    pages = scratch.keep(pages.select("page", "target").where("target IS NOT NULL").distinct(), "pages")
    links = links.select("page", "target", "priority").where("target IS NOT NULL").groupBy("page", "target").agg(F.min("priority").alias("priority"))
    if links_per_page is not None:
        first = Window.partitionBy("page").orderBy("priority", "target")
        links = links.withColumn("nth", F.row_number().over(first)).where(F.col("nth") <= links_per_page).drop("nth")
    links = scratch.keep(links, "links")
    asked = scratch.keep(seeds.where("entity IS NOT NULL AND target IS NOT NULL").groupBy("entity", "target").agg(F.min("priority").alias("priority")), "asked1")
    told = scratch.keep(visited.select("entity", "page").distinct(), "told0") if visited is not None else None
    new, read = asked, None
    for turn in range(1, depth + 1):
        # Plain scans on both sides: a target that many pages answer can be split.
        hits = new.join(pages, "target")
        if told is not None:
            hits = hits.join(told, ["entity", "page"], "left_anti")
        best = hits.groupBy("entity", "page").agg(F.min(F.struct("priority", "target")).alias("b"))
        found = scratch.keep(best.select("entity", "page", F.lit(turn).alias("depth"), F.col("b.priority").alias("priority"), F.col("b.target").alias("target")), f"found{turn}")
        read = found if read is None else read.unionByName(found)
        if turn == depth or found.isEmpty():
            break
        told = found.select("entity", "page") if told is None else told.unionByName(found.select("entity", "page"))
        leads = found.select("entity", "page").join(links, "page").groupBy("entity", "target").agg(F.min("priority").alias("priority"))
        new = scratch.keep(leads.join(asked.select("entity", "target"), ["entity", "target"], "left_anti"), f"new{turn}")
        asked = scratch.keep(asked.unionByName(new), f"asked{turn + 1}")
        scratch.drop(f"asked{turn}")
    return read
