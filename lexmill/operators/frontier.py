"""Bounded discovery of links: breadth-first rounds of joins that give what a queue would."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .lineage import kept

_PATH = "array<long>"


def discover(links: DataFrame, seeds: DataFrame, candidate: Column, follow: Column, max_depth: int = 1, max_pages: int = 100, max_items: int = 0) -> tuple[DataFrame, DataFrame]:
    """(pages, items) that a queue would visit and find.

    ``links(page, position, target, title)`` holds the links of each page in
    order, ``seeds(page, position)`` the first pages in order. A page is read
    once, in the order of its first link from the pages before it, up to
    ``max_depth`` links from a seed and ``max_pages`` in all; pages without
    links are read, too. ``follow`` says of a link that its target may be read,
    ``candidate`` that it is an item; both are columns of ``links`` alone.

    ``pages(page, depth, path)``: the path holds the positions of the links that
    lead there, so paths of one depth are in the queue's order. ``items(url,
    title, depth, path)``: each target once, by its first link; ``max_items``
    (0: all) of them. Null pages and targets are never read nor found; of
    repeated rows the first counts; an empty table gives empty results. Each
    round is an equi-join of the links with the pages just read, an aggregation
    by target and an anti-join with the pages read before; no task or driver
    holds a level.
    """
    rows = links.select("page", F.col("position").cast("long").alias("position"), "target", "title", F.coalesce(candidate, F.lit(False)).alias("found"), F.coalesce(follow, F.lit(False)).alias("next"))
    rows = rows.where("page is not null and target is not null")
    level = seeds.where("page is not null").groupBy("page").agg(F.array(F.min(F.col("position").cast("long"))).alias("path"))
    done = items = None
    left = max_pages
    for depth in range(max_depth + 1):
        if left <= 0:
            break
        level = kept(level.orderBy("path").limit(left).select("page", F.lit(depth).alias("depth"), F.col("path").cast(_PATH).alias("path")))
        n = level.count()
        if not n:
            break
        left -= n
        done = level if done is None else done.unionAll(level)
        # a page of many links stays spread: the links' side of the join can be split
        out = rows.join(level.withColumnRenamed("page", "at"), F.col("page") == F.col("at")).select("target", "title", "found", "next", F.concat("path", F.array("position")).cast(_PATH).alias("path"))
        first = F.min(F.struct(F.lit(depth).alias("depth"), "path", "title")).alias("x")
        new = out.where("found").groupBy(F.col("target").alias("url")).agg(first)
        items = new if items is None else items.unionAll(new)
        level = out.where("next").groupBy(F.col("target").alias("page")).agg(F.min("path").alias("path")).join(done.select("page"), "page", "left_anti")
    if done is None:
        none = rows.where("false")
        return none.select("page", F.lit(0).alias("depth"), F.array("position").alias("path")), none.select(F.col("target").alias("url"), "title", F.lit(0).alias("depth"), F.array("position").alias("path"))
    items = items.groupBy("url").agg(F.min("x").alias("x")).select("url", "x.title", "x.depth", "x.path")
    return done, items.orderBy("depth", "path").limit(max_items) if max_items else items
