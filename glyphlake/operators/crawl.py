"""Bounded expansion of a stored link graph."""

from __future__ import annotations

import itertools

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glyphlake import fixed_values as fv
from glyphlake.functions import urls
from glyphlake.session import cut_lineage

C = F.col


#: links of a page from which on they are dealt over several partitions
HUB_LINKS = 100_000
#: hubs that are few enough to be sent to every task
FEW_HUBS = 10_000


def laid_out(links: DataFrame, hub_links: int = HUB_LINKS) -> tuple[DataFrame, DataFrame | None]:
    """The links (url, link, pos, part), partitioned by page and part, once;
    joins by page and part leave them where they are.  A page with more than
    ``hub_links`` links has several parts: (url, parts), or None without hubs."""
    # written first, so that the links are extracted once
    edges = cut_lineage(links.select("url", "link", "pos"))
    counts = edges.groupBy("url").agg(F.count("*").alias("_n")).filter(C("_n") > hub_links)
    hubs = None if counts.isEmpty() else cut_lineage(counts.select("url", F.ceil(C("_n") / hub_links).cast("int").alias("parts")))
    if hubs is None:
        edges = edges.withColumn("part", F.lit(0))
    else:
        known = F.broadcast(hubs) if hubs.count() <= FEW_HUBS else hubs
        part = F.pmod(F.xxhash64("link"), F.coalesce("parts", F.lit(1))).cast("int")
        edges = edges.join(known, "url", "left").select("url", "link", "pos", part.alias("part"))
    width = int(links.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return cut_lineage(edges.repartition(width, "url", "part")), hubs


def linked_from(pages: DataFrame, edges: DataFrame, hubs: DataFrame | None) -> DataFrame:
    """``pages`` with the links of ``laid_out`` that lead away from them."""
    if hubs is None:
        asked = pages.withColumn("part", F.lit(0))
    else:
        parts = F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1)
        asked = pages.join(hubs, "url", "left").withColumn("part", F.explode(parts)).drop("parts")
    return asked.join(edges, ["url", "part"]).drop("part")


def expand_link_graph(
    seeds: DataFrame, links: DataFrame, stored: DataFrame, max_depth: int | None = None, max_pages: int | None = None,
    include: list[str] = fv.CRAWL_INCLUDE, exclude: list[str] = fv.CRAWL_EXCLUDE, hub_links: int = HUB_LINKS,
) -> DataFrame:
    """Visit ``seeds`` (url, pos) and what they link to, breadth first.

    ``links``: admitted (url, link, pos) of stored pages; ``stored``: (url).
    All pages that links lead to are reached; a caller may ask for those within
    ``max_depth`` links, or for the first ``max_pages`` in crawl order.  A
    page's place in the order is the list of link positions that led to it, so
    no global numbering is needed; each level is checkpointed, and pages seen
    before are removed by an anti-join.  Links are shuffled once, before the
    first level; then only pages move.
    """
    edges, hubs = laid_out(links, hub_links)
    matched = urls.matches_patterns(C("url"), include, exclude)
    queued = cut_lineage(
        seeds.groupBy("url").agg(F.min("pos").alias("pos"))
        .select("url", F.array(C("pos").cast("long")).alias("place"), F.lit(0).alias("depth"), F.lit(None).cast("string").alias("parent"))
    )
    if max_pages is not None:
        queued = cut_lineage(queued.orderBy("place").limit(max_pages))
    seen, total = queued, queued.count()
    frontier = queued
    for depth in itertools.count(1):
        if max_depth is not None and depth > max_depth or max_pages is not None and total >= max_pages:
            break
        reached = linked_from(frontier.select("url", "place"), edges, hubs).select(
            C("link").alias("url"), F.concat("place", F.array(C("pos").cast("long"))).alias("place"), C("url").alias("parent")
        )
        first = reached.groupBy("url").agg(F.min(F.struct("place", "parent")).alias("f")).select(
            "url", "f.place", F.lit(depth).alias("depth"), "f.parent"
        )
        fresh = cut_lineage(first.join(seen.select("url"), "url", "left_anti"))
        found = fresh.count()
        if found == 0:
            break
        if max_pages is not None and total + found > max_pages:
            fresh, found = cut_lineage(fresh.orderBy("place").limit(max_pages - total)), max_pages - total
        frontier, seen, total = fresh, seen.unionByName(fresh), total + found
    per_part = edges.groupBy("url", "part").agg(F.count_distinct("link").alias("_links"))
    discovered = per_part.groupBy("url").agg(F.sum("_links").alias("discovered"))
    enqueued = seen.filter("parent is not null").groupBy(C("parent").alias("url")).agg(F.count("*").alias("enqueued"))
    return (
        seen.join(stored.select("url", F.lit(True).alias("ok")).distinct(), "url", "left")
        .join(discovered, "url", "left")
        .join(enqueued, "url", "left")
        .select(
            "url", "depth", "place", F.coalesce("ok", F.lit(False)).alias("ok"),
            F.coalesce("discovered", F.lit(0)).alias("discovered"), F.coalesce("enqueued", F.lit(0)).alias("enqueued"),
            matched.alias("matched"),
        )
    )


def crawl_summary(
    results: DataFrame, links: DataFrame, include: list[str] = fv.CRAWL_INCLUDE, exclude: list[str] = fv.CRAWL_EXCLUDE
) -> DataFrame:
    """One row about a crawl: what was visited, what its pages link to beyond
    that (``queued``), and the catalogue URLs among both."""
    visited = results.agg(
        F.count("*").alias("visited"),
        F.count_if("matched").alias("_visited_matches"),
        F.count_if("ok").alias("ok_count"),
        F.count_if(~C("ok")).alias("fail_count"),
        F.max("depth").alias("deepest"),
    )
    seen = results.select("url")
    open_ = links.select("url", "link").join(seen, "url", "left_semi").select(C("link").alias("url")).distinct().join(seen, "url", "left_anti")
    waiting = open_.agg(F.count("*").alias("queued"), F.count_if(urls.matches_patterns(C("url"), include, exclude)).alias("_open_matches"))
    # one row each
    both = visited.withColumn("_one", F.lit(1)).join(waiting.withColumn("_one", F.lit(1)), "_one")
    return both.select("visited", "queued", (C("_visited_matches") + C("_open_matches")).alias("catalog_urls"), "ok_count", "fail_count", "deepest")
