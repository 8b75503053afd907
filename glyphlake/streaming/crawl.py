"""A crawl that goes on as pages arrive, and after it was stopped.

State is three tables in one folder, each with a folder per micro-batch that
the batch overwrites when it is run again; a batch reads only what earlier
batches wrote.  So a retry, a lost executor or a restart changes nothing.

    pages     page, page_id, links   what was visited, each arrival once
    links     url, link, pos         the admitted links of those pages
    frontier  url, depth, place, parent   what a batch found first, or found a
              better way to than earlier batches had

A url's row is the least of its frontier rows, by depth and then by place, the
list of link positions that lead to it.  Pages come in any order, so a batch
follows its improvements through all links known so far; after the last batch
the frontier is that of a breadth-first expansion of all pages at once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from glyphlake import fixed_values as fv
from glyphlake.functions import urls
from glyphlake.operators import links as lk
from glyphlake.session import cut_lineage, deal_out
from glyphlake.streaming.jobs import read_batches

C = F.col
PAGES, LINKS, FRONTIER = (
    "page string, page_id long, links long",
    "url string, link string, pos int",
    "url string, depth int, place array<long>, parent string",
)


def _table(spark: SparkSession, path: str, name: str, schema: str, before: int | None = None) -> DataFrame:
    """All batches of a table, or those before a batch; without any, no rows."""
    rows = read_batches(spark, f"{path}/{name}", schema)
    return (rows if before is None else rows.filter(C("batch") < before)).drop("batch")


def _keep(rows: DataFrame, path: str, name: str, batch_id: int) -> None:
    rows.write.mode("overwrite").parquet(f"{path}/{name}/batch={batch_id}")


def _least(rows: DataFrame) -> DataFrame:
    """The first way to each url: least depth, then place, then parent."""
    way = F.min(F.struct("depth", "place", "parent")).alias("way")
    return rows.groupBy("url").agg(way).select("url", "way.*")


def visited(spark: SparkSession, path: str) -> DataFrame:
    """Pages handled so far, with their admitted link counts."""
    return _table(spark, path, "pages", PAGES)


def frontier(spark: SparkSession, path: str) -> DataFrame:
    """Every url found so far: its depth, its place and what led to it."""
    return _least(_table(spark, path, "frontier", FRONTIER))


def queue(spark: SparkSession, path: str) -> DataFrame:
    """What was found and is still to be visited, in the order of a crawl."""
    done = visited(spark, path).select(C("page").alias("url"))
    return frontier(spark, path).join(done, "url", "left_anti")


def results(spark: SparkSession, path: str, include: list[str] = fv.CRAWL_INCLUDE, exclude: list[str] = fv.CRAWL_EXCLUDE) -> DataFrame:
    """One row per url found: depth, place, whether its page was visited, links
    on it, urls first found through it, and whether it is a catalogue URL."""
    found = frontier(spark, path)
    links = _table(spark, path, "links", LINKS).groupBy("url").agg(F.count_distinct("link").alias("discovered"))
    enqueued = found.filter("parent is not null").groupBy(C("parent").alias("url")).agg(F.count("*").alias("enqueued"))
    pages = visited(spark, path).select(C("page").alias("url"), F.lit(True).alias("ok")).distinct()
    return found.join(pages, "url", "left").join(links, "url", "left").join(enqueued, "url", "left").select(
        "url", "depth", "place", F.coalesce("ok", F.lit(False)).alias("ok"),
        F.coalesce("discovered", F.lit(0)).alias("discovered"), F.coalesce("enqueued", F.lit(0)).alias("enqueued"),
        urls.matches_patterns(C("url"), include, exclude).alias("matched"),
    )


def catalog_urls(spark: SparkSession, path: str) -> DataFrame:
    """The catalogue URLs among all that was found."""
    return results(spark, path).filter("matched").select("url", "depth", "ok")


def handle_pages(batch: DataFrame, seeds: DataFrame, domains: DataFrame | None, path: str, batch_id: int, max_depth: int | None = None) -> None:
    """Visit the pages of a batch that no earlier batch visited, and extend the
    frontier by what they link to, within ``max_depth`` links of ``seeds``
    (url, pos)."""
    spark = batch.sparkSession
    # a page that arrives again is not visited again; pages of one url all are
    # texts are sorted to find equal keys: a task gets a fixed share of them
    keyed = deal_out(batch.withColumn("page", urls.normalize_crawl_url(C("url"))), "page", "page_id")
    pages = keyed.dropDuplicates(["page", "page_id"])
    pages = cut_lineage(pages.join(_table(spark, path, "pages", PAGES, batch_id), ["page", "page_id"], "left_anti"))
    found = cut_lineage(lk.crawl_admission(lk.extract_links(pages), domains).select("page_id", urls.normalize_crawl_url(C("url")).alias("url"), "link", C("pos").cast("int").alias("pos")))
    _keep(found.drop("page_id"), path, "links", batch_id)
    counts = found.groupBy("page_id").agg(F.count("*").alias("links"))
    _keep(pages.select("page", "page_id").join(counts, "page_id", "left").select("page", "page_id", F.coalesce("links", F.lit(0)).alias("links")), path, "pages", batch_id)

    links = _table(spark, path, "links", LINKS, batch_id).unionByName(found.drop("page_id"))
    known = cut_lineage(_least(_table(spark, path, "frontier", FRONTIER, batch_id)))
    start = seeds.select("url", F.lit(0).alias("depth"), F.array(C("pos").cast("long")).alias("place"), F.lit(None).cast("string").alias("parent"))
    better = cut_lineage(_improved(_least(start), known))
    # known urls whose pages arrived now lead on as they are
    moved = better.unionByName(known.join(pages.select(C("page").alias("url")), "url", "left_semi"))
    known = _least(known.unionByName(better))
    while not moved.isEmpty():
        ways = moved if max_depth is None else moved.filter(C("depth") < max_depth)
        reached = ways.withColumnRenamed("parent", "_parent").join(links, "url").select(
            C("link").alias("url"), (C("depth") + 1).alias("depth"), F.concat("place", F.array(C("pos").cast("long"))).alias("place"), C("url").alias("parent")
        )
        moved = cut_lineage(_improved(_least(reached), known))
        better, known = better.unionByName(moved), cut_lineage(_least(known.unionByName(moved)))
    _keep(_least(better), path, "frontier", batch_id)


def _improved(found: DataFrame, known: DataFrame) -> DataFrame:
    """The rows of ``found`` that are new or come before what is known."""
    way = lambda t: F.struct(*(C(f"{t}.{c}") for c in ("depth", "place", "parent")))
    both = found.alias("f").join(known.alias("k"), C("f.url") == C("k.url"), "left")
    return both.filter(C("k.url").isNull() | (way("f") < way("k"))).select("f.*")


def incremental_crawl(
    pages: DataFrame, seeds: DataFrame, domains: DataFrame | None, path: str, checkpoint: str, max_depth: int | None = None
) -> StreamingQuery:
    """Run ``handle_pages`` over a stream of (page_id, url, html) until it is drained."""
    return (
        pages.writeStream.option("checkpointLocation", checkpoint)
        .foreachBatch(lambda batch, batch_id: handle_pages(batch, seeds, domains, path, batch_id, max_depth))
        .trigger(availableNow=True).start()
    )
