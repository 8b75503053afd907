"""Stored pages and sitemaps."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glyphlake import fixed_values as fv


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    """Page corpus (page_id, url, html) from parquet; empty bodies are dropped."""
    return spark.read.parquet(path).select("page_id", "url", "html").filter(F.trim("html") != "")


def textual_only(resources: DataFrame) -> DataFrame:
    """Rows whose content type or extension says text."""
    kind = F.lower(F.coalesce(F.col("content_type"), F.lit("")))
    return resources.filter(
        kind.startswith("text/") | kind.rlike("javascript|json|css") | F.col("url").rlike(fv.TEXT_RESOURCE)
    )


def sitemap_locations(spark: SparkSession, path: str) -> DataFrame:
    """``loc`` of all pages of a sitemap and of those it is an index of.

    Sitemaps that list sitemaps are followed level by level, each file once;
    what the driver holds are the addresses of files, one for up to 50,000
    pages, never the pages.  The XML source splits files by row tag, so one
    large sitemap is read in parallel.
    """
    read = lambda tag, files: spark.read.format("xml").option("rowTag", tag).schema("loc string").load(files)
    seen, level, out = set(), [path], None
    while level:
        seen.update(level)
        found = read("url", level)
        out = found if out is None else out.union(found)
        nested = [r["loc"] for r in read("sitemap", level).distinct().collect() if r["loc"]]
        level = sorted(set(nested) - seen)
    return out


def read_sitemap(spark: SparkSession, path: str, url_prefix: str) -> DataFrame:
    """Slugs of the entries below a prefix, lower-cased and distinct."""
    locations = sitemap_locations(spark, path)
    slug = F.lower(F.regexp_extract(F.substring_index("loc", url_prefix, -1), r"^([^/?#]+)", 1))
    return (
        locations.filter(F.col("loc").startswith(url_prefix))
        .select(slug.alias("slug"))
        .filter("slug <> ''")
        .distinct()
    )
