"""Written results: format folders, reports, event logs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glyphlake.functions.files import format_folder


def write_by_format(df: DataFrame, path: str) -> None:
    """Lay rows out in one folder per format; every task writes its own files."""
    df.withColumn("format_dir", format_folder(F.col("ext"))).write.mode("overwrite").partitionBy("format_dir").parquet(path)


def write_report(summary: DataFrame, results: DataFrame, path: str) -> None:
    """A report is a folder: summary rows and result rows as JSON lines.

    Results stay a distributed dataset; they are never folded into one value.
    """
    summary.write.mode("overwrite").json(f"{path}/summary")
    results.write.mode("overwrite").json(f"{path}/results")


def read_report(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    return spark.read.json(f"{path}/summary"), spark.read.json(f"{path}/results")


def append_telemetry(events: DataFrame, path: str) -> None:
    """Append (ts, run_id, event, payload) rows to a JSON-lines log."""
    events.select("ts", "run_id", "event", "payload").write.mode("append").json(path)


def write_sitemaps(pages: DataFrame, path: str, files: int) -> str:
    """Write (loc) rows as ``files`` sitemaps and an index of them; its path."""
    spark = pages.sparkSession
    dealt = pages.withColumn("_file", F.pmod(F.xxhash64("loc"), F.lit(files)))
    places = [f"{path}/part-{n}.xml" for n in range(files)]
    for n, place in enumerate(places):
        dealt.filter(F.col("_file") == n).select("loc").write.format("xml").option("rootTag", "urlset").option("rowTag", "url").save(place)
    index = spark.createDataFrame([(p,) for p in places], "loc string")
    index.coalesce(1).write.format("xml").option("rootTag", "sitemapindex").option("rowTag", "sitemap").save(f"{path}/index.xml")
    return f"{path}/index.xml"
