"""Shards by proportional stratified interleaving, in DataFrame operations only.

Rows of each source are put into a seeded order, and a row of rank k among n
gets the fraction (k + 1/2) / n.  Sorting all rows by that fraction deals the
sources out in proportion, and every contiguous cut of the sorted rows holds
the mixture of the whole to within a row per source.  The cuts are made by
count, so the sizes of shards differ by one row at most (law ``rows``).

No window spans a source or the table: ranks are counted within buckets of
bounded size, and a running sum over the bucket counts gives each bucket the
rank it starts from.  Texts stay where they are read; only small rows move.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from glyphlake.llm.common import fresh, staged, whole

ROWS_PER_BUCKET = 50_000


def seeded_key(doc_id: Column, seed: int) -> Column:
    """60 bits of the MD5 of seed and id: an order any engine can repeat."""
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("null"))).cast("binary"))
    return F.conv(F.substring(digest, 1, 15), 16, 10).cast("long")


def interleaved(docs: DataFrame, shards: int, seed: int = 0, rows_per_bucket: int = ROWS_PER_BUCKET) -> DataFrame:
    """One row per document: its shard and its slot in the shard.

    A null source is a source of its own, a null text has no bytes, and a null
    id has a place like any other.  Rows that agree in id, text and source are
    interchangeable.  With fewer rows than shards the rest stay empty; an empty
    table gives no rows.  Columns beyond doc_id, text, source are not read.

    Returns doc_id, size, text_crc32, law, shard, slot, grown_shard.
    """
    rows = staged(
        docs.select(
            F.col("doc_id").cast("long").alias("doc_id"),
            F.coalesce(F.col("source"), F.lit("")).alias("_source"),
            F.col("source").isNull().alias("_unknown"),
            (F.octet_length(whole(F.col("text"))) + 16).cast("long").alias("size"),
            F.crc32(whole(F.col("text")).cast("binary")).alias("text_crc32"),
            seeded_key(F.col("doc_id"), seed).alias("_key"),
        )
    )
    total = rows.count()
    buckets = max(16, -(-total // rows_per_bucket))

    stratum = ["_unknown", "_source"]
    rows = rows.withColumn("_bucket", F.pmod("_key", F.lit(buckets)))
    running = Window.partitionBy(*stratum).orderBy("_bucket")
    starts = (
        rows.groupBy(*stratum, "_bucket")
        .agg(F.count("*").alias("_n"))
        .withColumn("_start", F.sum("_n").over(running.rowsBetween(Window.unboundedPreceding, 0)) - F.col("_n"))
        .withColumn("_of", F.sum("_n").over(Window.partitionBy(*stratum)))
        .drop("_n")
    )
    inside = Window.partitionBy(*stratum, "_bucket").orderBy("_key", F.col("doc_id").asc_nulls_last(), "text_crc32", "size")
    ranked = (
        rows.join(starts, [*stratum, "_bucket"])
        .withColumn("_rank", F.col("_start") + F.row_number().over(inside) - 1)
        .withColumn("_fraction", (F.col("_rank") + F.lit(0.5)) / F.col("_of"))
        .withColumn("_slice", F.floor(F.col("_fraction") * buckets))
        .select("doc_id", "size", "text_crc32", *stratum, "_rank", "_fraction", "_slice")
    )
    ranked = staged(ranked)
    # one row per slice here, never one per document
    offsets = (
        ranked.groupBy("_slice")
        .agg(F.count("*").alias("_n"))
        .withColumn("_offset", F.sum("_n").over(Window.orderBy("_slice").rowsBetween(Window.unboundedPreceding, 0)) - F.col("_n"))
        .drop("_n")
    )
    dealt = Window.partitionBy("_slice").orderBy("_fraction", *stratum, "_rank")
    place = F.col("_offset") + F.row_number().over(dealt) - 1
    count = F.lit(max(total, 1))
    return (
        ranked.join(offsets, "_slice")
        .withColumn("_place", place)
        .withColumn("shard", F.expr(f"(_place * {shards}) div {max(total, 1)}").cast("int"))
        .select(
            "doc_id",
            "size",
            "text_crc32",
            F.lit("rows").alias("law"),
            "shard",
            (F.col("_place") - F.ceil(F.col("shard") * count / shards)).cast("long").alias("slot"),
            F.lit(None).cast("int").alias("grown_shard"),
        )
    )


def write_shards(docs: DataFrame, path: str, shards: int, seed: int = 0) -> None:
    """Write the documents themselves, one folder per shard, in slot order.

    Rows that repeat an id go to one place; columns shard and slot are new."""
    (key,) = fresh(docs, "_key")
    plan = interleaved(docs.dropDuplicates(["doc_id"]), shards, seed).select(F.col("doc_id").alias(key), "shard", "slot")
    placed = docs.drop("shard", "slot").join(plan, F.col("doc_id").cast("long").eqNullSafe(F.col(key))).drop(key)
    placed.repartition("shard").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)
