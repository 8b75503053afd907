"""Folder trees held as adjacency rows (id, parent_id, name, kind, size)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glyphlake.session import cut_lineage

C = F.col


def tree_listing(nodes: DataFrame) -> DataFrame:
    """(id, depth, path, line): depth from the root and an indented line.

    One join per level; a tree has few levels.
    """
    level = nodes.filter("parent_id is null").select("id", "name", F.lit(0).alias("depth"), C("name").alias("path"))
    out = level
    while True:
        below = (
            nodes.select("id", "name", "parent_id")
            .join(level.select(C("id").alias("parent_id"), "depth", C("path").alias("above")), "parent_id")
            .select("id", "name", (C("depth") + 1).alias("depth"), F.concat_ws("/", "above", "name").alias("path"))
        )
        level = cut_lineage(below)
        if level.isEmpty():
            break
        out = out.unionByName(level)
    return out.select("id", "depth", "path", F.concat(F.repeat(F.lit("  "), C("depth")), "name").alias("line"))


def directory_rollup(nodes: DataFrame) -> DataFrame:
    """Direct and total file counts, folder counts and sizes per folder.

    Sums climb one level at a time and are combined per folder before each
    climb, so the root never receives more than one row per child.  In a tree
    every climb reaches fewer folders than the one before; where one does not,
    the folders still reached have a cycle below them, and no totals.
    """
    folder = C("kind") == "folder"
    direct = nodes.filter("parent_id is not null").groupBy(C("parent_id").alias("id")).agg(
        F.count_if(~folder).alias("files"), F.count_if(folder).alias("dirs"), F.sum("size").alias("size")
    )
    parents = nodes.filter("parent_id is not null").select("id", "parent_id")
    carry, totals, reached, endless = direct, direct, None, None
    while endless is None:
        climbed = carry.join(parents, "id").groupBy(C("parent_id").alias("id")).agg(
            *[F.sum(c).alias(c) for c in ("files", "dirs", "size")]
        )
        carry = cut_lineage(climbed)
        before, reached = reached, carry.count()
        if reached == 0:
            break
        if reached == before:
            endless = carry.select("id")
        totals = totals.unionByName(carry)
    if endless is not None:
        totals = totals.join(endless, "id", "left_anti")
    summed = totals.groupBy("id").agg(*[F.sum(c).alias(f"total_{c}") for c in ("files", "dirs", "size")])
    folders = nodes.filter(folder).select("id", "name")
    full = folders.join(direct, "id", "left").join(summed, "id", "left").na.fill(0)
    if endless is None:
        return full
    flagged = full.join(endless.withColumn("_endless", F.lit(True)), "id", "left")
    return flagged.select("id", "name", "files", "dirs", "size", *[F.when(C("_endless").isNull(), C(f"total_{c}")).alias(f"total_{c}") for c in ("files", "dirs", "size")])
