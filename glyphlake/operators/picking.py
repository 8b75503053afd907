"""First, best and top rows per key, written so that hot keys stay cheap."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def computed(df: DataFrame, **columns: Column) -> DataFrame:
    """Add costly columns that are evaluated once per row.

    A filter on a plain computed column is pushed below the projection, with a
    copy of the expression; it cannot be pushed below a generator.
    """
    return df.select("*", F.inline(F.array(F.struct(*[c.alias(n) for n, c in columns.items()]))))


def first_by(df: DataFrame, keys: Sequence[str | Column], order: Sequence[Column]) -> DataFrame:
    """The least row per key in the given order.

    An aggregate, not a window: every task keeps one row per key before the
    shuffle, so a key that owns a third of the rows costs no more than others.
    """
    row = F.struct(*df.columns)
    best = df.groupBy(*keys).agg(F.min_by(row, F.struct(*order)).alias("_row"))
    return best.select("_row.*")


def dedupe_first(df: DataFrame, keys: Sequence[str | Column], pos: Sequence[str] = ("pos",)) -> DataFrame:
    """First row per key in input order."""
    return first_by(df, keys, [F.col(p) for p in pos])


def top_k(df: DataFrame, keys: Sequence[str], order: Sequence[Column], k: int) -> DataFrame:
    """Best k rows per key; the limit is pushed below the shuffle."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("_rank", rank).filter(F.col("_rank") <= k).drop("_rank")


def prefer_matching(df: DataFrame, keys: Sequence[str], matches: Column) -> DataFrame:
    """Keep matching rows of each key; a key without any keeps all its rows.

    The any-flag is one small row per key, joined back; the rows themselves
    are not gathered per key.
    """
    flagged = df.withColumn("_hit", F.coalesce(matches, F.lit(False)))
    hit_keys = flagged.filter("_hit").select(*keys).distinct().withColumn("_any", F.lit(True))
    joined = flagged.join(hit_keys, list(keys), "left")
    return joined.filter(F.col("_hit") | F.col("_any").isNull()).drop("_hit", "_any")
