"""Scores as tables: which facts hold, and how many points each is worth."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def points(table: Mapping[str, int], facts: Mapping[str, Column]) -> Column:
    """Sum of the points of all facts that hold; an unknown fact adds nothing.

    Every name of the table must be among the facts, so a misspelt rule fails
    when the expression is built and not silently.
    """
    worth = [F.when(facts[name], F.lit(n)).otherwise(F.lit(0)) for name, n in table.items()]
    return reduce(lambda a, b: a + b, worth)


def pattern_points(value: Column, table: Sequence[tuple[str, int]]) -> Column:
    """The same, with patterns over one text as facts."""
    return points({p: n for p, n in table}, {p: value.rlike(p) for p, _ in table})


def best_of(*candidates: tuple[Column, Column, int]) -> Column:
    """The text of the candidate (points, text, preference) with most points;
    the larger preference decides ties.  Candidates without points are out."""
    rows = [F.when(p.isNotNull(), F.struct(p.alias("points"), F.lit(order).alias("order"), text.alias("text"))) for p, text, order in candidates]
    return F.array_max(F.array(*rows))["text"]
