"""User rules: each owns the URLs its pattern accepts and turns its slice of a
table into rows."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glyphlake.operators.links import first_rule


@dataclass(frozen=True)
class ExtractorRule:
    """``pattern`` is tested on the ``part`` ("url" or "host") of a row's URL."""

    rule: str
    pattern: str
    transform: Callable[[DataFrame], DataFrame]
    part: str = "url"


def apply_rules(df: DataFrame, rules: Sequence[ExtractorRule], url: str = "url") -> DataFrame:
    """Route every row to the first rule that accepts it, let each rule
    transform its own slice, and put the results together."""
    routed = df.withColumn("rule", first_rule(F.col(url), [(r.rule, r.part, r.pattern) for r in rules]))
    parts = [r.transform(routed.filter(F.col("rule") == r.rule)) for r in rules]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
