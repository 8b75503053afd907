"""Mixing sources to target weights by pivotal dependent rounding.

Each source is to give a number of words; divided by its size that is a rate,
and a document is taken floor(rate) times plus once more with the rest as its
probability.  The rests are rounded together, not one by one: two documents
with open probabilities meet, and words of expectation move from one to the
other, at random and fair in the mean, until one of the two is certain.  The
sum of probability times size never changes, so what a source gives misses its
target by less than the size of the one document that is left open at the end.

Documents of a source are dealt into bounded groups, each of which leaves at
most one open document; those meet in groups of the next level, and so on: a
reduction tree in which no task sees more than one group.  All randomness is a
hash of seed, level, id, text and, for rows equal in all of these, a number,
so a rerun gives the same rows and rows without an id are dealt like others.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from glyphlake.llm.common import fresh, staged, uniform, word_count

WEIGHTS = (5, 2, 1)
BUDGET = 1.5
MOST = 2
GROUP_ROWS = 4096
FAN_IN = 64
SEED = 20


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, budget: float = BUDGET, most: int = MOST) -> DataFrame:
    """One row per source: source_size and target, from ``source, size`` rows.

    Sources in order of code points, null last, take the weights in turn and
    share ``budget`` times all words; none gets more than ``most`` times its
    own, and what is over goes to the others by weight.  That level is the one
    number x with sum(min(most * size, x * weight)) = budget: with sources
    sorted by most * size / weight, those that are full come first, so running
    sums give x at once.  The windows span sources, not documents.
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("_docs"))
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    turn = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (place % len(weights) + 1).cast("int"))
    per = per.withColumn("_weight", turn).withColumn("_cap", F.lit(float(most)) * F.col("source_size"))
    by_fill = Window.orderBy(F.col("_cap") / F.col("_weight"), F.col("source").asc_nulls_last())
    before = by_fill.rowsBetween(Window.unboundedPreceding, -1)
    rest = by_fill.rowsBetween(0, Window.unboundedFollowing)
    everything = Window.partitionBy()
    total = F.sum("source_size").over(everything) * F.lit(float(budget))
    level = (total - F.coalesce(F.sum("_cap").over(before), F.lit(0.0))) / F.sum("_weight").over(rest)
    per = per.withColumn("_level", level)
    fits = F.min(F.when(F.col("_level") <= F.col("_cap") / F.col("_weight"), F.struct(F.col("_cap") / F.col("_weight"), "source", "_level"))).over(everything)
    chosen = F.coalesce(fits["_level"], F.max(F.col("_cap") / F.col("_weight")).over(everything))
    return per.select("source", "source_size", "_docs", F.least("_cap", chosen * F.col("_weight")).alias("target"))


def _settle(rows: pd.DataFrame) -> pd.DataFrame:
    """Round one group; all rows but one at most come out with 0 or 1."""
    rows = rows.sort_values(["_draw", "doc_id", "size", "_text", "_nth"], kind="stable", ignore_index=True)
    share = rows["_share"].to_numpy(np.float64).copy()
    size = rows["size"].to_numpy(np.float64)
    draw = rows["_draw"].to_numpy(np.float64)
    held = -1
    for i in range(len(rows)):
        if not 0.0 < share[i] < 1.0:
            continue
        if held < 0:
            held = i
            continue
        up = min((1.0 - share[held]) * size[held], share[i] * size[i])
        down = min(share[held] * size[held], (1.0 - share[i]) * size[i])
        if draw[i] * (up + down) < down:
            one_full = (1.0 - share[held]) * size[held] <= share[i] * size[i]
            both = (1.0 - share[held]) * size[held] == share[i] * size[i]
            new_held = 1.0 if one_full else share[held] + up / size[held]
            new_i = 0.0 if both or not one_full else share[i] - up / size[i]
        else:
            one_out = share[held] * size[held] <= (1.0 - share[i]) * size[i]
            both = share[held] * size[held] == (1.0 - share[i]) * size[i]
            new_held = 0.0 if one_out else share[held] - down / size[held]
            new_i = 1.0 if both or not one_out else share[i] + down / size[i]
        share[held], share[i] = new_held, new_i
        if 0.0 < share[i] < 1.0:
            held = i
        elif not 0.0 < share[held] < 1.0:
            held = -1
    rows["_share"] = share
    return rows


def _named_apart(sized: DataFrame, group_rows: int) -> DataFrame:
    """Add ``_nth``, which tells rows of one id, source and text apart.

    Such rows are equal in all that is used of them, so they are counted, not
    ranked: one row per kind is written out ``count`` times by tasks that each
    write ``group_rows`` of them.  No kind is ever gathered in one place.
    """
    kind = ["doc_id", "source", "size", "_text"]
    counted = sized.groupBy(*kind).agg(F.count("*").alias("_count"))
    first = F.explode(F.sequence(F.lit(0).cast("long"), F.col("_count") - 1, F.lit(group_rows).cast("long")))
    once = counted.filter("_count = 1").select(*kind, F.lit(0).cast("long").alias("_nth"))
    parts = counted.filter("_count > 1").select(*kind, "_count", first.alias("_from")).repartition(*kind, "_from")
    last = F.least(F.col("_from") + group_rows, F.col("_count")) - 1
    return once.unionByName(parts.select(*kind, F.explode(F.sequence(F.col("_from"), last)).alias("_nth")))


def mixture(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, budget: float = BUDGET, most: int = MOST, seed: int = SEED, group_rows: int = GROUP_ROWS, fan_in: int = FAN_IN) -> DataFrame:
    """One row per document: the words the mix takes of it, repeats counted.

    A null source is a source of its own, in last place.  A document without a
    word, or with null text, has size 0 and gives nothing.  Rows that repeat an
    id are documents of their own.  Columns beyond doc_id, text and source are
    not read; an empty table gives no rows.

    Returns doc_id, size, source_size, target, taken, copies.
    """
    sized = staged(
        docs.select(
            F.col("doc_id").cast("long").alias("doc_id"),
            F.col("source").cast("string").alias("source"),
            word_count(F.col("text")).alias("size"),
            F.xxhash64("text").alias("_text"),
        )
    )
    sized = staged(_named_apart(sized, group_rows))
    targets = staged(source_targets(sized, weights, budget, most))
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    groups = F.greatest(F.lit(1), F.ceil(F.col("_docs") / F.lit(group_rows)))
    known = targets.select(F.col("source").alias("_of"), "source_size", "target", rate.alias("_rate"), groups.alias("_groups"))
    rows = (
        sized.join(known, F.col("source").eqNullSafe(F.col("_of")))
        .withColumn("_whole", F.floor("_rate"))
        .withColumn("_share", F.when(F.col("size") > 0, F.col("_rate") - F.floor("_rate")).otherwise(F.lit(0.0)))
        .withColumn("_group", F.pmod(F.xxhash64(F.lit(seed), F.lit("group"), "doc_id", "_text", "_nth"), "_groups"))
        .select("doc_id", "source", "size", "_text", "_nth", "source_size", "target", "_whole", "_share", "_group")
    )
    most_groups = targets.agg(F.max(groups)).first()[0] or 1
    schema = "doc_id long, source string, size long, _text long, _nth long, source_size long, target double, _whole long, _share double, _group long, _draw double"
    done, level = [], 0
    while True:
        drawn = rows.withColumn("_draw", uniform(F.lit(seed), F.lit(level), F.col("doc_id"), F.col("size"), F.col("_text"), F.col("_nth")))
        rows = staged(drawn.groupBy("source", "_group").applyInPandas(_settle, schema)).drop("_draw")
        is_open = (F.col("_share") > 0) & (F.col("_share") < 1)
        done.append(rows.filter(~is_open))
        rows = rows.filter(is_open)
        if most_groups <= 1:
            break
        most_groups = -(-most_groups // fan_in)
        rows = rows.withColumn("_group", F.floor(F.col("_group") / fan_in))
        level += 1
    last = uniform(F.lit(seed), F.lit("last"), F.col("doc_id"), F.col("_text"), F.col("_nth")) < F.col("_share")
    everything = rows.withColumn("_share", last.cast("double"))
    for part in done:
        everything = everything.unionByName(part)
    copies = (F.col("_whole") + F.col("_share")).cast("long")
    return everything.select("doc_id", "size", "source_size", "target", (copies * F.col("size")).alias("taken"), copies.alias("copies"))


def mix_documents(docs: DataFrame) -> DataFrame:
    """The mix itself: each document as many times as the mix takes it, with
    all its columns; documents the mix does not take are left out.

    Documents without a word weigh nothing in any mix; they are taken once.
    Rows that repeat an id share its copies evenly, rounded up.
    """
    copies = F.when(F.col("size") == 0, F.lit(1)).otherwise(F.col("copies"))
    key, times, copy = fresh(docs, "_key", "_times", "_copy")
    plan = mixture(docs).groupBy(F.col("doc_id").alias(key)).agg(F.ceil(F.avg(copies)).cast("int").alias(times))
    named = [F.col(f"`{c}`") for c in docs.columns]
    found = docs.join(plan.filter(F.col(times) > 0), F.col("doc_id").cast("long").eqNullSafe(F.col(key)))
    return found.withColumn(copy, F.explode(F.sequence(F.lit(1), F.col(times)))).select(*named)
