"""Memory of productive resources: boosts, outcomes, pruning."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glyphlake.functions import urls
from glyphlake.operators.picking import top_k

C = F.col


def apply_memory(candidates: DataFrame, memory: DataFrame) -> DataFrame:
    """Add ``boost`` from rows of the page's host that earned a score.

    The memory is not assumed pruned: the join strategy is the optimiser's.
    """
    boosts = memory.filter(C("score") >= 3).select(
        "host", C("key").alias("memory_key"), F.greatest(F.lit(1), F.least(F.lit(40), F.floor(C("score") + 0.5))).cast("int").alias("boost")
    )
    keyed = candidates.withColumn("host", urls.host_of(C("page_url")))
    return keyed.join(boosts, ["host", "memory_key"], "left")


def update_memory(memory: DataFrame, outcomes: DataFrame, now_ms: int) -> DataFrame:
    """Fold a batch of outcomes (host, key, kind, rel, signature, success,
    signal, seq) into the memory.

    The running score only depends on the final counts and the last signal, so
    one aggregate per key replaces the loop; counts combine before the shuffle.
    """
    batch = outcomes.groupBy("host", "key").agg(
        F.sum(F.when(C("success"), 1 + (C("signal") >= 2).cast("int")).otherwise(0)).cast("long").alias("d_success"),
        F.count_if(~C("success")).alias("d_fail"),
        F.max_by("signal", "seq").alias("last_signal"),
        F.min_by(F.struct("kind", "rel", "signature"), "seq").alias("about"),
    )
    merged = memory.join(batch, ["host", "key"], "full_outer")
    kind = F.coalesce("kind", "about.kind")
    success = F.coalesce("success_count", F.lit(0)) + F.coalesce("d_success", F.lit(0))
    fail = F.coalesce("fail_count", F.lit(0)) + F.coalesce("d_fail", F.lit(0))
    weighted = (
        success * 6
        + F.greatest(F.lit(0), F.least(F.lit(4), C("last_signal"))) * 2
        - fail * 4
        + F.when(kind == "css", 2).otherwise(0)
    )
    touched = C("last_signal").isNotNull()
    return merged.select(
        "host",
        "key",
        kind.alias("kind"),
        F.coalesce("rel", "about.rel").alias("rel"),
        F.coalesce("signature", "about.signature").alias("signature"),
        success.alias("success_count"),
        fail.alias("fail_count"),
        F.when(touched, F.greatest(F.lit(-30), F.least(F.lit(60), weighted))).otherwise(C("score")).cast("double").alias("score"),
        F.when(touched, F.lit(now_ms)).otherwise(C("updated_at")).alias("updated_at"),
    )


def prune_memory(memory: DataFrame, per_host: int, hosts: int) -> DataFrame:
    """Best rows of each host, and only the most recently touched hosts."""
    kept = top_k(memory, ["host"], [C("score").desc(), C("updated_at").desc(), C("key")], per_host)
    recent = (
        kept.groupBy("host").agg(F.max("updated_at").alias("u")).orderBy(C("u").desc(), "host").limit(hosts).select("host")
    )
    return kept.join(recent, "host", "left_semi")
