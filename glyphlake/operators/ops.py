"""Suites, jobs, logs and caches: the operational tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from glyphlake import fixed_values as fv
from glyphlake.functions.files import reason_code
from glyphlake.operators.picking import first_by, top_k

C = F.col


def select_cases(cases: DataFrame, only: str | None, wanted: list[str], offset: int = 0, limit: int | None = None) -> DataFrame:
    """Cases by exact or partial id, then by list, then a slice in order."""
    picked = cases
    if only:
        picked = picked.filter(F.contains("id", F.lit(only)))
    if wanted:
        picked = picked.filter(F.exists(F.array(*[F.lit(w) for w in wanted]), lambda w: F.contains(C("id"), w)))
    if offset or limit is not None:
        picked = picked.orderBy("pos").offset(offset)
        picked = picked if limit is None else picked.limit(limit)
    return picked


def latest_by_id(results: DataFrame, cases: DataFrame) -> DataFrame:
    """Last result per id; known cases by position, others after."""
    last = first_by(results, ["id"], [-C("seq")])
    return last.join(cases.select("id", C("pos").alias("case_pos")), "id", "left")


def pending(cases: DataFrame, done: DataFrame, rerun_failed: bool) -> DataFrame:
    if not rerun_failed:
        return cases.join(done.select("id"), "id", "left_anti")
    return cases.join(done.filter("status <> 'fail'").select("id"), "id", "left_anti")


def case_gate(results: DataFrame, cases: DataFrame, strict: bool, phase: bool) -> DataFrame:
    """Reasons and status of each result; flagged cases that downloaded
    nothing pass softly on a network timeout."""
    r = results.join(cases.select("id", "min_downloaded", "soft_pass"), "id")
    quality = F.lower(F.coalesce("quality_status", F.lit("")))
    on, tough = F.lit(phase), F.lit(phase and strict)

    def count(name: str, text: str) -> Column:
        return F.when(on & (C(name) > 0), F.concat(F.lit(text), C(name)))

    reasons = F.array_compact(
        F.array(
            F.when(
                C("downloaded") < C("min_downloaded"),
                F.concat(F.lit("files: "), C("downloaded"), F.lit(" of at least "), C("min_downloaded")),
            ),
            F.when(F.lower("validation_status") == "fail", F.lit("validation failed")),
            F.when(tough & (quality == ""), F.lit("quality report missing")),
            F.when(on & (quality == "fail"), F.lit("quality failed")).otherwise(
                F.when(tough & (quality == "warn"), F.lit("quality warns"))
            ),
            F.when(
                on & (C("coverage_pct") < 90),
                F.concat(F.lit("style coverage: "), F.regexp_replace(C("coverage_pct").cast("string"), r"\.0$", ""), F.lit("%")),
            ),
            count("invalid_fonts", "invalid files: "),
            count("italic_mismatches", "slope mismatches: "),
            F.when(tough, count("contamination", "foreign files: ")),
            F.when((C("downloaded") == 0) & (C("skipped") > 0), F.concat(F.lit("first skip: "), C("first_skip"))),
        )
    )
    gated = r.withColumn("reasons", reasons)
    soft = (
        C("soft_pass")
        & (F.size("reasons") > 0)
        & (C("downloaded") == 0)
        & F.exists("reasons", lambda x: x.rlike(fv.NETWORK_TIMEOUT))
    )
    note = F.lit("passed softly: network timeout")
    return gated.withColumn("status", F.when((F.size("reasons") == 0) | soft, "pass").otherwise("fail")).withColumn(
        "reasons", F.when(soft, F.array_append("reasons", note)).otherwise(C("reasons"))
    )


def suite_summary(cases: DataFrame, gated: DataFrame) -> DataFrame:
    """total, completed, pending, passed, failed over the selected cases."""
    joined = cases.select("id").join(gated.select("id", "status"), "id", "left")
    return joined.agg(
        F.count("*").alias("total"),
        F.count("status").alias("completed"),
        F.count_if(C("status").isNull()).alias("pending"),
        F.count_if(C("status") == "pass").alias("passed"),
        F.count_if(C("status") == "fail").alias("failed"),
    )


def reason_counts(rows: DataFrame, reason: str) -> DataFrame:
    return rows.groupBy(reason_code(C(reason)).alias("code")).agg(F.count("*").alias("n"))


def retry_triage(log: DataFrame, coverage: DataFrame) -> DataFrame:
    """Per batch: does it need another try, and why.

    ``coverage``: (job_id, coverage_pct), may lack batches.
    """
    fontlike = (C("status") == "downloaded") & C("filename").rlike(r"(?i)\.(woff2?|ttf|otf|zip)$")
    skipped = C("status") == "skipped"
    signals = log.groupBy("job_id").agg(
        F.count("*").alias("items"),
        F.count_if(fontlike).alias("files"),
        F.bool_or(skipped & C("reason").rlike(fv.FETCH_FAILURE)).alias("fetch_failure"),
        F.bool_or(skipped & C("reason").rlike(fv.BLOCKED_RESPONSE)).alias("blocked"),
        F.bool_or(skipped & C("reason").rlike(fv.HTML_LIKE_SKIP)).alias("html_like"),
    )
    any_signal = C("fetch_failure") | C("blocked") | C("html_like")
    cause = (
        F.when(~any_signal, F.lit(None).cast("string"))
        .when(C("files") == 0, "no-files")
        .when((C("blocked") | C("html_like")) & (C("files") / C("items") < 0.6), "low-ratio")
        .when(C("coverage_pct") < 90, "low-coverage")
    )
    return signals.join(coverage, "job_id", "left").withColumn("cause", cause).withColumn("needs_retry", C("cause").isNotNull())


# --- jobs and logs -------------------------------------------------------


def job_state(events: DataFrame) -> DataFrame:
    """Latest status and merged result per job; also the streaming form.

    Every column is a mergeable aggregate, so a job with a third of all events
    is combined before the shuffle.  Log lines stay rows, see ``tail_log``.
    """

    def last(name: str) -> Column:
        return F.max_by(name, F.when(C(name).isNotNull(), C("seq")))

    return events.groupBy("job_id").agg(
        last("status").alias("status"),
        last("result_value").alias("result_value"),
        last("result_error").alias("result_error"),
        F.count("line").alias("log_lines"),
        F.max("ts").alias("updated_at"),
    )


def tail_log(events: DataFrame, n: int) -> DataFrame:
    return top_k(events.filter("line is not null").select("job_id", "seq", "line"), ["job_id"], [C("seq").desc()], n)


def suite_progress(events: DataFrame) -> DataFrame:
    """Running counts per run; a plain mergeable aggregate, batch or stream."""
    return events.groupBy("run_id").agg(
        F.count_if(C("event") == "case_start").alias("started"),
        F.count_if(C("event") == "case_result").alias("finished"),
        F.count_if((C("event") == "case_result") & (C("status") == "pass")).alias("passed"),
        F.max("ts").alias("last_ts"),
    )


def suite_throughput(events: DataFrame, width: str = "1 hour") -> DataFrame:
    return events.groupBy(F.window("ts", width).alias("w")).agg(F.count_if(C("event") == "case_result").alias("finished"))


def wall_micros(ts: Column) -> Column:
    """Microseconds on the wall clock; no time zone enters for zone-free stamps."""
    day = F.unix_date(F.to_date(ts)).cast("long") * 86_400_000_000
    minutes = (F.hour(ts) * 60 + F.minute(ts)).cast("long") * 60_000_000
    return day + minutes + (F.date_part(F.lit("SECOND"), ts) * 1_000_000).cast("long")


# --- newest and latest entries -------------------------------------------


def newest(entries: DataFrame, k: int) -> DataFrame:
    """The ``k`` newest entries; a sort with a limit keeps ``k`` rows per task."""
    return entries.orderBy(C("created").desc(), C("token").desc()).limit(k)


def latest_within(entries: DataFrame, reads: DataFrame, seconds: int) -> DataFrame:
    """As-of lookup: for each read (get_id, token, ts) the token's latest entry
    (put_id, token, ts) before it and less than ``seconds`` old.

    Entries are copied to their own and the next time bucket, one ``seconds``
    wide, so a busy token is split by time and no window holds all of it.
    """
    micros = wall_micros(C("ts"))
    width = seconds * 1_000_000
    p = entries.select(C("put_id").alias("id"), "token", micros.alias("t"), F.lit(True).alias("is_put"))
    g = reads.select(C("get_id").alias("id"), "token", micros.alias("t"), F.lit(False).alias("is_put"))
    bucket = F.floor(C("t") / width)
    rows = p.withColumn("bucket", F.explode(F.array(bucket, bucket + 1))).unionByName(g.withColumn("bucket", bucket))
    order = Window.partitionBy("token", "bucket").orderBy("t", "id").rowsBetween(Window.unboundedPreceding, 0)
    entry = F.last(F.when(C("is_put"), F.struct("id", "t")), ignorenulls=True).over(order)
    found = rows.withColumn("e", entry).filter(~C("is_put"))
    fresh = C("e").isNotNull() & (C("t") < C("e.t") + width)
    return found.select(C("id").alias("get_id"), "token", F.when(fresh, C("e.id")).alias("put_id"), F.coalesce(fresh, F.lit(False)).alias("found"))
