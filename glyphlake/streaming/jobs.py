"""Streams of job, telemetry and cache events."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from glyphlake.operators.ops import job_state, suite_progress, wall_micros
from glyphlake.operators.packages import number_rows
from glyphlake.operators.windows import anchored_windows
from glyphlake.session import cut_lineage

C = F.col


def read_event_stream(spark: SparkSession, path: str, schema: T.StructType, files_per_trigger: int | None = None) -> DataFrame:
    reader = spark.readStream.schema(schema)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.parquet(path)


def changes_to(path: str) -> Callable[[DataFrame, int], None]:
    """Writes the rows a batch changed to a folder of its own."""

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.withColumn("version", F.lit(batch_id)).write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return write


def job_status_stream(events: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Keep the state of every job in a table that each batch adds changes to.

    A batch writes the jobs it touched to its own folder (rewritten if the
    batch is retried); ``read_job_states`` takes the latest row per job.
    """
    return (
        job_state(events).writeStream.outputMode("update").option("checkpointLocation", checkpoint)
        .foreachBatch(changes_to(path)).trigger(availableNow=True).start()
    )


def read_latest(spark: SparkSession, path: str, key: str) -> DataFrame:
    """The latest row per key of a table of changes."""
    rows = spark.read.parquet(path).drop("batch")
    row = F.struct(*rows.columns)
    return rows.groupBy(key).agg(F.max_by(row, "version").alias("r")).select("r.*").drop("version")


def read_job_states(spark: SparkSession, path: str) -> DataFrame:
    return read_latest(spark, path, "job_id")


def progress_stream(events: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Running suite summary as a table of changes, one folder per batch, for
    ``read_progress``; nothing is gathered in the driver."""
    return (
        suite_progress(events).writeStream.outputMode("update").option("checkpointLocation", checkpoint)
        .foreachBatch(changes_to(path)).trigger(availableNow=True).start()
    )


def read_progress(spark: SparkSession, path: str) -> DataFrame:
    return read_latest(spark, path, "run_id")


def throughput_stream(events: DataFrame, width: str, delay: str) -> DataFrame:
    """Finished cases per window; the watermark bounds the state."""
    windowed = events.withWatermark("ts", delay).groupBy(F.window("ts", width).alias("w"))
    return windowed.agg(F.count_if(C("event") == "case_result").alias("finished"))


def append_telemetry_stream(events: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    rows = events.select("ts", "run_id", "event", "payload")
    return (
        rows.writeStream.format("json").option("path", path).option("checkpointLocation", checkpoint)
        .outputMode("append").trigger(availableNow=True).start()
    )


def lines_of(batch: DataFrame, batch_id: int, path: str) -> None:
    """Append a batch's log lines, with their time, as a folder of its own."""
    lines = batch.filter("line is not null").select("job_id", "seq", "ts", "line")
    lines.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")


def job_lines_stream(events: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Append the log lines of all jobs, once each, next to their states; a
    batch that is run again rewrites its own folder.  ``read_job_lines`` and
    ``ops.tail_log`` read them in order."""
    return (
        events.writeStream.option("checkpointLocation", checkpoint)
        .foreachBatch(lambda batch, batch_id: lines_of(batch, batch_id, path)).trigger(availableNow=True).start()
    )


def read_job_lines(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path).drop("batch")


RATES = "event_id long, key long, opened_us long, n long, limited boolean"
OPEN = "key long, opened long, seen long"


def limit_batch(batch: DataFrame, batch_id: int, limit: int, seconds: int, path: str) -> None:
    """Label the events of a batch, going on from the windows that earlier
    batches left open: events within a key's open window are numbered on, all
    later ones are windows of the batch alone, cut by time slice.
    """
    spark = batch.sparkSession
    before = read_batches(spark, f"{path}/open", OPEN).filter(C("batch") < batch_id)
    last = before.groupBy("key").agg(F.max_by(F.struct("opened", "seen"), "batch").alias("o")).select("key", "o.*")
    rows = cut_lineage(batch.select("event_id", "key", "ts", wall_micros(C("ts")).alias("t")).join(last, "key", "left"))
    goes_on = F.coalesce(C("t") <= C("opened") + seconds * 1_000_000, F.lit(False))
    inside = number_rows(rows.filter(goes_on).withColumn("at", F.struct("t", "event_id")), ["key"], "at", "place")
    inside = inside.select("event_id", "key", C("opened").alias("opened_us"), (C("seen") + C("place")).alias("n"))
    fresh = anchored_windows(rows.filter(~goes_on).select("event_id", "key", "ts"), limit, seconds).drop("limited")
    out = inside.unionByName(fresh).withColumn("limited", C("n") > limit)
    out.write.mode("overwrite").parquet(f"{path}/events/batch={batch_id}")
    told = spark.read.schema(RATES).parquet(f"{path}/events/batch={batch_id}")
    left = told.groupBy("key").agg(F.max(F.struct("opened_us", "n")).alias("o"))
    left.select("key", C("o.opened_us").alias("opened"), C("o.n").alias("seen")).write.mode("overwrite").parquet(f"{path}/open/batch={batch_id}")


def read_batches(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """All batches of a table with their numbers; none yet: no rows."""
    try:
        return spark.read.schema(f"{schema}, batch int").option("basePath", path).parquet(f"{path}/batch=*")
    except AnalysisException as error:
        if "PATH_NOT_FOUND" not in str(error):
            raise
        return spark.createDataFrame([], f"{schema}, batch int")


def rate_limit_stream(events: DataFrame, limit: int, seconds: int, path: str, checkpoint: str) -> StreamingQuery:
    """Label a stream of (event_id, key, ts) as ``anchored_windows`` does, for
    events that arrive in the order of time, however they are cut into batches.
    ``read_rates`` has the labels."""
    return (
        events.writeStream.option("checkpointLocation", checkpoint)
        .foreachBatch(lambda batch, batch_id: limit_batch(batch, batch_id, limit, seconds, path)).trigger(availableNow=True).start()
    )


def read_rates(spark: SparkSession, path: str) -> DataFrame:
    return read_batches(spark, f"{path}/events", RATES).drop("batch")
