"""Session helpers: the local session for tests and the lineage cut."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_KEY = "spark.checkpoint.dir"


def local_session(cores: str | int = 8, partitions: int = 8) -> SparkSession:
    """A local session with the settings the queries are checked under."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("glyphlake")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        # rows here are small and cost much CPU each: keep small shuffles parallel
        .config("spark.sql.adaptive.coalescePartitions.minPartitionSize", "64KB")
        .config("spark.driver.memory", os.environ.get("GLYPHLAKE_DRIVER_MEMORY", "8g"))
        .config("spark.local.dir", tempfile.mkdtemp(prefix="spark-", dir="/tmp"))
        .config("spark.ui.enabled", "false")
        # expressions here are large: do not record a call site for each node
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .getOrCreate()
    )


def spread(df: DataFrame) -> DataFrame:
    """Give every core a share of an input that is read as fewer splits than
    there are cores, as a table in one small file is.  Rows and results stay
    the same; an input with splits enough passes through untouched.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def deal_out(df: DataFrame, *keys: str) -> DataFrame:
    """Deal the rows out, evenly or by keys, whatever files and shuffles they
    come from: for rows that take long or much room.  Partitions that are asked
    for by number are not put together again by their small compressed size."""
    # a task of large expressions takes half a second to begin: three to a core do
    spark = df.sparkSession
    shares = 3 * spark.sparkContext.defaultParallelism
    return df.repartition(max(shares, int(spark.conf.get("spark.sql.shuffle.partitions"))), *keys) if keys else df.repartition(shares)


def by_shuffle(df: DataFrame) -> DataFrame:
    """Join these rows by a shuffle.

    The optimizer takes a compressed file's size for that of the rows unfolded
    from it, dozens of times too little, and would broadcast them through the
    driver.  The hint holds up to the first join and ends at a checkpoint.
    """
    return df.hint("merge")


def checkpoint_root(spark: SparkSession) -> str:
    """The shared folder the cluster names; a fresh one in a local session only."""
    named = spark.conf.get(CHECKPOINT_KEY, None) or spark.sparkContext.getConf().get(CHECKPOINT_KEY)
    if named:
        return named
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError(f"{CHECKPOINT_KEY} must name a folder that all executors share")
    chosen = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    spark.conf.set(CHECKPOINT_KEY, chosen)
    return chosen


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint: the rows survive the loss of any executor."""
    spark = df.sparkSession
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        context.setCheckpointDir(checkpoint_root(spark))
    return df.checkpoint(eager=True)
