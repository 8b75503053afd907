"""What the operators share: words, hashes, staging of intermediate tables."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# fixed values: the white space that separates words, as a Java class
SPACES = r"[\x20\x09-\x0D]+"

CHECKPOINT_KEY = "spark.checkpoint.dir"


#: rows of text that a task turns into Python objects at once
ROWS_AT_ONCE = 256


def sliced(batches: Iterator[pa.RecordBatch], rows: int = ROWS_AT_ONCE) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of bounded size."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors see: what the session names, or, only where
    nothing is named and the session is a local one, a new temporary folder."""
    named = spark.conf.get(CHECKPOINT_KEY, None)
    if named:
        return named
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError(f"{CHECKPOINT_KEY} must name a folder that all executors share")
    chosen = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    spark.conf.set(CHECKPOINT_KEY, chosen)
    return chosen


def staged(df: DataFrame) -> DataFrame:
    """Cut the lineage: the rows as a reliable checkpoint in the shared folder."""
    context = df.sparkSession.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        context.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint(eager=True)


def new_folder(spark: SparkSession, name: str) -> str:
    """A path for one table in the shared folder that nothing else uses."""
    return f"{shared_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str, codec: str = "zstd", buckets: int | None = None, by: str | None = None) -> DataFrame:
    """As ``staged``, but as a compressed Parquet table: for large rows.

    With ``buckets`` the files are bucketed ``by`` a column, so that grouping
    by it later needs no shuffle; the name in the catalog is taken back at once.
    """
    spark = df.sparkSession
    path = new_folder(spark, name)
    if not buckets:
        df.write.option("compression", codec).parquet(path)
        return spark.read.schema(df.schema).parquet(path)
    table = f"{name}_{uuid.uuid4().hex}"
    df.write.option("compression", codec).option("path", path).bucketBy(buckets, by).saveAsTable(table, format="parquet")
    found = spark.table(table).select("*")
    found.schema  # resolved now; the files outlive the name
    spark.sql(f"DROP TABLE {table}")
    return found


def fresh(df: DataFrame, *names: str) -> list[str]:
    """The names, each lengthened until the table has no column of that name."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def whole(text: Column) -> Column:
    """The text; nothing counts as empty."""
    return F.coalesce(text, F.lit(""))


def word_count(text: Column) -> Column:
    """Number of runs of characters other than white space; null: 0."""
    parts = F.split(whole(text), SPACES)
    blank = (parts[0] == "").cast("long")
    last = F.when(F.size(parts) > 1, (F.element_at(parts, -1) == "").cast("long")).otherwise(F.lit(0))
    return F.size(parts).cast("long") - blank - last


def held_out(doc_id: Column) -> Column:
    """Rows that no model may learn labels from; a null id may be learnt from."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def uniform(*parts: Column) -> Column:
    """A number in [0, 1) that depends on the given values alone."""
    return F.shiftrightunsigned(F.xxhash64(*parts), 11) * F.lit(2.0**-53)
