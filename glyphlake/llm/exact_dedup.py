"""Exact duplicates by a tree-merge of sorted digest runs.

Every document becomes a small key: the SHA-256 of its normalised text, and,
to verify it, the text's length and a second hash.  Keys are dealt into lanes,
where each lane sorts its keys and collapses equal ones to (smallest id,
copies): a sorted run.  The lanes then exchange runs in rounds along the
digits of the lane number, as in a binomial (radix) exchange: in round r a
lane meets only those that differ from it in digit r, and each key goes to the
one whose digit r equals the digit of the key's own lane.  A lane merges the
sorted runs it receives and again keeps the smallest id per key.  After the
last round a key is in its own lane only, so its run entry is final.

Copies collapse before every exchange, so a group that holds a third of all
rows is at most one row per lane and round.  The result goes back to the
documents by way of the first runs, (lane, key), so no join key is hot either.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glyphlake.llm.common import SPACES, fresh, staged, whole

FAN_IN = 8
ROWS_PER_LANE = 1 << 18
RUN = "_lane int, _digest binary, _length long, _second long, _keep long, _copies long"
KEY = ["_digest", "_length", "_second"]


def _merge_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Collapse equal neighbours of a sorted stream; memory: one batch."""
    names = ["_lane", *KEY, "_keep", "_copies"]
    types = pa.schema([("_lane", pa.int32()), ("_digest", pa.binary()), ("_length", pa.int64()), ("_second", pa.int64()), ("_keep", pa.int64()), ("_copies", pa.int64())])
    held = None
    for batch in batches:
        if batch.num_rows == 0:
            continue
        rows = pa.Table.from_batches([batch]).select(names).cast(types)
        if held is not None:
            rows = pa.concat_tables([held, rows])
        merged = rows.group_by(["_lane", *KEY], use_threads=False).aggregate([("_keep", "min"), ("_copies", "sum")])
        merged = merged.rename_columns([{"_keep_min": "_keep", "_copies_sum": "_copies"}.get(n, n) for n in merged.column_names]).select(names).cast(types)
        yield from merged.slice(0, merged.num_rows - 1).to_batches()
        held = merged.slice(merged.num_rows - 1)
    if held is not None:
        yield from held.to_batches()


def _exchange(runs: DataFrame, lanes: int) -> DataFrame:
    """Send every row to its lane and merge there, in sorted order."""
    met = runs.repartitionById(lanes, F.col("_lane")).sortWithinPartitions(*KEY, F.col("_keep").asc_nulls_last())
    return met.mapInArrow(_merge_runs, RUN)


def exact_groups(docs: DataFrame, fan_in: int = FAN_IN, rows_per_lane: int = ROWS_PER_LANE) -> DataFrame:
    """One row per document: its digest, the id that stays, and the copies.

    Texts are equal when they are identical after every run of white space is
    one space.  A null text is empty, and empty texts equal each other.  Null
    ids come after all others and stay only if the group has no other.  Rows
    that repeat one id count as copies each and share its fate.  The given
    table may have further columns; only ``doc_id`` and ``text`` are read.

    Returns doc_id, keep_id, group_size, kept, text_sha256.
    """
    text = F.regexp_replace(whole(F.col("text")), SPACES, " ")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("_text"))
    keys = staged(
        rows.select(
            "doc_id",
            F.unhex(F.sha2("_text", 256)).alias("_digest"),
            F.octet_length("_text").cast("long").alias("_length"),
            F.xxhash64("_text").alias("_second"),
        )
    )
    digits = 2
    total = keys.count()
    while fan_in**digits * rows_per_lane < total:
        digits += 1
    lanes = fan_in**digits
    keys = keys.withColumn("_lane", F.pmod(F.xxhash64(F.lit("lane"), "doc_id"), F.lit(lanes)).cast("int"))
    own_lane = F.pmod(F.conv(F.hex(F.substring("_digest", 1, 6)), 16, 10).cast("long"), F.lit(lanes))
    first = _exchange(keys.select("_lane", *KEY, F.col("doc_id").alias("_keep"), F.lit(1).cast("long").alias("_copies")), lanes)
    runs = first
    for digit in range(digits):
        unit = fan_in**digit
        here = F.floor(F.col("_lane") / unit) % fan_in
        there = F.floor(own_lane / unit) % fan_in
        runs = _exchange(runs.withColumn("_lane", (F.col("_lane") + (there - here) * unit).cast("int")), lanes)
    final = runs.select(*KEY, F.col("_keep").alias("keep_id"), F.col("_copies").alias("group_size"))
    back = first.select("_lane", *KEY).join(final, KEY)
    return keys.join(back, ["_lane", *KEY]).select(
        "doc_id",
        "keep_id",
        "group_size",
        F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"),
        F.lower(F.hex("_digest")).alias("text_sha256"),
    )


def drop_exact_copies(docs: DataFrame) -> DataFrame:
    """The documents that stay, with all their columns, whole and unchanged.

    Only the ids to drop travel; a document without a copy is never touched.
    Of rows that repeat an id, all stay if one of them does; rows without an
    id cannot be named and stay.
    """
    (gone,) = fresh(docs, "_gone")
    copies = exact_groups(docs).groupBy(F.col("doc_id").alias(gone)).agg(F.bool_or("kept").alias("kept")).filter("not kept").select(gone)
    return docs.join(copies, F.col("doc_id") == F.col(gone), "left_anti")
