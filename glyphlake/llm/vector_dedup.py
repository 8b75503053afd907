"""Near-duplicate embeddings: learnt binary codes in multi-index Hamming tables.

Codes.  On a bounded sample of distinct unit vectors the mean and the principal
axes are taken, and iterative quantisation learns a rotation of them: signs of
the rotated vectors and the rotation that brings the vectors closest to their
signs are improved by turns.  The signs are balanced bits; several rotations,
from different starts, give as many bits as are needed.

Tables.  The bits are cut into substrings, each the key of one table (the
multi-index).  Two codes that differ in fewer bits than there are tables agree
wholly in one substring at least, and most others do too.  The width of a key
follows the number of vectors, so that a bucket holds about ``BUCKET`` vectors
at any size; the number of tables follows from the width: partners at exactly
the threshold are drawn around the sample, and tables are added until
``RECALL`` of them share a bucket.  Closer pairs share one more surely.

Rerank.  Within a bucket the original vectors are compared, in double
precision.  A pair counts in the first table in which it meets, so each link
counts once; a bucket reports numbers of links and a tree of each linked group,
never its pairs.  Equal vectors are one entry with the number of their rows.  A
bucket of more than ``BLOCK`` vectors is split, and its blocks are compared two
by two in tasks of their own.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glyphlake.llm.common import fresh, staged, written
from glyphlake.llm.simhash import _roots, components

THRESHOLD = 0.95
#: vectors that the codes are learnt from, at most, and numbers in them
SAMPLE = 8192
SAMPLE_NUMBERS = 1 << 22
RECALL = 0.998
PARTNERS = 4096
BUCKET = 48
BLOCK = 1024
MOST_TABLES = 64
PAIRS_AT_ONCE = 1 << 18
ROUNDS = 40
SEED = 11

#: a distinct vector: the smallest key that has it, two hashes, rows, bytes
CLASS = ["_node", "_mark", "_second", "_rows", "_vector"]
CLASS_KINDS = "_node long, _mark long, _second long, _rows long, _vector binary"
MET = "_node long, _mark long, _second long, _links long, _to long"


class Codes(NamedTuple):
    """centre (d), rotations (d x bits), tables of ``width`` bits each."""

    centre: np.ndarray
    rotations: np.ndarray
    width: int
    tables: int

    @property
    def kind(self) -> str:
        return "<i4" if self.width < 32 else "<i8"

    def keys(self, unit: np.ndarray) -> np.ndarray:
        """The key of each unit vector in each table, n x tables."""
        bits = (unit - self.centre) @ self.rotations > 0
        weights = np.int64(1) << np.arange(self.width, dtype=np.int64)
        return bits.reshape(len(unit), self.tables, self.width) @ weights


def rotation(projected: np.ndarray, seed: int, rounds: int = ROUNDS) -> np.ndarray:
    """Iterative quantisation: the rotation R of the projected sample that
    makes ``projected R`` closest to its own signs, from a random start."""
    d = projected.shape[1]
    turned, _ = np.linalg.qr(np.random.default_rng(seed).standard_normal((d, d)))
    for _ in range(rounds):
        signs = np.where(projected @ turned > 0, 1.0, -1.0)
        left, _, right = np.linalg.svd(projected.T @ signs)
        turned = left @ right
    return turned


def _partners(unit: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Vectors of the sample, and for each a partner at exactly the threshold."""
    random = np.random.default_rng(SEED)
    chosen = unit[random.integers(0, len(unit), PARTNERS)]
    aside = random.standard_normal(chosen.shape)
    aside -= (aside * chosen).sum(axis=1, keepdims=True) * chosen
    length = np.linalg.norm(aside, axis=1, keepdims=True)
    aside /= np.where(length > 0, length, 1)
    return chosen, threshold * chosen + np.sqrt(max(0.0, 1 - threshold**2)) * aside


def learnt(unit: np.ndarray, total: int, threshold: float, recall: float = RECALL) -> Codes:
    """Codes for ``total`` unit vectors from a sample of them."""
    centre = unit.mean(axis=0)
    _, spread, axes = np.linalg.svd(unit - centre, full_matrices=False)
    axes = axes[spread > 1e-9 * spread[0]].T if len(spread) and spread[0] > 0 else axes[:1].T
    projected = (unit - centre) @ axes
    one, other = _partners(unit, threshold)
    width = max(0, int(np.ceil(np.log2(max(1, total) / BUCKET))))
    blocks = np.zeros((unit.shape[1], 0))
    seed = 0
    while True:
        open_ = np.ones(len(one), bool)
        for tables in range(1, MOST_TABLES + 1):
            while blocks.shape[1] < width * tables:
                blocks = np.concatenate([blocks, axes @ rotation(projected, seed)], axis=1)
                seed += 1
            part = blocks[:, width * (tables - 1) : width * tables]
            open_ &= (((one - centre) @ part > 0) != ((other - centre) @ part > 0)).any(axis=1)
            if open_.mean() <= 1 - recall:
                return Codes(centre, blocks[:, : width * tables], width, tables)
        width -= 1  # wider buckets; at none all vectors are in one


def _unit(vectors: np.ndarray) -> np.ndarray:
    scaled = vectors / np.abs(vectors).max(axis=1, keepdims=True)
    return scaled / np.linalg.norm(scaled, axis=1, keepdims=True)


def _matrix(column: pa.Array | pa.ChunkedArray, kind: str) -> np.ndarray:
    """Vectors of one length, kept as bytes, as rows of doubles of length 1."""
    return _unit(np.frombuffer(b"".join(column.to_pylist()), kind).reshape(len(column), -1).astype(float))


def _packed(kind: str):
    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The vectors as bytes, in their own precision."""
        for batch in batches:
            at = np.flatnonzero(np.array(batch.schema.names) == "_vector")[0]
            vectors = batch.column(int(at))
            packed = pa.array([np.asarray(v.values, kind).tobytes() for v in vectors], pa.binary())
            yield pa.record_batch([packed if i == at else c for i, c in enumerate(batch.columns)], names=batch.schema.names)

    return packed


def usable(vector: Column) -> Column:
    """Not null, all entries finite numbers, and not all of them zero."""
    value = lambda c: c.cast("double")
    wrong = lambda c: c.isNull() | F.isnan(value(c)) | (F.abs(value(c)) == float("inf"))
    return F.coalesce(~F.exists(vector, wrong) & F.exists(vector, lambda c: value(c) != 0), F.lit(False))


def _keyed(codes: Codes, kind: str):
    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """One row per table: its bucket; the bucket's number has the table in
        the bits above the key."""
        for batch in batches:
            for at in range(0, batch.num_rows, 2048):
                part = batch.slice(at, 2048)
                keys = codes.keys(_matrix(part.column("_vector"), kind))
                table = np.tile(np.arange(codes.tables), part.num_rows)
                rows = pa.array(np.repeat(np.arange(part.num_rows), codes.tables))
                every = keys.astype(codes.kind)
                yield pa.record_batch(
                    [
                        pa.array((table.astype(np.int64) << 48) + keys.ravel()),
                        *(part.column(c).take(rows) for c in CLASS),
                        pa.array([k.tobytes() for k in every], pa.binary()).take(rows),
                    ],
                    names=["_bucket", *CLASS, "_keys"],
                )

    return keyed


def _compared(codes: Codes, kind: str, threshold: float):
    def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Sorted rows, cell by cell; memory: a batch and a cell."""
        held: pa.Table | None = None

        def told(table: pa.Table) -> Iterator[pa.RecordBatch]:
            if table.num_rows:
                yield _told(table.combine_chunks(), codes, kind, threshold)

        for batch in batches:
            if batch.num_rows == 0:
                continue
            table = pa.Table.from_batches([batch])
            cells = np.stack([batch.column(c).to_numpy() for c in ("_bucket", "_low", "_high")])
            last = (cells == cells[:, -1:]).all(axis=0)
            cut = int(np.argmax(last))
            if held is not None:
                if cut == 0 and all(held.column(c)[-1].as_py() == cells[i, -1] for i, c in enumerate(("_bucket", "_low", "_high"))):
                    held = pa.concat_tables([held, table])
                    continue
                table = pa.concat_tables([held, table])
                cut += held.num_rows
            yield from told(table.slice(0, cut))
            held = table.slice(cut)
        if held is not None:
            yield from told(held)

    return compared


def _told(table: pa.Table, codes: Codes, kind: str, threshold: float) -> pa.RecordBatch:
    """For whole cells: each vector's links first met there, and the smallest
    vector that the cells join it to."""
    bucket, low, high, block, node, rows = (table.column(c).to_numpy() for c in ("_bucket", "_low", "_high", "_block", "_node", "_rows"))
    unit = _matrix(table.column("_vector"), kind)
    keys = np.frombuffer(b"".join(table.column("_keys").to_pylist()), codes.kind).reshape(len(unit), -1)
    new = np.ones(len(unit), bool)
    new[1:] = (bucket[1:] != bucket[:-1]) | (low[1:] != low[:-1]) | (high[1:] != high[:-1])
    starts = np.flatnonzero(new)
    links, left, right = np.zeros(len(unit), np.int64), [], []
    for begin, end in zip(starts.tolist(), np.append(starts[1:], len(unit)).tolist(), strict=True):
        here = np.arange(begin, end)
        if low[begin] == high[begin]:
            one, other = np.nonzero(np.triu(unit[here] @ unit[here].T >= threshold, 1))
            one, other = here[one], here[other]
        else:  # pairs within a block are another cell's
            lower, upper = here[block[here] == low[begin]], here[block[here] == high[begin]]
            one, other = np.nonzero(unit[lower] @ unit[upper].T >= threshold)
            one, other = lower[one], upper[other]
        table_number = int(bucket[begin] >> 48)
        for at in range(0, len(one), PAIRS_AT_ONCE):
            a, b = one[at : at + PAIRS_AT_ONCE], other[at : at + PAIRS_AT_ONCE]
            first = ~(keys[a, :table_number] == keys[b, :table_number]).any(axis=1)
            a, b = a[first], b[first]
            links += np.bincount(a, rows[b], len(links)).astype(np.int64) + np.bincount(b, rows[a], len(links)).astype(np.int64)
            left.append(a)
            right.append(b)
    a, b = np.concatenate([np.zeros(0, np.int64), *left]), np.concatenate([np.zeros(0, np.int64), *right])
    order = np.argsort(node, kind="stable")
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    root = node[order[_roots(len(order), rank[a], rank[b])]][rank]
    some = pa.array(np.flatnonzero(links))
    return pa.record_batch(
        [*(table.column(c).combine_chunks().take(some) for c in CLASS[:3]), pa.array(links).take(some), pa.array(root).take(some)],
        names=["_node", "_mark", "_second", "_links", "_to"],
    )


def _sampled(classes: DataFrame, size: int, kind: str) -> np.ndarray:
    """Up to SAMPLE distinct vectors, chosen by hash: the same on every run."""
    most = max(64, min(SAMPLE, SAMPLE_NUMBERS // size))
    chosen = classes.orderBy(F.xxhash64(F.lit(SEED), "_mark"), "_mark", "_second").limit(most).select("_vector").toArrow()
    return _matrix(chosen.column("_vector"), kind)


def _linked(classes: DataFrame, size: int, kind: str, threshold: float, recall: float) -> DataFrame:
    """MET rows of distinct vectors of one length."""
    codes = learnt(_sampled(classes, size, kind), classes.count(), threshold, recall)
    rows = classes.select(CLASS).mapInArrow(_keyed(codes, kind), f"_bucket long, {CLASS_KINDS}, _keys binary")
    sizes = rows.groupBy("_bucket").agg(F.count("*").alias("_n")).filter(F.col("_n") > BLOCK)
    crowded = written(sizes.select("_bucket", F.ceil(F.col("_n") / BLOCK).cast("int").alias("_blocks")), "crowded")
    blocks = F.coalesce("_blocks", F.lit(1))
    dealt = rows.join(crowded, "_bucket", "left").withColumns({"_of": blocks, "_block": F.pmod(F.xxhash64("_mark", "_second"), blocks).cast("int")})
    # to the cells of its block with every block, itself included
    cells = dealt.withColumn("_with", F.explode(F.sequence(F.lit(0), F.col("_of") - 1)))
    cells = cells.withColumns({"_low": F.least("_block", "_with"), "_high": F.greatest("_block", "_with")})
    order = ["_bucket", "_low", "_high"]
    met = cells.select(*order, "_block", *CLASS, "_keys")
    return met.repartition(*order).sortWithinPartitions(*order).mapInArrow(_compared(codes, kind, threshold), MET)


def near_vectors(rows: DataFrame, key: str = "vec_id", vector: str = "embedding", threshold: float = THRESHOLD, recall: float = RECALL) -> DataFrame:
    """One row per vector: its links and its group's smallest key.

    Two vectors link if their cosine is at least ``threshold``; of such pairs
    at least ``recall`` are found as measured on pairs at the threshold, and no
    other pair links.  Vectors that are null, empty, zero, or hold a null or
    non-finite entry link with nothing; vectors of different lengths do not
    link.  Equal vectors link with each other if they have a direction.  Rows
    that repeat a key are one node of the groups; a null key takes part through
    its vector and names a group only where no other row does (component then
    null).  Only the two named columns are read; an empty table gives no rows.

    Returns key, n_links, component_id, kept (the key is the group's smallest).
    """
    (name,) = fresh(rows, "_key")
    element = rows.schema[vector].dataType.elementType.simpleString()
    element, kind = ("float", "<f4") if element == "float" else ("double", "<f8")
    # minus zero is zero
    plain = F.transform("_vector", lambda c: c.cast(element) + F.lit(0.0).cast(element))
    given = rows.select(F.col(key).cast("long").alias(name), F.col(vector).alias("_vector"))
    given = given.select(name, F.when(usable(F.col("_vector")), plain).alias("_vector"))
    marks = {"_mark": F.xxhash64("_vector"), "_second": F.xxhash64(F.lit(SEED), "_vector")}

    classes = given.filter(F.col("_vector").isNotNull()).groupBy("_vector").agg(F.min(name).alias("_least"), F.count("*").alias("_rows")).withColumns(marks)
    # a class of null keys only gets a name above all keys, hidden again at the end
    nameless = F.col("_mark").bitwiseOR(F.lit(1 << 62)).bitwiseAND(F.lit((1 << 63) - 1))
    classes = classes.select(F.coalesce("_least", nameless).alias("_node"), "_mark", "_second", "_rows", "_vector", F.size("_vector").alias("_size"))
    classes = written(classes.mapInArrow(_packed(kind), f"{CLASS_KINDS}, _size int"), "vectors")

    # vectors of one length are a table of their own; there are few lengths
    met = given.sparkSession.createDataFrame([], MET)
    for (size,) in classes.select("_size").distinct().orderBy("_size").collect():
        met = met.union(_linked(classes.filter(F.col("_size") == size), size, kind, threshold, recall))
    met = staged(met)
    groups = components(met.select(F.col("_node").alias("u"), F.col("_to").alias("v")))
    links = met.groupBy("_mark", "_second").agg(F.sum("_links").alias("_links"))
    known = classes.join(links, ["_mark", "_second"], "left").join(groups, F.col("_node") == F.col("node"), "left")
    known = known.select("_mark", "_second", (F.coalesce("_links", F.lit(0)) + F.col("_rows") - 1).alias("n_links"), F.coalesce("component_id", "_node").alias("_component"))

    own = F.coalesce("_component", name)
    component = F.when(F.col(name).isNull() & (own >= 1 << 62), F.lit(None)).otherwise(own).cast("long")
    linked = given.filter(F.col("_vector").isNotNull()).withColumns(marks).drop("_vector").join(known, ["_mark", "_second"]).select(name, "n_links", component.alias("_component"))
    alone = given.filter(F.col("_vector").isNull()).select(name, F.lit(0).cast("long").alias("n_links"), F.col(name).alias("_component"))
    kept = F.col(name).eqNullSafe(F.col("_component"))
    return linked.union(alone).select(F.col(name).alias(key), "n_links", F.col("_component").alias("component_id"), kept.alias("kept"))
