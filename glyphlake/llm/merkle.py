"""A Merkle manifest of a table, proved leaf by leaf with a recursive query.

Digests.  A document's leaf is the SHA-256 of its columns, each with its length
before it.  The leaves of a source, in order of doc_id, are a tree of threes:
every run of three neighbours, the last run possibly shorter, becomes the
digest of their digests until one node is left, the source's subroot.  The
subroots, in order of source, are such a tree too; its last node is the root.

Stored nodes.  A stored row spans ``SPAN`` levels: it holds the digests of up
to 81 neighbours, of the runs they form, and so on up to the row's own digest,
and its place in its parent row.  Rows above the lowest are stored once for
each lowest row below them, so that no row, not even the root's, is asked for
by more than 729 leaves: there is no hot key however large a source is.

Proofs.  A recursive query starts from every leaf, with the digest that the
leaf has now, and climbs from row to row: it appends the siblings it passes and
folds the digest with them, up to the root.  A leaf is verified if that ends at
the stored root.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from glyphlake.llm.common import staged, written

SPAN = 6
WIDTH = 3**SPAN
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
ROOT_TREE = -1
ROW_LIMIT = "spark.sql.cteRecursionRowLimit"
STEP_LIMIT = "spark.sql.cteRecursionLevelLimit"

#: digests of a row's levels, as columns
LEVELS = [f"level_{i}" for i in range(SPAN)]


class Manifest(NamedTuple):
    """``leaves``: doc_id, tree, place, leaves, leaf, now.  ``nodes``: tree, step, spot,
    height, level_0 .. , up_slot, last.  ``trees``: tree, source, leaves,
    subroot.  ``root``: hex, or None for an empty table."""

    leaves: DataFrame
    nodes: DataFrame
    trees: DataFrame
    root: str | None


def leaf_digest(values: dict[str, Column]) -> Column:
    """SHA-256, as bytes, of the fields in their order, each ``-`` if null and
    else its UTF-8 length, a colon and the value."""
    parts = []
    for name in FIELDS:
        value = values[name].cast("string")
        parts.append(F.coalesce(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value), F.lit("-")))
    return F.unhex(F.sha2(F.concat(*parts), 256))


def _placed(rows: DataFrame, group: list[str], order: list[Column]) -> DataFrame:
    """The rows with ``_place``, gapless from 0 within each group, and ``_of``,
    the size of the group.  Rows are sorted by range, numbered within each
    range and shifted by what stands before; nothing holds a whole group.
    Equal rows are spread over ranges by a random key: any order of them will do.
    """
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    by = [*(F.col(g) for g in group), *order, F.col("_spread")]
    sorted_rows = rows.withColumn("_spread", F.rand(13)).repartitionByRange(parts, *by).sortWithinPartitions(*by).drop("_spread")
    at = staged(sorted_rows.withColumn("_at", F.monotonically_increasing_id())).withColumn("_range", F.shiftright("_at", 33))
    ranges = at.groupBy("_range", *group).agg(F.min("_at").alias("_first"), F.count("*").alias("_n"))
    # one row per range and group here
    over = Window.partitionBy(*(group or [F.lit(0)]))
    before = F.sum("_n").over(over.orderBy("_range").rowsBetween(Window.unboundedPreceding, 0)) - F.col("_n")
    starts = ranges.select("_range", *group, (before - F.col("_first")).alias("_shift"), F.sum("_n").over(over).alias("_of"))
    return at.join(written(starts, "ranges"), ["_range", *group]).withColumn("_place", F.col("_at") + F.col("_shift")).drop("_at", "_range", "_shift")


def _joined(digests: Column) -> Column:
    """One binary value of many digests."""
    return F.unhex(F.array_join(F.transform(digests, F.hex), ""))


def _runs(level: Column) -> Column:
    """The digests of the runs of three in a level, as one binary value."""
    runs = F.sequence(F.lit(0), F.floor((F.octet_length(level) - 1) / 96).cast("int"))
    return F.unhex(F.array_join(F.transform(runs, lambda i: F.sha2(F.lower(F.hex(F.substring(level, 96 * i + 1, F.lit(96)))), 256)), ""))


def _height(n: Column) -> Column:
    """Levels of a row in a tree that has n nodes beside each other there."""
    out = F.lit(SPAN)
    for levels in range(SPAN - 1, 0, -1):
        out = F.when(n <= 3**levels, F.lit(levels)).otherwise(out)
    return out


def _rows_above(nodes: DataFrame) -> DataFrame:
    """Stored rows over ``nodes (tree, n, idx, digest)`` of trees with n > 1:
    tree, n, idx of the row, height, the levels, and the row's own digest."""
    grouped = nodes.groupBy("tree", "n", F.expr(f"idx div {WIDTH}").alias("row"))
    found = grouped.agg(F.array_sort(F.collect_list(F.struct("idx", "digest"))).alias("_members"))
    found = found.select("tree", "n", F.col("row").alias("idx"), _height(F.col("n")).alias("height"), _joined(F.col("_members.digest")).alias(LEVELS[0]))
    for below, above in zip(LEVELS, [*LEVELS[1:], "_top"], strict=False):
        found = found.withColumn(above, _runs(F.col(below)))
    own = F.col("_top")
    for levels in range(SPAN - 1, 0, -1):
        own = F.when(F.col("height") == levels, F.col(LEVELS[levels])).otherwise(own)
    return staged(found.withColumn("digest", own).drop("_top"))


def _tree_rows(nodes: DataFrame, largest: int) -> tuple[list[DataFrame], DataFrame]:
    """All stored rows over ``nodes (tree, n, idx, digest)``, level by level, and
    the last digest of each tree.  ``largest``: the most nodes of any tree."""
    levels, tops = [], [nodes.filter("n = 1").select("tree", "digest")]
    for _ in range(_steps_of(largest)):
        rows = _rows_above(nodes.filter("n > 1"))
        levels.append(rows)
        nodes = rows.select("tree", F.expr(f"(n + {WIDTH - 1}) div {WIDTH}").alias("n"), "idx", "digest")
        tops.append(nodes.filter("n = 1").select("tree", "digest"))
    found = tops[0]
    for top in tops[1:]:
        found = found.union(top)
    return levels, found


def _steps_of(n: int) -> int:
    """Stored rows on the way from one of n nodes to the last one."""
    steps = 0
    while n > 1:
        n = -(-n // WIDTH)
        steps += 1
    return steps


def _steps(n: Column, most: int) -> Column:
    """The same for a column of values up to ``most``."""
    out = F.lit(_steps_of(most))
    for steps in range(_steps_of(most) - 1, -1, -1):
        out = F.when(n <= WIDTH**steps, F.lit(steps)).otherwise(out)
    return out


def build(docs: DataFrame, present: Column | None = None) -> Manifest:
    """The manifest of a table: leaves, stored nodes, subroots and root.

    ``present`` gives the text that a document is found to have now, if that
    may differ from the text the manifest is made of; the leaf then keeps its
    digest with that text as ``now``.

    Nulls: a null field has a digest of its own, a null source is a source and
    comes first, null ids come first within their source.  Rows that repeat an
    id are ordered by their leaf digest; equal rows are leaves of their own.
    An empty table has no leaves and no root.  Only doc_id, source, lang,
    n_chars and text are read.
    """
    spark = docs.sparkSession
    fields = {name: F.col(name) for name in FIELDS}
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.col("source").isNotNull().alias("_named"),
        F.coalesce(F.col("source").cast("string"), F.lit("")).alias("_source"),
        leaf_digest(fields).alias("leaf"),
        leaf_digest({**fields, "text": fields["text"] if present is None else present}).alias("now"),
    )
    # positions within sources, then positions of sources
    placed = _placed(rows, ["_named", "_source"], [F.col("doc_id").asc_nulls_first(), F.col("leaf")])
    placed = placed.withColumnsRenamed({"_place": "place", "_of": "leaves"})
    sources = _placed(placed.filter("place = 0").select("_named", "_source", "leaves"), [], [F.col("_named"), F.col("_source")])
    sources = written(sources.select("_named", "_source", "leaves", F.col("_place").alias("tree")), "sources")
    leaves = staged(placed.join(sources.drop("leaves"), ["_named", "_source"]).select("doc_id", "tree", "place", "leaves", "leaf", "now"))
    count, most = sources.agg(F.count("*"), F.max("leaves")).first()

    levels, subroots = _tree_rows(leaves.select("tree", F.col("leaves").alias("n"), F.col("place").alias("idx"), F.col("leaf").alias("digest")), most or 0)
    trees = sources.join(subroots, "tree").select(
        "tree", F.when(F.col("_named"), F.col("_source")).alias("source"), "leaves", F.col("digest").alias("subroot"), _steps(F.col("leaves"), most or 0).alias("_steps")
    )
    trees = written(trees, "trees")
    top_nodes = trees.select(F.lit(ROOT_TREE).cast("long").alias("tree"), F.lit(count).cast("long").alias("n"), F.col("tree").alias("idx"), F.col("subroot").alias("digest"))
    top_levels, root = _tree_rows(top_nodes, count)
    found = root.first()
    nodes = _stored(spark, levels, top_levels, trees)
    return Manifest(leaves, nodes, trees, found["digest"].hex() if found else None)


def _stored(spark: SparkSession, levels: list[DataFrame], top_levels: list[DataFrame], trees: DataFrame) -> DataFrame:
    """The stored rows, a copy for each lowest row below them, linked upwards.

    A row is found by tree, step (rows climbed from the leaf, from 1) and spot
    (the lowest row's place).  ``up_slot`` is its place in the row of the next
    step at the same spot; ``last`` marks a row whose digest is the root.
    """
    known = trees.select("tree", "leaves", "_steps")
    has_top = F.lit(len(top_levels) > 0)
    lowest = F.expr(f"(leaves - 1) div {WIDTH}")
    columns = ["tree", "step", "spot", "height", *LEVELS, "up_slot", "last"]
    out = []
    for at, rows in enumerate(levels):
        below = WIDTH**at
        spots = F.sequence(F.col("idx") * below, F.least(F.col("idx") * below + (below - 1), lowest))
        is_top = F.col("_steps") == at + 1
        found = rows.join(known, "tree").withColumns(
            {
                "step": F.lit(at + 1),
                "spot": F.explode(spots),
                "up_slot": F.when(is_top, F.col("tree") % WIDTH).otherwise(F.col("idx") % WIDTH).cast("int"),
                "last": is_top & ~has_top,
            }
        )
        out.append(found.select(columns))
    for at, rows in enumerate(top_levels):
        asking = known.withColumn("idx", F.expr(f"tree div {WIDTH ** (at + 1)}L"))
        found = rows.drop("tree").join(asking, "idx").withColumns(
            {
                "step": F.col("_steps") + (at + 1),
                "spot": F.explode(F.sequence(F.lit(0).cast("long"), lowest)),
                "up_slot": (F.col("idx") % WIDTH).cast("int"),
                "last": F.lit(at + 1 == len(top_levels)),
            }
        )
        out.append(found.select(columns))
    if not out:
        kinds = ["tree long", "step int", "spot long", "height int", *(f"{c} binary" for c in LEVELS), "up_slot int", "last boolean"]
        return spark.createDataFrame([], ", ".join(kinds))
    stored = out[0]
    for more in out[1:]:
        stored = stored.unionByName(more)
    return written(stored, "nodes")


def _siblings(level: int) -> str:
    """The digests before and after a slot's own on one level of a row."""
    at, of = f"int(c.slot div {3**level})", f"n.{LEVELS[level]}"
    return f"named_struct('b', substring({of}, 96 * int({at} div 3) + 1, 32 * ({at} % 3)), 'a', substring({of}, 32 * {at} + 33, 32 * (2 - {at} % 3)))"


#: one step: climb the levels of a row, appending siblings and folding
_STEP = f"""aggregate(slice(array({", ".join(map(_siblings, range(SPAN)))}), 1, n.height), named_struct('proof', c.proof, 'folded', c.folded), (s, x) -> named_struct(
  'proof', concat(s.proof, x.b, x.a),
  'folded', unhex(sha2(lower(hex(concat(x.b, s.folded, x.a))), 256))))"""

_CLIMB = f"""WITH RECURSIVE climb (doc_id, tree, leaf, spot, step, slot, proof, folded, done) AS (
  SELECT doc_id, tree, leaf, spot, 1, slot, X'', now, done FROM {{starts}}
  UNION ALL
  SELECT doc_id, tree, leaf, spot, step + 1, up_slot, climbed.proof, climbed.folded, last FROM (
    SELECT c.doc_id, c.tree, c.leaf, c.spot, c.step, n.up_slot, n.last, {_STEP} AS climbed
    FROM climb c JOIN {{nodes}} n ON n.tree = c.tree AND n.step = c.step AND n.spot = c.spot WHERE NOT c.done))
SELECT doc_id, tree, leaf, proof, folded FROM climb WHERE done"""


def climbed(leaves: DataFrame, nodes: DataFrame, alone: bool) -> DataFrame:
    """doc_id, tree, leaf, proof and folded digest of ``leaves (doc_id, tree,
    place, leaves, leaf, now)``, where now is the digest to fold.  ``alone``:
    there is one source, so a source with one leaf needs no step at all."""
    spark = leaves.sparkSession
    lone = F.col("leaves") == 1
    starts = leaves.select(
        "doc_id",
        "tree",
        "leaf",
        "now",
        F.expr(f"place div {WIDTH}").alias("spot"),
        F.when(lone, F.col("tree") % WIDTH).otherwise(F.col("place") % WIDTH).cast("int").alias("slot"),
        (lone & F.lit(alone)).alias("done"),
    )
    # the query's own bounds on rows and steps guard against endless recursion;
    # a climb ends at the root
    before = {key: spark.conf.get(key) for key in (ROW_LIMIT, STEP_LIMIT)}
    try:
        for key in before:
            spark.conf.set(key, "-1")
        return written(spark.sql(_CLIMB, starts=starts, nodes=nodes), "proofs")
    finally:
        for key, value in before.items():
            spark.conf.set(key, value)


def proved(manifest: Manifest) -> DataFrame:
    """Prove every leaf against the manifest, with the digest it has ``now``.

    Returns doc_id, leaf, subroot, root, proof (the siblings' digests, joined),
    folded_root, verified; digests in lowercase hex.
    """
    text = lambda c: F.lower(F.hex(c))
    ways = climbed(manifest.leaves, manifest.nodes, manifest.trees.count() == 1)
    return ways.join(manifest.trees.select("tree", "subroot"), "tree").select(
        "doc_id",
        text("leaf").alias("leaf"),
        text("subroot").alias("subroot"),
        F.lit(manifest.root).alias("root"),
        text("proof").alias("proof"),
        text("folded").alias("folded_root"),
        (text("folded") == F.lit(manifest.root)).alias("verified"),
    )
