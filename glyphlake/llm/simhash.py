"""Near duplicates: SimHash fingerprints compared at the anchors of a code.

Anchors.  The 64 bits of a fingerprint are cut into three blocks.  If two
fingerprints differ in at most four bits, they differ in at most one bit in
one of the blocks, since 2 + 2 + 2 > 4.  On each block the anchors are a
covering code: a Hamming code on its first 15 bits, in which every word lies
within radius 1 of exactly one codeword, next to all words on the other 6 or 7
bits (radius 0).  A fingerprint's home is the anchor that covers it.  It is
copied to every anchor that a word within the threshold (one bit) could call
home: those in reach of covering radius plus threshold.  So two fingerprints
whose block differs in at most one bit always meet at the home of either.

Comparison.  At an anchor only those at home are compared with all others.
Fingerprints are distinct there, so copies of a text are one row however many
they are.  A small meeting is compared at once; a large one is searched from
fingerprint to fingerprint, each found one leaving the set of those still to
be found, so a dense group costs about its size.  Either way a meeting reports
a tree of links, never all its pairs: each fingerprint points to the smallest
id that the meeting joins it to, by links that were all verified on 64 bits.

Components.  The trees are joined by alternating large-star and small-star
steps, each an aggregate and an equi-join, until no edge changes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glyphlake.llm.common import fresh, staged

SHINGLE = 4
MOST_BITS = 4
SEED = 42
BLOCKS = ((0, 22), (22, 21), (43, 21))
HAMMING = 15
CHUNK = 1 << 15
PAIRS_AT_ONCE = 1 << 21

_LOWER_BITS = np.arange(7, -1, -1)


def fingerprint(text: str | None, size: int = SHINGLE) -> int:
    """SimHash of a whole text, as a signed 64-bit number.

    A-Z are made lower case; words are runs of characters other than ASCII
    white space; a text with fewer words than ``size`` is one shingle, a text
    with none (or null) has the fingerprint 0.
    """
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    span = min(size, len(words))
    first, last = starts[: len(words) - span + 1], ends[span - 1 :]
    ones = np.zeros(64, np.int64)
    hashed = xxhash.xxh64_intdigest
    for at in range(0, len(first), CHUNK):
        pairs = zip(first[at : at + CHUNK].tolist(), last[at : at + CHUNK].tolist(), strict=True)
        found = np.array([hashed(joined[a:b], SEED) for a, b in pairs], np.uint64)
        ones += np.unpackbits(found.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    bits = np.packbits(2 * ones > len(first))
    return int.from_bytes(bits.tobytes(), "big", signed=True)


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        marks = [fingerprint(t.as_py()) for t in batch.column("text")]
        yield pa.record_batch([batch.column("doc_id"), pa.array(marks, pa.int64())], names=["doc_id", "_mark"])


def _syndromes() -> np.ndarray:
    """For each 15-bit word, the number of the bit that leads to its codeword,
    counted from 1; 0 if it is a codeword."""
    words = np.arange(1 << HAMMING)
    found = np.zeros(1 << HAMMING, np.int64)
    for bit in range(HAMMING):
        found ^= np.where(words >> bit & 1, bit + 1, 0)
    return found


def _anchors(marks: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places in ``marks``, anchors they go to, and whether each is the home."""
    syndromes = _syndromes()
    rows, anchors, homes = [], [], []
    everyone = np.arange(len(marks))
    for number, (start, width) in enumerate(BLOCKS):
        block = (marks >> np.uint64(start)).astype(np.int64) & ((1 << width) - 1)
        code, rest = block & ((1 << HAMMING) - 1), block >> HAMMING

        def home_of(word: np.ndarray) -> np.ndarray:
            lead = syndromes[word]
            return np.where(lead > 0, word ^ (1 << np.maximum(lead - 1, 0)), word)

        own = home_of(code)
        tag = number << 32
        reach = [own] + [home_of(code ^ (1 << bit)) for bit in range(HAMMING)]
        # flips of one bit reach the home itself too, and some anchors twice
        stacked = np.sort(np.stack(reach), axis=0)
        new = np.ones(stacked.shape, bool)
        new[1:] = stacked[1:] != stacked[:-1]
        at, who = np.nonzero(new)
        anchor = stacked[at, who]
        rows.append(who)
        anchors.append(tag | (rest[who] << HAMMING) | anchor)
        homes.append(anchor == own[who])
        for bit in range(width - HAMMING):
            rows.append(everyone)
            anchors.append(tag | ((rest ^ (1 << bit)) << HAMMING) | own)
            homes.append(np.zeros(len(marks), bool))
    return np.concatenate(rows), np.concatenate(anchors), np.concatenate(homes)


def _copies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, 4096):
            part = batch.slice(at, 4096)
            marks = part.column("_mark").to_numpy(zero_copy_only=False).view(np.uint64)
            rows, anchors, homes = _anchors(marks)
            yield pa.record_batch(
                [pa.array(anchors), pa.array(marks[rows].view(np.int64)), part.column("_id").take(pa.array(rows)), pa.array(homes)],
                names=["_anchor", "_mark", "_id", "_home"],
            )


def _roots(count: int, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Smallest member of each component of a small graph on 0..count-1."""
    root = np.arange(count)
    while len(left):
        low, high = np.minimum(root[left], root[right]), np.maximum(root[left], root[right])
        open_ = low != high
        if not open_.any():
            break
        left, right, low, high = left[open_], right[open_], low[open_], high[open_]
        np.minimum.at(root, high, low)
        while True:
            higher = root[root]
            if np.array_equal(higher, root):
                break
            root = higher
    return root


def _search(marks: np.ndarray, homes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A spanning tree of each component of one large meeting."""
    left, right = [], []
    open_ = np.concatenate([np.flatnonzero(homes), np.flatnonzero(~homes)])
    while len(open_) and homes[open_[0]]:
        queue = [open_[0]]
        open_ = open_[1:]
        while queue and len(open_):
            at = queue.pop()
            near = np.bitwise_count(marks[open_] ^ marks[at]) <= MOST_BITS
            if not homes[at]:
                near &= homes[open_]
            found = open_[near]
            if len(found):
                open_ = open_[~near]
                queue.extend(found.tolist())
                left.append(np.full(len(found), at))
                right.append(found)
    none = np.zeros(0, np.int64)
    return np.concatenate([none, *left]), np.concatenate([none, *right])


def _links(anchors: np.ndarray, marks: np.ndarray, ids: np.ndarray, homes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges (id, smaller id it belongs to) of whole meetings, sorted by anchor."""
    starts = np.flatnonzero(np.concatenate(([True], anchors[1:] != anchors[:-1])))
    sizes = np.diff(np.append(starts, len(anchors)))
    first, size = np.repeat(starts, sizes), np.repeat(sizes, sizes)
    left, right = [], []
    small = homes & (size <= 512) & (size > 1)
    asking = np.flatnonzero(small)
    ends = np.cumsum(size[asking])
    at = 0
    while at < len(asking):
        until = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + PAIRS_AT_ONCE)))
        some = asking[at:until]
        each = size[some]
        one = np.repeat(some, each)
        offset = np.arange(len(one)) - np.repeat(np.cumsum(each) - each, each)
        other = first[one] + offset
        near = (np.bitwise_count(marks[one] ^ marks[other]) <= MOST_BITS) & (one != other)
        left.append(one[near])
        right.append(other[near])
        at = until
    for begin, n in zip(starts[sizes > 512].tolist(), sizes[sizes > 512].tolist(), strict=True):
        a, b = _search(marks[begin : begin + n], homes[begin : begin + n])
        left.append(a + begin)
        right.append(b + begin)
    a, b = np.concatenate([np.zeros(0, np.int64), *left]), np.concatenate([np.zeros(0, np.int64), *right])
    if not len(a):
        return ids[:0], ids[:0]
    # number the rows of each meeting by id, so that the smallest row is the smallest id
    order = np.lexsort((ids, anchors))
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    root = _roots(len(order), rank[a], rank[b])
    sorted_ids = ids[order]
    member = np.flatnonzero(root != np.arange(len(root)))
    return sorted_ids[member], sorted_ids[root[member]]


def _meetings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Compare sorted rows, meeting by meeting; memory: a batch and a meeting."""
    held: pa.Table | None = None

    def told(table: pa.Table) -> Iterator[pa.RecordBatch]:
        cols = [table.column(n).to_numpy() for n in ("_anchor", "_mark", "_id", "_home")]
        a, b = _links(cols[0], cols[1].view(np.uint64), cols[2], cols[3])
        if len(a):
            both = np.unique(np.stack([a, b], axis=1), axis=0)
            yield pa.record_batch([pa.array(both[:, 0]), pa.array(both[:, 1])], names=["u", "v"])

    for batch in batches:
        if batch.num_rows == 0:
            continue
        table = pa.Table.from_batches([batch])
        anchors = batch.column("_anchor").to_numpy()
        cut = int(np.searchsorted(anchors, anchors[-1]))
        if held is not None:
            if cut == 0 and held.column("_anchor")[-1].as_py() == anchors[-1]:
                held = pa.concat_tables([held, table])
                continue
            table = pa.concat_tables([held, table])
            cut += held.num_rows
        yield from told(table.slice(0, cut).combine_chunks())
        held = table.slice(cut)
    if held is not None:
        yield from told(held.combine_chunks())


def components(edges: DataFrame) -> DataFrame:
    """Connected components of ``edges (u, v)``: one row ``node, component_id``
    per node of an edge, the component being the smallest node reachable.

    A large-star step points each larger neighbour of a node to its smallest
    neighbour, a small-star step does so for the smaller ones; both keep
    connectivity.  A hub's neighbours are reduced to a minimum before the
    shuffle, and meet it in an equi-join that adaptive execution may split.
    """
    edges = staged(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u <> v").distinct())

    def state(e: DataFrame) -> tuple:
        return tuple(e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())

    now = state(edges)
    while now[0]:
        both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("_least"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("_least").alias("v")).filter("u <> v").distinct()
        below = large.groupBy("u").agg(F.min("v").alias("_least"))
        small = large.join(below, "u").select(F.col("v").alias("u"), F.col("_least").alias("v")).union(below.select("u", F.col("_least").alias("v")))
        edges = staged(small.filter("u <> v").distinct())
        before, now = now, state(edges)
        if before == now:
            break
    members = edges.select(F.col("u").alias("node"), F.col("v").alias("component_id"))
    return members.union(edges.select(F.col("v").alias("node"), F.col("v").alias("component_id")).distinct())


def near_groups(docs: DataFrame) -> DataFrame:
    """One row per document: its fingerprint and its group's smallest doc_id.

    Null and blank texts have the fingerprint 0 and link like any other.  Rows
    that repeat an id are one node.  A null id takes part through its text: it
    is in the group, and names it only where no other row has its fingerprint
    (component_id is then that of what the fingerprint links to, or null).
    Only doc_id and text are read; an empty table gives no rows.

    Returns doc_id, fingerprint (16 hex digits), component_id.
    """
    marked = staged(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(_fingerprints, "doc_id long, _mark long"))
    # a class of equal fingerprints is named by its smallest id; a class of null
    # ids only gets a name below all ids, which is hidden again at the end
    classes = marked.groupBy("_mark").agg(F.min("doc_id").alias("_least"))
    classes = classes.select("_mark", F.coalesce("_least", F.xxhash64("_mark").bitwiseOR(F.lit(1 << 62)).bitwiseAND(F.lit((1 << 63) - 1))).alias("_id"), F.col("_least").isNull().alias("_nameless"))
    copies = classes.select("_mark", "_id").mapInArrow(_copies, "_anchor long, _mark long, _id long, _home boolean")
    met = copies.repartition("_anchor").sortWithinPartitions("_anchor")
    groups = components(met.mapInArrow(_meetings, "u long, v long"))
    named = classes.join(groups, F.col("_id") == F.col("node"), "left").select("_mark", F.coalesce("component_id", "_id").alias("_component"), "_nameless")
    hidden = F.when(F.col("_nameless") & (F.col("_component") >= (1 << 62)), F.lit(None)).otherwise(F.col("_component"))
    return marked.join(named, "_mark").select("doc_id", F.lower(F.lpad(F.hex("_mark"), 16, "0")).alias("fingerprint"), hidden.cast("long").alias("component_id"))


def keep_one_per_group(docs: DataFrame) -> DataFrame:
    """Of each group the document with the smallest id, whole and unchanged.

    Only the ids of documents that go are joined with the table.  Of rows that
    repeat an id, all stay if one of them does; rows without an id stay.
    """
    (name,) = fresh(docs, "_gone")
    stays = F.bool_or(F.col("doc_id") == F.col("component_id")).alias("stays")
    gone = near_groups(docs).groupBy(F.col("doc_id").alias(name)).agg(stays).filter("not stays").select(name)
    return docs.join(gone, F.col("doc_id") == F.col(name), "left_anti")
