"""Line dedup by pairwise alignment.

Documents that share a line are found through the hashes of their lines, lined
up by patience diff, and common blocks are deleted from the later document
(the larger id).  Which lines mark a pair and which only ride along follows
from rarity: a line that occurs once in both documents is an anchor, the gaps
between anchors have anchors of their own, and where none is left the longest
common runs are matched.  A block goes at every place where the later document
has it, in whatever order.

Which documents are compared follows from windows: the shortest runs of lines
that make a block, from each line on and up to each line.  Any common block
consists of windows that both documents hold, however short its lines are, so
every holder of a window is compared with the window's first holder, and with
no other.  A window that a third of all documents hold costs one comparison per
holder; nothing is left out for being frequent, and the first holder of a
window keeps it.  A comparison sees all lines of both documents, whoever else
holds them.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glyphlake.llm.common import sliced, written

#: shorter common blocks are left where they are
BLOCK_WORDS = 8

LINES = "doc_id long, _version long, _line binary, _words int, _places array<int>"
#: bytes of the hash of a line
KEY = 16


def filled_lines(text: str | None) -> list[bytes]:
    """The lines with a word, white space made single spaces, in UTF-8."""
    found = ((text or "").encode("utf-8", "surrogatepass")).split(b"\n")
    return [b" ".join(words) for words in map(bytes.split, found) if words]


def _lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row per document and different line: hash, words, and places."""
    for part in sliced(batches):
        ids, versions, hashes, words, places = [], [], [], [], []
        for doc_id, version, text in zip(*(part.column(n).to_pylist() for n in ("doc_id", "_version", "text")), strict=True):
            found: dict[bytes, list[int]] = {}
            for place, line in enumerate(filled_lines(text)):
                found.setdefault(line, []).append(place)
            for line, where in found.items():
                ids.append(doc_id)
                versions.append(version)
                hashes.append(xxhash.xxh3_128_digest(line))
                words.append(line.count(b" ") + 1)
                places.append(where)
        yield pa.record_batch([pa.array(ids, pa.int64()), pa.array(versions, pa.int64()), pa.array(hashes, pa.binary()), pa.array(words, pa.int32()), pa.array(places, pa.list_(pa.int32()))], names=["doc_id", "_version", "_line", "_words", "_places"])


def _rising(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The longest run of pairs, sorted by the first, whose second rises."""
    tops: list[int] = []
    last: list[int] = []
    before: list[int] = []
    for number, (_, q) in enumerate(pairs):
        pile = bisect_left(tops, q)
        if pile == len(tops):
            tops.append(q)
            last.append(number)
        else:
            tops[pile], last[pile] = q, number
        before.append(last[pile - 1] if pile else -1)
    out, at = [], last[-1] if last else -1
    while at >= 0:
        out.append(pairs[at])
        at = before[at]
    return out[::-1]


def common_blocks(shared: list[tuple[int, list[int], list[int]]], block_words: int = BLOCK_WORDS) -> list[int]:
    """Places in the later document of the lines to delete.

    ``shared``: words, places in the later and in the earlier document, for
    each line the two have in common.  Lines that occur once in both are the
    anchors (if none does, first occurrences are); the longest rising run of
    them is the alignment.  From each anchor a block grows up and down over
    equal lines, as far as the neighbouring anchors.  Blocks of fewer than
    ``block_words`` words are not reported.
    """
    words = {p: w for w, later, _ in shared for p in later}
    there = {p: earlier for _, later, earlier in shared for p in later}
    once = [(later[0], earlier[0]) for _, later, earlier in shared if len(later) == len(earlier) == 1]
    chain = _rising(sorted(once or [(min(later), min(earlier)) for _, later, earlier in shared]))
    equal = {p: set(q) for p, q in there.items()}
    matched: list[tuple[int, int]] = []
    for number, (p, q) in enumerate(chain):
        floor = matched[-1] if matched else (-1, -1)
        if p <= floor[0] or q <= floor[1]:
            continue
        up = []
        a, b = p - 1, q - 1
        while a > floor[0] and b > floor[1] and b in equal.get(a, ()):
            up.append((a, b))
            a, b = a - 1, b - 1
        matched.extend(up[::-1])
        matched.append((p, q))
        limit = chain[number + 1] if number + 1 < len(chain) else (float("inf"), float("inf"))
        a, b = p + 1, q + 1
        while a < limit[0] and b < limit[1] and b in equal.get(a, ()):
            matched.append((a, b))
            a, b = a + 1, b + 1
    out: list[int] = []
    block: list[int] = []
    for number, (p, q) in enumerate(matched):
        block.append(p)
        if number + 1 == len(matched) or matched[number + 1] != (p + 1, q + 1):
            if sum(words[x] for x in block) >= block_words:
                out.extend(block)
            block = []
    return out


def _aligned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in sliced(batches):
        places = [common_blocks([(s["words"], s["later"], s["earlier"]) for s in shared]) for shared in batch.column("_shared").to_pylist()]
        yield pa.record_batch([batch.column("doc_id"), batch.column("_version"), batch.column("_first"), pa.array(places, pa.list_(pa.int32()))], names=["doc_id", "version", "earlier_id", "places"])


def aligned_pairs(docs: DataFrame) -> DataFrame:
    """Pairs with something to delete: doc_id (later), version (a hash of its
    text), earlier_id, places (of the lines with a word, counted from 0 among
    these).

    The plain form: one comparison per line with the line's first holder, on
    the lines first held there alone, by ``common_blocks`` in one pass.  ``without_common_blocks`` takes
    ``compared_pairs``."""
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.xxhash64(F.col("text").cast("string")).alias("_version")).filter(F.col("doc_id").isNotNull())
    lines = written(source.mapInArrow(_lines, LINES), "lines")
    # the first holder with its places; partial minima go through the shuffle
    first = lines.groupBy("_line").agg(F.min(F.struct("doc_id", "_version", "_places")).alias("_holder"), F.max("doc_id").alias("_last")).filter(F.col("_holder.doc_id") < F.col("_last"))
    first = first.select("_line", F.col("_holder.doc_id").alias("_first"), F.col("_holder._places").alias("_there"))
    met = lines.join(first, "_line").filter(F.col("doc_id") > F.col("_first"))
    shared = F.struct(F.col("_words").alias("words"), F.col("_places").alias("later"), F.col("_there").alias("earlier"))
    pairs = met.groupBy("doc_id", "_version", "_first").agg(F.collect_list(shared).alias("_shared"))
    return pairs.mapInArrow(_aligned, "doc_id long, version long, earlier_id long, places array<int>").filter(F.size("places") > 0)


def windows(words: list[int], block_words: int = BLOCK_WORDS) -> list[tuple[int, int]]:
    """The shortest runs (start, end) of ``block_words`` words or more, from
    each line on and up to each line.  Those inside a block cover all of it."""
    out, end, total = set(), 0, 0
    for start, count in enumerate(words):
        while end < len(words) and total < block_words:
            total += words[end]
            end += 1
        if total < block_words:
            break
        out.add((start, end))
        total -= count
    start, total = 0, 0
    for end, count in enumerate(words, 1):
        total += count
        while total - words[start] >= block_words:
            total -= words[start]
            start += 1
        if total >= block_words:
            out.add((start, end))
    return sorted(out)


def _keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row per document that holds a block: hashes and words of its lines."""
    for part in sliced(batches):
        ids, versions, keys, words = [], [], [], []
        for doc_id, version, text in zip(*(part.column(n).to_pylist() for n in ("doc_id", "_version", "text")), strict=True):
            lines = filled_lines(text)
            counts = [line.count(b" ") + 1 for line in lines]
            if sum(counts) >= BLOCK_WORDS:
                ids.append(doc_id)
                versions.append(version)
                keys.append(b"".join(map(xxhash.xxh3_128_digest, lines)))
                words.append(counts)
        yield pa.record_batch([pa.array(ids, pa.int64()), pa.array(versions, pa.int64()), pa.array(keys, pa.binary()), pa.array(words, pa.list_(pa.int32()))], names=["doc_id", "_version", "_keys", "_words"])


def _windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row per document and different window."""
    for part in sliced(batches):
        at, found = [], []
        for number, (keys, words) in enumerate(zip(part.column("_keys").to_pylist(), part.column("_words").to_pylist(), strict=True)):
            some = {xxhash.xxh3_128_digest(keys[KEY * start : KEY * end]) for start, end in windows(words)}
            at.extend([number] * len(some))
            found.extend(some)
        whose = part.select(["doc_id", "_version", "_row"]).take(pa.array(at, pa.int64()))
        yield pa.RecordBatch.from_arrays([*whose.columns, pa.array(found, pa.binary())], names=[*whose.schema.names, "_window"])


def _longest_run(later: list[bytes], before: list[int], earlier: list[bytes], gap: tuple[int, int, int, int]) -> tuple[int, int, int]:
    """The common run with most words within a gap: its starts and length.

    A suffix automaton of the earlier lines, so time is linear however often a
    line is repeated."""
    a0, a1, b0, b1 = gap
    steps: list[dict[bytes, int]] = [{}]
    link, length, ends = [-1], [0], [0]
    last = 0
    for q in range(b0, b1):
        line, at = earlier[q], last
        last = len(steps)
        steps.append({})
        link.append(0)
        length.append(length[at] + 1)
        ends.append(q + 1)
        while at >= 0 and line not in steps[at]:
            steps[at][line] = last
            at = link[at]
        if at >= 0:
            to = steps[at][line]
            if length[to] != length[at] + 1:
                steps.append(dict(steps[to]))
                link.append(link[to])
                length.append(length[at] + 1)
                ends.append(ends[to])
                copy = link[to] = len(steps) - 1
                while at >= 0 and steps[at].get(line) == to:
                    steps[at][line] = copy
                    at = link[at]
                to = copy
            link[last] = to
    best, at, n = (0, 0, 0, 0), 0, 0
    for p in range(a0, a1):
        while at and later[p] not in steps[at]:
            at = link[at]
            n = length[at]
        if later[p] in steps[at]:
            at, n = steps[at][later[p]], n + 1
            count = before[p + 1] - before[p + 1 - n]
            if count > best[0]:
                best = (count, p + 1 - n, ends[at] - n, n)
    return best[1:]


def _where(lines: list[bytes], start: int, end: int) -> dict[bytes, list[int]]:
    found: dict[bytes, list[int]] = {}
    for place in range(start, end):
        found.setdefault(lines[place], []).append(place)
    return found


def alignment(later: list[bytes], before: list[int], earlier: list[bytes], start: int, end: int, block_words: int) -> list[tuple[int, int]]:
    """Matched places of the later lines from ``start`` to ``end`` with the
    earlier ones, in the order of both.  ``before``: running sums of words.

    Lines that occur once in both parts of a gap are its anchors, the longest
    rising run of them counts; from each, equal lines match up and down as far
    as the neighbouring anchors, and the gaps between are treated alike.  In a
    gap without an anchor, the common run with most words is taken."""
    matched: list[tuple[int, int]] = []
    gaps = [(start, end, 0, len(earlier))]
    while gaps:
        a0, a1, b0, b1 = gaps.pop()
        if before[a1] - before[a0] < block_words:
            continue  # what touches a match has been matched; a block needs more
        here, there = _where(later, a0, a1), _where(earlier, b0, b1)
        both = here.keys() & there.keys()
        chain = _rising(sorted((here[x][0], there[x][0]) for x in both if len(here[x]) == len(there[x]) == 1))
        if both and not chain:
            p, q, n = _longest_run(later, before, earlier, (a0, a1, b0, b1))
            if before[p + n] - before[p] >= block_words:
                chain = [(p, q)]
        for number, (p, q) in enumerate(chain):
            if p < a0 or q < b0:
                continue
            top, over = p, q
            while top > a0 and over > b0 and later[top - 1] == earlier[over - 1]:
                top, over = top - 1, over - 1
            gaps.append((a0, top, b0, over))
            limit = chain[number + 1] if number + 1 < len(chain) else (a1, b1)
            a0, b0 = p + 1, q + 1
            while a0 < limit[0] and b0 < limit[1] and later[a0] == earlier[b0]:
                a0, b0 = a0 + 1, b0 + 1
            matched.extend(zip(range(top, a0), range(over, b0), strict=True))
        if chain:
            gaps.append((a0, a1, b0, b1))
    return sorted(matched)


def _blocks(matched: list[tuple[int, int]], before: list[int], block_words: int) -> list[tuple[int, int]]:
    """Runs (start, end) in the later document that are runs in both."""
    out, start = [], 0
    for number, (p, q) in enumerate(matched):
        if number + 1 == len(matched) or matched[number + 1] != (p + 1, q + 1):
            if before[p + 1] - before[matched[start][0]] >= block_words:
                out.append((matched[start][0], p + 1))
            start = number + 1
    return out


def places_held(later: list[bytes], words: list[int], earlier: list[bytes], block_words: int = BLOCK_WORDS) -> list[int]:
    """Places in the later document of the lines to delete, from the whole
    line lists of both.

    Blocks of an alignment go, with every other place where a window of
    theirs stands in the later document.  What is left between them is
    aligned with the whole earlier document again, for blocks in another
    order, until nothing more is found."""
    if later == earlier:
        return list(range(len(later))) if sum(words) >= block_words else []
    before = [0]
    for count in words:
        before.append(before[-1] + count)
    own = [(s, e, b"".join(later[s:e])) for s, e in windows(words, block_words)]
    held = set(earlier)
    gone: set[int] = set()
    left = [(0, len(later))]
    while left:
        blocks: list[tuple[int, int]] = []
        for start, end in left:
            if before[end] - before[start] < block_words or held.isdisjoint(later[start:end]):
                continue
            found = _blocks(alignment(later, before, earlier, start, end, block_words), before, block_words)
            if not found:
                # short anchors in the way of a longer run
                p, _, n = _longest_run(later, before, earlier, (start, end, 0, len(earlier)))
                found = [(p, p + n)] if before[p + n] - before[p] >= block_words else []
            blocks.extend(found)
        if not blocks:
            break
        inside = {p: n for n, block in enumerate(blocks) for p in range(*block)}
        keys = {key for s, e, key in own if s in inside and inside[s] == inside.get(e - 1)}
        gone.update(inside)
        for s, e, key in own:
            if key in keys:
                gone.update(range(s, e))
        edges = [-1, *sorted(gone), len(later)]
        left = [(x + 1, y) for x, y in zip(edges, edges[1:], strict=False) if y > x + 1]
    return sorted(gone)


def _split(keys: bytes) -> list[bytes]:
    return [keys[at : at + KEY] for at in range(0, len(keys), KEY)]


def _compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in sliced(batches):
        columns = (batch.column(n).to_pylist() for n in ("_keys", "_words", "_there"))
        places = [places_held(_split(keys), words, _split(there)) for keys, words, there in zip(*columns, strict=True)]
        yield pa.record_batch([batch.column("doc_id"), batch.column("_version"), batch.column("_first"), pa.array(places, pa.list_(pa.int32()))], names=["doc_id", "version", "earlier_id", "places"])


def compared_pairs(docs: DataFrame) -> DataFrame:
    """As ``aligned_pairs``, from the whole line lists of both documents, for
    each document and the first holders of its windows."""
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.xxhash64(F.col("text").cast("string")).alias("_version")).filter(F.col("doc_id").isNotNull())
    keyed = source.mapInArrow(_keyed, "doc_id long, _version long, _keys binary, _words array<int>")
    # rows that repeat id and text are told apart by a number, kept with the table
    keyed = written(keyed.withColumn("_row", F.monotonically_increasing_id()), "lines")
    held = keyed.mapInArrow(_windows, "doc_id long, _version long, _row long, _window binary")
    # partial minima go through the shuffle
    first = held.groupBy("_window").agg(F.min(F.struct("doc_id", "_version", "_row")).alias("_holder"), F.max("doc_id").alias("_last")).filter(F.col("_holder.doc_id") < F.col("_last"))
    first = first.select("_window", F.col("_holder.doc_id").alias("_first"), F.col("_holder._row").alias("_first_row"))
    met = held.join(first, "_window").filter(F.col("doc_id") > F.col("_first"))
    # one row of those that repeat id and text
    pairs = met.groupBy("doc_id", "_version", "_first", "_first_row").agg(F.min("_row").alias("_row"))
    both = pairs.join(keyed.select("_row", "_keys", "_words"), "_row").join(keyed.select(F.col("_row").alias("_first_row"), F.col("_keys").alias("_there")), "_first_row")
    return both.select("doc_id", "_version", "_first", "_keys", "_words", "_there").mapInArrow(_compared, "doc_id long, version long, earlier_id long, places array<int>").filter(F.size("places") > 0)


def _without(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in sliced(batches):
        texts, lines, gone, words = [], [], [], []
        for text, places in zip(part.column("_text").to_pylist(), part.column("_places").to_pylist(), strict=True):
            deleted, kept, place, dropped = set(places or ()), [], -1, 0
            for line in text.split("\n") if text else []:
                count = len(line.encode("utf-8", "surrogatepass").split())
                place += count > 0
                if count and place in deleted:
                    dropped += count
                else:
                    kept.append(line)
            texts.append(text if not deleted else "\n".join(kept))
            lines.append(place + 1)
            gone.append(len(deleted))
            words.append(dropped)
        names = [n for n in part.schema.names if n not in ("_places", "_text")]
        yield pa.RecordBatch.from_arrays(
            [*[part.column(n) for n in names], pa.array(texts, pa.string()), pa.array(lines, pa.int64()), pa.array(gone, pa.int64()), pa.array(words, pa.int64())],
            names=[*names, "_kept_text", "_lines", "_gone", "_words_gone"],
        )


def without_common_blocks(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs``: doc_id, text (what is left of it, null if it
    was null), n_lines (with a word), n_deleted_lines, n_deleted_words and
    earlier_ids, the documents that hold the deleted blocks, in order.

    Lines are equal when equal after white space is single spaces; lines
    without a word stay.  Rows that repeat an id are never compared with each
    other; each loses the lines of its own text.  A null id has no
    place in the order, so its text stays as it is.  Columns beyond doc_id and
    text are not read; an empty table gives no rows.
    """
    found = compared_pairs(docs).groupBy(F.col("doc_id").alias("_id"), F.col("version").alias("_version")).agg(F.array_distinct(F.flatten(F.collect_list("places"))).alias("_places"), F.sort_array(F.collect_set("earlier_id")).alias("earlier_ids"))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("_text"))
    rows = rows.join(found, (F.col("doc_id") == F.col("_id")) & (F.xxhash64("_text") == F.col("_version")), "left")
    cut = rows.select("doc_id", F.coalesce("earlier_ids", F.array().cast("array<long>")).alias("earlier_ids"), "_places", "_text").mapInArrow(
        _without, "doc_id long, earlier_ids array<long>, _kept_text string, _lines long, _gone long, _words_gone long"
    )
    return cut.select("doc_id", F.col("_kept_text").alias("text"), F.col("_lines").alias("n_lines"), F.col("_gone").alias("n_deleted_lines"), F.col("_words_gone").alias("n_deleted_words"), "earlier_ids")
