"""Anchored windows of an event log: a window opens at a key's first event and
again at the first event after it has closed.

Where a window opens depends on all windows before it, but not within a time
slice: there, every possible entry leads to one exit.  So (1) every (key, time
slice) works out exits for all its entries at once, by pointer jumping; (2) a
key's slices, a short list each, are chained in order; (3) every slice marks
the openings its events belong to, again by pointer jumping.  A busy key is
split by time like any other, and no step loops over events.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glyphlake import fixed_values as fv
from glyphlake.operators.ops import wall_micros

C = F.col


def _whole_groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Sorted rows in tables that never cut a group of equal keys."""
    held: pa.Table | None = None
    for batch in batches:
        if batch.num_rows == 0:
            continue
        table = pa.Table.from_batches([batch])
        if held is not None:
            table = pa.concat_tables([held, table])
        values = [table.column(k).to_numpy() for k in keys]
        last = np.logical_and.reduce([v == v[-1] for v in values])
        cut = len(last) - int(np.argmin(last[::-1])) if not last.all() else 0
        if cut:
            yield table.slice(0, cut)
        held = table.slice(cut)
    if held is not None:
        yield held


class _Slices:
    """Rows of several (key, slice) groups, in order, as one numbered line."""

    def __init__(self, table: pa.Table, width: int, span: int) -> None:
        self.key, self.slice, self.t = (table.column(n).to_numpy() for n in ("key", "slice", "t"))
        self.count = len(self.t)
        new = np.ones(self.count, bool)
        new[1:] = (self.key[1:] != self.key[:-1]) | (self.slice[1:] != self.slice[:-1])
        self.starts = np.flatnonzero(new)
        self.ends = np.append(self.starts[1:], self.count)
        self.group = np.cumsum(new) - 1
        self.width, self.span = width, span
        # groups lie so far apart that no window reaches the next one
        self.line = self.t - self.slice * span + self.group * (2 * (span + width))
        step = np.searchsorted(self.line, self.line + width, side="right")
        self.next = np.where(step < self.ends[self.group], step, self.count)

    def after(self, opened: np.ndarray) -> np.ndarray:
        """First row of each group that lies beyond the window opened before."""
        first = self.starts
        far = np.maximum(opened + self.width - self.slice[first] * self.span, -1)
        found = np.searchsorted(self.line, far + np.arange(len(first)) * (2 * (self.span + self.width)), side="right")
        return np.clip(found, first, self.ends)


def _exits(width: int, span: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _whole_groups(batches, ["key", "slice"]):
            rows = _Slices(table, width, span)
            last = np.where(rows.next < rows.count, rows.next, np.arange(rows.count))
            while True:
                further = last[last]
                if np.array_equal(further, last):
                    break
                last = further
            # a window opened in an earlier slice closes within one width, so
            # later entries than the first one after that are never used
            at = rows.t - rows.slice * span
            used = at <= width
            used |= np.concatenate(([False], used[:-1])) | (np.arange(rows.count) == rows.starts[rows.group])
            # of a run of entries with one exit the last one is enough
            runs = np.append((last[1:] != last[:-1]) | ~used[1:] | (rows.group[1:] != rows.group[:-1]), True)
            keep = np.flatnonzero(used & runs)
            out = last[keep]
            yield pa.record_batch(
                [pa.array(v) for v in (rows.key[keep], rows.slice[keep], rows.t[keep], rows.t[out], rows.ends[rows.group[keep]] - out, (rows.ends - rows.starts)[rows.group[keep]])],
                names=["key", "slice", "entry", "exit", "tail", "rows"],
            )

    return run


def _chain(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, opened, before = None, None, 0
        for table in _whole_groups(batches, ["key", "slice"]):
            cols = [table.column(n).to_numpy() for n in ("key", "slice", "entry", "exit", "tail", "rows")]
            starts = np.flatnonzero(np.concatenate(([True], (cols[0][1:] != cols[0][:-1]) | (cols[1][1:] != cols[1][:-1]))))
            out: list[tuple] = []
            for a, b in zip(starts.tolist(), [*starts[1:].tolist(), len(cols[0])], strict=True):
                if cols[0][a] != key:
                    key, opened, before = cols[0][a], None, 0
                out.append((int(key), int(cols[1][a]), opened, before))
                at = a if opened is None else a + int(np.searchsorted(cols[2][a:b], opened + width, side="right"))
                if at < b:
                    opened, before = int(cols[3][at]), int(cols[4][at])
                else:
                    before += int(cols[5][a])
            yield pa.record_batch([pa.array([r[k] for r in out], pa.int64()) for k in range(4)], names=["key", "slice", "opened", "before"])

    return run


def _openings(width: int, span: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _whole_groups(batches, ["key", "slice"]):
            rows = _Slices(table, width, span)
            carried = table.column("opened")
            known = np.asarray(carried.is_valid())
            opened = carried.fill_null(0).to_numpy()
            before = table.column("before").to_numpy()
            first = np.where(known[rows.starts], rows.after(opened[rows.starts]), rows.starts)
            opens = np.zeros(rows.count + 1, bool)
            opens[np.where(first < rows.ends, first, rows.count)] = True
            jump = np.append(rows.next, rows.count)
            while (jump[:-1] < rows.count).any():
                opens[jump[np.flatnonzero(opens)]] = True
                jump = jump[jump]
            place = np.arange(rows.count)
            anchor = np.maximum.accumulate(np.where(opens[:-1], place, -1))
            own = anchor >= rows.starts[rows.group]
            at = np.where(own, rows.t[np.maximum(anchor, 0)], opened)
            n = np.where(own, place - anchor + 1, place - rows.starts[rows.group] + 1 + before)
            yield pa.record_batch([table.column("event_id").combine_chunks(), pa.array(rows.key), pa.array(at), pa.array(n)], names=["event_id", "key", "opened_us", "n"])

    return run


def anchored_windows(
    events: DataFrame, limit: int = fv.RATE_LIMIT_EVENTS, seconds: int = fv.RATE_LIMIT_SECONDS, slice_windows: int = 1440
) -> DataFrame:
    """Label events (event_id, key, ts): the opening of their window, their
    number ``n`` in it, and ``limited`` where that is beyond ``limit``.

    Ties in time go by event_id.  A slice is ``slice_windows`` windows long.
    """
    width = seconds * 1_000_000
    span = width * slice_windows
    rows = events.select("event_id", "key", wall_micros(C("ts")).alias("t")).withColumn("slice", F.floor(C("t") / span))
    group = ["key", "slice"]
    steps = rows.select("key", "slice", "t").repartition(*[C(k) for k in group]).sortWithinPartitions(*group, "t")
    exits = steps.mapInArrow(_exits(width, span), "key long, slice long, entry long, exit long, tail long, rows long")
    chained = exits.repartition(C("key")).sortWithinPartitions("key", "slice", "entry").mapInArrow(_chain(width), "key long, slice long, opened long, before long")
    placed = rows.join(chained, group).repartition(*[C(k) for k in group]).sortWithinPartitions(*group, "t", "event_id")
    named = placed.mapInArrow(_openings(width, span), "event_id long, key long, opened_us long, n long")
    return named.select("event_id", "key", "opened_us", "n", (C("n") > limit).alias("limited"))
