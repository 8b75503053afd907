"""Language identification with a bidirectional gated recurrent network.

The network reads bytes.  One gated recurrent layer runs over a stretch of text
from left to right, another from right to left, and both states together give
every position a distribution over languages.  A document's distribution is
the mean over all its positions, so the whole text counts, whatever its length.

Stretches have a fixed number of bytes, so a task runs thousands of them side
by side, and its memory does not depend on the length of a text.  Training is
backpropagation through time in numpy, on a bounded number of stretches drawn
from a bounded number of documents per language.

The gates use x / (1 + |x|) in place of the exponential forms: of the same
shape, and several times cheaper in numpy.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glyphlake.llm.common import fresh, held_out, sliced

STRETCH = 64
STATE = 8
SIDE_BY_SIDE = 2048
#: training reads about so many documents per language, and from each so many stretches
DOCS_PER_LANG, STRETCHES_PER_DOC = 400, 8
STEPS, BATCH, RATE = 300, 256, 1e-2
SEED = 2
UNKNOWN = "und"

_LETTER = re.compile("[A-Za-z]")


def has_letter(text: str | None) -> bool:
    return bool(text) and (_LETTER.search(text) is not None or any(map(str.isalpha, text)))


@dataclass
class Layer:
    """One gated recurrent layer; rows of its tables: update, reset, new."""

    seen: np.ndarray
    back: np.ndarray

    def step(self, state: np.ndarray, byte: np.ndarray, keep: list | None = None) -> np.ndarray:
        n = len(state)
        old = self.back @ state
        new = self.seen.take(byte, axis=1)
        gate = new[: 2 * n]
        gate += old[: 2 * n]
        size = np.abs(gate)
        size += 1
        gate /= size
        gate *= 0.5
        gate += 0.5
        fresh = gate[n:] * old[2 * n :]
        fresh += new[2 * n :]
        size = np.abs(fresh)
        size += 1
        fresh /= size
        if keep is not None:
            keep.append((state, gate, old[2 * n :], fresh))
        out = fresh - state
        out *= gate[:n]
        out += state
        return out

    def grads(self, kept: list, given: list, bytes_: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Gradients of both tables; ``kept``, ``given`` and ``bytes_`` in the
        order in which the layer ran, ``given`` being those of its states."""
        n = self.back.shape[1]
        d_back, d_state, d_seen = np.zeros_like(self.back), np.zeros_like(given[0]), []
        for (state, gate, old, fresh), direct in zip(reversed(kept), reversed(given), strict=True):
            d_out = d_state + direct
            d_fresh = d_out * gate[:n] * (1 - np.abs(fresh)) ** 2
            slope = 0.5 * (1 - np.abs(2 * gate - 1)) ** 2
            d_update = d_out * (fresh - state) * slope[:n]
            d_reset = d_fresh * old * slope[n:]
            d_old = np.concatenate([d_update, d_reset, d_fresh * gate[n:]])
            d_seen.append(np.concatenate([d_update, d_reset, d_fresh]))
            d_back += d_old @ state.T
            d_state = d_out * (1 - gate[:n]) + self.back.T @ d_old
        at = bytes_.reshape(-1)
        flat = np.stack(d_seen[::-1], axis=1).reshape(3 * n, -1)
        return np.stack([np.bincount(at, row, 256) for row in flat]).astype(np.float32), d_back


@dataclass
class Network:
    languages: list[str]
    forward: Layer
    backward: Layer
    top: np.ndarray
    bias: np.ndarray
    params: list = field(default_factory=list)

    def label(self, bytes_: np.ndarray, used: np.ndarray) -> np.ndarray:
        """Sums of the distributions of all positions of each stretch.

        ``bytes_``: stretches as columns; ``used``: how many of their bytes count."""
        n, width = self.forward.back.shape[1], bytes_.shape[1]
        state, states = np.zeros((n, width), np.float32), []
        for row in bytes_:
            state = self.forward.step(state, row)
            states.append(state)
        total, state = np.zeros((len(self.languages), width), np.float32), np.zeros((n, width), np.float32)
        for place in range(len(bytes_) - 1, -1, -1):
            state = self.backward.step(state, bytes_[place])
            odds = self.top[:, :n] @ states[place]
            odds += self.top[:, n:] @ state
            odds += self.bias
            odds -= odds.max(axis=0)
            np.exp(odds, out=odds)
            odds *= (used > place) / odds.sum(axis=0)
            total += odds
        return total


def _softmax(odds: np.ndarray) -> np.ndarray:
    odds = np.exp(odds - odds.max(axis=0))
    return odds / odds.sum(axis=0)


def train(stretches: np.ndarray, used: np.ndarray, labels: np.ndarray, languages: list[str], steps: int = STEPS) -> Network:
    """Backpropagation through time with Adam; every position has the label of
    its document.  ``stretches``: rows of bytes, padded with 0 after ``used``."""
    rng = np.random.default_rng(SEED)
    n, many = STATE, len(languages)

    def table(*shape: int, scale: float) -> np.ndarray:
        return rng.normal(0, scale, shape).astype(np.float32)

    p = [table(3 * n, 256, scale=0.5), table(3 * n, n, scale=0.3), table(3 * n, 256, scale=0.5), table(3 * n, n, scale=0.3), table(many, 2 * n, scale=0.3), np.zeros((many, 1), np.float32)]
    net = Network(languages, Layer(p[0], p[1]), Layer(p[2], p[3]), p[4], p[5])
    if many < 2 or not len(labels):
        return net
    m, v = [np.zeros_like(a) for a in p], [np.zeros_like(a) for a in p]
    weight = 1.0 / np.bincount(labels, minlength=many).clip(1)
    chance = weight[labels] / weight[labels].sum()
    for step in range(1, steps + 1):
        some = rng.choice(len(labels), min(BATCH, len(labels)), p=chance)
        rows, last, goal = stretches[some].T.astype(np.int64), used[some], labels[some]
        length, width = rows.shape
        kept_f, kept_b, states_f, states_b = [], [], [], [None] * length
        state = np.zeros((n, width), np.float32)
        for row in rows:
            state = net.forward.step(state, row, kept_f)
            states_f.append(state)
        state = np.zeros((n, width), np.float32)
        for place in range(length - 1, -1, -1):
            state = net.backward.step(state, rows[place], kept_b)
            states_b[place] = state
        both = np.concatenate([np.stack(states_f, axis=1), np.stack(states_b, axis=1)]).reshape(2 * n, -1)
        error = _softmax(p[4] @ both + p[5]).reshape(many, length, width)
        error[goal, :, np.arange(width)] -= 1
        counts = (np.arange(length)[:, None] < last).astype(np.float32)
        error = (error * counts / counts.sum()).reshape(many, -1).astype(np.float32)
        to_states = (p[4].T @ error).reshape(2 * n, length, width)
        forward = net.forward.grads(kept_f, list(to_states[:n].transpose(1, 0, 2)), rows)
        backward = net.backward.grads(kept_b, list(to_states[n:, ::-1].transpose(1, 0, 2)), rows[::-1])
        rate = RATE * min(1.0, 2.0 * (1 - step / (steps + 1)))
        for k, g in enumerate([*forward, *backward, error @ both.T, error.sum(axis=1, keepdims=True)]):
            m[k] += 0.1 * (g - m[k])
            v[k] += 0.01 * (g * g - v[k])
            p[k] -= (rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.99**step)) + 1e-8)).astype(np.float32)
    return net


def _drawn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Stretches of each text, from places all over it that its hash decides."""
    for batch in sliced(batches):
        ids, langs, found = [], [], []
        for doc_id, lang, text in zip(batch.column("doc_id").to_pylist(), batch.column("lang").to_pylist(), batch.column("text").to_pylist(), strict=True):
            raw = text.encode("utf-8", "surrogatepass")
            rng = np.random.default_rng(crc32(raw))
            starts = rng.integers(0, max(1, len(raw) - STRETCH + 1), min(STRETCHES_PER_DOC, 1 + len(raw) // STRETCH))
            for at in starts.tolist():
                ids.append(doc_id)
                langs.append(lang)
                found.append(raw[at : at + STRETCH])
        yield pa.record_batch([pa.array(ids, pa.int64()), pa.array(langs, pa.string()), pa.array(found, pa.binary())], names=["doc_id", "lang", "raw"])


def fit(docs: DataFrame, docs_per_lang: int = DOCS_PER_LANG) -> Network | None:
    """Learn from ``text`` and ``lang`` of rows that are not held out.

    Rows are chosen by a hash of the id, about ``docs_per_lang`` of each
    language; null languages and ids, and texts without a letter, teach
    nothing.  None if no row is left to learn from.
    """
    open_ = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text")).filter(F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    # one row per language
    share = open_.groupBy("lang").agg((F.lit(float(docs_per_lang)) / F.count("*")).alias("_share")).withColumnRenamed("lang", "_lang")
    draw = F.pmod(F.xxhash64(F.lit(SEED), "doc_id"), F.lit(1 << 30)) / F.lit(float(1 << 30))
    chosen = open_.join(F.broadcast(share), (F.col("lang") == F.col("_lang")) & (draw < F.col("_share"))).filter(F.col("text").rlike(r"\p{L}"))
    rows = chosen.select("doc_id", "lang", "text").mapInArrow(_drawn, "doc_id long, lang string, raw binary").toArrow().sort_by([("doc_id", "ascending"), ("raw", "ascending")])
    if not rows.num_rows:
        return None
    raw, langs = rows.column("raw").to_pylist(), rows.column("lang").to_pylist()
    languages = sorted(set(langs))
    number = {lang: k for k, lang in enumerate(languages)}
    used = np.array([len(x) for x in raw])
    grid = np.frombuffer(b"".join(x.ljust(STRETCH, b"\0") for x in raw), np.uint8).reshape(-1, STRETCH)
    return train(grid, used, np.array([number[x] for x in langs]), languages)


def distributions(texts: list[str | None], net: Network) -> np.ndarray:
    """Mean distribution of each text's positions; zeros for empty texts.

    Stretches of all texts run side by side, in groups of bounded size."""
    sums, lengths = np.zeros((len(texts), len(net.languages))), np.zeros(len(texts))
    grids, owners, used, held = [], [], [], 0

    def flush() -> None:
        grid, owner, last = np.concatenate(grids), np.concatenate(owners), np.concatenate(used)
        for at in range(0, len(owner), SIDE_BY_SIDE):
            part = slice(at, at + SIDE_BY_SIDE)
            found = net.label(np.ascontiguousarray(grid[part].T).astype(np.intp), last[part])
            np.add.at(sums, owner[part], found.T)

    for number, text in enumerate(texts):
        raw = (text or "").encode("utf-8", "surrogatepass")
        lengths[number] = len(raw)
        for at in range(0, len(raw), SIDE_BY_SIDE * STRETCH):
            piece = raw[at : at + SIDE_BY_SIDE * STRETCH]
            count = -(-len(piece) // STRETCH)
            grids.append(np.frombuffer(piece.ljust(count * STRETCH, b"\0"), np.uint8).reshape(count, STRETCH))
            owners.append(np.full(count, number))
            used.append(np.minimum(STRETCH, len(piece) - STRETCH * np.arange(count)))
            held += count
            if held >= 4 * SIDE_BY_SIDE:
                flush()
                grids, owners, used, held = [], [], [], 0
    if held:
        flush()
    return sums / np.maximum(lengths, 1)[:, None]


def _predict(model: Broadcast) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net = model.value
        for part in sliced(batches):
            texts = part.column("text").to_pylist()
            spoken = np.fromiter(map(has_letter, texts), bool, len(texts))
            if net is None:
                best, sure = np.full(len(texts), UNKNOWN, object), np.zeros(len(texts))
            else:
                share = distributions([t if s else None for t, s in zip(texts, spoken, strict=True)], net)
                best, sure = np.array(net.languages, object)[share.argmax(axis=1)], share.max(axis=1).clip(0, 1)
            best[~spoken], sure[~spoken] = UNKNOWN, 1.0
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(best.tolist(), pa.string()), pa.array(sure.astype(np.float64))], names=[*part.schema.names, "_language", "_sure"])

    return run


def identified(docs: DataFrame, learn_from: DataFrame | None = None) -> DataFrame:
    """``docs`` with ``_language`` and ``_sure``, its mean probability.

    Null texts and texts without a letter are ``und`` (probability 1), and so,
    with probability 0, is everything if nothing could be learnt.  Repeated
    rows are judged alike.  All columns of the table stay; it must
    not have columns of these two names.  An empty table gives no rows.
    """
    if fresh(docs, "_language", "_sure") != ["_language", "_sure"]:
        raise ValueError("the table already has a column _language or _sure")
    model = docs.sparkSession.sparkContext.broadcast(fit(docs if learn_from is None else learn_from))
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    return docs.mapInArrow(_predict(model), f"{fields}, _language string, _sure double")
