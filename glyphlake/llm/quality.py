"""Quality classifier: random-indexing word vectors, pooled, then a network.

Word vectors.  A word has two units, its hash and the hash of its last three
bytes, in a vocabulary of fixed size.  Every unit owns a sparse ternary index
vector, and its context vector is the sum of the index vectors of all units
that stand next to it, over the whole corpus.  Sums of such vectors are whole
numbers, so tasks add their parts in any order with the same result, and what
a task sends is bounded by the vocabulary.

Documents.  The vectors of a text's words are pooled to their mean, the mean
of their squares, and the mean product of neighbours; text length joins them.

Network.  One hidden layer, trained in numpy on a bounded sample of labelled
rows; a temperature fitted on rows that training did not see calibrates the
probabilities.  Labels, language, source and id are never inputs of a score.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glyphlake.llm.common import fresh, held_out, sliced

WORD_UNITS, ENDING_UNITS = 1 << 13, 1 << 12
UNITS = WORD_UNITS + ENDING_UNITS
DIMENSIONS, NONZERO = 32, 4
FEATURES = 3 * DIMENSIONS + 1
#: most labelled rows that training reads
SAMPLE = 8192
HIDDEN, EPOCHS, BATCH, RATE, DECAY = 24, 60, 128, 3e-3, 1e-4
THRESHOLD = 0.7
SEED = 3
PIECE_BYTES = 1 << 18

_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_FACTOR = 0x9E3779B97F4A7C15


def index_vectors() -> np.ndarray:
    """Sparse ternary index vectors, one per unit; the seed fixes them."""
    rng = np.random.default_rng(SEED)
    table = np.zeros((UNITS, DIMENSIONS), np.int32)
    where = np.argsort(rng.random((UNITS, DIMENSIONS)), axis=1)[:, :NONZERO]
    np.put_along_axis(table, where, rng.choice(np.array([-1, 1], np.int32), (UNITS, NONZERO)), axis=1)
    return table


def _powers(n: int, base: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


class Units:
    """Turns bytes of text into the two unit numbers of each word."""

    def __init__(self) -> None:
        self.up = self.down = np.zeros(0, np.uint64)

    def of(self, raw: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Starts of the words in ``raw`` (which ends in a space), and units."""
        if len(raw) >= len(self.up):
            inverse = pow(_FACTOR, -1, 1 << 64)
            self.up, self.down = _powers(len(raw) + 1, _FACTOR), _powers(len(raw) + 1, inverse)
        blank = _SPACE[raw]
        edges = np.flatnonzero(blank[1:] != blank[:-1]) + 1
        if not blank[0]:
            edges = np.concatenate(([0], edges))
        starts, ends = edges[0::2], edges[1::2]
        sums = np.zeros(len(raw) + 1, np.uint64)
        np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * self.up[: len(raw)], dtype=np.uint64, out=sums[1:])
        mixed = (sums[ends] - sums[starts]) * self.down[starts]
        mixed ^= mixed >> np.uint64(29)
        mixed *= np.uint64(0xBF58476D1CE4E5B9)
        word = (mixed >> np.uint64(64 - 13)).astype(np.int64)
        tail = raw[ends - 1].astype(np.uint64)
        for back in (2, 3):
            at = np.maximum(ends - back, 0)
            tail = tail * np.uint64(257) + np.where(ends - back >= starts, raw[at], 0).astype(np.uint64)
        tail *= np.uint64(_FACTOR)
        return starts, word, (tail >> np.uint64(64 - 12)).astype(np.int64) + WORD_UNITS


def _cut(text: bytes) -> Iterator[bytes]:
    """A long text in pieces of bounded size, cut at spaces where there are any."""
    at = 0
    while len(text) - at > PIECE_BYTES:
        end = text.rfind(b" ", at, at + PIECE_BYTES)
        end = at + PIECE_BYTES if end <= at else end
        yield text[at:end]
        at = end
    yield text[at:]


def words_of(texts: list[str | None], units: Units) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Text number, word unit and ending unit of all words, in bounded groups.

    No text is cut short; a very long one comes in several groups."""
    parts: list[bytes] = []
    owners: list[int] = []
    size = 0

    def group() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        raw = np.frombuffer(b" ".join(parts) + b" ", np.uint8)
        firsts = np.cumsum([0] + [len(p) + 1 for p in parts[:-1]])
        starts, word, ending = units.of(raw)
        return np.array(owners)[np.searchsorted(firsts, starts, side="right") - 1], word, ending

    for number, text in enumerate(texts):
        for piece in _cut((text or "").encode("utf-8", "surrogatepass")):
            parts.append(piece)
            owners.append(number)
            size += len(piece)
            if size >= PIECE_BYTES:
                yield group()
                parts, owners, size = [], [], 0
    if parts:
        yield group()


def _contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Context sums of this task's texts: one row per unit it has seen."""
    index, units = index_vectors(), Units()
    total = np.zeros((UNITS, DIMENSIONS), np.int64)
    for batch in sliced(batches):
        for owner, word, ending in words_of(batch.column("text").to_pylist(), units):
            own = index[word] + index[ending]
            near = np.zeros_like(own)
            together = (owner[1:] == owner[:-1])[:, None]
            near[1:] += own[:-1] * together
            near[:-1] += own[1:] * together
            for unit in (word, ending):
                if len(unit):
                    order = np.argsort(unit.astype(np.uint16), kind="stable")
                    firsts = np.flatnonzero(np.concatenate(([True], np.diff(unit[order]) > 0)))
                    total[unit[order[firsts]]] += np.add.reduceat(near[order], firsts, axis=0)
    seen = np.flatnonzero(total.any(axis=1))
    if len(seen):
        yield pa.record_batch([pa.array(seen.astype(np.int32))] + [pa.array(total[seen, k]) for k in range(DIMENSIONS)], names=["unit"] + [f"c{k}" for k in range(DIMENSIONS)])


def word_vectors(docs: DataFrame) -> np.ndarray:
    """Context vectors of all units over all documents, each of length 1.

    The driver receives one row per unit, however large the corpus is."""
    names = [f"c{k}" for k in range(DIMENSIONS)]
    parts = docs.select(F.col("text").cast("string").alias("text")).mapInArrow(_contexts, "unit int, " + ", ".join(f"{n} long" for n in names))
    rows = parts.groupBy("unit").agg(*[F.sum(n).alias(n) for n in names]).toArrow()
    table = np.zeros((UNITS, DIMENSIONS), np.float64)
    if rows.num_rows:
        table[rows.column("unit").to_numpy()] = np.stack([rows.column(n).to_numpy() for n in names], axis=1)
    length = np.linalg.norm(table, axis=1, keepdims=True)
    return (table / np.maximum(length, 1e-9)).astype(np.float32)


def pooled(texts: list[str | None], vectors: np.ndarray, units: Units) -> np.ndarray:
    """The features of each text; a text without a word has all zeros."""
    sums = np.zeros((len(texts), 3 * DIMENSIONS), np.float64)
    count, pairs = np.zeros(len(texts)), np.zeros(len(texts))
    for owner, word, ending in words_of(texts, units):
        if not len(owner):
            continue
        vector = vectors[word] + vectors[ending]
        firsts = np.flatnonzero(np.concatenate(([True], owner[1:] != owner[:-1])))
        who = owner[firsts]
        following = np.zeros_like(vector)
        together = owner[1:] == owner[:-1]
        following[:-1] = vector[1:] * together[:, None]
        for at, part in enumerate((vector, vector * vector, vector * following)):
            np.add.at(sums, (who, slice(at * DIMENSIONS, (at + 1) * DIMENSIONS)), np.add.reduceat(part, firsts, axis=0, dtype=np.float64))
        count += np.bincount(owner, minlength=len(texts))
        pairs += np.bincount(owner[:-1][together], minlength=len(texts))
    sums[:, : 2 * DIMENSIONS] /= np.maximum(count, 1)[:, None]
    sums[:, 2 * DIMENSIONS :] /= np.maximum(pairs, 1)[:, None]
    return np.concatenate([sums, np.log1p(count)[:, None] / 10], axis=1)


@dataclass
class Network:
    """Standardising, one tanh layer, one logit, divided by the temperature."""

    mean: np.ndarray
    spread: np.ndarray
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: float
    temperature: float = 1.0

    def logits(self, x: np.ndarray) -> np.ndarray:
        return np.tanh(((x - self.mean) / self.spread) @ self.w1 + self.b1) @ self.w2 + self.b2

    def scores(self, x: np.ndarray) -> np.ndarray:
        return 1.0 / (1.0 + np.exp(-np.clip(self.logits(x) / self.temperature, -40, 40)))


def train(x: np.ndarray, y: np.ndarray) -> Network:
    """Adam on the log loss; then the temperature, on every fifth row."""
    rng = np.random.default_rng(SEED)
    n = len(y)
    if n < 10 or y.min() == y.max():
        prior = (y.sum() + 1) / (n + 2)
        return Network(np.zeros(FEATURES), np.ones(FEATURES), np.zeros((FEATURES, 1)), np.zeros(1), np.zeros(1), float(np.log(prior / (1 - prior))))
    apart = np.arange(n) % 5 == 4
    mean, spread = x.mean(axis=0), x.std(axis=0) + 1e-3
    z = (x - mean) / spread
    learn = np.flatnonzero(~apart)
    p = [rng.normal(0, 1 / np.sqrt(FEATURES), (FEATURES, HIDDEN)), np.zeros(HIDDEN), rng.normal(0, 1 / np.sqrt(HIDDEN), HIDDEN), np.zeros(1)]
    m, v, step = [np.zeros_like(a) for a in p], [np.zeros_like(a) for a in p], 0
    for _ in range(max(EPOCHS, min(20 * EPOCHS, EPOCHS * 2048 // n))):
        order = rng.permutation(learn)
        for at in range(0, len(order), BATCH):
            some = order[at : at + BATCH]
            hidden = np.tanh(z[some] @ p[0] + p[1])
            error = (1 / (1 + np.exp(-np.clip(hidden @ p[2] + p[3], -40, 40))) - y[some]) / len(some)
            back = np.outer(error, p[2]) * (1 - hidden * hidden)
            grads = [z[some].T @ back + DECAY * p[0], back.sum(axis=0), hidden.T @ error + DECAY * p[2], np.array([error.sum()])]
            step += 1
            for k, g in enumerate(grads):
                m[k] = 0.9 * m[k] + 0.1 * g
                v[k] = 0.999 * v[k] + 0.001 * g * g
                p[k] = p[k] - RATE * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)
    net = Network(mean, spread, p[0], p[1], p[2], float(p[3][0]))
    raw, seen = net.logits(x[apart]), y[apart]
    scale = np.exp(np.linspace(np.log(0.25), np.log(8.0), 141))
    loss = [np.mean(np.logaddexp(0, -np.where(seen == 1, raw, -raw) / t)) for t in scale]
    net.temperature = float(scale[int(np.argmin(loss))])
    return net


def _features(vectors: Broadcast) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        units = Units()
        for batch in sliced(batches):
            rows = pooled(batch.column("text").to_pylist(), vectors.value, units).astype("<f8")
            yield pa.record_batch([batch.column("doc_id"), batch.column("label"), pa.array([r.tobytes() for r in rows], pa.binary())], names=["doc_id", "label", "x"])

    return run


def _scores(model: Broadcast, name: str) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vectors, net = model.value
        units = Units()
        for batch in sliced(batches):
            texts = batch.column("text").to_pylist()
            score = net.scores(pooled(texts, vectors, units))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(score)], names=[*batch.schema.names, name])

    return run


def learning_rows(known: DataFrame, total: int, sample: int) -> DataFrame:
    """At most ``sample`` of the ``total`` rows, those first by a hash of the
    id: the same ones whatever order rows arrive in."""
    place = F.pmod(F.xxhash64(F.lit(SEED), "_id"), F.lit(1 << 30))
    return known.filter(place < min(1.0, sample / max(total, 1)) * (1 << 30)).orderBy(place, "_id").limit(sample)


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> tuple[np.ndarray, Network]:
    """Word vectors of all documents, and the network for ``labels.quality``.

    Learns from at most ``sample`` labelled rows, chosen by a hash of the id
    among those that are not held out.  Rows that repeat a label count once,
    by majority (ties: 1); null labels and ids are left out.  Without labels,
    or with one kind only, every score is that kind's smoothed share.
    """
    vectors = word_vectors(docs)
    known = labels.filter(F.col("quality").isNotNull() & F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").cast("long").alias("_id")).agg((F.avg("quality") >= 0.5).cast("double").alias("label"))
    known = known.filter(~held_out(F.col("_id")))
    total = known.count()
    some = learning_rows(known, total, sample)
    # at most ``sample`` rows of two numbers each
    found = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).join(F.broadcast(some), F.col("doc_id") == F.col("_id")).select("doc_id", "label", "text")
    shared = docs.sparkSession.sparkContext.broadcast(vectors)
    rows = found.mapInArrow(_features(shared), "doc_id long, label double, x binary").toArrow().sort_by("doc_id")
    x = np.frombuffer(b"".join(v.as_py() for v in rows.column("x")), "<f8").reshape(-1, FEATURES)
    return vectors, train(x, rows.column("label").to_numpy().astype(np.float64))


def scored(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, name: str = "_score") -> DataFrame:
    """``docs`` with a column ``name``: the probability of label 1.

    Null and empty texts are scored as a text without words.  All columns of
    the table stay, whatever their names; an empty table gives no rows.
    """
    model = docs.sparkSession.sparkContext.broadcast(fit(docs, labels, sample))
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    return docs.mapInArrow(_scores(model, name), f"{fields}, `{name}` double")


def keep_high_quality(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The documents that the classifier does not reject, all columns kept."""
    (name,) = fresh(docs, "_score")
    return scored(docs, labels, name=name).filter(F.col(name) >= threshold).drop(name)
