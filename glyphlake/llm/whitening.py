"""Whitening of embeddings by Golub-Kahan-Lanczos bidiagonalisation.

Components of ``chosen`` integer vectors are taken, each distinct one once: the
fit list X, of n rows, with column means m.  From a start vector v1 the method
builds orthonormal rows of directions, v1, v2, .. in the space of dimensions
and u1, u2, .. in the space of rows, by turns:

    u_k = (X - m) v_k - b_(k-1) u_(k-1), scaled to length 1 by its length a_k
    v_(k+1) = (X - m)' u_k - a_k v_k,    scaled to length 1 by its length b_k

so that (X - m) is an upper bidiagonal matrix with the a on its diagonal and
the b above it, seen from these directions.  Its singular value decomposition
is a small one, and gives components and deviations.

Both products are distributed: the rows stay in tasks, and each task returns
sums over its rows.  One pass over the fit list makes both products of a step,
since everything is linear: a u_k is the image of a vector in the space of
dimensions, its products with the earlier u come from the same pass, and what
the reorthogonalisation takes off u_k it takes off (X - m)' u_k in the same
measure.  All u and all v are reorthogonalised against all earlier ones.

The process runs to the last direction, not until the first components look
settled, so that equal deviations are all found; where a direction leads
nowhere (b_k = 0) it goes on from a new one.  Passes: the number of dimensions.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glyphlake.llm.common import fresh, written

UNIT = 256
COMPONENTS = 4
SEED = 12
#: a direction shorter than this, measured against the largest, is none
NOTHING = 1e-12
#: rows that a task multiplies at once
ROWS_AT_ONCE = 1 << 14


class Fit(NamedTuple):
    """n rows, their sums per dimension, components in rows, eigenvalues of
    the covariance, its trace, and the error of the whitened fit list."""

    n: int
    sums: list[int]
    components: np.ndarray
    values: np.ndarray
    trace: float
    identity_error: float


def integer_vector(vector: Column) -> Column:
    """floor(256 c) of each entry, as long; beyond that range the nearest."""
    return F.transform(vector, lambda c: F.floor(c.cast("double") * UNIT).cast("long"))


def usable(vector: Column) -> Column:
    """Not null, not empty, and every entry a finite number."""
    wrong = lambda c: c.isNull() | F.isnan(c.cast("double")) | (F.abs(c.cast("double")) == float("inf"))
    return F.coalesce((F.size(vector) > 0) & ~F.exists(vector, wrong), F.lit(False))


def _matrices(batches: Iterator[pa.RecordBatch]) -> Iterator[np.ndarray]:
    for batch in batches:
        for at in range(0, batch.num_rows, ROWS_AT_ONCE):
            part = batch.slice(at, ROWS_AT_ONCE)
            yield part.column("x").flatten().to_numpy().reshape(part.num_rows, -1)


def _summed(fit_list: DataFrame, per_rows, size: int) -> np.ndarray:
    """The sum over all tasks of ``per_rows(matrix)``, vectors of ``size``
    numbers; a task sends one row for each of them and Spark adds them up."""

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size)
        for x in _matrices(batches):
            total += per_rows(x)
        yield pa.record_batch([pa.array(np.arange(size), pa.int32()), pa.array(total)], names=["k", "v"])

    found = fit_list.select("x").mapInArrow(sums, "k int, v double").groupBy("k").agg(F.sum("v").alias("v"))
    out = np.zeros(size)
    for row in found.collect():
        out[row["k"]] = row["v"]
    return out


class _Step(NamedTuple):
    image: np.ndarray
    product: np.ndarray
    length: float


def _product(fit_list: DataFrame, mean: np.ndarray, direction: np.ndarray, earlier: list[_Step]) -> _Step:
    """u = (X - m) direction, freed of the earlier u and scaled to length 1, as
    the vector that it is the image of, and (X - m)' u."""
    d, k = len(mean), len(earlier)
    images = np.array([e.image for e in earlier]).reshape(k, d).T

    def per_rows(x: np.ndarray) -> np.ndarray:
        centred = x - mean
        u = centred @ direction
        return np.concatenate([u @ centred, (centred @ images).T @ u, [u @ u]])

    sums = _summed(fit_list, per_rows, d + k + 1)
    product, shares, square = sums[:d], sums[d:-1], sums[-1]
    image = direction.copy()
    for share, e in zip(shares, earlier, strict=True):
        image = image - share * e.image
        product = product - share * e.product
    length = float(np.sqrt(max(0.0, square - shares @ shares)))
    scale = 1 / length if length else 0.0
    return _Step(image * scale, product * scale, length)


def _away_from(vector: np.ndarray, basis: list[np.ndarray]) -> np.ndarray:
    """The vector without its shares of the basis, twice, as is enough."""
    for _ in range(2):
        for v in basis:
            vector = vector - (v @ vector) * v
    return vector


def bidiagonalised(fit_list: DataFrame, mean: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Components of the centred fit list, in rows, and its singular values,
    largest first, as many as there are dimensions with any deviation."""
    d = len(mean)
    random = np.random.default_rng(SEED)

    def new_direction(basis: list[np.ndarray]) -> np.ndarray:
        v = _away_from(random.standard_normal(d), basis)
        return v / np.linalg.norm(v)

    directions, steps = [new_direction([])], []
    diagonal, above = [], []
    while True:
        v = directions[-1]
        start = v - above[-1] * steps[-1].image if steps else v
        step = _product(fit_list, mean, start, steps)
        largest = max([step.length, *diagonal])
        if step.length <= NOTHING * largest:  # the image of v is within that of the others
            step = _Step(np.zeros(d), np.zeros(d), 0.0)
        diagonal.append(step.length)
        steps.append(step)
        if len(directions) == d:
            break
        rest = _away_from(step.product - step.length * v, directions)
        length = float(np.linalg.norm(rest))
        if length <= NOTHING * max([length, largest]):
            above.append(0.0)
            directions.append(new_direction(directions))
        else:
            above.append(length)
            directions.append(rest / length)
    small = np.diag(diagonal) + np.diag(above, 1)
    _, values, right = np.linalg.svd(small)
    kept = values > NOTHING * values[0] if values[0] > 0 else np.zeros(d, bool)
    components = right[kept] @ np.array(directions)
    return components / np.linalg.norm(components, axis=1, keepdims=True), values[kept]


def _centred(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """n x - S, exactly: in 64 bits where they hold it, else as Python numbers."""
    most = int(max(x.max(initial=0), -x.min(initial=0), 1))
    if n * most + max(map(abs, sums)) < 1 << 62:
        return x * np.int64(n) - np.array(sums, np.int64)
    return x.astype(object) * n - np.array(sums, object)


def fitted(fit_list: DataFrame, components: int = COMPONENTS) -> Fit | None:
    """The whitening of a fit list of distinct vectors ``x``; None if empty."""
    entries = fit_list.select(F.posexplode("x").alias("at", "c"))
    exact = entries.groupBy("at").agg(F.count("*").alias("n"), F.sum(F.col("c").cast("decimal(28,0)")).alias("s")).orderBy("at").collect()
    if not exact:
        return None
    n, sums = exact[0]["n"], [int(r["s"]) for r in exact]
    mean = np.array([s / n for s in sums])
    vectors, lengths = bidiagonalised(fit_list, mean)
    every = lengths**2 / n
    fit = Fit(n, sums, vectors[:components], every[:components], float(every.sum()), 0.0)
    k = len(fit.values)
    if not k:
        return fit

    def squares(x: np.ndarray) -> np.ndarray:
        w = _whitened(x, fit)
        return np.concatenate([w.sum(axis=0), (w.T @ w).ravel()])

    found = _summed(fit_list, squares, k + k * k)
    average = found[:k] / n
    covariance = found[k:].reshape(k, k) / n - np.outer(average, average)
    return fit._replace(identity_error=float(np.abs(covariance - np.eye(k)).max()))


def _whitened(x: np.ndarray, fit: Fit) -> np.ndarray:
    return _centred(x, fit.n, fit.sums).astype(float) / fit.n @ fit.components.T / np.sqrt(fit.values)


def _applied(fit: Fit):
    k = len(fit.values)
    limit = 10**38

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS_AT_ONCE):
                part = batch.slice(at, ROWS_AT_ONCE)
                x = part.column("_x").flatten().to_numpy().reshape(part.num_rows, -1)
                centred = _centred(x, fit.n, fit.sums)
                most = int(np.abs(centred).max(initial=0))
                if most * most * x.shape[1] >= 1 << 63:
                    centred = centred.astype(object)
                far = [int(v) for v in (centred * centred).sum(axis=1)]
                deviation = pa.array([v if v < limit else None for v in far], pa.decimal128(38, 0))
                whitened = _whitened(x, fit).ravel()
                rows = np.repeat(np.arange(part.num_rows), k)
                kept = part.drop_columns(["_x"]).take(pa.array(rows))
                yield pa.record_batch(
                    [*kept.columns, pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), part.num_rows)), deviation.take(pa.array(rows)), pa.array(whitened)],
                    names=[*kept.schema.names, "component", "deviation", "whitened"],
                )

    return apply


def whitened(rows: DataFrame, key: str = "vec_id", vector: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """One row per usable vector and component.

    Rows whose vector is null, empty, or has a null or non-finite entry have no
    result, nor have those whose length is not the commonest one (of equally
    common ones the greatest): they are in no space with the others.  Rows that
    repeat a key or a vector have results each; in the fit a vector counts
    once.  There are as many components as dimensions with any deviation, at
    most ``components``; a table of one distinct vector has none, and no rows.
    Only the two named columns are read.

    Returns key, component, n, deviation (decimal, exact; null from 10^38),
    whitened, explained, identity_error.
    """
    spark = rows.sparkSession
    (name,) = fresh(rows, "_key")
    chosen = rows.select(F.col(key).alias(name), F.col(vector).alias("_vector")).filter(usable(F.col("_vector"))).select(name, integer_vector(F.col("_vector")).alias("_x"))
    length = chosen.groupBy(F.size("_x").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    fit = None
    if length is not None:
        chosen = chosen.filter(F.size("_x") == length["d"])
        fit = fitted(written(chosen.select(F.col("_x").alias("x")).distinct(), "fit-list"), components)
    kind = rows.schema[key].dataType.simpleString()
    schema = f"`{name}` {kind}, component int, deviation decimal(38,0), whitened double"
    if fit is None or not len(fit.values):
        found = spark.createDataFrame([], schema)
        fit = Fit(0, [], np.zeros((0, 0)), np.zeros(0), 0.0, 0.0)
    else:
        found = chosen.mapInArrow(_applied(fit), schema)
    explained = F.array(*(F.lit(float(v / fit.trace)) for v in fit.values)) if len(fit.values) else F.array(F.lit(0.0))
    return found.select(
        F.col(name).alias(key),
        "component",
        F.lit(fit.n).cast("long").alias("n"),
        "deviation",
        "whitened",
        F.element_at(explained, F.col("component")).alias("explained"),
        F.lit(fit.identity_error).alias("identity_error"),
    )
