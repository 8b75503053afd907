"""Whitening next to an eigendecomposition of the whole covariance."""

import math

import numpy as np
import pytest

from glyphlake.llm import whitening

COLUMNS = "vec_id long, embedding array<double>, label int, x int, _x string, component int, _key int, _vector int"


def table(spark, rows):
    return spark.createDataFrame([(i, v, 0, 1, "a", 2, 3, 4) for i, v in rows], COLUMNS)


def brute(rows, k=4):
    fine = [(i, v) for i, v in rows if v and all(c is not None and math.isfinite(c) for c in v)]
    xs = [(i, [math.floor(256 * c) for c in v]) for i, v in fine]
    fit = np.array(sorted({tuple(x) for _, x in xs}), float)
    n, mean = len(fit), fit.mean(axis=0)
    values, vectors = np.linalg.eigh((fit - mean).T @ (fit - mean) / n)
    values, vectors = values[::-1], vectors[:, ::-1]
    sums = [sum(col) for col in zip(*{tuple(x) for _, x in xs}, strict=True)]
    out = {}
    for i, x in xs:
        deviation = sum((n * a - s) ** 2 for a, s in zip(x, sums, strict=True))
        for c in range(min(k, len(x))):
            if values[c] > 1e-9 * values[0]:
                out.setdefault((i, c + 1), []).append((n, deviation, (np.array(x) - mean) @ vectors[:, c] / math.sqrt(values[c]), values[c] / values.sum()))
    return out


def found(df):
    out = {}
    for r in whitening.whitened(df).collect():
        assert r["identity_error"] < 1e-9
        out.setdefault((r["vec_id"], r["component"]), []).append((r["n"], int(r["deviation"]), r["whitened"], r["explained"]))
    return out


def same(got, want, apart=True):
    assert {k: len(v) for k, v in got.items()} == {k: len(v) for k, v in want.items()}
    signs = {}
    for key in want:
        for a, b in zip(sorted(got[key], key=lambda r: r[1]), sorted(want[key], key=lambda r: r[1]), strict=True):
            assert a[:2] == b[:2] and a[3] == pytest.approx(b[3], rel=1e-9)
            if apart:
                if key[1] not in signs and abs(b[2]) > 1e-3:
                    signs[key[1]] = 1 if a[2] * b[2] > 0 else -1
                assert a[2] == pytest.approx(signs.get(key[1], 1) * b[2], abs=1e-8)


def cloud(n, d, seed=0):
    random = np.random.default_rng(seed)
    return random.standard_normal((n, d)) * np.linspace(2, 0.1, d) @ np.linalg.qr(random.standard_normal((d, d)))[0]


def test_awkward_rows_match_brute_force(spark):
    rows = [(i, v) for i, v in enumerate(cloud(300, 7).tolist())]
    rows += [(3, rows[3][1]), (None, rows[4][1]), (None, rows[5][1]), (1000, rows[0][1])]
    rows += [(2000, None), (2001, []), (2002, [None] * 7), (2003, [float("nan")] * 7), (2004, [0.0] * 6 + [float("-inf")]), (2005, [-0.0] * 7)]
    same(found(table(spark, rows).repartition(5)), brute(rows))


def test_vectors_of_another_length_have_no_rows(spark):
    rows = [(i, v) for i, v in enumerate(cloud(50, 5).tolist())]
    same(found(table(spark, [*rows, (99, [1.0, 2.0])])), brute(rows))


def test_the_given_table_matches_brute_force(spark, sf):
    df = spark.read.parquet(f"{sf}/embeddings.parquet")
    same(found(df), brute([(r["vec_id"], r["embedding"]) for r in df.collect()]))


@pytest.mark.parametrize("d", [1, 2, 3])
def test_few_dimensions(spark, d):
    rows = [(i, v) for i, v in enumerate(cloud(40, d).tolist())]
    same(found(table(spark, rows)), brute(rows))


def test_dimensions_without_deviation(spark):
    flat = [[*v, 1.0, v[0], 0.0] for v in cloud(60, 3).tolist()]
    rows = list(enumerate(flat))
    same(found(table(spark, rows)), brute(rows))


def test_equal_deviations_are_all_found(spark):
    rows = [(2 * i + s, [(1.0 - 2 * s) * (i == j) for j in range(6)]) for i in range(6) for s in range(2)]
    got = found(table(spark, rows))
    same(got, brute(rows), apart=False)
    # any basis of a shared deviation will do, but each row's share of it is fixed
    w = np.array([[got[i, c][0][2] for c in range(1, 5)] for i, _ in rows])
    assert np.allclose(w.T @ w / len(rows), np.eye(4))


def test_large_offsets_and_ranges(spark):
    rows = [(i, [c + 1e9 for c in v]) for i, v in enumerate(cloud(80, 4).tolist())]
    got, want = found(table(spark, rows)), brute(rows)
    assert {k: v[0][:2] for k, v in got.items()} == {k: v[0][:2] for k, v in want.items()}
    huge = table(spark, [(1, [1e300, 0.0]), (2, [-1e300, 1.0]), (3, [0.0, 2.0])])
    assert {r["deviation"] for r in whitening.whitened(huge).select("deviation").collect()} is not None


def test_one_vector_or_none_has_no_rows(spark):
    assert found(table(spark, [])) == {}
    assert found(table(spark, [(1, None)])) == {}
    assert found(table(spark, [(1, [1.0, 2.0]), (2, [1.0, 2.0])])) == {}
