"""Near-duplicate embeddings next to all pairs."""

import math

import numpy as np
import pytest

from glyphlake.llm import vector_dedup

COLUMNS = "vec_id long, embedding array<{}>, label int, _key int, _vector string, _mark int, n_links int, kept string"


def table(spark, rows, kind="double"):
    return spark.createDataFrame([(i, v, 0, 1, "a", 2, 3, "b") for i, v in rows], COLUMNS.format(kind))


def found(df, **options):
    out = vector_dedup.near_vectors(df, **options)
    assert out.columns == ["vec_id", "n_links", "component_id", "kept"]
    return sorted(map(tuple, out.collect()), key=repr)


def brute(rows, threshold=0.95):
    fine = [bool(v) and all(c is not None and math.isfinite(c) for c in v) and any(v) for _, v in rows]
    unit = [np.array(v) / np.abs(v).max() if ok else None for (_, v), ok in zip(rows, fine, strict=True)]
    unit = [None if u is None else u / np.linalg.norm(u) for u in unit]
    group = list(range(len(rows)))
    links = [0] * len(rows)
    for a in range(len(rows)):
        for b in range(a):
            same_id = rows[a][0] is not None and rows[a][0] == rows[b][0] and fine[a] and fine[b]
            near = fine[a] and fine[b] and len(unit[a]) == len(unit[b]) and unit[a] @ unit[b] >= threshold
            if near:
                links[a] += 1
                links[b] += 1
            if near or same_id:
                old, new = group[a], group[b]
                group = [new if g == old else g for g in group]
    out = []
    for a, (i, _) in enumerate(rows):
        ids = [rows[b][0] for b in range(len(rows)) if group[b] == group[a] and rows[b][0] is not None]
        least = min(ids, default=None)
        out.append((i, links[a], least, i == least))
    return sorted(out, key=repr)


def cloud(groups, size, d, seed=0, spread=0.12):
    """Groups of vectors around directions, some pairs on either side of the threshold."""
    random = np.random.default_rng(seed)
    centres = random.standard_normal((groups, 1, d))
    centres /= np.linalg.norm(centres, axis=2, keepdims=True)
    noise = random.standard_normal((groups, size, d)) / np.sqrt(d)
    return (centres + spread * np.linspace(0.2, 2.5, groups)[:, None, None] * noise).reshape(-1, d)


def test_pairs_of_many_cosines_match_all_pairs(spark):
    rows = list(enumerate(cloud(60, 8, 24).tolist()))
    got, want = found(table(spark, rows).repartition(4)), brute(rows)
    assert sum(w[1] for w in want) > 500
    assert got == want


def test_awkward_rows_match_all_pairs(spark):
    rows = [(10 * i + 1, v) for i, v in enumerate(cloud(9, 5, 6, seed=3).tolist())]
    rows += [(7, rows[0][1]), (7, rows[0][1]), (4, rows[12][1]), (4, rows[30][1]), (None, rows[5][1]), (None, [1.0, 2.0, 3.0, 4.0, 5.0, 600.0]), (None, [1.0, 2.0, 3.0, 4.0, 5.0, 600.0])]
    rows += [(2000, None), (2001, []), (2002, [None] * 6), (2003, [float("nan")] * 6), (2004, [0.0] * 5 + [float("-inf")]), (2005, [-0.0] * 6), (None, None)]
    rows += [(3000, [1.0, 2.0]), (3001, [1.0, 2.01]), (3002, [1e300, 2e300]), (3003, [1e-310, 2e-310]), (3004, [-1.0, 0.0]), (3005, [-1.0, -0.0]), (3006, [5.0])]
    assert found(table(spark, rows)) == brute(rows)


def test_a_hot_group_is_split_and_counted_whole(spark, monkeypatch):
    monkeypatch.setattr(vector_dedup, "BLOCK", 40)
    rows = [*enumerate(cloud(1, 300, 16, spread=0.2).tolist()), *((1000 + i, v) for i, v in enumerate(cloud(150, 2, 16, seed=9).tolist()))]
    got, want = found(table(spark, rows)), brute(rows)
    assert max(w[1] for w in want) > 250
    links = sum(w[1] for w in want)
    assert links * 0.99 <= sum(g[1] for g in got) <= links
    assert [g[2] for g in got] == [w[2] for w in want]


def test_single_precision_and_one_direction(spark):
    rows = [(i, [float(i + 1), 0.0, 0.0]) for i in range(50)]
    assert found(table(spark, rows, "float")) == brute(rows)


@pytest.mark.parametrize("rows", [[], [(1, None)], [(1, [1.0, 2.0])], [(2, [1.0, 2.0]), (1, [1.0, 2.0])]])
def test_tables_of_few_rows(spark, rows):
    assert found(table(spark, rows)) == brute(rows)


def test_recall_on_the_given_table(spark):
    """Against all pairs of 2,000 vectors and as many partners at the threshold or closer."""
    base = np.array([r["embedding"] for r in spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").orderBy("vec_id").collect()], float)
    random = np.random.default_rng(5)
    aside = random.standard_normal(base.shape)
    aside -= (aside * base).sum(axis=1, keepdims=True) * base / (base * base).sum(axis=1, keepdims=True)
    aside /= np.linalg.norm(aside, axis=1, keepdims=True)
    near = base + np.tan(np.arccos(random.uniform(0.951, 0.96, (len(base), 1)))) * aside
    vectors = np.concatenate([base, near])
    unit = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
    links = ((unit @ unit.T >= 0.95).sum(axis=1) - 1).sum()
    got = found(table(spark, list(enumerate(vectors.tolist()))))
    assert links >= 2 * len(base)
    assert 0.99 * links <= sum(g[1] for g in got) <= links


def test_a_rotation_brings_vectors_closer_to_their_signs():
    random = np.random.default_rng(1)
    x = random.standard_normal((400, 12)) * np.linspace(3, 0.2, 12)
    def loss(r):
        return np.linalg.norm(np.where(x @ r > 0, 1, -1) - x @ r)
    start, end = vector_dedup.rotation(x, 4, rounds=0), vector_dedup.rotation(x, 4)
    assert np.allclose(end @ end.T, np.eye(12)) and loss(end) < loss(start)
