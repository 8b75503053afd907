"""The Merkle manifest next to a plain restatement."""

import hashlib
import zlib

import pytest

from glyphlake.llm import merkle, queries

COLUMNS = "doc_id long, source string, lang string, n_chars long, text string, tree string, leaf int, spot string, _place int, idx int"


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf_of(row, text):
    def part(v):
        return "-" if v is None else f"{len(str(v).encode())}:{v}"

    return h(*(part(v) for v in (row["doc_id"], row["source"], row["lang"], row["n_chars"], text)))


def climb(level, at):
    """Siblings on the way up from one place, with the last digest."""
    before_after = []
    while len(level) > 1:
        run = level[at // 3 * 3 : at // 3 * 3 + 3]
        before_after.append((run[: at % 3], run[at % 3 + 1 :]))
        level = [h(*level[i : i + 3]) for i in range(0, len(level), 3)]
        at //= 3
    return before_after, level[0] if level else None


def brute(rows):
    sources = sorted({r["source"] for r in rows}, key=lambda s: (s is not None, (s or "").encode()))
    trees = {}
    for s in sources:
        members = [(r["doc_id"] is not None, r["doc_id"] or 0, leaf_of(r, r["text"]), i) for i, r in enumerate(rows) if r["source"] == s]
        trees[s] = sorted(members)
    subroots = [climb([m[2] for m in trees[s]], 0)[1] for s in sources]
    root = climb(subroots, 0)[1]
    out = []
    for q, s in enumerate(sources):
        level = [m[2] for m in trees[s]]
        for at, (_, _, leaf, i) in enumerate(trees[s]):
            row = rows[i]
            text = row["text"]
            if text is not None and row["doc_id"] is not None and zlib.crc32(str(row["doc_id"]).encode()) % 2 == 0:
                text = text.replace("\n", "")
            folded = leaf_of(row, text)
            way = climb(level, at)[0] + climb(subroots, q)[0]
            proof = ""
            for before, after in way:
                proof += "".join(before + after)
                folded = h(*before, folded, *after)
            out.append((row["doc_id"], leaf, subroots[q], root, h(proof), folded, folded == root))
    return sorted(out, key=repr)


def table(spark, rows):
    return spark.createDataFrame([(*r, "x", 1, "y", 2, 3) for r in rows], COLUMNS)


def run(spark, df, monkeypatch):
    monkeypatch.setattr(queries, "documents", lambda *_: df)
    found = queries.op13_merkle_climb(spark, "")
    assert found.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    return sorted(map(tuple, found.collect()), key=repr)


AWKWARD = [
    (5, "b", "en", 3, "a\nb"),
    (None, "b", None, None, None),
    (None, "b", "en", 1, "x\ny"),
    (7, None, "en", 0, ""),
    (7, None, "en", 0, ""),
    (7, None, "de", 0, "other\ntext"),
    (6, "", "en", 2, "é\nü"),
    (8, "ä", "en", 2, "line\n" * 30_000),
    *((100 + i, "z", "en", i, f"doc\n{i}") for i in range(83)),
]


@pytest.mark.parametrize("sizes", [[1], [2], [3], [4], [9], [10], [729], [730], [1, 1], [1, 30, 1], [244, 1, 5, 1, 1]])
def test_trees_of_many_shapes_match_brute_force(spark, monkeypatch, sizes):
    rows = [(1000 * s + i, f"s{s}", "en", i, f"text {i}\nline") for s, n in enumerate(sizes) for i in range(n)]
    df = table(spark, rows).repartition(3)
    assert run(spark, df, monkeypatch) == brute([r.asDict() for r in df.collect()])


def test_many_sources_and_a_large_one_match_brute_force(spark, monkeypatch):
    rows = [(i, f"s{i}" if i % 3 else "hot", "en", i, f"text {i}\nline") for i in range(0, 2_401)]
    rows += [(-i, "hot", "en", i, f"more {i}\nline") for i in range(1, 300)]
    df = table(spark, rows)
    assert run(spark, df, monkeypatch) == brute([r.asDict() for r in df.collect()])


def test_awkward_rows(spark, monkeypatch):
    df = table(spark, AWKWARD)
    assert run(spark, df, monkeypatch) == brute([r.asDict() for r in df.collect()])


def test_an_empty_table_has_no_root(spark, monkeypatch):
    df = table(spark, [])
    assert run(spark, df, monkeypatch) == []
    assert merkle.build(df).root is None


def test_the_session_keeps_its_limits(spark):
    before = spark.conf.get(merkle.ROW_LIMIT), spark.conf.get(merkle.STEP_LIMIT)
    merkle.proved(merkle.build(table(spark, AWKWARD))).collect()
    assert before == (spark.conf.get(merkle.ROW_LIMIT), spark.conf.get(merkle.STEP_LIMIT))
