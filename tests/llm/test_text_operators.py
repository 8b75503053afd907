"""Exact dedup, near dedup, line dedup and quality rules next to brute force."""

import collections
import hashlib
import re

import numpy as np
import pytest
import xxhash

from glyphlake.llm import exact_dedup, line_dedup, quality_rules, simhash

WORD = re.compile(r"[^\x20\x09-\x0D]+")
COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, _gone string, _key string, _lane int, size string"


def rows_of(spark, texts):
    rows = [(i, t, "en", "s", 0, "x", "y", 1, "z") for i, t in texts]
    return spark.createDataFrame(rows, COLUMNS)


LONG = " ".join(f"w{i % 7919}" for i in range(60_000))
AWKWARD = [
    (5, None),
    (3, ""),
    (4, " \t\n"),
    (9, "alpha beta  gamma delta epsilon"),
    (2, "alpha beta\ngamma delta epsilon"),
    (8, "alpha beta gamma delta epsilon "),
    (7, LONG),
    (7, LONG),
    (None, "alpha beta gamma delta epsilon"),
    (None, None),
    (11, "é" * 1000),
    (12, "The same line of text stands here twice over now\nThe same line of text stands here twice over now"),
    (13, "unlike\nThe same line of text stands here twice over now\nother"),
    (14, "x y z v"),
]


@pytest.fixture(scope="module")
def awkward(spark):
    return rows_of(spark, AWKWARD).cache()


@pytest.fixture(scope="module")
def corpus(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")


@pytest.fixture(scope="module")
def nothing(spark):
    return rows_of(spark, [])


def normal(text):
    return re.sub(r"[\x20\x09-\x0D]+", " ", text or "")


def check_exact(docs):
    pairs = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    groups = collections.defaultdict(list)
    for i, t in pairs:
        groups[normal(t)].append(i)
    want = []
    for i, t in pairs:
        ids = [x for x in groups[normal(t)] if x is not None]
        keep = min(ids) if ids else None
        want.append((i, keep, len(groups[normal(t)]), i == keep, hashlib.sha256(normal(t).encode()).hexdigest()))
    got = [tuple(r) for r in exact_dedup.exact_groups(docs, fan_in=2, rows_per_lane=4).collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)


def test_exact_groups_match_brute_force(corpus, awkward):
    check_exact(corpus)
    check_exact(awkward)


def test_exact_groups_of_nothing(nothing):
    assert exact_dedup.exact_groups(nothing).count() == 0


def test_dropping_copies_keeps_columns_and_rows(awkward):
    kept = exact_dedup.drop_exact_copies(awkward)
    assert kept.columns == awkward.columns
    # 3 and 5: "" ; 4: " " is another text; 2 and 9 are equal; 8 ends in a space; rows without an id stay
    assert sorted((r.doc_id for r in kept.collect() if r.doc_id is not None)) == [2, 3, 4, 7, 7, 8, 11, 12, 13, 14]
    assert kept.filter("doc_id is null").count() == 2


def test_rows_of_one_id_with_different_texts_are_not_lost(spark):
    passage = "\n".join(f"passage line {k} with a handful of words in it" for k in range(4))
    docs = rows_of(spark, [(1, passage), (7, passage), (7, f"own\n{'other words ' * 9}\n{passage}"), (None, "a text without any id")])
    assert sorted(r.doc_id or 0 for r in exact_dedup.drop_exact_copies(docs).collect()) == [0, 1, 7, 7]
    assert sorted(r.doc_id or 0 for r in simhash.keep_one_per_group(docs).collect()) == [0, 1, 7, 7]
    left = sorted((r.doc_id or 0, r.text) for r in line_dedup.without_common_blocks(docs).collect())
    assert left == [(0, "a text without any id"), (1, passage), (7, ""), (7, f"own\n{'other words ' * 9}")]


def mark_of(text):
    words = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    shingles = [" ".join(words[k : k + 4]) for k in range(max(1, len(words) - 3))] if words else []
    hashes = [xxhash.xxh64_intdigest(x.encode(), 42) for x in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in hashes) > len(hashes))


def check_near(docs):
    rows = docs.select("doc_id", "text").collect()
    marks = [mark_of(r.text) for r in rows]
    group = list(range(len(rows)))

    def top(x):
        while group[x] != x:
            x = group[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            if bin(marks[a] ^ marks[b]).count("1") <= 4:
                group[max(top(a), top(b))] = min(top(a), top(b))
    least = {}
    for n, r in enumerate(rows):
        if r.doc_id is not None:
            least[top(n)] = min(least.get(top(n), r.doc_id), r.doc_id)
    want = [(r.doc_id, f"{marks[n]:016x}", least.get(top(n))) for n, r in enumerate(rows)]
    assert sorted(map(tuple, simhash.near_groups(docs).collect()), key=repr) == sorted(want, key=repr)


def test_near_groups_match_brute_force(corpus):
    check_near(corpus.limit(150))


def test_near_groups_of_awkward_rows(spark, awkward, nothing):
    check_near(rows_of(spark, [(i, t if t != LONG else LONG[:3000]) for i, t in AWKWARD]))
    assert simhash.near_groups(nothing).count() == 0


def test_every_pair_within_four_bits_meets_at_an_anchor():
    rng = np.random.default_rng(0)
    marks = rng.integers(0, 1 << 63, 400).astype(np.uint64)
    flips = np.array([sum(1 << int(b) for b in rng.choice(64, k % 5, replace=False)) for k in range(400)], np.uint64)
    both = np.concatenate([marks, marks ^ flips])
    rows, anchors, homes = simhash._anchors(both)
    order = np.argsort(anchors, kind="stable")
    a, b = simhash._links(anchors[order], both[rows][order], rows[order], homes[order])
    root = simhash._roots(800, a, b)
    assert all(root[k] == root[k + 400] for k in range(400))


def test_a_large_meeting_gives_a_tree_and_the_same_groups():
    rng = np.random.default_rng(1)
    marks = np.unique(np.array([sum(1 << int(b) for b in rng.choice(40, 3, replace=False)) for _ in range(900)], np.uint64))
    homes = rng.random(len(marks)) < 0.5
    a, b = simhash._search(marks, homes)
    assert len(a) < len(marks)
    linked = np.bitwise_count(marks[:, None] ^ marks[None, :]) <= 4
    linked &= homes[:, None] | homes[None, :]
    x, y = np.nonzero(linked)
    want = simhash._roots(len(marks), x, y)
    assert np.array_equal(simhash._roots(len(marks), a, b), want)


def test_components_of_a_long_chain_and_a_hub(spark):
    edges = [(k, k + 1) for k in range(60)] + [(1000, 2000 + k) for k in range(50)]
    got = dict(simhash.components(spark.createDataFrame(edges, "u long, v long")).collect())
    assert got == {**{k: 0 for k in range(61)}, **{2000 + k: 1000 for k in range(50)}, 1000: 1000}


def words_measures(text):
    words = WORD.findall(text or "")
    windows = collections.Counter(zip(words, words[1:], words[2:], strict=False))
    places = set()
    for k in range(len(words) - 2):
        if windows[tuple(words[k : k + 3])] > 1:
            places |= {k, k + 1, k + 2}
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    symbols = sum((text or "").count(c) for c in "#*$%&|<>")
    return len(words), sum(map(len, words)), symbols, len(lines) - len(set(lines)), len(places)


def test_rule_measures_match_brute_force(corpus, awkward, nothing):
    for docs in (corpus, awkward):
        want = sorted(((r.doc_id, *words_measures(r.text)) for r in docs.select("doc_id", "text").collect()), key=repr)
        found = quality_rules.judged(docs).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept").collect()
        assert sorted((tuple(r)[:6] for r in found), key=repr) == want
        for r in found:
            assert r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words)
            assert not (r.base_failed and r.kept)
    assert quality_rules.judged(nothing).count() == 0


def test_clashing_hashes_fall_back_to_the_windows(spark):
    text = " ".join(["a b c d"] * 3 + [f"x{i}" for i in range(40)] + ["b c d"])
    frame = spark.createDataFrame([(text,)], "text string")
    from pyspark.sql import functions as F

    words = F.split("text", " ")
    # so few bits for places that the text has more words than fit
    few = frame.select(quality_rules.bound(words, lambda w: quality_rules._repeated_words(w, 3)).alias("n")).first().n
    assert few == words_measures(text)[4]


def test_rules_keep_labelled_good_documents(spark, sf, corpus):
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    found = quality_rules.judged(corpus).join(labels, "doc_id").filter("not base_failed").collect()
    good, bad = [r.kept for r in found if r.quality == 1], [r.kept for r in found if r.quality == 0]
    assert np.mean(good) > 0.99 and np.mean(bad) < 0.2
    assert quality_rules.keep_good(corpus).columns == corpus.columns


def brute_lines(rows):
    """Holders of each line in id order; compare each with the first."""
    texts = {}
    for i, t in rows:
        if i is not None:
            texts.setdefault(i, line_dedup.filled_lines(t))
    first = {}
    for i in sorted(texts):
        for line in texts[i]:
            first.setdefault(line, i)
    out = {}
    for i, lines in texts.items():
        for e in {first[x] for x in lines if first[x] != i}:
            shared = [(x.count(b" ") + 1, [k for k, y in enumerate(lines) if y == x], [k for k, y in enumerate(texts[e]) if y == x]) for x in dict.fromkeys(lines) if first[x] == e]
            places = line_dedup.common_blocks(shared)
            if places:
                out[(i, e)] = sorted(places)
    return out


def test_aligned_pairs_match_brute_force(corpus, awkward, nothing):
    for docs in (corpus, awkward):
        got = {(r.doc_id, r.earlier_id): sorted(r.places) for r in line_dedup.aligned_pairs(docs).collect()}
        assert got == brute_lines([(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()])
    assert line_dedup.without_common_blocks(nothing).count() == 0


def test_common_blocks_are_deleted_from_the_later_document(spark):
    shared = "\n".join(f"passage line {k} with a handful of words in it" for k in range(6))
    texts = [(1, f"own start\n{shared}\nown end"), (2, f"another start\n\n{shared}\nanother end"), (3, "short\nown start\nclean document")]
    got = {r.doc_id: r for r in line_dedup.without_common_blocks(rows_of(spark, texts)).collect()}
    assert got[1].text == texts[0][1] and got[1].earlier_ids == []
    assert got[2].text == "another start\n\nanother end" and got[2].n_deleted_lines == 6 and got[2].earlier_ids == [1]
    # a common line below the smallest block stays
    assert got[3].text == texts[2][1]


def test_alignment_follows_order_and_rarity():
    # a b c / c a b: the longest rising run is a b; c is not aligned
    assert line_dedup.common_blocks([(9, [0], [1]), (9, [1], [2]), (9, [2], [0])]) == [0, 1]
    # a line that stands twice is matched next to an anchor only
    assert line_dedup.common_blocks([(9, [0], [5]), (9, [1, 7], [6, 9])]) == [0, 1]
    assert line_dedup.common_blocks([(3, [0], [0])]) == []
