"""Line dedup next to a brute force that aligns whole documents."""

import random

import pytest

from glyphlake.llm import line_dedup


def rows_of(spark, texts):
    return spark.createDataFrame(texts, "doc_id long, text string")


def deleted(docs):
    out = {}
    for r in line_dedup.compared_pairs(docs).collect():
        out.setdefault(r.doc_id, set()).update(r.places)
    return out


def brute(rows):
    """Each document aligned with every earlier one, whole line lists."""
    texts = {i: line_dedup.filled_lines(t) for i, t in rows if i is not None}
    out = {}
    for i, later in texts.items():
        words = [x.count(b" ") + 1 for x in later]
        for e, earlier in texts.items():
            if e < i and not set(later).isdisjoint(earlier):
                out.setdefault(i, set()).update(line_dedup.places_held(later, words, earlier))
    return {i: places for i, places in out.items() if places}


PASSAGE = [f"short line {k}" for k in range(5)]


@pytest.mark.parametrize("older", [[PASSAGE[2]], PASSAGE])
def test_short_lines_that_older_documents_hold_stay_in_the_block(spark, older):
    texts = [(k, f"start of {k}\n{line}\nend of {k}") for k, line in enumerate(older)]
    texts += [(i, "\n".join([f"head of {i}", *PASSAGE, f"foot of {i}"])) for i in (50, 60)]
    docs = rows_of(spark, texts)
    assert deleted(docs) == brute(texts) == {60: {1, 2, 3, 4, 5}}
    got = {r.doc_id: r for r in line_dedup.without_common_blocks(docs).collect()}
    assert got[60].text == "head of 60\nfoot of 60" and got[60].earlier_ids == [50]
    assert all(got[i].text == t for i, t in texts if i != 60)


def test_windows_cover_every_block():
    assert line_dedup.windows([5, 1, 5]) == [(0, 3)]
    assert line_dedup.windows([8, 3]) == [(0, 1), (0, 2)]
    assert line_dedup.windows([3, 4]) == line_dedup.windows([]) == []
    for seed in range(200):
        words = [1 + (seed * 7 + k * k * (seed % 11 + 1)) % 9 for k in range(seed % 13)]
        for start in range(len(words)):
            for end in range(start + 1, len(words) + 1):
                if sum(words[start:end]) >= 8:
                    inside = [range(s, e) for s, e in line_dedup.windows(words) if start <= s and e <= end]
                    assert set().union(*inside) == set(range(start, end))


def test_whole_documents_match_brute_force(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    assert deleted(docs) == brute([tuple(r) for r in docs.collect()])


def test_rows_that_repeat_an_id_and_text_are_compared_once(spark):
    text = "\n".join(PASSAGE)
    docs = rows_of(spark, [(1, text)] * 3 + [(2, text)] * 3 + [(None, text)])
    assert [(r.doc_id, r.earlier_id) for r in line_dedup.compared_pairs(docs).collect()] == [(2, 1)]
    assert sorted((r.doc_id or 0, r.text) for r in line_dedup.without_common_blocks(docs).collect()) == [(0, text)] + [(1, text)] * 3 + [(2, "")] * 3


def names(text):
    return [x.encode() for x in text]


def held(later, earlier, words=9):
    return line_dedup.places_held(names(later), [words] * len(later), names(earlier))


def test_repeated_and_moved_blocks_are_found():
    # y stands twice in both, x once: both y go
    assert held("xypqrsty", "abcdexyfgy") == [0, 1, 7]
    # a passage pasted twice, and a unique line that does not touch it
    assert held("kabczabc", "kuabcv") == [0, 1, 2, 3, 5, 6, 7]
    assert held("abczabc", "uabcv") == [0, 1, 2, 4, 5, 6]
    # the passage twice in the earlier document, beside a unique line
    assert held("kzab", "kabuabw") == [0, 2, 3]
    # header and footer in the other order
    assert held("amz", "zna") == [0, 2]
    # short lines: a block needs three in a row
    assert held("abcxabxbc", "qabcw", 3) == [0, 1, 2]
    assert held("ababababz", "abababq", 3) == [*range(8)]


def test_no_block_of_the_earlier_document_survives():
    rng = random.Random(4)
    for _ in range(3000):
        later, earlier = ("".join(rng.choices("abcdefgh"[: rng.randint(1, 8)], k=rng.randint(1, 14))) for _ in range(2))
        count = {x: rng.randint(1, 10) for x in "abcdefgh"}
        words = [count[x] for x in later]
        gone = line_dedup.places_held(names(later), words, names(earlier))
        runs = [range(s, e) for s in range(len(later)) for e in range(s + 1, len(later) + 1) if sum(words[s:e]) >= 8 and later[s:e] in earlier]
        assert set(gone) <= set().union(*runs), (later, earlier)
        assert all(set(r) & set(gone) for r in runs), (later, earlier, count)
