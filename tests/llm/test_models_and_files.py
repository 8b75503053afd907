"""Classifiers, mixing, shards, token files, BPE and the pipeline."""

import collections
import hashlib
import re
import time
import zlib
from fractions import Fraction

import numpy as np
import pandas as pd
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from glyphlake.llm import bpe, lang_id, mixing, quality, queries, range_coder, sharding, token_files

WORD = re.compile(r"[^\x20\x09-\x0D]+")
COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, _gone string, _key string, _times int, size string"
TEXTS = [
    (1, None, None, None),
    (2, "", "en", "a"),
    (3, "  \n ", "en", "a"),
    (4, "12345 --- !!!", "de", "b"),
    (5, "ab " * 150_000, "en", "b"),
    (6, "same", "en", "a"),
    (6, "same", "en", "a"),
    (None, "no id", "en", "a"),
    (7, "a<|endoftext|>b  it's 'sx 日本語 😀 é²³½ªº\x1c\x85 end", None, "c"),
    (8, "x" * 70_000, "fr", "c"),
]


def frame(spark, rows):
    return spark.createDataFrame([(i, t, lang, s, 0, "x", "y", 1, "z") for i, t, lang, s in rows], COLUMNS)


@pytest.fixture(scope="module")
def awkward(spark):
    return frame(spark, TEXTS).cache()


@pytest.fixture(scope="module")
def nothing(spark):
    return frame(spark, [])


@pytest.fixture(scope="module")
def corpus(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet").repartition(4)


@pytest.fixture(scope="module")
def labels(spark, sf):
    return spark.read.parquet(f"{sf}/labels.parquet")


def is_held_out(i):
    return i is not None and zlib.crc32(str(i).encode()) % 4 == 2


# language identification


def test_language_of_held_out_documents(spark, sf, corpus):
    lang = {r.doc_id: (r.lang, len(r.text)) for r in corpus.collect()}
    found = queries.op2_gated_byte_network(spark, sf).collect()
    assert len(found) == len(lang) and all(r.held_out == is_held_out(r.doc_id) and 0 <= r.score <= 1 for r in found)
    long_ = [r for r in found if r.held_out and lang[r.doc_id][1] > 40]
    assert np.mean([r.lang_pred == lang[r.doc_id][0] for r in long_]) > 0.95


def test_language_of_awkward_rows(awkward, nothing, corpus):
    got = {r.doc_id: r for r in lang_id.identified(awkward, corpus).collect()}
    assert [got[k]["_language"] for k in (1, 2, 3, 4)] == ["und"] * 4 and got[5]["_language"] in ("en", "de", "fr", "es")
    assert lang_id.identified(nothing, corpus).count() == 0
    assert {r["_language"] for r in lang_id.identified(awkward, nothing).collect()} == {"und"}


def test_gradients_of_the_recurrent_layer():
    rng = np.random.default_rng(0)
    layer = lang_id.Layer(rng.normal(0, 0.5, (6, 256)), rng.normal(0, 0.5, (6, 2)))
    bytes_, goal = rng.integers(0, 4, (5, 3)), rng.normal(size=(5, 2, 3))

    def loss(keep=None):
        state, total = np.zeros((2, 3)), 0.0
        for row, g in zip(bytes_, goal, strict=True):
            state = layer.step(state, row, keep)
            total += (state * g).sum()
        return total

    kept = []
    loss(kept)
    d_seen, d_back = layer.grads(kept, list(goal), bytes_)
    for table, grad, at in ((layer.back, d_back, (3, 1)), (layer.back, d_back, (5, 0)), (layer.seen, d_seen, (2, 1)), (layer.seen, d_seen, (4, 2))):
        table[at] += 1e-5
        up = loss()
        table[at] -= 2e-5
        down = loss()
        table[at] += 1e-5
        assert abs((up - down) / 2e-5 - grad[at]) < 1e-4


# quality


def test_quality_of_held_out_documents(spark, sf, labels):
    quality_of = {r.doc_id: r.quality for r in labels.collect()}
    found = queries.op3_random_index_quality(spark, sf).collect()
    assert all(r.held_out == is_held_out(r.doc_id) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in found)
    judged = [(r.predicted, quality_of[r.doc_id]) for r in found if r.held_out and r.doc_id in quality_of]
    assert np.mean([a == b for a, b in judged]) > 0.85


def test_quality_of_awkward_rows(spark, awkward, nothing, corpus, labels):
    kept = quality.keep_high_quality(awkward, labels)
    assert kept.columns == awkward.columns and quality.scored(awkward, labels).count() == len(TEXTS)
    assert quality.keep_high_quality(nothing, labels).count() == 0
    none = spark.createDataFrame([], labels.schema)
    assert {r["_score"] for r in quality.scored(awkward, none).collect()} == {0.5}


def test_units_do_not_depend_on_where_a_word_stands():
    units = quality.Units()
    texts = ["one two three", "three", " two\tthree\n", None, ""]
    owner, word, ending = (np.concatenate(x) for x in zip(*quality.words_of(texts, units), strict=True))
    assert owner.tolist() == [0, 0, 0, 1, 2, 2]
    assert word[2] == word[3] == word[5] and word[1] == word[4] and ending[2] == ending[3] == ending[5]


def test_context_sums_do_not_depend_on_partitions(corpus):
    assert np.array_equal(quality.word_vectors(corpus), quality.word_vectors(corpus.repartition(7)))


def test_a_long_text_is_pooled_whole():
    vectors = np.random.default_rng(0).normal(size=(quality.UNITS, quality.DIMENSIONS)).astype(np.float32)
    text = " ".join(f"w{k % 997}" for k in range(200_000))
    whole = quality.pooled([text], vectors, quality.Units())[0]
    units = quality.Units()
    word, ending = (np.concatenate(x) for x in list(zip(*quality.words_of([text], units), strict=True))[1:])
    assert len(word) == 200_000
    assert np.allclose(whole[: quality.DIMENSIONS], (vectors[word] + vectors[ending]).mean(axis=0), atol=1e-4)


# mixing


def targets_by_rounds(sizes, weights=(5, 2, 1)):
    """The rule as stated: cap, share the excess again, until none is above."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + ([None] if None in sizes else [])
    weight = {s: weights[k % 3] for k, s in enumerate(names)}
    full, budget = set(), 1.5 * sum(sizes.values())
    while True:
        rest = budget - sum(2 * sizes[s] for s in full)
        open_ = [s for s in names if s not in full]
        share = {s: rest * weight[s] / sum(weight[x] for x in open_) for s in open_}
        over = {s for s in open_ if share[s] > 2 * sizes[s]}
        if not over:
            return {**{s: 2.0 * sizes[s] for s in full}, **share}
        full |= over


def check_mixture(docs):
    rows = docs.select("doc_id", "source", "text").collect()
    sizes = collections.Counter()
    for r in rows:
        sizes[r.source] += len(WORD.findall(r.text or ""))
    want = targets_by_rounds(dict(sizes))
    source = {r.doc_id: r.source for r in rows}
    found = mixing.mixture(docs, group_rows=8, fan_in=3).collect()
    again = mixing.mixture(docs.repartition(5), group_rows=8, fan_in=3).collect()
    assert sorted(map(tuple, found), key=repr) == sorted(map(tuple, again), key=repr) and len(found) == len(rows)
    taken, largest = collections.Counter(), collections.Counter()
    for r in found:
        s = source[r.doc_id]
        assert r.source_size == sizes[s] and r.target == pytest.approx(want[s])
        assert 0 <= r.taken <= 2 * r.size and r.taken == r.copies * r.size
        taken[s] += r.taken
        largest[s] = max(largest[s], r.size)
    for s in sizes:
        assert abs(taken[s] - want[s]) <= largest[s] + 1e-6


def test_mixture_meets_its_targets(corpus, awkward, nothing):
    check_mixture(corpus)
    check_mixture(awkward)
    assert mixing.mixture(nothing).count() == 0


def pivotal(items):
    """Rounding one after another, in exact fractions: (share, size, draw)."""
    shares, held = [Fraction(s) for s, _, _ in items], None
    for i, (_, size, draw) in enumerate(items):
        if not 0 < shares[i] < 1:
            continue
        if held is None:
            held = i
            continue
        other = items[held][1]
        up = min((1 - shares[held]) * other, shares[i] * size)
        down = min(shares[held] * other, (1 - shares[i]) * size)
        moved = up if Fraction(draw) * (up + down) < down else -down
        shares[held] += moved / other
        shares[i] -= moved / size
        held = i if 0 < shares[i] < 1 else held if 0 < shares[held] < 1 else None
    return shares


def test_a_group_is_rounded_as_one_after_another():
    pick = np.random.default_rng(3)
    for n in (0, 1, 2, 3, 17, 200):
        size, draw = pick.integers(1, 40, n), np.sort(pick.random(n))
        share = pick.choice([0.0, 0.25, 0.5, 0.75, 0.625, 1.0], n)
        rows = pd.DataFrame({"doc_id": range(n), "size": size, "_text": 0, "_nth": 0, "_share": share, "_draw": draw})
        want = pivotal([(share[i], int(size[i]), draw[i]) for i in range(n)])
        got = mixing._settle(rows)["_share"].to_numpy()
        assert np.allclose(got, [float(w) for w in want], atol=1e-9)
        assert sum(0 < w < 1 for w in want) <= 1
        assert sum(w * int(z) for w, z in zip(want, size)) == sum(Fraction(s) * int(z) for s, z in zip(share, size))


def test_rows_without_an_id_or_equal_rows_are_dealt_into_bounded_groups(spark, monkeypatch, tmp_path):
    same = [(None, "one two", "en", "a")] * 90 + [(5, "three", "en", "a")] * 90
    rows = same + [(None, f"text {i} " * (1 + i % 3), "en", "a") for i in range(90)] + [(i, "w", "en", None) for i in range(30)]
    docs, folder, settle = frame(spark, rows), str(tmp_path), mixing._settle

    def seen(group):
        with open(f"{folder}/sizes", "a") as out:
            out.write(f"{len(group)}\n")
        return settle(group)

    monkeypatch.setattr(mixing, "_settle", seen)
    found = mixing.mixture(docs, group_rows=16, fan_in=4).collect()
    sizes = [int(n) for n in open(f"{folder}/sizes")]
    assert max(sizes) <= 48 and sum(sizes) >= 300
    assert len(found) == 300
    words = lambda t: len(WORD.findall(t))
    assert sorted((r.doc_id or -1, r.size) for r in found) == sorted((i or -1, words(t)) if i is not None else (-1, words(t)) for i, t, _, _ in rows)
    again = mixing.mixture(docs.repartition(7), group_rows=16, fan_in=4).collect()
    assert sorted(map(tuple, found), key=repr) == sorted(map(tuple, again), key=repr)
    assert abs(sum(r.taken for r in found) - 1.5 * sum(words(t) for _, t, _, _ in rows)) <= 12


def test_rounding_is_fair_in_the_mean(spark):
    docs = spark.createDataFrame([(i, "w " * (1 + i % 5), "s") for i in range(40)], "doc_id long, text string, source string")
    mean = np.mean([[r.copies for r in mixing.mixture(docs, seed=s).orderBy("doc_id").collect()] for s in range(12)])
    assert abs(mean - 1.5) < 0.1


def test_mixed_documents_keep_their_columns(awkward):
    mix = mixing.mix_documents(awkward)
    assert mix.columns == awkward.columns
    assert {r.doc_id for r in mix.collect()} <= {t[0] for t in TEXTS}


# shards


def check_shards(docs, shards):
    rows = docs.select("doc_id", "source", "text").collect()
    found = sharding.interleaved(docs, shards, 8, rows_per_bucket=7).collect()
    assert len(found) == len(rows)
    slots = collections.defaultdict(list)
    for r in found:
        slots[r.shard].append(r.slot)
    counts = [len(slots[k]) for k in range(shards)]
    assert max(counts) - min(counts) <= 1 and all(sorted(v) == list(range(len(v))) for v in slots.values())
    want = sorted(((r.doc_id, len((r.text or "").encode()) + 16, zlib.crc32((r.text or "").encode())) for r in rows), key=repr)
    assert sorted(((r.doc_id, r.size, r.text_crc32) for r in found), key=repr) == want
    return found


def test_shards_hold_the_mixture(corpus, awkward, nothing):
    source = {r.doc_id: r.source for r in corpus.collect()}
    found = check_shards(corpus, 10)
    per = collections.Counter((r.shard, source[r.doc_id]) for r in found)
    of = collections.Counter(source.values())
    for shard in range(10):
        for s, n in of.items():
            assert abs(per[(shard, s)] - n / 10) <= 1.01
    check_shards(awkward, 3)
    check_shards(awkward, 40)
    assert sharding.interleaved(nothing, 4).count() == 0


def test_written_shards_hold_the_documents(spark, corpus, tmp_path):
    sharding.write_shards(corpus, str(tmp_path / "shards"), 6, seed=1)
    back = spark.read.parquet(str(tmp_path / "shards"))
    plan = {r.doc_id: (r.shard, r.slot) for r in sharding.interleaved(corpus, 6, 1).collect()}
    assert {r.doc_id: (r.shard, r.slot) for r in back.select("doc_id", "shard", "slot").collect()} == plan
    assert set(back.columns) == {*corpus.columns, "shard", "slot"}


# token files


def test_range_coder_round_trip():
    rng = np.random.default_rng(3)
    for ids in (rng.integers(0, range_coder.LARGEST_ID + 1, (5, 400)), np.zeros((2, 900)), np.minimum(rng.zipf(1.3, (40, 700)), 49_407), np.tile(np.arange(30), (3, 40))):
        grid = ids.astype(np.uint16)
        assert np.array_equal(range_coder.decode_blocks(range_coder.encode_blocks(grid), grid.shape[1]), grid)


def test_range_coder_of_odd_blocks():
    rng = np.random.default_rng(6)
    shapes = [(1, 1), (3, 2), (2, 257), (1, 5000), (0, 256)]
    grids = [rng.integers(0, 1 << 16, s) for s in shapes] + [np.full((2, 300), 65_535), np.arange(8192).reshape(1, -1), np.tile([7, 7, 65_535], (1, 3000))]
    for ids in grids:
        grid = ids.astype(np.uint16)
        assert np.array_equal(range_coder.decode_blocks(range_coder.encode_blocks(grid), grid.shape[1]), grid)
    with pytest.raises(ValueError):
        range_coder.encode_blocks(np.zeros((1, range_coder.LONGEST_BLOCK + 1), np.uint16))


def test_an_id_is_coded_and_read_within_a_microsecond():
    grid = np.minimum(np.random.default_rng(7).zipf(1.2, (256, 4096)), 49_407).astype(np.uint16)

    def seconds():
        began = time.process_time()
        assert np.array_equal(range_coder.decode_blocks(range_coder.encode_blocks(grid), 4096), grid)
        return time.process_time() - began

    assert min(seconds() for _ in range(3)) < 1e-6 * grid.size


def test_known_words_do_not_change_the_ids(monkeypatch):
    rng = np.random.default_rng(8)
    signs = list("ab'sté \n\t9²_-!…İßſΣς\u0307\x00\x7f\xa0\x1c\x85ｆ½") + ["'ll", "  ", "<|endoftext|>", "日", "</w>", "<|", "e\u0301", "\U0001f600"]
    texts = ["".join(rng.choice(signs, 12)) for _ in range(600)] + [None, "", " \n"]
    for name in ("word_bpe_49k.json", "byte_bpe_50k.json"):
        path = public_tokenizers.path(name)
        encoder = Tokenizer.from_file(path)
        want = [encoder.encode(t or "", add_special_tokens=False).ids for t in texts]
        for most in (token_files.MOST_WORDS, 20):
            monkeypatch.setattr(token_files, "MOST_WORDS", most)
            words = token_files.WordIds(path)
            asked = []
            monkeypatch.setattr(words, "model", type("Asked", (), {"tokenize": lambda _, w, model=words.model, asked=asked: asked.append(w) or model.tokenize(w)})())
            for _ in range(2):
                assert [i.tolist() for at in range(0, len(texts), 50) for i in words.of(texts[at : at + 50])] == want
            assert (len(asked) == len(set(asked))) == (most > 20)


def test_blocks_are_independent_and_checked():
    rng = np.random.default_rng(4)
    ids = [rng.integers(0, 500, n).astype(np.uint16) for n in (300, 1, 0, 700)]
    record = token_files.pack_segment([3, None, 5, -2], ids, block_ids=256)
    names, counts, stream = token_files.unpack_segment(record)
    assert names == [3, None, 5, -2] and counts.tolist() == [300, 1, 0, 700] and np.array_equal(stream, np.concatenate(ids))
    one = range_coder.encode_blocks(stream[256:512].reshape(1, 256))[0]
    assert one in record
    for at in (5, len(record) // 2, len(record) - 1):
        with pytest.raises(ValueError):
            token_files.unpack_segment(record[:at] + bytes([record[at] ^ 1]) + record[at + 1 :])


def check_files(spark, docs, tmp, segment_ids):
    path = public_tokenizers.path("word_bpe_49k.json")
    token_files.write_ids(docs, path, str(tmp), segment_ids=segment_ids)
    got = sorted(token_files.read_ids(spark, str(tmp)).collect(), key=lambda r: r.start)
    encoder, start = Tokenizer.from_file(path), 0
    want = collections.defaultdict(list)
    for r in docs.select("doc_id", "text").collect():
        want[r.doc_id].append(encoder.encode(r.text or "", add_special_tokens=False).ids + [2])
    assert [r.doc_id for r in got] == sorted((r.doc_id for r in got), key=lambda i: (i is not None, i))
    for r in got:
        ids = np.frombuffer(r.ids, "<u4").tolist()
        assert ids in want[r.doc_id] and r.start == start and r.n_tokens == len(ids) and r.ids_crc32 == zlib.crc32(r.ids)
        start += len(ids)
    assert len(got) == sum(map(len, want.values()))


def test_files_of_ids(spark, corpus, awkward, nothing, tmp_path):
    check_files(spark, corpus.limit(60), tmp_path / "a", 2000)
    check_files(spark, awkward.filter("doc_id is null or doc_id <> 5"), tmp_path / "b", 5)
    check_files(spark, nothing, tmp_path / "c", 5)


# BPE


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
@pytest.mark.parametrize("block", [1, 1 << 24])
def test_ids_are_those_of_the_library(awkward, corpus, name, block):
    path = public_tokenizers.path(name)
    encoder = Tokenizer.from_file(path)
    for docs in (awkward, corpus.limit(30)):
        got = collections.defaultdict(list)
        for r in bpe.decoded(bpe.encoded(docs, path, block_bytes=block), path).collect():
            got[r.doc_id].append((np.frombuffer(r.ids, "<u4").tolist(), r.n_tokens, r.decoded))
        want = collections.defaultdict(list)
        for r in docs.select("doc_id", "text").collect():
            ids = encoder.encode(r.text or "", add_special_tokens=False).ids
            want[r.doc_id].append((ids, len(ids), encoder.decode(ids, skip_special_tokens=False)))
        if name.startswith("byte"):
            assert got == want
        else:
            assert {k: [x[:2] for x in v] for k, v in got.items()} == {k: [x[:2] for x in v] for k, v in want.items()}


def test_bpe_of_nothing_and_of_broken_bytes(spark, nothing):
    path = public_tokenizers.path("byte_bpe_50k.json")
    assert bpe.round_trip(nothing, path).count() == 0
    encoder = Tokenizer.from_file(path)
    ids = encoder.encode("é😀").ids
    cut = spark.createDataFrame([(1, np.array(ids[1:-1], "<u4").tobytes()), (2, None)], "doc_id long, ids binary")
    got = {r.doc_id: r.decoded for r in bpe.decoded(cut, path).collect()}
    assert got == {1: encoder.decode(ids[1:-1]), 2: ""}


def test_all_words_are_split_as_the_library_does():
    path = public_tokenizers.path("byte_bpe_50k.json")
    split, encoder = bpe.splitter(path), Tokenizer.from_file(path)
    rng = np.random.default_rng(5)
    signs = list("ab'sté \n\t9²_-!…") + ["'ll", "  ", "<|endoftext|>", "日"]
    for _ in range(400):
        text = "".join(rng.choice(signs, 12))
        assert [i for w in split(text) for i in encoder.encode(w, add_special_tokens=False).ids] == encoder.encode(text, add_special_tokens=False).ids


# pipeline


def test_pipeline_stages(spark, sf, corpus, tmp_path):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    kept = [docs]
    for number, (_, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
        out = stage(spark, kept[-1], sf)
        assert out.columns == docs.columns
        out.write.parquet(str(tmp_path / str(number)))
        kept.append(spark.read.parquet(str(tmp_path / str(number))))
    scored = {r.doc_id for r in queries.op3_random_index_quality(spark, sf).filter("predicted = 1").collect()}
    good, exact, near, mixed = ([r.asDict() for r in k.collect()] for k in kept[1:])
    assert {r["doc_id"] for r in good} == scored
    first = {}
    for r in sorted(good, key=lambda r: r["doc_id"]):
        first.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", r["text"]), r["doc_id"])
    assert sorted(r["doc_id"] for r in exact) == sorted(first.values())
    assert {r["doc_id"] for r in near} <= {r["doc_id"] for r in exact} and len(near) >= 0.9 * len(exact)
    copies = collections.Counter(r["doc_id"] for r in mixed)
    plan = {r.doc_id: r.copies for r in mixing.mixture(kept[3]).collect()}
    assert copies == {i: c for i, c in plan.items() if c}
    encoder = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    text = {r["doc_id"]: r["text"] for r in mixed}
    last = corpus_pipeline.STAGES[-1][1](spark, kept[4], sf).collect()
    assert len(last) == len(mixed)
    for r in last:
        assert r.decoded == text[r.doc_id] and np.frombuffer(r.ids, "<u4").tolist() == encoder.encode(text[r.doc_id], add_special_tokens=False).ids
    whole = corpus_pipeline.run(spark, sf).select("doc_id", F.sha2("ids", 256).alias("x")).collect()
    assert sorted(map(tuple, whole)) == sorted((r.doc_id, hashlib.sha256(r.ids).hexdigest()) for r in last)
