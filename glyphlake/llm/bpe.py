"""BPE encoding and decoding over a table of distinct words.

Encoding.  Documents are split into the words of the tokenizer's own splitting
rule and gathered into blocks of bounded text.  A block keeps each of its
distinct words once, and each document as the places of its words in that
list.  The words travel, in packs by hash, to the one task that owns them: it
encodes a word the first time it sees it and never again.  The ids travel back
to the block, where they are joined to the documents by position.  So what is
shuffled is one entry per block and distinct word, never one per word read,
and a word that is in every text is one entry per block.

Decoding is a join of ids with the table of the vocabulary's pieces; that table
is bounded by the vocabulary file (50,257 pieces here), so every task holds it
and the join needs no shuffle.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator
from functools import cache
from zlib import crc32

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from glyphlake.llm.common import sliced, written

BLOCK_BYTES = 8 << 20
TOKENS_AT_ONCE = 1 << 18

# fixed values: letters and other characters of European texts whose classes
# are the same in all engines and versions; texts with any other character are
# split by the tokenizers library itself
LETTERS = "A-Za-zÀ-ÖØ-öø-ɏ"
OTHERS = "\t\n\r -@\\[-`{-~¡-©«¬®¯°±´¶·¸»¿×÷–—‘’“”•…"
ENDINGS = "'s|'t|'re|'ve|'m|'ll|'d"

#: the two words of a part in lower case that is letters and then signs, if any
letters_signs = re.compile(f"([{LETTERS}]+)([!-/:-@\\[-`{{-~]*)\\Z").match

_PLAIN = re.compile(f"[{LETTERS}{OTHERS}]*\\Z")
_BYTE_WORDS = re.compile(f"{ENDINGS}| ?[{LETTERS}]+| ?[0-9]+| ?[^\\s0-9{LETTERS}]+|\\s+(?!\\S)|\\s+")
_LOWER_WORDS = re.compile(f"{ENDINGS}|[{LETTERS}]+|[0-9]|[^\\s0-9{LETTERS}]+")


# how vocabularies write bytes: as one printable character each, itself if it
# is one, else the next free character from 256 on
_PRINTABLE = [*range(33, 127), *range(161, 173), *range(174, 256)]
BYTE_SIGNS = {b: chr(b) for b in _PRINTABLE} | {b: chr(256 + n) for n, b in enumerate(b for b in range(256) if b not in set(_PRINTABLE))}


@cache
def tokenizer(path: str) -> Tokenizer:
    loaded = Tokenizer.from_file(path)
    loaded.no_truncation()
    loaded.no_padding()
    return loaded


@cache
def _special(path: str) -> tuple[re.Pattern | None, frozenset[str]]:
    with open(path, encoding="utf-8") as file:
        named = [t["content"] for t in json.load(file)["added_tokens"]]
    return (re.compile("(" + "|".join(map(re.escape, sorted(named, key=len, reverse=True))) + ")"), frozenset(named)) if named else (None, frozenset())


def special_tokens(path: str) -> frozenset[str]:
    return _special(path)[1]


def splitter(path: str) -> Callable[[str], list[str]]:
    """The function that cuts a text into words which can be encoded alone."""
    loaded = tokenizer(path)
    special, names = _special(path)
    lower = loaded.normalizer is not None
    words = _LOWER_WORDS if lower else _BYTE_WORDS

    def by_library(text: str) -> list[str]:
        found = []
        for part in special.split(text) if special else [text]:
            if part in names:
                found.append(part)
            elif part:
                part = loaded.normalizer.normalize_str(part) if lower else part
                found.extend(part[a:b] for _, (a, b) in loaded.pre_tokenizer.pre_tokenize_str(part))
        return found

    def split(text: str) -> list[str]:
        if "<|" in text or not _PLAIN.match(text):
            return by_library(text)
        return words.findall(text.lower() if lower else text)

    return split


def spacer(path: str) -> Callable[[str], str] | None:
    """The function that writes a text so that all parts between its white
    space can be encoded alone; nothing where words may hold white space."""
    if tokenizer(path).normalizer is None:
        return None
    split = splitter(path)

    def space(text: str) -> str:
        if "<|" in text or not _PLAIN.match(text):
            return " ".join(split(text))
        return text.lower()

    return space


class _Places(dict):
    """Numbers things in the order in which they are first asked for."""

    def __missing__(self, key: str) -> int:
        place = self[key] = len(self)
        return place


def pack_numbers(numbers: np.ndarray) -> bytes:
    """32-bit numbers, compressed: all lowest bytes, then all next ones, ..."""
    planes = np.ascontiguousarray(np.asarray(numbers, "<u4").view(np.uint8).reshape(-1, 4).T)
    return zstandard.ZstdCompressor(level=3).compress(planes.tobytes())


def unpack_numbers(packed: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(packed), np.uint8).reshape(4, -1)
    return np.ascontiguousarray(planes.T).view("<u4").reshape(-1).astype(np.int64)


WORD_PACKS = pa.list_(pa.struct([("pack", pa.int32()), ("places", pa.binary()), ("lengths", pa.binary()), ("spelt", pa.binary())]))
BLOCKS = pa.schema([("block", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("counts", pa.binary()), ("codes", pa.list_(pa.binary())), ("packs", WORD_PACKS)])
BLOCKS_DDL = "block long, doc_ids array<long>, counts binary, codes array<binary>, packs array<struct<pack int, places binary, lengths binary, spelt binary>>"


def _blocks(path: str, packs: int, block_bytes: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split = splitter(path)
        number = TaskContext.get().partitionId() << 32
        places, ids, counts, codes, waiting, size = _Places(), [], [], [], [], 0

        def close() -> pa.RecordBatch:
            if waiting:
                codes.append(pack_numbers(np.concatenate(waiting)))
            owners: dict[int, tuple[list[int], list[bytes]]] = {}
            for word, place in places.items():
                spelt = word.encode("utf-8", "surrogatepass")
                spots, words = owners.setdefault(crc32(spelt) % packs, ([], []))
                spots.append(place)
                words.append(spelt)
            press = zstandard.ZstdCompressor(level=3).compress
            # places rise, so their differences are small
            sent = [{"pack": k, "places": pack_numbers(np.diff(s, prepend=0)), "lengths": pack_numbers(np.fromiter(map(len, w), np.int64, len(w))), "spelt": press(b"".join(w))} for k, (s, w) in owners.items()]
            return pa.RecordBatch.from_pylist([{"block": number, "doc_ids": ids, "counts": pack_numbers(np.array(counts)), "codes": codes, "packs": sent}], schema=BLOCKS)

        held = 0
        for batch in sliced(batches):
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                found = split(text) if text else []
                ids.append(doc_id)
                counts.append(len(found))
                waiting.append(np.fromiter(map(places.__getitem__, found), np.uint32, len(found)))
                held += len(found)
                size += len(text or "") + 64
                if held >= TOKENS_AT_ONCE:
                    codes.append(pack_numbers(np.concatenate(waiting)))
                    waiting, held = [], 0
                if size >= block_bytes or len(places) >= 1 << 22:
                    yield close()
                    number += 1
                    places, ids, counts, codes, waiting, size, held = _Places(), [], [], [], [], 0, 0
        if ids:
            yield close()

    return run


def _encode_packs(path: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Encode the words of one owner; each distinct word once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, open_up = tokenizer(path), zstandard.ZstdDecompressor().decompress
        known: dict[bytes, np.ndarray] = {}
        for batch in batches:
            for row in batch.to_pylist():
                ends = np.cumsum(unpack_numbers(row["lengths"]))
                spelt = open_up(row["spelt"])
                words = [spelt[a:b] for a, b in zip([0, *ends[:-1].tolist()], ends.tolist(), strict=True)]
                new = [w for w in words if w not in known]
                for at in range(0, len(new), 4096):
                    some = new[at : at + 4096]
                    for word, found in zip(some, encoder.encode_batch_fast([w.decode("utf-8", "surrogatepass") for w in some], add_special_tokens=False), strict=True):
                        known[word] = np.array(found.ids, "<u4")
                pieces = [known[w] for w in words]
                yield pa.record_batch(
                    [pa.array([row["block"]], pa.int64()), pa.array([row["places"]], pa.binary()), pa.array([pack_numbers(np.fromiter(map(len, pieces), np.int64, len(pieces)))], pa.binary()), pa.array([pack_numbers(np.concatenate(pieces))], pa.binary())],
                    names=["block", "places", "lengths", "ids"],
                )

    return run


def gather(flat: np.ndarray, starts: np.ndarray, lengths: np.ndarray, picked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The slices of ``flat`` named by ``picked``, end to end, and their ends."""
    each = lengths[picked]
    ends = np.cumsum(each)
    total = int(ends[-1]) if len(ends) else 0
    shift = starts[picked] - (ends - each)
    return flat[np.repeat(shift, each) + np.arange(total)], ends


def _join_back(path: str | None) -> Callable[[tuple, pa.Table, pa.Table], pa.Table]:
    """The ids of the documents of one block: those of its words, by position.
    With ``path`` also the texts they spell, from the id-to-piece table."""

    def run(key: tuple, block: pa.Table, words: pa.Table) -> pa.Table:
        places = [np.cumsum(unpack_numbers(x.as_py())) for x in words.column("places")]
        lengths = [unpack_numbers(x.as_py()) for x in words.column("lengths")]
        count = sum(map(len, places))
        length, start = np.zeros(count, np.int64), np.zeros(count, np.int64)
        flat, base = [], 0
        for spot, size, ids in zip(places, lengths, words.column("ids").to_pylist(), strict=True):
            part = unpack_numbers(ids).astype("<u4")
            ends = np.cumsum(size)
            length[spot], start[spot] = size, base + ends - size
            flat.append(part)
            base += len(part)
        joined = np.concatenate(flat) if flat else np.zeros(0, "<u4")
        del places, lengths, flat, words
        doc_ids = block.column("doc_ids")[0].as_py()
        counts = unpack_numbers(block.column("counts")[0].as_py())
        parts = iter(block.column("codes")[0])
        held, at, out, tokens, spelt = np.zeros(0, np.int64), 0, [], [], []
        while at < len(doc_ids):
            until = int(np.searchsorted(np.cumsum(counts[at:]), len(held), side="right")) + at
            if until == at:
                held = np.concatenate([held, unpack_numbers(next(parts).as_py())])
                continue
            ends = np.concatenate(([0], np.cumsum(counts[at:until])))
            ids, word_ends = gather(joined, start, length, held[: ends[-1]])
            held = held[ends[-1] :]
            bounds = np.concatenate(([0], word_ends))[ends].tolist()
            out += [ids[a:b].tobytes() for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
            tokens += np.diff(bounds).tolist()
            if path is not None:
                spelt += spell(ids, bounds, path)
            at = until
        columns = {"doc_id": pa.array(doc_ids, pa.int64()), "n_tokens": pa.array(tokens, pa.int64()), "ids": pa.array(out, pa.binary())}
        return pa.table(columns if path is None else columns | {"decoded": pa.array(spelt, pa.string())})

    return run


def encoded(docs: DataFrame, path: str, block_bytes: int = BLOCK_BYTES, spelt: bool = False) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_tokens and ids, the latter as
    little-endian unsigned 32-bit numbers in a binary.

    The ids are those that the tokenizer of ``path`` gives the whole text,
    without special tokens added; special tokens written out in a text get
    their own id, as the library does.  Null and empty texts have no ids.  Rows
    that repeat an id, and null ids, are encoded each for itself.  Columns
    beyond doc_id and text are not read; an empty table gives no rows.
    """
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    packs = max(64, 2 * source.rdd.getNumPartitions())
    # bucketed by block, so that documents stay where they are when ids come back
    blocks = written(source.mapInArrow(_blocks(path, packs, block_bytes), BLOCKS_DDL), "blocks", buckets=packs, by="block")
    owned = blocks.select("block", F.explode("packs").alias("p")).select("block", "p.*").repartitionById(packs, F.col("pack"))
    words = owned.select("block", "places", "lengths", "spelt").mapInArrow(_encode_packs(path), "block long, places binary, lengths binary, ids binary")
    bodies = blocks.select("block", "doc_ids", "counts", "codes")
    schema = "doc_id long, n_tokens long, ids binary" + ", decoded string" * spelt
    return bodies.groupBy("block").cogroup(words.groupBy("block")).applyInArrow(_join_back(path if spelt else None), schema)


@cache
def pieces(path: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The id-to-piece table: bytes of all pieces, their starts and lengths."""
    byte_of = {sign: b for b, sign in BYTE_SIGNS.items()}
    loaded = tokenizer(path)
    table = []
    for number in range(loaded.get_vocab_size()):
        piece = loaded.id_to_token(number)
        table.append(bytes(byte_of[c] for c in piece) if all(c in byte_of for c in piece) else piece.encode())
    lengths = np.array([len(p) for p in table], np.int64)
    return np.frombuffer(b"".join(table), np.uint8), np.cumsum(lengths) - lengths, lengths


def spell(ids: np.ndarray, bounds: list[int], path: str) -> list[str]:
    """The texts of the slices of ``ids`` between ``bounds``: every id joined
    with its piece.  Works through slices of bounded size."""
    flat, starts, lengths = pieces(path)
    out = []
    for first in range(0, len(bounds) - 1, 256):
        some = bounds[first : first + 257]
        part, ends = gather(flat, starts, lengths, ids[some[0] : some[-1]])
        cuts = np.concatenate(([0], ends))[np.array(some) - some[0]].tolist()
        out += [part[a:b].tobytes().decode("utf-8", "replace") for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
    return out


def _decode(path: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in sliced(batches):
            ids = [np.frombuffer(x.as_py() or b"", "<u4") for x in part.column("ids")]
            texts = spell(np.concatenate(ids), np.cumsum([0, *map(len, ids)]).tolist(), path)
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(texts, pa.string())], names=[*part.schema.names, "decoded"])

    return run


def decoded(coded: DataFrame, path: str) -> DataFrame:
    """``coded`` with a column ``decoded``: the text its ids spell, with special
    tokens written out; bytes that are no UTF-8 become replacement characters.
    Null ids spell the empty text."""
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in coded.schema.fields)
    return coded.mapInArrow(_decode(path), f"{fields}, decoded string")


def round_trip(docs: DataFrame, path: str) -> DataFrame:
    """Encode and decode: doc_id, n_tokens, ids, decoded."""
    return encoded(docs, path, spelt=True)
