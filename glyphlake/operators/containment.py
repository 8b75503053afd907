"""Which tokens occur inside which texts, without comparing all with all."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glyphlake.functions.text import let

C = F.col

#: bits of the index per token, and at most: two megabytes, however many tokens
BITS_PER_TOKEN, MOST_BITS = 32, 1 << 24
#: so many anchors are spelled out in a pattern; more go into the index
SPELLED = 1000
#: characters of a text that travel with a piece, at most
WINDOW = 256


def anchor_bits(anchors: DataFrame, tokens: int) -> tuple[list[int], int]:
    """A set of anchors as bits, in words of 64; a bit may stand for several."""
    bits = 1 << 10
    while bits < min(MOST_BITS, tokens * BITS_PER_TOKEN):
        bits *= 2
    place = F.pmod(F.xxhash64(C("anchor").cast("binary")), F.lit(bits))
    words = anchors.select(F.floor(place / 64).alias("word"), F.expr("1L").alias("one"), (place % 64).cast("int").alias("bit"))
    found = words.groupBy("word").agg(F.bit_or(F.expr("shiftleft(one, bit)")).alias("bits")).collect()
    out = [0] * (bits // 64)
    for row in found:
        out[row["word"]] = row["bits"]
    return out, bits


def trie_pattern(words: list[str]) -> str:
    """A regular expression for words of one length over ``[a-z0-9]``; it
    reads every character of a text once for each level that fits."""
    tails: dict[str, list[str]] = {}
    for word in words:
        tails.setdefault(word[0], []).append(word[1:])
    branches = [first + (trie_pattern(rest) if rest[0] else "") for first, rest in sorted(tails.items())]
    return branches[0] if len(branches) == 1 else "(?:" + "|".join(branches) + ")"


def _spelled_hits(text: Column, anchors: dict[int, list[str]], width: int) -> Column:
    """As ``_hits``, by one search for each size: few anchors are spelled out."""

    def of_size(size: int, words: list[str]) -> Column:
        rest = f".{{0,{width - size}}}" if width > size else ""
        found = F.regexp_extract_all(text, F.lit(f"(?s)(?=({trie_pattern(words)}{rest}))"), F.lit(1))
        return F.transform(found, lambda w: F.struct(F.left(w, F.lit(size)).alias("anchor"), w.alias("window")))

    return F.array_distinct(F.concat(*[of_size(size, words) for size, words in sorted(anchors.items())]))


def _hits(text: Column, sizes: list[int], index: Column, bits: int, width: int) -> Column:
    """Array of struct(anchor, window): the distinct pieces of a text, as bytes,
    that the index knows, with what follows them."""

    def known(place: Column) -> Column:
        return F.call_function("getbit", F.get(index, F.shiftright(place, 6).cast("int")), place.bitwiseAND(63).cast("int")) == 1

    def of_size(size: int) -> Column:
        last = F.octet_length(text) - size + 1
        starts = F.when(last > 0, F.sequence(F.lit(1), last)).otherwise(F.array().cast("array<int>"))
        # a piece is cut out and hashed once, though its place is used twice
        places = F.transform(starts, lambda i: F.pmod(F.xxhash64(F.substring(text, i, F.lit(size))), F.lit(bits)))
        found = F.array_compact(F.transform(places, lambda place, i: F.when(known(place), i + 1)))
        return F.transform(found, lambda i: F.struct(F.substring(text, i, F.lit(size)).cast("string").alias("anchor"), F.substring(text, i, F.lit(width)).cast("string").alias("window")))

    return F.array_distinct(F.concat(*map(of_size, sizes)))


def contained_tokens(texts: DataFrame, tokens: DataFrame, min_length: int = 1, window: int = WINDOW) -> DataFrame:
    """(id, token) where ``text`` contains ``token``; both are ``[a-z0-9]*``.

    Every token is filed under its first 8 characters (4, 3, 2 or 1 if it is
    shorter), its anchor.  A pattern of the anchors, if they are few, or a
    bounded index goes to every task and prunes the pieces of a text in its own
    row.  What is left, with the
    characters that follow, meets the tokens in an equi-join and is verified
    there: neither texts nor all their pieces move.  Only for tokens longer
    than ``window`` are texts asked again, those that hold the beginning.
    """
    filed_size = F.when(F.length("token") >= 8, 8).otherwise(F.least(F.length("token"), F.lit(4)))
    sized = tokens.filter(F.length("token") >= F.lit(max(1, min_length))).distinct().select("token", filed_size.alias("_size"))
    filed = sized.select("token", "_size", F.left("token", C("_size")).alias("anchor"))
    # five sizes at most: texts are cut into pieces of those that occur only
    count, longest, sizes = filed.agg(F.count("*"), F.max(F.length("token")), F.array_sort(F.collect_set("_size"))).first()
    if not count:
        return texts.select("id", F.lit("").alias("token")).limit(0)
    width = min(longest, window)
    few = [r["anchor"] for r in filed.select("anchor").distinct().limit(SPELLED + 1).collect()]
    if len(few) <= SPELLED:
        pieces = _spelled_hits(C("text"), {size: [a for a in few if len(a) == size] for size in sizes}, width)
    else:
        words, bits = anchor_bits(filed, count)
        index = F.from_json(F.lit(json.dumps(words)), "array<bigint>")
        pieces = let(C("text").cast("binary"), lambda text: _hits(text, sizes, index, bits, width))
    met = texts.select("id", F.inline(pieces)).join(filed.select("token", "anchor"), "anchor")
    begins = met.filter(F.startswith("window", F.left("token", F.lit(width)))).select("id", "token").distinct()
    if longest <= window:
        return begins
    long = begins.filter(F.length("token") > window).groupBy("id").agg(F.collect_set("token").alias("_tokens"))
    asked = texts.join(long, "id").select("id", F.explode(F.filter("_tokens", lambda t: F.contains(C("text"), t))).alias("token"))
    return begins.filter(F.length("token") <= window).unionByName(asked.distinct())
