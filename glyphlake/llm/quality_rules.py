"""Quality rules: a threshold table compiled into one Spark projection.

Measures of a text (length, symbol, stop-word and line ratios) are plain
column expressions, and each rule of the table is a range one of them must lie
in.  ``compiled`` turns the table into columns; there is no user function, no
shuffle and no second pass over the text.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glyphlake.llm.common import SPACES, whole

# fixed values: frequent words of the languages the corpus is written in
STOP_WORDS = (
    # English
    "the", "of", "and", "to", "a", "in", "is", "that", "it", "for", "was", "on", "with", "as", "be", "by", "this", "are", "at", "from",
    # German
    "der", "die", "und", "den", "von", "zu", "das", "mit", "sich", "des", "auf", "für", "ist", "im", "dem", "nicht", "ein", "eine", "als",
    # French
    "de", "la", "le", "et", "les", "en", "un", "du", "une", "que", "pour", "est", "dans", "qui", "par", "au", "sur", "pas", "avec",
    # Spanish
    "el", "y", "los", "se", "las", "del", "por", "con", "no", "una", "su", "para", "al", "es", "lo",
)

# the threshold table: rule, measure, least, most (None: no bound); a text
# that fails one rule is not kept
RULES = (
    ("too_few_words", "n_words", 50, None),
    ("word_length_low", "mean_word_length", 3.0, None),
    ("word_length_high", "mean_word_length", None, 12.0),
    ("symbols", "symbol_ratio", None, 0.05),
    ("exclamations", "exclamation_ratio", None, 0.1),
    ("ellipsis_lines", "ellipsis_line_ratio", None, 0.3),
    ("bullet_lines", "bullet_line_ratio", None, 0.9),
    ("repeated_lines", "dup_line_ratio", None, 0.4),
    ("repeated_words", "repeat_word_ratio", None, 0.5),
    ("stop_words", "stop_word_ratio", 0.02, None),
)

SYMBOLS = r"[^#*$%&|<>]+"

# of 64 bits, those that hold a word's place; the others hold a hash
PLACE_BITS = 21


def bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once per row."""
    return F.transform(F.array(value), body)[0]


def _covered(at: Column) -> Column:
    """Words covered by three-word windows that start at the given places, in
    ascending order: three each, less what the next one covers as well."""
    new = F.transform(at, lambda p, i: F.least(F.lit(3), F.coalesce(F.get(at, i + 1) - p, F.lit(3))))
    return F.aggregate(new, F.lit(0).cast("long"), lambda total, n: total + n)


def _repeated_by_words(words: Column) -> Column:
    """Places of repeated windows, by sorting the windows themselves."""
    windows = F.slice(F.transform(words, lambda w, i: F.struct(w.alias("a"), F.get(words, i + 1).alias("b"), F.get(words, i + 2).alias("c"), i.alias("at"))), 1, F.greatest(F.size(words) - 2, F.lit(0)))

    def same(x: Column, y: Column) -> Column:
        return (x["a"] == y["a"]) & (x["b"] == y["b"]) & (x["c"] == y["c"])

    def places(ordered: Column) -> Column:
        found = F.transform(ordered, lambda w, i: F.when(F.coalesce(same(w, F.get(ordered, i + 1)), F.lit(False)) | F.coalesce(same(w, F.get(ordered, i - 1)), F.lit(False)), w["at"].cast("long")))
        return F.sort_array(F.filter(found, lambda p: p.isNotNull()))

    return bound(F.sort_array(windows), places)


def _repeated_words(words: Column, place_bits: int = PLACE_BITS) -> Column:
    """Words that lie in a three-word window which the text has twice or more.

    Windows are sorted as numbers, the upper bits a hash and the lower ones the
    place, so that equal windows are neighbours.  The neighbours found are
    compared word by word; where two different windows share a hash, or the
    text has more words than places fit, the windows themselves are sorted.
    """
    mask = (1 << place_bits) - 1

    def number(w: Column, i: Column) -> Column:
        return F.xxhash64(w, F.get(words, i + 1), F.get(words, i + 2)).bitwiseAND(F.lit(~mask)).bitwiseOR(i)

    numbers = F.slice(F.transform(words, number), 1, F.greatest(F.size(words) - 2, F.lit(0)))

    def together(ordered: Column) -> Column:
        def same(v: Column, other: Column) -> Column:
            return F.coalesce(v.bitwiseXOR(other).bitwiseAND(F.lit(~mask)) == 0, F.lit(False))

        return F.filter(ordered, lambda v, i: same(v, F.get(ordered, i + 1)) | same(v, F.get(ordered, i - 1)))

    def clash(found: Column) -> Column:
        def differs(v: Column, i: Column) -> Column:
            other = F.get(found, i + 1)
            p, q = v.bitwiseAND(F.lit(mask)).cast("int"), other.bitwiseAND(F.lit(mask)).cast("int")
            equal = (F.get(words, p) == F.get(words, q)) & (F.get(words, p + 1) == F.get(words, q + 1)) & (F.get(words, p + 2) == F.get(words, q + 2))
            return (v.bitwiseXOR(other).bitwiseAND(F.lit(~mask)) == 0) & ~equal

        return F.size(F.filter(found, lambda v, i: F.coalesce(differs(v, i), F.lit(False)))) > 0

    def covered(found: Column) -> Column:
        places = F.sort_array(F.transform(found, lambda v: v.bitwiseAND(F.lit(mask))))
        slow = clash(found) | (F.size(words) > mask)
        return F.when(F.size(found) == 0, F.lit(0).cast("long")).when(slow, bound(_repeated_by_words(words), _covered)).otherwise(bound(places, _covered))

    return bound(F.sort_array(numbers), lambda ordered: bound(together(ordered), covered))


def measures(text: Column) -> dict[str, Column]:
    """Named measures of a whole text; a null text has no word and no line."""
    text = whole(text)

    def of_words(words: Column) -> Column:
        stops = F.size(F.filter(words, lambda w: F.lower(w).isin(*STOP_WORDS)))
        return F.struct(F.size(words).cast("long").alias("n_words"), stops.cast("long").alias("n_stop_words"), _repeated_words(words).alias("n_repeat_words"), F.length(F.array_join(words, "")).cast("long").alias("word_chars"))

    def of_lines(lines: Column) -> Column:
        def count(test: Callable[[Column], Column]) -> Column:
            return F.size(F.filter(lines, test)).cast("long")

        return F.struct(
            F.size(lines).cast("long").alias("n_lines"),
            (F.size(lines) - F.size(F.array_distinct(lines))).cast("long").alias("n_dup_lines"),
            count(lambda x: F.rtrim(x).endswith("...") | F.rtrim(x).endswith("…")).alias("n_ellipsis_lines"),
            count(lambda x: F.substring(F.ltrim(x), 1, 1).isin("-", "*", "•")).alias("n_bullet_lines"),
        )

    return {
        "_words": bound(F.filter(F.split(text, SPACES), lambda w: w != ""), of_words),
        "_lines": bound(F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")), of_lines),
        "n_symbols": F.length(F.regexp_replace(text, SYMBOLS, "")).cast("long"),
        "n_exclamations": (F.length(text) - F.length(F.replace(text, F.lit("!"), F.lit("")))).cast("long"),
    }


def ratios() -> dict[str, Column]:
    def per(part: str, of: str) -> Column:
        return F.when(F.col(of) > 0, F.col(part) / F.col(of)).otherwise(F.lit(0.0))

    return {
        "mean_word_length": per("word_chars", "n_words"),
        "symbol_ratio": per("n_symbols", "n_words"),
        "exclamation_ratio": per("n_exclamations", "n_words"),
        "stop_word_ratio": per("n_stop_words", "n_words"),
        "repeat_word_ratio": per("n_repeat_words", "n_words"),
        "dup_line_ratio": per("n_dup_lines", "n_lines"),
        "ellipsis_line_ratio": per("n_ellipsis_lines", "n_lines"),
        "bullet_line_ratio": per("n_bullet_lines", "n_lines"),
    }


def compiled(rules: tuple[tuple, ...]) -> Column:
    """Names of the rules that a row of measures fails, in table order."""
    failed = []
    for name, measure, least, most in rules:
        breaks = F.lit(False)
        if least is not None:
            breaks = breaks | (F.col(measure) < least)
        if most is not None:
            breaks = breaks | (F.col(measure) > most)
        failed.append(F.when(breaks, F.lit(name)))
    return F.filter(F.array(*failed), lambda x: x.isNotNull())


def judged(docs: DataFrame, rules: tuple[tuple, ...] = RULES) -> DataFrame:
    """One row per row of ``docs``: its counts, ratios, failed rules, verdict.

    A null or empty text has no word, so it fails the length rule.  Repeated
    rows are judged alike; columns beyond doc_id and text are not read.
    """
    found = docs.select(F.col("doc_id"), *[m.alias(n) for n, m in measures(F.col("text")).items()])
    flat = found.select("doc_id", "_words.*", "_lines.*", "n_symbols", "n_exclamations")
    rated = flat.select("*", *[r.alias(n) for n, r in ratios().items()])
    base_failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return rated.select("*", base_failed.alias("base_failed"), compiled(rules).alias("failed_rules")).withColumn("kept", ~F.col("base_failed") & (F.size("failed_rules") == 0))


def keep_good(docs: DataFrame, rules: tuple[tuple, ...] = RULES) -> DataFrame:
    """The documents that pass, with all their columns."""
    names = docs.columns
    found = docs.select(F.struct(*[F.col(f"`{n}`") for n in names]).alias("_row"), *[m.alias(n) for n, m in measures(F.col("text")).items()])
    flat = found.select("_row", "_words.*", "_lines.*", "n_symbols", "n_exclamations")
    return flat.select("*", *[r.alias(n) for n, r in ratios().items()]).filter(F.size(compiled(rules)) == 0).select("_row.*")
