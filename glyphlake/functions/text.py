"""Text columns: tokens, spaces, words, entities, safe names."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once per row.

    A plain column used several times is copied into every use, and the copies
    multiply when such columns nest; a lambda variable is not.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))


def normalize_token(c: Column) -> Column:
    return F.regexp_replace(F.lower(c), "[^a-z0-9]+", "")


def normalize_space(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, r"\s+", " "))


def trim_all(c: Column) -> Column:
    """Trim every kind of white space, not only blanks."""
    return F.btrim(c, F.lit(" \t\n\x0b\f\r"))


def strip_quotes(c: Column) -> Column:
    return trim_all(F.regexp_replace(trim_all(c), "^['\"]+|['\"]+$", ""))


def blank_to_null(c: Column) -> Column:
    # ``nullif`` inside a lambda reads its argument twice, and nested ones multiply
    return let(c, lambda v: F.when(v != "", v))


def title_words(c: Column) -> Column:
    return F.initcap(normalize_space(F.regexp_replace(c, "[-_]+", " ")))


def ascii_bounds(pattern: str) -> str:
    """Spell word boundaries out over ASCII letters and digits.

    What ``\\b`` means next to an accented letter depends on the Java version;
    style and licence words must be found there as well ("éBold").
    """
    return pattern.replace(r"\b", r"(?:(?<=\w)(?!\w)|(?<!\w)(?=\w))")


def rewrite(c: Column, rules: list[tuple[str, str]]) -> Column:
    """Apply a list of (pattern, replacement) in order."""
    return reduce(lambda acc, rule: F.regexp_replace(acc, ascii_bounds(rule[0]), rule[1]), rules, c)


def decode_html_entities(c: Column) -> Column:
    """Six entities; the ampersand goes first, so ``&amp;lt;`` becomes ``<``."""
    return rewrite(
        c,
        [
            ("(?i)&amp;", "&"),
            ("(?i)&quot;", '"'),
            ("(?i)&#39;", "'"),
            ("(?i)&lt;", "<"),
            ("(?i)&gt;", ">"),
            ("(?i)&nbsp;", " "),
        ],
    )


# Latin letters with marks and their base letters (no NFKD among the built-ins).
ACCENTED = "àáâãäåçèéêëìíîïñòóôõöùúûüýÿÀÁÂÃÄÅÇÈÉÊËÌÍÎÏÑÒÓÔÕÖÙÚÛÜÝ"
BASE_LETTERS = "aaaaaaceeeeiiiinooooouuuuyyAAAAAACEEEEIIIINOOOOOUUUUY"


def strip_accents(c: Column) -> Column:
    return F.translate(F.regexp_replace(c, "[\\u0300-\\u036f]", ""), ACCENTED, BASE_LETTERS)


def normalized_words(c: Column) -> Column:
    """Percent- and entity-decoded, unaccented, camel-split, lower-case words."""
    decoded = decode_html_entities(
        let(c, lambda v: F.coalesce(F.try_url_decode(F.replace(v, F.lit("+"), F.lit("%2B"))), v))
    )
    spaced = F.regexp_replace(strip_accents(decoded), "([a-z0-9])([A-Z])", "$1 $2")
    return F.filter(F.split(F.lower(spaced), "[^a-z0-9]+"), lambda w: w != "")


def safe_file_name(c: Column) -> Column:
    kept = normalize_space(F.regexp_replace(c, "[^a-zA-Z0-9 _-]+", ""))
    return F.coalesce(blank_to_null(F.trim(kept)), F.lit("font-file"))


def file_stem(c: Column) -> Column:
    """Kebab-case stem of a display name."""
    spelled = F.regexp_replace(normalize_space(c), "&", " and ")
    return F.lower(F.regexp_replace(F.regexp_replace(spelled, "[^A-Za-z0-9]+", "-"), "^-+|-+$", ""))


def file_name_hint(family: Column, style: Column) -> Column:
    parts = F.array(file_stem(family), file_stem(style))
    return let(parts, lambda p: F.when((p[0] != "") & (p[1] != ""), F.array_join(p, "-")))


def base_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def extension(name: Column) -> Column:
    """Lower-case extension without the dot, '' when there is none."""
    return F.lower(F.regexp_extract(name, r"[^/.][^/]*?\.([^./]*)$", 1))


def without_extension(name: Column) -> Column:
    return F.regexp_replace(base_name(name), r"(?<=.)\.[^.]*$", "")


def strip_numeric_prefix(c: Column) -> Column:
    return F.regexp_replace(c, r"^\d{8,}-", "")


def strip_web_suffix(c: Column) -> Column:
    """Desktop files drop a trailing ``-web``; a name made only of it stays."""
    cut = trim_all(F.regexp_replace(trim_all(c), r"(?i)[-_\s]+web$", ""))
    return F.coalesce(blank_to_null(cut), c)


def any_contains(text: Column, words: Column) -> Column:
    return F.exists(words, lambda w: F.contains(text, w))
