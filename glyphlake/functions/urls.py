"""URL columns: split, canonical form, resolution, host and path tests."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glyphlake import fixed_values as fv
from glyphlake.functions.text import (
    any_contains,
    blank_to_null,
    decode_html_entities,
    let,
    normalize_space,
    normalize_token,
    normalized_words,
    trim_all,
)

SCHEME = r"^([A-Za-z][A-Za-z0-9+.\-]*):"
ABSOLUTE = r"^[A-Za-z][A-Za-z0-9+.\-]*://"
# Characters a path or query may not carry unescaped.
UNSAFE = r'[^\x21-\x7e]|["<>`{}]'
# Spelt canonically as it is: a bare lower-case host, a path without dot
# segments, and nothing that must be escaped.
PLAIN = r'^https?://[a-z0-9.\-]+(?!\S*/\.{1,2}(?:[/?#]|$))/[\x21-\x7e&&[^"<>`{}]]*\z'


def scheme_of(u: Column) -> Column:
    return F.lower(F.regexp_extract(u, SCHEME, 1))


def authority_of(u: Column) -> Column:
    return F.regexp_extract(u, ABSOLUTE + r"([^/?#]*)", 1)


def path_of(u: Column) -> Column:
    return F.regexp_extract(u, ABSOLUTE + r"[^/?#]*([^?#]*)", 1)


def query_of(u: Column) -> Column:
    """Query with its question mark, '' when there is none."""
    return F.regexp_extract(u, r"^[^?#]*(\?[^#]*)", 1)


def fragment_of(u: Column) -> Column:
    return F.regexp_extract(u, r"(#.*)$", 1)


def host_of(u: Column) -> Column:
    """Lower-case host with a non-default port; '' when the URL has none."""
    bare = F.lower(F.regexp_replace(authority_of(u), r"^.*@", ""))
    port = F.when(u.rlike("(?i)^http:"), ":80$").when(u.rlike("(?i)^https:"), ":443$").otherwise("^$")
    return F.regexp_replace(bare, port, "")


def hostname_of(u: Column) -> Column:
    """Host without any port or brackets."""
    return F.regexp_replace(F.regexp_replace(host_of(u), r":\d+$", ""), r"^\[|\]$", "")


def percent_encode(c: Column) -> Column:
    """Escape only what may not stand in a path or query."""

    def escaped(v: Column) -> Column:
        return F.array_join(
            F.transform(
                F.regexp_extract_all(v, F.lit("(?s)."), F.lit(0)),
                lambda ch: F.when(ch.rlike(UNSAFE), F.replace(F.url_encode(ch), F.lit("+"), F.lit("%20"))).otherwise(ch),
            ),
            "",
        )

    return let(c, lambda v: F.when(v.rlike(UNSAFE), escaped(v)).otherwise(v))


def remove_dot_segments(path: Column) -> Column:
    """Fold ``.`` and ``..`` out of a rooted path."""

    def folded(v: Column) -> Column:
        kept = F.aggregate(
            F.filter(F.split(F.regexp_replace(v, r"/\.{1,2}$", "$0/"), "/"), lambda s, i: i > 0),
            F.array().cast("array<string>"),
            lambda acc, s: F.when(s == ".", acc)
            .when(s == "..", F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0))))
            .otherwise(F.concat(acc, F.array(s))),
        )
        return F.concat(F.lit("/"), F.array_join(kept, "/"))

    return let(path, lambda v: F.when(v.rlike(r"/\.{1,2}(/|$)"), folded(v)).otherwise(v))


def is_web_url(u: Column) -> Column:
    return u.rlike(r"(?i)^https?://[^\s/?#<>\"{}|\\^`]+([/?#]|$)")


def canonical_href(u: Column) -> Column:
    """Canonical form of an absolute http(s) URL, NULL for anything else."""

    def spelled(v: Column) -> Column:
        rooted = F.regexp_replace(path_of(v), "^$", "/")
        return F.concat(
            scheme_of(v),
            F.lit("://"),
            host_of(v),
            percent_encode(F.concat(remove_dot_segments(rooted), query_of(v), fragment_of(v))),
        )

    return let(u, lambda v: F.when(v.rlike(PLAIN), v).when(is_web_url(v), spelled(v)))


def normalize_input_url(c: Column) -> Column:
    def full(v: Column) -> Column:
        return F.when(v.rlike("(?i)^https?://"), v).when(v != "", F.concat(F.lit("https://"), v))

    return canonical_href(let(trim_all(c), full))


def resolve_url(ref: Column, base: Column) -> Column:
    """``ref`` resolved against ``base`` (RFC 3986); NULL unless http(s)."""

    def joined(x: Column) -> Column:
        r, b = x["r"], x["b"]
        origin = F.concat(scheme_of(b), F.lit("://"), authority_of(b))
        page = F.concat(origin, path_of(b))
        folder = F.regexp_replace(F.regexp_extract(path_of(b), r"^(.*/)", 1), "^$", "/")
        return (
            F.when(r.rlike(ABSOLUTE), r)
            .when(r.rlike(SCHEME), F.lit(None))
            .when(r.startswith("//"), F.concat(scheme_of(b), F.lit(":"), r))
            .when(r.startswith("/"), F.concat(origin, r))
            .when((r == "") | r.startswith("#"), F.concat(page, query_of(b), r))
            .when(r.startswith("?"), F.concat(page, r))
            .otherwise(F.concat(origin, folder, r))
        )

    pair = F.struct(trim_all(F.regexp_replace(ref, r"\\/", "/")).alias("r"), base.alias("b"))
    return canonical_href(let(pair, joined))


def with_resolved_url(df: DataFrame, ref: str, base: str, out: str) -> DataFrame:
    return df.withColumn(out, resolve_url(F.col(ref), F.col(base)))


def _form_encode(c: Column) -> Column:
    """Form serialisation keeps letters, digits and ``*-._``; blank is ``+``."""
    return let(
        c,
        lambda v: F.when(
            v.rlike(r"[^A-Za-z0-9*\-._+]"), F.url_encode(F.coalesce(F.try_url_decode(v), v))
        ).otherwise(v),
    )


def normalize_crawl_url(c: Column) -> Column:
    """No fragment; query parameters sorted by key, ties in their given order."""

    def parameter(p: Column, i: Column) -> Column:
        key = F.regexp_extract(p, "^([^=]*)", 1)
        value = F.regexp_extract(p, "^[^=]*=(.*)$", 1)
        return F.struct(
            _form_encode(key).alias("k"), i.alias("i"), _form_encode(value).alias("v")
        )

    def sorted_query(q: Column) -> Column:
        parts = F.filter(F.split(F.regexp_replace(q, r"^\?", ""), "&"), lambda p: p != "")
        return F.array_join(
            F.transform(F.array_sort(F.transform(parts, parameter)), lambda s: F.concat(s["k"], F.lit("="), s["v"])), "&"
        )

    def spelled(v: Column) -> Column:
        bare = F.regexp_replace(v, r"[?#].*$", "")
        query = query_of(v)
        return F.when(
            query != "", F.concat(bare, F.regexp_replace(F.concat(F.lit("?"), sorted_query(query)), r"^\?$", ""))
        ).otherwise(bare)

    return F.coalesce(let(canonical_href(c), lambda v: F.when(v.isNotNull(), spelled(v))), trim_all(c))


def is_private_url(c: Column) -> Column:
    """True for local, private-range, non-http(s) or unreadable URLs."""

    def private_range(o: Column) -> Column:
        a, b = o[0], o[1]
        return (
            (a == 10)
            | ((a == 172) & b.between(16, 31))
            | ((a == 192) & (b == 168))
            | ((a == 169) & (b == 254))
            | ((a == 100) & b.between(64, 127))
        )

    def local(host: Column) -> Column:
        octets = F.transform(F.split(host, r"\."), lambda o: o.try_cast("int"))
        return host.isin("localhost", "127.0.0.1", "::1", "0.0.0.0") | F.when(
            host.rlike(r"^\d+\.\d+\.\d+\.\d+$"), let(octets, private_range)
        ).otherwise(F.lit(False))

    return ~is_web_url(c) | let(hostname_of(c), local)


def has_skip_extension(path: Column) -> Column:
    return path.rlike(fv.CRAWL_SKIP)


def _alternation(words: list[str]) -> str:
    return "(?i)" + "|".join(re.escape(w).replace("/", "/") for w in words)


def matches_patterns(u: Column, include: list[str], exclude: list[str]) -> Column:
    return ~u.rlike(_alternation(exclude)) & u.rlike(_alternation(include))


def is_excluded(u: Column, exclude: list[str]) -> Column:
    return u.rlike(_alternation(exclude))


def resource_signature(u: Column) -> Column:
    """Path and query with hashes and numbers folded, so variants share a key."""
    path = F.lower(path_of(u))
    for pattern, to in (("[0-9a-f]{8,}", ":hash"), (r"\d+", ":num"), ("/{2,}", "/"), ("/$", "")):
        path = F.regexp_replace(path, pattern, to)
    query = F.regexp_replace(F.regexp_replace(query_of(u), "[0-9a-f]{8,}", ":hash"), r"\d+", ":num")
    return F.when(is_web_url(u), F.concat(path, query)).otherwise(normalize_space(F.lower(u)))


def memory_key(u: Column, kind: Column, rel: Column) -> Column:
    token = normalize_token(rel)
    return F.concat_ws("|", kind, F.coalesce(blank_to_null(token), F.lit("none")), resource_signature(u))


def asset_stem(u: Column) -> Column:
    """Readable part of an asset's file name."""
    name = F.element_at(F.split(path_of(u), "/"), -1)
    stem = F.try_url_decode(F.replace(name, F.lit("+"), F.lit("%2B")))
    for pattern in (
        r"\.[^.]+$",
        r"(?i)\.p$",
        "(?i)^[0-9a-f]{8,}[-_]+",
        "(?i)[-_]+[0-9a-f]{8,}$",
        r"(?:[-_][0-9]+)+$",
    ):
        stem = F.regexp_replace(stem, pattern, "")
    return blank_to_null(stem)


def target_tokens(u: Column, html: Column) -> Column:
    """Words of the page path and title that may name the wanted family."""
    stop = F.array(*[F.lit(w) for w in fv.FAMILY_STOPWORDS])
    keep = lambda t: (F.length(t) >= 3) & ~F.array_contains(stop, t)
    path_words = F.filter(F.transform(F.split(path_of(u), "/"), normalize_token), keep)
    title = F.regexp_replace(F.regexp_extract(html, r"(?is)<title[^>]*>(.*?)</title>", 1), "<[^>]+>", " ")
    title_words = F.filter(
        F.split(F.lower(title), "[^a-z0-9]+"), lambda t: keep(t) & ~t.isin("font", "family")
    )
    return F.array_union(path_words, title_words)


def is_noise_resource(u: Column) -> Column:
    return ~is_web_url(u) | host_of(u).rlike(fv.NOISE_HOST) | F.lower(path_of(u)).rlike(fv.NOISE_PATH)


def slug_words(u: Column) -> Column:
    """Word lists of the last path segment and of every segment after a marker."""
    markers = F.array(*[F.lit(m) for m in fv.SLUG_MARKERS])
    segments = F.filter(F.split(path_of(u), "/"), lambda s: s != "")

    def sequences(seg: Column) -> Column:
        marks = F.transform(seg, lambda s: normalize_token(F.coalesce(F.try_url_decode(s), s)))
        after = F.filter(F.arrays_zip(F.slice(seg, F.lit(2), F.size(seg)).alias("s"), marks.alias("m")), lambda x: x["s"].isNotNull())
        marked = F.filter(after, lambda x: F.array_contains(markers, x["m"]))
        return F.concat(
            F.transform(F.slice(F.reverse(seg), 1, 1), normalized_words),
            F.transform(marked, lambda x: normalized_words(x["s"])),
        )

    return let(segments, sequences)


def with_canonical_asset_url(df: DataFrame, raw: str, base: str, out: str) -> DataFrame:
    """Unescape, decode entities, strip quotes, resolve, drop the fragment."""
    cleaned = F.regexp_replace(
        decode_html_entities(F.regexp_replace(trim_all(F.col(raw)), r"\\/", "/")), "^['\"]+|['\"]+$", ""
    )
    staged = with_resolved_url(df.withColumn("_raw", cleaned), "_raw", base, out)
    return staged.withColumn(out, F.regexp_replace(F.col(out), "#.*$", "")).drop("_raw")


def keyword_format(text: Column) -> Column:
    """Best format keyword of a text, by rank."""
    ranked = None
    for word in fv.FORMAT_KEYWORDS:
        hit = F.contains(text, F.lit(word))
        ranked = F.when(hit, word) if ranked is None else ranked.when(hit, word)
    return ranked


def detect_extension(u: Column, declared: Column) -> Column:
    """Declared format, else path extension, else best keyword, else ``bin``."""
    known = fv.FORMAT_KEYWORDS
    path_ext = F.regexp_extract(F.lower(path_of(u)), r"\.([^./]*)$", 1)
    said = F.regexp_replace(F.lower(declared), r"^\.", "")
    return F.coalesce(
        F.when(~is_web_url(u), F.lit("bin")),
        F.when(said.isin(known), said),
        F.when(path_ext.isin(known), path_ext),
        keyword_format(F.lower(F.concat(path_of(u), query_of(u)))),
        F.lit("bin"),
    )


def url_format(u: Column) -> Column:
    """Format by plain substring; ttf when nothing matches."""
    low = F.lower(u)
    return (
        F.when(F.contains(low, F.lit(".woff2")), "woff2")
        .when(F.contains(low, F.lit(".woff")), "woff")
        .when(F.contains(low, F.lit(".otf")), "otf")
        .otherwise("ttf")
    )


def payload_format(head: Column, content_type: Column, u: Column) -> Column:
    """Magic bytes (hex of the first four), else content type, else URL."""
    by_magic = None
    for magic, name in fv.MAGIC_HEX.items():
        by_magic = F.when(head == magic, name) if by_magic is None else by_magic.when(head == magic, name)
    kind = F.lower(F.coalesce(content_type, F.lit("")))
    low = F.lower(u)
    by_url = None
    for name in ("woff2", "woff", "ttf", "otf", "zip"):
        hit = F.contains(low, F.lit("." + name))
        by_url = F.when(hit, name) if by_url is None else by_url.when(hit, name)
    by_type = (
        F.when(kind.rlike("text/html|application/json|text/plain"), F.lit(None).cast("string"))
        .when(F.contains(kind, F.lit("font/woff2")), "woff2")
        .when(F.contains(kind, F.lit("font/woff")), "woff")
        .when(F.contains(kind, F.lit("font/ttf")), "ttf")
        .when(F.contains(kind, F.lit("font/otf")), "otf")
        .when(F.contains(kind, F.lit("application/zip")), "zip")
        .when((kind != "") & ~kind.rlike("octet-stream|binary|x-font"), F.lit(None).cast("string"))
        .otherwise(by_url)
    )
    return F.coalesce(by_magic, by_type)
