"""Snippets of DuckDB SQL shared by the oracle statements.

These spell the expected results independently of the Spark columns.
"""

from __future__ import annotations


def lit(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def words(items) -> str:
    return "[" + ", ".join(lit(i) for i in items) + "]"


def rep(x: str, pattern: str, to: str = "") -> str:
    return f"regexp_replace({x}, {lit(pattern)}, {lit(to)}, 'g')"


def rep_all(x: str, rules) -> str:
    for pattern, to in rules:
        x = rep(x, pattern, to)
    return x


def ext(x: str, pattern: str, group: int = 1) -> str:
    return f"regexp_extract({x}, {lit(pattern)}, {group})"


def has(x: str, pattern: str) -> str:
    return f"regexp_matches({x}, {lit(pattern)})"


def token(x: str) -> str:
    return rep(f"lower({x})", "[^a-z0-9]+")


def space(x: str) -> str:
    return f"trim({rep(x, chr(92) + 's+', ' ')})"


def trim_all(x: str) -> str:
    return rep(x, r"^\s+|\s+$")


def strip_quotes(x: str) -> str:
    return trim_all(rep(trim_all(x), "^['\"]+|['\"]+$"))


def title(x: str) -> str:
    parts = f"list_filter(string_split({space(rep(x, '[-_]+', ' '))}, ' '), lambda w: w <> '')"
    return f"array_to_string(list_transform({parts}, lambda w: upper(w[1]) || lower(w[2:])), ' ')"


def entities(x: str) -> str:
    return rep_all(
        x, [("(?i)&amp;", "&"), ("(?i)&quot;", '"'), ("(?i)&#39;", "'"), ("(?i)&lt;", "<"), ("(?i)&gt;", ">"), ("(?i)&nbsp;", " ")]
    )


def scheme(u: str) -> str:
    return f"lower({ext(u, '^([A-Za-z][A-Za-z0-9+.-]*):')})"


def authority(u: str) -> str:
    return ext(u, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)")


def path(u: str) -> str:
    return ext(u, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)")


def query(u: str) -> str:
    return ext(u, r"^[^?#]*(\?[^#]*)")


def host(u: str) -> str:
    bare = f"lower({rep(authority(u), '^.*@')})"
    return (
        f"CASE {scheme(u)} WHEN 'http' THEN {rep(bare, ':80$')} WHEN 'https' THEN {rep(bare, ':443$')} ELSE {bare} END"
    )


def encode(x: str) -> str:
    return (
        f"array_to_string(list_transform(regexp_extract_all({x}, '(?s).'), lambda ch: "
        r"""CASE WHEN regexp_matches(ch, '[^\x21-\x7e]|["<>`{}]') THEN url_encode(ch) ELSE ch END), '')"""
    )


def undot(p: str) -> str:
    segs = f"string_split(regexp_replace({p}, '(/\\.{{1,2}})$', '\\1/'), '/')"
    fold = (
        f"list_reduce(list_transform({segs}[2:], lambda s: [s]), lambda a, b: "
        "CASE b[1] WHEN '.' THEN a WHEN '..' THEN a[:-2] ELSE list_concat(a, b) END, CAST([] AS VARCHAR[]))"
    )
    return rf"CASE WHEN regexp_matches({p}, '/\.{{1,2}}(/|$)') THEN '/' || array_to_string({fold}, '/') ELSE {p} END"


WEB = r"""(?i)^https?://[^\s/?#<>"{}|\\^`]+([/?#]|$)"""


def is_web(u: str) -> str:
    return has(u, WEB)


def href(u: str) -> str:
    rooted = f"CASE WHEN {path(u)} = '' THEN '/' ELSE {path(u)} END"
    return (
        f"CASE WHEN {is_web(u)} THEN {scheme(u)} || '://' || {host(u)} || {encode(undot(rooted))} || "
        f"{encode(query(u))} || {encode(ext(u, '(#.*)$'))} END"
    )


def resolve(ref: str, base: str) -> str:
    r = trim_all(f"replace({ref}, '\\/', '/')")
    origin = f"{scheme(base)} || '://' || {authority(base)}"
    folder = ext(path(base), "^(.*/)")
    joined = (
        f"CASE WHEN {has(r, '^[A-Za-z][A-Za-z0-9+.-]*://')} THEN {r} WHEN {has(r, '^[A-Za-z][A-Za-z0-9+.-]*:')} THEN NULL "
        f"WHEN starts_with({r}, '//') THEN {scheme(base)} || ':' || {r} WHEN starts_with({r}, '/') THEN {origin} || {r} "
        f"WHEN {r} = '' THEN {origin} || {path(base)} || {query(base)} "
        f"WHEN starts_with({r}, '#') THEN {origin} || {path(base)} || {query(base)} || {r} "
        f"WHEN starts_with({r}, '?') THEN {origin} || {path(base)} || {r} "
        f"ELSE {origin} || CASE WHEN {folder} = '' THEN '/' ELSE {folder} END || {r} END"
    )
    return f"(SELECT {href('j')} FROM (SELECT {joined} AS j) AS jj)"


def form(x: str) -> str:
    return (
        f"CASE WHEN regexp_matches({x}, '[^A-Za-z0-9*._+-]') THEN replace(url_encode(url_decode(replace({x}, '+', ' '))), '%20', '+') ELSE {x} END"
    )


def crawl_url(u: str) -> str:
    parts = f"list_filter(string_split({query(u)}[2:], '&'), lambda p: p <> '')"
    key = form("string_split(p, '=')[1]")
    val = form("CASE WHEN contains(p, '=') THEN regexp_extract(p, '^[^=]*=(.*)$', 1) ELSE '' END")
    rows = f"list_sort(list_transform({parts}, lambda p, i: {{'k': {key}, 'i': i, 'kv': {key} || '=' || {val}}}))"
    joined = f"array_to_string(list_transform({rows}, lambda s: s.kv), '&')"
    bare = rep(href(u), "[?#].*$")
    return (
        f"CASE WHEN {is_web(u)} THEN {bare} || CASE WHEN {joined} <> '' THEN '?' || {joined} ELSE '' END ELSE {trim_all(u)} END"
    )


def signature(u: str) -> str:
    p = rep_all(f"lower({path(u)})", [("[0-9a-f]{8,}", ":hash"), ("[0-9]+", ":num"), ("/{2,}", "/"), ("/$", "")])
    q = rep_all(query(u), [("[0-9a-f]{8,}", ":hash"), ("[0-9]+", ":num")])
    return f"CASE WHEN {is_web(u)} THEN {p} || {q} ELSE {space(f'lower({u})')} END"


def stem(u: str) -> str:
    name = f"url_decode(replace(string_split({path(u)}, '/')[-1], '+', '%2B'))"
    return "nullif(" + rep_all(
        name,
        [(r"\.[^.]+$", ""), (r"(?i)\.p$", ""), ("(?i)^[0-9a-f]{8,}[-_]+", ""), ("(?i)[-_]+[0-9a-f]{8,}$", ""), ("(?:[-_][0-9]+)+$", "")],
    ) + ", '')"


def accents(x: str) -> str:
    return f"strip_accents({x})"


def norm_words(x: str) -> str:
    decoded = accents(entities(f"coalesce(url_decode(replace({x}, '+', '%2B')), {x})"))
    spaced = f"lower(regexp_replace({decoded}, '([a-z0-9])([A-Z])', '\\1 \\2', 'g'))"
    return f"list_filter(regexp_split_to_array({spaced}, '[^a-z0-9]+'), lambda w: w <> '')"


def url_format(u: str) -> str:
    return (
        f"CASE WHEN contains(lower({u}), '.woff2') THEN 'woff2' WHEN contains(lower({u}), '.woff') THEN 'woff' "
        f"WHEN contains(lower({u}), '.otf') THEN 'otf' ELSE 'ttf' END"
    )
