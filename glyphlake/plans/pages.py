"""Queries over page documents, resources and resource memory."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from glyphlake import fixed_values as fv
from glyphlake.functions import urls
from glyphlake.operators import documents as docs
from glyphlake.operators import memory as mem
from glyphlake.operators.picking import prefer_matching
from glyphlake.plans import sql_text as d
from glyphlake.plans.fixtures import fixture, with_fixtures
from glyphlake.plans.registry import query, table
from glyphlake.plans.urls import target_tokens_sql
from glyphlake.session import checkpoint_root
from glyphlake.sources import sinks
from glyphlake.sources.pages import read_sitemap

C = F.col


def attr_sql(tag: str, name: str) -> str:
    return d.ext(tag, rf"(?i)\b{name}\s*=\s*[\"']([^\"']*)[\"']")


INLINE_CTE = rf""", st AS (SELECT page_id, url, 'css' AS kind, {d.trim_all('t')} AS text, CAST(pos AS BIGINT) AS pos FROM (SELECT page_id, url, unnest(x) AS t, generate_subscripts(x, 1) - 1 AS pos FROM
      (SELECT page_id, url, regexp_extract_all(html, '(?is)<style\b[^>]*>(.*?)</style>', 1) AS x FROM html) AS a) AS b),
  sc AS (SELECT page_id, url, {d.ext('t', '(?is)^(<script[^>]*>)')} AS head, {d.trim_all(d.ext('t', '(?is)^<script[^>]*>(.*)</script>$'))} AS text, pos + 4294967296 AS pos FROM (SELECT page_id, url, unnest(x) AS t, generate_subscripts(x, 1) - 1 AS pos FROM
      (SELECT page_id, url, regexp_extract_all(html, '(?is)<script\b[^>]*>.*?</script>', 0) AS x FROM html) AS a) AS b),
  sk AS (SELECT *, {attr_sql('head', 'id')} AS id, CASE WHEN contains(lower({attr_sql('head', 'type')}), 'json') OR {attr_sql('head', 'id')} = '__NEXT_DATA__' THEN 'inline-json' WHEN regexp_matches(text, {d.lit(fv.FONT_HINT)}) THEN 'inline-script' END AS kind
      FROM sc WHERE NOT regexp_matches(head, '(?i)\bsrc\s*=')),
  inline_docs AS (SELECT * FROM st WHERE text <> '' UNION ALL SELECT page_id, url || '#' || CASE WHEN kind = 'inline-script' THEN kind ELSE coalesce(nullif(id, ''), kind) END, kind, text, pos FROM sk WHERE kind IS NOT NULL AND text <> '')"""


@query("extract_inline_docs", with_fixtures("html") + INLINE_CTE + " SELECT page_id, url, kind, text, pos FROM inline_docs")
def _(spark, sf):
    df = docs.extract_inline_docs(fixture(spark, sf, "html"))
    return df.withColumn("pos", C("pos").cast("long"))


@query(
    "union_documents",
    with_fixtures("html") + INLINE_CTE + " SELECT page_id, url, 'html' AS kind, sha256(html) AS digest, CAST(-1 AS BIGINT) AS pos FROM html UNION ALL SELECT page_id, url, kind, sha256(text), pos FROM inline_docs",
)
def _(spark, sf):
    df = docs.union_documents(fixture(spark, sf, "html"))
    return df.select("page_id", "url", "kind", F.sha2("text", 256).alias("digest"), C("pos").cast("long").alias("pos"))


# the bare-URL pattern has a look-behind; here the character before is captured instead
_CSS_FONT = r"(?i)url\(\s*['\"]?([^\"')]+?\.(?:woff2|woff|otf|ttf)(?:\?[^\"')\s]+)?)['\"]?\s*\)"
_ATTR_FONT = r"""(?i)\b(?:href|src)=["']([^"']+?[.](?:woff2|woff|otf|ttf)(?:[?][^"'\s]+)?)["']"""
_RAW_FONT = r"(?i)(?:^|[^A-Za-z0-9._-])((?:https?://|/|\.\./|\./)[^\s\"'()<>]+?\.(?:woff2|woff|otf|ttf)(?:\?[^\s\"'()<>]+)?)"


def font_refs_sql(text: str) -> str:
    return (
        f"list_concat(regexp_extract_all({text}, {d.lit(_CSS_FONT)}, 1), regexp_extract_all({text}, {d.lit(_ATTR_FONT)}, 1), regexp_extract_all({text}, {d.lit(_RAW_FONT)}, 1))"
    )


def font_urls_cte(src: str, keys: str, text: str, base: str, name: str = "font_urls") -> str:
    """(keys, asset_url): distinct resolved font URLs of each row's text."""
    return f""", {name}_refs AS (SELECT DISTINCT {keys}, {base} AS base_url, unnest({font_refs_sql(text)}) AS ref FROM {src}),
      {name} AS (SELECT DISTINCT {keys}, u AS asset_url FROM (SELECT {keys}, {d.resolve('ref', 'base_url')} AS u FROM {name}_refs) AS q WHERE u IS NOT NULL)"""


@query("extract_asset_urls", with_fixtures("html", "css") + font_urls_cte("(SELECT url, html AS t FROM html UNION ALL SELECT url, css FROM css)", "url", "t", "url") + " SELECT url, asset_url FROM font_urls")
def _(spark, sf):
    both = fixture(spark, sf, "html").select("url", C("html").alias("t")).union(fixture(spark, sf, "css"))
    return docs.explode_urls(both, docs.font_urls(C("t"), C("url")), ["url"]).select("url", "asset_url").distinct()


_PAYLOAD = [
    r"""https?://[^\s"'<>]+?[.](?:woff2|woff|ttf|otf|zip)(?:[?][^\s"'<>]*)?""",
    r""""url"\s*:\s*"([^"]+?[.](?:woff2|woff|ttf|otf|zip)(?:[?][^"]*)?)"""+chr(34),
    r"""["'](/[^"'<>\\]+?[.](?:woff2|woff|ttf|otf|zip)(?:[?][^"'<>\\]*)?)["']""",
]
_PAYLOAD_SQL = "list_concat(" + ", ".join(f"regexp_extract_all(html, {d.lit('(?i)' + p)}, {min(k, 1)})" for k, p in enumerate(_PAYLOAD)) + ")"


@query("extract_payload_urls", with_fixtures("html") + f""", r AS (SELECT DISTINCT page_id, url, unnest({_PAYLOAD_SQL}) AS ref FROM html) SELECT DISTINCT page_id, {d.resolve('ref', 'url')} AS asset_url FROM r""")
def _(spark, sf):
    return docs.explode_urls(fixture(spark, sf, "html"), docs.payload_urls(C("html"), C("url")), ["page_id"]).select("page_id", "asset_url")


@query(
    "css_urls",
    with_fixtures("css") + rf""", r AS (SELECT DISTINCT url, regexp_replace({d.trim_all('x')}, '^["'']|["'']$', '', 'g') AS ref FROM (SELECT url, unnest(regexp_extract_all(css, '(?i)url\(([^)]+)\)', 1)) AS x FROM css) AS q)
    SELECT DISTINCT url, {d.resolve('ref', 'url')} AS asset_url FROM r WHERE ref <> '' AND NOT starts_with(ref, 'data:')""",
)
def _(spark, sf):
    return docs.explode_urls(fixture(spark, sf, "css"), docs.css_urls(C("css"), C("url")), ["url"]).select("url", "asset_url")


_DOCUMENTS = [
    r"""https?://[^\s"'<>]+?(?:[.]pdf|/pdfs/[a-z0-9-]+)(?:[?][^\s"'<>]*)?""",
    r"""["'](/[^"'<>]+?(?:[.]pdf|/pdfs/[a-z0-9-]+)(?:[?][^"'<>]*)?)["']""",
]
_DOC_SQL = "list_concat(" + ", ".join(f"regexp_extract_all(html, {d.lit('(?i)' + p)}, {k})" for k, p in enumerate(_DOCUMENTS)) + ")"


@query(
    "extract_doc_links",
    with_fixtures("html") + rf""", r AS (SELECT DISTINCT page_id, url, unnest({_DOC_SQL}) AS x FROM html), u AS (SELECT page_id, {d.resolve(d.entities("replace(" + d.trim_all('x') + ", '\\/', '/')"), 'url')} AS asset_url FROM r)
    SELECT DISTINCT page_id, asset_url FROM u WHERE regexp_matches(asset_url, '(?i)\.pdf(?:$|\?)') OR regexp_matches(asset_url, '(?i)/pdfs/[a-z0-9-]+(?:$|[/?#])')""",
)
def _(spark, sf):
    return docs.explode_urls(fixture(spark, sf, "html"), docs.document_links(C("html"), C("url")), ["page_id"]).select("page_id", "asset_url")


RESOURCE_CTE = rf""", tags AS (SELECT page_id, url AS page_url, html, generate_subscripts(x, 1) AS pos, unnest(x) AS tag FROM (SELECT page_id, url, html,
      list_concat(list_filter(regexp_extract_all(html, '(?is)<link\b[^>]*>', 0), lambda t: regexp_matches(t, '(?i)\bhref\s*=')), list_filter(regexp_extract_all(html, '(?is)<script\b[^>]*>', 0), lambda t: regexp_matches(t, '(?i)\bsrc\s*='))) AS x FROM html) AS a),
  attrs AS (SELECT page_id, page_url, pos, starts_with(lower(tag), '<link') AS is_link, CASE WHEN starts_with(lower(tag), '<link') THEN {attr_sql('tag', 'href')} ELSE {attr_sql('tag', 'src')} END AS ref,
      CASE WHEN starts_with(lower(tag), '<link') THEN lower({d.space(attr_sql('tag', 'rel'))}) ELSE 'script' END AS rel, lower({attr_sql('tag', 'as')}) AS a, lower({attr_sql('tag', 'type')}) AS ty FROM tags),
  res0 AS (SELECT *, {d.resolve('ref', 'page_url')} AS url FROM attrs),
  res1 AS (SELECT *, CASE WHEN NOT is_link THEN 'js' WHEN contains(rel, 'stylesheet') OR a = 'style' OR contains(lower(url), '.css') THEN 'css' WHEN contains(rel, 'manifest') OR contains(lower(url), 'manifest') THEN 'manifest'
      WHEN contains(ty, 'json') OR contains(lower(url), '.json') OR a = 'fetch' THEN 'json' WHEN a = 'script' OR contains(lower(url), '.js') OR contains(lower(url), '.mjs') OR contains(rel, 'modulepreload') THEN 'js' END AS kind FROM res0),
  cand AS (SELECT page_id, page_url, pos, url, kind, rel, kind || '|' || coalesce(nullif({d.token('rel')}, ''), 'none') || '|' || ({d.signature('url')}) AS memory_key FROM res1 WHERE url IS NOT NULL AND kind IS NOT NULL
      AND (regexp_matches(url, {d.lit(fv.TEXT_RESOURCE)}) OR kind = 'manifest') AND NOT regexp_matches({d.host('url')}, {d.lit(fv.NOISE_HOST)}) AND NOT regexp_matches({d.path('url')}, {d.lit(fv.NOISE_PATH)})),
  toks AS (SELECT page_id, {target_tokens_sql('url', 'html')} AS tokens FROM html),
  cand2 AS (SELECT c.*, k.tokens, {d.host('c.page_url')} AS host, lower({d.host('c.url')} || {d.path('c.url')}) AS hp FROM cand AS c JOIN toks AS k ON k.page_id = c.page_id),
  boosted AS (SELECT c.*, CASE WHEN m.score IS NULL THEN 0 ELSE greatest(1, least(40, CAST(floor(m.score + 0.5) AS INT))) END AS boost FROM cand2 AS c LEFT JOIN memory AS m ON m.host = c.host AND m.key = c.memory_key AND m.score >= 3),
  scored AS (SELECT *, CASE kind WHEN 'css' THEN 120 WHEN 'manifest' THEN 100 WHEN 'json' THEN 90 ELSE 70 END + CASE WHEN contains(rel, 'preload') OR contains(rel, 'prefetch') THEN 12 ELSE 0 END
      + CASE WHEN starts_with(url, {d.scheme('page_url')} || '://' || host || '/') THEN 20 ELSE 0 END + CASE WHEN len(list_filter(tokens, lambda t: contains(hp, t))) > 0 THEN 18 ELSE 0 END
      + CASE WHEN regexp_matches(hp, {d.lit(fv.RESOURCE_HINT)}) THEN 10 ELSE 0 END - CASE WHEN ends_with(lower({d.path('url')}), '.map') THEN 40 ELSE 0 END AS base_score FROM boosted)"""


@query(
    "extract_resources",
    with_fixtures("html", "memory") + RESOURCE_CTE + """, r AS (SELECT *, row_number() OVER (PARTITION BY page_id, url ORDER BY base_score DESC, pos) AS rn FROM scored)
    SELECT page_id, url, kind, rel, memory_key FROM r WHERE rn = 1""",
)
def _(spark, sf):
    scored = docs.score_resources(docs.resource_candidates(fixture(spark, sf, "html")))
    return docs.best_resources(scored).select("page_id", "url", "kind", "rel", "memory_key")


def _boosted(spark, sf):
    return mem.apply_memory(docs.resource_candidates(fixture(spark, sf, "html")), fixture(spark, sf, "memory"))


@query("resource_score", with_fixtures("html", "memory") + RESOURCE_CTE + " SELECT page_id, CAST(pos - 1 AS BIGINT) AS pos, url, CAST(base_score + boost AS BIGINT) AS score FROM scored")
def _(spark, sf):
    return docs.score_resources(_boosted(spark, sf)).select("page_id", C("pos").cast("long").alias("pos"), "url", C("score").cast("long").alias("score"))


@query("apply_memory", with_fixtures("html", "memory") + RESOURCE_CTE + " SELECT page_id, memory_key, boost, count(*) AS n FROM boosted GROUP BY ALL")
def _(spark, sf):
    return _boosted(spark, sf).groupBy("page_id", "memory_key", F.coalesce("boost", F.lit(0)).alias("boost")).agg(F.count("*").alias("n"))


@query(
    "top_resources",
    with_fixtures("html", "memory") + RESOURCE_CTE + """, r AS (SELECT *, row_number() OVER (PARTITION BY page_id, url ORDER BY base_score + boost DESC, pos) AS rn FROM scored),
    k AS (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY base_score + boost DESC, url) AS rk FROM r WHERE rn = 1) SELECT page_id, url, kind, CAST(base_score + boost AS BIGINT) AS score FROM k WHERE rk <= 18""",
)
def _(spark, sf):
    best = docs.best_resources(docs.score_resources(_boosted(spark, sf)))
    return docs.top_resources(best, k=18).select("page_id", "url", "kind", C("score").cast("long").alias("score"))


SIGNAL_CTE = INLINE_CTE + """, alldocs AS (SELECT page_id, url, 'html' AS kind, html AS text, CAST(-1 AS BIGINT) AS pos FROM html UNION ALL SELECT page_id, url, kind, text, pos FROM inline_docs)""" + font_urls_cte(
    "alldocs", "page_id, pos", "text", "url"
) + f""", signals AS (SELECT a.page_id, a.url, a.kind, a.pos, least(4, CASE WHEN f.page_id IS NOT NULL THEN 2 ELSE 0 END + CASE WHEN regexp_matches(text, {d.lit(fv.FONT_HINT)}) THEN 1 ELSE 0 END + CASE WHEN kind = 'css' THEN 1 ELSE 0 END) AS signal,
     f.page_id IS NOT NULL OR regexp_matches(text, {d.lit(fv.FONT_HINT)}) AS success FROM alldocs AS a LEFT JOIN (SELECT DISTINCT page_id, pos FROM font_urls) AS f ON f.page_id = a.page_id AND f.pos = a.pos)"""


def _signals(spark, sf):
    every = docs.union_documents(fixture(spark, sf, "html"))
    signal = docs.signal_score(C("text"), C("url"), C("kind"))
    return every.select("page_id", "url", "kind", C("pos").cast("long").alias("pos"), signal.alias("signal"), ((signal >= 2) | C("text").rlike(fv.FONT_HINT)).alias("success"))


@query("style_signal_corpus", with_fixtures("html") + SIGNAL_CTE + " SELECT page_id, kind, pos, signal, success FROM signals")
def _(spark, sf):
    return _signals(spark, sf).select("page_id", "kind", "pos", "signal", "success")


_OUTCOME_CTE = SIGNAL_CTE + f""", outcomes AS (SELECT {d.host('url')} AS host, kind || '|stylesheet|' || CASE WHEN page_id%2=0 THEN '/css/site-:num.css?v=:num' ELSE '/doc' || CAST(page_id%7 AS VARCHAR) END AS key, kind, 'stylesheet' AS rel,
      CASE WHEN page_id%2=0 THEN '/css/site-:num.css?v=:num' ELSE '/doc' || CAST(page_id%7 AS VARCHAR) END AS signature, success AND page_id%4<>3 AS success, signal, page_id*1000000 + pos AS seq FROM signals),
    batch AS (SELECT host, key, sum(CASE WHEN success THEN CASE WHEN signal >= 2 THEN 2 ELSE 1 END ELSE 0 END) AS ds, count(*) FILTER (WHERE NOT success) AS df, arg_max(signal, seq) AS last_signal, arg_min(kind, seq) AS bkind, arg_min(rel, seq) AS brel, arg_min(signature, seq) AS bsig FROM outcomes GROUP BY host, key),
    updated AS (SELECT coalesce(m.host, b.host) AS host, coalesce(m.key, b.key) AS key, coalesce(m.kind, bkind) AS kind, coalesce(m.rel, brel) AS rel, coalesce(m.signature, bsig) AS signature, CAST(coalesce(success_count, 0) + coalesce(ds, 0) AS BIGINT) AS success_count, CAST(coalesce(fail_count, 0) + coalesce(df, 0) AS BIGINT) AS fail_count,
      CAST(CASE WHEN b.host IS NULL THEN m.score ELSE greatest(-30, least(60, (coalesce(success_count, 0) + ds) * 6 + least(4, last_signal) * 2 - (coalesce(fail_count, 0) + df) * 4 + CASE WHEN coalesce(m.kind, bkind) = 'css' THEN 2 ELSE 0 END)) END AS DOUBLE) AS score,
      CASE WHEN b.host IS NULL THEN m.updated_at ELSE 1800000000000 END AS updated_at FROM memory AS m FULL JOIN batch AS b ON m.host = b.host AND m.key = b.key)"""


def _updated_memory(spark, sf):
    page = C("page_id")
    signature = F.when(page % 2 == 0, "/css/site-:num.css?v=:num").otherwise(F.concat(F.lit("/doc"), (page % 7).cast("string")))
    outcomes = _signals(spark, sf).select(
        urls.host_of(C("url")).alias("host"), F.concat_ws("|", "kind", F.lit("stylesheet"), signature).alias("key"), "kind", F.lit("stylesheet").alias("rel"), signature.alias("signature"),
        (C("success") & (page % 4 != 3)).alias("success"), "signal", (page * 1_000_000 + C("pos")).alias("seq"),
    )
    return mem.update_memory(fixture(spark, sf, "memory"), outcomes, 1_800_000_000_000)


@query("update_memory", with_fixtures("html", "memory") + _OUTCOME_CTE + " SELECT * FROM updated")
def _(spark, sf):
    return _updated_memory(spark, sf)


@query(
    "prune_memory",
    with_fixtures("html", "memory") + _OUTCOME_CTE + """, k AS (SELECT *, row_number() OVER (PARTITION BY host ORDER BY score DESC, updated_at DESC, key) AS rn FROM updated),
    h AS (SELECT host FROM (SELECT host, max(updated_at) AS u FROM k WHERE rn <= 3 GROUP BY host) AS q ORDER BY u DESC, host LIMIT 20) SELECT host, key, score FROM k WHERE rn <= 3 AND host IN (SELECT host FROM h)""",
)
def _(spark, sf):
    return mem.prune_memory(_updated_memory(spark, sf), per_host=3, hosts=20).select("host", "key", "score")


@query(
    "extract_embedded_json",
    with_fixtures("html") + r""", b AS (SELECT page_id, regexp_extract(html, '(?is)<script[^>]*\bid=["'']__NEXT_DATA__["''][^>]*>(.*?)</script>', 1) AS j FROM html),
    g AS (SELECT page_id, CAST(json_extract(CASE WHEN json_valid(j) THEN CAST(j AS JSON) END, '$.props.styles') AS JSON[]) AS items FROM b)
    SELECT page_id, CAST(pos - 1 AS BIGINT) AS pos, item->>'$.name' AS name, CAST(item->>'$.weight' AS BIGINT) AS weight FROM (SELECT page_id, generate_subscripts(items, 1) AS pos, unnest(items) AS item FROM g) AS q""",
)
def _(spark, sf):
    rows = docs.embedded_json_rows(fixture(spark, sf, "html"), "__NEXT_DATA__", "$.props.styles")
    item = F.from_json("item", "name string, weight long")
    return rows.select("page_id", C("pos").cast("long").alias("pos"), item["name"].alias("name"), item["weight"].alias("weight"))


_ANCHOR_SQL = rf""", a AS (SELECT page_id, url, generate_subscripts(x, 1) - 1 AS pos, unnest(x) AS tag FROM (SELECT page_id, url, regexp_extract_all(html, '(?is)<a\b[^>]*>.*?</a>', 0) AS x FROM html) AS q),
  r AS (SELECT page_id, pos, {d.resolve(d.entities(attr_sql(d.ext('tag', '(?is)^(<a[^>]*>)'), 'href')), 'url')} AS u, {d.space(d.entities(d.rep(d.ext('tag', '(?is)^<a[^>]*>(.*)</a>$'), '<[^>]+>', ' ')))} AS label FROM a),
  e AS (SELECT *, lower({d.ext(d.path('u'), '[.]([^./]*)$')}) AS ext, lower(u || ' ' || label) AS said FROM r WHERE u IS NOT NULL)"""


@query(
    "extract_anchor_assets",
    with_fixtures("html") + _ANCHOR_SQL + f""" SELECT page_id, CAST(pos AS BIGINT) AS pos, u AS asset_url, label, CASE WHEN ext = 'pdf' AND regexp_matches(said, {d.lit(fv.LEGAL_DOCUMENT)}) THEN 'legal-pdf' WHEN ext = 'pdf' AND regexp_matches(said, {d.lit(fv.SHEET_DOCUMENT)}) THEN 'sheet-pdf' WHEN ext = 'pdf' THEN 'pdf'
      WHEN ext = 'zip' AND regexp_matches(said, {d.lit(fv.TRIAL_ASSET)}) THEN 'trial-zip' WHEN ext = 'zip' THEN 'zip' WHEN contains(lower(u), 'firebasestorage.googleapis.com') THEN 'preview-firebase-font' WHEN ext IN ('otf', 'ttf') THEN 'desktop-file' ELSE 'preview-font' END AS asset_class
      FROM e WHERE ext IN ('woff', 'woff2', 'ttf', 'otf', 'zip', 'pdf')""",
)
def _(spark, sf):
    return docs.anchor_assets(fixture(spark, sf, "html")).withColumn("pos", C("pos").cast("long"))


# documents carry no style or feature words of their own; one seeded sentence is appended
_SEED = "CASE doc_id%6 WHEN 0 THEN ' Features: SS01, liga kern cv12 ss01.' WHEN 1 THEN ' Light Italic | Semi Bold/condensed bold oblique and Regular, italic' WHEN 2 THEN ' CondensedSemiboldItalic BoldItalic Regular' WHEN 3 THEN ' Latin Plus, Cyrillic & Viet-namese' WHEN 4 THEN ' ' ELSE ' Text Extra  Light. Small Ring Regular' END"


def seeded_documents(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.concat("text", F.expr(_SEED)).alias("text"))


@query("extract_feature_tags", f"WITH s AS (SELECT doc_id, text || {_SEED} AS text FROM documents) SELECT doc_id, array_to_string(list_sort(list_distinct(list_transform(regexp_extract_all(text, {d.lit(fv.FEATURE_TAG)}, 1), lambda t: lower(t)))), ',') AS tags FROM s")
def _(spark, sf):
    return seeded_documents(spark, sf).select("doc_id", F.array_join(docs.feature_tags(C("text")), ",").alias("tags"))


def spelled_sql(x: str) -> str:
    folded = d.rep_all(x, [(r"(?i)semi\s*-?\s*bold", "Semibold"), (r"(?i)demi\s*-?\s*bold", "Semibold"), (r"(?i)extra\s*-?\s*light", "Extralight"), (r"(?i)extra\s*-?\s*bold", "Extrabold"), (r"(?i)ultra\s*-?\s*light", "Extralight")])
    return f"array_to_string(list_transform(string_split({d.space(folded)}, ' '), lambda w: upper(w[1]) || lower(w[2:])), ' ')"


def candidates_sql(t: str) -> str:
    """Sorted list of style candidates of a flattened text."""
    phrase = rf"(?i)\b(?:(?:{fv.SHEET_WIDTH_WORDS})\s+)?(?:{fv.SHEET_STYLE_WORDS})(?:\s+(?:italic|oblique))?\b"
    base = (
        f"list_distinct(list_concat(list_transform(regexp_extract_all({t}, {d.lit(phrase)}), lambda s: {spelled_sql('s')}),"
        f" list_transform(regexp_extract_all({t}, {d.lit(fv.COMPACT_STYLE)}), lambda s: {spelled_sql(d.rep('s', '([a-z])([A-Z])', chr(92) + '1 ' + chr(92) + '2'))})))"
    )
    return (
        f"(SELECT list_sort(CASE WHEN list_contains(b, 'Regular') AND regexp_matches(tt, '(?i)\\b(?:italic|oblique)\\b') AND NOT list_has_any(b, ['Italic', 'Regular Italic', 'Regular Oblique']) THEN list_append(b, 'Italic') ELSE b END)"
        f" FROM (SELECT {base} AS b, {t} AS tt) AS bb)"
    )


def flat_sql(x: str) -> str:
    return d.rep(d.rep(x, "[/|]+", " "), r"\s+", " ")


@query("extract_style_candidates", f"WITH s AS (SELECT doc_id, {flat_sql('text || ' + _SEED)} AS t FROM documents) SELECT doc_id, array_to_string({candidates_sql('t')}, ',') AS candidates FROM s")
def _(spark, sf):
    return seeded_documents(spark, sf).select("doc_id", F.array_join(docs.style_candidates(C("text")), ",").alias("candidates"))


@query("language_hints", f"WITH s AS (SELECT doc_id, {d.token('text || ' + _SEED)} AS t FROM documents) SELECT doc_id, array_to_string(list_filter({d.words(fv.SCRIPT_NAMES)}, lambda n: contains(t, n)), ',') AS hints FROM s")
def _(spark, sf):
    return seeded_documents(spark, sf).select("doc_id", F.array_join(docs.language_hints(C("text")), ",").alias("hints"))


_SOFT_SQL = "list_filter([" + ", ".join(f"CASE WHEN regexp_matches(t, {d.lit(p)}) THEN {d.lit('pattern:' + p)} END" for p in fv.BLOCKED_SOFT) + "], lambda x: x IS NOT NULL)"
_STRONG_SQL = "list_filter([" + ", ".join(f"CASE WHEN contains(t, {d.lit(p)}) THEN {d.lit('strong:' + p)} END" for p in fv.BLOCKED_STRONG) + "], lambda x: x IS NOT NULL)"


@query(
    "classify_blocked_page",
    with_fixtures("html") + f""", s AS (SELECT page_id, CASE page_id%29 WHEN 0 THEN 403 WHEN 1 THEN 429 ELSE 200 END AS status, lower({d.ext('html', '(?is)<title[^>]*>(.*?)</title>')} || chr(10) || html) AS t FROM html),
    g AS (SELECT page_id, status, {_SOFT_SQL} AS soft, {_STRONG_SQL} AS strong FROM s), v AS (SELECT *, status IN (403, 429) OR len(strong) > 0 OR len(soft) >= 2 AS blocked FROM g)
    SELECT page_id, blocked, concat_ws(',', CASE WHEN status IN (403, 429) THEN 'status:' || status END, nullif(array_to_string(soft, ','), ''), nullif(array_to_string(strong, ','), '')) AS signals,
      CASE WHEN blocked THEN 'Blocked page detected (' || concat_ws(', ', CASE WHEN status IN (403, 429) THEN 'status ' || status END, CASE WHEN len(strong) > 0 THEN 'strong-signals ' || len(strong) END, CASE WHEN len(soft) > 0 THEN 'signals ' || len(soft) END) || ').' END AS reason FROM v""",
)
def _(spark, sf):
    status = F.when(C("page_id") % 29 == 0, 403).when(C("page_id") % 29 == 1, 429).otherwise(200)
    title = F.regexp_extract("html", "(?is)<title[^>]*>(.*?)</title>", 1)
    df = fixture(spark, sf, "html").select("page_id", docs.blocked_page(status, title, C("html"), [403, 429]).alias("v"))
    return df.select("page_id", C("v.blocked").alias("blocked"), F.array_join("v.signals", ",").alias("signals"), C("v.reason").alias("reason"))


@query(
    "extract_catalog",
    with_fixtures("html") + rf""", a AS (SELECT page_id, generate_subscripts(x, 1) AS pos, unnest(x) AS tag FROM (SELECT page_id, regexp_extract_all(html, '(?is)<a\b[^>]*href=["'']/fonts/[^"''?#]+[^"'']*["''][^>]*>.*?</a>', 0) AS x FROM html) AS q),
    r AS (SELECT page_id, pos, lower(regexp_extract(tag, '(?i)href=["'']/fonts/([^"''?#]+)', 1)) AS slug, {d.space(d.entities(d.rep('tag', '<[^>]+>', ' ')))} AS title FROM a)
    SELECT page_id, slug, arg_min(title, pos) AS title FROM r GROUP BY page_id, slug""",
)
def _(spark, sf):
    return docs.catalog_entries(fixture(spark, sf, "html"))


_KEYED_SQL = """html || '<a href="/fonts/deep/' || CAST(page_id%4 AS VARCHAR) || '?x=1">Deep ' || CAST(page_id%4 AS VARCHAR) || '</a><script>window.FontMetadata[' || chr(39) || 'Key-' || CAST(page_id%5 AS VARCHAR) || chr(39) || '] = 1; window.FontMetadata[' || chr(39) || 'deep/' || CAST(page_id%8 AS VARCHAR) || chr(39) || '] = 2</script>'"""


@query(
    "catalog_script_keys",
    with_fixtures("html") + rf""", h AS (SELECT page_id, {_KEYED_SQL} AS html FROM html), a AS (SELECT page_id, generate_subscripts(x, 1) AS pos, unnest(x) AS tag FROM (SELECT page_id, regexp_extract_all(html, '(?is)<a\b[^>]*href=["'']/fonts/[^"''?#]+[^"'']*["''][^>]*>.*?</a>', 0) AS x FROM h) AS q),
    r AS (SELECT page_id, pos, lower(regexp_extract(tag, '(?i)href=["'']/fonts/([^"''?#]+)', 1)) AS slug, {d.space(d.entities(d.rep('tag', '<[^>]+>', ' ')))} AS title FROM a),
    k AS (SELECT page_id, lower(unnest(regexp_extract_all(html, '(?i)window\.FontMetadata\[[^a-z]([^\]]+)[^a-z0-9]\]', 1))) AS slug FROM h),
    t AS (SELECT page_id, slug, arg_min(title, pos) AS title FROM r GROUP BY page_id, slug)
    SELECT page_id, slug, title FROM t UNION ALL SELECT DISTINCT page_id, slug, CAST(NULL AS VARCHAR) FROM k WHERE NOT EXISTS (SELECT 1 FROM t WHERE t.page_id = k.page_id AND t.slug = k.slug)""",
)
def _(spark, sf):
    text = lambda n: (C("page_id") % n).cast("string")
    more = F.concat(
        F.lit('<a href="/fonts/deep/'), text(4), F.lit('?x=1">Deep '), text(4), F.lit("</a><script>window.FontMetadata['Key-"), text(5),
        F.lit("'] = 1; window.FontMetadata['deep/"), text(8), F.lit("'] = 2</script>"),
    )
    return docs.catalog_entries(fixture(spark, sf, "html").withColumn("html", F.concat("html", more)))


@query(
    "form_feature_tags",
    """SELECT page_id, CASE page_id%3 WHEN 0 THEN 'kern,liga,ss07' WHEN 1 THEN 'liga,swsh' ELSE 'liga' END AS tags FROM pages WHERE trim(html) <> ''""",
)
def _(spark, sf):
    """The controls are added here; what they name follows from the page's id."""
    page = C("page_id")
    controls = F.concat(
        F.lit('<select name="Feature liga"><option value="none" data-other="zero">x</option></select>'),
        F.when(page % 3 == 0, '<option data-tag="SS07" id="kern-switch">').when(page % 3 == 1, '<input type="checkbox" name="Swashes-on" value=" SWSH ">').otherwise('<input name="size" value="tall">'),
        F.lit("<p>onum tnum</p>"),
    )
    pages = table(spark, sf, "pages").filter(F.trim("html") != "")
    return pages.select("page_id", F.array_join(docs.form_feature_tags(F.concat("html", controls)), ",").alias("tags"))


@query(
    "glyph_payload_stats",
    with_fixtures("html") + r""", x AS (SELECT page_id, regexp_extract_all(html, '(?i)data-characters=["'']([^"'']*)["'']', 1) AS s FROM html)
    SELECT page_id, CAST(len(s) AS INT) AS glyph_sets, CAST(len(list_filter(regexp_split_to_array(array_to_string(s, ' '), '\s+'), lambda t: t <> '')) AS INT) AS glyph_tokens FROM x""",
)
def _(spark, sf):
    df = fixture(spark, sf, "html").select("page_id", docs.glyph_payload_stats(C("html")).alias("g"))
    return df.select("page_id", "g.glyph_sets", "g.glyph_tokens")


@query(
    "prefer_matching",
    with_fixtures("html") + font_urls_cte("html", "page_id, url", "html", "url") + f""", t AS (SELECT page_id, {target_tokens_sql('url', 'html')} AS tokens FROM html),
    m AS (SELECT f.page_id, f.asset_url, len(list_filter(t.tokens, lambda k: contains({d.token("string_split(" + d.path('f.asset_url') + ", '/')[-1]")}, k))) > 0 AS hit FROM font_urls AS f JOIN t ON t.page_id = f.page_id)
    SELECT page_id, asset_url FROM (SELECT *, bool_or(hit) OVER (PARTITION BY page_id) AS any_hit FROM m) AS q WHERE hit OR NOT any_hit""",
)
def _(spark, sf):
    from glyphlake.functions.text import any_contains, base_name, normalize_token

    found = fixture(spark, sf, "html").select(
        "page_id", urls.target_tokens(C("url"), C("html")).alias("tokens"), F.explode(docs.font_urls(C("html"), C("url"))).alias("asset_url")
    )
    hit = any_contains(normalize_token(base_name(urls.path_of(C("asset_url")))), C("tokens"))
    return prefer_matching(found, ["page_id"], hit).select("page_id", "asset_url")


@query(
    "read_sitemap",
    """WITH l AS (SELECT CASE WHEN page_id % 5 = 0 THEN 'https://shop.example.com/about/' ELSE 'https://shop.example.com/fonts/' END || 'Face-' || page_id // 2 || CASE page_id % 3 WHEN 0 THEN '/' WHEN 1 THEN '?from=map' ELSE '' END AS loc FROM pages)
    SELECT DISTINCT lower(regexp_extract(loc, '/fonts/([^/?#]+)', 1)) AS slug FROM l WHERE contains(loc, '/fonts/')""",
)
def _(spark, sf):
    """Addresses of the stored pages as sitemaps under an index, read back."""
    k = C("page_id")
    shelf = F.when(k % 5 == 0, "https://shop.example.com/about/").otherwise("https://shop.example.com/fonts/")
    ending = F.when(k % 3 == 0, "/").when(k % 3 == 1, "?from=map").otherwise("")
    locations = table(spark, sf, "pages").select(F.concat(shelf, F.lit("Face-"), F.expr("page_id div 2"), ending).alias("loc"))
    index = sinks.write_sitemaps(locations, f"{checkpoint_root(spark)}/sitemap_{uuid.uuid4().hex}", 3)
    return read_sitemap(spark, index, "https://shop.example.com/fonts/")
