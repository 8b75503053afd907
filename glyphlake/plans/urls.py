"""Queries over page and link URLs."""

from __future__ import annotations

from pyspark.sql import functions as F

from glyphlake import fixed_values as fv
from glyphlake.functions import text, urls
from glyphlake.operators import links
from glyphlake.plans import sql_text as d
from glyphlake.plans.fixtures import fixture, with_fixtures
from glyphlake.plans.registry import query, table
from glyphlake.sources.pages import read_pages


@query(
    "read_pages",
    """SELECT page_id, url, length(html) AS html_length, html LIKE '<!DOCTYPE%' AS has_doctype
       FROM pages WHERE trim(html) <> ''""",
)
def _(spark, sf):
    pages = read_pages(spark, f"{sf}/pages.parquet")
    return pages.select(
        "page_id", "url", F.length("html").cast("long").alias("html_length"), F.col("html").startswith("<!DOCTYPE").alias("has_doctype")
    )


@query(
    "normalize_input_url",
    f"""WITH x AS (SELECT page_id, CASE page_id%4 WHEN 0 THEN url WHEN 1 THEN '  ' || upper(url[1:5]) || url[6:] || ' '
                  WHEN 2 THEN regexp_replace(url, '^https?://', '') ELSE '  ' END AS raw FROM pages)
        SELECT page_id, {d.href("CASE WHEN regexp_matches(" + d.trim_all("raw") + ", '(?i)^https?://') THEN " + d.trim_all("raw") + " WHEN " + d.trim_all("raw") + " = '' THEN NULL ELSE 'https://' || " + d.trim_all("raw") + " END")} AS href FROM x""",
)
def _(spark, sf):
    u = F.col("url")
    raw = (
        F.when(F.col("page_id") % 4 == 0, u)
        .when(F.col("page_id") % 4 == 1, F.concat(F.lit("  "), F.upper(u.substr(1, 5)), F.substring(u, 6, 10000), F.lit(" ")))
        .when(F.col("page_id") % 4 == 2, F.regexp_replace(u, "^https?://", ""))
        .otherwise("  ")
    )
    return table(spark, sf, "pages").select("page_id", urls.normalize_input_url(raw).alias("href"))


@query(
    "normalize_crawl_url",
    f"""WITH x AS (SELECT page_id, url || CASE WHEN contains(url, '?') THEN '&b=2&a=1 x&b=1#f' ELSE '' END AS url FROM pages)
        SELECT page_id, {d.crawl_url("url")} AS link FROM x""",
)
def _(spark, sf):
    pages = table(spark, sf, "pages").withColumn(
        "url", F.concat("url", F.when(F.contains("url", F.lit("?")), "&b=2&a=1 x&b=1#f").otherwise(""))
    )
    return pages.select("page_id", urls.normalize_crawl_url(F.col("url")).alias("link"))


@query(
    "resolve_url",
    with_fixtures("html")
    + rf""", refs AS (SELECT page_id, url, generate_subscripts(h, 1) - 1 AS pos, unnest(h) AS href
             FROM (SELECT page_id, url, regexp_extract_all(html, '(?i)\b(?:href|src)="([^"]*)"', 1) AS h FROM html) AS a)
        SELECT page_id, CAST(pos AS BIGINT) AS pos, href, {d.resolve("href", "url")} AS resolved FROM refs""",
)
def _(spark, sf):
    refs = fixture(spark, sf, "html").select(
        "page_id", "url", F.posexplode(F.regexp_extract_all("html", F.lit(r'(?i)\b(?:href|src)="([^"]*)"'), F.lit(1))).alias("pos", "href")
    )
    return urls.with_resolved_url(refs, "href", "url", "resolved").select(
        "page_id", F.col("pos").cast("long").alias("pos"), "href", "resolved"
    )


@query(
    "host_of",
    f"""WITH x AS (SELECT page_id, CASE page_id%3 WHEN 0 THEN regexp_replace(url, '(//[^/]*)', '\\1:8080') WHEN 1 THEN replace(url, '.example', '.EXAMPLE') ELSE 'not a url' END AS u FROM pages)
        SELECT page_id, {d.host("u")} AS host FROM x""",
)
def _(spark, sf):
    u = (
        F.when(F.col("page_id") % 3 == 0, F.regexp_replace("url", "(//[^/]*)", "$1:8080"))
        .when(F.col("page_id") % 3 == 1, F.replace("url", F.lit(".example"), F.lit(".EXAMPLE")))
        .otherwise("not a url")
    )
    return table(spark, sf, "pages").select("page_id", urls.host_of(u).alias("host"))


_PRIVATE_SAMPLES = [
    "http://localhost/x", "http://127.0.0.1:8080/", "http://10.1.2.3/", "http://172.16.0.1/", "http://172.32.0.1/",
    "http://192.168.1.1/", "http://169.254.169.254/meta", "http://100.64.0.1/", "http://100.128.0.1/", "ftp://host/x",
    "http://[::1]/", "http://0.0.0.0/", "nonsense",
]


@query(
    "drop_private_urls",
    f"""WITH x AS (SELECT page_id, coalesce({d.words(_PRIVATE_SAMPLES)}[page_id % 40 + 1], url) AS url FROM pages),
        h AS (SELECT page_id, url, {d.rep(d.rep(d.host("url"), ":[0-9]+$"), "^[[]|]$")} AS host FROM x),
        o AS (SELECT *, CASE WHEN regexp_matches(host, '^[0-9]+[.][0-9]+[.][0-9]+[.][0-9]+$') THEN CAST(split_part(host, '.', 1) AS INT) END AS a,
              CASE WHEN regexp_matches(host, '^[0-9]+[.][0-9]+[.][0-9]+[.][0-9]+$') THEN CAST(split_part(host, '.', 2) AS INT) END AS b FROM h)
        SELECT page_id, url FROM o WHERE {d.is_web("url")} AND host NOT IN ('localhost', '127.0.0.1', '::1', '0.0.0.0')
          AND NOT coalesce(a=10 OR (a=172 AND b BETWEEN 16 AND 31) OR (a=192 AND b=168) OR (a=169 AND b=254) OR (a=100 AND b BETWEEN 64 AND 127), false)""",
)
def _(spark, sf):
    samples = F.array(*[F.lit(s) for s in _PRIVATE_SAMPLES])
    pages = table(spark, sf, "pages").select(
        "page_id", F.coalesce(F.get(samples, (F.col("page_id") % 40).cast("int")), F.col("url")).alias("url")
    )
    return pages.filter(~urls.is_private_url(F.col("url")))


_LINKS_CTE = rf""", hrefs AS (SELECT page_id, url, generate_subscripts(h, 1) - 1 AS pos, unnest(h) AS href FROM
      (SELECT page_id, url, regexp_extract_all(html, '(?i)<a\b[^>]*?\bhref\s*=\s*["'']([^"'']+)["'']', 1) AS h FROM html) AS a),
    targets AS (SELECT page_id, url, pos, {d.resolve("href", "url")} AS target FROM hrefs),
    links AS (SELECT page_id, url, link, min(pos) AS pos FROM (SELECT page_id, url, pos, {d.crawl_url("target")} AS link FROM targets WHERE target IS NOT NULL) AS t GROUP BY page_id, url, link)"""
_ADMITTED_CTE = (
    _LINKS_CTE
    + rf""", seeds AS (SELECT DISTINCT {d.host("url")} AS host FROM html),
    admitted AS (SELECT *, {d.host("link")} AS host FROM links WHERE {d.is_web("link")} AND NOT regexp_matches({d.path("link")}, {d.lit(fv.CRAWL_SKIP)})
      AND NOT regexp_matches(link, '(?i)/cart|/checkout|/login|/account|/privacy|/terms|/cdn-cgi/') AND {d.host("link")} IN (SELECT host FROM seeds))"""
)


@query("extract_links", with_fixtures("html") + _LINKS_CTE + " SELECT page_id, link, CAST(pos AS BIGINT) AS pos FROM links")
def _(spark, sf):
    found = links.extract_links(fixture(spark, sf, "html"))
    return found.select("page_id", "link", F.col("pos").cast("long").alias("pos"))


@query("has_skip_extension", with_fixtures("html") + _LINKS_CTE + f""" SELECT page_id, link, regexp_matches({d.path("link")}, {d.lit(fv.CRAWL_SKIP)}) AS skip FROM links""")
def _(spark, sf):
    found = links.extract_links(fixture(spark, sf, "html"))
    return found.select("page_id", "link", urls.has_skip_extension(urls.path_of(F.col("link"))).alias("skip"))


@query(
    "matches_patterns",
    with_fixtures("html") + _LINKS_CTE + """ SELECT page_id, link,
      len(list_filter(['/cart','/checkout','/login','/account','/privacy','/terms','/cdn-cgi/'], lambda p: contains(lower(link), p))) = 0
      AND len(list_filter(['/typefaces/','/fonts/','/font/','/family/'], lambda p: contains(lower(link), p))) > 0 AS is_catalog FROM links""",
)
def _(spark, sf):
    found = links.extract_links(fixture(spark, sf, "html"))
    hit = urls.matches_patterns(F.col("link"), fv.CRAWL_INCLUDE, fv.CRAWL_EXCLUDE)
    return found.select("page_id", "link", hit.alias("is_catalog"))


@query("crawl_admission", with_fixtures("html") + _ADMITTED_CTE + " SELECT page_id, link, host FROM admitted")
def _(spark, sf):
    pages = fixture(spark, sf, "html")
    return links.crawl_admission(links.extract_links(pages), links.seed_hosts(pages)).select("page_id", "link", "host")


_RULES_CTE = ", rules AS (" + " UNION ALL ".join(
    f"SELECT {i} AS priority, {d.lit(r)} AS rule, {d.lit(p)} AS part, {d.lit(x)} AS pattern"
    for i, (r, p, x) in enumerate(fv.ROUTING_RULES, 1)
) + ")"


def _route_sql(src: str, key: str, url: str) -> str:
    hostname = d.rep(d.host(url), ":[0-9]+$")
    return f"""(SELECT {key}, arg_min(rule, priority) AS rule FROM (SELECT s.*, {hostname} AS hn FROM {src} AS s) AS s
      JOIN rules ON regexp_matches(CASE part WHEN 'host' THEN hn ELSE {url} END, pattern) GROUP BY ALL)"""


@query(
    "links_by_rule_and_host",
    with_fixtures("html") + _ADMITTED_CTE + _RULES_CTE
    + f""" SELECT rule, host, count(*) AS links FROM {_route_sql("(SELECT DISTINCT host, link FROM admitted)", "host, link", "link")} AS r GROUP BY rule, host""",
)
def _(spark, sf):
    return links.links_by_rule_and_host(fixture(spark, sf, "html"))


@query("route", with_fixtures("routed") + _RULES_CTE + f" SELECT page_id, url, rule FROM {_route_sql('routed', 'page_id, url', 'url')} AS r")
def _(spark, sf):
    return links.route(fixture(spark, sf, "routed"))


@query(
    "routing_dim_usage",
    with_fixtures("routed") + _RULES_CTE
    + f""" SELECT r.priority, r.rule, r.part, count(x.page_id) AS pages FROM rules AS r LEFT JOIN {_route_sql('routed', 'page_id, url', 'url')} AS x ON x.rule = r.rule GROUP BY ALL""",
)
def _(spark, sf):
    counts = links.route(fixture(spark, sf, "routed")).groupBy("rule").agg(F.count("*").alias("n"))
    return (
        links.routing_dim(spark).join(counts, "rule", "left")
        .select("priority", "rule", "part", F.coalesce("n", F.lit(0)).alias("pages"))
    )


@query(
    "case_dim_coverage",
    with_fixtures("routed") + _RULES_CTE + ", cases AS (" + " UNION ALL ".join(
        f"SELECT {i} AS pos, {d.lit(c)} AS id, {timeout or 'CAST(NULL AS INT)'} AS timeout_ms, {str(soft).lower()} AS soft_pass"
        for i, (c, _u, timeout, soft) in enumerate(fv.SUITE_CASES, 1)
    ) + f""") SELECT c.pos, c.id, c.timeout_ms, c.soft_pass, count(x.page_id) AS pages FROM cases AS c LEFT JOIN {_route_sql('routed', 'page_id, url', 'url')} AS x ON x.rule = c.id GROUP BY ALL""",
)
def _(spark, sf):
    counts = links.route(fixture(spark, sf, "routed")).groupBy(F.col("rule").alias("expected_rule")).agg(F.count("*").alias("n"))
    return links.case_dim(spark).join(counts, "expected_rule", "left").select(
        "pos", "id", "timeout_ms", "soft_pass", F.coalesce("n", F.lit(0)).alias("pages")
    )


@query(
    "preset_dim_items",
    with_fixtures("api_json") + """ SELECT p.preset, p.items_path, p.url_field, count(a.doc_id) AS payloads
       FROM (VALUES ('lineto', 'styles', 'woff2'), ('generic-api', 'data.fonts', 'url')) AS p(preset, items_path, url_field)
       LEFT JOIN api_json AS a ON json_extract(CAST(a.payload AS JSON), '$.' || p.items_path) IS NOT NULL GROUP BY ALL""",
)
def _(spark, sf):
    presets = links.preset_dim(spark).filter("mode = 'api-json'")
    payloads = fixture(spark, sf, "api_json").select(
        "doc_id",
        F.explode(F.array_compact(F.array(
            *[F.when(F.get_json_object("payload", f"$.{path}").isNotNull(), F.lit(path)) for _, mode, path, *_r in fv.SOURCE_PRESETS if mode == "api-json"]
        ))).alias("items_path"),
    )
    return presets.join(payloads, "items_path", "left").groupBy("preset", "items_path", "url_field").agg(F.count("doc_id").alias("payloads"))


_DECLARED = "CASE page_id%5 WHEN 0 THEN '.OTF' WHEN 1 THEN 'bogus' END"


@query(
    "detect_format",
    with_fixtures("html", "css") + rf""", u AS (SELECT DISTINCT page_id, unnest(regexp_extract_all(html, '(?i)\b(?:href|src)="([^"]*)"', 1)) AS ref, url AS base FROM html),
      r AS (SELECT page_id, ref, {d.resolve("ref", "base")} AS u, {_DECLARED} AS declared, CASE page_id%6 WHEN 0 THEN '774F4632' WHEN 1 THEN '504B0304' ELSE '00000000' END AS head,
            CASE page_id%7 WHEN 0 THEN 'text/html' WHEN 1 THEN 'font/woff' WHEN 2 THEN 'image/png' WHEN 3 THEN 'application/octet-stream' END AS ctype FROM u)
      SELECT page_id, ref, CASE WHEN NOT coalesce({d.is_web("u")}, false) THEN 'bin' WHEN list_contains({d.words(fv.FORMAT_KEYWORDS)}, coalesce(ltrim(lower(declared), '.'), '')) THEN ltrim(lower(declared), '.')
          WHEN list_contains({d.words(fv.FORMAT_KEYWORDS)}, {d.ext("lower(" + d.path("u") + ")", "[.]([^./]*)$")}) THEN {d.ext("lower(" + d.path("u") + ")", "[.]([^./]*)$")}
          ELSE coalesce(list_filter({d.words(fv.FORMAT_KEYWORDS)}, lambda k: contains(lower({d.path("u")} || {d.query("u")}), k))[1], 'bin') END AS file_ext,
        CASE WHEN head='774F4632' THEN 'woff2' WHEN head='504B0304' THEN 'zip' WHEN ctype IN ('text/html', 'image/png') THEN NULL WHEN ctype='font/woff' THEN 'woff'
          ELSE list_filter(['woff2','woff','ttf','otf','zip'], lambda k: contains(lower(coalesce(u, ref)), '.' || k))[1] END AS payload_ext,
        {d.url_format("coalesce(u, ref)")} AS url_ext FROM r""",
)
def _(spark, sf):
    refs = fixture(spark, sf, "html").select(
        "page_id", "url", F.explode(F.array_distinct(F.regexp_extract_all("html", F.lit(r'(?i)\b(?:href|src)="([^"]*)"'), F.lit(1)))).alias("ref")
    )
    df = urls.with_resolved_url(refs, "ref", "url", "u")
    u, page = F.col("u"), F.col("page_id")
    declared = F.when(page % 5 == 0, ".OTF").when(page % 5 == 1, "bogus")
    head = F.when(page % 6 == 0, "774F4632").when(page % 6 == 1, "504B0304").otherwise("00000000")
    ctype = F.when(page % 7 == 0, "text/html").when(page % 7 == 1, "font/woff").when(page % 7 == 2, "image/png").when(page % 7 == 3, "application/octet-stream")
    either = F.coalesce(u, F.col("ref"))
    return df.select(
        "page_id", "ref",
        F.when(u.isNull(), F.lit("bin")).otherwise(urls.detect_extension(u, declared)).alias("file_ext"),
        urls.payload_format(head, ctype, either).alias("payload_ext"),
        urls.url_format(either).alias("url_ext"),
    )


@query(
    "resource_signature",
    f"""WITH x AS (SELECT page_id, CASE page_id%3 WHEN 0 THEN replace(url, '/en/', '/deadbeef01/') || '/' ELSE url END AS u FROM pages)
        SELECT page_id, {d.signature("u")} AS signature, 'css|' || coalesce(nullif({d.token("'Style Sheet'")}, ''), 'none') || '|' || ({d.signature("u")}) AS memory_key FROM x""",
)
def _(spark, sf):
    u = F.when(F.col("page_id") % 3 == 0, F.concat(F.replace("url", F.lit("/en/"), F.lit("/deadbeef01/")), F.lit("/"))).otherwise(F.col("url"))
    return table(spark, sf, "pages").withColumn("u", u).select(
        "page_id", urls.resource_signature(F.col("u")).alias("signature"),
        urls.memory_key(F.col("u"), F.lit("css"), F.lit("Style Sheet")).alias("memory_key"),
    )


_CSS_REFS = rf""", refs AS (SELECT url, generate_subscripts(r, 1) - 1 AS pos, unnest(r) AS ref FROM
   (SELECT url, regexp_extract_all(css, '(?i)url\(\s*["'']?([^"'')]+)["'']?\s*\)', 1) AS r FROM css) AS a)"""
_CSS_URL = r"(?i)url\(\s*[\"']?([^\"')]+)[\"']?\s*\)"


def _css_refs(spark, sf):
    return fixture(spark, sf, "css").select(
        "url", F.posexplode(F.regexp_extract_all("css", F.lit(_CSS_URL), F.lit(1))).alias("pos", "ref")
    )


@query(
    "asset_stem",
    with_fixtures("css") + _CSS_REFS + f""", r AS (SELECT url, pos, {d.resolve("ref", "url")} AS u FROM refs) SELECT url, CAST(pos AS BIGINT) AS pos, {d.stem("u")} AS stem FROM r""",
)
def _(spark, sf):
    df = urls.with_resolved_url(_css_refs(spark, sf), "ref", "url", "u")
    return df.select("url", F.col("pos").cast("long").alias("pos"), urls.asset_stem(F.col("u")).alias("stem"))


@query(
    "decode_html_entities",
    f"""SELECT page_id, {d.entities(d.ext("html", "(?is)<title[^>]*>(.*?)</title>") + " || '&amp;lt;&NBSP;&#39;&quot;'")} AS title FROM pages""",
)
def _(spark, sf):
    raw = F.concat(F.regexp_extract("html", "(?is)<title[^>]*>(.*?)</title>", 1), F.lit("&amp;lt;&NBSP;&#39;&quot;"))
    return table(spark, sf, "pages").select("page_id", text.decode_html_entities(raw).alias("title"))


def target_tokens_sql(url: str, html: str) -> str:
    """Array of target tokens, in order of first appearance."""
    title = d.rep(d.ext(html, "(?is)<title[^>]*>(.*?)</title>"), "<[^>]+>", " ")
    stop = d.words(fv.FAMILY_STOPWORDS)
    path_part = f"list_filter(list_transform(string_split({d.path(url)}, '/'), lambda s: {d.token('s')}), lambda t: length(t) >= 3 AND NOT list_contains({stop}, t))"
    title_part = f"list_filter(regexp_split_to_array(lower({title}), '[^a-z0-9]+'), lambda t: length(t) >= 3 AND NOT list_contains({stop}, t) AND t NOT IN ('font', 'family'))"
    return f"list_concat({path_part}, {title_part})"


@query("target_tokens", f"SELECT page_id, array_to_string(list_sort(list_distinct({target_tokens_sql('url', 'html')})), ' ') AS tokens FROM pages")
def _(spark, sf):
    tokens = F.array_join(F.array_sort(urls.target_tokens(F.col("url"), F.col("html"))), " ")
    return table(spark, sf, "pages").select("page_id", tokens.alias("tokens"))


@query(
    "is_noise_resource",
    with_fixtures("html") + rf""", u AS (SELECT DISTINCT page_id, url, unnest(regexp_extract_all(html, '(?i)\b(?:href|src)="([^"]*)"', 1)) AS ref FROM html),
      r AS (SELECT page_id, ref, {d.resolve("ref", "url")} AS u FROM u)
      SELECT page_id, ref, u IS NULL OR regexp_matches({d.host("u")}, {d.lit(fv.NOISE_HOST)}) OR regexp_matches({d.path("u")}, {d.lit(fv.NOISE_PATH)}) AS noise FROM r""",
)
def _(spark, sf):
    refs = fixture(spark, sf, "html").select(
        "page_id", "url", F.explode(F.array_distinct(F.regexp_extract_all("html", F.lit(r'(?i)\b(?:href|src)="([^"]*)"'), F.lit(1)))).alias("ref")
    )
    df = urls.with_resolved_url(refs, "ref", "url", "u")
    return df.select("page_id", "ref", F.coalesce(urls.is_noise_resource(F.col("u")), F.lit(True)).alias("noise"))


@query(
    "slug_words",
    with_fixtures("html") + _LINKS_CTE + f""", s AS (SELECT page_id, link, list_filter(string_split({d.path("link")}, '/'), lambda x: x <> '') AS seg FROM links),
      w AS (SELECT page_id, link, 0 AS n, {d.norm_words("seg[-1]")} AS w FROM s WHERE len(seg) > 0
        UNION ALL SELECT page_id, link, i, {d.norm_words("seg[i + 1]")} FROM (SELECT page_id, link, seg, unnest(range(1, len(seg))) AS i FROM s) AS q
          WHERE list_contains({d.words(fv.SLUG_MARKERS)}, {d.token("url_decode(seg[i])")}))
      SELECT page_id, link, string_agg(array_to_string(w, '-'), ' ' ORDER BY n) AS slugs FROM w GROUP BY page_id, link""",
)
def _(spark, sf):
    found = links.extract_links(fixture(spark, sf, "html"))
    seqs = urls.slug_words(F.col("link"))
    out = found.select("page_id", "link", seqs.alias("seqs")).filter(F.size("seqs") > 0)
    return out.select("page_id", "link", F.array_join(F.transform("seqs", lambda w: F.array_join(w, "-")), " ").alias("slugs"))


@query(
    "canonical_asset_url",
    with_fixtures("html") + rf""", u AS (SELECT DISTINCT page_id, url, '"' || replace(unnest(regexp_extract_all(html, '(?i)\b(?:href|src)="([^"]*)"', 1)), '/', '\/') || '&amp;x=1#frag"' AS ref FROM html),
      c AS (SELECT page_id, url, ref, {d.rep(d.entities("replace(" + d.trim_all("ref") + ", '\\/', '/')"), "^['\"]+|['\"]+$")} AS c FROM u)
      SELECT page_id, ref, {d.rep(d.resolve("c", "url"), "#.*$")} AS asset_url FROM c""",
)
def _(spark, sf):
    refs = fixture(spark, sf, "html").select(
        "page_id", "url", F.explode(F.array_distinct(F.regexp_extract_all("html", F.lit(r'(?i)\b(?:href|src)="([^"]*)"'), F.lit(1)))).alias("r")
    ).withColumn("ref", F.concat(F.lit('"'), F.replace("r", F.lit("/"), F.lit("\\/")), F.lit('&amp;x=1#frag"')))
    return urls.with_canonical_asset_url(refs, "ref", "url", "asset_url").select("page_id", "ref", "asset_url")
