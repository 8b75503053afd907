"""Derived inputs: the driver tables reshaped into pages, style sheets, dumps and logs.

One SQL text per input, used by Spark and by the checking engine alike, so
only portable SQL appears here.  Two dialect differences are filled in: the
ordered string aggregation and ``EACH(...)``, a row per listed literal.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from glyphlake import fixed_values as fv
from glyphlake.session import by_shuffle, deal_out

SQ, NL = "chr(39)", "chr(10)"

CSS_FACES = f"""
SELECT p_partkey, p_brand, CAST(FLOOR(p_partkey/1000.0) AS BIGINT) AS blk,
  concat('@font-face {{ font-family: "', p_name, CASE WHEN p_size%7=0 THEN ' Bold' ELSE '' END,
    CASE WHEN p_partkey%11=0 THEN ' Variable' ELSE '' END,
    '"; font-weight: ', CASE WHEN p_partkey%11=0 THEN '100 900' WHEN p_partkey%23=0 THEN 'bold' WHEN p_partkey%29=0 THEN 'normal' ELSE CAST(100*(1+p_size%9) AS VARCHAR(10)) END,
    '; font-style: ', CASE WHEN p_size%4=0 THEN 'italic' WHEN p_partkey%31=0 THEN 'Oblique' ELSE 'normal' END,
    '; src: url("/f/', CASE WHEN p_partkey%5=0 THEN 'a1b2c3d4e5-' ELSE '' END, replace(p_name,' ','-'),
    CASE WHEN p_size%5=0 THEN '-BoldItalic' WHEN p_size%5=1 THEN '-Light' WHEN p_size%5=2 THEN '-semi-bold' ELSE '' END,
    CASE WHEN p_partkey%11=0 THEN '-VF' ELSE '' END, '-', CAST(p_size AS VARCHAR(10)),
    CASE WHEN p_partkey%13=0 THEN '.woff' ELSE '.woff2' END, CASE WHEN p_partkey%17=0 THEN '?v=3' ELSE '' END, '") format("woff2")',
    CASE WHEN p_partkey%2=0 THEN concat(', url(', {SQ}, '../fonts/', replace(p_name,' ','_'), '-', CAST(p_size AS VARCHAR(10)), '.ttf', {SQ}, ')') ELSE '' END,
    CASE WHEN p_partkey%3=0 THEN '; unicode-range: U+0000-00FF' WHEN p_partkey%3=1 THEN '; unicode-range: U+0400-04FF' ELSE '' END,
    '; }}') AS face
FROM part
"""


def css(agg: str) -> str:
    return f"""
SELECT concat('https://', lower(replace(p_brand,'#','')), '.example.com/css/', CAST(blk AS VARCHAR(20)), '.css') AS url,
  {agg.format(x='face', sep=NL, key='p_partkey')} AS css
FROM ({CSS_FACES}) AS f GROUP BY p_brand, blk
"""


HTML = f"""
SELECT p.page_id AS page_id, p.url AS url, concat(p.html,
  '<a class="next" href="', n.url, '">next page</a>',
  '<link rel="stylesheet" href="/css/site-', CAST(p.page_id%7 AS VARCHAR(20)), '.css?v=', CAST(p.page_id AS VARCHAR(20)), '">',
  '<link rel="preload" as="script" href="assets/app-', CAST(p.page_id%5 AS VARCHAR(20)), '.js">',
  '<link href="https://cdn.example.net/site.webmanifest" rel="manifest">',
  '<link rel="preload" as="font" href="/f/body-', CAST(p.page_id%9 AS VARCHAR(20)), '.woff2">',
  '<link rel="icon" href="/favicon.png">',
  '<script src="https://www.googletagmanager.com/gtag.js"></script>',
  '<script src="../js/runtime.js"></script>',
  '<script src="/js/app.js.map"></script>',
  '<style>@font-face{{font-family:"Page Face ', CAST(p.page_id%13 AS VARCHAR(20)), '";font-weight:700;src:url(/f/page-face-', CAST(p.page_id%13 AS VARCHAR(20)), '.woff2)}}</style>',
  '<script>var theme={{fontFamily:"Page Face"}};load("https://cdn.example.net/f/extra-', CAST(p.page_id%4 AS VARCHAR(20)), '.zip");</script>',
  '<script id="__NEXT_DATA__" type="application/json">{{"props":{{"styles":[{{"name":"Style ', CAST(p.page_id%6 AS VARCHAR(20)), '","weight":', CAST(100*(1+p.page_id%9) AS VARCHAR(20)), '}},{{"name":"Italic","weight":400}}]}}', CASE WHEN p.page_id%19=0 THEN '' ELSE '}}' END, '</script>',
  CASE WHEN p.page_id%3=0 THEN '<a href="/files/technical-guide.pdf">Technical <b>PDF</b></a>' WHEN p.page_id%3=1 THEN '<a href="/files/eula-license.pdf">Licence</a>' ELSE '<a href="/files/family-trial.zip">Trial fonts</a>' END,
  '<a href="https://firebasestorage.googleapis.com/v0/demo.woff2?alt=media">Preview</a><a href="/files/Full-Family.zip">All</a><a href="/files/desktop.otf">Desktop</a>',
  '<a href="/docs/pdfs/', CASE WHEN p.page_id%2=0 THEN 'small-ring' ELSE 'other-face' END, '-sheet">Sheet</a>',
  '<a href="/fonts/face-', CAST(p.page_id%8 AS VARCHAR(20)), '">Face <i>', CAST(p.page_id%8 AS VARCHAR(20)), '</i></a>',
  '<form data-features="ss01 liga KERN"></form><div data-characters="A B C  D" ></div><div data-characters="x y"></div>',
  CASE WHEN p.page_id%17=0 THEN '<p>Just a moment... verify you are human</p>' WHEN p.page_id%23=0 THEN '<p>Ray ID 1234</p>' ELSE '' END) AS html
FROM pages AS p JOIN (SELECT page_id, url FROM pages) AS n
  ON n.page_id = (2*p.page_id+1) % (SELECT count(*) FROM pages)
"""


def api_json(agg: str) -> str:
    item = (
        "concat(CASE WHEN p_partkey%10=9 THEN concat('\"https://cdn.example.com/f/', replace(p_name,' ','-'), '.otf\"') ELSE "
        "concat('{\"family_name\":\"', p_name, '\"', "
        "CASE WHEN p_partkey%4=0 THEN concat(',\"url\":\"https://cdn.example.com/f/', replace(p_name,' ','-'), '.woff2\"') "
        "WHEN p_partkey%4=1 THEN concat(',\"woff2\":{\"href\":\"/f/', replace(p_name,' ','_'), '.woff2\"}') "
        "WHEN p_partkey%4=2 THEN concat(',\"font_file\":{\"url\":\"f/', CAST(p_partkey AS VARCHAR(20)), '.ttf\"}') ELSE '' END, "
        "CASE WHEN p_size%3=0 THEN ',\"license_type\":\"ofl-1.1\"' ELSE '' END, '}') END)"
    )
    keyed = f"concat('\"k', CAST(p_partkey AS VARCHAR(20)), '\":', {item})"
    return f"""
SELECT concat(p_brand, '-', CAST(blk AS VARCHAR(20))) AS doc_id,
  concat('{{"data":{{"fonts":', CASE WHEN odd=1 THEN '{{' ELSE '[' END, {agg.format(x='item', sep="','", key='p_partkey')},
    CASE WHEN odd=1 THEN '}}' ELSE ']' END, '}}}}') AS payload
FROM (SELECT p_brand, p_partkey, CAST(FLOOR(p_partkey/1000.0) AS BIGINT) AS blk, CAST(length(p_brand)%2 AS INTEGER) AS odd,
        CASE WHEN length(p_brand)%2=1 THEN {keyed} ELSE {item} END AS item FROM part) AS i
GROUP BY p_brand, blk, odd
"""


PRODUCTS = """
SELECT p_partkey, concat('{"id":', CAST(p_partkey AS VARCHAR(20)), ',"handle":"',
  CASE WHEN p_partkey%50=0 THEN 'option-set-' ELSE '' END, CASE WHEN p_partkey%50=0 THEN concat(CAST(p_partkey AS VARCHAR(20)), '-select-1') ELSE concat(replace(p_name,' ','-'), '-', CAST(p_partkey AS VARCHAR(20))) END,
  '","title":"', p_name, '","vendor":"', p_brand, '","product_type":"', CASE WHEN p_size%3=0 THEN 'Font' WHEN p_size%3=1 THEN 'Typeface' ELSE p_type END,
  '","tags":[', CASE WHEN p_size%2=0 THEN '"font","new"' ELSE '"merch"' END, '],"options":[{"name":"',
  CASE WHEN p_partkey%2=0 THEN 'Font License' ELSE 'Usage' END, '","values":["Desktop","Web","App"]},{"name":"',
  CASE WHEN p_partkey%3=0 THEN 'Style' WHEN p_partkey%3=1 THEN 'Weight' ELSE 'Pack' END, '","values":["Regular","Bold"]},{"name":"Slope","values":["Upright","Italic"]}],"variants":[',
  '{"id":', CAST(p_partkey*10+1 AS VARCHAR(20)), ',"title":"Desktop / Regular","option1":"Desktop","option2":"Regular","option3":"Upright","price":"', CAST(p_size AS VARCHAR(10)), '.00","available":true},',
  '{"id":', CAST(p_partkey*10+2 AS VARCHAR(20)), ',"title":"Web / Bold","option1":"Web","option2":"', CASE WHEN p_size%4=0 THEN 'Bold' ELSE 'Semi Bold' END, '","option3":"Italic","price":"9.50","available":false},',
  '{"id":', CAST(p_partkey*10+3 AS VARCHAR(20)), ',"title":"App / Family","option1":"App","option2":"', CASE WHEN p_size%5=0 THEN 'Complete Family' ELSE 'Black' END, '","option3":"Upright","price":"99.00"}',
  CASE WHEN p_partkey%7=0 THEN ',{"id":null,"title":"broken"}' ELSE '' END, ']}') AS payload
FROM part
"""


def collections(agg: str) -> str:
    style = (
        "concat('{\"name\":\"Regular\",\"webfontSources\":[{\"format\":\"woff\",\"url\":\"https://cdn.example.com/', s_name, '.woff\"}', "
        "CASE WHEN s_suppkey%3=0 THEN concat(',{\"format\":\"woff2\",\"url\":\"https://cdn.example.com/', s_name, '.woff2\"}') ELSE '' END, ']}')"
    )
    child = (
        f"concat('{{\"name\":\"', CASE WHEN s_suppkey%4=0 THEN '' ELSE replace(s_name,'#',' ') END, '\",\"fontStyles\":[', {style}, '],\"children\":[', "
        "CASE WHEN s_suppkey%5=0 THEN '{\"name\":\"Deep\",\"fontStyles\":[{\"name\":\"Bold\",\"webfontSources\":[{\"format\":\"woff2\",\"url\":\"https://cdn.example.com/deep.woff2\"}]}],\"children\":[]}' ELSE '' END, ']}')"
    )
    return f"""
SELECT concat(n_name, '-', CAST(blk AS VARCHAR(20))) AS doc_id, n_name,
  concat('{{"name":"', replace(n_name,'_',' '), '","fontStyles":[{{"name":"Root","webfontSources":[{{"format":"woff2","url":"https://cdn.example.com/', n_name, '.woff2"}}]}}],"children":[', {agg.format(x='child', sep="','", key='s_suppkey')}, ']}}') AS payload
FROM (SELECT n_name, s_suppkey, CAST(FLOOR(s_suppkey/1000.0) AS BIGINT) AS blk, {child} AS child
      FROM supplier JOIN nation ON s_nationkey = n_nationkey) AS c
GROUP BY n_name, blk
"""


TREE = """
SELECT concat('r', CAST(r_regionkey AS VARCHAR(20))) AS id, CAST(NULL AS VARCHAR(40)) AS parent_id, r_name AS name, 'folder' AS kind, CAST(0 AS BIGINT) AS size FROM region
UNION ALL SELECT concat('n', CAST(n_nationkey AS VARCHAR(20))), concat('r', CAST(n_regionkey AS VARCHAR(20))), n_name, 'folder', CAST(0 AS BIGINT) FROM nation
UNION ALL SELECT concat('s', CAST(s_suppkey AS VARCHAR(20))), concat('n', CAST(s_nationkey AS VARCHAR(20))), s_name, 'file', CAST(100+s_suppkey%900 AS BIGINT) FROM supplier
"""

FILE_METRICS = """
SELECT package, concat(package, '/', filename) AS path, filename, ext,
  CASE WHEN p_partkey%89=0 AND ext='woff' THEN 'woff2' WHEN p_partkey%101=0 THEN NULL ELSE ext END AS signature,
  CAST(1000+(p_partkey*7919)%50000 AS BIGINT) AS size_bytes, is_valid,
  CASE WHEN is_valid THEN CAST((p_partkey*37)%1500 AS BIGINT) END AS glyph_count,
  CASE WHEN is_valid THEN CAST((p_partkey*17)%900 AS BIGINT) END AS cmap_entries,
  CASE WHEN NOT is_valid THEN NULL WHEN p_partkey%6=0 THEN '' WHEN p_partkey%6=1 THEN 'kern,liga,ss01' WHEN p_partkey%6=2 THEN 'kern,onum' ELSE 'calt,kern,liga,zero' END AS feature_tags,
  CASE WHEN NOT is_valid THEN NULL WHEN p_partkey%53=0 THEN ' ' WHEN p_partkey%59=0 THEN '.' ELSE p_name END AS family_name,
  CASE WHEN NOT is_valid THEN NULL WHEN p_partkey%61=0 AND ext='woff2' THEN 'Regular' ELSE style END AS subfamily_name,
  CASE WHEN NOT is_valid THEN NULL ELSE concat(p_name, ' ', style) END AS full_name,
  CASE WHEN NOT is_valid THEN NULL WHEN p_partkey%67=0 THEN '' ELSE concat(replace(p_name,' ',''), '-', replace(style,' ','')) END AS postscript_name,
  CASE WHEN is_valid THEN p_size%4=0 END AS flag_italic, CAST(p_partkey*3+k AS BIGINT) AS pos
FROM (SELECT p_partkey, p_name, p_size, style, ext, k, package, p_partkey%97<>0 AS is_valid,
    concat(CASE WHEN p_partkey%41=0 THEN concat('12345678-', replace(p_name,' ','-')) WHEN p_partkey%43=0 THEN 'deadbeefdeadbeef00' WHEN p_partkey%47=0 THEN CAST(57000+p_partkey AS VARCHAR(20)) ELSE replace(p_name,' ','-') END,
      CASE WHEN p_partkey%37=0 THEN '-Variable' ELSE '' END, CASE WHEN p_partkey%43=0 OR p_partkey%47=0 THEN '' ELSE concat('-', replace(style,' ','')) END,
      CASE WHEN p_partkey%71=0 THEN '-trial' WHEN p_partkey%73=0 THEN '-web' ELSE '' END, '.', ext) AS filename
  FROM (SELECT p_partkey, p_name, p_size, concat(p_brand, '-', CAST(CAST(FLOOR(p_partkey/1000.0) AS BIGINT) AS VARCHAR(20))) AS package,
      CASE p_size%9 WHEN 0 THEN 'Thin' WHEN 1 THEN 'Light' WHEN 2 THEN 'Regular' WHEN 3 THEN 'Italic' WHEN 4 THEN 'Semi Bold' WHEN 5 THEN 'Bold Italic' WHEN 6 THEN 'Oblique' WHEN 7 THEN 'Black' ELSE 'ExtraBold' END AS style,
      k, CASE k WHEN 0 THEN 'woff2' WHEN 1 THEN 'woff' ELSE CASE WHEN p_partkey%3=0 THEN 'ttf' ELSE 'otf' END END AS ext
    FROM (SELECT p_partkey, p_name, p_size, p_brand, EACH(0, 1, 2) AS k FROM part) AS ks
    WHERE NOT (p_partkey%5=0 AND k=1)) AS a) AS b
"""

PROFILE_LABELS = [
    "Thin", "Light", "Regular", "Italic", "Semi Bold", "DemiBold", "semibold italic", "Bold", "Bold Italic",
    "Extra Bold", "ExtraBold", "Black", "Oblique", "Light Italic", "Medium", "Ultra Light", "Book", "Variable Font",
]

PROFILES = (
    """
SELECT package, style_label, CASE WHEN pk%2=0 THEN 'family-style' ELSE 'style' END AS scope, pk%3=0 AS strict,
  CASE WHEN pk%4=0 THEN 'kern,smcp' ELSE 'kern' END AS required_tags, CASE WHEN pk%5=0 THEN 'ttf' ELSE '' END AS source_limited,
  CAST(40*(pk%4) AS BIGINT) AS min_cmap, CAST(pk%3 AS BIGINT) AS min_features, pos%17=0 AS optional, pos
FROM (SELECT package, pk, CAST(n AS BIGINT) AS pos, CASE n """
    + " ".join(f"WHEN {i} THEN '{label}'" for i, label in enumerate(PROFILE_LABELS, 1))
    + """ END AS style_label
  FROM (SELECT package, pk, EACH("""
    + ", ".join(str(i) for i in range(1, len(PROFILE_LABELS) + 1))
    + """) AS n FROM (
    SELECT concat(p_brand, '-', CAST(CAST(FLOOR(p_partkey/1000.0) AS BIGINT) AS VARCHAR(20))) AS package, CAST(max(p_partkey) AS BIGINT) AS pk
    FROM part GROUP BY p_brand, FLOOR(p_partkey/1000.0)) AS b) AS c) AS l"""
)

DOWNLOAD_LOG = """
SELECT l_orderkey AS job_id, CAST(l_linenumber AS BIGINT) AS idx,
  concat('https://cdn.example.com/f/', CAST(l_partkey AS VARCHAR(20)), '.woff2') AS url,
  concat(replace(p_name,' ','-'), CASE WHEN p_size%9=0 THEN '-Thin' WHEN p_size%9=1 THEN '-Light' WHEN p_size%9=2 THEN '-Regular' WHEN p_size%9=5 THEN '-BoldItalic' ELSE '' END, CASE WHEN l_partkey%14=0 THEN '-Trial' ELSE '' END, CASE WHEN l_partkey%3=0 THEN '.woff2' WHEN l_partkey%3=1 THEN '.otf' ELSE '.zip' END) AS filename,
  p_name AS name, concat('https://', lower(replace(p_brand,'#','')), '.example.com/', CASE WHEN l_partkey%33=0 THEN 'trial fonts/' ELSE 'fonts/' END, CAST(l_partkey AS VARCHAR(20))) AS source_url,
  concat(p_brand, '-', CAST(CAST(FLOOR(p_partkey/1000.0) AS BIGINT) AS VARCHAR(20))) AS package,
  CASE WHEN l_partkey%8<3 THEN 'downloaded' ELSE 'skipped' END AS status,
  CASE l_partkey%8 WHEN 3 THEN 'Request gagal (403)' WHEN 4 THEN 'fetch failed' WHEN 5 THEN 'socket timeout' WHEN 6 THEN '<html>access denied' WHEN 7 THEN 'Duplicate payload hash' ELSE '' END AS reason
FROM lineitem JOIN part ON l_partkey = p_partkey
"""

CASES = """
SELECT lower(replace(s_name,'#','-')) AS id, s_name AS name, concat('https://s', CAST(s_suppkey AS VARCHAR(20)), '.example.com/fonts/') AS url,
  CAST(1+s_suppkey%3 AS BIGINT) AS min_downloaded, s_suppkey%4=0 AS soft_pass, CAST(s_suppkey AS BIGINT) AS pos FROM supplier
"""

RESULTS = """
SELECT lower(replace(s_name,'#','-')) AS id, s_name AS name, CAST(r AS BIGINT) AS seq, CAST(s_suppkey AS BIGINT) AS supp,
  CAST((s_suppkey*7+r*3)%5 AS BIGINT) AS downloaded, CAST((s_suppkey+r)%4 AS BIGINT) AS skipped,
  CASE WHEN (s_suppkey+r)%11=0 THEN 'fail' WHEN (s_suppkey+r)%3=0 THEN 'warn' ELSE 'pass' END AS validation_status,
  CASE WHEN (s_suppkey+r)%9=0 THEN NULL WHEN (s_suppkey+r)%13=0 THEN 'FAIL' WHEN (s_suppkey+r)%5=0 THEN 'warn' ELSE 'pass' END AS quality_status,
  CASE WHEN (s_suppkey+r)%6=0 THEN NULL ELSE CAST(70+(s_suppkey*3+r)%31 AS DOUBLE) END AS coverage_pct,
  CAST(CASE WHEN s_suppkey%10=0 THEN r ELSE 0 END AS BIGINT) AS invalid_fonts, CAST(CASE WHEN s_suppkey%14=0 THEN 2 ELSE 0 END AS BIGINT) AS italic_mismatches,
  CAST(CASE WHEN s_suppkey%15=0 THEN 4 ELSE 0 END AS BIGINT) AS contamination,
  CASE WHEN s_suppkey%2=0 THEN 'connection timeout' ELSE 'Request gagal (404)' END AS first_skip
FROM (SELECT s_suppkey, s_name, EACH(1, 2, 3) AS r FROM supplier) AS rs WHERE NOT (s_suppkey%9=0)
"""

JOB_EVENTS = """
SELECT user_id AS job_id, ts, event_id AS seq,
  CASE event_type WHEN 'signup' THEN 'PENDING' WHEN 'view' THEN 'RUNNING' WHEN 'purchase' THEN 'SUCCESS' WHEN 'error' THEN 'FAILED' END AS status,
  CASE WHEN event_type='click' THEN concat('line ', CAST(event_id AS VARCHAR(20))) END AS line,
  CASE WHEN event_type='purchase' THEN value END AS result_value, CASE WHEN event_type='error' THEN props END AS result_error
FROM events
"""

MEMORY = """
SELECT host, concat(kind, '|', rel, '|', signature) AS key, kind, rel, signature, max(succ) AS success_count, max(fail) AS fail_count,
  CAST(max(6*succ-4*fail) AS DOUBLE) AS score, max(upd) AS updated_at
FROM (SELECT lower(replace(replace(split_part(url,'/',3),':80',''),':443','')) AS host,
    CASE k WHEN 0 THEN 'css' WHEN 1 THEN 'js' ELSE 'manifest' END AS kind,
    CASE k WHEN 0 THEN 'stylesheet' WHEN 1 THEN 'script' ELSE 'manifest' END AS rel,
    CASE k WHEN 0 THEN '/css/site-:num.css?v=:num' WHEN 1 THEN concat('/js/runtime.js', CASE WHEN page_id%4=0 THEN '' ELSE CAST(page_id%60 AS VARCHAR(20)) END) ELSE '/site.webmanifest' END AS signature,
    CAST(page_id%5 AS BIGINT) AS succ, CAST(page_id%3 AS BIGINT) AS fail, CAST(1700000000000+page_id*1000 AS BIGINT) AS upd
  FROM (SELECT page_id, url, EACH(0, 1, 2) AS k FROM pages) AS ks) AS m
GROUP BY host, kind, rel, signature
"""

ROUTED = (
    """
SELECT page_id, CASE WHEN h.host IS NULL THEN p.url ELSE concat('https://', h.host, '/fonts/', CAST(page_id AS VARCHAR(20))) END AS url
FROM pages AS p LEFT JOIN ("""
    + " UNION ALL ".join(
        f"SELECT CAST({i} AS BIGINT) AS k, '{url.split('/')[2]}' AS host" for i, (_, url, _, _) in enumerate(fv.SUITE_CASES)
    )
    + f") AS h ON h.k = p.page_id % {len(fv.SUITE_CASES) + 4}"
)

SPARK_AGG = "listagg({x}, {sep}) WITHIN GROUP (ORDER BY {key})"
DUCK_AGG = "string_agg({x}, {sep} ORDER BY {key})"
BASE_TABLES = "part|pages|supplier|nation|region|lineitem|events"

_PLAIN = {
    "html": HTML, "products": PRODUCTS, "tree": TREE, "file_metrics": FILE_METRICS, "profiles": PROFILES,
    "download_log": DOWNLOAD_LOG, "cases": CASES, "results": RESULTS, "job_events": JOB_EVENTS,
    "memory": MEMORY, "routed": ROUTED,
}
_AGGREGATED = {"css": css, "api_json": api_json, "collections": collections}
NAMES = [*_PLAIN, *_AGGREGATED]


def fixture_sql(name: str) -> str:
    """The text the checking engine runs."""
    text = _PLAIN[name] if name in _PLAIN else _AGGREGATED[name](DUCK_AGG)
    return re.sub(r"EACH\(([^()]*)\)", r"unnest([\1])", text)


def fixture(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The derived input as a lazy DataFrame over the driver's parquet files.

    ``part`` is dealt out before its few columns become texts, and style sheets
    and pages after they are put together: one small file holds much work.
    """
    text = _PLAIN[name] if name in _PLAIN else _AGGREGATED[name](SPARK_AGG)
    text = re.sub(r"EACH\(([^()]*)\)", r"explode(array(\1))", text)
    used = set(re.findall(rf"\b(?:FROM|JOIN) ({BASE_TABLES})\b", text))
    inputs = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in used}
    if "part" in inputs:
        inputs["part"] = by_shuffle(deal_out(inputs["part"]))
    text = text.replace("{", "{{").replace("}", "}}")
    frame = spark.sql(re.sub(rf"\b(FROM|JOIN) ({BASE_TABLES})\b", r"\1 {\2}", text), **inputs)
    if name in ("html", "css"):
        frame = deal_out(frame)
    return frame if name in ("html", "tree", "memory", "routed") else by_shuffle(frame)


def with_fixtures(*names: str) -> str:
    """``WITH a AS (...), b AS (...)`` head of an oracle statement."""
    return "WITH " + ", ".join(f"{n} AS ({fixture_sql(n)})" for n in names)
