"""Queries over font faces of style sheets."""

from __future__ import annotations

from pyspark.sql import functions as F

from glyphlake import fixed_values as fv
from glyphlake.functions import styles, urls
from glyphlake.operators import documents as docs
from glyphlake.operators import faces as fc
from glyphlake.operators.picking import computed
from glyphlake.plans import sql_text as d
from glyphlake.plans.fixtures import fixture, with_fixtures
from glyphlake.plans.normalize import SUFFIX_RULES, alias_sql, css_label_sql, humanize_sql, score_sql, stem_sql, suffix_sql, weight_sql
from glyphlake.plans.pages import INLINE_CTE, RESOURCE_CTE, font_urls_cte
from glyphlake.plans.registry import query
from glyphlake.plans.urls import target_tokens_sql
from glyphlake.session import cut_lineage

C = F.col


def css_docs(spark, sf):
    """Each style sheet is its own page; URLs that say 'cold' count as preloaded."""
    base = fixture(spark, sf, "css").select(
        C("url").alias("page"), "url", F.lit("css").alias("kind"), C("css").alias("text"), F.lit(0).alias("doc_pos")
    )
    return base.withColumn("preload", F.filter(docs.font_urls(C("text"), C("url")), lambda u: F.contains(u, F.lit("cold"))))


_CSS_FONT = r"(?i)url\(\s*['\"]?([^\"')]+?\.(?:woff2|woff|otf|ttf)(?:\?[^\"')\s]+)?)['\"]?\s*\)"


def decl_sql(block: str, name: str) -> str:
    return d.space(d.ext(block, rf"(?i){name}\s*:\s*([^;]+);"))


def url_label_sql(u: str) -> str:
    return d.space(d.rep(d.rep(humanize_sql(f"coalesce({d.stem(u)}, '')"), r"(?i)\b(?:vf|var|variable)\b$"), r"(?i)\bweb\b$"))


SCORE_OF = lambda s: score_sql(f"{s}.label", f"{s}.weight", f"{s}.style")
RANK = "CASE fmt WHEN 'woff2' THEN 0 WHEN 'woff' THEN 1 WHEN 'otf' THEN 2 ELSE 3 END"

FACES_CTE = f""", {SUFFIX_RULES}, blocks AS (SELECT url AS page, generate_subscripts(x, 1) - 1 AS pos, unnest(x) AS block FROM (SELECT url, regexp_extract_all(css, '(?is)@font-face\\s*\\{{(.*?)\\}}', 1) AS x FROM css) AS q),
  rawf AS (SELECT page, pos, block, {d.strip_quotes(decl_sql('block', 'font-family'))} AS fam, coalesce(nullif({decl_sql('block', 'font-weight')}, ''), '400') AS rw, coalesce(nullif({decl_sql('block', 'font-style')}, ''), 'normal') AS rs,
     contains(block, 'U+0000-00FF') AS core FROM blocks),
  src0 AS (SELECT page, pos, generate_subscripts(x, 1) AS i, unnest(x) AS ref FROM (SELECT page, pos, regexp_extract_all(block, {d.lit(_CSS_FONT)}, 1) AS x FROM rawf WHERE fam <> '') AS q),
  src1 AS (SELECT page, pos, i, {d.resolve('ref', 'page')} AS u FROM src0),
  src2 AS (SELECT *, {d.url_format('u')} AS fmt, contains(u, 'cold') AS preload, regexp_matches(u, '(?i)variable|\\bvf\\b') AS var FROM src1 WHERE u IS NOT NULL),
  vf AS (SELECT r.page, r.pos, contains({d.token('any_value(fam)')}, 'variable') OR regexp_matches(any_value(rw), '^[0-9]+ [0-9]+$') OR bool_and(var) AS vface FROM rawf AS r JOIN src2 AS s ON s.page = r.page AND s.pos = r.pos GROUP BY r.page, r.pos),
  pick AS (SELECT s.page, s.pos, vface, u, fmt, preload, var, row_number() OVER (PARTITION BY s.page, s.pos ORDER BY CASE WHEN vface THEN NOT preload ELSE var END, {RANK}, i) AS rn FROM src2 AS s JOIN vf ON vf.page = s.page AND vf.pos = s.pos),
  f0 AS (SELECT r.page, r.pos, fam, core, u, fmt, preload, var, {humanize_sql('fam')} AS human, {url_label_sql('u')} AS ulabel, {css_label_sql('rw', 'rs', 'vface')} AS lab,
     CASE WHEN coalesce({weight_sql('rw')}, 0) <> 0 THEN regexp_replace(CAST({weight_sql('rw')} AS VARCHAR), '\\.0$', '') ELSE rw END AS wt, CASE WHEN regexp_matches(rs, '(?i)italic|oblique') THEN 'Italic' ELSE 'Normal' END AS slope
     FROM rawf AS r JOIN pick AS p ON p.page = r.page AND p.pos = r.pos AND p.rn = 1),
  f1 AS (SELECT *, {{'family': fam, 'label': lab, 'weight': wt, 'style': slope}} AS cur, {suffix_sql('f0.human')} AS h1, {suffix_sql('f0.ulabel')} AS h2, {d.token('human')} AS ct FROM f0),
  f2 AS (SELECT *, CASE WHEN h1 IS NULL THEN cur WHEN {SCORE_OF('h1')} >= {SCORE_OF('cur')} OR h1.label <> 'Regular' THEN h1 ELSE {{'family': h1.family, 'label': cur.label, 'weight': cur.weight, 'style': cur.style}} END AS c2 FROM f1),
  f3 AS (SELECT *, CASE WHEN h2 IS NOT NULL AND ct <> '' AND {d.token('h2.family')} <> '' AND (contains(ct, {d.token('h2.family')}) OR contains({d.token('h2.family')}, ct)) AND {SCORE_OF('h2')} >= {SCORE_OF('c2')} THEN h2 ELSE c2 END AS c3 FROM f2),
  faces AS (SELECT page, pos, {alias_sql('f3.c3.family', 'f3.c3.label')} AS family, c3.label AS label, c3.weight AS weight, c3.style AS style, 'font-face' AS discovery, u, fmt, preload, var, core FROM f3)"""

def flat(with_pos: bool = True) -> list:
    head = ["page", C("pos").cast("long").alias("pos")] if with_pos else ["page"]
    source = [C("source.url").alias("u"), C("source.format").alias("fmt"), C("source.preload").alias("preload"), C("source.variable").alias("var")]
    return [*head, "family", "label", "weight", "style", *source]


FLAT_SQL = "page, CAST(pos AS BIGINT) AS pos, family, label, weight, style, u, fmt, preload, var"


@query("extract_faces", with_fixtures("css") + FACES_CTE + f" SELECT {FLAT_SQL} FROM faces")
def _(spark, sf):
    return fc.extract_faces(css_docs(spark, sf)).select(*flat())


@query("pick_face_source", with_fixtures("css") + FACES_CTE + " SELECT page, CAST(pos AS BIGINT) AS pos, u, vface FROM pick WHERE rn = 1")
def _(spark, sf):
    return fc.raw_faces(css_docs(spark, sf)).select("page", C("pos").cast("long").alias("pos"), C("source.url").alias("u"), C("variable_face").alias("vface"))


INFERRED_CTE = font_urls_cte("css", "url", "css", "url") + f""", i0 AS (SELECT url AS page, asset_url AS u, {url_label_sql('asset_url')} AS lab FROM font_urls),
  i1 AS (SELECT *, {suffix_sql('i0.lab')} AS h FROM i0),
  inferred AS (SELECT page, u, coalesce(h.family, lab) AS family, coalesce(h.label, 'Regular') AS label, coalesce(h.weight, '400') AS weight, coalesce(h.style, 'Normal') AS style, {d.url_format('u')} AS fmt, contains(u, 'cold') AS preload,
     regexp_matches({d.stem('u')}, '(?i)variable|\\bvf\\b') AS var FROM i1 WHERE length({d.token('coalesce(h.family, lab)')}) >= 3)"""


@query("infer_face_from_url", with_fixtures("css") + f", {SUFFIX_RULES}" + INFERRED_CTE + " SELECT page, u, family, label, weight, style, fmt, preload, var FROM inferred")
def _(spark, sf):
    return fc.inferred_faces(css_docs(spark, sf)).select(*flat(with_pos=False))


def count_sql(text: str, needle: str) -> str:
    return f"CASE WHEN length({needle}) > 0 THEN (length({text}) - length(replace({text}, {needle}, ''))) // length({needle}) ELSE 0 END"


USAGE_CTE = f""", fams AS (SELECT DISTINCT page, family FROM faces), uses AS (SELECT f.page, family, CASE WHEN {count_sql('lower(css)', 'lower(family)')} > 0 THEN {count_sql('lower(css)', 'lower(family)')}
   WHEN length({d.token('family')}) >= 3 THEN {count_sql('lower(css)', d.token('family'))} ELSE 0 END AS usage FROM fams AS f JOIN css AS c ON c.url = f.page)"""


@query(
    "collapse_aliases",
    with_fixtures("css") + FACES_CTE + USAGE_CTE + """, r AS (SELECT f.*, row_number() OVER (PARTITION BY f.page, u, label, weight, style ORDER BY usage DESC, length(f.family) DESC, pos) AS rn FROM faces AS f JOIN uses AS s ON s.page = f.page AND s.family = f.family)
    SELECT page, CAST(pos AS BIGINT) AS pos, family, label, u FROM r WHERE rn = 1""",
)
def _(spark, sf):
    docs_ = css_docs(spark, sf)
    faces = cut_lineage(fc.extract_faces(docs_))
    out = fc.collapse_aliases(faces, fc.family_usage(faces, docs_))
    return out.select("page", C("pos").cast("long").alias("pos"), "family", "label", C("source.url").alias("u"))


@query("dedupe_first", with_fixtures("css") + FACES_CTE + " SELECT page, family, label, u, CAST(min(pos) AS BIGINT) AS pos FROM faces GROUP BY page, family, label, u")
def _(spark, sf):
    out = fc.dedupe_faces(fc.extract_faces(css_docs(spark, sf)))
    return out.select("page", "family", "label", C("source.url").alias("u"), C("pos").cast("long").alias("pos"))


@query(
    "pick_style_source",
    with_fixtures("css") + FACES_CTE + f""", r AS (SELECT *, row_number() OVER (PARTITION BY page, {d.token('family')}, {d.token('label')}, style ORDER BY {RANK}, NOT preload, var, u, pos) AS rn FROM faces) SELECT page, CAST(pos AS BIGINT) AS pos, family, label, style, u FROM r WHERE rn = 1""",
)
def _(spark, sf):
    out = fc.pick_style_source(fc.extract_faces(css_docs(spark, sf)))
    return out.select("page", C("pos").cast("long").alias("pos"), "family", "label", "style", C("source.url").alias("u"))


@query("pick_subset_seed", with_fixtures("css") + FACES_CTE + " SELECT page, family, label, style, arg_min(u, pos + CASE WHEN core THEN 0 ELSE 1000000 END) AS u FROM faces GROUP BY page, family, label, style")
def _(spark, sf):
    out = fc.pick_subset_seed(fc.extract_faces(css_docs(spark, sf)))
    return out.select("page", "family", "label", "style", C("source.url").alias("u"))


def _ranked(ranks) -> str:
    case = "CASE fmt " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in ranks.items()) + " ELSE 0 END"
    return f"SELECT page, family, label, style, var, u, row_number() OVER (PARTITION BY page, family, label, style, var ORDER BY {case} DESC, u, pos) AS rn FROM faces"


@query(
    "pick_by_format_rank",
    with_fixtures("css") + FACES_CTE + f""", w AS ({_ranked(fv.WEB_FORMAT_RANK)}), k AS ({_ranked(fv.DESKTOP_FORMAT_RANK)})
    SELECT 'web' AS dialect, page, family, label, style, var, u FROM w WHERE rn = 1 UNION ALL SELECT 'desktop', page, family, label, style, var, u FROM k WHERE rn = 1""",
)
def _(spark, sf):
    faces = cut_lineage(fc.extract_faces(css_docs(spark, sf)))
    pick = lambda ranks, name: fc.pick_by_format_rank(faces, ranks).select(
        F.lit(name).alias("dialect"), "page", "family", "label", "style", C("source.variable").alias("var"), C("source.url").alias("u")
    )
    return pick(fv.WEB_FORMAT_RANK, "web").union(pick(fv.DESKTOP_FORMAT_RANK, "desktop"))


def _display_score_sql(v: str) -> str:
    return (
        f"CASE WHEN {v} = '' THEN -1000 ELSE len(string_split({v}, ' ')) * 6 - CASE WHEN contains({v}, ' ') THEN 0 ELSE 5 END + CASE WHEN regexp_matches({v}, '[A-Z]{{2,}}') THEN 4 ELSE 0 END"
        f" + CASE WHEN regexp_matches({v}, '[A-Z][a-z]+ +[A-Z][a-z]+') THEN 2 ELSE 0 END - CASE WHEN regexp_matches({v}, '^[a-z0-9 ]+$') THEN 3 ELSE 0 END END"
    )


DISPLAY_CTE = f""", d0 AS (SELECT *, array_to_string(list_filter(regexp_split_to_array({d.stem('u')}, '[-_]+'), lambda p: p <> ''), '-') AS st, replace(label, ' ', '') AS compact FROM faces),
  d1 AS (SELECT *, {humanize_sql('family')} AS hraw, {humanize_sql("coalesce(nullif(CASE WHEN ends_with(" + d.token('st') + ", lower(compact)) AND length(st) > length(compact) THEN rtrim(st[:length(st) - length(compact)], '-_') ELSE st END, ''), '')")} AS hstem FROM d0),
  d2 AS (SELECT *, {alias_sql('d1.hraw', 'd1.label')} AS raw, {alias_sql('d1.hstem', 'd1.label')} AS stem FROM d1),
  display AS (SELECT page, pos, family, label, u, CASE WHEN {d.token('raw')} <> '' AND {d.token('raw')} = {d.token('stem')} THEN CASE WHEN NOT regexp_matches(raw, '^[a-z0-9 ]+$') AND regexp_matches(stem, '^[a-z0-9 ]+$') THEN stem ELSE raw END
     WHEN stem <> '' AND (raw = '' OR {_display_score_sql('stem')} >= {_display_score_sql('raw')}) THEN stem WHEN raw <> '' THEN raw ELSE family END AS display FROM d2)"""


@query("display_label", with_fixtures("css") + FACES_CTE + DISPLAY_CTE + " SELECT page, CAST(pos AS BIGINT) AS pos, family, label, display FROM display")
def _(spark, sf):
    faces = fc.extract_faces(css_docs(spark, sf))
    return faces.select("page", C("pos").cast("long").alias("pos"), "family", "label", styles.display_label(C("family"), C("label"), C("source.url")).alias("display"))


RANK_CTE = USAGE_CTE + f""", st AS (SELECT page, family, count(*) AS faces, count(*) FILTER (WHERE preload) AS preload FROM faces GROUP BY page, family),
  tk AS (SELECT url AS page, {target_tokens_sql('url', 'css')} AS tokens FROM css),
  sc AS (SELECT s.*, {d.token('s.family')} AS tok, greatest(0, usage - faces) AS usage, CASE WHEN len(list_filter(tokens, lambda t: contains({d.token('s.family')}, t) OR contains(t, {d.token('s.family')}))) > 0 THEN 6 ELSE 0 END AS boost
     FROM st AS s JOIN uses AS u ON u.page = s.page AND u.family = s.family JOIN tk ON tk.page = s.page),
  s2 AS (SELECT *, faces * 6 + usage * 3 + preload * 2 + boost AS score FROM sc WHERE NOT list_contains({d.words(fv.FAMILY_STOPWORDS)}, tok)),
  s3 AS (SELECT *, first_value(score) OVER w AS ts, first_value(tok) OVER w AS tt FROM s2 WINDOW w AS (PARTITION BY page ORDER BY score DESC, faces DESC, family)),
  ranks AS (SELECT page, family, faces, usage, preload, boost, score, score >= greatest(4, ts * 0.6) OR starts_with(tok, tt) OR starts_with(tt, tok) OR (contains(tok, tt) AND length(tt) >= 4) AS selected FROM s3)"""


@query("family_rank", with_fixtures("css") + FACES_CTE + RANK_CTE + " SELECT page, family, faces, faces AS declared, usage, preload, boost, score, selected FROM ranks")
def _(spark, sf):
    docs_ = css_docs(spark, sf)
    faces = cut_lineage(fc.extract_faces(docs_))
    tokens = docs_.select("page", urls.target_tokens(C("url"), C("text")).alias("tokens"))
    return fc.family_rank(faces, fc.family_usage(faces, docs_), tokens).drop("inferred")


# The style sheet queries read a table ``css`` whose URL is key and base in one;
# for the whole scan it holds every document of every page, with page and place
# in the fragment of its URL, which does not take part in resolving.
_PG, _DP = "CAST(regexp_extract(page, '~p([0-9]+)~', 1) AS BIGINT)", "CAST(regexp_extract(page, '~(-?[0-9]+)$', 1) AS BIGINT)"
_PRELOADED = "(regexp_extract(page, '~p([0-9]+)~', 1) || ' ' || u) IN (SELECT page_id || ' ' || asset_url FROM own)"
_ALL_DOCS = INLINE_CTE + """, alldocs AS (SELECT page_id, url, 'html' AS kind, html AS text, CAST(-1 AS BIGINT) AS pos FROM html UNION ALL SELECT page_id, url, kind, text, pos FROM inline_docs)""" + font_urls_cte(
    "html", "page_id", "html", "url", name="own"
) + """, css AS MATERIALIZED (SELECT url || CASE WHEN contains(url, '#') THEN '' ELSE '#' END || '~p' || page_id || '~' || pos AS url, text AS css FROM alldocs)"""
_SCAN_FACES = (FACES_CTE + INFERRED_CTE).replace("contains(u, 'cold')", _PRELOADED).replace("faces AS (", "faces AS MATERIALIZED (") + f""",
  af AS MATERIALIZED (SELECT {_PG} AS pg, {_DP} AS dp, pos, family, label, weight, style, 'font-face' AS disc, u, fmt, preload, var FROM faces
    UNION ALL SELECT pg, dp, 4294967296, family, label, weight, style, 'inferred-url', u, fmt, preload, var FROM (SELECT *, {_PG} AS pg, {_DP} AS dp, row_number() OVER (PARTITION BY {_PG}, u ORDER BY {_DP}) AS rn FROM inferred) WHERE rn = 1)"""
_SCAN_SHOWN = DISPLAY_CTE.replace("FROM faces)", "FROM (SELECT DISTINCT 0 AS page, 0 AS pos, family, label, u FROM af))").replace("display AS (", "display AS MATERIALIZED (") + f""",
  names AS (SELECT pg, family FROM af UNION SELECT pg, display FROM af JOIN display USING (family, label, u)),
  said AS (SELECT pg, family, sum({count_sql('lower(text)', 'lower(family)')}) AS n, sum(CASE WHEN length({d.token('family')}) >= 3 THEN {count_sql('lower(text)', d.token('family'))} ELSE 0 END) AS t FROM names JOIN alldocs ON page_id = pg GROUP BY pg, family),
  used AS MATERIALIZED (SELECT pg, family, CASE WHEN n > 0 THEN n ELSE t END AS usage FROM said),
  c1 AS (SELECT af.*, row_number() OVER (PARTITION BY pg, u, label, weight, style ORDER BY usage DESC, disc <> 'font-face', length(family) DESC, dp, pos) AS rn FROM af JOIN used USING (pg, family)),
  c2 AS (SELECT * EXCLUDE (rn), row_number() OVER (PARTITION BY pg, family, label, u ORDER BY dp, pos) AS rn FROM c1 WHERE rn = 1),
  c3 AS (SELECT c2.* EXCLUDE (rn), display AS shown FROM c2 JOIN display USING (family, label, u) WHERE rn = 1),
  c4 AS (SELECT *, row_number() OVER (PARTITION BY pg, shown, label, u ORDER BY dp, pos) AS rn FROM c3),
  c5 AS (SELECT * EXCLUDE (rn), row_number() OVER (PARTITION BY pg, {d.token('shown')}, {d.token('label')}, style ORDER BY {RANK}, NOT preload, disc <> 'font-face', var, u, dp, pos) AS rn FROM c4 WHERE rn = 1),
  kept AS MATERIALIZED (SELECT pg, shown AS family, label, weight, style, disc, u, fmt, preload FROM c5 WHERE rn = 1 AND length({d.token('shown')}) >= 3),
  stats AS (SELECT pg, family, count(*) AS faces, count(*) FILTER (WHERE disc = 'font-face') AS declared, count(*) FILTER (WHERE disc <> 'font-face') AS inferred, count(*) FILTER (WHERE preload) AS preload FROM kept GROUP BY pg, family),
  wanted AS MATERIALIZED (SELECT page_id AS pg, {target_tokens_sql('url', 'html')} AS tokens FROM html),
  points AS (SELECT s.pg, s.family, s.faces, {d.token('s.family')} AS tok, s.declared * 6 + s.inferred * 2 + greatest(0, usage - s.faces) * 3 + s.preload * 2 + CASE WHEN len(list_filter(tokens, lambda t: contains({d.token('s.family')}, t) OR contains(t, {d.token('s.family')}))) > 0 THEN 6 ELSE 0 END AS score
    FROM stats AS s JOIN used AS x ON x.pg = s.pg AND x.family = s.family JOIN wanted AS w ON w.pg = s.pg),
  tops AS (SELECT *, first_value(score) OVER w AS ts, first_value(tok) OVER w AS tt FROM points WHERE NOT list_contains({d.words(fv.FAMILY_STOPWORDS)}, tok) WINDOW w AS (PARTITION BY pg ORDER BY score DESC, faces DESC, family)),
  chosen AS (SELECT pg, family, score FROM tops WHERE score >= greatest(4, ts * 0.6) OR starts_with(tok, tt) OR starts_with(tt, tok) OR (contains(tok, tt) AND length(tt) >= 4)),
  scan AS MATERIALIZED (SELECT pg AS page, family, label, weight, style, disc AS discovery, u AS asset_url, fmt AS format, CASE WHEN {stem_sql('family')} <> '' AND {stem_sql('label')} <> '' THEN {stem_sql('family')} || '-' || {stem_sql('label')} END AS file_name_hint, CAST(score AS BIGINT) AS score FROM kept JOIN chosen USING (pg, family))"""
SCAN_CTE = _ALL_DOCS + _SCAN_FACES + _SCAN_SHOWN


def scanned(spark, sf, *keep):
    """All that a scan needs of each page, read in the page's row; the documents by their kinds.
    ``keep`` names more to carry on: url, tags (that may name resources)."""
    pages = fixture(spark, sf, "html")
    told = computed(
        pages, preload=docs.font_urls(C("html"), C("url")), documents=docs.page_documents(C("html"), C("url")), tokens=urls.target_tokens(C("url"), C("html")),
        **({"tags": docs.resource_tags(C("html"))} if "tags" in keep else {}),
    ).withColumn("kinds", F.transform("documents", lambda d: F.struct(d["kind"].alias("kind"))))
    return cut_lineage(fc.in_page_rows(told.withColumnRenamed("page_id", "page"), ("tokens", "kinds", *keep)))


@query("scan_pages", with_fixtures("html") + SCAN_CTE + " SELECT * FROM scan")
def _(spark, sf):
    rows = scanned(spark, sf)
    out = fc.scan_pages(rows, rows.select("page", "tokens"))
    return out.select("page", "family", "label", "weight", "style", "discovery", C("source.url").alias("asset_url"), C("source.format").alias("format"), "file_name_hint", C("score").cast("long").alias("score"))


@query(
    "scan_summary",
    with_fixtures("html") + SCAN_CTE + RESOURCE_CTE.split(",\n  toks AS")[0] + f""", probed AS (SELECT page_id, count(DISTINCT url) AS candidates, count(DISTINCT url) FILTER (WHERE kind = 'css') AS css_links FROM cand GROUP BY page_id)
    SELECT h.page_id AS page, (SELECT count(*) FROM alldocs AS a WHERE a.page_id = h.page_id AND a.kind <> 'html') AS documents, (SELECT string_agg(kind, ',' ORDER BY pos) FROM alldocs AS a WHERE a.page_id = h.page_id) AS sources,
      coalesce(p.candidates, 0) AS candidates, coalesce(p.css_links, 0) AS css_links, (SELECT count(DISTINCT family) FROM af WHERE af.pg = h.page_id) AS families_found, (SELECT count(DISTINCT family) FROM scan AS s WHERE s.page = h.page_id) AS families_selected,
      (SELECT count(DISTINCT nullif({d.host("asset_url")}, '')) FROM scan AS s WHERE s.page = h.page_id) AS asset_hosts, (SELECT count(*) FROM scan AS s WHERE s.page = h.page_id) AS faces_selected FROM html AS h LEFT JOIN probed AS p ON p.page_id = h.page_id""",
)
def _(spark, sf):
    rows = scanned(spark, sf, "url", "tags")
    candidates = docs.best_resources(docs.score_resources(docs.tag_candidates(rows.withColumnRenamed("page", "page_id"))))
    whole = rows.select("page", C("kinds").alias("documents"))
    return fc.scan_summary(whole, fc.page_faces(rows), fc.scan_pages(rows, rows.select("page", "tokens")), candidates)
