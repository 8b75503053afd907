"""Queries over catalogue dumps, products, collections and folder trees."""

from __future__ import annotations

from pyspark.sql import functions as F

from glyphlake import fixed_values as fv
from glyphlake.functions import styles as st
from glyphlake.functions import urls
from glyphlake.functions.text import normalize_token
from glyphlake.operators import faces as fc
from glyphlake.operators import products as pr
from glyphlake.operators.relevance import document_relevance
from glyphlake.operators.tree import directory_rollup, tree_listing
from glyphlake.plans import sql_text as d
from glyphlake.plans.faces import FACES_CTE
from glyphlake.plans.fixtures import fixture, with_fixtures
from glyphlake.plans.registry import query, table
from glyphlake.session import by_shuffle
from glyphlake.sources import catalog_dumps as dumps

C = F.col
_API_BASE = "https://api.example.com/v1/list"


@query(
    "read_api_items",
    with_fixtures("api_json") + f""", j AS (SELECT doc_id, json_extract(CAST(payload AS JSON), '$.data.fonts') AS items FROM api_json),
    arr AS (SELECT doc_id, CAST(NULL AS VARCHAR) AS item_key, unnest(CAST(items AS JSON[])) AS item FROM j WHERE json_type(items) = 'ARRAY'),
    ks AS (SELECT doc_id, items, unnest(json_keys(items)) AS item_key FROM j WHERE json_type(items) = 'OBJECT'),
    allitems AS (SELECT * FROM arr UNION ALL SELECT doc_id, item_key, json_extract(items, '$."' || item_key || '"') FROM ks),
    u AS (SELECT doc_id, item_key, {d.resolve("CASE WHEN json_type(item) = 'VARCHAR' THEN item->>'$' ELSE coalesce(item->>'$.url', item->>'$.woff2.href', item->>'$.font_file.url') END", d.lit(_API_BASE))} AS source_url,
       CASE WHEN json_type(item) = 'VARCHAR' THEN NULL ELSE item->>'$.family_name' END AS given, upper(CASE WHEN json_type(item) = 'VARCHAR' THEN NULL ELSE item->>'$.license_type' END) AS lic FROM allitems)
    SELECT doc_id, item_key, source_url, coalesce(given, {d.rep(d.rep("string_split(" + d.path('source_url') + ", '/')[-1]", '[.][^.]*$'), '[-_]+', ' ')}) AS name, lic AS license_id, CASE WHEN lic IS NULL THEN 'unknown' WHEN lic = 'OFL-1.1' THEN 'open' ELSE 'restricted' END AS license_class,
      CASE WHEN source_url IS NULL THEN 'Font URL not found' END AS reason FROM u""",
)
def _(spark, sf):
    out = dumps.read_api_items(fixture(spark, sf, "api_json"), "data.fonts", "url", "family_name", "license_type", F.lit(_API_BASE))
    return out.drop("idx")


PRODUCTS_CTE = """, pj AS (SELECT p_partkey, CAST(payload AS JSON) AS j FROM products)"""


@query("extract_products", with_fixtures("products") + PRODUCTS_CTE + " SELECT CAST(j->>'$.id' AS BIGINT) AS id, j->>'$.handle' AS handle, j->>'$.title' AS title, j->>'$.vendor' AS vendor, j->>'$.product_type' AS product_type, array_to_string(CAST(json_extract(j, '$.tags') AS VARCHAR[]), ',') AS tags FROM pj")
def _(spark, sf):
    p = dumps.read_products(fixture(spark, sf, "products"))
    return p.select("product.id", "product.handle", "product.title", "product.vendor", "product.product_type", F.array_join("product.tags", ",").alias("tags"))


@query(
    "extract_variants",
    with_fixtures("products") + PRODUCTS_CTE + """, v AS (SELECT CAST(j->>'$.id' AS BIGINT) AS product_id, unnest(CAST(json_extract(j, '$.variants') AS JSON[])) AS v FROM pj)
    SELECT product_id, CAST(v->>'$.id' AS BIGINT) AS variant_id, v->>'$.option1' AS option1, v->>'$.option2' AS option2, v->>'$.option3' AS option3, CAST(v->>'$.price' AS DOUBLE) AS price, CAST(v->>'$.available' AS BOOLEAN) AS available FROM v WHERE v->>'$.id' IS NOT NULL""",
)
def _(spark, sf):
    v = dumps.product_variants(dumps.read_products(fixture(spark, sf, "products")))
    return v.select("product_id", "variant_id", "option1", "option2", "option3", "price", "available")


IS_FONT_SQL = f"""NOT regexp_matches(lower(j->>'$.handle'), {d.lit(fv.NOISE_HANDLE)}) AND (contains({d.token("j->>'$.product_type'")}, 'font') OR contains({d.token("array_to_string(CAST(json_extract(j, '$.tags') AS VARCHAR[]), ' ')")}, 'font')
   OR len(list_filter(CAST(json_extract(j, '$.options[*].name') AS VARCHAR[]), lambda o: regexp_matches({d.token('o')}, 'fontlicense|fontweight|fontstyle'))) > 0)"""


@query("is_font_product", with_fixtures("products") + PRODUCTS_CTE + f" SELECT p_partkey, {IS_FONT_SQL} AS is_font FROM pj")
def _(spark, sf):
    p = dumps.read_products(fixture(spark, sf, "products"))
    return p.select("p_partkey", pr.is_font_product(C("product")).alias("is_font"))


@query(
    "flatten_collections",
    with_fixtures("collections") + """, cj AS (SELECT doc_id, CAST(payload AS JSON) AS j FROM collections), m AS (SELECT doc_id, 0 AS member, j->>'$.name' AS family, false AS is_child, json_extract(j, '$.fontStyles') AS fs FROM cj
      UNION ALL SELECT doc_id, i, coalesce(nullif(trim(c->>'$.name'), ''), root), true, json_extract(c, '$.fontStyles') FROM (SELECT doc_id, j->>'$.name' AS root, generate_subscripts(CAST(json_extract(j, '$.children') AS JSON[]), 1) AS i, unnest(CAST(json_extract(j, '$.children') AS JSON[])) AS c FROM cj) AS q),
    s AS (SELECT doc_id, member, family, is_child, generate_subscripts(CAST(fs AS JSON[]), 1) AS pos, unnest(CAST(fs AS JSON[])) AS style FROM m),
    u AS (SELECT *, coalesce(list_filter(CAST(json_extract(style, '$.webfontSources') AS JSON[]), lambda x: x->>'$.format' = 'woff2')[1], list_filter(CAST(json_extract(style, '$.webfontSources') AS JSON[]), lambda x: x->>'$.format' = 'woff')[1]) AS src FROM s)
    SELECT doc_id, family, is_child, style->>'$.name' AS style_name, src->>'$.url' AS url, src->>'$.format' AS format FROM u""",
)
def _(spark, sf):
    out = dumps.flatten_collections(fixture(spark, sf, "collections"))
    return out.select("doc_id", "family", "is_child", "style_name", "url", "format")


@query("count_tree_styles", with_fixtures("collections") + """ SELECT doc_id, CAST((length(payload) - length(replace(payload, '"webfontSources"', ''))) // length('"webfontSources"') AS BIGINT) AS styles FROM collections""")
def _(spark, sf):
    return dumps.count_tree_styles(fixture(spark, sf, "collections"))


def axis_rows(spark, sf):
    """(owner, axis, label, pos): an axis named per part, in mixed case; brands
    that end in 3 have an optical size instead of a weight."""
    k = C("p_partkey")
    weight = F.when(C("p_brand").endswith("3"), "opsz").otherwise("wght")
    return table(spark, sf, "part").select(
        C("p_brand").alias("owner"),
        F.when(k % 4 == 0, weight).when(k % 4 == 1, "WDTH").when(k % 4 == 2, "slnt").otherwise("Wdth").alias("axis"),
        F.when(k % 3 == 0, "").otherwise(F.concat(F.lit("Axis "), (k % 5).cast("string"))).alias("label"),
        k.alias("pos"),
    )


@query(
    "variable_axes",
    """WITH a AS (SELECT p_brand AS owner, CASE p_partkey%4 WHEN 0 THEN CASE WHEN ends_with(p_brand, '3') THEN 'opsz' ELSE 'wght' END WHEN 1 THEN 'WDTH' WHEN 2 THEN 'slnt' ELSE 'Wdth' END AS axis, CASE WHEN p_partkey%3=0 THEN NULL ELSE 'Axis ' || p_partkey%5 END AS label, p_partkey AS pos FROM part)
    SELECT owner, lower(axis) AS tag, arg_min(axis, pos) AS axis, arg_min(label, pos) FILTER (WHERE label IS NOT NULL) AS label, CASE WHEN lower(axis) = 'wght' THEN '100 900' END AS weight_range FROM a GROUP BY owner, lower(axis)""",
)
def _(spark, sf):
    return pr.merge_axes(axis_rows(spark, sf)).drop("pos")


@query(
    "merge_catalogs",
    """WITH s AS (SELECT p_partkey AS id, p_brand AS item, p_name AS face, ['basic', lower(p_type)] AS sets, CASE WHEN p_size%3=0 THEN p_size%2=0 END AS hidden FROM part WHERE p_partkey%3<>0),
    v AS (SELECT p_partkey AS id, CASE WHEN p_size%2=0 THEN p_name END AS item, p_name || ' VF' AS face, ['kern', 'liga'] AS feats, [lower(p_type), 'plus'] AS sets, CASE WHEN p_size%4=0 THEN true END AS hidden FROM part WHERE p_partkey%2=0 OR p_partkey%3=0)
    SELECT coalesce(s.id, v.id) AS asset_id, coalesce(v.item, s.item) AS item_name, coalesce(v.face, s.face) AS face_name, array_to_string(coalesce(feats, []), ',') AS feature_tags, array_to_string(list_sort(list_distinct(list_concat(coalesce(s.sets, []), coalesce(v.sets, [])))), ',') AS set_tags,
      coalesce(v.hidden, s.hidden) AS hidden, CASE WHEN s.id IS NULL THEN 'variable-list' WHEN v.id IS NULL THEN 'static-list' ELSE 'merged' END AS source FROM s FULL JOIN v ON s.id = v.id""",
)
def _(spark, sf):
    part, size = table(spark, sf, "part"), C("p_size")
    none = F.array().cast("array<string>")
    static = part.filter("p_partkey%3<>0").select(
        C("p_partkey").alias("asset_id"), C("p_brand").alias("item_name"), C("p_name").alias("face_name"), none.alias("feature_tags"),
        F.array(F.lit("basic"), F.lower("p_type")).alias("set_tags"), F.when(size % 3 == 0, size % 2 == 0).alias("hidden"),
    )
    variable = part.filter("p_partkey%2=0 OR p_partkey%3=0").select(
        C("p_partkey").alias("asset_id"), F.when(size % 2 == 0, C("p_name")).alias("item_name"), F.concat("p_name", F.lit(" VF")).alias("face_name"),
        F.array(F.lit("kern"), F.lit("liga")).alias("feature_tags"), F.array(F.lower("p_type"), F.lit("plus")).alias("set_tags"), F.when(size % 4 == 0, True).alias("hidden"),
    )
    out = pr.merge_catalogs(static, variable)
    return out.withColumn("feature_tags", F.array_join("feature_tags", ",")).withColumn("set_tags", F.array_join(F.array_sort("set_tags"), ","))


@query(
    "resolve_scope",
    with_fixtures("products") + PRODUCTS_CTE + f""", cat AS (SELECT p_partkey AS id, j->>'$.handle' AS handle, {d.token("j->>'$.handle'")} AS tok, {d.token("(j->>'$.handle') || ' ' || (j->>'$.vendor') || ' ' || array_to_string(CAST(json_extract(j, '$.tags') AS VARCHAR[]), ' ')")} AS search, {IS_FONT_SQL} AS is_font FROM pj),
    rq AS (SELECT p_partkey AS request_id, CASE p_partkey%4 WHEN 0 THEN 'product' WHEN 1 THEN 'product' WHEN 2 THEN 'collection' ELSE 'unknown' END AS kind,
      CASE p_partkey%4 WHEN 0 THEN replace(p_name, ' ', '-') || '-' || p_partkey WHEN 1 THEN replace(p_name, ' ', '_') || '_' || p_partkey WHEN 2 THEN CASE WHEN p_partkey%40=2 THEN split_part(p_name, ' ', 1) || ' ' || p_partkey%10 ELSE 'zz' || p_partkey END ELSE 'none-' || p_partkey END AS handle FROM part),
    r2 AS (SELECT *, {d.token('handle')} AS tok FROM rq)
    SELECT r.request_id, coalesce(e.id, f.id) AS product_id, CASE WHEN e.id IS NOT NULL THEN CASE kind WHEN 'product' THEN 'product-exact' ELSE 'unknown-token-handle' END WHEN f.id IS NOT NULL THEN CASE kind WHEN 'product' THEN 'product-fuzzy' ELSE 'unknown-token-fuzzy' END WHEN kind = 'product' THEN 'product-not-found' ELSE 'scope-unsupported' END AS reason
      FROM r2 AS r LEFT JOIN (SELECT handle, max(id) AS id FROM cat GROUP BY handle) AS e ON e.handle = r.handle LEFT JOIN (SELECT tok, min(id) AS id FROM cat GROUP BY tok) AS f ON f.tok = r.tok WHERE kind <> 'collection'
    UNION ALL SELECT r.request_id, c.id, 'collection-heuristic' FROM r2 AS r JOIN cat AS c ON c.is_font AND contains(c.search, r.tok) WHERE kind = 'collection' AND r.tok <> ''""",
)
def _(spark, sf):
    k, name = C("p_partkey"), C("p_name")
    part = table(spark, sf, "part")
    requests = part.select(
        k.alias("request_id"),
        F.when(k % 4 < 2, "product").when(k % 4 == 2, "collection").otherwise("unknown").alias("kind"),
        F.when(k % 4 == 0, F.concat(F.replace(name, F.lit(" "), F.lit("-")), F.lit("-"), k.cast("string")))
        .when(k % 4 == 1, F.concat(F.replace(name, F.lit(" "), F.lit("_")), F.lit("_"), k.cast("string")))
        .when((k % 4 == 2) & (k % 40 == 2), F.concat(F.substring_index(name, " ", 1), F.lit(" "), (k % 10).cast("string")))
        .when(k % 4 == 2, F.concat(F.lit("zz"), k.cast("string")))
        .otherwise(F.concat(F.lit("none-"), k.cast("string"))).alias("handle"),
    )
    p = dumps.read_products(fixture(spark, sf, "products"))
    catalog = p.select(
        C("p_partkey").alias("product_id"), C("product.handle").alias("handle"),
        F.concat_ws(" ", "product.handle", "product.vendor", F.array_join("product.tags", " ")).alias("search"),
        pr.is_font_product(C("product")).alias("is_font"), C("p_partkey").alias("pos"),
    )
    return pr.resolve_scope(requests, catalog)


@query(
    "pick_largest_group",
    """WITH f AS (SELECT replace(p_name, ' ', '-') || '-' || p_size AS font_slug, CASE WHEN p_partkey%2=0 THEN split_part(p_name, ' ', 2) ELSE lower(p_brand) END AS fam, p_partkey AS pos FROM part), sz AS (SELECT fam, count(*) AS n FROM f GROUP BY fam), own AS (SELECT font_slug AS slug, arg_min(fam, pos) AS fam FROM f GROUP BY font_slug),
    rq AS (SELECT font_slug AS slug FROM f UNION SELECT fam FROM f UNION SELECT split_part(p_name, ' ', 1) FROM part),
    c AS (SELECT r.slug, o.fam, n * 10 + 2 AS score FROM rq AS r JOIN own AS o ON o.slug = r.slug JOIN sz ON sz.fam = o.fam UNION ALL SELECT r.slug, r.slug, n * 10 + 1 FROM rq AS r JOIN sz ON sz.fam = r.slug)
    SELECT r.slug, arg_max(c.fam, c.score) AS family_slug, max(c.score) AS score FROM rq AS r LEFT JOIN c ON c.slug = r.slug GROUP BY r.slug""",
)
def _(spark, sf):
    k, name = C("p_partkey"), C("p_name")
    fonts = table(spark, sf, "part").select(
        F.concat(F.replace(name, F.lit(" "), F.lit("-")), F.lit("-"), C("p_size").cast("string")).alias("font_slug"),
        F.when(k % 2 == 0, F.substring_index(name, " ", -1)).otherwise(F.lower("p_brand")).alias("family_slug"), k.alias("pos"), F.substring_index(name, " ", 1).alias("first"),
    )
    requests = fonts.select(C("font_slug").alias("slug")).union(fonts.select("family_slug")).union(fonts.select("first")).distinct()
    return pr.pick_largest_group(requests, fonts.drop("first"))


_VALUE = lambda x: f"CASE WHEN {x} <> '' AND NOT regexp_matches({x}, {d.lit(fv.AXIS_LABEL)}) AND NOT regexp_matches({x}, {d.lit(fv.BUNDLE_LABEL)}) THEN {x} END"
EXPECTED_CTE = PRODUCTS_CTE + f""", px AS (SELECT p_partkey AS product_id, j->>'$.title' AS title, p_partkey%2=0 AS licensed, p_partkey%3=0 AS style2, generate_subscripts(CAST(json_extract(j, '$.variants') AS JSON[]), 1) AS pos, unnest(CAST(json_extract(j, '$.variants') AS JSON[])) AS v FROM pj),
  pv AS (SELECT *, {_VALUE("(v->>'$.option2')")} AS w0, {_VALUE("(v->>'$.option3')")} AS s0 FROM px WHERE v->>'$.id' IS NOT NULL),
  pw AS (SELECT *, CASE WHEN regexp_matches(s0, {d.lit(fv.WEIGHT_WORDS)}) AND NOT regexp_matches(w0, {d.lit(fv.WEIGHT_WORDS)}) THEN w0 ELSE s0 END AS s, CASE WHEN regexp_matches(s0, {d.lit(fv.WEIGHT_WORDS)}) AND NOT regexp_matches(w0, {d.lit(fv.WEIGHT_WORDS)}) THEN s0 ELSE w0 END AS w FROM pv),
  pm AS (SELECT product_id, title, licensed, pos, v->>'$.option1' AS lic, w0, CASE WHEN s IS NULL OR w IS NULL THEN coalesce(s, w) WHEN regexp_matches(lower(w), '^regular( (italic|oblique|slanted))?$') THEN s || ' Regular' WHEN contains({d.token('s')}, {d.token('w')}) THEN s ELSE s || ' ' || w END AS style FROM pw),
  po AS (SELECT product_id, count(DISTINCT w0) = 1 AND bool_or(lower(w0) = 'regular') AS only_regular FROM pm GROUP BY product_id),
  pd AS (SELECT m.product_id, title, CASE WHEN only_regular THEN regexp_replace(style, '(?i) regular$', '') ELSE style END AS style, min(pos) AS pos FROM pm AS m JOIN po ON po.product_id = m.product_id WHERE style IS NOT NULL GROUP BY 1, 2, 3),
  pstyles AS (SELECT product_id, title, string_agg(style, ',' ORDER BY pos) AS styles FROM pd GROUP BY product_id, title)"""


@query("expected_styles", with_fixtures("products") + EXPECTED_CTE + """ SELECT s.product_id, styles, CASE WHEN bool_or(licensed) THEN 'Desktop,Web,App' ELSE string_agg(DISTINCT lic, ',' ORDER BY lic) END AS licenses FROM pstyles AS s JOIN pm ON pm.product_id = s.product_id GROUP BY s.product_id, styles""")
def _(spark, sf):
    out = pr.expected_styles(dumps.read_products(fixture(spark, sf, "products")))
    by_option = C("product_id") % 2 == 0
    return out.select("product_id", F.array_join("styles", ",").alias("styles"), F.array_join(F.when(by_option, C("licenses")).otherwise(F.array_sort("licenses")), ",").alias("licenses"))


@query("build_profiles", with_fixtures("products") + EXPECTED_CTE + """ SELECT 'product-' || product_id AS package, CAST(row_number() OVER (PARTITION BY product_id ORDER BY pos) - 1 AS BIGINT) AS pos, title || ' ' || style AS style_label, 'family-style' AS scope, true AS strict FROM pd""")
def _(spark, sf):
    return pr.build_profiles(pr.expected_styles(dumps.read_products(fixture(spark, sf, "products"))))


def variant_rows(spark, sf):
    v = dumps.product_variants(dumps.read_products(fixture(spark, sf, "products")))
    return v.select(
        "product_id", C("option2").alias("label"), (C("pos") + C("product_id") * 10).alias("pos"), (C("option3") == "Italic").alias("italic"),
        st.weight_value(F.when(C("option2") == "Bold", "700").otherwise("400")).alias("weight"), "variant_id", "handle", "option1",
    )


_VARIANTS_CTE = PRODUCTS_CTE + """, vr AS (SELECT p_partkey AS product_id, pos - 1 + p_partkey * 10 AS pos, v->>'$.option1' AS option1, v->>'$.option2' AS label, v->>'$.option3' = 'Italic' AS italic, CASE WHEN v->>'$.option2' = 'Bold' THEN 700.0 ELSE 400.0 END AS weight, CAST(v->>'$.id' AS BIGINT) AS variant_id, j->>'$.title' AS title
   FROM (SELECT p_partkey, j, generate_subscripts(CAST(json_extract(j, '$.variants') AS JSON[]), 1) AS pos, unnest(CAST(json_extract(j, '$.variants') AS JSON[])) AS v FROM pj) AS q WHERE v->>'$.id' IS NOT NULL)"""


@query(
    "style_map",
    with_fixtures("products") + _VARIANTS_CTE + f""", x AS (SELECT title AS grp, label, pos, italic, weight FROM vr) SELECT grp AS product_id, {d.token('label')} AS token, arg_min(label, pos) AS style_name, CASE WHEN bool_and(italic) THEN 'Italic' ELSE 'Normal' END AS style, CAST(min(weight) AS DOUBLE) AS weight_min, CAST(max(weight) AS DOUBLE) AS weight_max, count(*) AS variants FROM x GROUP BY grp, {d.token('label')}""",
)
def _(spark, sf):
    titles = dumps.read_products(fixture(spark, sf, "products")).select("p_partkey", C("product.title").alias("title"))
    rows = variant_rows(spark, sf).join(titles.withColumnRenamed("p_partkey", "product_id"), "product_id")
    return pr.style_map(rows.withColumn("product_id", C("title")))


@query(
    "group_by_asset_url",
    with_fixtures("products") + _VARIANTS_CTE + """, e AS (SELECT 'https://cdn.example.com/' || replace(title, ' ', '-') || '-' || lower(option1) || '.woff2' AS url, title AS family, label AS style_title, italic, false AS variable, pos FROM vr), o AS (SELECT url, style_title, min(pos) AS pos, arg_min(italic, pos) AS italic, arg_min(family, pos) AS family FROM e GROUP BY url, style_title)
    SELECT url, arg_min(family, pos) AS family, string_agg(style_title, ',' ORDER BY pos) AS styles, bool_and(italic) AS is_italic, count(*) > 1 AS is_variable FROM o GROUP BY url""",
)
def _(spark, sf):
    titles = dumps.read_products(fixture(spark, sf, "products")).select(C("p_partkey").alias("product_id"), C("product.title").alias("family"))
    entries = variant_rows(spark, sf).join(titles, "product_id").select(
        F.concat(F.lit("https://cdn.example.com/"), F.replace("family", F.lit(" "), F.lit("-")), F.lit("-"), F.lower("option1"), F.lit(".woff2")).alias("url"),
        "family", C("label").alias("style_title"), F.lit(False).alias("is_variable"), C("italic").alias("is_italic"), "pos",
    )
    return pr.group_by_asset_url(entries).withColumn("styles", F.array_join("styles", ","))


_EXTS = ["otf", "woff2", "woff", "zip", "ttf"]


@query(
    "best_preview_by_style",
    with_fixtures("products") + _VARIANTS_CTE + f""", a AS (SELECT title AS product_id, label AS style, {d.words(_EXTS)}[variant_id % 5 + 1] AS ext, pos, variant_id FROM vr), k AS (SELECT *, {d.token('style')} AS token, CASE ext WHEN 'otf' THEN 4 WHEN 'ttf' THEN 4 WHEN 'woff2' THEN 3 ELSE 2 END AS pri FROM a WHERE ext <> 'zip'),
    x AS (SELECT DISTINCT title AS product_id, 'bold' AS token FROM vr WHERE contains(title, 'ring')), f AS (SELECT * FROM k WHERE product_id NOT IN (SELECT product_id FROM x) OR token = 'bold')
    SELECT product_id, token, variant_id, ext FROM (SELECT *, row_number() OVER (PARTITION BY product_id, token ORDER BY pri DESC, pos) AS rn FROM f) AS q WHERE rn = 1""",
)
def _(spark, sf):
    titles = dumps.read_products(fixture(spark, sf, "products")).select(C("p_partkey").alias("product_id"), C("product.title").alias("title"))
    rows = variant_rows(spark, sf).join(titles, "product_id")
    assets = rows.select(
        C("title").alias("product_id"), C("label").alias("style"), F.get(F.array(*[F.lit(e) for e in _EXTS]), (C("variant_id") % 5).cast("int")).alias("ext"), "pos", "variant_id"
    )
    expected = titles.filter(F.contains("title", F.lit("ring"))).select(C("title").alias("product_id"), F.lit("bold").alias("token"))
    return pr.best_preview_by_style(assets, expected).select("product_id", "token", "variant_id", "ext")


@query(
    "merge_style_maps",
    """WITH r AS (SELECT p_brand AS family, CASE WHEN p_partkey%9=0 THEN '' ELSE replace(p_name, ' ', '-') || '.woff2' END AS font_file, p_name || ' ' || p_size AS style_name, p_partkey AS pos FROM part)
    SELECT family, font_file, arg_min(style_name, pos) AS style_name FROM r WHERE font_file <> '' GROUP BY family, font_file""",
)
def _(spark, sf):
    k = C("p_partkey")
    rows = table(spark, sf, "part").select(
        C("p_brand").alias("family"), F.when(k % 9 == 0, "").otherwise(F.concat(F.replace("p_name", F.lit(" "), F.lit("-")), F.lit(".woff2"))).alias("font_file"),
        F.concat_ws(" ", "p_name", C("p_size").cast("string")).alias("style_name"), k.alias("pos"),
    )
    return pr.merge_style_maps(rows).select("family", "font_file", "style_name")


@query(
    "pick_top_scoring",
    with_fixtures("collections") + """, w AS (SELECT n_name, 'nation' || n_regionkey AS w1, right(n_name, 1) AS w2 FROM nation),
    c AS (SELECT s_suppkey, s_name, n_regionkey AS grp, n_nationkey FROM supplier JOIN nation ON s_nationkey = n_nationkey),
    s AS (SELECT s_suppkey, grp, CASE WHEN contains(t, w1) THEN 2 ELSE 0 END + CASE WHEN contains(t, w2) THEN 2 ELSE 0 END + CASE WHEN contains(t, w1) AND contains(t, w2) THEN 4 ELSE 0 END AS score FROM (SELECT s_suppkey, grp, regexp_replace(lower(s_name), '[^a-z0-9]+', '', 'g') AS t, CAST(grp * 11 AS VARCHAR) AS w1, CAST(grp + 4 AS VARCHAR) AS w2 FROM c) AS q),
    m AS (SELECT *, max(score) OVER (PARTITION BY grp) AS best FROM s) SELECT s_suppkey, grp, score, best <= 0 OR score = best AS strict_pick FROM m WHERE best <= 0 OR (score > 0 AND score >= CASE WHEN best >= 4 THEN best - 1 ELSE best END)""",
)
def _(spark, sf):
    nation = table(spark, sf, "nation")
    rows = table(spark, sf, "supplier").join(nation, C("s_nationkey") == C("n_nationkey")).select("s_suppkey", "s_name", C("n_regionkey").alias("grp"))
    words = F.array((C("grp") * 11).cast("string"), (C("grp") + 4).cast("string"))
    scored = rows.withColumn("score", pr.word_score(C("s_name"), words, 4))
    loose = pr.pick_top_scoring(scored, "grp", "score", slack=True)
    strict = pr.pick_top_scoring(scored, "grp", "score").select("s_suppkey", F.lit(True).alias("strict_pick"))
    return loose.join(strict, "s_suppkey", "left").select("s_suppkey", "grp", "score", F.coalesce("strict_pick", F.lit(False)).alias("strict_pick"))


_FAMILY_SQL = f"""fam AS (SELECT p_partkey AS family_id, replace(p_name, ' ', '-') || CASE WHEN p_size%3=0 THEN '' ELSE '-' || p_size END AS ref, CASE WHEN p_size%2=0 THEN [split_part(p_name, ' ', 2), 'x' || p_partkey] ELSE [] END AS aliases, p_name || CASE WHEN p_size%5=0 THEN ' ' || p_type ELSE '' END AS name, p_partkey AS pos FROM part),
  rq AS (SELECT doc_id AS request_id, split_part(p_name, ' ', 1) || '-' || split_part(p_name, ' ', 2) || CASE WHEN doc_id%3=0 THEN '-mono' ELSE '' END AS slug, CASE WHEN doc_id%4=0 THEN '' WHEN doc_id%4=1 THEN p_name ELSE 'The ' || p_name || ' ' || p_type END AS title FROM documents JOIN part ON p_partkey = doc_id)"""


@query(
    "match_family",
    f"""WITH {_FAMILY_SQL}, f AS (SELECT *, {d.token('ref')} AS rt, list_transform(aliases, lambda a: {d.token('a')}) AS ats, {d.token('name')} AS nt FROM fam), r AS (SELECT *, {d.token('slug')} AS st, {d.token('title')} AS tt FROM rq),
    p AS (SELECT request_id, family_id, pos, CASE WHEN ref = slug THEN 140 ELSE 0 END + CASE WHEN list_contains(aliases, slug) THEN 130 ELSE 0 END + CASE WHEN rt = st THEN 120 ELSE 0 END + CASE WHEN list_contains(ats, st) THEN 110 ELSE 0 END
      + CASE WHEN tt <> '' AND nt = tt THEN 120 ELSE 0 END + CASE WHEN tt <> '' AND rt = tt THEN 90 ELSE 0 END + CASE WHEN length(rt) >= 4 AND contains(st, rt) THEN 70 ELSE 0 END + CASE WHEN tt <> '' AND (contains(nt, tt) OR contains(tt, nt)) THEN 50 ELSE 0 END AS score FROM r, f)
    SELECT request_id, family_id, score FROM (SELECT *, row_number() OVER (PARTITION BY request_id ORDER BY score DESC, pos) AS rn FROM p WHERE score > 0) AS q WHERE rn = 1""",
)
def _(spark, sf):
    k, name, size = C("p_partkey"), C("p_name"), C("p_size")
    part = by_shuffle(table(spark, sf, "part"))
    dash = F.replace(name, F.lit(" "), F.lit("-"))
    families = part.select(
        k.alias("family_id"), F.when(size % 3 == 0, dash).otherwise(F.concat_ws("-", dash, size.cast("string"))).alias("ref"),
        F.when(size % 2 == 0, F.array(F.substring_index(name, " ", -1), F.concat(F.lit("x"), k.cast("string")))).otherwise(F.array().cast("array<string>")).alias("aliases"),
        F.when(size % 5 == 0, F.concat_ws(" ", "p_name", "p_type")).otherwise(name).alias("name"), k.alias("pos"),
    )
    doc = C("doc_id")
    requests = table(spark, sf, "documents").select("doc_id").join(part, doc == k).select(
        doc.alias("request_id"), F.when(doc % 3 == 0, F.concat(dash, F.lit("-mono"))).otherwise(dash).alias("slug"),
        F.when(doc % 4 == 0, "").when(doc % 4 == 1, name).otherwise(F.concat_ws(" ", F.lit("The"), "p_name", "p_type")).alias("title"),
    )
    return pr.match_family(requests, families)


@query(
    "mentions_family",
    f"""WITH f AS (SELECT DISTINCT {d.token('p_name')} AS token FROM part UNION SELECT 'erthat' UNION SELECT 'thenuc'), t AS (SELECT doc_id, {d.token("text || CASE WHEN doc_id%5=0 THEN ' Small Ring Regular, small-gear.' ELSE '' END")} AS t FROM documents)
    SELECT doc_id, token FROM t JOIN f ON contains(t, token)""",
)
def _(spark, sf):
    families = table(spark, sf, "part").select(normalize_token(C("p_name")).alias("token")).distinct()
    spoken = families.limit(1).select(F.explode(F.array(F.lit("erthat"), F.lit("thenuc"))).alias("token"))
    docs = table(spark, sf, "documents").select("doc_id", F.concat("text", F.when(C("doc_id") % 5 == 0, " Small Ring Regular, small-gear.").otherwise("")).alias("text"))
    return pr.mentions_family(docs, families.union(spoken))


@query(
    "assign_best",
    with_fixtures("css", "profiles").replace("WITH ", "WITH RECURSIVE ", 1) + FACES_CTE + f""", fa AS (SELECT regexp_extract(page, '//(brand[0-9]+)[.]', 1) AS brand, regexp_extract(page, '/css/([0-9]+)', 1) AS blk, {d.token('family')} AS fam, u AS face, style = 'Italic' AS it, TRY_CAST(weight AS DOUBLE) AS w, pos AS face_pos, {d.token(d.stem('u'))} AS stem FROM faces),
    wa AS (SELECT lower(replace(regexp_extract(package, '^(.*)-[0-9]+$', 1), '#', '')) AS brand, regexp_extract(package, '-([0-9]+)$', 1) AS blk, pos AS style_pos, style_label AS style, regexp_matches(style_label, '(?i)italic|oblique') AS it, CASE WHEN contains(lower(style_label), 'bold') THEN 700.0 ELSE 400.0 END AS w, list_filter(string_split(lower(style_label), ' '), lambda t: t <> '') AS tokens FROM profiles),
    sc AS (SELECT fa.brand || '/' || fa.blk || '/' || fam AS family, style_pos, style, face, face_pos, CASE WHEN wa.it = fa.it THEN 45 ELSE -25 END + CASE WHEN fa.w IS NULL THEN 0 WHEN fa.w = wa.w THEN 40 WHEN floor(fa.w / 100) = floor(wa.w / 100) THEN 20 ELSE -8 END
       + coalesce(list_sum(list_transform(tokens, lambda t: CASE WHEN contains(stem, t) THEN 8 ELSE -4 END)), 0) AS score FROM fa JOIN wa ON wa.brand = fa.brand AND wa.blk = fa.blk),
    st AS (SELECT family, style_pos, style, row_number() OVER (PARTITION BY family ORDER BY style_pos, style) AS k, list({{'face': face, 'score': score}} ORDER BY score DESC, face_pos, face) AS opts FROM sc WHERE score > 0 GROUP BY family, style_pos, style),
    g AS (SELECT family, k, style_pos, style, opts[1] AS pick, [opts[1].face] AS taken FROM st WHERE k = 1
      UNION ALL SELECT family, k, style_pos, style, pick, list_append(taken, pick.face) FROM (SELECT st.family, st.k, st.style_pos, st.style, g.taken, coalesce(list_filter(st.opts, lambda o: NOT list_contains(g.taken, o.face))[1], st.opts[1]) AS pick FROM g JOIN st ON st.family = g.family AND st.k = g.k + 1) AS q)
    SELECT family, style_pos, style, pick.face AS face, CAST(pick.score AS BIGINT) AS score FROM g""",
)
def _(spark, sf):
    """Styles of the profiles against the faces of the style sheets, per brand block."""
    from glyphlake.plans.faces import css_docs

    faces = fc.extract_faces(css_docs(spark, sf)).select(
        F.regexp_extract("page", r"//(brand\d+)\.", 1).alias("brand"), F.regexp_extract("page", r"/css/(\d+)", 1).alias("blk"),
        normalize_token(C("family")).alias("fam"), C("source.url").alias("face"), (C("style") == "Italic").alias("face_italic"),
        C("weight").try_cast("double").alias("face_weight"), C("pos").cast("long").alias("face_pos"), normalize_token(urls.asset_stem(C("source.url"))).alias("stem"),
    )
    wanted = fixture(spark, sf, "profiles").select(
        F.lower(F.replace(F.regexp_extract("package", r"^(.*)-\d+$", 1), F.lit("#"), F.lit(""))).alias("brand"), F.regexp_extract("package", r"-(\d+)$", 1).alias("blk"),
        C("pos").alias("style_pos"), C("style_label").alias("style"), C("style_label").rlike("(?i)italic|oblique").alias("italic"),
        F.when(F.lower("style_label").rlike("bold"), 700.0).otherwise(400.0).alias("weight"),
        F.filter(F.split(F.lower("style_label"), " "), lambda t: t != "").alias("tokens"),
    )
    named = faces.withColumn("family", F.concat_ws("/", "brand", "blk", "fam"))
    return pr.assign_best(pr.score_candidates(named, wanted, ["brand", "blk"]))


@query(
    "assign_longest_first",
    with_fixtures("css", "profiles").replace("WITH ", "WITH RECURSIVE ", 1) + FACES_CTE + f""", fb AS (SELECT page, u, arg_min(label, pos) AS label, arg_min(style, pos) AS style, min(pos) AS pos FROM faces GROUP BY page, u),
    fa AS (SELECT regexp_extract(page, '//(brand[0-9]+)[.]', 1) AS brand, regexp_extract(page, '/css/([0-9]+)', 1) AS blk, u AS url, {d.token('label')} AS token, style = 'Italic' AS sl, pos % 7 AS quality FROM fb),
    wa AS (SELECT lower(replace(regexp_extract(package, '^(.*)-[0-9]+$', 1), '#', '')) AS brand, regexp_extract(package, '-([0-9]+)$', 1) AS blk, style_label AS style, regexp_matches(style_label, '(?i)italic|oblique') AS it, {d.token('style_label')} AS t FROM profiles),
    wb AS (SELECT brand, blk, style, it, [t, replace(t, 'demi', 'semi')] AS tokens, length(t) AS len FROM wa GROUP BY ALL),
    m AS (SELECT wb.brand, wb.blk, wb.style, url, list_max(list_transform(tokens, lambda t: CASE WHEN t = '' OR token = '' THEN NULL WHEN token = t THEN 140 WHEN contains(token, t) THEN 98 - (length(token) - length(t)) WHEN contains(t, token) THEN 88 - (length(t) - length(token)) END))
       + CASE WHEN it AND sl THEN 10 WHEN it THEN -20 WHEN sl THEN -8 ELSE 0 END + quality AS score FROM wb JOIN fa ON fa.brand = wb.brand AND fa.blk = wb.blk),
    o AS (SELECT brand, blk, style, list({{'url': url, 'score': score}} ORDER BY score DESC, url) AS opts FROM m WHERE score >= 60 GROUP BY brand, blk, style),
    st AS (SELECT wb.brand, wb.blk, wb.style, coalesce(o.opts, []) AS opts, row_number() OVER (PARTITION BY wb.brand, wb.blk ORDER BY len DESC, wb.style) AS k FROM wb LEFT JOIN o ON o.brand = wb.brand AND o.blk = wb.blk AND o.style = wb.style),
    g AS (SELECT brand, blk, k, style, opts[1] AS pick, CASE WHEN len(opts) > 0 THEN [opts[1].url] ELSE [] END AS taken FROM st WHERE k = 1
      UNION ALL SELECT brand, blk, k, style, pick, CASE WHEN pick IS NULL THEN taken ELSE list_append(taken, pick.url) END FROM (SELECT st.brand, st.blk, st.k, st.style, g.taken, list_filter(st.opts, lambda o: NOT list_contains(g.taken, o.url))[1] AS pick FROM g JOIN st ON st.brand = g.brand AND st.blk = g.blk AND st.k = g.k + 1) AS q)
    SELECT brand, blk, style, pick.url AS url, CAST(pick.score AS BIGINT) AS score FROM g""",
)
def _(spark, sf):
    """Styles of the profiles and the assets of the style sheets, per brand block."""
    from glyphlake.plans.faces import css_docs

    assets = fc.extract_faces(css_docs(spark, sf)).groupBy("page", C("source.url").alias("url")).agg(
        normalize_token(F.min_by("label", "pos")).alias("token"), (F.min_by("style", "pos") == "Italic").alias("slanted"), (F.min("pos") % 7).alias("quality")
    )
    named = assets.select(F.regexp_extract("page", r"//(brand\d+)\.", 1).alias("brand"), F.regexp_extract("page", r"/css/(\d+)", 1).alias("blk"), "url", "token", "slanted", "quality")
    token = normalize_token(C("style_label"))
    wanted = fixture(spark, sf, "profiles").select(
        F.lower(F.replace(F.regexp_extract("package", r"^(.*)-\d+$", 1), F.lit("#"), F.lit(""))).alias("brand"), F.regexp_extract("package", r"-(\d+)$", 1).alias("blk"),
        C("style_label").alias("style"), C("style_label").rlike("(?i)italic|oblique").alias("italic"), F.array(token, F.replace(token, F.lit("demi"), F.lit("semi"))).alias("tokens"),
    ).distinct()
    return pr.assign_longest_first(wanted, named, ["brand", "blk"])


@query(
    "document_relevance",
    """WITH n AS (SELECT p_partkey AS key, p_name, replace(p_name, ' ', '-') || CASE p_partkey%6 WHEN 0 THEN '-Guide-v2' WHEN 1 THEN '-Bold' WHEN 2 THEN '2' WHEN 3 THEN 'TechDoc' WHEN 4 THEN '_v12' ELSE '-brochure_' || p_brand END || '.pdf' AS name, CASE WHEN p_partkey%7=0 THEN 'other face' ELSE p_name END AS family, p_partkey%5 AS none FROM part)
    SELECT key, name, none = 0 OR (family = p_name AND key%6 <> 1) AS relevant FROM n""",
)
def _(spark, sf):
    part, k = table(spark, sf, "part"), C("p_partkey")
    ending = F.when(k % 6 == 0, "-Guide-v2").when(k % 6 == 1, "-Bold").when(k % 6 == 2, "2").when(k % 6 == 3, "TechDoc").when(k % 6 == 4, "_v12").otherwise(F.concat(F.lit("-brochure_"), C("p_brand")))
    named = part.select(k.alias("key"), F.concat(F.replace("p_name", F.lit(" "), F.lit("-")), ending, F.lit(".pdf")).alias("name"))
    families = part.filter(k % 5 != 0).select(k.alias("key"), F.when(k % 7 == 0, "other face").otherwise(C("p_name")).alias("family"))
    return document_relevance(named, families)


@query(
    "directory_rollup",
    with_fixtures("tree").replace("WITH ", "WITH RECURSIVE ", 1) + """, up AS (SELECT id, parent_id AS anc, kind, size FROM tree WHERE parent_id IS NOT NULL UNION ALL SELECT u.id, t.parent_id, u.kind, u.size FROM up AS u JOIN tree AS t ON t.id = u.anc WHERE t.parent_id IS NOT NULL)
    SELECT f.id, f.name, (SELECT count(*) FROM tree AS c WHERE c.parent_id = f.id AND c.kind = 'file') AS files, (SELECT count(*) FROM tree AS c WHERE c.parent_id = f.id AND c.kind = 'folder') AS dirs, (SELECT CAST(coalesce(sum(size), 0) AS BIGINT) FROM tree AS c WHERE c.parent_id = f.id) AS size,
      (SELECT count(*) FROM up WHERE anc = f.id AND kind = 'file') AS total_files, (SELECT count(*) FROM up WHERE anc = f.id AND kind = 'folder') AS total_dirs, (SELECT CAST(coalesce(sum(size), 0) AS BIGINT) FROM up WHERE anc = f.id) AS total_size FROM tree AS f WHERE f.kind = 'folder'""",
)
def _(spark, sf):
    return directory_rollup(fixture(spark, sf, "tree"))


@query("tree_listing", with_fixtures("tree").replace("WITH ", "WITH RECURSIVE ", 1) + """, w AS (SELECT id, name, 0 AS depth, name AS path FROM tree WHERE parent_id IS NULL UNION ALL SELECT t.id, t.name, w.depth + 1, w.path || '/' || t.name FROM tree AS t JOIN w ON t.parent_id = w.id) SELECT id, depth, path, repeat('  ', depth) || name AS line FROM w""")
def _(spark, sf):
    return tree_listing(fixture(spark, sf, "tree"))
