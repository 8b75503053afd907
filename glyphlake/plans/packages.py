"""Queries over packages of font files."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from glyphlake import fixed_values as fv
from glyphlake.operators import packages as pk
from glyphlake.plans import sql_text as d
from glyphlake.plans.fixtures import fixture, with_fixtures
from glyphlake.plans.normalize import ITALIC_CTE, issues_sql, quality_token_sql
from glyphlake.plans.registry import query, table
from glyphlake.session import checkpoint_root
from glyphlake.sources import sinks

C = F.col
TOKENS = ["ring", "gear", "rod", "bolt", "smabolt"]


def metrics(spark, sf):
    return fixture(spark, sf, "file_metrics")


def limited_formats(spark, sf):
    """(package, limited): formats the source of a package does not offer."""
    from glyphlake.functions.files import format_tokens

    rows = fixture(spark, sf, "profiles").groupBy("package").agg(F.max("source_limited").alias("s"))
    return rows.select("package", format_tokens(C("s")).alias("limited"))


def state(spark, sf):
    return pk.with_file_state(metrics(spark, sf), F.array(*[F.lit(t) for t in TOKENS]))


STATE_CTE = ITALIC_CTE + f""", lim AS (SELECT package, max(source_limited) AS limited FROM profiles GROUP BY package),
  hay AS (SELECT *, lower(concat_ws(' ', filename, coalesce(family_name, ''), coalesce(subfamily_name, ''), coalesce(full_name, ''), coalesce(postscript_name, ''))) AS hay FROM effective),
  state AS (SELECT *, coalesce(ext <> signature, false) AS mm, coalesce(glyph_count < 50 OR cmap_entries BETWEEN 1 AND 49, false) AS subset, CASE WHEN is_valid THEN len({issues_sql()}) = 0 END AS name_ok, coalesce(file_italic <> eff, false) AS it_mm,
     list_filter(string_split(coalesce(feature_tags, ''), ','), lambda t: t <> '') AS tags,
     CASE WHEN is_valid THEN len(list_filter({d.words(TOKENS)}, lambda t: contains(hay, t) OR contains({d.token('hay')}, t) OR contains(replace({d.token('hay')}, 'll', ''), t))) > 0 END AS target FROM hay)"""
FX = with_fixtures("file_metrics", "profiles")

INVENTORY_CTE = ", inv AS (SELECT m.package, limited, " + ", ".join(f"count(*) FILTER (WHERE ext = '{f}') AS n_{f}" for f in fv.CORE_FORMATS) + ", list_filter([" + ", ".join(
    f"CASE WHEN count(*) FILTER (WHERE ext = '{f}') = 0 AND limited <> '{f}' THEN '{f}' END" for f in fv.CORE_FORMATS
) + "], lambda x: x IS NOT NULL) AS missing FROM file_metrics AS m JOIN (SELECT package, max(source_limited) AS limited FROM profiles GROUP BY package) AS l ON l.package = m.package GROUP BY m.package, limited)"


@query("format_inventory", FX + INVENTORY_CTE + " SELECT package, n_woff, n_woff2, n_otf, n_ttf, array_to_string(missing, ',') AS missing FROM inv")
def _(spark, sf):
    out = pk.format_inventory(metrics(spark, sf), limited_formats(spark, sf))
    return out.select("package", "n_woff", "n_woff2", "n_otf", "n_ttf", F.array_join("missing", ",").alias("missing"))


GROUPS_CTE = f""", keyed AS (SELECT m.*, lower({d.rep('filename', '[.][^.]*$')}) AS key, limited FROM file_metrics AS m JOIN (SELECT package, max(source_limited) AS limited FROM profiles GROUP BY package) AS l ON l.package = m.package),
  grp AS (SELECT package, key, count(*) AS files, list_sort(list(DISTINCT ext)) AS formats, count(DISTINCT nullif(family_name, '')) AS fams, count(DISTINCT nullif(subfamily_name, '')) AS subs,
     list_filter(['woff', 'woff2', CASE WHEN contains(key, 'variable') THEN 'ttf' ELSE 'otf' END], lambda f: f <> any_value(limited)) AS expected FROM keyed GROUP BY package, key),
  grp2 AS (SELECT *, list_filter(expected, lambda f: NOT list_contains(formats, f)) AS missing FROM grp)"""


@query(
    "format_groups",
    FX + GROUPS_CTE + """ SELECT package, key, files, array_to_string(formats, ',') AS formats, array_to_string(expected, ',') AS expected, array_to_string(missing, ',') AS missing,
      concat_ws(',', CASE WHEN fams > 1 THEN 'family_name_mismatch' END, CASE WHEN subs > 1 THEN 'subfamily_name_mismatch' END, CASE WHEN len(missing) > 0 THEN 'format_incomplete' END) AS issues FROM grp2""",
)
def _(spark, sf):
    out = pk.format_groups(metrics(spark, sf), limited_formats(spark, sf))
    return out.select("package", "key", "files", *[F.array_join(c, ",").alias(c) for c in ("formats", "expected", "missing", "issues")])


SUMMARY_CTE = """, summary AS (SELECT package, count(*) AS total_files, count(*) FILTER (WHERE is_valid) AS valid_fonts, count(*) FILTER (WHERE NOT is_valid) AS invalid_fonts,
   count(*) FILTER (WHERE is_valid AND subset) AS subsetted_fonts, count(*) FILTER (WHERE is_valid AND NOT subset) AS full_fonts, count(*) FILTER (WHERE name_ok) AS name_table_ok_fonts, count(*) FILTER (WHERE NOT name_ok) AS name_table_bad_fonts,
   count(*) FILTER (WHERE is_valid AND it_mm) AS italic_mismatches, count(*) FILTER (WHERE mm) AS ext_signature_mismatches, CAST(0 AS BIGINT) AS os2_italic_mismatches, CAST(0 AS BIGINT) AS mono_fixed_pitch_mismatches,
   count(*) FILTER (WHERE is_valid AND ext IN ('ttf', 'otf')) AS desktop_fonts, count(*) FILTER (WHERE is_valid AND ext IN ('ttf', 'otf') AND name_ok) AS desktop_name_ok, count(*) FILTER (WHERE is_valid AND ext IN ('ttf', 'otf') AND NOT subset) AS desktop_full_fonts,
   count(*) FILTER (WHERE target) AS target_matched_fonts, count(*) FILTER (WHERE NOT target) AS contamination_fonts,
   coalesce(CAST(sum(glyph_count) AS DOUBLE), 0) / greatest(1, count(*) FILTER (WHERE is_valid)) AS average_glyphs, CAST(sum(CASE WHEN is_valid THEN len(tags) ELSE 0 END) AS DOUBLE) / greatest(1, count(*) FILTER (WHERE is_valid)) AS average_feature_count
   FROM state GROUP BY package),
  verdict AS (SELECT *, CASE WHEN valid_fonts = 0 THEN 'fail' WHEN invalid_fonts + name_table_bad_fonts + italic_mismatches + ext_signature_mismatches + contamination_fonts > 0 THEN 'warn' ELSE 'pass' END AS status FROM summary)"""


@query("validation_summary", FX + STATE_CTE + SUMMARY_CTE + " SELECT * FROM verdict")
def _(spark, sf):
    return pk.validation_summary(state(spark, sf))


@query(
    "feature_histogram",
    FX + STATE_CTE + """, t AS (SELECT package, unnest(tags) AS tag FROM state WHERE is_valid), c AS (SELECT package, tag, count(*) AS count FROM t GROUP BY package, tag)
    SELECT package, tag, count FROM c""",
)
def _(spark, sf):
    return pk.feature_histogram(state(spark, sf))


@query(
    "technical_qa",
    FX + INVENTORY_CTE + GROUPS_CTE + """, iv AS (SELECT package, count(*) FILTER (WHERE NOT is_valid) AS n FROM file_metrics GROUP BY package),
    gr AS (SELECT package, count(*) AS total, count(*) FILTER (WHERE len(missing) > 0) AS inc, count(*) FILTER (WHERE fams > 1 OR subs > 1) AS nm FROM grp2 GROUP BY package),
    j AS (SELECT i.package, total, inc, nm, concat_ws('; ', CASE WHEN n > 0 THEN 'invalid_files=' || n END, CASE WHEN len(missing) > 0 THEN 'formats_missing=' || array_to_string(missing, ',') END, CASE WHEN inc > 0 THEN 'groups_incomplete' END, CASE WHEN nm > 0 THEN 'groups_with_other_names=' || nm END) AS reasons
      FROM inv AS i JOIN iv ON iv.package = i.package JOIN gr ON gr.package = i.package)
    SELECT package, total AS groups_total, inc AS groups_incomplete, nm AS group_name_mismatch_count, reasons, CASE WHEN reasons = '' THEN 'pass' ELSE 'warn' END AS status FROM j""",
)
def _(spark, sf):
    out = pk.technical_qa(metrics(spark, sf), limited_formats(spark, sf), strict_groups=True)
    return out.select("package", "groups_total", "groups_incomplete", "group_name_mismatch_count", F.array_join("reasons", "; ").alias("reasons"), "status")


CANDIDATES_CTE = """, cs AS (SELECT package, filename, pos, CASE WHEN contains(lower(filename), 'variable') THEN 100 ELSE 0 END + CASE ext WHEN 'woff2' THEN 40 WHEN 'woff' THEN 25 WHEN 'ttf' THEN 20 WHEN 'otf' THEN 15 ELSE 0 END - CASE WHEN contains(lower(filename), 'italic') THEN 1 ELSE 0 END AS score FROM file_metrics),
  top AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY package ORDER BY score DESC, pos) AS rn FROM cs) AS q WHERE rn <= 5)"""


@query("rank_candidates", FX + CANDIDATES_CTE + " SELECT package, filename, pos, score FROM top")
def _(spark, sf):
    return pk.rank_candidates(metrics(spark, sf), k=5).select("package", "filename", "pos", "score")


@query(
    "recovery_plan",
    FX + """, fine AS (SELECT package || '/' || coalesce(full_name, '?') AS package, filename, ext, pos FROM file_metrics),
    mi AS (SELECT package, list_filter([CASE WHEN count(*) FILTER (WHERE ext = 'woff') = 0 THEN 'woff' END, CASE WHEN count(*) FILTER (WHERE ext = 'woff2') = 0 THEN 'woff2' END, CASE WHEN count(*) FILTER (WHERE ext = 'otf') = 0 THEN 'otf' END], lambda x: x IS NOT NULL) AS missing FROM fine GROUP BY package),
    sc AS (SELECT package, filename, pos, CASE WHEN contains(lower(filename), 'variable') THEN 100 ELSE 0 END + CASE ext WHEN 'woff2' THEN 40 WHEN 'woff' THEN 25 WHEN 'ttf' THEN 20 WHEN 'otf' THEN 15 ELSE 0 END - CASE WHEN contains(lower(filename), 'italic') THEN 1 ELSE 0 END AS score FROM fine),
    rk AS (SELECT * FROM sc)
    SELECT m.package, array_to_string(missing, ',') AS missing, CASE WHEN len(missing) = 0 THEN 'noop' ELSE 'needed' END AS status, r.filename, r.score FROM mi AS m LEFT JOIN rk AS r ON r.package = m.package AND len(missing) > 0""",
)
def _(spark, sf):
    # one package per full name, so that some lack a format
    fine = metrics(spark, sf).withColumn("package", F.concat_ws("/", "package", F.coalesce("full_name", F.lit("?"))))
    out = pk.recovery_plan(fine, limited_formats(spark, sf), ["woff", "woff2", "otf"])
    return out.select("package", F.array_join("missing", ",").alias("missing"), "status", "filename", "score")


@query(
    "best_metrics",
    FX + STATE_CTE + f""", k AS (SELECT *, {quality_token_sql('subfamily_name')} AS tok FROM state WHERE subfamily_name IS NOT NULL),
    r AS (SELECT *, row_number() OVER (PARTITION BY package, tok ORDER BY cmap_entries DESC, glyph_count DESC, pos) AS rn FROM k WHERE tok <> '') SELECT package, tok AS style_token, filename, cmap_entries, glyph_count FROM r WHERE rn = 1""",
)
def _(spark, sf):
    return pk.best_metrics(state(spark, sf)).select("package", "style_token", "filename", "cmap_entries", "glyph_count")


@query(
    "dedupe_content",
    """WITH h AS (SELECT doc_id, row_number() OVER (PARTITION BY sha256(text) ORDER BY doc_id) AS rn FROM documents)
    SELECT doc_id, CASE WHEN rn = 1 THEN 'kept' ELSE 'Duplicate payload hash' END AS outcome FROM h""",
)
def _(spark, sf):
    kept, skipped = pk.dedupe_content(table(spark, sf, "documents"), "doc_id", "text")
    return kept.select("doc_id", F.lit("kept").alias("outcome")).union(skipped.select("doc_id", "reason"))


@query("dedupe_labels", FX + f", k AS (SELECT package, style_label, pos, {quality_token_sql('style_label')} AS token FROM profiles) SELECT package, token, arg_min(style_label, pos) AS style_label FROM k WHERE token <> '' GROUP BY package, token")
def _(spark, sf):
    return pk.dedupe_labels(fixture(spark, sf, "profiles")).select("package", "token", "style_label")


@query(
    "unique_names",
    with_fixtures("download_log") + r""", n AS (SELECT job_id, idx, package, filename, row_number() OVER (PARTITION BY package, filename ORDER BY job_id * 10 + idx) - 1 AS k FROM download_log)
    SELECT job_id, idx, package, filename, CASE WHEN k = 0 THEN filename ELSE regexp_replace(filename, '[.][^.]*$', '') || '-' || k || regexp_extract(filename, '([.][^.]*)$', 1) END AS unique_name FROM n""",
)
def _(spark, sf):
    log = fixture(spark, sf, "download_log").withColumn("o", C("job_id") * 10 + C("idx"))
    return pk.unique_names(log, "package", "filename", "o").select("job_id", "idx", "package", "filename", "unique_name")


@query(
    "unique_document_names",
    """WITH n AS (SELECT doc_id, source, lang || '-sheet.pdf' AS name FROM documents), k AS (SELECT *, row_number() OVER (PARTITION BY source, name ORDER BY doc_id) AS k FROM n)
    SELECT doc_id, source, CASE WHEN k = 1 THEN name ELSE replace(name, '.pdf', '') || '-' || k || '.pdf' END AS unique_name FROM k""",
)
def _(spark, sf):
    named = table(spark, sf, "documents").select("doc_id", "source", F.concat("lang", F.lit("-sheet.pdf")).alias("name"))
    return pk.unique_names(named, "source", "name", "doc_id", first=2).select("doc_id", "source", "unique_name")


@query("contamination_filter", FX + STATE_CTE + " SELECT package, path, CASE WHEN target = false THEN 'contaminated' ELSE 'clean' END AS side FROM state")
def _(spark, sf):
    return pk.contamination_side(state(spark, sf)).select("package", "path", "side")


@query("trial_assets", with_fixtures("download_log") + r" SELECT job_id, idx, filename FROM download_log WHERE regexp_matches(source_url, '(?i)\btrial\b') OR regexp_matches(filename, '(?i)\btrial\b') OR regexp_matches(name, '(?i)\btrial\b')")
def _(spark, sf):
    return pk.trial_assets(fixture(spark, sf, "download_log")).select("job_id", "idx", "filename")


@query("write_by_format", with_fixtures("file_metrics") + " SELECT CASE ext WHEN 'woff2' THEN 'Webfonts/Woff2' WHEN 'woff' THEN 'Webfonts/Woff' WHEN 'ttf' THEN 'TTF' ELSE 'OTF' END AS format_dir, count(*) AS files FROM file_metrics GROUP BY ALL")
def _(spark, sf):
    path = f"{checkpoint_root(spark)}/by_format_{uuid.uuid4().hex}"
    sinks.write_by_format(metrics(spark, sf), path)
    return spark.read.parquet(path).groupBy("format_dir").agg(F.count("*").alias("files"))


@query("write_report", FX + STATE_CTE + SUMMARY_CTE + " SELECT status, count(*) AS packages, CAST(sum(total_files) AS BIGINT) AS files FROM verdict GROUP BY status")
def _(spark, sf):
    path = f"{checkpoint_root(spark)}/report_{uuid.uuid4().hex}"
    results = pk.validation_summary(state(spark, sf))
    sinks.write_report(results.groupBy("status").agg(F.count("*").alias("packages"), F.sum("total_files").alias("files")), results, path)
    return sinks.read_report(spark, path)[1].groupBy("status").agg(F.count("*").alias("packages"), F.sum("total_files").alias("files"))


@query(
    "array_set_algebra",
    FX + """, a AS (SELECT package, list_sort(list(DISTINCT ext)) AS e FROM file_metrics GROUP BY package), b AS (SELECT package, ['woff', 'ttf', 'eot'] AS r FROM a)
    SELECT a.package, array_to_string(list_sort(list_distinct(list_concat(e, r))), ',') AS united, array_to_string(list_sort(list_intersect(e, r)), ',') AS shared, array_to_string(list_sort(list_filter(e, lambda x: NOT list_contains(r, x))), ',') AS only_left FROM a JOIN b ON b.package = a.package""",
)
def _(spark, sf):
    r = F.array(F.lit("woff"), F.lit("ttf"), F.lit("eot"))
    e = metrics(spark, sf).groupBy("package").agg(F.collect_set("ext").alias("e"))
    join = lambda a: F.array_join(F.array_sort(a), ",")
    return e.select("package", join(F.array_union("e", r)).alias("united"), join(F.array_intersect("e", r)).alias("shared"), join(F.array_except("e", r)).alias("only_left"))


@query(
    "row_set_algebra",
    FX + """, e AS (SELECT DISTINCT package, lower(replace(style_label, ' ', '')) AS token FROM profiles), o AS (SELECT DISTINCT package, lower(replace(subfamily_name, ' ', '')) AS token FROM file_metrics WHERE subfamily_name IS NOT NULL)
    SELECT 'shared' AS side, package, token FROM (SELECT * FROM e INTERSECT SELECT * FROM o) AS x UNION ALL SELECT 'missing', package, token FROM (SELECT * FROM e EXCEPT SELECT * FROM o) AS y UNION ALL SELECT 'extra', package, token FROM (SELECT * FROM o EXCEPT SELECT * FROM e) AS z""",
)
def _(spark, sf):
    squeeze = lambda c: F.lower(F.replace(c, F.lit(" "), F.lit(""))).alias("token")
    e = fixture(spark, sf, "profiles").select("package", squeeze(C("style_label"))).distinct()
    o = metrics(spark, sf).filter("subfamily_name is not null").select("package", squeeze(C("subfamily_name"))).distinct()
    tag = lambda df, name: df.select(F.lit(name).alias("side"), "package", "token")
    return tag(e.intersect(o), "shared").union(tag(e.subtract(o), "missing")).union(tag(o.subtract(e), "extra"))
