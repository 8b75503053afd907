"""Queries that compare expected styles and names with observed ones."""

from __future__ import annotations

from pyspark.sql import functions as F

from glyphlake.functions.styles import quality_style_token, target_style_token
from glyphlake.operators import coverage as cv
from glyphlake.operators import packages as pk
from glyphlake.operators.picking import computed, dedupe_first, first_by
from glyphlake.plans import sql_text as d
from glyphlake.plans.fixtures import fixture, with_fixtures
from glyphlake.plans.normalize import quality_token_sql, sheet_token_sql, target_token_sql
from glyphlake.plans.packages import FX, STATE_CTE, SUMMARY_CTE, state
from glyphlake.plans.pages import candidates_sql, flat_sql, seeded_documents, spelled_sql, _SEED
from glyphlake.plans.registry import query
from glyphlake.session import by_shuffle, cut_lineage

C = F.col


def expected_styles(spark, sf, token=quality_style_token):
    rows = fixture(spark, sf, "profiles").filter("NOT optional")
    return cv.styles_of(rows, "style_label", token(C("style_label")), "scope")


def optional_styles(spark, sf):
    rows = fixture(spark, sf, "profiles").filter("optional")
    return cv.styles_of(rows, "style_label", quality_style_token(C("style_label"))).select("package", "token")


def full_fonts(spark, sf):
    return state(spark, sf).filter("is_valid AND NOT is_subset")


def observed_metrics(spark, sf):
    """Best full font per (package, style key), family prefix kept in the key
    for half of the packages by using the full name."""
    rows = full_fonts(spark, sf).withColumn(
        "label", F.when(C("package").endswith("0"), C("full_name")).otherwise(C("subfamily_name"))
    )
    keyed = computed(rows, token=quality_style_token(C("label"))).filter("token <> ''")
    return first_by(keyed, ["package", "token"], [-C("cmap_entries"), -C("glyph_count"), C("pos")])


EXPECTED_CTE = f""", ex0 AS (SELECT package, style_label AS label, scope, pos, {quality_token_sql('style_label')} AS token FROM profiles WHERE NOT optional),
  expected AS (SELECT package, token, arg_min(label, pos) AS label, arg_min(scope, pos) AS scope, min(pos) AS pos FROM ex0 WHERE token <> '' GROUP BY package, token)"""
OBSERVED_CTE = f""", ob0 AS (SELECT *, {quality_token_sql("CASE WHEN ends_with(package, '0') THEN full_name ELSE subfamily_name END")} AS token FROM state WHERE is_valid AND NOT subset),
  observed AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY package, token ORDER BY cmap_entries DESC, glyph_count DESC, pos) AS rn FROM ob0 WHERE token <> '') AS q WHERE rn = 1)"""
MATCH_CTE = """, matched AS (SELECT e.package, e.token, e.label, e.scope, e.pos, coalesce(max(CASE WHEN o.token = e.token THEN o.token END), arg_min(o.token, o.pos)) AS observed_token FROM expected AS e
   LEFT JOIN observed AS o ON o.package = e.package AND (o.token = e.token OR (e.scope = 'family-style' AND (contains(o.token, e.token) OR starts_with(e.token, o.token)))) GROUP BY e.package, e.token, e.label, e.scope, e.pos)"""
HEAD = FX + STATE_CTE + EXPECTED_CTE + OBSERVED_CTE


@query("style_coverage", HEAD + MATCH_CTE + " SELECT package, token, label, scope, observed_token FROM matched")
def _(spark, sf):
    return cv.style_coverage(expected_styles(spark, sf), observed_metrics(spark, sf)).select("package", "token", "label", "scope", "observed_token")


@query(
    "unexpected_styles",
    HEAD + f""", opt AS (SELECT DISTINCT package, {quality_token_sql('style_label')} AS token FROM profiles WHERE optional), asked AS (SELECT * FROM expected AS e WHERE NOT EXISTS (SELECT 1 FROM opt AS p WHERE p.package = e.package AND p.token = e.token))
    SELECT package, token FROM observed AS o WHERE NOT EXISTS (SELECT 1 FROM opt AS p WHERE p.package = o.package AND p.token = o.token) AND NOT EXISTS (SELECT 1 FROM asked AS a WHERE a.package = o.package AND a.token = o.token) AND package IN (SELECT package FROM asked)""",
)
def _(spark, sf):
    return cv.unexpected(observed_metrics(spark, sf), expected_styles(spark, sf), optional_styles(spark, sf)).select("package", "token")


def names(spark, sf, fonts):
    """(package, token, name, pos) of postscript names, first per token."""
    rows = computed(fonts.filter("postscript_name <> ''"), token=target_style_token(C("postscript_name")))
    return dedupe_first(rows.select("package", "token", C("postscript_name").alias("name"), "pos"), ["package", "token"])


def expected_names(spark, sf):
    """Names the catalogue lists: those of the woff files, cut short or extended."""
    woff = state(spark, sf).filter("ext = 'woff' AND postscript_name <> ''")
    changed = (
        F.when(C("pos") % 5 == 0, F.concat("postscript_name", F.lit("Pro")))
        .when(C("pos") % 5 == 1, F.substring_index("postscript_name", "-", 1))
        .when(C("pos") % 5 == 2, F.concat(F.lit("Lost-"), C("postscript_name")))
        .otherwise(C("postscript_name"))
    )
    return names(spark, sf, woff.withColumn("postscript_name", changed))


NAMES_CTE = f""", en0 AS (SELECT package, pos, CASE pos%5 WHEN 0 THEN postscript_name || 'Pro' WHEN 1 THEN split_part(postscript_name, '-', 1) WHEN 2 THEN 'Lost-' || postscript_name ELSE postscript_name END AS name FROM state WHERE ext = 'woff' AND postscript_name <> ''),
  exn AS (SELECT package, {target_token_sql('name')} AS token, arg_min(name, pos) AS name, min(pos) AS pos FROM en0 GROUP BY package, {target_token_sql('name')}),
  obn AS (SELECT package, {target_token_sql('postscript_name')} AS token, arg_min(postscript_name, pos) AS name, min(pos) AS pos FROM state WHERE is_valid AND NOT subset AND ext <> 'woff' AND postscript_name <> '' GROUP BY package, {target_token_sql('postscript_name')})"""


def observed_names(spark, sf):
    return names(spark, sf, full_fonts(spark, sf).filter("ext <> 'woff'"))


@query(
    "prefix_match",
    HEAD + NAMES_CTE + """ SELECT 'missing' AS side, package, token FROM exn AS e WHERE NOT EXISTS (SELECT 1 FROM obn AS o WHERE o.package = e.package AND (starts_with(o.token, e.token) OR starts_with(e.token, o.token)))
    UNION ALL SELECT 'unexpected', package, token FROM obn AS o WHERE NOT EXISTS (SELECT 1 FROM exn AS e WHERE o.package = e.package AND (starts_with(o.token, e.token) OR starts_with(e.token, o.token)))""",
)
def _(spark, sf):
    e, o = by_shuffle(cut_lineage(expected_names(spark, sf))), by_shuffle(cut_lineage(observed_names(spark, sf)))
    missing = cv.without_prefix_match(e, o).select(F.lit("missing").alias("side"), "package", "token")
    return missing.union(cv.without_prefix_match(o, e).select(F.lit("unexpected").alias("side"), "package", "token"))


@query(
    "dominant_prefix",
    HEAD + """, n AS (SELECT package, pos, postscript_name AS name, split_part(postscript_name, '-', 1) AS prefix FROM state WHERE postscript_name <> ''),
    c AS (SELECT *, count(*) OVER (PARTITION BY package, prefix) AS n, count(*) OVER (PARTITION BY package) AS total FROM n), m AS (SELECT *, max(n) OVER (PARTITION BY package) AS most, dense_rank() OVER (PARTITION BY package ORDER BY prefix) AS dr FROM c),
    x AS (SELECT *, max(dr) OVER (PARTITION BY package) AS prefixes FROM m) SELECT package, pos, name FROM x WHERE total < 3 OR prefixes <= 1 OR most < 2 OR n = most""",
)
def _(spark, sf):
    rows = state(spark, sf).filter("postscript_name <> ''").select("package", "pos", C("postscript_name").alias("name"))
    return cv.dominant_prefix(rows).select("package", "pos", "name")


@query(
    "intersect_or_fallback",
    HEAD + NAMES_CTE + """, cat AS (SELECT * FROM exn WHERE NOT ends_with(package, '1')), ses AS (SELECT * FROM obn WHERE package NOT LIKE 'Brand#2%' OR starts_with(token, 'zz')),
    sh AS (SELECT s.* FROM ses AS s WHERE EXISTS (SELECT 1 FROM cat AS c WHERE c.package = s.package AND c.token = s.token))
    SELECT package, token, name FROM sh UNION ALL SELECT package, token, name FROM ses WHERE package NOT IN (SELECT package FROM cat) UNION ALL SELECT package, token, name FROM cat WHERE package NOT IN (SELECT package FROM sh)""",
)
def _(spark, sf):
    cat = expected_names(spark, sf).filter(~C("package").endswith("1"))
    ses = observed_names(spark, sf).filter(~C("package").startswith("Brand#2") | C("token").startswith("zz"))
    return cv.intersect_or_fallback(cat, ses).select("package", "token", "name")


@query(
    "style_from_filename",
    HEAD + f""", fs AS (SELECT package, path, {d.space(d.rep(d.rep('filename', '[.][^.]*$'), '[_-]+', ' '))} AS s FROM file_metrics),
    ws AS (SELECT package, path, s, string_split(s, ' ') AS w FROM fs),
    cd AS (SELECT package, path, 0 AS ci, {quality_token_sql('s')} AS c FROM ws UNION ALL SELECT package, path, 1, {quality_token_sql(d.rep('s', '(?i)' + chr(92) + 'bweb' + chr(92) + 'b', ' '))} FROM ws
      UNION ALL SELECT package, path, 1 + i, {quality_token_sql("array_to_string(w[i:], ' ')")} FROM (SELECT *, unnest(range(1, len(w) + 1)) AS i FROM ws) AS q),
    sc AS (SELECT cd.package, path, e.token, CASE WHEN c = e.token THEN 100000 ELSE 0 END + length(e.token) AS score, ci, e.pos AS ei FROM cd JOIN expected AS e ON e.package = cd.package AND c <> '' AND (contains(c, e.token) OR contains(e.token, c))),
    best AS (SELECT package, path, token FROM (SELECT *, row_number() OVER (PARTITION BY package, path ORDER BY score DESC, ci, ei) AS rn FROM sc) AS q WHERE rn = 1)
    SELECT f.package, f.path, b.token AS file_token FROM file_metrics AS f LEFT JOIN best AS b ON b.package = f.package AND b.path = f.path""",
)
def _(spark, sf):
    files = fixture(spark, sf, "file_metrics").select("package", "path", "filename")
    return cv.style_from_filename(files, expected_styles(spark, sf)).select("package", "path", "file_token")


_LOG_PATH_SQL = "CASE job_id%3 WHEN 0 THEN '/out/' || package || '/' || fname WHEN 1 THEN package || '/' || fname ELSE fname END"


def download_rows(spark, sf):
    """Log rows whose file path is absolute, relative or bare, by job."""
    log = fixture(spark, sf, "download_log").filter("status = 'downloaded'").withColumn("fname", F.regexp_replace("filename", "zip$", "woff2"))
    return log.select(
        "package", "source_url", (C("job_id") * 10 + C("idx")).alias("pos"),
        F.when(C("job_id") % 3 == 0, F.concat_ws("/", F.lit("/out"), "package", "fname"))
        .when(C("job_id") % 3 == 1, F.concat_ws("/", "package", "fname")).otherwise(C("fname")).alias("file_path"),
    )


@query(
    "lookup_source",
    with_fixtures("file_metrics", "download_log") + f""", l AS (SELECT package, source_url, job_id * 10 + idx AS pos, {_LOG_PATH_SQL} AS fp FROM (SELECT *, regexp_replace(filename, 'zip$', 'woff2') AS fname FROM download_log WHERE status = 'downloaded') AS q),
    l2 AS (SELECT package, lower(string_split(fp, '/')[-1]) AS base, arg_min(source_url, pos) AS source_url FROM l GROUP BY package, lower(string_split(fp, '/')[-1])), f AS (SELECT DISTINCT package, path, lower(filename) AS base FROM file_metrics)
    SELECT f.package, f.path, l2.source_url FROM f JOIN l2 ON l2.package = f.package AND l2.base = f.base""",
)
def _(spark, sf):
    files = fixture(spark, sf, "file_metrics").select("package", "path").distinct()
    return cv.lookup_source(files, download_rows(spark, sf))


@query(
    "asset_style_lookup",
    with_fixtures("download_log") + r""", m AS (SELECT lower(CASE WHEN job_id%2=0 THEN source_url ELSE 'https://archive.example.net' END || '/' || filename) AS key, arg_max(name || ' mapped', job_id * 10 + idx) AS style_name FROM download_log GROUP BY 1),
    a AS (SELECT job_id, idx, CASE WHEN job_id%3=0 THEN source_url ELSE 'https://mirror.example.net' END || '/' || filename || '?v=1' AS asset_url FROM download_log),
    k AS (SELECT *, lower(regexp_replace(asset_url, '[?#].*$', '')) AS key FROM a), b AS (SELECT string_split(key, '/')[-1] AS file, arg_min(style_name, key) AS style_name FROM m GROUP BY 1)
    SELECT job_id, idx, asset_url, coalesce(m.style_name, b.style_name) AS style_name FROM k LEFT JOIN m ON m.key = k.key LEFT JOIN b ON b.file = string_split(k.key, '/')[-1]""",
)
def _(spark, sf):
    log = fixture(spark, sf, "download_log")
    kept_at = F.when(C("job_id") % 2 == 0, C("source_url")).otherwise("https://archive.example.net")
    style_map = log.select(F.lower(F.concat_ws("/", kept_at, "filename")).alias("key"), F.concat("name", F.lit(" mapped")).alias("style_name"), (C("job_id") * 10 + C("idx")).alias("pos"))
    home = F.when(C("job_id") % 3 == 0, C("source_url")).otherwise("https://mirror.example.net")
    assets = log.select("job_id", "idx", F.concat(home, F.lit("/"), C("filename"), F.lit("?v=1")).alias("asset_url"))
    return cv.asset_style_lookup(assets, style_map)


def profile_rows(spark, sf):
    parts = fixture(spark, sf, "profiles").select(
        "package", "pos", "scope", "strict", F.split("required_tags", ",").alias("required_tags"),
        F.array("style_label").alias("expected_styles"), "min_cmap", "min_features",
    )
    return cv.merge_profiles(parts)


@query(
    "merge_profiles",
    FX + """, p AS (SELECT package, pos, CASE WHEN pos%7=0 THEN 'family-style' ELSE 'style' END AS scope, CASE WHEN pos%3=0 THEN NULL ELSE pos%2=0 END AS strict, CASE WHEN pos%4=0 THEN '' ELSE 'KERN,' || style_label END AS tags, (min_cmap + pos) * CASE WHEN pos%5=0 THEN 1 ELSE 0 END AS min_cmap FROM profiles)
    SELECT package, max(CASE WHEN scope = 'family-style' THEN scope ELSE 'aaa' END) AS scope, arg_max(strict, pos) FILTER (WHERE strict IS NOT NULL) AS strict, lower(arg_max(tags, pos) FILTER (WHERE tags <> '')) AS required_tags, arg_max(min_cmap, pos) FILTER (WHERE min_cmap > 0) AS min_cmap FROM p GROUP BY package""",
)
def _(spark, sf):
    p, pos = fixture(spark, sf, "profiles"), C("pos")
    parts = p.select(
        "package", "pos",
        F.when(pos % 7 == 0, "family-style").otherwise("style").alias("scope"),
        F.when(pos % 3 != 0, pos % 2 == 0).alias("strict"),
        F.when(pos % 4 == 0, F.array().cast("array<string>")).otherwise(F.array(F.lit("KERN"), C("style_label"))).alias("required_tags"),
        F.array().cast("array<string>").alias("expected_styles"),
        ((C("min_cmap") + pos) * F.when(pos % 5 == 0, 1).otherwise(0)).alias("min_cmap"),
        "min_features",
    )
    return cv.merge_profiles(parts).select("package", "scope", "strict", F.array_join("required_tags", ",").alias("required_tags"), "min_cmap")


@query(
    "profile_fallback",
    FX + f""", silent AS (SELECT package, max(min_cmap * (pos % 2)) AS any_cmap FROM profiles GROUP BY package),
    own0 AS (SELECT package, {d.space('style_label')} AS label, pos FROM profiles), own1 AS (SELECT package, arg_min(label, pos) AS label, min(pos) AS pos FROM own0 WHERE label <> '' GROUP BY package, lower(label)),
    own AS (SELECT package, string_agg(label, ',' ORDER BY pos) AS labels FROM own1 GROUP BY package)
    SELECT s.package, CASE WHEN s.package LIKE '%1%' THEN 'Regular' WHEN s.any_cmap > 0 THEN '' ELSE o.labels END AS expected_styles FROM silent AS s LEFT JOIN own AS o ON o.package = s.package""",
)
def _(spark, sf):
    p = fixture(spark, sf, "profiles")
    none = F.array().cast("array<string>")
    parts = p.select(
        "package", "pos", F.lit("style").alias("scope"), F.lit(None).cast("boolean").alias("strict"), none.alias("required_tags"),
        F.when(C("package").contains("1"), F.array(F.lit("Regular"))).otherwise(none).alias("expected_styles"),
        (C("min_cmap") * (C("pos") % 2)).alias("min_cmap"), F.lit(0).alias("min_features"),
    )
    rows = p.select("package", "pos", C("style_label").alias("label"))
    return cv.with_fallback_styles(cv.merge_profiles(parts), rows).select("package", F.array_join("expected_styles", ",").alias("expected_styles"))


PROFILE_CTE = ", profile AS (SELECT package, any_value(strict) AS strict, any_value(required_tags) AS required_tags, any_value(min_cmap) AS min_cmap, any_value(min_features) AS min_features, any_value(pk2) AS fail_on_trial FROM (SELECT *, ends_with(package, '0') AS pk2 FROM profiles) AS q GROUP BY package)"
PCT = "CAST(round(CAST(100 * {a} AS DECIMAL(20,6)) / nullif({b}, 0), 2) AS DOUBLE)"


@query(
    "quality_audit",
    with_fixtures("file_metrics", "profiles", "download_log") + STATE_CTE + SUMMARY_CTE + EXPECTED_CTE + OBSERVED_CTE + MATCH_CTE + PROFILE_CTE + """,
    g0 AS (SELECT m.package, m.label, m.pos, m.observed_token, o.cmap_entries, len(o.tags) AS nf, o.tags FROM matched AS m LEFT JOIN observed AS o ON o.package = m.package AND o.token = m.observed_token),
    g AS (SELECT g0.package, count(*) AS expected_styles, count(observed_token) AS matched_styles, count(*) FILTER (WHERE cmap_entries < min_cmap) AS below_cmap, count(*) FILTER (WHERE nf < min_features) AS below_features,
       string_agg(label, ', ' ORDER BY g0.pos) FILTER (WHERE observed_token IS NULL) AS missing, flatten(list(tags) FILTER (WHERE tags IS NOT NULL)) AS all_tags FROM g0 JOIN profile AS p ON p.package = g0.package GROUP BY g0.package),
    tr AS (SELECT package, count(*) AS trial_assets FROM download_log WHERE regexp_matches(source_url || ' | ' || filename || ' | ' || name, '(?i)\\btrial\\b') GROUP BY package),
    j AS (SELECT g.*, p.strict, p.min_cmap, p.min_features, v.invalid_fonts, v.italic_mismatches, v.status, coalesce(tr.trial_assets, 0) AS trial_assets, p.fail_on_trial, list_filter(string_split(p.required_tags, ','), lambda t: NOT list_contains(coalesce(all_tags, []), t)) AS missing_tags
       FROM profile AS p JOIN g ON g.package = p.package JOIN verdict AS v ON v.package = p.package LEFT JOIN tr ON tr.package = p.package),
    r AS (SELECT *, concat_ws('; ', CASE WHEN strict AND missing IS NOT NULL THEN 'missing styles: ' || missing END, CASE WHEN below_cmap > 0 THEN 'styles below cmap threshold (' || min_cmap || ')' END, CASE WHEN invalid_fonts > 0 THEN 'invalid fonts detected: ' || invalid_fonts END,
       CASE WHEN italic_mismatches > 0 THEN 'italic mismatches detected: ' || italic_mismatches END, CASE WHEN fail_on_trial AND trial_assets > 0 THEN 'trial assets detected: ' || trial_assets END) AS fails FROM j),
    w AS (SELECT *, concat_ws('; ', CASE WHEN NOT strict AND missing IS NOT NULL THEN 'missing styles: ' || missing END, CASE WHEN below_features > 0 THEN 'styles below feature threshold (' || min_features || ')' END, CASE WHEN len(missing_tags) > 0 THEN 'required feature tags missing: ' || array_to_string(missing_tags, ', ') END,
       CASE WHEN status = 'warn' AND fails = '' THEN 'validation status is warn' END) AS warns FROM r)
    SELECT package, expected_styles, matched_styles, """ + PCT.format(a="matched_styles", b="expected_styles") + """ AS coverage_pct, below_cmap, below_features, trial_assets, fails AS fail_reasons, warns AS warn_reasons,
      CASE WHEN invalid_fonts > 0 OR italic_mismatches > 0 THEN 'warn' ELSE 'likely-safe' END AS print_readiness, CASE WHEN fails <> '' THEN 'fail' WHEN warns <> '' THEN 'warn' ELSE 'pass' END AS verdict FROM w""",
)
def _(spark, sf):
    # two joins and two aggregates read the best files: they are written out once
    observed = by_shuffle(cut_lineage(observed_metrics(spark, sf)))
    summary = pk.validation_summary(state(spark, sf)).select("package", "invalid_fonts", "italic_mismatches", "status")
    trials = pk.trial_assets(fixture(spark, sf, "download_log")).groupBy("package").agg(F.count("*").alias("trial_assets"))
    profile = profile_rows(spark, sf).withColumn("fail_on_trial", C("package").endswith("0"))
    out = cv.quality_audit(expected_styles(spark, sf), observed, summary, trials, profile)
    return out.withColumn("fail_reasons", F.array_join("fail_reasons", "; ")).withColumn("warn_reasons", F.array_join("warn_reasons", "; "))


@query(
    "target_audit",
    HEAD + NAMES_CTE + SUMMARY_CTE + PROFILE_CTE + f""", te AS (SELECT DISTINCT package, {target_token_sql('style_label')} AS token FROM profiles WHERE NOT optional), tob AS (SELECT DISTINCT package, {target_token_sql('subfamily_name')} AS token FROM state WHERE is_valid AND NOT subset AND {target_token_sql('subfamily_name')} <> ''),
    c1 AS (SELECT e.package, count(*) AS expected_styles, count(o.token) AS matched_styles FROM te AS e LEFT JOIN tob AS o ON o.package = e.package AND o.token = e.token GROUP BY e.package), c2 AS (SELECT package, count(*) AS observed_styles FROM tob GROUP BY package),
    c3 AS (SELECT package, count(*) AS unexpected_styles FROM tob AS o WHERE NOT EXISTS (SELECT 1 FROM te AS e WHERE e.package = o.package AND e.token = o.token) GROUP BY package),
    c4 AS (SELECT package, count(*) AS missing_names FROM exn AS e WHERE NOT EXISTS (SELECT 1 FROM obn AS o WHERE o.package = e.package AND (starts_with(o.token, e.token) OR starts_with(e.token, o.token))) GROUP BY package),
    c5 AS (SELECT package, count(*) AS unexpected_names FROM obn AS o WHERE package IN (SELECT package FROM exn) AND NOT EXISTS (SELECT 1 FROM exn AS e WHERE o.package = e.package AND (starts_with(o.token, e.token) OR starts_with(e.token, o.token))) GROUP BY package),
    j AS (SELECT v.*, p.strict, coalesce(c1.expected_styles, 0) AS es, coalesce(matched_styles, 0) AS ms, coalesce(observed_styles, 0) AS os, coalesce(unexpected_styles, 0) AS us, coalesce(missing_names, 0) AS mn, coalesce(unexpected_names, 0) AS un FROM verdict AS v
      LEFT JOIN c1 ON c1.package = v.package LEFT JOIN c2 ON c2.package = v.package LEFT JOIN c3 ON c3.package = v.package LEFT JOIN c4 ON c4.package = v.package LEFT JOIN c5 ON c5.package = v.package LEFT JOIN profile AS p ON p.package = v.package)
    SELECT package, es AS expected_styles, ms AS matched_styles, os AS observed_styles, us AS unexpected_styles, mn AS missing_names, un AS unexpected_names, """ + PCT.format(a="ms", b="es") + """ AS style_accuracy_pct, round(contamination_fonts / total_files, 4) AS contamination_ratio,
      CASE WHEN desktop_fonts = 0 OR valid_fonts = 0 THEN 'high-risk' WHEN invalid_fonts + name_table_bad_fonts + italic_mismatches > 0 OR desktop_full_fonts < desktop_fonts THEN 'warn' ELSE 'likely-safe' END AS print_readiness,
      CASE WHEN status = 'fail' OR (strict AND es = 0 AND os > 0) OR (es > 0 AND ms = 0) OR (contamination_fonts > 0 AND contamination_fonts / total_files >= 0.3) THEN 'fail' WHEN es > ms OR mn + invalid_fonts + contamination_fonts + italic_mismatches + name_table_bad_fonts > 0 THEN 'warn' ELSE 'pass' END AS verdict FROM j""",
)
def _(spark, sf):
    expected = expected_styles(spark, sf, target_style_token)
    observed = by_shuffle(cut_lineage(cv.styles_of(full_fonts(spark, sf), "subfamily_name", target_style_token(C("subfamily_name")))))
    summary = pk.validation_summary(state(spark, sf))
    names_ = by_shuffle(cut_lineage(expected_names(spark, sf))), by_shuffle(cut_lineage(observed_names(spark, sf)))
    return cv.target_audit(expected, observed, *names_, summary, profile_rows(spark, sf))


def tokens_sql(label: str) -> str:
    sp = spelled_sql(label)
    return f"list_filter(list_distinct(list_transform(list_concat([{sp}, {label}], {candidates_sql(flat_sql(sp))}), lambda c: {sheet_token_sql('c')})), lambda t: t <> '')"




@query(
    "sample_coverage",
    FX + STATE_CTE + f""", pkgs AS (SELECT package, row_number() OVER (ORDER BY package) - 1 AS n FROM (SELECT DISTINCT package FROM profiles) AS q),
    sp0 AS (SELECT p.package, doc_id AS pos, unnest({candidates_sql('t')}) AS label FROM (SELECT doc_id, {flat_sql('text || ' + _SEED)} AS t FROM documents) AS x JOIN pkgs AS p ON p.n = x.doc_id % (SELECT count(*) FROM pkgs)),
    sp AS (SELECT package, arg_min(label, pos) AS label FROM sp0 GROUP BY package, lower(label)), st AS (SELECT DISTINCT package, unnest({tokens_sql('label')}) AS token FROM sp),
    exl AS (SELECT package, arg_min(label, pos) AS label, min(pos) AS pos FROM (SELECT package, pos, {d.space('style_label')} AS label FROM profiles) AS q GROUP BY package, lower(label)),
    obl AS (SELECT package, arg_min(label, pos) AS label, min(pos) AS pos FROM (SELECT package, pos, {d.space('subfamily_name')} AS label FROM state WHERE is_valid AND NOT subset) AS q WHERE label <> '' GROUP BY package, lower(label)),
    eh AS (SELECT e.package, e.label, e.pos, EXISTS (SELECT 1 FROM st AS s WHERE s.package = e.package AND list_contains({tokens_sql('e.label')}, s.token)) AS hit FROM exl AS e),
    oh AS (SELECT e.package, e.label, e.pos, EXISTS (SELECT 1 FROM st AS s WHERE s.package = e.package AND list_contains({tokens_sql('e.label')}, s.token)) AS hit FROM obl AS e),
    ea AS (SELECT package, count(*) AS n, count(*) FILTER (WHERE hit) AS m, string_agg(label, ',' ORDER BY pos) FILTER (WHERE NOT hit) AS miss FROM eh GROUP BY package), oa AS (SELECT package, count(*) AS n, count(*) FILTER (WHERE hit) AS m FROM oh GROUP BY package), sa AS (SELECT package, count(*) AS n FROM sp GROUP BY package)
    SELECT ea.package, ea.n AS expected_styles, coalesce(oa.n, 0) AS observed_styles, coalesce(sa.n, 0) AS sheet_styles, ea.m AS expected_matched, coalesce(oa.m, 0) AS observed_matched, """ + PCT.format(a="ea.m", b="ea.n") + " AS expected_pct, " + PCT.format(a="oa.m", b="oa.n") + """ AS observed_pct, coalesce(miss, '') AS missing,
      CASE WHEN sa.n IS NULL THEN 'fail' WHEN ea.n > ea.m THEN 'warn' ELSE 'pass' END AS status FROM ea LEFT JOIN oa ON oa.package = ea.package LEFT JOIN sa ON sa.package = ea.package""",
)
def _(spark, sf):
    from pyspark.sql import Window

    from glyphlake.operators.documents import style_candidates

    profiles = fixture(spark, sf, "profiles")
    # the packages are numbered only to pair them with document numbers here
    pkgs = profiles.select("package").distinct().select("package", (F.row_number().over(Window.orderBy("package")) - 1).alias("n"))
    # every document belongs to a package: ids modulo the number of packages
    count = max(1, profiles.select("package").distinct().count())
    # labels are read where the texts are: these do not move
    spoken = seeded_documents(spark, sf).select((C("doc_id") % count).alias("n"), C("doc_id").alias("pos"), F.explode(style_candidates(C("text"))).alias("label"))
    sheet = spoken.join(pkgs, "n").select("package", "pos", "label")
    expected = profiles.select("package", "pos", C("style_label").alias("label"))
    observed = full_fonts(spark, sf).select("package", "pos", C("subfamily_name").alias("label"))
    out = cv.sample_coverage(expected, observed, sheet)
    return out.select("package", "expected_styles", "observed_styles", "sheet_styles", "expected_matched", "observed_matched", "expected_pct", "observed_pct", F.array_join("expected_missing", ",").alias("missing"), "status")
