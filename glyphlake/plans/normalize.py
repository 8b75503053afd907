"""Queries over names, styles, weights, formats and reasons."""

from __future__ import annotations

from pyspark.sql import functions as F

from glyphlake import fixed_values as fv
from glyphlake.functions import files, styles, text
from glyphlake.plans import sql_text as d
from glyphlake.plans.fixtures import fixture, with_fixtures
from glyphlake.plans.registry import query, table

C = F.col

SUFFIX_RULES = "suffix_rules AS (" + " UNION ALL ".join(
    f"SELECT {i} AS ord, {d.lit(p)} AS pat, {d.lit(n)} AS label, {d.lit(w)} AS weight, {d.lit(s)} AS style"
    for i, (p, n, w, s) in enumerate(fv.STYLE_SUFFIXES)
) + ")"


def suffix_sql(x: str) -> str:
    """Struct {family,label,weight,style} of the first fitting rule, else NULL."""
    v = d.space(x)
    rest = f"regexp_replace({v}, pat, '')"
    return (
        f"(SELECT arg_min({{'family': {d.space(rest)}, 'label': label, 'weight': weight, 'style': style}}, ord) FROM suffix_rules "
        f"WHERE regexp_matches({v}, pat) AND length({d.token(rest)}) >= 3)"
    )


def humanize_sql(x: str) -> str:
    return d.space(d.rep_all(x, [("[?#].*$", ""), (r"\.[^.]+$", ""), (r"(?i)\.p\b", " "), ("[_-]+", " "), ("([A-Z]+)([A-Z][a-z])", r"\1 \2"), ("([a-z0-9])([A-Z])", r"\1 \2"), (r"(?i)\b[0-9a-f]{8,}\b", " ")]))


def weight_sql(x: str) -> str:
    v = f"lower({d.space(x)})"
    return f"CASE WHEN regexp_matches({v}, '^[0-9]+ [0-9]+$') THEN CAST(split_part({v}, ' ', 1) AS DOUBLE) WHEN {v} = 'normal' THEN 400 WHEN {v} = 'bold' THEN 700 ELSE try_cast({v} AS DOUBLE) END"


def ladder_sql(v: str, steps) -> str:
    return "CASE " + " ".join(f"WHEN {v} <= {b} THEN '{n}'" for b, n in steps) + " ELSE 'Black' END"


def css_label_sql(weight: str, style: str, variable: str) -> str:
    base = f"CASE WHEN ({weight_sql(weight)}) IS NULL THEN 'Regular' ELSE {ladder_sql('(' + weight_sql(weight) + ')', fv.CSS_WEIGHT_STEPS)} END"
    it = f"regexp_matches(lower({style}), 'italic|oblique')"
    return f"CASE WHEN {variable} THEN CASE WHEN {it} THEN 'Italic' ELSE 'Regular' END WHEN {it} AND ({base}) = 'Regular' THEN 'Italic' WHEN {it} THEN ({base}) || ' Italic' ELSE {base} END"


def score_sql(label: str, weight: str, style: str) -> str:
    return (
        f"(CASE WHEN lower({label}) IN ('regular', 'italic') THEN 0 ELSE 4 END + CASE WHEN {style} = 'Italic' OR contains(lower({label}), 'italic') THEN 2 ELSE 0 END"
        f" + coalesce(least(5, CAST(floor(abs(try_cast({weight} AS DOUBLE) - 400) / 100 + 0.5) AS INT)), 0))"
    )


def alias_sql(family: str, label: str) -> str:
    n = d.space(family)
    base = f"CASE WHEN {d.token('s.label')} = {d.token(label)} THEN s.family ELSE v END"
    one = f"CASE WHEN regexp_matches(lower({label}), '^(regular|italic|regular italic)$') THEN {d.rep('b', '(?i)[ ]+Normal$')} ELSE b END"
    two = f"CASE WHEN regexp_matches(lower({label}), 'bold|black|heavy|extra') THEN {d.rep('n', '(?i)[ ]+Extra$')} ELSE n END"
    return (
        f"(SELECT {d.space(two)} FROM (SELECT {one} AS n FROM (SELECT {base} AS b FROM (SELECT v, {suffix_sql('v')} AS s FROM (SELECT {n} AS v) AS q0) AS q1) AS q2) AS q3)"
    )


@query("normalize_token", f"SELECT p_partkey, {d.token('p_name || p_brand')} AS token, {d.space(chr(39) + '  ' + chr(39) + ' || p_name || chr(9) || chr(10) || p_type')} AS spaced, {d.title('p_name || ' + chr(39) + '-_ ' + chr(39) + ' || p_type')} AS title FROM part")
def _(spark, sf):
    return table(spark, sf, "part").select(
        "p_partkey",
        text.normalize_token(F.concat("p_name", "p_brand")).alias("token"),
        text.normalize_space(F.concat(F.lit("  "), C("p_name"), F.lit("\t\n"), C("p_type"))).alias("spaced"),
        text.title_words(F.concat(C("p_name"), F.lit("-_ "), C("p_type"))).alias("title"),
    )


_WEIGHTS = ["400", "normal", "Bold", "100 900", " 250 ", "950", "heavy", "", "650", "Extra-Light", "Ultra Bold", "demi-bold", "hairline", "Book", "roman", "poster face", "350", "131", "0"]
_W_SQL = f"{d.words(_WEIGHTS)}[p_partkey % {len(_WEIGHTS)} + 1]"


def _weights(spark, sf):
    options = F.array(*[F.lit(w) for w in _WEIGHTS])
    return table(spark, sf, "part").select("p_partkey", "p_size", F.get(options, (C("p_partkey") % len(_WEIGHTS)).cast("int")).alias("w"))


@query(
    "weight_labels",
    f"""WITH x AS (SELECT p_partkey, p_size, {_W_SQL} AS w FROM part), y AS (SELECT *, {weight_sql('w')} AS v, trim(w) AS t FROM x)
    SELECT p_partkey, v AS weight_value, CASE WHEN v IS NULL THEN 'Regular' ELSE {ladder_sql('v', fv.CSS_WEIGHT_STEPS)} END AS css_label,
      CASE WHEN t = '' THEN 'Regular' WHEN regexp_matches(t, '^[0-9]{{2,4}} +[0-9]{{2,4}}$') THEN 'Variable' WHEN try_cast(t AS DOUBLE) IS NOT NULL THEN {ladder_sql('try_cast(t AS DOUBLE)', fv.NAME_WEIGHT_STEPS)}
        {' '.join(f"WHEN regexp_matches(lower(t), {d.lit(p)}) THEN {d.lit(n)}" for p, n in fv.NAME_WEIGHT_WORDS)} ELSE {d.title('t')} END AS name_label,
      CASE WHEN v IS NULL THEN NULL WHEN abs(v - greatest(100, least(900, ceil((v - 50) / 100) * 100))) <= 60
        THEN ['Thin','ExtraLight','Light','Regular','Medium','SemiBold','Bold','ExtraBold','Black'][CAST(greatest(1, least(9, ceil((v - 50) / 100))) AS INT)] END AS nearest_label FROM y""",
)
def _(spark, sf):
    w = C("w")
    return _weights(spark, sf).select(
        "p_partkey",
        styles.weight_value(w).alias("weight_value"),
        styles.css_weight_label(styles.weight_value(w)).alias("css_label"),
        styles.name_weight_label(w).alias("name_label"),
        styles.nearest_weight_label(styles.weight_value(w)).alias("nearest_label"),
    )


_SLOPES = ["normal", "italic", "Oblique", "kursiv", "slanted", "oblique 10deg"]
_S_SQL = f"{d.words(_SLOPES)}[p_size % {len(_SLOPES)} + 1]"


@query(
    "style_labels",
    f"""WITH x AS (SELECT p_partkey, {_W_SQL} AS w, {_S_SQL} AS s, p_partkey%11=0 AS variable FROM part) SELECT p_partkey, {css_label_sql('w', 's', 'variable')} AS label,
      CASE WHEN regexp_matches(s, '(?i)italic|kursiv|slanted|oblique') THEN 'Italic' ELSE 'Normal' END AS slope FROM x""",
)
def _(spark, sf):
    slopes = F.array(*[F.lit(s) for s in _SLOPES])
    df = _weights(spark, sf).withColumn("s", F.get(slopes, C("p_size") % len(_SLOPES)))
    return df.select(
        "p_partkey",
        styles.css_style_label(C("w"), C("s"), C("p_partkey") % 11 == 0).alias("label"),
        styles.slope_label(C("s")).alias("slope"),
    )


_TAILS = ["Bold", "semi bold italic", "UltraLight", "regular italic", "Book", "Normal", "heavy italic", "Wide", "Extra Bold", "italic", "Black", "normal italic"]
_T_SQL = f"{d.words(_TAILS)}[p_partkey % {len(_TAILS)} + 1]"
_LABEL_SQL = f"CASE WHEN p_partkey%7=0 THEN {_T_SQL} ELSE p_name || '  ' || {_T_SQL} END"


def _labels(spark, sf):
    tail = F.get(F.array(*[F.lit(s) for s in _TAILS]), (C("p_partkey") % len(_TAILS)).cast("int"))
    return table(spark, sf, "part").select(
        "p_partkey", "p_name", "p_size", F.when(C("p_partkey") % 7 == 0, tail).otherwise(F.concat(C("p_name"), F.lit("  "), tail)).alias("label")
    )


@query(
    "style_suffix",
    f"""WITH {SUFFIX_RULES}, x AS (SELECT p_partkey, {_LABEL_SQL} AS label FROM part), y AS (SELECT p_partkey, label, {suffix_sql('x.label')} AS s FROM x)
    SELECT p_partkey, label, s.family AS family, s.label AS style_label, s.weight AS weight, s.style AS slope, CASE WHEN s IS NOT NULL THEN {score_sql('s.label', 's.weight', 's.style')} END AS score FROM y""".replace("'label': label", "'label': suffix_rules.label"),
)
def _(spark, sf):
    df = _labels(spark, sf).withColumn("s", styles.style_suffix(C("label")))
    return df.select(
        "p_partkey", "label", C("s.family").alias("family"), C("s.label").alias("style_label"), C("s.weight").alias("weight"), C("s.style").alias("slope"),
        F.when(C("s").isNotNull(), styles.signal_score(C("s.label"), C("s.weight"), C("s.style"))).alias("score"),
    )


_RAW_SQL = "CASE p_partkey%4 WHEN 0 THEN replace(p_name,' ','_') || '-Regular.woff2?v=2' WHEN 1 THEN 'GTStandard' || upper(p_name[1:1]) || p_name[2:] || ' Normal' WHEN 2 THEN p_name || ' deadbeef99 Extra' ELSE p_name || ' Bold' END"
_RL_SQL = "CASE p_size%3 WHEN 0 THEN 'Regular' WHEN 1 THEN 'Bold' ELSE 'Italic' END"


@query(
    "humanize_label",
    f"""WITH {SUFFIX_RULES}, x AS (SELECT p_partkey, {_RAW_SQL} AS raw, {_RL_SQL} AS lab FROM part), y AS (SELECT *, {humanize_sql('raw')} AS human FROM x)
    SELECT p_partkey, human, {alias_sql('y.human', 'y.lab')} AS alias FROM y""",
)
def _(spark, sf):
    k, name = C("p_partkey"), C("p_name")
    raw = (
        F.when(k % 4 == 0, F.concat(F.replace(name, F.lit(" "), F.lit("_")), F.lit("-Regular.woff2?v=2")))
        .when(k % 4 == 1, F.concat(F.lit("GTStandard"), F.upper(F.substring(name, 1, 1)), F.substring(name, 2, 100), F.lit(" Normal")))
        .when(k % 4 == 2, F.concat(name, F.lit(" deadbeef99 Extra")))
        .otherwise(F.concat(name, F.lit(" Bold")))
    )
    lab = F.when(C("p_size") % 3 == 0, "Regular").when(C("p_size") % 3 == 1, "Bold").otherwise("Italic")
    df = table(spark, sf, "part").select("p_partkey", styles.humanize_label(raw).alias("human"), lab.alias("lab"))
    return df.select("p_partkey", "human", styles.family_alias(C("human"), C("lab")).alias("alias"))


def quality_token_sql(x: str) -> str:
    t = d.rep_all(f"lower({x})", fv.QUALITY_STYLE_REWRITES)
    return (
        f"(SELECT CASE WHEN t IN ('italic','oblique','regularoblique','variableitalic','variableoblique') THEN 'regularitalic' WHEN t = 'variable' THEN 'regular' WHEN t = '' THEN ''"
        f" ELSE (SELECT CASE WHEN ends_with(e, 'italic') AND NOT regexp_matches(e, {d.lit(fv.QUALITY_WEIGHTED_ITALIC)}) THEN e[:-7] || 'regularitalic' ELSE e END FROM"
        f" (SELECT replace(CASE WHEN ends_with(t, 'variableitalic') THEN t[:-15] || 'regularitalic' WHEN ends_with(t, 'variableoblique') THEN t[:-16] || 'regularitalic'"
        f" WHEN ends_with(t, 'variable') THEN t[:-9] || 'regular' WHEN ends_with(t, 'oblique') THEN t[:-8] || 'italic' ELSE t END, 'variable', '') AS e) AS ee) END FROM (SELECT {t} AS t) AS tt)"
    )


def sheet_token_sql(x: str) -> str:
    t = d.token(x)
    return f"CASE WHEN {t} IN ('italic','oblique','regularoblique') THEN 'regularitalic' WHEN ends_with({t}, 'oblique') THEN {t}[:-8] || 'italic' ELSE {t} END"


def target_token_sql(x: str) -> str:
    return d.rep_all(f"lower({x})", fv.TARGET_STYLE_REWRITES)


@query(
    "style_token",
    with_fixtures("profiles", "file_metrics") + f""", labels AS (SELECT package, style_label AS label FROM profiles UNION SELECT package, {d.rep('filename', '[.][^.]*$')} FROM file_metrics UNION SELECT package, p_label FROM (SELECT package, 'Sans ' || style_label || ' VF' AS p_label FROM profiles) AS q)
    SELECT package, label, {quality_token_sql('label')} AS quality, {sheet_token_sql('label')} AS sheet, {target_token_sql('label')} AS target FROM labels""",
)
def _(spark, sf):
    profiles = fixture(spark, sf, "profiles")
    labels = (
        profiles.select("package", C("style_label").alias("label"))
        .union(profiles.select("package", F.concat(F.lit("Sans "), C("style_label"), F.lit(" VF"))))
        .union(fixture(spark, sf, "file_metrics").select("package", F.regexp_replace("filename", "[.][^.]*$", "")))
        .distinct()
    )
    return labels.select(
        "package", "label",
        styles.quality_style_token(C("label")).alias("quality"),
        styles.sheet_style_token(C("label")).alias("sheet"),
        styles.target_style_token(C("label")).alias("target"),
    )


def stem_sql(x: str) -> str:
    return f"lower({d.rep(d.rep(d.rep(d.space(x), '&', ' and '), '[^A-Za-z0-9]+', '-'), '^-+|-+$')})"


@query(
    "safe_name",
    rf"""WITH x AS (SELECT p_partkey, CASE p_partkey%5 WHEN 0 THEN '123456789-' || p_name || ' & Co.' WHEN 1 THEN repeat(p_name || '! ', 20) WHEN 2 THEN '***' WHEN 3 THEN p_name || '-web' ELSE p_name END AS raw FROM part)
    SELECT p_partkey, coalesce(nullif(trim({d.space(d.rep('raw', '[^a-zA-Z0-9 _-]+'))}), ''), 'font-file') AS safe, {stem_sql('raw')} AS stem,
      CASE WHEN {stem_sql('raw')} <> '' THEN {stem_sql('raw')} || '-semi-bold' END AS hint, {d.rep('raw', '^[0-9]{8,}-')} AS unprefixed, coalesce(nullif({d.trim_all(d.rep(d.trim_all('raw'), '(?i)[-_ ]+web$'))}, ''), raw) AS desktop FROM x""",
)
def _(spark, sf):
    k, name = C("p_partkey"), C("p_name")
    raw = (
        F.when(k % 5 == 0, F.concat(F.lit("123456789-"), name, F.lit(" & Co.")))
        .when(k % 5 == 1, F.repeat(F.concat(name, F.lit("! ")), 20))
        .when(k % 5 == 2, F.lit("***"))
        .when(k % 5 == 3, F.concat(name, F.lit("-web")))
        .otherwise(name)
    )
    r = C("raw")
    return table(spark, sf, "part").select("p_partkey", raw.alias("raw")).select(
        "p_partkey", text.safe_file_name(r).alias("safe"), text.file_stem(r).alias("stem"),
        text.file_name_hint(r, F.lit("Semi Bold")).alias("hint"), text.strip_numeric_prefix(r).alias("unprefixed"),
        text.strip_web_suffix(r).alias("desktop"),
    )


def name_weight_sql(t: str) -> str:
    return (
        f"CASE WHEN {t} = '' THEN 'Regular' WHEN try_cast({t} AS DOUBLE) IS NOT NULL THEN {ladder_sql(f'try_cast({t} AS DOUBLE)', fv.NAME_WEIGHT_STEPS)} "
        + " ".join(f"WHEN regexp_matches(lower({t}), {d.lit(p)}) THEN {d.lit(n)}" for p, n in fv.NAME_WEIGHT_WORDS)
        + f" ELSE {d.title(t)} END"
    )


@query(
    "display_name",
    with_fixtures("file_metrics") + f""", x AS (SELECT path, family_name, CASE WHEN pos%5=0 THEN full_name END AS full_name, coalesce(subfamily_name, '') AS sub, ext, CASE WHEN pos%3=0 THEN 'display' WHEN pos%3=1 THEN 'ring' END AS category FROM file_metrics),
    y AS (SELECT *, coalesce(nullif({d.title("coalesce(family_name, '')")}, ''), 'Unknown') AS fam, {d.title("coalesce(category, '')")} AS cat,
      CASE WHEN regexp_matches(sub, '(?i)italic|oblique') THEN CASE WHEN ({name_weight_sql('sub')}) = 'Regular' THEN 'Italic' ELSE ({name_weight_sql('sub')}) || ' Italic' END ELSE {name_weight_sql('sub')} END AS subf FROM x)
    SELECT path, coalesce(nullif({d.space('full_name')}, ''), CASE WHEN cat = '' OR contains(replace(lower(fam), ' ', ''), replace(lower(cat), ' ', '')) THEN fam ELSE fam || ' ' || cat END || ' ' || subf) || ' (' || ext || ')' AS display FROM y""",
)
def _(spark, sf):
    pos = C("pos")
    name = styles.display_name(
        C("family_name"), F.coalesce("subfamily_name", F.lit("")), C("subfamily_name"),
        F.when(pos % 3 == 0, "display").when(pos % 3 == 1, "ring"), C("ext"), F.lit(None).cast("string"), F.when(pos % 5 == 0, C("full_name")),
    )
    return fixture(spark, sf, "file_metrics").select("path", name.alias("display"))


@query(
    "needs_name_repair",
    with_fixtures("file_metrics", "download_log") + rf""", n AS (SELECT filename FROM file_metrics UNION SELECT filename FROM download_log UNION SELECT 'lineto-font-' || filename FROM file_metrics), s AS (SELECT filename, lower({d.rep('filename', '[.][^.]*$')}) AS stem FROM n)
    SELECT filename, stem IN ('font', 'unknown') OR regexp_matches(stem, '^(lineto|pangram|abcdinamo|klim)-font') OR regexp_matches(stem, '[a-f0-9]{{16,}}') OR regexp_matches(stem, '[a-f0-9]{{8}}-[a-f0-9]{{4}}-[a-f0-9]{{4}}') OR regexp_matches(stem, '^[0-9]{{3,}}$') AS repair,
      regexp_matches(stem, '[a-z]') AND NOT regexp_matches(stem, '^[a-f0-9]{{12,}}$') AS safe FROM s""",
)
def _(spark, sf):
    metrics = fixture(spark, sf, "file_metrics").select("filename")
    names = metrics.union(fixture(spark, sf, "download_log").select("filename")).union(metrics.select(F.concat(F.lit("lineto-font-"), C("filename")))).distinct()
    return names.select("filename", files.needs_name_repair(C("filename")).alias("repair"), files.is_safe_name(text.without_extension(C("filename"))).alias("safe"))


@query(
    "can_repair_names",
    with_fixtures("file_metrics") + f""" SELECT path, coalesce(regexp_matches({d.trim_all('family_name')}, '(?i)[a-z]') AND regexp_matches({d.trim_all('subfamily_name')}, '(?i)[a-z]'), false) AS repairable FROM file_metrics""",
)
def _(spark, sf):
    return fixture(spark, sf, "file_metrics").select("path", F.coalesce(files.can_repair_names(C("family_name"), C("subfamily_name")), F.lit(False)).alias("repairable"))


@query(
    "classify_license",
    r"""WITH l AS (SELECT doc_id, lower(regexp_extract(text, '(?im)^.*\b(licen[cs]e[sd]?|copyright|all rights reserved)\b.*$', 0)) AS line FROM documents)
    SELECT doc_id, CASE WHEN line = '' THEN 'unknown' WHEN regexp_matches(line, '\b(ofl|open font|apache|mit|cc0|cc-0|public domain|ufl)\b') THEN 'open'
      WHEN regexp_matches(line, 'proprietary|all rights reserved|restricted|no permission|without permission') THEN 'restricted' ELSE 'unknown' END AS license_class FROM l""",
)
def _(spark, sf):
    return table(spark, sf, "documents").select("doc_id", files.text_license_class(C("text")).alias("license_class"))




def says_sql(x: str) -> str:
    t = d.token(f"coalesce({x}, '')")
    return f"(contains({t}, 'italic') OR contains({t}, 'oblique') OR ends_with({t}, 'ital'))"


ITALIC_CTE = f""", italics AS (SELECT *, {says_sql('filename')} AS file_italic, CASE WHEN is_valid THEN {says_sql('subfamily_name')} OR {says_sql('full_name')} OR {says_sql('postscript_name')} END AS declared FROM file_metrics),
  effective AS (SELECT *, CASE WHEN declared THEN true WHEN NOT declared THEN file_italic ELSE flag_italic END AS eff FROM italics)"""


@query(
    "effective_italic",
    with_fixtures("file_metrics") + ITALIC_CTE + " SELECT path, file_italic, declared, eff AS effective, coalesce(file_italic <> eff, false) AS mismatch FROM effective",
)
def _(spark, sf):
    from glyphlake.operators.packages import with_italic_state

    return with_italic_state(fixture(spark, sf, "file_metrics")).select(
        "path", "file_italic", C("declared_italic").alias("declared"), C("effective_italic").alias("effective"), C("italic_mismatch").alias("mismatch")
    )


@query(
    "signature_mismatch",
    with_fixtures("file_metrics") + " SELECT path, ext, signature, coalesce(ext <> signature, false) AS mismatch FROM file_metrics",
)
def _(spark, sf):
    return fixture(spark, sf, "file_metrics").select("path", "ext", "signature", files.signature_mismatch(C("ext"), C("signature")).alias("mismatch"))


def issues_sql(prefix: str = "") -> str:
    bad = lambda c: f"coalesce({d.trim_all(c)} IN ('', '.'), true)"
    return (
        f"list_filter([CASE WHEN {bad('family_name')} THEN 'no usable family name (ids 16, 1)' END, CASE WHEN {bad('subfamily_name')} THEN 'no usable style name (ids 17, 2)' END,"
        f" CASE WHEN {bad('full_name')} THEN 'no usable full name (id 4)' END, CASE WHEN {bad('postscript_name')} THEN 'no usable PostScript name (id 6)' END], lambda i: i IS NOT NULL)"
    )


@query("name_sanity", with_fixtures("file_metrics") + f" SELECT path, array_to_string({issues_sql()}, '; ') AS issues, len({issues_sql()}) = 0 AS ok FROM file_metrics")
def _(spark, sf):
    df = fixture(spark, sf, "file_metrics").withColumn("i", files.name_issues(C("family_name"), C("subfamily_name"), C("full_name"), C("postscript_name")))
    return df.select("path", F.array_join("i", "; ").alias("issues"), (F.size("i") == 0).alias("ok"))


@query(
    "subset_evidence",
    with_fixtures("file_metrics") + " SELECT path, concat_ws(',', CASE WHEN glyph_count < 50 THEN 'glyph_count<50' END, CASE WHEN cmap_entries BETWEEN 1 AND 49 THEN 'cmap_entries<50' END) AS evidence FROM file_metrics",
)
def _(spark, sf):
    return fixture(spark, sf, "file_metrics").select("path", F.array_join(files.subset_evidence(C("glyph_count"), C("cmap_entries")), ",").alias("evidence"))


def validation_tokens_sql(raw: str) -> str:
    """All tokens of one phrase, before the length test, as a list."""
    stop = d.words(fv.VALIDATION_STOPWORDS)
    parts = f"list_filter(regexp_split_to_array(lower({raw}), '[^a-z0-9]+'), lambda p: p <> '')"
    kept = f"list_filter({parts}, lambda p: NOT list_contains({stop}, p))"
    return f"[array_to_string({parts}, ''), CASE WHEN len({parts}) > 1 THEN ({parts})[1] END, array_to_string({kept}, ''), ({kept})[1]]"


@query(
    "validation_tokens",
    rf"""WITH pieces AS (SELECT page_id, {d.rep(d.ext("lower(url)", "^https?://([^/?#:]+)"), "[.](com|net|org|xyz|co|uk|dev|io|ai)$")} AS piece FROM pages
        UNION ALL SELECT page_id, {d.rep("unnest(string_split(" + d.path("url") + ", '/'))", "(?i)[.][a-z0-9]+$")} FROM pages),
      toks AS (SELECT page_id, unnest({validation_tokens_sql('piece')}) AS t FROM pieces WHERE piece <> '')
    SELECT page_id, string_agg(DISTINCT t, ' ' ORDER BY t) AS tokens FROM toks WHERE length(t) BETWEEN 4 AND 40 AND NOT starts_with(t, 'http') AND NOT contains(t, 'www') GROUP BY page_id""",
)
def _(spark, sf):
    toks = files.sanitized_tokens(files.validation_tokens(C("url")))
    df = table(spark, sf, "pages").select("page_id", F.array_sort(toks).alias("t"))
    return df.filter(F.size("t") > 0).select("page_id", F.array_join("t", " ").alias("tokens"))


REASON_CASE = "CASE WHEN lower({x}) = '' THEN 'unknown' " + " ".join(f"WHEN contains(lower({{x}}), {d.lit(p)}) THEN {d.lit(c)}" for p, c in fv.REASON_CODES) + " ELSE 'other' END"


@query("reason_taxonomy", with_fixtures("download_log") + f" SELECT job_id, idx, reason, {REASON_CASE.format(x='reason')} AS code FROM download_log")
def _(spark, sf):
    return fixture(spark, sf, "download_log").select("job_id", "idx", "reason", files.reason_code(C("reason")).alias("code"))


@query(
    "format_tokens",
    with_fixtures("profiles") + """, x AS (SELECT package, pos, required_tags || ', WOFF2 ,otf,woff2, ' || source_limited AS raw FROM profiles)
    SELECT package, pos, array_to_string(list_concat(['woff2', 'otf'], CASE WHEN contains(raw, 'ttf') THEN ['ttf'] ELSE [] END), ',') AS formats FROM x""",
)
def _(spark, sf):
    raw = F.concat("required_tags", F.lit(", WOFF2 ,otf,woff2, "), "source_limited")
    return fixture(spark, sf, "profiles").select("package", "pos", F.array_join(files.format_tokens(raw), ",").alias("formats"))


@query(
    "expected_formats",
    with_fixtures("file_metrics") + rf""", k AS (SELECT DISTINCT {d.rep('lower(' + d.rep('filename', '[.][^.]*$') + ')', ' +', '-')} AS key FROM file_metrics)
    SELECT key, CASE WHEN contains(key, 'variable') THEN 'woff,ttf' ELSE 'woff,otf' END AS formats FROM k""",
)
def _(spark, sf):
    keys = fixture(spark, sf, "file_metrics").select(files.group_key(C("filename")).alias("key")).distinct()
    return keys.select("key", F.array_join(files.expected_formats(C("key"), F.array(F.lit("woff2"))), ",").alias("formats"))
