"""Expected against observed: matches, gaps, surplus, and the audits on top.

Tables are keyed by ``package``.  A package's expected styles are a short
profile, so they travel as one array per package; observed rows are reduced to
distinct tokens first.  No step emits pairs of a package's rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glyphlake.functions.styles import quality_style_token, sheet_style_token
from glyphlake.functions.text import let, normalize_space, trim_all, without_extension
from glyphlake.operators.documents import spelled_style, style_candidates
from glyphlake.operators.picking import computed, dedupe_first, first_by
from glyphlake.session import by_shuffle

C = F.col

#: an expected style of more characters is looked up by its first ones
FILED = 8


def styles_of(rows: DataFrame, label: str, token: Column, *extra: str) -> DataFrame:
    """(package, token, label, pos, ...): first label per style key."""
    keyed = computed(rows, token=token).select("package", "token", C(label).alias("label"), "pos", *extra)
    return dedupe_first(keyed.filter(C("token") != ""), ["package", "token"])


def _piece(kind: str, piece: Column, whole: Column | None = None) -> Column:
    parts = [F.lit(kind).alias("kind"), piece.alias("piece")]
    return F.struct(*parts, *([] if whole is None else [whole.alias("whole")]))


def _numbers(last: Column) -> Column:
    return F.when(last > 0, F.sequence(F.lit(1), last)).otherwise(F.array().cast("array<int>"))


def _offered(token: Column, sizes: Column) -> Column:
    """What an observed token can be found by: itself, its pieces of up to
    ``FILED`` characters, and with those of that length the whole token.
    ``sizes`` names the lengths asked for, more than ``FILED`` as one."""

    def of_size(size: int, kind: str, whole: Column) -> Column:
        asked = F.array_contains(sizes, size if kind == "part" else FILED + 1)
        starts = _numbers(F.when(asked, F.length(token) - (size - 1)).otherwise(F.lit(0)))
        return F.transform(starts, lambda i: _piece(kind, F.substring(token, i, F.lit(size)), whole))

    parts = [of_size(size, "part", F.lit("")) for size in range(1, FILED + 1)]
    return F.concat(F.array(_piece("whole", token, F.lit(""))), *parts, of_size(FILED, "long", token))


def _asked(token: Column) -> Column:
    """Where an expected token is looked for: in a token that it starts with,
    and in one that contains it, by its first characters if it is long."""
    starts = F.transform(_numbers(F.length(token) - 1), lambda n: _piece("whole", F.left(token, n)))
    kind = F.when(F.length(token) > FILED, "long").otherwise("part")
    inside = F.struct(kind.alias("kind"), F.left(token, F.lit(FILED)).alias("piece"))
    return F.concat(starts, F.array(inside))


def style_coverage(expected: DataFrame, observed: DataFrame) -> DataFrame:
    """Add ``observed_token`` to every expected style, NULL when missing.

    An equal token wins; in family-style scope the first observed token that
    contains the expected one, or that it starts with, is taken next.  Both are
    equi-joins of a package's pieces: no list grows with a package, and a
    package with very many styles is spread over its pieces.
    """
    seen = observed.select("package", "token", "pos")
    exact = expected.join(
        seen.select("package", "token", C("token").alias("exact_token")), ["package", "token"], "left"
    )
    missing = exact.filter(C("exact_token").isNull() & (C("scope") == "family-style")).select("package", "token")
    # at most FILED + 1 lengths a package; packages that miss nothing go here
    sizes = by_shuffle(missing.groupBy("package").agg(F.collect_set(F.least(F.length("token"), F.lit(FILED + 1))).alias("sizes")))
    # equal pieces of a package's observed tokens are one row before they move
    offered = (
        seen.join(sizes, "package")
        .select("package", "pos", "token", F.inline(_offered(C("token"), C("sizes"))))
        .groupBy("package", "kind", "piece", "whole")
        .agg(F.min_by("token", "pos").alias("near_token"), F.min("pos").alias("pos"))
    )
    near = (
        missing.select("package", "token", F.inline(_asked(C("token"))))
        .join(by_shuffle(offered), ["package", "kind", "piece"])
        .filter((C("kind") != "long") | F.contains("whole", C("token")))
        .groupBy("package", "token")
        .agg(F.min_by("near_token", "pos").alias("near_token"))
    )
    return (
        exact.join(by_shuffle(near), ["package", "token"], "left")
        .withColumn("observed_token", F.coalesce("exact_token", "near_token"))
        .drop("exact_token", "near_token")
    )


def unexpected(observed: DataFrame, expected: DataFrame, optional: DataFrame | None = None) -> DataFrame:
    """Observed styles nobody asked for, in packages that ask for some.

    Optional styles (package, token) are taken out of both sides first.
    """
    asked, seen = expected, observed
    if optional is not None:
        asked = expected.join(optional, ["package", "token"], "left_anti")
        seen = observed.join(optional, ["package", "token"], "left_anti")
    asked = by_shuffle(asked)
    return (
        seen.join(asked.select("package", "token"), ["package", "token"], "left_anti")
        .join(asked.select("package").distinct(), "package", "left_semi")
    )


def _prefixes(names: DataFrame) -> DataFrame:
    """(package, token): every non-empty beginning of every name, once."""
    grown = F.transform(F.sequence(F.lit(1), F.length("token")), lambda i: F.left(C("token"), i))
    return names.select("package", F.explode(grown).alias("token")).distinct()


def without_prefix_match(left: DataFrame, right: DataFrame) -> DataFrame:
    """Names of ``left`` that neither begin, nor begin with, a name of ``right``.

    Both directions are equi-joins on whole prefixes: work grows with the
    number of names, not with their pairs.
    """
    grown = by_shuffle(left.select("package", "token", F.explode(
        F.transform(F.sequence(F.lit(1), F.length("token")), lambda i: F.left(C("token"), i))
    ).alias("_prefix")))
    continues = grown.join(
        right.select("package", C("token").alias("_prefix")), ["package", "_prefix"], "left_semi"
    ).select("package", "token").distinct()
    return left.join(by_shuffle(_prefixes(right)), ["package", "token"], "left_anti").join(
        by_shuffle(continues), ["package", "token"], "left_anti"
    )


def dominant_prefix(names: DataFrame) -> DataFrame:
    """Of three or more names with several prefixes, keep the most frequent
    prefixes (ties kept), unless every prefix occurs once."""
    keyed = names.withColumn("prefix", trim_all(F.substring_index("name", "-", 1)))
    counts = keyed.groupBy("package", "prefix").agg(F.count("*").alias("n"))
    named = C("prefix") != ""
    totals = counts.groupBy("package").agg(
        F.sum("n").alias("names"), F.count_if(named).alias("prefixes"), F.max(F.when(named, C("n"))).alias("most")
    )
    choice = counts.join(totals, "package").select(
        "package",
        "prefix",
        ((C("names") < 3) | (C("prefixes") <= 1) | (C("most") < 2) | (named & (C("n") == C("most")))).alias("_keep"),
    )
    return keyed.join(choice, ["package", "prefix"]).filter("_keep").drop("_keep", "prefix")


def intersect_or_fallback(catalog: DataFrame, session: DataFrame) -> DataFrame:
    """Session names the catalogue knows; where none is, the catalogue; where
    one side is empty, the other."""
    shared = session.join(catalog.select("package", "token"), ["package", "token"], "left_semi")
    hit = shared.select("package").distinct()
    only_session = session.join(catalog.select("package").distinct(), "package", "left_anti")
    fallback = catalog.join(hit, "package", "left_anti")
    return shared.unionByName(only_session).unionByName(fallback)


def file_style_candidates(filename: Column) -> Column:
    """Style keys a file name may spell: the whole stem and all its tails."""
    spaced = normalize_space(F.regexp_replace(without_extension(filename), "[_-]+", " "))

    def tails(s: Column) -> Column:
        words = F.split(s, " ")
        suffixes = F.transform(
            F.sequence(F.lit(1), F.size(words)), lambda i: F.array_join(F.slice(words, i, F.size(words)), " ")
        )
        every = F.concat(F.array(s, F.regexp_replace(s, r"(?i)\bweb\b", " ")), suffixes)
        return F.array_distinct(F.filter(F.transform(every, quality_style_token), lambda t: t != ""))

    return let(spaced, tails)


def style_from_filename(files: DataFrame, expected: DataFrame) -> DataFrame:
    """Add ``file_token``: the expected style a file name names best.

    Equality beats containment, longer tokens beat shorter ones; expected
    tokens arrive as one short array per package.
    """
    profile = expected.groupBy("package").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("pos", "token"))), lambda s: s["token"]).alias("wanted")
    )
    joined = files.join(profile, "package", "left").withColumn("_names", file_style_candidates(C("filename")))
    scored = F.flatten(
        F.transform(
            "_names",
            lambda c, ci: F.transform(
                F.coalesce("wanted", F.array().cast("array<string>")),
                lambda e, ei: F.struct(
                    F.when(c == e, 100000 + F.length(e))
                    .when(F.contains(c, e) | F.contains(e, c), F.length(e))
                    .otherwise(0)
                    .alias("score"),
                    (-ci).alias("ci"),
                    (-ei).alias("ei"),
                    e.alias("token"),
                ),
            ),
        )
    )
    best = let(F.array_max(scored), lambda b: F.when(b["score"] > 0, b["token"]))
    return joined.withColumn("file_token", best).drop("_names", "wanted")


def lookup_source(files: DataFrame, log: DataFrame) -> DataFrame:
    """Source URL of each file (package, path): that of the first log row of
    its package whose file has the same base name, whatever its case.

    Equal paths imply equal base names, and the first row wins on any ground,
    so one equi-join decides; the log is first reduced to its first row per
    name, so popular names do not multiply.
    """
    name = lambda path: F.lower(F.element_at(F.split(path, "/"), -1))
    firsts = log.groupBy("package", name(C("file_path")).alias("_name")).agg(F.min_by("source_url", "pos").alias("source_url"))
    return files.withColumn("_name", name(C("path"))).join(firsts, ["package", "_name"]).select("package", "path", "source_url")


def asset_style_lookup(assets: DataFrame, style_map: DataFrame) -> DataFrame:
    """Style name of each asset URL: exact key, else the first key with the
    same file name.  ``style_map``: (key, style_name, pos)."""
    key = F.lower(F.regexp_replace("asset_url", r"[?#].*$", ""))
    named = assets.withColumn("_key", key).withColumn("_file", F.element_at(F.split("_key", "/"), -1))
    exact = first_by(style_map, ["key"], [-C("pos")]).select(C("key").alias("_key"), C("style_name").alias("_exact"))
    by_file = first_by(
        exact.select(F.element_at(F.split("_key", "/"), -1).alias("_file"), C("_exact").alias("_near"), "_key"),
        ["_file"],
        [C("_key")],
    ).drop("_key")
    return (
        named.join(exact, "_key", "left")
        .join(by_file, "_file", "left")
        .withColumn("style_name", F.coalesce("_exact", "_near"))
        .drop("_key", "_file", "_exact", "_near")
    )


# --- audits --------------------------------------------------------------


def percent(part: Column, whole: Column, digits: int = 2) -> Column:
    """Rounded half up through DECIMAL; NULL for an empty whole."""
    ratio = part.cast("decimal(20,0)") * 100 / F.nullif(whole.cast("decimal(20,0)"), F.lit(0).cast("decimal(20,0)"))
    return F.round(ratio, digits).cast("double")


def with_fallback_styles(merged: DataFrame, rows: DataFrame) -> DataFrame:
    """Merged profiles; one without any signal expects the styles of the
    package's own rows (package, pos, label), once each, in order."""
    own = label_entries(rows, "label").groupBy("package").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("pos", "label"))), lambda s: s["label"]).alias("_own")
    )
    silent = (F.size("expected_styles") == 0) & (F.size("required_tags") == 0) & (C("min_cmap") == 0) & (C("min_features") == 0)
    styles = F.when(silent, F.coalesce("_own", F.array().cast("array<string>"))).otherwise(C("expected_styles"))
    return merged.join(own, "package", "left").withColumn("expected_styles", styles).drop("_own")


def merge_profiles(parts: DataFrame) -> DataFrame:
    """Fold ordered profile parts (package, pos, ...) into one per package.

    The last given scalar wins, the wider scope sticks, lists are replaced
    only by non-empty ones, thresholds must be positive.
    """

    def last(name: str, valid: Column) -> Column:
        return F.max_by(F.when(valid, C(name)), F.when(valid, C("pos"))).alias(name)

    merged = parts.groupBy("package").agg(
        F.when(F.bool_or(C("scope") == "family-style"), "family-style").otherwise("style").alias("scope"),
        last("strict", C("strict").isNotNull()),
        last("required_tags", F.size("required_tags") > 0),
        last("expected_styles", F.size("expected_styles") > 0),
        last("min_cmap", C("min_cmap") > 0),
        last("min_features", C("min_features") > 0),
    )
    none = F.array().cast("array<string>")
    return merged.select(
        "package",
        "scope",
        F.coalesce("strict", F.lit(False)).alias("strict"),
        F.transform(F.coalesce("required_tags", none), F.lower).alias("required_tags"),
        F.coalesce("expected_styles", none).alias("expected_styles"),
        F.coalesce("min_cmap", F.lit(0)).alias("min_cmap"),
        F.coalesce("min_features", F.lit(0)).alias("min_features"),
    )


def quality_audit(
    expected: DataFrame, metrics: DataFrame, summary: DataFrame, trials: DataFrame, profile: DataFrame
) -> DataFrame:
    """Style coverage and thresholds of each package, graded.

    ``metrics``: best file per (package, token) with cmap_entries, tags, pos.
    ``profile``: one row per package.  Everything after the coverage join is
    one aggregate per package.
    """
    found = style_coverage(expected, metrics)
    measured = metrics.select(
        "package", C("token").alias("observed_token"), "cmap_entries", F.size("tags").alias("features"), "tags"
    )
    graded = (
        found.join(measured, ["package", "observed_token"], "left")
        .join(profile.select("package", "min_cmap", "min_features"), "package")
        .groupBy("package")
        .agg(
            F.count("*").alias("expected_styles"),
            F.count("observed_token").alias("matched_styles"),
            F.count_if(C("cmap_entries") < C("min_cmap")).alias("below_cmap"),
            F.count_if(C("features") < C("min_features")).alias("below_features"),
            F.array_sort(F.collect_list(F.when(C("observed_token").isNull(), F.struct("pos", "label")))).alias("_missing"),
            F.array_distinct(F.flatten(F.collect_set("tags"))).alias("_tags"),
        )
    )
    joined = (
        profile.drop("expected_styles").join(graded, "package", "left")
        .join(by_shuffle(summary), "package", "left")
        .join(by_shuffle(trials), "package", "left")
        .na.fill(0, ["expected_styles", "matched_styles", "below_cmap", "below_features", "trial_assets"])
        .withColumn("missing_styles", F.transform("_missing", lambda m: m["label"]))
        .withColumn("missing_tags", F.array_except("required_tags", F.coalesce("_tags", F.array().cast("array<string>"))))
    )
    gap = F.when(
        F.size("missing_styles") > 0, F.concat(F.lit("missing styles: "), F.array_join("missing_styles", ", "))
    )
    note = lambda n, text: F.when(C(n) > 0, F.concat(F.lit(text), C(n)))
    fails = F.array_compact(
        F.array(
            F.when(C("strict"), gap),
            F.when(C("below_cmap") > 0, F.concat(F.lit("styles below cmap threshold ("), C("min_cmap"), F.lit(")"))),
            note("invalid_fonts", "invalid fonts detected: "),
            note("italic_mismatches", "italic mismatches detected: "),
            F.when(C("fail_on_trial"), note("trial_assets", "trial assets detected: ")),
        )
    )
    warns = F.array_compact(
        F.array(
            F.when(~C("strict"), gap),
            F.when(
                C("below_features") > 0, F.concat(F.lit("styles below feature threshold ("), C("min_features"), F.lit(")"))
            ),
            F.when(
                F.size("missing_tags") > 0,
                F.concat(F.lit("required feature tags missing: "), F.array_join("missing_tags", ", ")),
            ),
            F.when((C("status") == "warn") & (F.size("fail_reasons") == 0), F.lit("validation status is warn")),
        )
    )
    return (
        joined.withColumn("fail_reasons", fails)
        .withColumn("warn_reasons", warns)
        .select(
            "package",
            "expected_styles",
            "matched_styles",
            percent(C("matched_styles"), C("expected_styles")).alias("coverage_pct"),
            "below_cmap",
            "below_features",
            "trial_assets",
            "fail_reasons",
            "warn_reasons",
            F.when((C("invalid_fonts") > 0) | (C("italic_mismatches") > 0), "warn").otherwise("likely-safe").alias("print_readiness"),
            F.when(F.size("fail_reasons") > 0, "fail").when(F.size("warn_reasons") > 0, "warn").otherwise("pass").alias("verdict"),
        )
    )


def target_audit(
    expected: DataFrame, observed: DataFrame, expected_names: DataFrame, observed_names: DataFrame, summary: DataFrame, profile: DataFrame
) -> DataFrame:
    """Styles and names of each package against its target, with a verdict."""
    matches = (
        expected.select("package", "token")
        .join(observed.select("package", "token", F.lit(True).alias("_hit")), ["package", "token"], "left")
        .groupBy("package")
        .agg(F.count("*").alias("expected_styles"), F.count("_hit").alias("matched_styles"))
    )
    def sized(rows: DataFrame, name: str) -> DataFrame:
        return rows.groupBy("package").agg(F.count("*").alias(name))

    out = summary
    for part in (
        matches,
        sized(observed, "observed_styles"),
        sized(unexpected(observed, expected), "unexpected_styles"),
        sized(without_prefix_match(expected_names, observed_names), "missing_names"),
        sized(
            without_prefix_match(observed_names, expected_names).join(
                expected_names.select("package").distinct(), "package", "left_semi"
            ),
            "unexpected_names",
        ),
        profile.select("package", "strict"),
    ):
        out = out.join(by_shuffle(part), "package", "left")
    counts = ["expected_styles", "matched_styles", "observed_styles", "unexpected_styles", "missing_names", "unexpected_names"]
    ratio = C("contamination_fonts") / F.nullif(C("total_files"), F.lit(0))
    print_ready = (
        F.when((C("desktop_fonts") == 0) | (C("valid_fonts") == 0), "high-risk")
        .when(
            (C("invalid_fonts") > 0)
            | (C("name_table_bad_fonts") > 0)
            | (C("italic_mismatches") > 0)
            | (C("desktop_full_fonts") < C("desktop_fonts")),
            "warn",
        )
        .otherwise("likely-safe")
    )
    warn = (
        C("missing_names")
        + C("invalid_fonts")
        + C("contamination_fonts")
        + C("italic_mismatches")
        + C("name_table_bad_fonts")
        + C("expected_styles")
        - C("matched_styles")
    )
    verdict = (
        F.when(C("status") == "fail", "fail")
        .when(F.coalesce("strict", F.lit(False)) & (C("expected_styles") == 0) & (C("observed_styles") > 0), "fail")
        .when((C("expected_styles") > 0) & (C("matched_styles") == 0), "fail")
        .when((C("contamination_fonts") > 0) & (ratio >= 0.3), "fail")
        .when(warn > 0, "warn")
        .otherwise("pass")
    )
    return out.na.fill(0, counts).select(
        "package",
        *counts,
        percent(C("matched_styles"), C("expected_styles")).alias("style_accuracy_pct"),
        F.round(F.coalesce(ratio, F.lit(0.0)), 4).alias("contamination_ratio"),
        print_ready.alias("print_readiness"),
        verdict.alias("verdict"),
    )


def coverage_tokens(label: Column) -> Column:
    """All keys a label may be found under in a sample-sheet text."""

    def tokens(x: Column) -> Column:
        spelled = x["s"]
        every = F.concat(
            F.array(spelled, x["l"]), style_candidates(F.when(spelled != "", spelled).otherwise(x["l"]))
        )
        return F.array_distinct(F.filter(F.transform(every, sheet_style_token), lambda t: t != ""))

    return let(F.struct(spelled_style(label).alias("s"), label.alias("l")), tokens)


def label_entries(rows: DataFrame, label: str) -> DataFrame:
    """(package, label, tokens, pos): labels once each, whatever their case."""
    clean = rows.select("package", "pos", normalize_space(C(label)).alias("label")).filter("label <> ''")
    once = first_by(clean, ["package", F.lower("label")], [C("pos")])
    return once.withColumn("tokens", coverage_tokens(C("label")))


def sample_coverage(expected: DataFrame, observed: DataFrame, sheet: DataFrame) -> DataFrame:
    """How many expected and observed labels share a token with the sample sheets.

    Tokens are exploded and semi-joined: the sheet side is one row per
    (package, token).
    """
    sheet_entries = label_entries(sheet, "label")
    tokens = sheet_entries.select("package", F.explode("tokens").alias("token")).distinct()

    def side(rows: DataFrame, name: str) -> DataFrame:
        entries = label_entries(rows, "label")
        hits = (
            entries.select("package", "label", F.explode("tokens").alias("token"))
            .join(tokens, ["package", "token"], "left_semi")
            .select("package", "label", F.lit(True).alias("_hit"))
            .distinct()
        )
        return (
            entries.join(hits, ["package", "label"], "left")
            .groupBy("package")
            .agg(
                F.count("*").alias(f"{name}_styles"),
                F.count("_hit").alias(f"{name}_matched"),
                F.transform(
                    F.array_sort(F.collect_list(F.when(C("_hit").isNull(), F.struct("pos", "label")))), lambda s: s["label"]
                ).alias(f"{name}_missing"),
            )
        )

    counted = sheet_entries.groupBy("package").agg(F.count("*").alias("sheet_styles"))
    out = side(expected, "expected").join(side(observed, "observed"), "package", "full_outer").join(counted, "package", "left")
    out = out.na.fill(0)
    status = (
        F.when(C("sheet_styles") == 0, "fail")
        .when((C("expected_styles") > C("expected_matched")) & (C("expected_styles") > 0), "warn")
        .otherwise("pass")
    )
    return (
        out.withColumn("expected_pct", percent(C("expected_matched"), C("expected_styles")))
        .withColumn("observed_pct", percent(C("observed_matched"), C("observed_styles")))
        .withColumn("status", status)
    )
