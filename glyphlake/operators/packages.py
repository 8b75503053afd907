"""Packages of font files: file state, inventories, summaries, verdicts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from glyphlake import fixed_values as fv
from glyphlake.functions import files
from glyphlake.functions.styles import quality_style_token
from glyphlake.functions.text import let, normalize_token
from glyphlake.operators.picking import computed, dedupe_first, first_by, top_k
from glyphlake.session import cut_lineage

C = F.col


# --- file state ----------------------------------------------------------


def with_italic_state(metrics: DataFrame) -> DataFrame:
    """Add what the file name, the names inside and the flags say about slope."""
    declared = F.when(C("is_valid"), files.declared_italic(C("subfamily_name"), C("full_name"), C("postscript_name")))
    return (
        metrics.withColumn("file_italic", files.says_italic(C("filename")))
        .withColumn("declared_italic", declared)
        .withColumn("effective_italic", files.effective_italic(C("declared_italic"), C("file_italic"), C("flag_italic")))
        .withColumn("italic_mismatch", F.coalesce(C("file_italic") != C("effective_italic"), F.lit(False)))
    )


def matched_tokens(tokens: Column) -> Column:
    """Target tokens found in a file's names; NULL for files that do not open."""
    names = F.lower(
        F.concat_ws(
            " ",
            "filename",
            *[F.coalesce(c, F.lit("")) for c in ("family_name", "subfamily_name", "full_name", "postscript_name")],
        )
    )

    def found(hay: Column) -> Column:
        collapsed = normalize_token(hay)
        return let(
            F.struct(hay.alias("h"), collapsed.alias("c"), F.replace(collapsed, F.lit("ll"), F.lit("")).alias("w")),
            lambda x: F.filter(
                tokens, lambda t: F.contains(x["h"], t) | F.contains(x["c"], t) | F.contains(x["w"], t)
            ),
        )

    return F.when(C("is_valid"), let(names, found))


def with_file_state(metrics: DataFrame, tokens: Column | None = None) -> DataFrame:
    """All derived columns the summaries need, in one pass and no shuffle."""
    state = with_italic_state(metrics)
    issues = files.name_issues(C("family_name"), C("subfamily_name"), C("full_name"), C("postscript_name"))
    target = F.lit(None).cast("boolean") if tokens is None else F.size(matched_tokens(tokens)) > 0
    if tokens is not None:
        target = F.when(C("is_valid"), target)
    return (
        state.withColumn("mismatch", files.signature_mismatch(C("ext"), C("signature")))
        .withColumn("is_subset", F.size(files.subset_evidence(C("glyph_count"), C("cmap_entries"))) > 0)
        .withColumn("name_ok", F.when(C("is_valid"), F.size(issues) == 0))
        .withColumn("tags", F.filter(F.split(F.coalesce("feature_tags", F.lit("")), ","), lambda t: t != ""))
        .withColumn("target_matched", target)
    )


def contamination_side(state: DataFrame) -> DataFrame:
    """Add ``side``, clean or contaminated; files that do not open are not
    contamination.  One pass: filter it for either half."""
    return state.withColumn("side", F.when(C("target_matched"), "clean").when(C("target_matched").isNull(), "clean").otherwise("contaminated"))


def trial_assets(log: DataFrame) -> DataFrame:
    return log.filter(
        reduce(lambda a, b: a | b, [C(c).rlike(r"(?i)\btrial\b") for c in ("source_url", "filename", "name")])
    )


# --- inventories ---------------------------------------------------------


def format_inventory(metrics: DataFrame, limited: DataFrame, required: list[str] = fv.CORE_FORMATS) -> DataFrame:
    """Files per format and missing formats of each package.

    ``limited``: (package, limited) with the formats the source does not offer.
    One aggregate; the format list is fixed, so no pivot discovery pass.
    """
    counts = metrics.groupBy("package").agg(
        *[F.count_if(C("ext") == f).alias(f"n_{f}") for f in fv.CORE_FORMATS],
        F.count_if(~C("ext").isin(fv.CORE_FORMATS)).alias("n_other"),
    )
    absent = F.array_compact(F.array(*[F.when(C(f"n_{f}") == 0, F.lit(f)) for f in required]))
    none = F.array().cast("array<string>")
    return counts.join(limited, "package", "left").withColumn(
        "missing", F.array_except(absent, F.coalesce("limited", none))
    )


def format_groups(metrics: DataFrame, limited: DataFrame) -> DataFrame:
    """Formats and names of each style (files sharing a stem), with issues."""
    grouped = metrics.groupBy("package", files.group_key(C("filename")).alias("key")).agg(
        F.count("*").alias("files"),
        F.array_sort(F.collect_set("ext")).alias("formats"),
        F.count_distinct(F.when(C("family_name") != "", C("family_name"))).alias("family_names"),
        F.count_distinct(F.when(C("subfamily_name") != "", C("subfamily_name"))).alias("subfamily_names"),
    )
    none = F.array().cast("array<string>")
    wanted = grouped.join(limited, "package", "left").withColumn(
        "expected", files.expected_formats(C("key"), F.coalesce("limited", none))
    )
    missing = wanted.withColumn("missing", F.array_except("expected", "formats"))
    issues = F.array_compact(
        F.array(
            F.when(C("family_names") > 1, F.lit("family_name_mismatch")),
            F.when(C("subfamily_names") > 1, F.lit("subfamily_name_mismatch")),
            F.when(F.size("missing") > 0, F.lit("format_incomplete")),
        )
    )
    return missing.withColumn("issues", issues).drop("limited")


def validation_summary(state: DataFrame) -> DataFrame:
    """Counts, averages and pass/warn/fail of each package, in one aggregate."""
    valid = C("is_valid")
    desktop = valid & C("ext").isin("ttf", "otf")
    out = state.groupBy("package").agg(
        F.count("*").alias("total_files"),
        F.count_if(valid).alias("valid_fonts"),
        F.count_if(~valid).alias("invalid_fonts"),
        F.count_if(valid & C("is_subset")).alias("subsetted_fonts"),
        F.count_if(valid & ~C("is_subset")).alias("full_fonts"),
        F.count_if(valid & C("name_ok")).alias("name_table_ok_fonts"),
        F.count_if(valid & ~C("name_ok")).alias("name_table_bad_fonts"),
        F.count_if(valid & C("italic_mismatch")).alias("italic_mismatches"),
        F.count_if("mismatch").alias("ext_signature_mismatches"),
        F.lit(0).cast("long").alias("os2_italic_mismatches"),
        F.lit(0).cast("long").alias("mono_fixed_pitch_mismatches"),
        F.count_if(desktop).alias("desktop_fonts"),
        F.count_if(desktop & C("name_ok")).alias("desktop_name_ok"),
        F.count_if(desktop & ~C("is_subset")).alias("desktop_full_fonts"),
        F.count_if("target_matched").alias("target_matched_fonts"),
        F.count_if(~C("target_matched")).alias("contamination_fonts"),
        (F.sum(F.when(valid, C("glyph_count")).otherwise(0)) / F.greatest(F.lit(1), F.count_if(valid))).alias("average_glyphs"),
        (F.sum(F.when(valid, F.size("tags")).otherwise(0)) / F.greatest(F.lit(1), F.count_if(valid))).alias("average_feature_count"),
    )
    defects = (
        C("invalid_fonts")
        + C("name_table_bad_fonts")
        + C("italic_mismatches")
        + C("ext_signature_mismatches")
        + C("contamination_fonts")
    )
    return out.withColumn(
        "status", F.when(C("valid_fonts") == 0, "fail").when(defects > 0, "warn").otherwise("pass")
    )


def feature_histogram(state: DataFrame, k: int | None = None) -> DataFrame:
    """Valid files per package and feature tag: all of them, or the ``k`` most
    frequent of each package."""
    counts = (
        state.filter("is_valid")
        .select("package", F.explode("tags").alias("tag"))
        .groupBy("package", "tag")
        .agg(F.count("*").alias("count"))
    )
    return counts if k is None else top_k(counts, ["package"], [C("count").desc(), C("tag")], k)


def technical_qa(metrics: DataFrame, limited: DataFrame, strict_groups: bool = False) -> DataFrame:
    """Package verdict from the inventory and the format groups."""
    inventory = format_inventory(metrics, limited).select("package", "missing")
    invalid = metrics.groupBy("package").agg(F.count_if(~C("is_valid")).alias("invalid_files"))
    mismatch = F.exists("issues", lambda i: i.endswith("_name_mismatch"))
    groups = format_groups(metrics, limited).groupBy("package").agg(
        F.count("*").alias("groups_total"),
        F.count_if(F.size("missing") > 0).alias("groups_incomplete"),
        F.count_if(mismatch).alias("group_name_mismatch_count"),
    )
    joined = inventory.join(invalid, "package").join(groups, "package")
    reasons = F.array_compact(
        F.array(
            F.when(C("invalid_files") > 0, F.concat(F.lit("invalid_files="), C("invalid_files"))),
            F.when(F.size("missing") > 0, F.concat(F.lit("formats_missing="), F.array_join("missing", ","))),
            F.when(F.lit(strict_groups) & (C("groups_incomplete") > 0), F.lit("groups_incomplete")),
            F.when(
                C("group_name_mismatch_count") > 0,
                F.concat(F.lit("groups_with_other_names="), C("group_name_mismatch_count")),
            ),
        )
    )
    return joined.withColumn("reasons", reasons).withColumn(
        "status", F.when(F.size("reasons") == 0, "pass").otherwise("warn")
    )


# --- ranking -------------------------------------------------------------


def candidate_score(filename: Column, ext: Column) -> Column:
    low = F.lower(filename)
    by_format = reduce(
        lambda acc, kv: F.when(ext == kv[0], kv[1]) if acc is None else acc.when(ext == kv[0], kv[1]),
        fv.RECOVERY_FORMAT_SCORE.items(),
        None,
    ).otherwise(0)
    return (
        F.when(F.contains(low, F.lit("variable")), 100).otherwise(0)
        + by_format
        - F.when(F.contains(low, F.lit("italic")), 1).otherwise(0)
    )


def rank_candidates(metrics: DataFrame, k: int | None = None) -> DataFrame:
    """Recovery sources of each package with their score: all of them, or the
    ``k`` best, stable by input order."""
    scored = metrics.withColumn("score", candidate_score(C("filename"), C("ext")))
    return scored if k is None else top_k(scored, ["package"], [C("score").desc(), C("pos")], k)


def recovery_plan(metrics: DataFrame, limited: DataFrame, required: list[str] = fv.CORE_FORMATS) -> DataFrame:
    """Missing formats per package and, where some are, the ranked sources.

    Complete packages are filtered out before any ranking.
    """
    inventory = format_inventory(metrics, limited, required).select("package", "missing")
    needed = inventory.filter(F.size("missing") > 0)
    ranked = rank_candidates(metrics.join(needed.select("package"), "package", "left_semi"))
    sources = ranked.select("package", "filename", "score", "pos")
    return (
        inventory.join(sources, "package", "left")
        .withColumn("status", F.when(F.size("missing") == 0, "noop").otherwise("needed"))
    )


def best_metrics(state: DataFrame) -> DataFrame:
    """Best file per package and style: most mapped characters, then glyphs."""
    keyed = computed(state, style_token=quality_style_token(C("subfamily_name"))).filter("style_token <> ''")
    return first_by(keyed, ["package", "style_token"], [-C("cmap_entries"), -C("glyph_count"), C("pos")])


def dedupe_content(docs: DataFrame, key: str, payload: str) -> tuple[DataFrame, DataFrame]:
    """(kept, skipped) by content hash.

    Payloads are hashed once.  Only (key, hash) is shuffled, combined before the shuffle; the skipped
    rows come from an anti-join on the unique key, so a payload copied a
    million times makes no hot partition.
    """
    hashed = cut_lineage(docs.select(key, F.sha2(payload, 256).alias("digest")))
    kept = hashed.groupBy("digest").agg(F.min(key).alias(key))
    skipped = hashed.join(kept.select(key), key, "left_anti").withColumn("reason", F.lit("Duplicate payload hash"))
    return kept, skipped


def dedupe_labels(labels: DataFrame) -> DataFrame:
    keyed = computed(labels, token=quality_style_token(C("style_label"))).filter("token <> ''")
    return dedupe_first(keyed, ["package", "token"])


#: rows of a key from which on it is numbered in ranges instead of one window
ROWS_IN_A_WINDOW = 500_000


def _same(left: str, right: str, keys: list[str]) -> Column:
    """Equal in all keys, where nulls are equal to each other."""
    return reduce(lambda a, b: a & b, (C(f"{left}.{k}").eqNullSafe(C(f"{right}.{k}")) for k in keys))


def _kept(rows: DataFrame, other: DataFrame, keys: list[str], how: str) -> DataFrame:
    return rows.alias("_l").join(other.alias("_r"), _same("_l", "_r", keys), how)


def number_ranges(df: DataFrame, keys: list[str], order: str, name: str) -> DataFrame:
    """Add ``name``: 1, 2, ... per key by the order column, nulls first.

    Rows are sorted by range, whatever a key's share of them is, counted range
    by range, and numbered on from the ranges before.  Equal order values are
    spread over ranges as well.  The sorted rows are written out, so that the
    counts and the numbers are of one and the same order.
    """
    width = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    by = [*keys, C(order).asc_nulls_first(), C("_spread")]
    ranges = df.withColumn("_spread", F.rand(3)).repartitionByRange(width, *by).sortWithinPartitions(*by).drop("_spread")
    at = cut_lineage(ranges.withColumn("_at", F.monotonically_increasing_id())).withColumn("_range", F.shiftright("_at", 33))
    before = Window.partitionBy(*keys).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    counts = at.groupBy(*keys, "_range").agg(F.min("_at").alias("_first"), F.count("*").alias("_n"))
    starts = counts.select(*keys, "_range", (F.coalesce(F.sum("_n").over(before), F.lit(0)) - C("_first") + 1).alias("_shift"))
    numbered = _kept(at, starts, [*keys, "_range"], "inner")
    return numbered.select(*(C(f"_l.{c}") for c in df.columns), (C("_at") + C("_shift")).alias(name))


def number_rows(df: DataFrame, keys: list[str], order: str, name: str, most: int = ROWS_IN_A_WINDOW) -> DataFrame:
    """Add ``name``: 1, 2, ... per key by the order column, nulls first; null
    keys are keys.  Keys of more than ``most`` rows are numbered in ranges."""
    window = F.row_number().over(Window.partitionBy(*keys).orderBy(C(order).asc_nulls_first()))
    large = cut_lineage(df.groupBy(*keys).agg(F.count("*").alias("_n")).filter(C("_n") > most).select(*keys))
    if large.isEmpty():
        return df.withColumn(name, window.cast("long"))
    small = _kept(df, large, keys, "left_anti").withColumn(name, window.cast("long"))
    return small.unionByName(number_ranges(_kept(df, large, keys, "left_semi"), keys, order, name))


def _free_numbers(places: DataFrame, gaps: DataFrame, keys: list[str], most: int) -> DataFrame:
    """``places`` with ``_shift``, the shift of the last gap whose ``_from`` is
    not above their ``_j``; both sides are merged in one order.

    A key's line is cut into stretches of ``most`` numbers; the largest shift
    before a stretch, one row per stretch, is carried into it.
    """
    stretch = F.floor(C("_at") / most)
    both = places.withColumns({"_at": C("_j"), "_gap": F.lit(None).cast("long"), "_is_row": F.lit(True)}).unionByName(
        gaps.select(*keys, C("_from").alias("_at"), C("_shift").alias("_gap"), F.lit(False).alias("_is_row")), allowMissingColumns=True
    ).withColumn("_stretch", stretch)
    inside = Window.partitionBy(*keys, "_stretch").orderBy("_at", "_is_row").rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy(*keys).orderBy("_stretch").rowsBetween(Window.unboundedPreceding, -1)
    carried = both.groupBy(*keys, "_stretch").agg(F.max("_gap").alias("_most")).select(*keys, "_stretch", F.max("_most").over(before).alias("_carried"))
    merged = _kept(both.withColumn("_here", F.max("_gap").over(inside)).filter("_is_row"), carried, [*keys, "_stretch"], "inner")
    return merged.select(*(C(f"_l.{c}") for c in places.columns), F.coalesce("_here", "_carried", F.lit(0)).alias("_shift"))


def unique_names(rows: DataFrame, group: str, name: str, order: str, first: int = 1, most: int = ROWS_IN_A_WINDOW) -> DataFrame:
    """Add ``unique_name``: the second row of a name gets ``-first`` before the
    extension, the next one the next number, stepping over numbers that names
    of the group already use.

    Every row is kept.  Rows without a group are a group; rows without an
    order value come first; a null name stays null, however often.

    The numbers in use, sorted, leave gaps; the k-th free number is k and the
    count of used ones below it.  That count is constant from one used number
    to the next, so it is taken from merging the two sorted lists.
    """
    keys = [group, name]
    stem = F.regexp_replace(name, r"(?<=.)\.[^.]*$", "")
    ext = F.regexp_extract(name, r".(\.[^.]*)$", 1)
    placed = number_rows(rows, keys, order, "_place", most).withColumn("_j", C("_place") - 1)
    used = (
        rows.filter(F.coalesce(stem.rlike(r"-\d+$"), F.lit(False)))
        .select(
            group,
            F.concat(F.regexp_extract(stem, r"^(.*)-(\d+)$", 1), ext).alias(name),
            F.regexp_extract(stem, r"^(.*)-(\d+)$", 2).try_cast("long").alias("_number"),
        )
        .filter(C("_number") >= first)
        .distinct()
    )
    used = cut_lineage(used)
    if used.isEmpty():
        shifted = placed.withColumn("_shift", F.lit(0).cast("long"))
    else:
        ranked = number_rows(used, keys, "_number", "_rank", most).withColumn("_below", C("_number") - (first - 1) - C("_rank"))
        gaps = cut_lineage(ranked.groupBy(*keys, "_below").agg(F.max("_rank").alias("_shift")).withColumn("_from", C("_below") + 1))
        touched = gaps.select(*keys).distinct()
        shifted = _free_numbers(_kept(placed, touched, keys, "left_semi"), gaps, keys, most).unionByName(
            _kept(placed, touched, keys, "left_anti").withColumn("_shift", F.lit(0).cast("long"))
        )
    renamed = F.concat(stem, F.lit("-"), C("_j") + (first - 1) + C("_shift"), ext)
    return shifted.withColumn("unique_name", F.when(C("_j") == 0, C(name)).otherwise(renamed)).drop("_place", "_j", "_shift")
