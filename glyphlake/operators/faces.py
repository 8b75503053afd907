"""Font faces: parsing, inference, source choice, dedupe, families of a page."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from glyphlake import fixed_values as fv
from glyphlake.functions import styles, urls
from glyphlake.functions.text import (
    blank_to_null,
    file_name_hint,
    let,
    normalize_space,
    normalize_token,
    strip_quotes,
)
from glyphlake.operators.documents import all_matches, css_font_references, font_urls
from glyphlake.operators.picking import computed, first_by
from glyphlake.session import cut_lineage

C = F.col
FACE_BLOCK = r"(?is)@font-face\s*\{(.*?)\}"
VARIABLE_URL = r"(?i)variable|\bvf\b"


def rank_of(value: Column, ranks: dict[str, int]) -> Column:
    return reduce(
        lambda acc, kv: F.when(value == kv[0], kv[1]) if acc is None else acc.when(value == kv[0], kv[1]),
        ranks.items(),
        None,
    ).otherwise(0)


def declaration(block: Column, name: str) -> Column:
    return normalize_space(F.regexp_extract(block, rf"(?i){name}\s*:\s*([^;]+);", 1))


def face_sources(block: Column, base: Column, preload: Column) -> Column:
    """Array of struct(url, format, preload, variable, i) of a face block."""
    resolved = F.transform(css_font_references(block), lambda r: urls.resolve_url(r, base))
    return F.transform(
        F.array_compact(resolved),
        lambda u, i: F.struct(
            u.alias("url"),
            urls.url_format(u).alias("format"),
            F.coalesce(F.array_contains(preload, u), F.lit(False)).alias("preload"),
            u.rlike(VARIABLE_URL).alias("variable"),
            i.alias("i"),
        ),
    )


def pick_face_source(sources: Column, variable_face: Column) -> Column:
    """Variable faces: preloaded first; static ones: static sources first."""
    keyed = F.transform(
        sources,
        lambda s: F.struct(
            F.when(variable_face, ~s["preload"]).otherwise(s["variable"]).alias("first"),
            rank_of(s["format"], fv.FACE_SOURCE_ORDER).alias("rank"),
            s["i"].alias("i"),
            s.alias("source"),
        ),
    )
    return F.array_min(keyed)["source"].dropFields("i")


def read_block(block: Column, doc_url: Column, preload: Column) -> Column:
    """What a face block declares, as a struct; NULL without a family or a source."""
    declared = F.struct(
        strip_quotes(declaration(block, "font-family")).alias("css_family"),
        F.coalesce(blank_to_null(declaration(block, "font-weight")), F.lit("400")).alias("raw_weight"),
        F.coalesce(blank_to_null(declaration(block, "font-style")), F.lit("normal")).alias("raw_style"),
        F.contains(block, F.lit("U+0000-00FF")).alias("core_range"),
        face_sources(block, doc_url, preload).alias("sources"),
    )

    def with_variable(r: Column) -> Column:
        variable = (
            F.contains(normalize_token(r["css_family"]), F.lit("variable"))
            | r["raw_weight"].rlike(styles.RANGE)
            | F.forall(r["sources"], lambda s: s["variable"])
        )
        return F.when((r["css_family"] != "") & (F.size(r["sources"]) > 0), F.struct(r.alias("r"), variable.alias("variable")))

    def with_source(x: Column) -> Column:
        r = x["r"]
        kept = [r[c].alias(c) for c in ("css_family", "raw_weight", "raw_style", "core_range")]
        source = pick_face_source(r["sources"], x["variable"])
        return F.when(x.isNotNull(), F.struct(*kept, x["variable"].alias("variable_face"), source.alias("source")))

    return let(let(declared, with_variable), with_source)


def raw_faces(docs: DataFrame) -> DataFrame:
    """Face blocks with a family and a source.  ``docs``: page, url, text,
    doc_pos and preload (array of the page's own font URLs)."""
    blocks = docs.select(
        "page", C("url").alias("doc_url"), "doc_pos", "preload", F.posexplode(all_matches(C("text"), FACE_BLOCK, 1)).alias("pos", "block"),
    )
    read = computed(blocks, read=read_block(C("block"), C("doc_url"), C("preload"))).filter(C("read").isNotNull())
    return read.select("page", "doc_url", "doc_pos", "pos", "read.*")


def _face_struct(family: Column, label: Column, weight: Column, style: Column) -> Column:
    return F.struct(family.alias("family"), label.alias("label"), weight.alias("weight"), style.alias("style"))


def _score(s: Column) -> Column:
    return styles.signal_score(s["label"], s["weight"], s["style"])


def url_label(url: Column) -> Column:
    """Readable label of a font file, without variable and web marks."""
    human = styles.humanize_label(F.coalesce(urls.asset_stem(url), F.lit("")))
    return normalize_space(
        F.regexp_replace(F.regexp_replace(human, r"(?i)\b(?:vf|var|variable)\b$", ""), r"(?i)\bweb\b$", "")
    )


def declared_face(raw: Column | dict[str, Column]) -> Column:
    """Family, label, weight and style of a block that ``read_block`` has read
    (a struct, or its fields by name), corrected by its family and file names."""
    weight = raw["raw_weight"]
    declared = _face_struct(
        raw["css_family"],
        styles.css_style_label(weight, raw["raw_style"], raw["variable_face"]),
        let(styles.weight_value(weight), lambda w: F.coalesce(styles.number_text(F.when(w != 0.0, w)), weight)),
        F.when(styles.is_italic_css(raw["raw_style"]), "Italic").otherwise("Normal"),
    )

    def by_family_name(x: Column) -> Column:
        face, hint = x["face"], x["hint"]
        stronger = (_score(hint) >= _score(face)) | (hint["label"] != "Regular")
        renamed = _face_struct(hint["family"], face["label"], face["weight"], face["style"])
        return F.when(hint.isNull(), face).when(stronger, hint).otherwise(renamed)

    def by_file_name(x: Column) -> Column:
        face, hint = x["face"], x["hint"]
        css_token, file_token = x["css_token"], normalize_token(hint["family"])
        same = (
            (css_token != "")
            & (file_token != "")
            & (F.contains(css_token, file_token) | F.contains(file_token, css_token))
        )
        return F.when(hint.isNotNull() & same & (_score(hint) >= _score(face)), hint).otherwise(face)

    def told(human: Column) -> Column:
        first = let(F.struct(declared.alias("face"), styles.style_suffix(human).alias("hint")), by_family_name)
        return F.struct(
            first.alias("face"),
            styles.style_suffix(url_label(raw["source"]["url"])).alias("hint"),
            normalize_token(human).alias("css_token"),
        )

    return let(let(styles.humanize_label(raw["css_family"]), told), by_file_name)


def extract_faces(docs: DataFrame) -> DataFrame:
    """(page, doc_url, doc_pos, pos, family, label, weight, style, discovery, source)."""
    raw = {c: C(c) for c in ("css_family", "raw_weight", "raw_style", "variable_face", "source")}
    return computed(raw_faces(docs), face=declared_face(raw)).select(
        "page",
        "doc_url",
        "doc_pos",
        "pos",
        styles.family_alias(C("face.family"), C("face.label")).alias("family"),
        C("face.label").alias("label"),
        C("face.weight").alias("weight"),
        C("face.style").alias("style"),
        F.lit("font-face").alias("discovery"),
        "source",
        "core_range",
    )


def infer_face(url: Column, preload: Column) -> Column:
    """Face struct told by a file name alone, NULL if its family is too short."""

    def read(label: Column) -> Column:
        return let(
            F.struct(label.alias("label"), styles.style_suffix(label).alias("hint")),
            lambda x: F.coalesce(x["hint"], _face_struct(x["label"], F.lit("Regular"), F.lit("400"), F.lit("Normal"))),
        )

    def full(x: Column) -> Column:
        f = x["f"]
        return F.when(
            F.length(normalize_token(f["family"])) >= 3,
            F.struct(
                f["family"].alias("family"),
                f["label"].alias("label"),
                f["weight"].alias("weight"),
                f["style"].alias("style"),
                F.struct(
                    url.alias("url"),
                    urls.url_format(url).alias("format"),
                    F.coalesce(F.array_contains(preload, url), F.lit(False)).alias("preload"),
                    urls.asset_stem(url).rlike(VARIABLE_URL).alias("variable"),
                ).alias("source"),
            ),
        )

    return let(F.struct(let(url_label(url), read).alias("f")), full)


def inferred_faces(docs: DataFrame) -> DataFrame:
    """Faces told by the font URLs of a page's documents, one per URL."""
    found = docs.select(
        "page", C("url").alias("doc_url"), "doc_pos", "preload",
        F.posexplode(font_urls(C("text"), C("url"))).alias("pos", "asset_url"),
    )
    once = first_by(found, ["page", "asset_url"], [C("doc_pos"), C("pos")])
    faces = computed(once, face=infer_face(C("asset_url"), C("preload"))).filter(C("face").isNotNull())
    return faces.select(
        "page", "doc_url", "doc_pos", (C("pos") + (1 << 32)).alias("pos"),
        "face.family", "face.label", "face.weight", "face.style",
        F.lit("inferred-url").alias("discovery"), "face.source", F.lit(False).alias("core_range"),
    )


# --- usage, aliases, dedupe ---------------------------------------------


def occurrences(text: Column, needle: Column) -> Column:
    """Non-overlapping occurrences; both sides already lower case."""
    # bytes, as characters would be counted through the whole text for every needle
    gone = F.octet_length(text) - F.octet_length(F.replace(text, needle, F.lit("")))
    return F.when(F.length(needle) > 0, (gone / F.octet_length(needle)).cast("long")).otherwise(F.lit(0).cast("long"))


def mentions(texts: Column, families: Column) -> Column:
    """Array of struct(family, usage): how often the texts, already in lower
    case, name each family; by its token where its spelling is never found."""

    def total(needle: Column) -> Column:
        return F.aggregate(texts, F.lit(0).cast("long"), lambda n, text: n + occurrences(text, needle))

    def used(family: Column) -> Column:
        names = F.struct(F.lower(family).alias("name"), normalize_token(family).alias("token"))
        by_token = lambda x: F.when(F.length(x["token"]) >= 3, total(x["token"])).otherwise(F.lit(0).cast("long"))
        return let(names, lambda x: let(total(x["name"]), lambda n: F.when(n > 0, n).otherwise(by_token(x))))

    return F.transform(families, lambda f: F.struct(f.alias("family"), used(f).alias("usage")))


def in_page_rows(pages: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """All faces of a page and all mentions of their families, in the page's
    row: ``page``, ``faces`` (array) and ``usage`` (array of family, usage).

    ``pages``: page, preload (the font URLs of the page itself), and
    ``documents``, an array of struct(url, kind, text, doc_pos), where the page
    itself has place -1.  Texts are read where they lie; nothing of them moves.
    Families count as declared or inferred, and as they are ``shown``.  ``keep``
    names columns of a page that its row carries on, so that no later step has
    to put the page together and read it again.
    """

    def face(told: Column, doc: Column, pos: Column, family: Column, source: Column, discovery: str, core_range: Column) -> Column:
        return F.struct(
            doc["url"].alias("doc_url"), doc["doc_pos"].alias("doc_pos"), pos.cast("long").alias("pos"),
            family.alias("family"), told["label"].alias("label"), told["weight"].alias("weight"), told["style"].alias("style"),
            F.lit(discovery).alias("discovery"), source.alias("source"), core_range.alias("core_range"),
        )

    def declared(doc: Column) -> Column:
        def read(block: Column, i: Column) -> Column:
            def named(raw: Column) -> Column:
                told = lambda t: face(t, doc, i, styles.family_alias(t["family"], t["label"]), raw["source"], "font-face", raw["core_range"])
                return F.when(raw.isNotNull(), let(declared_face(raw), told))

            return let(read_block(block, doc["url"], C("preload")), named)

        return F.array_compact(F.transform(all_matches(doc["text"], FACE_BLOCK, 1), read))

    def inferred(doc: Column) -> Column:
        def read(url: Column, i: Column) -> Column:
            told = lambda t: F.when(t.isNotNull(), face(t, doc, i + F.lit(1 << 32), t["family"], t["source"], "inferred-url", F.lit(False)))
            return let(infer_face(url, C("preload")), told)

        own = F.when(doc["doc_pos"] == -1, C("preload")).otherwise(font_urls(doc["text"], doc["url"]))
        return F.array_compact(F.transform(own, read))

    faces = F.flatten(F.transform("documents", lambda d: F.concat(declared(d), inferred(d))))
    shown = F.transform(faces, lambda f: f.withField("shown", styles.display_label(f["family"], f["label"], f["source"]["url"])))
    families = F.array_distinct(F.flatten(F.transform("faces", lambda f: F.array(f["family"], f["shown"]))))
    texts = F.transform("documents", lambda d: F.lower(d["text"]))
    found = computed(computed(pages, faces=shown), families=families, texts=texts)
    return found.select("page", *keep, "faces", mentions(C("texts"), C("families")).alias("usage"))


def page_faces(rows: DataFrame) -> DataFrame:
    """The faces of ``in_page_rows``; of inferred ones the first per URL."""
    faces = rows.select("page", F.inline("faces"))
    by_file = first_by(faces.filter("discovery = 'inferred-url'"), ["page", C("source.url")], document_order())
    return faces.filter("discovery <> 'inferred-url'").unionByName(by_file)


def page_usage(rows: DataFrame) -> DataFrame:
    return rows.select("page", F.inline("usage"))


def family_usage(faces: DataFrame, docs: DataFrame) -> DataFrame:
    """(page, family, usage) for documents that are a page each: the families
    of a page travel to it as one short list."""
    lists = faces.groupBy("page").agg(F.collect_set("family").alias("families"))
    named = docs.select("page", F.array(F.lower("text")).alias("texts")).join(lists, "page")
    return named.select("page", F.inline(mentions(C("texts"), C("families"))))


def document_order() -> list[Column]:
    return [C("doc_pos"), C("pos")]


def collapse_aliases(faces: DataFrame, usage: DataFrame) -> DataFrame:
    """One family per (page, URL, label, weight, style): the most used name,
    then a declared one, then the longest."""
    known = faces.join(usage, ["page", "family"], "left")
    order = [
        -F.coalesce("usage", F.lit(0)), F.when(C("discovery") == "font-face", 0).otherwise(1), -F.length("family"), *document_order(),
    ]
    return first_by(known, ["page", C("source.url"), "label", "weight", "style"], order).drop("usage")


def dedupe_faces(faces: DataFrame) -> DataFrame:
    return first_by(faces, ["page", "family", "label", C("source.url")], document_order())


def pick_style_source(faces: DataFrame) -> DataFrame:
    """Best file per (page, family, label, style)."""
    order = [
        -rank_of(C("source.format"), fv.STYLE_SOURCE_RANK),
        ~C("source.preload"),
        F.when(C("discovery") == "font-face", 0).otherwise(1),
        C("source.variable"),
        C("source.url"),
        *document_order(),
    ]
    return first_by(faces, ["page", normalize_token(C("family")), normalize_token(C("label")), "style"], order)


def pick_subset_seed(faces: DataFrame) -> DataFrame:
    """Of several range shards per style: the core one, then one with a
    payload, then the first."""
    order = [~C("core_range"), C("source.url").isNull(), *document_order()]
    return first_by(faces, ["page", "family", "label", "style"], order)


def pick_by_format_rank(faces: DataFrame, ranks: dict[str, int]) -> DataFrame:
    order = [-rank_of(C("source.format"), ranks), C("source.url"), *document_order()]
    return first_by(faces, ["page", "family", "label", "style", C("source.variable")], order)


def family_rank(faces: DataFrame, usage: DataFrame, tokens: DataFrame) -> DataFrame:
    """Score of each family of a page and whether it is kept.

    ``tokens``: (page, tokens) with the target words of the page.  The window
    runs over families, already aggregated: a handful per page.
    """
    stats = faces.groupBy("page", "family").agg(
        F.count("*").alias("faces"),
        F.count_if(C("discovery") == "font-face").alias("declared"),
        F.count_if(C("discovery") != "font-face").alias("inferred"),
        F.count_if(C("source.preload")).alias("preload"),
    )
    token = normalize_token(C("family"))
    near = F.exists("tokens", lambda t: F.contains(C("token"), t) | F.contains(t, C("token")))
    scored = (
        stats.join(usage, ["page", "family"], "left")
        .join(tokens, "page", "left")
        .withColumn("token", token)
        .withColumn("usage", F.greatest(F.lit(0), F.coalesce("usage", F.lit(0)) - C("faces")))
        .withColumn("boost", F.when(near, 6).otherwise(0))
        .withColumn(
            "score", C("declared") * 6 + C("inferred") * 2 + C("usage") * 3 + C("preload") * 2 + C("boost")
        )
        .filter(~C("token").isin(fv.FAMILY_STOPWORDS))
    )
    page = Window.partitionBy("page")
    top = F.min_by(F.struct("score", "token"), F.struct(-C("score"), -C("faces"), C("family"))).over(page)
    ranked = scored.withColumn("top", top)
    related = (
        C("token").startswith(C("top.token"))
        | C("top.token").startswith(C("token"))
        | (F.contains(C("token"), C("top.token")) & (F.length("top.token") >= 4))
    )
    return ranked.withColumn(
        "selected", (C("score") >= F.greatest(F.lit(4.0), C("top.score") * 0.6)) | related
    ).select("page", "family", "faces", "declared", "inferred", "usage", "preload", "boost", "score", "selected")


def scan_pages(rows: DataFrame, tokens: DataFrame) -> DataFrame:
    """The whole passive scan of ``in_page_rows``: declared and inferred faces
    of every page, cleaned, one file per style, families selected."""
    usage = page_usage(rows)
    shown = dedupe_faces(collapse_aliases(page_faces(rows), usage)).withColumn("family", C("shown")).drop("shown")
    named = dedupe_faces(shown)
    kept = cut_lineage(pick_style_source(named).filter(F.length(normalize_token(C("family"))) >= 3))
    families = family_rank(kept, usage, tokens).filter("selected")
    selected = kept.join(families.select("page", "family", "score"), ["page", "family"])
    return selected.withColumn("file_name_hint", file_name_hint(C("family"), C("label")))


def scan_summary(pages: DataFrame, faces: DataFrame, selected: DataFrame, candidates: DataFrame) -> DataFrame:
    """Per page: families found and selected, resources, asset hosts, sources.
    ``pages``: page, documents, as ``in_page_rows`` reads them (kinds will do)."""
    host = urls.host_of(C("source.url"))
    found = faces.groupBy("page").agg(F.count_distinct("family").alias("families_found"))
    chosen = selected.groupBy("page").agg(
        F.count_distinct("family").alias("families_selected"),
        F.count_distinct(blank_to_null(host)).alias("asset_hosts"),
        F.count("*").alias("faces_selected"),
    )
    probes = candidates.groupBy(C("page_id").alias("page")).agg(
        F.count("*").alias("candidates"), F.count_if(C("kind") == "css").alias("css_links")
    )
    sources = pages.select(
        "page", F.size(F.filter("documents", lambda d: d["kind"] != "html")).cast("long").alias("documents"),
        F.array_join(F.transform("documents", lambda d: d["kind"]), ",").alias("sources"),
    )
    out = sources.join(probes, "page", "left").join(found, "page", "left").join(chosen, "page", "left")
    return out.na.fill(0, ["candidates", "css_links", "families_found", "families_selected", "asset_hosts", "faces_selected"])
