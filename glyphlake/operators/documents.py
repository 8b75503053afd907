"""Documents of a page and what can be read out of their text."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glyphlake import fixed_values as fv
from glyphlake.functions import urls
from glyphlake.functions.text import (
    ascii_bounds,
    blank_to_null,
    decode_html_entities,
    let,
    normalize_space,
    normalize_token,
    trim_all,
)
from glyphlake.operators.picking import computed, first_by, top_k

C = F.col

ARCHIVES = ["zip"]


# --- pieces of a text ----------------------------------------------------


def words(text: Column) -> Column:
    """What stands between white space, quotes, angle brackets and parentheses."""
    return F.split(text, r"[\s\"'<>()]+")


def strings(text: Column, quote: str) -> Column:
    """Array of struct(value, lead, name): what stands between two marks of one
    kind, what stands before the first of them, and the string before that.
    Marks that are escaped, as in JSON within a script, count as well."""

    def between(pieces: Column) -> Column:
        inner = F.slice(pieces, 2, F.greatest(F.size(pieces) - 2, F.lit(0)))
        return F.transform(
            inner,
            lambda piece, i: F.struct(
                F.rtrim(piece, F.lit("\\")).alias("value"),
                F.get(pieces, i).alias("lead"),
                F.rtrim(F.get(pieces, i - 1), F.lit("\\")).alias("name"),
            ),
        )

    return let(F.split(text, quote), between)


def values(text: Column) -> Column:
    """All strings of a text in marks of either kind, without markup in them."""
    both = F.concat(strings(text, '"'), strings(text, "'"))
    return F.filter(F.transform(both, lambda s: s["value"]), lambda v: ~v.rlike("[<>]"))


def suffix_of(ref: Column) -> Column:
    """The lower-case file extension of a reference, its query aside."""
    return F.lower(F.substring_index(F.substring_index(ref, "?", 1), ".", -1))


def up_to_end(word: Column, end: str) -> Column:
    """A bare word up to the first ``end`` in its path, with the query behind
    that; null if there is none.  What follows, such as a comma, is no part."""
    path = F.substring_index(word, "?", 1)
    head = F.regexp_extract(path, f"(?i)^.+?(?:{end})", 0)
    return F.when(head == path, word).when(head != "", head)


def any_of(suffixes: list[str]) -> str:
    return "[.](?:" + "|".join(sorted(suffixes, reverse=True)) + ")"


def addresses(text: Column, end: str) -> Column:
    """Absolute addresses that stand by themselves, up to ``end``."""
    starts = F.flatten(F.transform(words(text), lambda w: F.split(w, "(?i)(?=https?://)")))
    found = F.filter(starts, lambda w: w.rlike("(?i)^https?://"))
    return F.array_compact(F.transform(found, lambda w: up_to_end(w, end)))


def rooted(ref: Column) -> Column:
    return ref.rlike("(?i)^(?:https?:/)?/")


def attribute(tag: Column, name: str) -> Column:
    return F.regexp_extract(tag, rf"(?i)\b{name}\s*=\s*[\"']([^\"']*)[\"']", 1)


def all_matches(text: Column, pattern: str, group: int) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(group))


# --- documents -----------------------------------------------------------


# positions in a page are below 2**31, so kinds that come later never collide
SCRIPTS_AFTER, FETCHED_AFTER = 1 << 32, 1 << 33


def inline_documents(html: Column, url: Column) -> Column:
    """Array of struct(url, kind, text, pos): style sheets, JSON and font
    scripts in a page, none of them empty."""
    sheets = F.transform(
        all_matches(html, r"(?is)<style\b[^>]*>(.*?)</style>", 1),
        lambda t, i: F.struct(url.alias("url"), F.lit("css").alias("kind"), trim_all(t).alias("text"), i.cast("long").alias("pos")),
    )

    def read(tag: Column, i: Column) -> Column:
        head = F.regexp_extract(tag, r"(?is)^(<script\b[^>]*>)", 1)
        parts = F.struct(
            attribute(head, "id").alias("id"), F.lower(attribute(head, "type")).alias("type"), head.rlike(r"(?i)\bsrc\s*=").alias("elsewhere"),
            trim_all(F.regexp_extract(tag, r"(?is)^<script\b[^>]*>(.*)</script>$", 1)).alias("text"),
        )

        def kept(s: Column) -> Column:
            is_json = F.contains(s["type"], F.lit("json")) | (s["id"] == "__NEXT_DATA__")
            name = F.when(is_json, F.coalesce(blank_to_null(s["id"]), F.lit("inline-json"))).otherwise("inline-script")
            kind = F.when(is_json, "inline-json").when(s["text"].rlike(fv.FONT_HINT), "inline-script")
            found = F.struct(F.concat(url, F.lit("#"), name).alias("url"), kind.alias("kind"), s["text"].alias("text"), (i + F.lit(SCRIPTS_AFTER)).alias("pos"))
            return F.when(~s["elsewhere"] & kind.isNotNull(), found)

        return let(parts, kept)

    scripts = F.transform(all_matches(html, r"(?is)<script\b[^>]*>.*?</script>", 0), read)
    return F.filter(F.concat(sheets, F.array_compact(scripts)), lambda d: d["text"] != "")


def extract_inline_docs(pages: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """(page_id, url, kind, text, pos): style sheets, JSON and font scripts in a
    page; ``keep`` names columns of the page that its documents carry on."""
    inside = F.inline(inline_documents(C("html"), C("url")))
    named = pages.select("page_id", *keep, "url", "html").select("page_id", *keep, inside)
    return named.select("page_id", "url", *keep, "kind", "text", "pos")


def page_documents(html: Column, url: Column) -> Column:
    """The page itself and what is inline in it, as an array in the order of
    ``union_documents``: struct(url, kind, text, doc_pos)."""
    own = F.struct(url.alias("url"), F.lit("html").alias("kind"), html.alias("text"), F.lit(-1).cast("long").alias("doc_pos"))
    inside = F.transform(
        inline_documents(html, url), lambda d: F.struct(d["url"].alias("url"), d["kind"].alias("kind"), d["text"].alias("text"), d["pos"].alias("doc_pos"))
    )
    return F.concat(F.array(own), inside)


def union_documents(pages: DataFrame, fetched: DataFrame | None = None, keep: tuple[str, ...] = ()) -> DataFrame:
    """Page, inline and stored side documents as one typed relation in order;
    ``keep`` as in ``extract_inline_docs`` (side documents must have these)."""
    own = pages.select(
        "page_id", "url", *keep, F.lit("html").alias("kind"), C("html").alias("text"), F.lit(-1).alias("pos")
    )
    out = own.unionByName(extract_inline_docs(pages, keep))
    if fetched is not None:
        out = out.unionByName(fetched.select("page_id", "url", *keep, "kind", "text", (C("pos") + FETCHED_AFTER).alias("pos")))
    return out


# --- asset URLs ----------------------------------------------------------


def css_references(css: Column) -> Column:
    """What stands in each url(...), without its quotes."""
    return all_matches(css, r"(?i)url\(\s*([\"']?)([^\"')]+)\1\s*\)", 2)


def css_font_references(css: Column) -> Column:
    return F.filter(css_references(css), lambda r: suffix_of(r).isin(fv.CORE_FORMATS))


def attribute_references(text: Column) -> Column:
    """Values of href and src."""
    # most strings have no such lead, and only a lead with its mark is worth the pattern
    named = lambda lead: F.contains(lead, F.lit("=")) & lead.rlike(r"(?i)\b(?:href|src)=$")

    def of(quote: str) -> Column:
        inner = lambda pieces: F.slice(pieces, 2, F.greatest(F.size(pieces) - 2, F.lit(0)))
        value = lambda pieces: lambda piece, i: F.when(named(F.get(pieces, i)), F.rtrim(piece, F.lit("\\")))
        return let(F.split(text, quote), lambda pieces: F.array_compact(F.transform(inner(pieces), value(pieces))))

    return F.concat(of('"'), of("'"))


def bare_references(text: Column) -> Column:
    """Font addresses in running text: absolute, from the root, or from here;
    they begin where no name goes on."""
    fonts = F.filter(words(text), lambda w: F.contains(w, F.lit(".")) & w.rlike("(?i)[.](?:woff|otf|ttf)"))
    begun = F.transform(fonts, lambda w: F.regexp_extract(w, r"(?i)(?:^|[^\w.-])((?:https?:/|[.]{0,2})/.+)", 1))
    return F.array_compact(F.transform(begun, lambda w: up_to_end(w, any_of(fv.CORE_FORMATS))))


def font_url_refs(text: Column) -> Column:
    """Raw font references of a text: css url(), attributes, then bare ones."""
    refs = F.concat(css_font_references(text), attribute_references(text), bare_references(text))
    return F.array_distinct(
        F.filter(F.transform(refs, lambda r: trim_all(F.replace(r, F.lit("\\/"), F.lit("/")))), lambda r: r.rlike("(?i)" + fv.FONT_URL))
    )


def font_urls(text: Column, base: Column) -> Column:
    """Distinct resolved font URLs of a text, in order."""
    return F.array_distinct(F.array_compact(F.transform(font_url_refs(text), lambda r: urls.resolve_url(r, base))))


def payload_urls(text: Column, base: Column) -> Column:
    """Second dialect: archives and strings of data count too; the value of a
    "url" field needs no slash in front."""
    wanted = [*fv.CORE_FORMATS, *ARCHIVES]
    fields = F.filter(strings(text, '"'), lambda s: (F.lower(s["name"]) == "url") & s["lead"].rlike(r"^\s*:\s*$"))
    data = F.concat(F.filter(values(text), rooted), F.transform(fields, lambda s: s["value"]))
    refs = F.concat(addresses(text, any_of(wanted)), F.filter(data, lambda r: suffix_of(r).isin(wanted)))
    return F.array_distinct(
        F.array_compact(F.transform(F.array_distinct(refs), lambda r: urls.resolve_url(r, base)))
    )


def css_urls(text: Column, base: Column) -> Column:
    """Every url(...) of a style sheet but data URLs, resolved and distinct."""
    refs = F.transform(
        all_matches(text, r"(?i)url\(([^)]+)\)", 1), lambda r: F.regexp_replace(trim_all(r), "^['\"]|['\"]$", "")
    )
    kept = F.filter(F.array_distinct(refs), lambda r: (r != "") & ~r.startswith("data:"))
    return F.array_distinct(F.array_compact(F.transform(kept, lambda r: urls.resolve_url(r, base))))


def document_links(text: Column, base: Column) -> Column:
    """PDF and ``/pdfs/<slug>`` links, quoted, bare or escaped."""
    sheet = f"{any_of(['pdf'])}|/pdfs/[a-z0-9-]+"
    refs = F.concat(addresses(text, sheet), F.filter(values(text), lambda r: rooted(r) & r.rlike(f"(?i)(?:{sheet})(?:[?]|$)")))
    cleaned = F.array_distinct(
        F.transform(refs, lambda r: decode_html_entities(F.regexp_replace(trim_all(r), r"\\/", "/")))
    )
    resolved = F.transform(cleaned, lambda r: urls.resolve_url(r, base))
    kept = F.filter(
        resolved, lambda u: u.isNotNull() & (u.rlike(r"(?i)\.pdf(?:$|\?)") | u.rlike("(?i)/pdfs/[a-z0-9-]+(?:$|[/?#])"))
    )
    return F.array_distinct(kept)


def explode_urls(docs: DataFrame, found: Column, keys: list[str]) -> DataFrame:
    return docs.select(*keys, F.posexplode(found).alias("pos", "asset_url"))


def signal_score(text: Column, base: Column, kind: Column) -> Column:
    """2 for font URLs, 1 for a font hint, 1 for a style sheet, at most 4."""
    return F.least(
        F.lit(4),
        F.when(F.size(font_urls(text, base)) > 0, 2).otherwise(0)
        + F.when(text.rlike(fv.FONT_HINT), 1).otherwise(0)
        + F.when(kind == "css", 1).otherwise(0),
    )


# --- resources -----------------------------------------------------------


def resource_kind(url: Column, rel: Column, as_attr: Column, type_attr: Column) -> Column:
    low = F.lower(url)
    return (
        F.when(F.contains(rel, F.lit("stylesheet")) | (as_attr == "style") | F.contains(low, F.lit(".css")), "css")
        .when(F.contains(rel, F.lit("manifest")) | F.contains(low, F.lit("manifest")), "manifest")
        .when(F.contains(type_attr, F.lit("json")) | F.contains(low, F.lit(".json")) | (as_attr == "fetch"), "json")
        .when(
            (as_attr == "script") | low.rlike(r"\.m?js") | F.contains(rel, F.lit("modulepreload")),
            "js",
        )
    )


def resource_score(kind: Column, rel: Column, url: Column, page_url: Column, tokens: Column, boost: Column) -> Column:
    host_path = F.lower(F.concat(urls.host_of(url), urls.path_of(url)))
    same_origin = (urls.scheme_of(url) == urls.scheme_of(page_url)) & (urls.host_of(url) == urls.host_of(page_url))

    def by_place(hp: Column) -> Column:
        return (
            F.when(F.exists(tokens, lambda t: F.contains(hp, t)), 18).otherwise(0)
            + F.when(hp.rlike(fv.RESOURCE_HINT), 10).otherwise(0)
        )

    return (
        F.when(kind == "css", 120).when(kind == "manifest", 100).when(kind == "json", 90).when(kind == "js", 70).otherwise(0)
        + F.when(rel.rlike("preload|prefetch"), 12).otherwise(0)
        + F.when(
            urls.is_web_url(page_url),
            F.when(same_origin, 20).otherwise(0)
            + let(host_path, by_place)
            + F.when(urls.path_of(url).rlike(r"(?i)\.map(?:$|\?)"), -40).otherwise(0),
        ).otherwise(-10)
        + F.least(F.lit(40), F.greatest(F.lit(0), F.coalesce(boost, F.lit(0))))
    )


def resource_tags(html: Column) -> Column:
    """The tags of a page that may name a resource, links first."""
    return F.concat(
        F.filter(all_matches(html, r"(?is)<link\b[^>]*>", 0), lambda t: t.rlike(r"(?i)\bhref\s*=")),
        F.filter(all_matches(html, r"(?is)<script\b[^>]*>", 0), lambda t: t.rlike(r"(?i)\bsrc\s*=")),
    )


def resource_candidates(pages: DataFrame) -> DataFrame:
    """(page_id, page_url, tokens, url, kind, rel, memory_key, pos) before scoring."""
    tokens = urls.target_tokens(C("url"), C("html"))
    return tag_candidates(pages.select("page_id", "url", tokens.alias("tokens"), resource_tags(C("html")).alias("tags")))


def tag_candidates(pages: DataFrame) -> DataFrame:
    """``resource_candidates`` of pages whose ``tokens`` and ``tags`` are read."""
    rows = pages.select("page_id", C("url").alias("page_url"), "tokens", F.posexplode("tags").alias("pos", "tag"))
    is_link = C("tag").rlike("(?i)^<link")
    read = computed(
        rows,
        url=urls.resolve_url(
            F.when(is_link, attribute(C("tag"), "href")).otherwise(attribute(C("tag"), "src")), C("page_url")
        ),
        rel=F.when(is_link, F.lower(normalize_space(attribute(C("tag"), "rel")))).otherwise("script"),
        as_attr=F.lower(attribute(C("tag"), "as")),
        type_attr=F.lower(attribute(C("tag"), "type")),
        is_link=is_link,
    ).drop("tag")
    kinds = read.withColumn(
        "kind",
        F.when(C("is_link"), resource_kind(C("url"), C("rel"), C("as_attr"), C("type_attr"))).otherwise("js"),
    )
    kept = kinds.filter(
        C("url").isNotNull()
        & C("kind").isNotNull()
        & (C("url").rlike(fv.TEXT_RESOURCE) | (C("kind") == "manifest"))
        & ~urls.is_noise_resource(C("url"))
    )
    return kept.withColumn("memory_key", urls.memory_key(C("url"), C("kind"), C("rel"))).drop(
        "as_attr", "type_attr", "is_link"
    )


def score_resources(candidates: DataFrame) -> DataFrame:
    """Add ``score``; ``boost`` is used when the candidates carry one."""
    boost = C("boost") if "boost" in candidates.columns else F.lit(0)
    return candidates.withColumn(
        "score", resource_score(C("kind"), C("rel"), C("url"), C("page_url"), C("tokens"), boost)
    ).drop("tokens")


def best_resources(scored: DataFrame) -> DataFrame:
    """One row per page and URL: best score, first in the page on ties."""
    return first_by(scored, ["page_id", "url"], [-C("score"), C("pos")])


def top_resources(best: DataFrame, k: int) -> DataFrame:
    return top_k(best, ["page_id"], [C("score").desc(), C("url")], k)


# --- other readings ------------------------------------------------------


def embedded_json_rows(pages: DataFrame, script_id: str, path: str) -> DataFrame:
    """Array rows at a path of a page's embedded JSON; bad JSON gives no rows."""
    body = F.regexp_extract("html", rf"(?is)<script[^>]*\bid=[\"']{script_id}[\"'][^>]*>(.*?)</script>", 1)
    items = F.from_json(
        F.get_json_object(F.to_json(F.try_parse_json(body)), path), "array<string>"
    )
    return pages.select("page_id", F.posexplode(items).alias("pos", "item"))


def anchor_assets(pages: DataFrame) -> DataFrame:
    """(page_id, pos, asset_url, label, asset_class) of anchors that lead to files."""
    anchors = pages.select(
        "page_id",
        "url",
        F.posexplode(all_matches(C("html"), r"(?is)<a\b[^>]*>.*?</a>", 0)).alias("pos", "tag"),
    )
    head, body = r"(?is)^(<a\b[^>]*>)", r"(?is)^<a\b[^>]*>(.*)</a>$"
    read = computed(
        anchors,
        asset_url=urls.resolve_url(decode_html_entities(attribute(F.regexp_extract("tag", head, 1), "href")), C("url")),
        label=normalize_space(
            decode_html_entities(F.regexp_replace(F.regexp_extract("tag", body, 1), "<[^>]+>", " "))
        ),
    ).drop("tag", "url").filter(C("asset_url").isNotNull() & C("asset_url").rlike(r"(?i)\.(?:woff2?|ttf|otf|zip|pdf)(?:$|[?#])"))
    return read.withColumn("asset_class", anchor_class(C("asset_url"), C("label")))


def anchor_class(url: Column, label: Column) -> Column:
    ext = F.lower(F.regexp_extract(urls.path_of(url), r"\.([^./]*)$", 1))
    said = F.lower(F.concat_ws(" ", url, label))
    return (
        F.when((ext == "pdf") & said.rlike(fv.LEGAL_DOCUMENT), "legal-pdf")
        .when((ext == "pdf") & said.rlike(fv.SHEET_DOCUMENT), "sheet-pdf")
        .when(ext == "pdf", "pdf")
        .when((ext == "zip") & said.rlike(fv.TRIAL_ASSET), "trial-zip")
        .when(ext == "zip", "zip")
        .when(F.contains(F.lower(url), F.lit(fv.PREVIEW_HOST)), "preview-firebase-font")
        .when(ext.isin("otf", "ttf"), "desktop-file")
        .when(ext.isin("woff", "woff2"), "preview-font")
        .otherwise("other")
    )


def feature_tags(text: Column) -> Column:
    """Distinct OpenType feature tags named in a text, sorted."""
    return F.array_sort(F.array_distinct(F.transform(all_matches(text, ascii_bounds(fv.FEATURE_TAG), 1), F.lower)))


def form_feature_tags(html: Column) -> Column:
    """Feature tags that a page's form controls name, sorted: in the attributes
    of inputs, selects and options, or as values of known feature switches."""
    numbered = r"ss\d{2}|cv\d{2}"
    named = ascii_bounds(rf"(?i)\b({numbered}|{'|'.join(fv.FORM_FEATURE_TAGS)})\b")

    def of_control(tag: Column) -> Column:
        said = F.concat_ws(" ", *[normalize_space(attribute(tag, a)) for a in fv.FORM_FEATURE_ATTRIBUTES])
        value = F.lower(normalize_space(attribute(tag, "value")))
        is_switch = tag.rlike("(?i)^<input") & attribute(tag, "name").rlike("(?i)" + "|".join(fv.FORM_FEATURE_CONTROLS))
        own = F.when(is_switch & value.rlike(rf"^(?:{numbered}|[a-z]{{3,5}})$"), F.array(value)).otherwise(F.array().cast("array<string>"))
        return F.concat(F.transform(all_matches(said, named, 1), F.lower), own)

    controls = all_matches(html, r"(?is)<(?:input|select|option)\b[^>]*>", 0)
    return F.array_sort(F.array_distinct(F.flatten(F.transform(controls, of_control))))


def spelled_style(c: Column) -> Column:
    """Sample-sheet spelling of a style phrase: folded compounds, capitalised words."""
    folded = reduce(
        lambda acc, r: F.regexp_replace(acc, r[0], r[1]),
        [
            (r"(?i)semi\s*-?\s*bold", "Semibold"),
            (r"(?i)demi\s*-?\s*bold", "Semibold"),
            (r"(?i)extra\s*-?\s*light", "Extralight"),
            (r"(?i)extra\s*-?\s*bold", "Extrabold"),
            (r"(?i)ultra\s*-?\s*light", "Extralight"),
        ],
        c,
    )
    return F.initcap(normalize_space(folded))


def style_candidates(text: Column) -> Column:
    """Style phrases of a sample-sheet text, normalised, distinct, sorted."""
    plain = F.regexp_replace(F.regexp_replace(text, r"[/|]+", " "), r"\s+", " ")
    phrase = ascii_bounds(
        rf"(?i)\b(?:(?:{fv.SHEET_WIDTH_WORDS})\s+)?(?:{fv.SHEET_STYLE_WORDS})(?:\s+(?:italic|oblique))?\b"
    )

    def found(t: Column) -> Column:
        spaced = F.transform(all_matches(t, phrase, 0), spelled_style)
        compact = F.transform(
            all_matches(t, ascii_bounds(fv.COMPACT_STYLE), 0), lambda s: spelled_style(F.regexp_replace(s, "([a-z])([A-Z])", "$1 $2"))
        )
        both = F.array_distinct(F.concat(spaced, compact))

        def with_italic(a: Column) -> Column:
            wanted = (
                F.array_contains(a, "Regular")
                & t.rlike(ascii_bounds(r"(?i)\b(?:italic|oblique)\b"))
                & ~F.arrays_overlap(a, F.array(F.lit("Italic"), F.lit("Regular Italic"), F.lit("Regular Oblique")))
            )
            return F.when(wanted, F.array_append(a, F.lit("Italic"))).otherwise(a)

        return let(both, with_italic)

    return F.array_sort(let(plain, found))


def language_hints(text: Column) -> Column:
    """Script names that occur in a text, in fixed order."""
    names = F.array(*[F.lit(n) for n in fv.SCRIPT_NAMES])
    return let(normalize_token(text), lambda t: F.filter(names, lambda n: F.contains(t, n)))


def blocked_page(status: Column, title: Column, html: Column, blocked_status: list[int]) -> Column:
    """Struct(blocked, signals, reason) of a stored page that is a challenge page."""
    sample = F.lower(F.concat(title, F.lit("\n"), html))

    def hits(text: Column, patterns: list[str], tag: str) -> Column:
        return F.array_compact(F.array(*[F.when(text.rlike(p), F.lit(f"{tag}:{p}")) for p in patterns]))

    def verdict(x: Column) -> Column:
        soft, strong = F.size(x["soft"]), F.size(x["strong"])
        by_status = F.size(x["status"]) > 0
        blocked = by_status | (strong > 0) | (soft >= 2)
        parts = F.array_compact(
            F.array(
                F.when(by_status, F.concat(F.lit("status "), status.cast("string"))),
                F.when(strong > 0, F.concat(F.lit("strong-signals "), strong.cast("string"))),
                F.when(soft > 0, F.concat(F.lit("signals "), soft.cast("string"))),
            )
        )
        return F.struct(
            blocked.alias("blocked"),
            F.concat(x["status"], x["soft"], x["strong"]).alias("signals"),
            F.when(
                blocked, F.concat(F.lit("Blocked page detected ("), F.array_join(parts, ", "), F.lit(")."))
            ).alias("reason"),
        )

    parts = let(
        sample,
        lambda t: F.struct(
            F.array_compact(
                F.array(F.when(status.isin(blocked_status), F.concat(F.lit("status:"), status.cast("string"))))
            ).alias("status"),
            hits(t, fv.BLOCKED_SOFT, "pattern").alias("soft"),
            hits(t, fv.BLOCKED_STRONG, "strong").alias("strong"),
        ),
    )
    return let(parts, verdict)


def catalog_entries(pages: DataFrame, prefix: str = "/fonts/") -> DataFrame:
    """(page_id, slug, title): catalogue links of a page, first title per slug.

    A slug may have several parts; keys of the page's font table in scripts
    are entries too, after the links and without a title.
    """
    anchors = pages.select(
        "page_id",
        F.posexplode(
            all_matches(C("html"), rf"(?is)<a\b[^>]*href=[\"']{prefix}[^\"'?#]+[^\"']*[\"'][^>]*>.*?</a>", 0)
        ).alias("pos", "tag"),
    )
    read = anchors.select(
        "page_id",
        "pos",
        F.lower(F.regexp_extract("tag", rf"(?i)href=[\"']{prefix}([^\"'?#]+)", 1)).alias("slug"),
        normalize_space(decode_html_entities(F.regexp_replace("tag", "<[^>]+>", " "))).alias("title"),
    )
    keys = pages.select("page_id", F.posexplode(all_matches(C("html"), r"(?i)window\.FontMetadata\['([^']+)'\]", 1)).alias("pos", "key")).select(
        "page_id", (C("pos") + SCRIPTS_AFTER).alias("pos"), F.lower(normalize_space(C("key"))).alias("slug"), F.lit(None).cast("string").alias("title")
    )
    every = read.unionByName(keys).filter("slug <> ''")
    return first_by(every, ["page_id", "slug"], [C("pos")]).drop("pos")


def glyph_payload_stats(html: Column) -> Column:
    """Struct(glyph_sets, glyph_tokens) of the character payloads of a page."""
    sets = all_matches(html, r"(?i)data-characters=[\"']([^\"']*)[\"']", 1)
    return let(
        sets,
        lambda a: F.struct(
            F.size(a).alias("glyph_sets"),
            F.aggregate(a, F.lit(0), lambda n, s: n + F.regexp_count(s, F.lit(r"\S+"))).alias("glyph_tokens"),
        ),
    )
