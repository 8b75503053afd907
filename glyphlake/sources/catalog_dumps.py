"""Catalogue dumps at rest: item lists, shop products, nested collections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glyphlake import fixed_values as fv
from glyphlake.functions.files import license_class
from glyphlake.functions.text import base_name, blank_to_null, trim_all, without_extension
from glyphlake.functions.urls import path_of, resolve_url
from glyphlake.operators.picking import computed

C = F.col

PRODUCT = """struct<id:long,handle:string,title:string,vendor:string,product_type:string,tags:array<string>,
  options:array<struct<name:string,values:array<string>>>,
  variants:array<struct<id:long,title:string,option1:string,option2:string,option3:string,price:string,available:boolean>>>"""


def _variant_text(v: Column, path: str) -> Column:
    """Non-blank text at a path; numbers and objects do not count as text."""
    value = F.try_variant_get(v, path, "string")
    is_text = F.schema_of_variant(F.try_variant_get(v, path, "variant")) == "STRING"
    return F.when(is_text, blank_to_null(trim_all(value)))


def _url_at(item: Column, path: str) -> Column:
    """A URL text at a path, or the first URL key of an object there."""
    return F.coalesce(_variant_text(item, f"$.{path}"), *[_variant_text(item, f"$.{path}.{k}") for k in fv.API_URL_KEYS])


def _ladder(first: str, rest: list[str]) -> list[str]:
    return list(dict.fromkeys(p for p in [first.strip(), *rest] if p))


def read_api_items(
    payloads: DataFrame, items_path: str, url_field: str, name_field: str, license_field: str, base_url: Column
) -> DataFrame:
    """One row per item of each JSON payload (doc_id, payload).

    Items may be an array or an object.  An item that is a bare text is its own
    URL; others are searched along the field ladders.  ``reason`` is set where
    no URL was found: callers split the output on it.
    """
    parsed = payloads.withColumn("_v", F.try_parse_json("payload"))
    items = parsed.withColumn("_items", F.try_variant_get("_v", f"$.{items_path}", "variant"))
    rows = items.lateralJoin(
        payloads.sparkSession.tvf.variant_explode(C("_items").outer())
    ).select("doc_id", base_url.alias("base"), C("pos").alias("idx"), C("key").alias("item_key"), C("value").alias("item"))
    item = C("item")
    own = F.when(F.schema_of_variant(item) == "STRING", blank_to_null(trim_all(F.try_variant_get(item, "$", "string"))))
    raw = F.coalesce(own, *[_url_at(item, p) for p in _ladder(url_field, fv.API_URL_PATHS)])
    name = F.coalesce(*[_variant_text(item, f"$.{p}") for p in _ladder(name_field, fv.API_NAME_PATHS)])
    license_id = F.coalesce(*[_variant_text(item, f"$.{p}") for p in _ladder(license_field, fv.API_LICENSE_PATHS)])
    found = rows.select(
        "doc_id", "idx", "item_key", resolve_url(raw, C("base")).alias("source_url"), name.alias("given"), license_id.alias("license_id")
    )
    from_url = blank_to_null(
        F.trim(F.regexp_replace(without_extension(base_name(path_of(C("source_url")))), "[-_]+", " "))
    )
    return found.select(
        "doc_id",
        "idx",
        "item_key",
        "source_url",
        F.coalesce("given", from_url, F.concat(F.lit("font-"), (C("idx") + 1).cast("string"))).alias("name"),
        F.upper("license_id").alias("license_id"),
        license_class(C("license_id")).alias("license_class"),
        F.when(C("source_url").isNull(), F.lit("Font URL not found")).alias("reason"),
    )


def read_products(payloads: DataFrame) -> DataFrame:
    """Products that carry id, handle and title; ``product`` is a struct."""
    # parsed once per row: the filter must not take copies of the parser below
    parsed = computed(payloads, product=F.from_json("payload", PRODUCT)).drop("payload")
    p = C("product")
    return parsed.filter(p["id"].isNotNull() & (trim_all(p["handle"]) != "") & (trim_all(p["title"]) != ""))


def product_variants(products: DataFrame) -> DataFrame:
    """(product_id, handle, pos, variant fields) of variants with id and title."""
    rows = products.select(
        C("product.id").alias("product_id"), C("product.handle").alias("handle"), F.posexplode("product.variants").alias("pos", "v")
    )
    return rows.filter(C("v.id").isNotNull() & C("v.title").isNotNull()).select(
        "product_id", "handle", "pos", C("v.id").alias("variant_id"), C("v.title").alias("variant_title"),
        "v.option1", "v.option2", "v.option3", C("v.price").try_cast("double").alias("price"), "v.available",
    )


STYLE = "struct<name:string,webfontSources:array<struct<format:string,url:string>>>"
LEAF = f"struct<name:string,fontStyles:array<{STYLE}>>"
COLLECTION = f"struct<name:string,fontStyles:array<{STYLE}>,children:array<{LEAF}>>"


def flatten_collections(payloads: DataFrame, default_name: str = "Catalogue") -> DataFrame:
    """Styles of a collection and of its children: woff2 before woff, each URL
    once per payload, children inherit a blank name."""
    root = F.from_json("payload", COLLECTION)
    parsed = payloads.select("doc_id", root.alias("r")).select(
        "doc_id",
        "r",
        F.coalesce(blank_to_null(trim_all(C("r.name"))), F.lit(default_name)).alias("root_name"),
    )
    member = lambda name, styles, child: F.struct(
        name.alias("family"), styles.alias("styles"), F.lit(child).alias("is_child")
    )
    members = F.concat(
        F.array(member(C("root_name"), C("r.fontStyles"), False)),
        F.transform(
            F.coalesce("r.children", F.array().cast(f"array<{LEAF}>")),
            lambda c: member(F.coalesce(blank_to_null(trim_all(c["name"])), C("root_name")), c["fontStyles"], True),
        ),
    )
    styles = (
        parsed.select("doc_id", F.posexplode(members).alias("member", "m"))
        .select("doc_id", "member", "m.family", "m.is_child", F.posexplode("m.styles").alias("pos", "style"))
    )
    by_format = lambda f: F.get(F.filter("style.webfontSources", lambda s: F.lower(s["format"]) == f), F.lit(0))
    picked = F.coalesce(by_format("woff2"), by_format("woff"))
    rows = styles.select(
        "doc_id", "member", "pos", "family", "is_child",
        F.coalesce(blank_to_null(trim_all(C("style.name"))), F.lit("Regular")).alias("style_name"),
        trim_all(picked["url"]).alias("url"), F.lower(picked["format"]).alias("format"),
    ).filter("url <> ''")
    from glyphlake.operators.picking import first_by

    return first_by(rows, ["doc_id", "url"], [C("member"), C("pos")])


def count_tree_styles(payloads: DataFrame) -> DataFrame:
    """(doc_id, styles) with a web font source anywhere in the tree.

    The depth is unknown, so levels are peeled off one by one; a level is
    checkpointed before the next is derived, and only child nodes travel.
    """
    from glyphlake.session import cut_lineage

    spark = payloads.sparkSession
    level = payloads.select("doc_id", F.try_parse_json("payload").alias("node"))
    total = None
    while total is None or not level.isEmpty():
        styles = level.withColumn("_s", F.try_variant_get("node", "$.fontStyles", "variant")).lateralJoin(
            spark.tvf.variant_explode(C("_s").outer())
        )
        found = styles.filter(F.try_variant_get("value", "$.webfontSources[0].url", "string") != "").select("doc_id")
        total = found if total is None else total.unionAll(found)
        children = level.withColumn("_c", F.try_variant_get("node", "$.children", "variant")).lateralJoin(
            spark.tvf.variant_explode(C("_c").outer())
        )
        level = cut_lineage(children.select("doc_id", C("value").alias("node")))
    return total.groupBy("doc_id").agg(F.count("*").alias("styles"))
