"""Which documents, by their names, belong to which families."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glyphlake import fixed_values as fv
from glyphlake.functions.text import base_name, let, normalized_words

C = F.col


def document_name_words(name: Column) -> Column:
    """Struct(stem_words, family_words) of a document's file name.

    The family ends at the first describing word, version or number; where
    that is the first word, only versions and numbers at the end are cut off.
    """
    describes = lambda w: w.isin(*fv.SHEET_DESCRIPTORS) | w.rlike(fv.DOCUMENT_VERSION)

    def without_versions(words: Column) -> Column:
        last = F.array_max(F.transform(words, lambda w, i: F.when(~w.rlike(fv.DOCUMENT_VERSION), i + 1)))
        return F.slice(words, F.lit(1), F.coalesce(last, F.lit(0)))

    def split(words: Column) -> Column:
        first = F.array_position(F.transform(words, describes), True)
        head = F.when(first > 1, F.slice(words, F.lit(1), (first - 1).cast("int"))).otherwise(words)
        return F.struct(words.alias("stem_words"), let(head, without_versions).alias("family_words"))

    return let(normalized_words(F.regexp_replace(base_name(name), r"(?i)\.pdf$", "")), split)


def name_matches(token: Column, family: Column) -> Column:
    """Equal, or the family followed by a describing word, a version, a digit."""
    rest = F.substring(token, F.length(family) + 1, F.length(token))
    described = rest.rlike("^(?:" + "|".join(fv.SHEET_DESCRIPTORS) + ")") | rest.rlike(fv.DOCUMENT_VERSION_START)
    return (token != "") & (family != "") & token.startswith(family) & ((rest == "") | described)


def document_relevance(documents: DataFrame, families: DataFrame) -> DataFrame:
    """(key, name, relevant) for documents (key, name) and the families (key,
    family) looked for under the same key; without any, all are relevant.

    An equi-join on the key; a family is a few words, and one hit decides.
    """
    named = documents.withColumn("_words", document_name_words(C("name"))).select(
        "key", "name", C("_words.family_words").alias("_family_words"),
        F.array_join("_words.family_words", "").alias("_family_token"), F.array_join("_words.stem_words", "").alias("_stem_token"),
    )
    wanted = families.select(C("key").alias("_key"), normalized_words(C("family")).alias("_wanted")).filter(F.size("_wanted") > 0)
    token = F.array_join("_wanted", "")
    hit = (C("_family_words") == C("_wanted")) | name_matches(C("_family_token"), token) | name_matches(C("_stem_token"), token)
    judged = named.join(wanted, C("key") == C("_key"), "left")
    return judged.groupBy("key", "name").agg(
        F.bool_or(F.when(C("_key").isNull(), F.lit(True)).otherwise((C("_stem_token") != "") & hit)).alias("relevant")
    )
