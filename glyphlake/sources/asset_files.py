"""Font files at rest: listing, signatures and the fields of plain sfnt files."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from glyphlake.functions.files import sniff_signature
from glyphlake.functions.text import base_name, extension, let

C = F.col
#: tables read, by tag, and the ids of the names read
TABLES = {"maxp": "maxp", "head": "head", "hhea": "hhea", "OS/2": "os2", "name": "name"}
NAMED = (1, 2, 4, 6, 16, 17)
EXTENSIONS = ("woff2", "woff", "ttf", "otf", "eot")


def read_asset_files(spark: SparkSession, path: str, extensions=EXTENSIONS, with_content: bool = False) -> DataFrame:
    """(path, filename, ext, size_bytes[, content]) of the font files below a
    folder.  Without ``content`` the bytes are pruned from the scan."""
    pattern = "*.{" + ",".join(extensions) + "}"
    files = (
        spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(path)
    )
    columns = ["path", base_name(C("path")).alias("filename"), extension(C("path")).alias("ext"), C("length").alias("size_bytes")]
    return files.select(*columns, *(["content"] if with_content else []))


def newest_report(spark: SparkSession, path: str, suite: str) -> str | None:
    """Path of the newest report of a suite, from the names alone: no file is
    opened for it."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", f"{suite}-*.json").load(path)
    return files.agg(F.max_by("path", base_name(C("path")))).first()[0]


def read_run_reports(spark: SparkSession, path: str, suite: str) -> DataFrame | None:
    """Result rows of the newest report of a suite (files named
    suite-<stamp>.json); older ones, damaged or not, are not read.  None if
    there is no report."""
    newest = newest_report(spark, path, suite)
    if newest is None:
        return None
    report = spark.read.option("multiLine", "true").json(newest)
    return report.select(F.lit(newest.rsplit("/", 1)[-1]).alias("file"), "suite", F.explode("results").alias("r")).select("file", "suite", "r.*")


def _bytes(b: Column, at: Column, size: Column) -> Column:
    """Bytes of a file; NULL where a damaged offset or size leads outside it."""
    inside = (at >= 0) & (size >= 0) & (at + size <= F.octet_length(b))
    return F.when(inside, F.substring(b, (at + 1).cast("int"), size.cast("int")))


def _number(b: Column, at: Column, size: int) -> Column:
    return F.conv(F.hex(_bytes(b, at, F.lit(size))), 16, 10).cast("long")


def _u16(b: Column, at: Column) -> Column:
    return _number(b, at, 2).cast("int")


def _u32(b: Column, at: Column) -> Column:
    return _number(b, at, 4)


def _each(count: Column, record: Callable[[Column], Column]) -> Column:
    """``record(i)`` for i below ``count``; no records if there is no count."""
    numbers = F.when(count > 0, F.sequence(F.lit(0), count - 1)).otherwise(F.array().cast("array<int>"))
    return F.transform(numbers, record)


def _i16(b: Column, at: Column) -> Column:
    return let(_u16(b, at), lambda v: F.when(v >= 32768, v - 65536).otherwise(v))


def sfnt_metrics(content: Column) -> Column:
    """Struct of the fixed-offset fields audits need; NULL for other formats.

    Reads the table directory, then single fields: no font is decoded.  Of
    tables with one tag the first counts; fields that a damaged file does not
    have are NULL.
    """

    def parse(b: Column) -> Column:
        directory = _each(
            _u16(b, F.lit(4)),
            lambda i: F.struct(
                F.decode(F.coalesce(_bytes(b, i * 16 + 12, F.lit(4)), F.lit(b"")), "ISO-8859-1").alias("tag"), _u32(b, i * 16 + 20).alias("offset")
            ),
        )
        return let(let(let(F.struct(b.alias("b"), directory.alias("d")), starts), named), fields)

    # what several fields need is bound first: where the tables start, then the names
    def starts(x: Column) -> Column:
        first = lambda tag: F.get(F.filter(x["d"], lambda t: t["tag"] == tag), F.lit(0))["offset"]
        return F.struct(x["b"].alias("b"), *[first(tag).alias(field) for tag, field in TABLES.items()])

    def named(x: Column) -> Column:
        kept = F.filter(_names(x["b"], x["name"]), lambda r: r["id"].isin(*NAMED) & (r["text"] != ""))
        return F.struct(x.alias("t"), kept.alias("names"))

    def fields(x: Column) -> Column:
        t = x["t"]
        b = t["b"]

        def at(tag: str, offset: int) -> Column:
            return t[TABLES[tag]] + offset

        def name(nid: int) -> Column:
            return F.get(F.filter(x["names"], lambda r: r["id"] == nid), F.lit(0))["text"]

        return F.struct(
            _u16(b, at("maxp", 4)).alias("num_glyphs"),
            _u16(b, at("head", 18)).alias("units_per_em"),
            _u16(b, at("head", 44)).alias("mac_style"),
            _u16(b, at("OS/2", 4)).alias("weight_class"),
            _u16(b, at("OS/2", 62)).alias("fs_selection"),
            F.struct(
                _i16(b, at("hhea", 4)).alias("ascender"), _i16(b, at("hhea", 6)).alias("descender"), _i16(b, at("hhea", 8)).alias("line_gap")
            ).alias("hhea"),
            F.struct(
                _i16(b, at("OS/2", 68)).alias("typo_ascender"),
                _i16(b, at("OS/2", 70)).alias("typo_descender"),
                _i16(b, at("OS/2", 72)).alias("typo_line_gap"),
                _u16(b, at("OS/2", 74)).alias("win_ascent"),
                _u16(b, at("OS/2", 76)).alias("win_descent"),
            ).alias("os2"),
            F.coalesce(name(16), name(1)).alias("family_name"),
            F.coalesce(name(17), name(2)).alias("subfamily_name"),
            name(4).alias("full_name"),
            name(6).alias("postscript_name"),
        )

    return F.when(sniff_signature(content).isin("ttf", "otf"), let(content, parse))


def _names(b: Column, start: Column) -> Column:
    """Array of struct(id, text) of the name table at ``start``."""

    def record(entry: Column) -> Column:
        raw = _bytes(b, entry["storage"] + _u16(b, entry["at"] + 10), _u16(b, entry["at"] + 8))
        return F.struct(_u16(b, entry["at"]).isin(0, 3).alias("wide"), _u16(b, entry["at"] + 6).alias("id"), raw.alias("raw"))

    def text(r: Column) -> Column:
        decoded = F.when(r["wide"], F.decode(r["raw"], "UTF-16BE")).otherwise(F.decode(r["raw"], "ISO-8859-1"))
        return F.struct(r["id"].alias("id"), F.trim(decoded).alias("text"))

    storage = start + _u16(b, start + 4)
    entries = let(storage, lambda at: _each(F.coalesce(_u16(b, start + 2), F.lit(0)), lambda i: F.struct((start + 6 + i * 12).alias("at"), at.alias("storage"))))
    return F.transform(F.transform(entries, record), text)
