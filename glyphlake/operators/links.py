"""Links of pages, their admission to a crawl, and routing to rules."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from glyphlake import fixed_values as fv
from glyphlake.functions import urls
from glyphlake.functions.text import let

#: what a rule's pattern may consist of for its literals to be told: characters
#: that stand for themselves, and flags, groups, anchors and alternatives
LITERAL_PART = r"(?:[A-Za-z0-9/-]|\\\.)(?![?*+{])"
PATTERN_PART = LITERAL_PART + r"|\(\?-?i\)|\((?!\?)(?:[^()\\]|\\.)*\)\??(?![?*+{])|[\^$|]"

ANCHOR_HREF = r"(?i)<a\b[^>]*?\bhref\s*=\s*[\"']([^\"']+)[\"']"


def extract_links(pages: DataFrame) -> DataFrame:
    """(page_id, url, link, pos): distinct crawl-normal links in page order.

    References become links inside the array, before the explode: each is
    resolved once, however many filters follow, and ``html`` goes no further.
    A link that a page repeats is dropped there too, by sorting the page's own
    links, so nothing is shuffled.
    """
    found = F.transform(
        F.regexp_extract_all("html", F.lit(ANCHOR_HREF), F.lit(1)),
        lambda h, i: F.struct(urls.normalize_crawl_url(urls.resolve_url(h, F.col("url"))).alias("link"), i.alias("pos")),
    )

    def once(ordered: Column) -> Column:
        return F.filter(ordered, lambda x, i: ~(x["link"] == F.coalesce(F.get(ordered, i - 1)["link"], F.lit(""))))

    links = let(F.array_sort(F.filter(found, lambda x: x["link"].isNotNull())), once)
    return pages.select("page_id", "url", F.inline(links)).select("page_id", "url", "link", "pos")


def seed_hosts(pages: DataFrame) -> DataFrame:
    return pages.select(urls.host_of(F.col("url")).alias("host")).filter("host <> ''").distinct()


def crawl_admission(
    links: DataFrame, domains: DataFrame | None, exclude: list[str] = fv.CRAWL_EXCLUDE
) -> DataFrame:
    """Links on an allowed host, with no media extension and no excluded part.

    ``domains`` is a one-column table ``host``; it may be large, so the choice
    between a broadcast and a shuffled semi-join is left to the optimiser.
    """
    link = F.col("link")
    kept = links.filter(
        urls.is_web_url(link) & ~urls.has_skip_extension(urls.path_of(link)) & ~urls.is_excluded(link, exclude)
    ).withColumn("host", urls.host_of(link))
    return kept if domains is None else kept.join(domains, "host", "left_semi")


def routing_dim(spark: SparkSession) -> DataFrame:
    rows = [(i, rule, part, pattern) for i, (rule, part, pattern) in enumerate(fv.ROUTING_RULES, 1)]
    return spark.createDataFrame(rows, "priority int, rule string, part string, pattern string")


def preset_dim(spark: SparkSession) -> DataFrame:
    schema = T.StructType(
        [
            T.StructField(n, T.StringType())
            for n in ("preset", "mode", "items_path", "url_field", "name_field", "license_field")
        ]
    )
    return spark.createDataFrame(fv.SOURCE_PRESETS, schema)


def case_dim(spark: SparkSession) -> DataFrame:
    rows = [(i, case, url, case, 1, timeout, soft) for i, (case, url, timeout, soft) in enumerate(fv.SUITE_CASES, 1)]
    return spark.createDataFrame(
        rows,
        "pos int, id string, url string, expected_rule string, min_downloaded int, timeout_ms int, soft_pass boolean",
    )


def rule_test(url: Column, part: str, pattern: str) -> Column:
    return (urls.hostname_of(url) if part == "host" else url).rlike(pattern) if pattern else F.lit(True)


def needed_literals(pattern: str) -> list[str]:
    """Lower-cased literals, one per alternative of a pattern, one of which is
    in every text the pattern accepts.  Empty where that cannot be told from
    the pattern: it has other syntax than the rules use, or asks for no text.
    """
    if not re.fullmatch(f"(?:{PATTERN_PART})*", pattern):
        return []
    longest = [""]
    for part in re.findall(f"(?:{LITERAL_PART})+|{PATTERN_PART}", pattern):
        if part == "|":
            longest.append("")
        elif re.match(LITERAL_PART, part):
            longest[-1] = max(longest[-1], part.replace("\\.", ".").lower(), key=len)
    return longest if all(longest) else []


def dotted_key(literal: str) -> str | None:
    """The last three characters before a dot, the dot and the two after it."""
    found = re.search(r"[^.]{3}\.[^.]{2}", literal)
    return found and found[0]


def _has_literal(literals: list[str], url: Column, keys: Column) -> Column:
    """Whether the URL may hold one of the literals; ``keys`` of its dots decide
    for literals that have a key, the whole URL for the others."""
    filed = [k for k in map(dotted_key, literals) if k]
    plain = [text for text in literals if not dotted_key(text)]
    tests = [F.contains(url, F.lit(text)) for text in plain]
    if filed:
        tests.append(F.exists(keys, lambda k: k.isin(sorted(set(filed)))))
    return reduce(lambda x, y: x | y, tests)


def first_rule(url: Column, rules=None) -> Column:
    """Id of the first rule, in registry order, that accepts the URL.

    The registry is a fixed list, so it becomes one CASE expression: no join,
    no shuffle, and evaluation stops at the first hit.  A pattern is tested
    only on a URL that has one of its literals; literals are domain names, so
    they are found by the characters around the few dots of the URL.  A URL
    with no literal of any rule, as most links of a crawl, meets only the rules
    that need none.
    """
    rules = fv.ROUTING_RULES if rules is None else rules
    literals = [needed_literals(pattern) for _, _, pattern in rules]

    def cases(chosen: list[tuple], seen: Column | None) -> Column:
        out = F
        for (rule, part, pattern), needed in chosen:
            test = rule_test(url, part, pattern)
            out = out.when(_has_literal(needed, seen["url"], seen["keys"]) & test if needed else test, F.lit(rule))
        return F.lit(None).cast("string") if out is F else out

    always = cases([(r, []) for r, needed in zip(rules, literals) if not needed], None)
    wanted = sorted({text for needed in literals for text in needed})
    if not wanted:
        return always
    lower = F.lower(url)

    def keyed(parts: Column) -> Column:
        around = F.transform(parts, lambda p, i: F.concat(F.right(p, F.lit(3)), F.lit("."), F.left(F.get(parts, i + 1), F.lit(2))))
        return F.struct(lower.alias("url"), F.filter(around, lambda k: k.isNotNull()).alias("keys"))

    def chosen(seen: Column) -> Column:
        every = cases(list(zip(rules, literals)), seen)
        return F.when(_has_literal(wanted, seen["url"], seen["keys"]), every).otherwise(always)

    return let(let(F.split(lower, r"\."), keyed), chosen)


def route(df: DataFrame, url: str = "url") -> DataFrame:
    """Add ``rule``, in the link's row."""
    return df.withColumn("rule", first_rule(F.col(url)))


def links_by_rule_and_host(pages: DataFrame) -> DataFrame:
    """Distinct admitted links per owning rule and host."""
    admitted = crawl_admission(extract_links(pages), seed_hosts(pages))
    return (
        route(admitted.select("host", "link").distinct(), "link")
        .groupBy("rule", "host")
        .agg(F.count("*").alias("links"))
    )
