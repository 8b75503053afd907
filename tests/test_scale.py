"""Plans that must hold at sizes the other tests do not reach."""

import pytest

import __spark_entry__ as entry
from glyphlake.operators import coverage as cv
from glyphlake.plans.fixtures import fixture

QUERIES = entry.queries()


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def most_rows(plan):
    """Most rows that any step of a plan that has run made."""
    kind = plan.getClass().getSimpleName()
    if kind == "AdaptiveSparkPlanExec":
        return most_rows(plan.executedPlan())
    below = [plan.plan()] if kind.endswith("QueryStageExec") else [plan.children().apply(i) for i in range(plan.children().size())]
    own = plan.metrics().apply("numOutputRows").value() if plan.metrics().contains("numOutputRows") else 0
    return max([own, *map(most_rows, below)])


@pytest.mark.parametrize("name", ["dominant_prefix", "lookup_source", "prefix_match", "style_coverage", "target_audit"])
def test_derived_rows_are_not_broadcast(spark, sf, name):
    """The rows are unfolded from a small file, which tells nothing of their size."""
    assert "BroadcastExchange" not in plan_of(QUERIES[name](spark, sf))


def test_prefixes_are_not_broadcast(spark):
    names = spark.createDataFrame([("p", "abc"), ("p", "xy"), ("q", "abc")], "package string, token string")
    other = spark.createDataFrame([("p", "ab"), ("p", "xyz"), ("p", "zz")], "package string, token string")
    out = cv.without_prefix_match(names, other)
    assert "BroadcastExchange" not in plan_of(out)
    assert [tuple(r) for r in out.collect()] == [("q", "abc")]


def test_part_is_dealt_out_before_texts_are_made(spark, sf):
    cores = spark.sparkContext.defaultParallelism
    for name in ("products", "file_metrics"):
        assert fixture(spark, sf, name).rdd.getNumPartitions() >= cores
        plan = plan_of(fixture(spark, sf, name))
        assert plan.index("concat(") < plan.index("RoundRobinPartitioning")  # children come later


def test_products_are_parsed_once(spark, sf):
    plan = plan_of(QUERIES["build_profiles"](spark, sf))
    assert plan.count("from_json(") == 1
    assert plan.index("from_json(") < plan.index("RoundRobinPartitioning")


def test_metrics_are_parsed_once_a_row(spark, sf):
    plan = plan_of(QUERIES["sfnt_metrics"](spark, sf))
    assert "Generate inline" in plan and "RoundRobinPartitioning" in plan


def test_equal_families_make_no_pairs(spark):
    """300 requests for one name and 300 families of it: pairs would be 90,000."""
    from pyspark.sql import functions as F

    from glyphlake.operators.products import match_family

    n = F.col("id")
    alias = F.concat(F.lit("x"), n)
    families = spark.range(300).select(
        n.alias("family_id"), F.lit("red-ring").alias("ref"), F.array(alias).alias("aliases"), F.lit("red ring").alias("name"), (-n).alias("pos")
    )
    slug = F.when(n % 100 == 7, F.upper(alias)).when(n % 100 == 8, alias).otherwise("red-ring")
    requests = spark.range(300).select(n.alias("request_id"), slug.alias("slug"), F.when(n % 2 == 0, "red ring").alias("title"))
    out = match_family(requests, families)
    got = {r.request_id: (r.family_id, r.score) for r in out.collect()}
    assert len(got) == 300
    assert got[0] == (299, 590) and got[1] == (299, 140 + 120 + 70)
    assert got[107] == (107, 110) and got[207] == (207, 110)
    assert got[8] == (8, 130 + 110 + 120 + 90 + 50) and got[108] == (108, 500)
    assert 300 <= most_rows(out._jdf.queryExecution().executedPlan()) <= 1200


def test_few_tokens_are_found_by_a_pattern_and_many_by_the_index(spark, monkeypatch):
    import random

    from glyphlake.operators import containment

    draw = random.Random(5)
    word = lambda n: "".join(draw.choice("ab1") for _ in range(n))
    texts = [(i, word(draw.randint(0, 60))) for i in range(60)] + [(60, None)]
    tokens = [(word(draw.randint(1, 12)),) for _ in range(60)] + [("a" * 9,), ("a" * 10,), ("aaaa",)]
    texts.append((61, "a" * 30))
    wanted = {(i, t) for i, text in texts if text for (t,) in tokens if t in text}
    for spelled in (1000, 0):
        monkeypatch.setattr(containment, "SPELLED", spelled)
        for window in (256, 9):
            out = containment.contained_tokens(
                spark.createDataFrame(texts, "id int, text string"), spark.createDataFrame(tokens, "token string"), window=window
            )
            assert {tuple(r) for r in out.collect()} == wanted
            plan = plan_of(out)
            assert ("xxhash64(" in plan) == (spelled == 0)


def test_crawled_pages_are_dealt_out_by_their_keys(spark, monkeypatch, tmp_path):
    from glyphlake.streaming import crawl

    plans = []
    monkeypatch.setattr(crawl, "cut_lineage", lambda df: plans.append(plan_of(df)) or df)
    rows = [(n % 3, "https://a.example.com/p", "<a href='/fonts/x'>x</a>") for n in range(6)]
    batch = spark.createDataFrame(rows, "page_id long, url string, html string")
    seeds = spark.createDataFrame([("https://a.example.com/p", 0)], "url string, pos long")
    crawl.handle_pages(batch, seeds, None, str(tmp_path), 0, max_depth=1)
    assert "REPARTITION_BY_NUM" in plans[0] and "SinglePartition" not in plans[0]
    assert crawl.visited(spark, str(tmp_path)).count() == 3


def test_texts_do_not_move_to_their_packages(spark, sf):
    """Labels are unfolded below the join with the packages, not above it."""
    plan = plan_of(QUERIES["sample_coverage"](spark, sf))
    moved = [part.split("documents.parquet")[0] for part in plan.split("Exchange hashpartitioning(n#")[1:] if "documents.parquet" in part]
    moved = [part for part in moved if "part.parquet" not in part]
    assert moved and all("Generate explode" in part for part in moved)


def test_a_family_is_spelt_once(spark):
    """Nested steps each read the one before twice: a file's stem was taken from its URL many times a face."""
    from pyspark.sql import functions as F

    from glyphlake.functions import styles
    from glyphlake.operators.picking import computed

    rows = spark.createDataFrame([("red ring", "Bold", "https://a.example.com/f/red-ring-Bold.woff2")], "family string, label string, url string")
    shown = computed(rows, shown=styles.display_label(F.col("family"), F.col("label"), F.col("url"))).select("shown")
    assert plan_of(shown).count("decode(") == 1
    assert [r.shown for r in shown.collect()] == ["red ring"]


def test_endings_name_the_rules_that_can_hold(spark):
    import re

    from pyspark.sql import functions as F

    from glyphlake import fixed_values as fv
    from glyphlake.functions import styles

    words = ["red", "ab1", "a", "extra", "ultra", "semi", "Semi", "bold", "BOLD", "Light", "thin", "normal", "regular", "medium", "black", "heavy", "book", "italic", "Italic"]
    labels = [" ".join(w) for a in words for b in words for w in ((a, b), ("red", a, b), ("ring", a, b, "italic"))] + ["redBold", "red extrabold", "x semibold italic", ""]

    def by_rules(label):
        for rule, *told in fv.STYLE_SUFFIXES:
            if re.search(r"(?is)^(?:[^a-z0-9]*[a-z0-9]){3}.*?" + rule.removeprefix("(?i)"), label):
                return (re.sub(rule, "", label).strip(), *told)
        return None

    out = spark.createDataFrame([(x,) for x in labels], "label string").select("label", styles.style_suffix(F.col("label")).alias("s")).collect()
    assert {r.label: r.s and tuple(r.s) for r in out} == {x: by_rules(x) for x in labels}


def test_urls_that_are_canonical_stay_as_they_are(spark):
    from pyspark.sql import functions as F

    from glyphlake.functions import urls

    wanted = {
        "https://a.example.com/f/x.woff2?v=3#t": "https://a.example.com/f/x.woff2?v=3#t",
        "https://a.example.com": "https://a.example.com/",
        "https://a.example.com/a/../b": "https://a.example.com/b",
        "https://a.example.com/a/.": "https://a.example.com/a/",
        "https://a.example.com/a/..?q": "https://a.example.com/?q",
        "https://a.example.com/.hidden/a..b": "https://a.example.com/.hidden/a..b",
        "HTTPS://A.example.com:443/x": "https://a.example.com/x",
        "https://u@a.example.com/x": "https://a.example.com/x",
        "https://a.example.com/a b": "https://a.example.com/a%20b",
        "https://a.example.com/x\n": "https://a.example.com/x%0A",
        "https://a.example.com/é": "https://a.example.com/%C3%A9",
        "ftp://a.example.com/x": None,
    }
    out = spark.createDataFrame([(u,) for u in wanted], "u string").select("u", urls.canonical_href(F.col("u")).alias("c")).collect()
    assert {r.u: r.c for r in out} == wanted


def test_a_scan_puts_pages_together_once(spark, sf):
    """What a scan needs of a page stays in its row."""
    for name in ("scan_pages", "scan_summary"):
        assert "pages.parquet" not in plan_of(QUERIES[name](spark, sf))


def test_occurrences_are_counted_in_texts_of_any_script(spark):
    from pyspark.sql import functions as F

    from glyphlake.operators.faces import occurrences

    rows = [("é red é red ébred", "é", 3), ("ééééé", "éé", 2), ("abc", "", 0), ("", "a", 0), ("日本日本", "日本", 2), ("aaa", "b", 0)]
    out = spark.createDataFrame(rows, "text string, needle string, n long").select("n", occurrences(F.col("text"), F.col("needle")).alias("got")).collect()
    assert [r.got for r in out] == [r.n for r in out]


def test_attributes_are_found_in_marks_of_either_kind(spark):
    from pyspark.sql import functions as F

    from glyphlake.operators.documents import attribute_references, bare_references

    text = """<a href="/x">y</a><img src='/b.png' alt="=no"><a HREF="c\\\\"><p data-href="d" nohref="e" href="""
    row = spark.createDataFrame([(text, "go to https://a.example.com/x.WOFF2?v=1, or ./y.ttf and woff")], "t string, b string").select(attribute_references(F.col("t")), bare_references(F.col("b"))).first()
    assert list(row[0]) == ["/x", "c", "d", "/b.png"]
    assert list(row[1]) == ["https://a.example.com/x.WOFF2?v=1,", "./y.ttf"]
