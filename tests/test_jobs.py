"""Streams equal their batch twins; crawls, sinks and readers on small inputs."""

import json
import uuid

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from glyphlake.functions.urls import normalize_crawl_url
from glyphlake.operators import crawl, ops, packages, products, windows
from glyphlake.operators import links as lk
from glyphlake.operators.containment import contained_tokens
from glyphlake.plans.fixtures import fixture
from glyphlake.plans.ops import telemetry
from glyphlake.sources import asset_files, pages
from glyphlake.streaming import crawl as stream_crawl
from glyphlake.streaming import jobs

C = F.col


def rows(df):
    return sorted(tuple(r) for r in df.collect())


@pytest.fixture()
def work(tmp_path):
    return lambda name: str(tmp_path / f"{name}_{uuid.uuid4().hex}")


def test_job_stream_ends_in_the_batch_state(spark, sf, work):
    events = fixture(spark, sf, "job_events")
    src, out = work("events"), work("jobs")
    events.repartition(3).write.parquet(src)
    jobs.job_status_stream(jobs.read_event_stream(spark, src, events.schema, 1), out, work("ck")).awaitTermination()
    assert rows(jobs.read_job_states(spark, out)) == rows(ops.job_state(events))


def test_progress_stream_ends_in_the_batch_summary(spark, sf, work):
    events = telemetry(spark, sf)
    src, out = work("telemetry"), work("progress")
    events.repartition(2).write.parquet(src)
    jobs.progress_stream(jobs.read_event_stream(spark, src, events.schema, 1), out, work("ck")).awaitTermination()
    assert rows(jobs.read_progress(spark, out)) == rows(ops.suite_progress(events))


def test_throughput_stream_has_a_bounded_state(spark, sf, work):
    events = telemetry(spark, sf).withColumn("ts", C("ts").cast("timestamp"))
    src = work("telemetry")
    events.write.parquet(src)
    windowed = jobs.throughput_stream(jobs.read_event_stream(spark, src, events.schema), "1 hour", "10 minutes")
    q = windowed.writeStream.outputMode("complete").format("memory").queryName("throughput").option("checkpointLocation", work("ck")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.table("throughput").agg(F.sum("finished")).first()[0] == events.filter("event = 'case_result'").count()


@pytest.mark.parametrize("batches", [1, 4])
def test_rate_stream_equals_batch(spark, sf, work, batches):
    events = spark.read.parquet(f"{sf}/events.parquet").select("event_id", C("user_id").alias("key"), "ts")
    src, out, ck = work("rate"), work("rates"), work("ck")
    week = 7 * 86400
    cut = F.ntile(batches).over(Window.orderBy("ts", "event_id"))
    for n in range(batches):
        events.withColumn("cut", cut).filter(C("cut") == n + 1).drop("cut").coalesce(1).write.mode("append").parquet(src)
        jobs.rate_limit_stream(jobs.read_event_stream(spark, src, events.schema), 10, week, out, ck).awaitTermination()
    want = windows.anchored_windows(events, 10, week).select("event_id", "key", "opened_us", "n", "limited")
    assert rows(jobs.read_rates(spark, out)) == rows(want)
    # the last batch, run again, leaves the same labels
    jobs.limit_batch(events.withColumn("cut", cut).filter(C("cut") == batches).drop("cut"), batches - 1, 10, week, out)
    assert rows(jobs.read_rates(spark, out)) == rows(want)


def test_log_lines_are_appended_once_and_in_order(spark, sf, work):
    events = fixture(spark, sf, "job_events")
    src, out = work("events"), work("lines")
    events.repartition(3).write.parquet(src)
    jobs.job_lines_stream(jobs.read_event_stream(spark, src, events.schema, 1), out, work("ck")).awaitTermination()
    # a batch that is run again
    first = spark.read.parquet(f"{out}/batch=1")
    jobs.lines_of(spark.createDataFrame(first.collect(), first.schema), 1, out)
    assert rows(ops.tail_log(jobs.read_job_lines(spark, out), 7)) == rows(ops.tail_log(events, 7))


@pytest.mark.parametrize("slices", [1, 2, 3, 1440])
def test_rate_windows_do_not_depend_on_how_keys_are_cut(spark, slices):
    import random

    rnd = random.Random(7)
    data = [(i, rnd.choice([1, 1, 1, 2]), rnd.randrange(0, 900)) for i in range(400)] + [(1000 + i, 3, 700 * i) for i in range(30)]
    df = spark.createDataFrame(data, "event_id long, key long, s long").select("event_id", "key", F.timestamp_seconds("s").alias("ts"))
    want, state = [], {}
    for event_id, key, s in sorted(data, key=lambda r: (r[1], r[2], r[0])):
        opened, n = state.get(key, (None, 0))
        if opened is None or s > opened + 60:
            opened, n = s, 0
        state[key] = (opened, n + 1)
        want.append((event_id, key, n + 1, n + 1 > 10))
    got = windows.anchored_windows(df, 10, 60, slice_windows=slices).select("event_id", "key", "n", "limited")
    assert rows(got) == sorted(want)


def crawled(spark, sf, work, cuts):
    """The state folder of a crawl whose pages came in ``cuts`` rounds, each stopped after."""
    corpus = fixture(spark, sf, "html").select("page_id", "url", "html")
    seeds = corpus.filter("page_id % 10 = 3").select(normalize_crawl_url(C("url")).alias("url"), C("page_id").alias("pos"))
    domains = lk.seed_hosts(corpus)
    src, out, ck = work("pages"), work("crawl"), work("ck")
    for cut in range(cuts):
        # later pages first, so that ways found early are improved on
        corpus.filter(f"{cuts - 1 - cut} = page_id % {cuts}").coalesce(1).write.mode("append").parquet(src)
        stream_crawl.incremental_crawl(jobs.read_event_stream(spark, src, corpus.schema, 1), seeds, domains, out, ck).awaitTermination()
    return corpus, seeds, domains, out


def test_a_resumed_crawl_ends_where_one_expansion_does(spark, sf, work):
    corpus, seeds, domains, out = crawled(spark, sf, work, 3)
    admitted = lk.crawl_admission(lk.extract_links(corpus), domains).select(normalize_crawl_url(C("url")).alias("url"), "link", "pos")
    stored = corpus.select(normalize_crawl_url(C("url")).alias("url"))
    want = crawl.expand_link_graph(seeds, admitted, stored)
    got = stream_crawl.results(spark, out)
    assert rows(got.select(want.columns)) == rows(want)
    assert got.agg(F.max("depth")).first()[0] >= 2
    seen = stream_crawl.visited(spark, out)
    assert rows(seen.select("page").distinct()) == rows(stored.distinct()) and seen.count() == corpus.count()
    done = {r[0] for r in rows(seen.select("page"))}
    assert {r[0] for r in rows(stream_crawl.queue(spark, out).select("url"))} == {r["url"] for r in want.collect()} - done
    assert rows(stream_crawl.catalog_urls(spark, out).select("url")) == rows(want.filter("matched").select("url"))


def test_a_batch_run_again_leaves_the_same_tables(spark, sf, work):
    corpus, seeds, domains, out = crawled(spark, sf, work, 2)
    before = rows(stream_crawl.results(spark, out)), rows(stream_crawl.visited(spark, out))
    for batch in (0, 1):
        stream_crawl.handle_pages(corpus.filter(f"page_id % 2 = {1 - batch}"), seeds, domains, out, batch)
    assert before == (rows(stream_crawl.results(spark, out)), rows(stream_crawl.visited(spark, out)))


def test_hub_pages_are_split_and_links_stay_where_they_are(spark):
    edges = [("hub", f"p{i}", i) for i in range(500)] + [(f"p{i}", "end", 0) for i in range(500)]
    table = spark.createDataFrame(edges, "url string, link string, pos int")
    seeds = spark.createDataFrame([("hub", 0)], "url string, pos int")
    whole = rows(crawl.expand_link_graph(seeds, table, seeds.select("url")))
    laid, hubs = crawl.laid_out(table, 100)
    assert rows(hubs) == [("hub", 5)] and laid.filter("url = 'hub'").select("part").distinct().count() == 5
    plan = crawl.linked_from(seeds.select("url"), laid, hubs)._jdf.queryExecution().executedPlan().toString()
    assert "Scan ExistingRDD" in plan and plan.count("hashpartitioning(link") == 0
    assert rows(crawl.expand_link_graph(seeds, table, seeds.select("url"), hub_links=100)) == whole and len(whole) == 502


def test_crawl_caps_depth_and_pages(spark):
    edges = [("a", "b", 0), ("a", "c", 1), ("b", "d", 0), ("c", "d", 0), ("c", "e", 1), ("d", "f", 0), ("e", "a", 0)]
    links = spark.createDataFrame(edges, "url string, link string, pos int")
    stored = spark.createDataFrame([(u,) for u in "abcd"], "url string")
    seeds = spark.createDataFrame([("a", 0)], "url string, pos int")
    deep = crawl.expand_link_graph(seeds, links, stored, max_depth=9, max_pages=99).select("url", "depth", "ok", "enqueued")
    assert rows(deep) == [("a", 0, True, 2), ("b", 1, True, 1), ("c", 1, True, 1), ("d", 2, True, 1), ("e", 2, False, 0), ("f", 3, False, 0)]
    assert rows(crawl.expand_link_graph(seeds, links, stored, 1, 99).select("url")) == [("a",), ("b",), ("c",)]
    assert rows(crawl.expand_link_graph(seeds, links, stored, 9, 4).select("url")) == [("a",), ("b",), ("c",), ("d",)]


def test_greedy_assignment_prefers_free_faces(spark):
    scored = [("f", 0, "Bold", "x", 0, 90), ("f", 0, "Bold", "y", 1, 80), ("f", 1, "Black", "x", 0, 95), ("f", 1, "Black", "y", 1, 10), ("f", 2, "Thin", "x", 0, 5)]
    df = spark.createDataFrame(scored, "family string, style_pos long, style string, face string, face_pos long, score long")
    assert rows(products.assign_best(df)) == [("f", 0, "Bold", "x", 90), ("f", 1, "Black", "y", 10), ("f", 2, "Thin", "x", 5)]


def test_containment_finds_exactly_the_contained_tokens(spark):
    texts = [(1, "abcdefghijkl"), (2, "xyz"), (3, "aaaa"), (4, "")]
    tokens = ["a", "aa", "abc", "cdef", "efghijkl", "defghijklm", "xyz", "zz", "ghijk"]
    got = contained_tokens(spark.createDataFrame(texts, "id long, text string"), spark.createDataFrame([(t,) for t in tokens], "token string"))
    want = sorted((i, t) for i, s in texts for t in tokens if t in s)
    assert rows(got) == want
    # tokens longer than what travels with a piece
    short = contained_tokens(spark.createDataFrame(texts, "id long, text string"), spark.createDataFrame([(t,) for t in tokens], "token string"), window=9)
    assert rows(short) == want
    assert contained_tokens(spark.createDataFrame(texts, "id long, text string"), spark.createDataFrame([], "token string")).count() == 0


def test_containment_moves_neither_texts_nor_all_pieces(spark):
    texts = spark.range(200).select("id", F.concat(F.lit("x" * 500), F.when(C("id") % 50 == 0, "needle42").otherwise("")).alias("text"))
    plan = contained_tokens(texts, spark.createDataFrame([("needle42",)], "token string"))
    assert rows(plan) == [(i, "needle42") for i in range(0, 200, 50)]
    text = plan._jdf.queryExecution().executedPlan().toString()
    shuffled = [line for line in text.splitlines() if "Exchange" in line]
    assert shuffled and not any("text#" in line for line in shuffled)


def test_unique_names_step_over_taken_numbers(spark):
    data = [("p", n, i) for i, n in enumerate(["a.ttf", "a.ttf", "a-1.ttf", "a.ttf", "b.ttf"])]
    df = spark.createDataFrame(data, "g string, name string, pos long")
    assert [r[0] for r in packages.unique_names(df, "g", "name", "pos").orderBy("pos").select("unique_name").collect()] == [
        "a.ttf", "a-2.ttf", "a-1.ttf", "a-3.ttf", "b.ttf"]


def test_numbering_in_ranges_is_plain_numbering(spark):
    df = spark.range(50).select((C("id") % 3).alias("k"), (C("id") * 7).alias("pos"))
    got = packages.number_rows(df, ["k"], "pos", "n", most=10)
    assert all(n == i + 1 for k in range(3) for i, (n,) in enumerate(rows(got.filter(C("k") == k).orderBy("pos").select("n"))))


def test_reports_newest_only(spark, work):
    import os

    folder = work("reports")
    os.makedirs(folder)
    for name, results in (("smoke-1.json", ["old"]), ("smoke-2.json", ["new", "er"]), ("smoke-0.json", None), ("other-9.json", ["no"])):
        with open(f"{folder}/{name}", "w") as f:
            if results is None:
                f.write('{"suite": "s", "results": [{"id": ')
            else:
                json.dump({"suite": "s", "results": [{"id": r} for r in results]}, f, indent=1)
    assert rows(asset_files.read_run_reports(spark, folder, "smoke").select("file", "id")) == [("smoke-2.json", "er"), ("smoke-2.json", "new")]
    assert asset_files.read_run_reports(spark, folder, "none") is None


def test_sitemap(spark, work):
    path = work("map") + ".xml"
    with open(path, "w") as f:
        f.write("<urlset><url><loc>https://x.example/fonts/Alpha</loc></url><url><loc>https://x.example/fonts/alpha?x=1</loc></url>"
                "<url><loc>https://x.example/about</loc></url><url><loc>https://x.example/fonts/beta/</loc></url></urlset>")
    assert rows(pages.read_sitemap(spark, path, "https://x.example/fonts/")) == [("alpha",), ("beta",)]


def test_asset_files_by_extension(spark, work):
    import os

    folder = work("assets")
    os.makedirs(f"{folder}/deep/er")
    for name, data in (("a.woff2", b"wOF2xx"), ("deep/b.TTF", b"no"), ("deep/er/c.ttf", b"\x00\x01\x00\x00"), ("d.txt", b"t")):
        with open(f"{folder}/{name}", "wb") as f:
            f.write(data)
    found = asset_files.read_asset_files(spark, folder, with_content=True)
    from glyphlake.functions.files import sniff_signature

    assert rows(found.select("filename", "ext", "size_bytes", sniff_signature(C("content")))) == [("a.woff2", "woff2", 6, "woff2"), ("c.ttf", "ttf", 4, "ttf")]


def test_partition_count_does_not_change_results(spark, sf):
    html = fixture(spark, sf, "html")
    one, seven = (lk.links_by_rule_and_host(html.repartition(n)) for n in (1, 7))
    assert rows(one) == rows(seven)


def test_flagship_plan_prunes_and_has_no_python(spark, sf):
    plan = lk.crawl_admission(lk.extract_links(fixture(spark, sf, "html")), None)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "CartesianProduct" not in plan


def test_whole_pages_and_scripts_are_read(spark, work):
    from glyphlake.operators.documents import blocked_page, extract_inline_docs
    from glyphlake.sources.pages import read_pages

    filler = "x" * 1_200_000
    html = f"<html><script>/* {filler} */ @font-face</script>{filler}captcha forbidden</html>"
    path = work("long")
    spark.createDataFrame([(1, "https://a.example/", html)], "page_id long, url string, html string").write.parquet(path)
    pages = read_pages(spark, path)
    assert pages.select(F.length("html")).first()[0] == len(html)
    assert [r.kind for r in extract_inline_docs(pages).collect()] == ["inline-script"]
    assert pages.select(blocked_page(F.lit(200), F.lit(""), C("html"), [403]).alias("v")).first().v.blocked


def test_names_stay_unique_beyond_any_number_of_digits(spark):
    taken = [(1, "a-1000.ttf", -2), (1, "a-7.ttf", -1)]
    df = spark.createDataFrame(taken + [(1, "a.ttf", i) for i in range(1500)], "g long, name string, pos long")
    got = [r.unique_name for r in packages.unique_names(df, "g", "name", "pos").collect()]
    assert len(set(got)) == 1502 and "a-1501.ttf" in got
    second = spark.createDataFrame([(1, "n.pdf", 5), (1, "n.pdf", 900_000_000_000), (1, "n.pdf", 7)], "g long, name string, n long")
    assert sorted(r.unique_name for r in packages.unique_names(second, "g", "name", "n", first=2).collect()) == ["n-2.pdf", "n-3.pdf", "n.pdf"]


def named_in_order(data, first):
    """Unique names of (group, name, order), one after another."""
    used = {(g, n) for g, n, _ in data}
    seen, out = {}, []
    for g, n, _ in sorted(data, key=lambda r: (r[2] is not None, r[2] or 0)):
        if n is None or (g, n) not in seen:
            seen[g, n] = first
            out.append((g, n))
            continue
        stem, dot, ext = n.rpartition(".") if "." in n[1:] else (n, "", "")
        while (g, f"{stem}-{seen[g, n]}{dot}{ext}") in used:
            seen[g, n] += 1
        out.append((g, f"{stem}-{seen[g, n]}{dot}{ext}"))
        seen[g, n] += 1
    return sorted(out, key=repr)


@pytest.mark.parametrize("first,most", [(1, 1_000), (2, 1_000), (1, 7)])
def test_unique_names_keep_every_row_and_match_naming_one_by_one(spark, first, most):
    import random

    pick = random.Random(first + most)
    data = [(pick.choice(["g", "h", None]), pick.choice(["a.ttf", "b.ttf", "c", None]), i) for i in range(400)]
    data += [("g", f"a-{n}.ttf", 1000 + n) for n in [1, 2, 3, 5, 7, 8, 20, 21, 60, 10**12] + list(range(70, 130, 2))]
    data += [(None, "b-4.ttf", 1), (None, "b-4.ttf", 2), ("h", "c-1", 0), ("h", "c-0", 9)]
    data = [(g, n, None if i == 0 else i) for g, n, i in data]
    df = spark.createDataFrame(data, "g string, name string, pos long").repartition(3)
    got = packages.unique_names(df, "g", "name", "pos", first=first, most=most)
    assert got.columns == ["g", "name", "pos", "unique_name"] and got.count() == len(data)
    assert sorted(((r.g, r.unique_name) for r in got.collect()), key=repr) == named_in_order(data, first)


def test_six_rows_without_an_order_are_six_names(spark):
    df = spark.createDataFrame([("g", "a.ttf", None)] * 4 + [(None, "a.ttf", 1)] * 2, "g string, name string, pos long")
    got = packages.unique_names(df, "g", "name", "pos").select("g", "unique_name").distinct().collect()
    assert len(got) == 6


def test_a_crawl_without_a_cap_reaches_every_page(spark):
    links = spark.range(300).select(F.lit("hub").alias("url"), F.concat(F.lit("p"), C("id")).alias("link"), C("id").cast("int").alias("pos"))
    seeds = spark.createDataFrame([("hub", 0)], "url string, pos int")
    out = crawl.expand_link_graph(seeds, links, seeds.select("url"))
    assert out.count() == 301
    summary = crawl.crawl_summary(crawl.expand_link_graph(seeds, links, seeds.select("url"), max_depth=0), links).first()
    assert (summary.visited, summary.queued) == (1, 300)


def test_damaged_font_files_give_nulls(spark):
    from glyphlake.sources.asset_files import sfnt_metrics

    head = bytes.fromhex("00010000")
    entry = lambda tag, offset: tag + b"\0" * 4 + offset.to_bytes(4, "big") + b"\0" * 4
    table = lambda *entries: head + len(entries).to_bytes(2, "big") + b"\0" * 6 + b"".join(entries)
    files = [
        (1, table(entry(b"maxp", 44), entry(b"maxp", 9)) + b"\0\0\0\0\0\x05"),
        (2, table(entry(b"maxp", 2**31 + 5), entry(b"name", 2**32 - 1))),
        (3, table()),
        (4, head),
        (5, head + b"\xff\xff"),
    ]
    got = {r.id: r.m for r in spark.createDataFrame(files, "id long, content binary").select("id", sfnt_metrics(C("content")).alias("m")).collect()}
    assert got[1].num_glyphs == 5
    assert all(got[k].num_glyphs is None and got[k].family_name is None for k in (2, 3, 4, 5))


def test_a_cycle_of_folders_ends(spark):
    from glyphlake.operators.tree import directory_rollup

    nodes = [(1, None, "root", "folder", 0), (2, 1, "in", "folder", 0), (3, 2, "f", "file", 5), (10, 11, "a", "folder", 0), (11, 10, "b", "folder", 0), (12, 11, "g", "file", 7)]
    got = {r.id: r for r in directory_rollup(spark.createDataFrame(nodes, "id long, parent_id long, name string, kind string, size long")).collect()}
    assert got[1].total_files == 1 and got[1].total_size == 5 and got[10].total_files is None and got[11].files == 1


def test_second_assignment_gives_every_url_once(spark):
    styles_ = spark.createDataFrame([("f", "Bold", False, ["bold"]), ("f", "Bold Italic", True, ["bolditalic"]), ("f", "Thin", False, ["thin"])], "k string, style string, italic boolean, tokens array<string>")
    assets = spark.createDataFrame([("f", "u1", "bolditalic", True, 0), ("f", "u2", "boldx", False, 0)], "k string, url string, token string, slanted boolean, quality int")
    got = rows(products.assign_longest_first(styles_, assets, ["k"]).select("style", F.coalesce("url", F.lit("-"))))
    assert got == [("Bold", "u2"), ("Bold Italic", "u1"), ("Thin", "-")]


def test_rules_are_told_by_literals_as_by_patterns(spark):
    from glyphlake import fixed_values as fv

    assert lk.needed_literals(r"(?i)(^|//)(www\.)?ab-c\.com") == ["ab-c.com"]
    assert lk.needed_literals(r"ab\.com|cde\.org") == ["ab.com", "cde.org"]
    for odd in ("", "ab?c", "a[bc]d", "ab.c", "x(y)*z", "(?:ab)c", "a|", "ab+"):
        assert lk.needed_literals(odd) == [], odd
    names = sorted({t for _, _, p in fv.ROUTING_RULES for t in lk.needed_literals(p)})
    shapes = ["https://{}/", "https://www.{}/a.b", "http://{}:81/x", "https://X{}", "https://a.b/?u=//{}.x", "https://a.b/{}", "https://{}.org/p"]
    urls = [s.format(n) for n in names for s in shapes] + [s.format(n.upper()) for n in names for s in shapes]
    urls += ["https://250.tf/", "https://www.205.tf", "https://x250.tf/", "https://a.b/c.d", "", "no url", "...", None]
    df = spark.createDataFrame([(u,) for u in urls], "url string")
    plain = F
    for rule, part, pattern in fv.ROUTING_RULES:
        plain = plain.when(lk.rule_test(C("url"), part, pattern), F.lit(rule))
    got = lk.route(df).withColumn("want", plain).collect()
    assert [r for r in got if r.rule != r.want] == []
    assert len({r.rule for r in got}) > 40
    own = [("none", "url", "x[yz]"), ("dot", "url", r"foo\.bar"), ("short", "host", r"q\.r")]
    texts = ["http://a/xy", "http://foo.bar", "http://q.r/", "http://a/"]
    found = spark.createDataFrame([(i, u) for i, u in enumerate(texts)], "i int, url string")
    assert [r[0] for r in found.orderBy("i").select(lk.first_rule(C("url"), own)).collect()] == ["none", "dot", "short", None]


def test_near_styles_match_brute_force(spark):
    import random

    from glyphlake.operators.coverage import style_coverage

    pick = random.Random(5)
    words = ["bold", "semi", "extra", "condensed", "italic", "text", "w5", "x", "ultracondensed", "display"]
    token = lambda: "".join(pick.choice(words) for _ in range(pick.randint(1, 4)))
    expected = {(p, token()): pick.choice(["family-style", "style"]) for p in ("a", "b", "hot") for _ in range(60)}
    observed = {(p, token()): 0 for p in ("a", "hot", "only") for _ in range(50)}
    observed = {k: n for n, k in enumerate(pick.sample(sorted(observed), len(observed)))}

    def want(package, e, scope):
        near = [(pos, o) for (p, o), pos in observed.items() if p == package and (e in o or e.startswith(o))]
        if (package, e) in observed:
            return e
        return min(near)[1] if near and scope == "family-style" else None

    got = style_coverage(
        spark.createDataFrame([(p, e, s) for (p, e), s in expected.items()], "package string, token string, scope string"),
        spark.createDataFrame([(p, o, n) for (p, o), n in observed.items()], "package string, token string, pos int"),
    )
    found = {(r.package, r.token): r.observed_token for r in got.collect()}
    assert found == {(p, e): want(p, e, s) for (p, e), s in expected.items()}
    assert len({v for k, v in found.items() if v and v != k[1]}) > 5
