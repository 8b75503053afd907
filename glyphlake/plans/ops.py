"""Queries over suites, jobs, caches, crawls, rules and file bytes."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from glyphlake import fixed_values as fv
from glyphlake.functions import files
from glyphlake.functions.urls import normalize_crawl_url
from glyphlake.functions.sql import register_sql_functions
from glyphlake.operators import crawl as cr
from glyphlake.operators import links as lk
from glyphlake.operators import ops
from glyphlake.operators.documents import anchor_assets, catalog_entries
from glyphlake.operators.picking import computed
from glyphlake.operators.rules import ExtractorRule, apply_rules
from glyphlake.operators.windows import anchored_windows
from glyphlake.plans import sql_text as d
from glyphlake.plans.fixtures import fixture, with_fixtures
from glyphlake.plans.normalize import REASON_CASE
from glyphlake.plans.registry import query, table
from glyphlake.plans.urls import _ADMITTED_CTE
from glyphlake.session import checkpoint_root, cut_lineage, deal_out
from glyphlake.sources import sinks
from glyphlake.sources.asset_files import sfnt_metrics
from glyphlake.streaming import crawl as stream_crawl
from glyphlake.streaming import jobs

C = F.col


@query("select_cases", with_fixtures("cases") + " SELECT id, pos FROM (SELECT * FROM cases WHERE contains(id, '0') AND (contains(id, '1') OR contains(id, '7')) ORDER BY pos LIMIT 20 OFFSET 5) AS q")
def _(spark, sf):
    return ops.select_cases(fixture(spark, sf, "cases"), "0", ["1", "7"], offset=5, limit=20).select("id", "pos")


LATEST_CTE = ", last AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY seq DESC) AS rn FROM results) AS q WHERE rn = 1)"


@query("latest_by_id", with_fixtures("results", "cases") + LATEST_CTE + " SELECT l.id, l.seq, l.downloaded, c.pos AS case_pos FROM last AS l LEFT JOIN cases AS c ON c.id = l.id")
def _(spark, sf):
    return ops.latest_by_id(fixture(spark, sf, "results"), fixture(spark, sf, "cases")).select("id", "seq", "downloaded", "case_pos")


def gate_sql(strict: bool) -> str:
    tough = str(strict).lower()
    return LATEST_CTE + f""", g0 AS (SELECT l.*, c.min_downloaded, c.soft_pass, lower(coalesce(quality_status, '')) AS q FROM last AS l JOIN cases AS c ON c.id = l.id),
    g1 AS (SELECT *, concat_ws(' | ', CASE WHEN downloaded < min_downloaded THEN 'files: ' || downloaded || ' of at least ' || min_downloaded END, CASE WHEN validation_status = 'fail' THEN 'validation failed' END,
      CASE WHEN {tough} AND q = '' THEN 'quality report missing' END, CASE WHEN q = 'fail' THEN 'quality failed' WHEN {tough} AND q = 'warn' THEN 'quality warns' END,
      CASE WHEN coverage_pct < 90 THEN 'style coverage: ' || CAST(coverage_pct AS BIGINT) || '%' END, CASE WHEN invalid_fonts > 0 THEN 'invalid files: ' || invalid_fonts END, CASE WHEN italic_mismatches > 0 THEN 'slope mismatches: ' || italic_mismatches END,
      CASE WHEN {tough} AND contamination > 0 THEN 'foreign files: ' || contamination END, CASE WHEN downloaded = 0 AND skipped > 0 THEN 'first skip: ' || first_skip END) AS rs FROM g0),
    g2 AS (SELECT *, soft_pass AND rs <> '' AND downloaded = 0 AND regexp_matches(rs, {d.lit(fv.NETWORK_TIMEOUT)}) AS soft FROM g1),
    gated AS (SELECT id, CASE WHEN rs = '' OR soft THEN 'pass' ELSE 'fail' END AS status, CASE WHEN soft THEN rs || ' | passed softly: network timeout' ELSE rs END AS reasons FROM g2)"""


def gated(spark, sf, strict=True):
    cases = fixture(spark, sf, "cases")
    return ops.case_gate(ops.latest_by_id(fixture(spark, sf, "results"), cases), cases, strict, True)


@query("case_gate", with_fixtures("results", "cases") + gate_sql(True) + " SELECT id, status, reasons FROM gated")
def _(spark, sf):
    return gated(spark, sf).select("id", "status", F.array_join("reasons", " | ").alias("reasons"))


@query("suite_summary", with_fixtures("results", "cases") + gate_sql(False) + " SELECT count(*) AS total, count(status) AS completed, count(*) FILTER (WHERE status IS NULL) AS pending, count(*) FILTER (WHERE status = 'pass') AS passed, count(*) FILTER (WHERE status = 'fail') AS failed FROM cases AS c LEFT JOIN gated AS g ON g.id = c.id")
def _(spark, sf):
    return ops.suite_summary(fixture(spark, sf, "cases"), gated(spark, sf, strict=False))


@query("pending_cases", with_fixtures("results", "cases") + gate_sql(True) + " SELECT 'rerun' AS mode, id FROM cases WHERE id NOT IN (SELECT id FROM gated WHERE status <> 'fail') UNION ALL SELECT 'fresh', id FROM cases WHERE id NOT IN (SELECT id FROM gated)")
def _(spark, sf):
    cases, done = fixture(spark, sf, "cases"), gated(spark, sf).select("id", "status")
    tag = lambda rerun, name: ops.pending(cases, done, rerun).select(F.lit(name).alias("mode"), "id")
    return tag(True, "rerun").union(tag(False, "fresh"))


@query("reason_counts", with_fixtures("download_log") + f" SELECT {REASON_CASE.format(x='reason')} AS code, count(*) AS n FROM download_log GROUP BY ALL")
def _(spark, sf):
    return ops.reason_counts(fixture(spark, sf, "download_log"), "reason")


@query(
    "retry_triage",
    with_fixtures("download_log") + f""", s AS (SELECT job_id, count(*) AS items, count(*) FILTER (WHERE status = 'downloaded') AS files, bool_or(status = 'skipped' AND regexp_matches(reason, {d.lit(fv.FETCH_FAILURE)})) AS fetch_failure,
      bool_or(status = 'skipped' AND regexp_matches(reason, {d.lit(fv.BLOCKED_RESPONSE)})) AS blocked, bool_or(status = 'skipped' AND regexp_matches(reason, {d.lit(fv.HTML_LIKE_SKIP)})) AS html_like FROM download_log GROUP BY job_id),
    c AS (SELECT *, CASE WHEN NOT (fetch_failure OR blocked OR html_like) THEN NULL WHEN files = 0 THEN 'no-files' WHEN (blocked OR html_like) AND files / items < 0.6 THEN 'low-ratio' WHEN job_id%5 = 0 THEN 'low-coverage' END AS cause FROM s)
    SELECT job_id, items, files, cause, cause IS NOT NULL AS needs_retry FROM c""",
)
def _(spark, sf):
    log = fixture(spark, sf, "download_log")
    coverage = table(spark, sf, "orders").filter("o_orderkey%5=0").select(C("o_orderkey").alias("job_id"), F.lit(80.0).alias("coverage_pct"))
    return ops.retry_triage(log, coverage).select("job_id", "items", "files", "cause", "needs_retry")


@query(
    "job_status",
    with_fixtures("job_events") + """ SELECT job_id, arg_max(status, seq) FILTER (WHERE status IS NOT NULL) AS status, arg_max(result_value, seq) FILTER (WHERE result_value IS NOT NULL) AS result_value, arg_max(result_error, seq) FILTER (WHERE result_error IS NOT NULL) AS result_error, count(line) AS log_lines FROM job_events GROUP BY job_id""",
)
def _(spark, sf):
    return ops.job_state(fixture(spark, sf, "job_events")).drop("updated_at")


@query("tail_log", with_fixtures("job_events") + " SELECT job_id, seq, line FROM (SELECT *, row_number() OVER (PARTITION BY job_id ORDER BY seq DESC) AS rn FROM job_events WHERE line IS NOT NULL) AS q WHERE rn <= 5")
def _(spark, sf):
    return ops.tail_log(fixture(spark, sf, "job_events"), n=5)


def telemetry(spark, sf):
    kind = C("event_type")
    return table(spark, sf, "events").select(
        "ts", C("user_id").cast("string").alias("run_id"),
        F.when(kind == "signup", "suite_start").when(kind == "view", "case_start").when(kind == "purchase", "case_result").when(kind == "error", "case_result").otherwise("checkpoint_write").alias("event"),
        F.when(kind == "purchase", "pass").when(kind == "error", "fail").alias("status"), C("props").alias("payload"),
    )


@query("suite_progress", "SELECT CAST(user_id AS VARCHAR) AS run_id, count(*) FILTER (WHERE event_type = 'view') AS started, count(*) FILTER (WHERE event_type IN ('purchase', 'error')) AS finished, count(*) FILTER (WHERE event_type = 'purchase') AS passed FROM events GROUP BY user_id")
def _(spark, sf):
    return ops.suite_progress(telemetry(spark, sf)).drop("last_ts")


@query("suite_throughput", "SELECT CAST(epoch(date_trunc('hour', ts)) AS BIGINT) AS hour, count(*) FILTER (WHERE event_type IN ('purchase', 'error')) AS finished FROM events GROUP BY 1")
def _(spark, sf):
    return ops.suite_throughput(telemetry(spark, sf)).select((ops.wall_micros(C("w.start")) / 1_000_000).cast("long").alias("hour"), "finished")


@query("append_telemetry", "SELECT CASE event_type WHEN 'signup' THEN 'suite_start' WHEN 'view' THEN 'case_start' WHEN 'click' THEN 'checkpoint_write' ELSE 'case_result' END AS event, count(*) AS n FROM events GROUP BY 1")
def _(spark, sf):
    path = f"{checkpoint_root(spark)}/telemetry_{uuid.uuid4().hex}"
    events = telemetry(spark, sf)
    sinks.append_telemetry(events.filter("event = 'case_result'"), path)
    sinks.append_telemetry(events.filter("event <> 'case_result'"), path)
    return spark.read.schema("event string").json(path).groupBy("event").agg(F.count("*").alias("n"))


@query("newest_signups", "SELECT event_id, user_id FROM events WHERE event_type = 'signup' ORDER BY ts DESC, event_id DESC LIMIT 512")
def _(spark, sf):
    """A top-k report: the limit is the question."""
    puts = table(spark, sf, "events").filter("event_type = 'signup'").select(C("event_id").alias("token"), "user_id", C("ts").alias("created"))
    return ops.newest(puts, 512).select(C("token").alias("event_id"), "user_id")


@query(
    "latest_within",
    """WITH e AS (SELECT event_id, user_id, ts, event_type FROM events WHERE event_type IN ('signup', 'view')),
    j AS (SELECT g.event_id AS get_id, g.user_id AS token, g.ts AS gts, arg_max({'id': p.event_id, 'ts': p.ts}, {'t': p.ts, 'i': p.event_id}) AS p FROM e AS g LEFT JOIN e AS p ON p.event_type = 'signup' AND p.user_id = g.user_id AND (p.ts < g.ts OR (p.ts = g.ts AND p.event_id < g.event_id)) WHERE g.event_type = 'view' GROUP BY ALL),
    k AS (SELECT *, p IS NOT NULL AND p.ts + INTERVAL 12 HOUR > gts AS hit FROM j)
    SELECT get_id, token, CASE WHEN hit THEN p.id END AS put_id, coalesce(hit, false) AS found FROM k""",
)
def _(spark, sf):
    events = table(spark, sf, "events")
    side = lambda kind, name: events.filter(C("event_type") == kind).select(C("event_id").alias(name), C("user_id").alias("token"), "ts")
    return ops.latest_within(side("signup", "put_id"), side("view", "get_id"), seconds=12 * 3600)


def _rate_sql(limit: int, seconds: int) -> str:
    return f"""WITH RECURSIVE e AS (SELECT user_id AS key, event_id, ts, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn FROM events),
    r AS (SELECT key, rn, event_id, ts AS opened, CAST(1 AS BIGINT) AS n FROM e WHERE rn = 1
      UNION ALL SELECT e.key, e.rn, e.event_id, CASE WHEN e.ts > r.opened + INTERVAL {seconds} SECOND THEN e.ts ELSE r.opened END, CASE WHEN e.ts > r.opened + INTERVAL {seconds} SECOND THEN 1 ELSE r.n + 1 END FROM r JOIN e ON e.key = r.key AND e.rn = r.rn + 1)
    SELECT event_id, key, n, n > {limit} AS limited FROM r"""


@query("rate_limit", _rate_sql(10, 60))
def _(spark, sf):
    events = table(spark, sf, "events").select("event_id", C("user_id").alias("key"), "ts")
    return anchored_windows(events).drop("opened_us")


@query("rate_limit_weekly", _rate_sql(10, 7 * 86400))
def _(spark, sf):
    events = table(spark, sf, "events").select("event_id", C("user_id").alias("key"), "ts")
    return anchored_windows(events, limit=10, seconds=7 * 86400, slice_windows=1).drop("opened_us")


def crawl_inputs(spark, sf):
    pages = fixture(spark, sf, "html")
    admitted = lk.crawl_admission(lk.extract_links(pages), lk.seed_hosts(pages))
    edges = admitted.select(normalize_crawl_url(C("url")).alias("url"), "link", "pos")
    stored = pages.select("page_id", normalize_crawl_url(C("url")).alias("url"))
    seeds = stored.filter("page_id % 50 = 0").select("url", C("page_id").alias("pos"))
    return seeds, edges, stored


_WALK_SQL = """, edges AS (SELECT {crawl} AS url, link, min(pos) AS pos FROM admitted GROUP BY 1, 2), stored AS (SELECT page_id, {crawl} AS url FROM html),
    walk AS (SELECT url, 0 AS depth, [CAST(page_id AS BIGINT)] AS place, CAST(NULL AS VARCHAR) AS parent FROM stored WHERE page_id%50 = 0
      UNION ALL SELECT link, depth, place, parent FROM (
        SELECT *, row_number() OVER (PARTITION BY link ORDER BY place, parent) AS nth FROM (
          SELECT e.link, w.depth + 1 AS depth, list_append(w.place, CAST(e.pos AS BIGINT)) AS place, w.url AS parent FROM walk AS w JOIN edges AS e ON e.url = w.url WHERE w.depth < {depth})) WHERE nth = 1),
    seen AS (SELECT url, depth, place, parent FROM (SELECT *, row_number() OVER (PARTITION BY url ORDER BY depth, place, parent) AS nth FROM walk) WHERE nth = 1)
    SELECT s.url, s.depth, array_to_string(s.place, '/') AS place, s.url IN (SELECT url FROM stored) AS ok, (SELECT count(*) FROM edges AS e WHERE e.url = s.url) AS discovered, (SELECT count(*) FROM seen AS e WHERE e.parent = s.url) AS enqueued,
      regexp_matches(s.url, '(?i)/typefaces/|/fonts/|/font/|/family/') AND NOT regexp_matches(s.url, '(?i)/cart|/checkout|/login|/account|/privacy|/terms|/cdn-cgi/') AS matched FROM seen AS s"""


def _walk_sql(depth: int) -> str:
    start = with_fixtures("html").replace("WITH ", "WITH RECURSIVE ", 1) + _ADMITTED_CTE
    return start + _WALK_SQL.format(crawl=d.crawl_url("url"), depth=depth)


def _as_listed(found):
    columns = ["url", "depth", F.array_join(C("place").cast("array<string>"), "/").alias("place"), "ok", "discovered", "enqueued", "matched"]
    return found.select(*columns)


@query("expand_link_graph", _walk_sql(4))
def _(spark, sf):
    """Seeds are every fiftieth page; the whole corpus may be reached."""
    seeds, edges, stored = crawl_inputs(spark, sf)
    return _as_listed(cr.expand_link_graph(seeds, edges, stored, max_depth=4))


@query("resumed_crawl", _walk_sql(3))
def _(spark, sf):
    """The pages arrive in two runs; the second goes on from what the first left."""
    state = f"{checkpoint_root(spark)}/crawl_{uuid.uuid4().hex}"
    pages = fixture(spark, sf, "html").select("page_id", "url", "html")
    seeds = pages.filter("page_id % 50 = 0").select(normalize_crawl_url(C("url")).alias("url"), C("page_id").alias("pos"))
    domains = cut_lineage(lk.seed_hosts(pages))
    for run in range(2):
        pages.filter(F.floor(C("page_id") / 2) % 2 == run).coalesce(1).write.mode("append").parquet(f"{state}/arrived")
        stream = jobs.read_event_stream(spark, f"{state}/arrived", pages.schema, 1)
        stream_crawl.incremental_crawl(stream, seeds, domains, f"{state}/tables", f"{state}/progress", max_depth=3).awaitTermination()
    return _as_listed(stream_crawl.results(spark, f"{state}/tables"))


_CATALOGUE_SQL = "regexp_matches({u}, '(?i)/typefaces/|/fonts/|/font/|/family/') AND NOT regexp_matches({u}, '(?i)/cart|/checkout|/login|/account|/privacy|/terms|/cdn-cgi/')"


@query(
    "crawl_summary",
    with_fixtures("html").replace("WITH ", "WITH RECURSIVE ", 1) + _ADMITTED_CTE + f""", edges AS (SELECT DISTINCT {d.crawl_url("url")} AS url, link FROM admitted), stored AS (SELECT page_id, {d.crawl_url("url")} AS url FROM html),
    walk AS (SELECT url, 0 AS depth FROM stored WHERE page_id%50 = 0 UNION SELECT e.link, w.depth + 1 FROM walk AS w JOIN edges AS e ON e.url = w.url WHERE w.depth < 3), seen AS (SELECT url, min(depth) AS depth FROM walk GROUP BY url),
    waiting AS (SELECT DISTINCT link AS url FROM edges WHERE url IN (SELECT url FROM seen) AND link NOT IN (SELECT url FROM seen))
    SELECT count(*) AS visited, (SELECT count(*) FROM waiting) AS queued, count(*) FILTER (WHERE {_CATALOGUE_SQL.format(u="url")}) + (SELECT count(*) FROM waiting WHERE {_CATALOGUE_SQL.format(u="url")}) AS catalog_urls,
      count(*) FILTER (WHERE url IN (SELECT url FROM stored)) AS ok_count, count(*) FILTER (WHERE url NOT IN (SELECT url FROM stored)) AS fail_count, max(depth) AS deepest FROM seen""",
)
def _(spark, sf):
    seeds, edges, stored = crawl_inputs(spark, sf)
    return cr.crawl_summary(cr.expand_link_graph(seeds, edges, stored, max_depth=3), edges)


@query(
    "apply_rules",
    with_fixtures("html") + r""", a AS (SELECT page_id, CASE WHEN regexp_matches(url, 'example\.org') THEN 'org-assets' WHEN regexp_matches(regexp_extract(url, '//([^/?#]*)', 1), 'example\.net$') THEN 'net-catalogue' ELSE 'fallback' END AS rule, html FROM html)
    SELECT rule, page_id, CASE rule WHEN 'fallback' THEN 1 WHEN 'net-catalogue' THEN len(list_distinct(list_transform(regexp_extract_all(html, '<a [^>]*href="/fonts/([^"/?#]+)"', 1), lambda s: lower(s))))
      ELSE len(regexp_extract_all(html, '(?i)<a [^>]*href="[^"]*\.(?:woff2?|ttf|otf|zip|pdf)(?:[?#][^"]*)?"')) END AS rows FROM a""",
)
def _(spark, sf):
    rules = [
        ExtractorRule("org-assets", r"example\.org", lambda df: anchor_assets(df).select(F.lit("org-assets").alias("rule"), "page_id")),
        ExtractorRule("net-catalogue", r"example\.net$", lambda df: catalog_entries(df).select(F.lit("net-catalogue").alias("rule"), "page_id"), part="host"),
        ExtractorRule("fallback", "", lambda df: df.select("rule", "page_id")),
    ]
    return apply_rules(fixture(spark, sf, "html"), rules).groupBy("rule", "page_id").agg(F.count("*").alias("rows"))


@query("sql_functions", f"SELECT p_partkey, {d.token('p_name || p_brand')} AS token, {d.title('p_name || chr(95) || p_type')} AS title, {d.rep('lower(p_name)', '[^a-z0-9]+', '-')} AS stem FROM part")
def _(spark, sf):
    register_sql_functions(spark)
    return spark.sql(f"SELECT p_partkey, gl_token(concat(p_name, p_brand)) AS token, gl_title(concat(p_name, '_', p_type)) AS title, gl_stem(p_name) AS stem FROM parquet.`{sf}/part.parquet`")


_MAGIC_SQL = "CASE p_partkey%6 WHEN 0 THEN '774F4632' WHEN 1 THEN '774F4646' WHEN 2 THEN '00010000' WHEN 3 THEN '4F54544F' WHEN 4 THEN '504B0304' ELSE '3C68746D' END"
_EXT_SQL = "CASE WHEN p_partkey%7=0 THEN 'woff2' ELSE CASE p_partkey%6 WHEN 0 THEN 'woff2' WHEN 1 THEN 'woff' WHEN 2 THEN 'ttf' ELSE 'otf' END END"


@query(
    "sniff_signature",
    f"""WITH b AS (SELECT p_partkey, {_MAGIC_SQL} AS magic, {_EXT_SQL} AS ext FROM part), s AS (SELECT *, CASE magic WHEN '774F4632' THEN 'woff2' WHEN '774F4646' THEN 'woff' WHEN '00010000' THEN 'ttf' WHEN '4F54544F' THEN 'otf' WHEN '504B0304' THEN 'zip' END AS sig FROM b)
    SELECT p_partkey, sig AS signature, coalesce(sig <> 'zip' AND sig <> ext, false) AS mismatch FROM s""",
)
def _(spark, sf):
    content = F.unhex(F.concat(F.expr(_MAGIC_SQL), F.hex("p_name")))
    df = table(spark, sf, "part").select("p_partkey", F.expr(_EXT_SQL).alias("ext"), files.sniff_signature(content).alias("signature"))
    return df.select("p_partkey", "signature", files.signature_mismatch(C("ext"), C("signature")).alias("mismatch"))


def sfnt_bytes():
    """Hex of a small but well-formed sfnt file made from the columns of a part."""
    num = lambda c, digits: F.lpad(F.hex(F.when(c < 0, c + 65536).otherwise(c)), digits, "0") if digits == 4 else F.lpad(F.hex(c), digits, "0")
    lit16 = lambda n: F.lit(f"{n & 0xFFFF:04X}")
    zeros = lambda n: F.lit("00" * n)
    k, size = C("p_partkey"), C("p_size").cast("long")
    family = F.hex(F.encode(C("p_name"), "UTF-16BE"))
    brand = F.hex(F.encode(C("p_brand"), "ISO-8859-1"))
    fam_len, brand_len = F.length("p_name") * 2, F.length("p_brand")
    head = F.concat(zeros(18), lit16(1000), zeros(24), lit16(0), zeros(8))  # 54 bytes
    hhea = F.concat(zeros(4), num(size * 10, 4), num(-size * 3, 4), lit16(90), zeros(26))  # 36
    maxp = F.concat(zeros(4), num(k % 1500, 4))  # 6
    os2 = F.concat(zeros(4), num((size % 9 + 1) * 100, 4), zeros(56), num(size % 2, 4), zeros(4), num(size * 7, 4), num(-size, 4), lit16(0), lit16(1000), lit16(250), zeros(18))
    record = lambda platform, nid, length, offset: F.concat(lit16(platform), lit16(1), lit16(0), lit16(nid), num(length.cast("long"), 4), num(offset.cast("long"), 4))
    names = F.concat(
        lit16(0), lit16(3), lit16(6 + 36), record(3, 1, fam_len, F.lit(0)), record(1, 2, brand_len, fam_len), record(3, 4, fam_len, F.lit(0)), family, brand
    )
    tables = [("head", head, 54), ("hhea", hhea, 36), ("maxp", maxp, 6), ("OS/2", os2, 96), ("name", names, None)]
    at, directory = 12 + 16 * len(tables), []
    for tag, _, length in tables:
        directory.append(F.concat(F.hex(F.lit(tag)), zeros(4), F.lit(f"{at:08X}"), F.lit("00000000")))
        at += length or 0
    return F.unhex(F.concat(F.lit("00010000"), lit16(len(tables)), zeros(6), *directory, *[t[1] for t in tables]))


@query(
    "sfnt_metrics",
    """SELECT p_partkey, CAST(p_partkey%1500 AS INT) AS num_glyphs, 1000 AS units_per_em, (p_size%9+1)*100 AS weight_class, p_size%2 AS fs_selection, p_size*10 AS ascender, -p_size*3 AS descender, 90 AS line_gap, p_size*7 AS typo_ascender, -p_size AS typo_descender, 250 AS win_descent,
      p_name AS family_name, p_brand AS subfamily_name, p_name AS full_name, CAST(NULL AS VARCHAR) AS postscript_name FROM part WHERE p_partkey%8 <> 0
    UNION ALL SELECT p_partkey, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL FROM part WHERE p_partkey%8 = 0""",
)
def _(spark, sf):
    content = F.when(C("p_partkey") % 8 == 0, F.unhex(F.lit("774F463200010000"))).otherwise(sfnt_bytes())
    # computed: sixteen fields are read from one struct, which is not built for each
    files = deal_out(table(spark, sf, "part")).select("p_partkey", content.alias("content"))
    df = computed(files, m=sfnt_metrics(C("content")))
    return df.select(
        "p_partkey", "m.num_glyphs", "m.units_per_em", "m.weight_class", "m.fs_selection", "m.hhea.ascender", "m.hhea.descender", "m.hhea.line_gap",
        "m.os2.typo_ascender", "m.os2.typo_descender", "m.os2.win_descent", "m.family_name", "m.subfamily_name", "m.full_name", "m.postscript_name",
    )


TAIL_SQL = " SELECT job_id, seq, line FROM (SELECT *, row_number() OVER (PARTITION BY job_id ORDER BY seq DESC) AS rn FROM job_events WHERE line IS NOT NULL) AS q WHERE rn <= 5"


def _arrived(spark, rows, order, name):
    """The rows as a stream of three files, in order; with a folder for state."""
    folder = f"{checkpoint_root(spark)}/{name}_{uuid.uuid4().hex}"
    rows.repartitionByRange(3, order).write.parquet(f"{folder}/arrived")
    return jobs.read_event_stream(spark, f"{folder}/arrived", rows.schema, 1), folder


@query("streamed_tail_log", with_fixtures("job_events") + TAIL_SQL)
def _(spark, sf):
    events, folder = _arrived(spark, fixture(spark, sf, "job_events"), "seq", "lines")
    jobs.job_lines_stream(events, f"{folder}/lines", f"{folder}/progress").awaitTermination()
    return ops.tail_log(jobs.read_job_lines(spark, f"{folder}/lines"), n=5)


@query("streamed_rate_limit", _rate_sql(10, 7 * 86400))
def _(spark, sf):
    """Time is cut into stretches, a batch each, in the middle of open windows."""
    rows = table(spark, sf, "events").select("event_id", C("user_id").alias("key"), "ts")
    folder = f"{checkpoint_root(spark)}/rates_{uuid.uuid4().hex}"
    for stretch, batch in enumerate((C("ts") < "2024-01-10", (C("ts") >= "2024-01-10") & (C("ts") < "2024-01-20"), C("ts") >= "2024-01-20")):
        rows.filter(batch).coalesce(1).write.mode("append").parquet(f"{folder}/arrived")
        stream = jobs.read_event_stream(spark, f"{folder}/arrived", rows.schema)
        jobs.rate_limit_stream(stream, 10, 7 * 86400, f"{folder}/tables", f"{folder}/progress").awaitTermination()
    return jobs.read_rates(spark, f"{folder}/tables").drop("opened_us")
