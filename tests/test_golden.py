"""Hand-checked rows for the scalar ladders and the URL algebra."""

import pytest
from pyspark.sql import functions as F

from glyphlake.functions import files, styles, text, urls


def values(spark, rows, fn, *cols):
    names = [f"c{i}" for i in range(len(rows[0]))]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], ["i", *names])
    return [r[0] for r in df.orderBy("i").select(fn(*[F.col(n) for n in names])).collect()]


BASE = "http://a/b/c/d;p?q"
RFC = [
    ("g", "http://a/b/c/g"), ("./g", "http://a/b/c/g"), ("g/", "http://a/b/c/g/"), ("/g", "http://a/g"),
    ("//g", "http://g/"), ("?y", "http://a/b/c/d;p?y"), ("g?y", "http://a/b/c/g?y"), ("#s", "http://a/b/c/d;p?q#s"),
    ("g#s", "http://a/b/c/g#s"), ("g?y#s", "http://a/b/c/g?y#s"), (";x", "http://a/b/c/;x"), ("g;x", "http://a/b/c/g;x"),
    ("", "http://a/b/c/d;p?q"), (".", "http://a/b/c/"), ("./", "http://a/b/c/"), ("..", "http://a/b/"),
    ("../", "http://a/b/"), ("../g", "http://a/b/g"), ("../..", "http://a/"), ("../../", "http://a/"),
    ("../../g", "http://a/g"), ("../../../g", "http://a/g"), ("/./g", "http://a/g"), ("/../g", "http://a/g"),
    ("g.", "http://a/b/c/g."), ("..g", "http://a/b/c/..g"), ("./../g", "http://a/b/g"), ("./g/.", "http://a/b/c/g/"),
    ("g/./h", "http://a/b/c/g/h"), ("g/../h", "http://a/b/c/h"), ("mailto:x@y", None), ("http://B:80/x y", "http://b/x%20y"),
    ("https://b:443/é", "https://b/%C3%A9"), ("\\/g", "http://a/g"),
]


def test_resolution_follows_the_rfc(spark):
    got = values(spark, [(r, BASE) for r, _ in RFC], urls.resolve_url)
    assert got == [want for _, want in RFC]


def test_private_addresses(spark):
    private = ["http://localhost/", "http://127.0.0.1/", "http://10.0.0.1/", "http://172.31.1.1/", "http://192.168.0.9/",
               "http://169.254.1.1/", "http://100.64.0.1/", "http://100.127.9.9/", "ftp://x/", "http://[::1]/", "junk"]
    public = ["http://172.32.0.1/", "http://11.0.0.1/", "https://example.com/", "http://100.128.0.1/", "http://192.169.0.1/"]
    got = values(spark, [(u,) for u in private + public], urls.is_private_url)
    assert got == [True] * len(private) + [False] * len(public)


def test_crawl_form_sorts_by_key_only_and_is_idempotent(spark):
    got = values(spark, [("http://h/p?b=2&a=9&b=1&a=3#f",), ("http://h/p#x",), (" junk ",)], urls.normalize_crawl_url)
    assert got == ["http://h/p?a=9&a=3&b=2&b=1", "http://h/p", "junk"]
    assert values(spark, [(u,) for u in got], urls.normalize_crawl_url) == got


@pytest.mark.parametrize(
    "label, want",
    [
        ("Foo Extra Bold Italic", ("Foo", "ExtraBold Italic", "800", "Italic")),
        ("Foo Semi Bold", ("Foo", "SemiBold", "600", "Normal")),
        ("Foo Normal Italic", ("Foo", "Italic", "400", "Italic")),
        ("éBold Bold", ("éBold", "Bold", "700", "Normal")),
        ("Bold", None),
        ("Semi Bold Italic", ("Semi", "Bold Italic", "700", "Italic")),
        ("Foo", None),
    ],
)
def test_style_suffix(spark, label, want):
    row = values(spark, [(label,)], styles.style_suffix)[0]
    assert (tuple(row) if row else None) == want


def test_quality_style_tokens(spark):
    cases = {
        "Semi-Bold": "semibold", "Demi Bold Italic": "semibolditalic", "Italic": "regularitalic", "Oblique": "regularitalic",
        "Variable Font": "regular", "Foo VF Italic": "fooregularitalic", "Foo Variable": "fooregular", "Ultra Light": "extralight",
        "Foo Italic": "fooregularitalic", "Bold Oblique": "bolditalic", "Trial": "", "ExLgt": "extralight",
    }
    assert values(spark, [(k,) for k in cases], styles.quality_style_token) == list(cases.values())


def test_target_and_sheet_tokens(spark):
    assert values(spark, [("Foo-LgtItalic",), ("Med Ital",), ("Semi_Bld",), ("SemiBd",)], styles.target_style_token) == [
        "foolightitalic", "mediumitalic", "semibold", "semibold"]
    assert values(spark, [("Oblique",), ("Bold Oblique",)], styles.sheet_style_token) == ["regularitalic", "bolditalic"]


def test_weights(spark):
    raw = ["400", "normal", "bold", "100 900", "", "heavy", "0", "350"]
    assert values(spark, [(r,) for r in raw], styles.weight_value) == [400, 400, 700, 100, None, None, 0, 350]
    assert values(spark, [(r,) for r in raw], lambda c: styles.css_weight_label(styles.weight_value(c))) == [
        "Regular", "Regular", "Bold", "Thin", "Regular", "Regular", "Thin", "Light"]
    assert values(spark, [("160.0",), ("161.0",), ("150.0",), ("999.0",)], lambda c: styles.nearest_weight_label(c.cast("double"))) == [
        "ExtraLight", "ExtraLight", "Thin", None]


def test_entities_decode_twice_through_the_ampersand(spark):
    assert values(spark, [("&amp;lt;b&gt; &QUOT;&#39;&nbsp;x",)], text.decode_html_entities) == ["<b> \"' x"]


def test_reason_codes(spark):
    cases = {"": "unknown", "Case timed out": "timeout", "Request gagal (403)": "network_fetch", "quality-log status=warn": "quality_warn",
             "First skip reason: x": "skip_signal", "whatever": "other"}
    assert values(spark, [(k,) for k in cases], files.reason_code) == list(cases.values())


def test_name_repair(spark):
    cases = {"font.ttf": True, "57803.otf": True, "12.otf": False, "0123456789abcdef.woff": True, "inter-bold.ttf": False,
             "deadbeef-1234-abcd.ttf": True}
    assert values(spark, [(k,) for k in cases], files.needs_name_repair) == list(cases.values())
