"""Link extraction, resolution and URL parts on hand-made rows."""

import pytest
from pyspark.sql import functions as F

from spindrift.functions.urls import content_key, directory_name, remove_dot_segments, url_parts
from spindrift.operators.links import extract_links, normalize_links, page_links, resolve_links

EXTRACTION = [
    ('<a href="#t">A</a> <a href="/x">', ["/x"]),
    ("<a href='javascript:f()'>z</a>\n<A HREF='b.html'>", ["b.html"]),
    ('<article><h1>x</h1><a class="k" href="../q">', ["../q"]),
    ('<a href="" class="x">', ['" class=']),
    ('<a\nhref="/n">', []),
    ('<a href="/it\'s">', ["/it"]),
    ('<a href="/a">\r<a href="/b"> <a href="/a">', ["/a", "/b", "/a"]),
    ("", []),
]

PAGE = "http://h.example/a/b/c.html"
RESOLUTION = [
    ("../x.html", "http://h.example/a/x.html", None),
    ("../y.html", "http://h.example/a/y.html", "http://h.example/y.html"),
    ("//o.example/p", "http://o.example/p", None),
    ("/r?q=1#f", "http://h.example/r?q=1#f", None),
    ("./s.html", "http://h.example/a/b/s.html", "http://h.example./s.html"),
    ("t.html", "http://h.example/a/b/t.html", None),
    ("d/u.html", "http://h.example/a/b/d/u.html", "http://h.exampled/u.html"),
    ("dd/u.html", "http://h.example/a/b/dd/u.html", None),
    ("https://z.example/", "https://z.example/", None),
    ("httpdocs.html", "http://h.example/a/b/httpdocs.html", "httpdocs.html"),
    ("?page=2", "http://h.example/a/b/c.html?page=2", "httpdocs.html"),
    ("mailto:a@b.example", "mailto:a@b.example", "http://h.example/a/b/mailto:a@b.example"),
    ("../../../../v.html", "http://h.example/v.html", "/v.html"),
]

# The examples of RFC 3986 section 5.4, for http://a/b/c/d;p?q
RFC_EXAMPLES = {
    "g:h": "g:h", "g": "http://a/b/c/g", "./g": "http://a/b/c/g", "g/": "http://a/b/c/g/", "/g": "http://a/g",
    "//g": "http://g", "?y": "http://a/b/c/d;p?y", "g?y": "http://a/b/c/g?y", "#s": "http://a/b/c/d;p?q#s",
    "g#s": "http://a/b/c/g#s", "g?y#s": "http://a/b/c/g?y#s", ";x": "http://a/b/c/;x", "g;x": "http://a/b/c/g;x",
    "": "http://a/b/c/d;p?q", ".": "http://a/b/c/", "./": "http://a/b/c/", "..": "http://a/b/", "../": "http://a/b/",
    "../g": "http://a/b/g", "../..": "http://a/", "../../": "http://a/", "../../g": "http://a/g",
    "../../../g": "http://a/g", "/./g": "http://a/g", "/../g": "http://a/g", "g.": "http://a/b/c/g.",
    ".g": "http://a/b/c/.g", "g..": "http://a/b/c/g..", "..g": "http://a/b/c/..g", "./../g": "http://a/b/g",
    "./g/.": "http://a/b/c/g/", "g/./h": "http://a/b/c/g/h", "g/../h": "http://a/b/c/h",
    "g;x=1/./y": "http://a/b/c/g;x=1/y", "g;x=1/../y": "http://a/b/c/y", "g?y/../x": "http://a/b/c/g?y/../x",
    "g#s/../x": "http://a/b/c/g#s/../x", "http:g": "http:g",
}

PARTS = [
    ("http://a.com/x y/é?q=1#f", ("http", "a.com", None, "/x y/é", "q=1", "f")),
    ("/rel?x", (None, None, None, "/rel", "x", None)),
    ("http://a.com", ("http", "a.com", None, None, None, None)),
    ("http://A.com:8080/p", ("http", "a.com", 8080, "/p", None, None)),
    ("mailto:a@b", ("mailto", None, None, "a@b", None, None)),
    ("HTTPS://u:p@H.example:1/x?#", ("https", "h.example", 1, "/x", None, None)),
    ("//cdn.example", (None, "cdn.example", None, None, None, None)),
    ("http://[2001:db8::1]:80/", ("http", "[2001:db8::1]", 80, "/", None, None)),
    ("", (None,) * 6),
]


def one_page(spark, links, url=PAGE):
    rows = [(1, url, pos, href) for pos, href in enumerate(links)]
    return spark.createDataFrame(rows, "page_id bigint, url string, pos int, href string")


def test_extraction(spark):
    pages = spark.createDataFrame(
        [(i, PAGE, html) for i, (html, _) in enumerate(EXTRACTION)], "page_id bigint, url string, html string"
    )
    got = {}
    for row in extract_links(pages).orderBy("page_id", "pos").collect():
        got.setdefault(row.page_id, []).append(row.href)
    assert got == {i: hrefs for i, (_, hrefs) in enumerate(EXTRACTION) if hrefs}


@pytest.mark.parametrize("mode", ["rfc", "legacy"])
def test_resolution(spark, mode):
    got = resolve_links(one_page(spark, [r[0] for r in RESOLUTION]), mode).orderBy("pos")
    want = [legacy or rfc if mode == "legacy" else rfc for _, rfc, legacy in RESOLUTION]
    assert [row.resolved for row in got.collect()] == want


def test_rfc_examples(spark):
    got = resolve_links(one_page(spark, list(RFC_EXAMPLES), "http://a/b/c/d;p?q"))
    assert {row.href: row.resolved for row in got.collect()} == RFC_EXAMPLES


def test_legacy_state_does_not_leave_the_page(spark):
    rows = [(1, PAGE, 0, "../../x"), (1, PAGE, 1, "?a"), (2, PAGE, 0, "?b"), (2, PAGE, 1, "../y")]
    links = spark.createDataFrame(rows, "page_id bigint, url string, pos int, href string")
    got = {(r.page_id, r.pos): r.resolved for r in resolve_links(links, "legacy").collect()}
    assert got == {
        (1, 0): "http://h.example/x", (1, 1): "http://h.example/x", (2, 0): "", (2, 1): "http://h.example/a/y",
    }


def test_normalized_defaults(spark):
    links = one_page(spark, ["//o.example", "mailto:a@b.example", "x?q#f"])
    got = normalize_links(resolve_links(links)).orderBy("pos").collect()
    assert [(r.scheme, r.host, r.path, r.query, r.fragment, r.scheme_supported) for r in got] == [
        ("http", "o.example", "/", None, None, True),
        ("mailto", "h.example", "a@b.example", None, None, False),
        ("http", "h.example", "/a/b/x", "q", "f", True),
    ]


@pytest.mark.parametrize("mode", ["rfc", "legacy"])
def test_one_pass_equals_three(spark, mode):
    html = " ".join(f'<a href="{href}">' for href, _, _ in RESOLUTION)
    pages = spark.createDataFrame([(1, PAGE, html)], "page_id bigint, url string, html string")
    apart = normalize_links(resolve_links(extract_links(pages), mode))
    together = page_links(pages, mode)
    assert together.columns == apart.columns
    assert sorted(together.collect()) == sorted(apart.collect())


def test_url_parts(spark):
    df = spark.createDataFrame([(u,) for u, _ in PARTS], "url string")
    got = {r.url: tuple(r.p) for r in df.select("url", url_parts(F.col("url")).alias("p")).collect()}
    assert got == dict(PARTS)


def test_dot_segments_and_directories(spark):
    paths = {"/a/b/c/./../../g": "/a/g", "/a//../b": "/a/b", "/..": "/", "/a/.": "/a/", "/x.y/z": "/x.y/z"}
    df = spark.createDataFrame([(p,) for p in paths], "p string")
    assert {r.p: r.c for r in df.select("p", remove_dot_segments(F.col("p")).alias("c")).collect()} == paths
    directories = {
        "http://h.example/a/b/c.html": "http://h.example/a/b", "http://h.example/a/b/": "http://h.example/a",
        "http://h.example/": "http:", "http://h.example": "http:", "http://h.example/x?y=/z": "http://h.example/x?y=",
        "x": ".",
    }
    df = spark.createDataFrame([(u,) for u in directories], "u string")
    assert {r.u: r.d for r in df.select("u", directory_name(F.col("u")).alias("d")).collect()} == directories


def test_content_key(spark):
    from hashlib import md5

    df = spark.createDataFrame([("http://H.example/p?a=b c*~", True), ("https://h.example/p?x", False)], "u string, h boolean")
    got = [r.k for r in df.select(content_key(url_parts(F.col("u")), F.col("h")).alias("k")).collect()]
    base = md5(b"h.example/p").hexdigest()
    assert got == [base + "a%3Db+c%2A%7E", base]
