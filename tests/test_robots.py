"""Robots rules on hand-made bodies."""

import re

import pytest
from pyspark.sql import functions as F

from spindrift.functions.robots import robots_regex
from spindrift.operators.robots import parse_robots, robots_blocked

BODY = """User-agent: *
Disallow: /en/
Allow: /en/2
Disallow: /*.html$
User-agent: Bot
Disallow: /
"""
EXPECTED = [
    ("http://h.example/en/30", True, True),
    ("http://h.example/en/25", False, True),
    ("http://h.example/en/25.html", True, True),
    ("http://h.example/fr/en/x", True, True),
    ("http://h.example/fr/1", False, True),
    ("http://h.example", False, True),
    ("http://other.example/en/30", False, False),
]


def rules(spark, *bodies):
    hosts = [("h.example" if i == 0 else f"h{i}.example", body) for i, body in enumerate(bodies)]
    return parse_robots(spark.createDataFrame(hosts, "host string, body string"))


@pytest.mark.parametrize("agent,column", [("*", 1), ("Bot", 2), ("Other", 1)])
def test_blocked(spark, agent, column):
    urls = spark.createDataFrame([(row[0],) for row in EXPECTED], "url string")
    got = {r.url: r.blocked for r in robots_blocked(urls, rules(spark, BODY), agent).collect()}
    assert got == {row[0]: row[column] for row in EXPECTED}


def test_duplicate_urls_are_kept(spark):
    urls = spark.createDataFrame([("http://h.example/en/30",)] * 3, "url string")
    assert robots_blocked(urls, rules(spark, BODY)).filter("blocked").count() == 3


def test_parse_details(spark):
    body = (
        "Disallow: /before\r\n"
        "user-AGENT : A # who\r\n"
        " Disallow: /indented\n"
        "DISALLOW: /p#q\n"
        "Disallow:\n"
        "Disallow: \n"
        "Disallow: # all\n"
        "Allow: /x: y\n"
        "Sitemap: http://h/\n"
        "User-agent: B\n"
        "User-agent: C\n"
        "Disallow: /c"
    )
    got = rules(spark, body).orderBy("pos").collect()
    assert [(r.agent, r.pos, r.pattern, r.allow) for r in got] == [
        ("A", 3, "/p", False), ("A", 7, "/x", True), ("C", 11, "/c", False),
    ]


def test_tie_goes_to_the_later_rule(spark):
    urls = spark.createDataFrame([("http://h.example/ab",), ("http://h1.example/ab",)], "url string")
    both = rules(spark, "User-agent: *\nDisallow: /a\nAllow: ab\n", "User-agent: *\nAllow: ab\nDisallow: /a\n")
    got = {r.url: r.blocked for r in robots_blocked(urls, both).collect()}
    assert got == {"http://h.example/ab": False, "http://h1.example/ab": True}


def test_length_counts_escapes(spark):
    # Built, ``/a.b`` is five characters and beats the four of ``/a*``.
    urls = spark.createDataFrame([("http://h.example/a.b",)], "url string")
    got = robots_blocked(urls, rules(spark, "User-agent: *\nDisallow: /a.b\nAllow: /a*\n")).first()
    assert got.blocked


@pytest.mark.parametrize("pattern", ["/a[b", "/{x}|y", "/a\\b", "/$x$", "/(", "/*?*=^+", "$", "*"])
def test_patterns_are_literal_but_for_star_and_end(spark, pattern):
    df = spark.createDataFrame([(pattern,)], "p string")
    regex = df.select(robots_regex(F.col("p"))).first()[0]
    body = pattern[:-1] if pattern.endswith("$") else pattern
    want = ".*".join(re.escape(piece) for piece in body.split("*")) + ("$" if pattern.endswith("$") else "")
    for text in (pattern, pattern.replace("*", "mid"), body, "/other", "/a[bc", "x"):
        assert bool(re.search(regex, text)) == bool(re.search(want, text))
