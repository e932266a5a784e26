"""Inputs that once gave wrong, missing or late answers."""

import re
import time
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from spindrift import session
from spindrift.functions.robots import pattern_found
from spindrift.operators import dims, fetches, frontier, links, report, robots, search
from spindrift.operators.throttle import throttle
from spindrift.plans.crawl import crawl, crawl_step
from spindrift.sources import tables
from spindrift.streaming.links import run_merge, stream_links
from spindrift.streaming.run import run_available
from spindrift.streaming.throttle import stream_throttle

T0 = datetime(2024, 1, 1)


def state_of(spark, urls, names):
    empty = tables.empty_state(spark)
    queue = spark.createDataFrame([(i + 1, u, T0, d) for i, (u, d) in enumerate(urls)], empty.queue.schema)
    domain = spark.createDataFrame([(i + 1, n, datetime(2023, 1, 1)) for i, n in enumerate(names)], empty.domain.schema)
    return empty.with_tables(queue=queue, domain=domain)


def no_rules(spark):
    return robots.parse_robots(spark.createDataFrame([], "host string, body string"))


@pytest.fixture(params=["America/New_York", "UTC"])
def zone(spark, request):
    before = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", request.param)
    yield request.param
    spark.conf.set("spark.sql.session.timeZone", before)


def test_times_without_zone_keep_their_clock(spark, zone, tmp_path):
    """A spring night in which New York has no 02:30."""
    texts = ["2024-03-10 01:50:00", "2024-03-10 02:30:00", "2024-03-10 03:10:00.000001", "1969-12-31 23:59:59.5"]
    events = spark.createDataFrame([(1, t, i) for i, t in enumerate(texts)], "key int, ts string, id int").withColumn(
        "ts", F.col("ts").cast("timestamp_ntz")
    )
    want = {datetime.fromisoformat(t) for t in texts}
    assert {r.ts for r in throttle(events, "key", "ts", "id", 1800).collect()} == want
    events, want = events.filter("id < 3"), {t for t in want if t.year > 1970}
    assert {r.ts for r in throttle(events, "key", "ts", "id", 1800, 0).collect()} == want
    events.write.parquet(str(tmp_path / "e" / "events.parquet"))
    arriving = spark.readStream.schema(events.schema).parquet(str(tmp_path / "e" / "events.parquet"))
    assert {r.ts for r in run_available(stream_throttle(arriving, "key", "ts", "id", 1800), "zone").collect()} == want


@pytest.mark.parametrize("buckets", [4, 64])
def test_number_of_buckets_comes_from_the_layout(spark, tmp_path, buckets):
    urls = [(f"http://h{i}.example/", i + 1) for i in range(20)]
    pages = spark.createDataFrame([(i, u, "<p>") for i, (u, _) in enumerate(urls)], tables.PAGES_SCHEMA)
    pages = pages.withColumns({k: F.lit(v) for k, v in tables.DEFAULT_HEADERS.items()})
    tables.write_pages(pages, str(tmp_path / "pages"), buckets)
    state = state_of(spark, urls, [f"h{i}.example" for i in range(20)])
    step = crawl_step(state, spark.read.parquet(str(tmp_path / "pages")), no_rules(spark), T0, n=None)
    assert {r.outcome for r in step.outcomes.collect()} == {"html"}

    documents = spark.createDataFrame([(1, "a b b"), (2, "b c")], "doc_id bigint, text string")
    search.write_index(search.postings(documents), str(tmp_path / "index"), buckets)
    n_docs = documents.agg(F.count("*").alias("n"))
    found = search.search(spark.read.parquet(str(tmp_path / "index")), n_docs, ["a", "c"]).collect()
    assert {r.doc_id for r in found} == {1, 2}


def test_streams_take_links_from_good_answers_only(spark, tmp_path):
    rows = [
        (1, "http://a/1", '<a href="/ok">', "HTTP/1.1 200 OK", "text/html"),
        (2, "http://a/2", '<a href="/lost">', "HTTP/1.1 404 Not Found", "text/html"),
        (3, "http://a/3", '<a href="/none">', None, "text/html"),
        (4, "http://b/private", '<a href="/secret">', "HTTP/1.1 200 OK", "text/html"),
    ]
    schema = "page_id long, url string, html string, status_line string, content_type string"
    spark.createDataFrame(rows, schema).write.parquet(str(tmp_path / "pages.parquet"))
    rules = robots.parse_robots(spark.createDataFrame([("b", "User-agent: *\nDisallow: /private")], "host string, body string"))

    def arriving():
        return tables.stream_pages(spark, str(tmp_path / "pages.parquet"), "*.parquet")

    assert {r.path for r in run_available(stream_links(arriving()), "l").collect()} == {"/ok", "/secret"}
    assert {r.path for r in run_available(stream_links(arriving(), rules=rules), "l").collect()} == {"/ok"}
    state = run_merge(arriving(), tables.empty_state(spark), str(tmp_path / "state"), lambda b: T0, rules)
    assert [r.url for r in state.queue.collect()] == ["http://a/ok"]


def test_streams_that_start_empty_know_headers(spark, tmp_path):
    """What arrives later is judged by its headers; files without headers hold good answers."""
    folder, out = tmp_path / "pages", str(tmp_path / "out")
    folder.mkdir()

    def arrive(rows, headers):
        columns = "page_id long, url string, html string" + (", status_line string, content_type string" if headers else "")
        spark.createDataFrame(rows, columns).coalesce(1).write.mode("append").parquet(str(folder))

    def run():
        arriving = tables.stream_pages(spark, str(folder), "*.parquet")
        return {r.path for r in run_available(stream_links(arriving), "late", out).collect()}

    assert run() == set()
    arrive([(1, "http://a/1", '<a href="/lost">', "HTTP/1.1 404 Not Found", "text/html"), (2, "http://a/2", '<a href="/ok">', "HTTP/1.0 200 OK", "text/html"),
               (3, "http://a/3", '<a href="/none">', None, None)], True)
    assert run() == {"/ok"}
    arrive([(4, "http://a/4", '<a href="/plain">')], False)
    arrive([(5, "http://a/5", '<a href="/gone">', "HTTP/1.1 410 Gone", "text/html")], True)
    assert run() == {"/ok", "/plain"}


def test_missing_content_types_are_empty(spark):
    dim = spark.createDataFrame([(1, "text/html")], "id bigint, value string")
    values = spark.createDataFrame([(None,), ("",), ("text/html",)], "value string")
    grown, ids = dims.content_type_ids(dim, values)
    assert grown.count() == 1 and {(r.value, r.id) for r in ids.collect()} == {("", 1), ("text/html", 1)}
    first, _ = dims.content_type_ids(dim.limit(0), values.limit(1))
    again, ids = dims.content_type_ids(first, values.limit(1))
    assert first.collect() == again.collect() and ids.first().id == 1


def test_queue_ids_never_come_back(spark):
    pages = spark.createDataFrame(
        [(1, "http://a.example/1", '<a href="http://b.example/1">'), (2, "http://b.example/1", '<a href="/2">'),
         (3, "http://b.example/2", '<a href="http://c.example/1">'), (4, "http://c.example/1", "")],
        tables.PAGES_SCHEMA,
    ).withColumns({k: F.lit(v) for k, v in tables.DEFAULT_HEADERS.items()})
    state = state_of(spark, [("http://a.example/1", 1)], ["a.example"])
    _, tried = crawl(state, pages, no_rules(spark), T0, rounds=6, tick=60, skip_known=True)
    by_id = {}
    for row in tried.collect():
        assert by_id.setdefault(row.id, row.url) == row.url
    assert sorted(by_id) == [1, 2, 3, 4]
    grown = frontier.enqueue(state.queue.limit(0), spark.createDataFrame([("u", 1)], "url string, domain_id long"), F.lit(T0).cast("timestamp_ntz"), last=F.lit(7))
    assert grown.first().id == 8


PATTERNS = ["/a", "*", "/a*b", "/*.html$", "a$", "$", "*$", "/a**b$", "a$b", "/x*y*z", "+.", "é*", "**", "/a*"]
TARGETS = ["/a", "/axb", "/b.html", "/b.html?x", "a", "ba", "a$b", "/xyz", "/z/y/x", "+.", "é1", "", "/aab", "/a/b/a"]


def test_patterns_match_as_their_regex(spark):
    from spindrift.functions.robots import robots_regex

    pairs = spark.createDataFrame([(p, t) for p in PATTERNS for t in TARGETS], "p string, t string")
    both = pairs.select("p", "t", pattern_found(F.col("p"), F.col("t")).alias("got"),
                        F.rlike("t", F.concat(F.lit("(?d)"), robots_regex(F.col("p")))).alias("want"))
    assert [tuple(r) for r in both.collect() if r.got != r.want] == []


def test_many_stars_take_no_time(spark):
    rule = spark.createDataFrame([("h", "User-agent: *\nDisallow: /" + "a*" * 10 + "b$")], "host string, body string")
    url = spark.createDataFrame([("http://h/" + "a" * 2000,)], "url string")
    rules = robots.parse_robots(rule)
    robots.robots_blocked(url, rules).collect()
    start = time.time()
    assert not robots.robots_blocked(url, rules).first().blocked
    assert time.time() - start < 5


def test_newest_robots_body_counts(spark):
    bodies = [("h", "User-agent: *\nDisallow: /old", datetime(2024, 1, 1)), ("h", "User-agent: *\nDisallow: /new", datetime(2024, 1, 2))]
    rules = robots.parse_robots(spark.createDataFrame(bodies, "host string, body string, fetched_at timestamp_ntz"))
    assert [r.pattern for r in rules.collect()] == ["/new"]


def test_rules_too_large_to_send_give_the_same(spark, monkeypatch):
    monkeypatch.setattr(robots, "RULE_BYTES", 0)
    rules = robots.parse_robots(spark.createDataFrame([("h", "User-agent: *\nDisallow: /a")], "host string, body string"))
    urls = spark.createDataFrame([("http://h/a",), ("http://h/b",), ("http://g/a",)], "url string")
    got = {r.url: r.blocked for r in robots.robots_blocked(urls, rules, few=True).collect()}
    assert got == {"http://h/a": True, "http://h/b": False, "http://g/a": False}


def test_link_values_are_those_of_the_pattern(spark):
    texts = [
        '<a href="/x"><a href="#t"> <a x>', "<article><a class=k href='../q'>", '<a href="" class="x">', '<a\nhref="/n">',
        '<a href="/it\'s"> <a', "<a href=javascript:f()> <a href='b'", '<A HREF="b">\r\n<a href="c"', "", "<ahref='x'>",
        '<a <a href="1"><a href="#"><a href="2', "x" * 50,
    ]
    rows = spark.createDataFrame([(t,) for t in texts], "html string")
    old = F.regexp_extract_all("html", F.lit(links.HREF), 2)
    both = rows.select("html", links.hrefs(F.col("html")).alias("got"), old.alias("want"))
    assert [tuple(r) for r in both.collect() if r.got != r.want] == []


def test_openers_without_link_take_no_time(spark):
    line = '<a href="/first">' + "<a x " * 200_000 + '<a href="#">' * 10
    rows = spark.createDataFrame([(line,)], "html string")
    start = time.time()
    assert rows.select(links.hrefs(F.col("html")).alias("h")).first().h == ["/first"]
    assert time.time() - start < 10


def test_deep_pages_and_outlying_ids(spark, monkeypatch):
    rows = spark.range(5000).select("id").unionByName(spark.createDataFrame([(1 << 62,)], "id long"))
    want = [r.id for r in report.page_of(rows, 301).collect()]
    monkeypatch.setattr(report, "NEAR_ROWS", 10)
    assert [r.id for r in report.page_of(rows, 301).collect()] == want == list(range(3000, 3010))
    assert [r.id for r in report.page_of(rows, 501).collect()] == [1 << 62]
    assert report.page_of(rows, 502).collect() == []
    indexed = {r.id: r.page for r in report.page_index(rows).collect()}
    assert all(indexed[i] == i // 10 + 1 for i in range(5000)) and indexed[1 << 62] == 501
    monkeypatch.setattr(report, "MARGIN", 0.01)
    assert [r.id for r in report.page_of(rows, 301).collect()] == want


def test_folder_without_setting(spark, monkeypatch):
    monkeypatch.setattr(session, "configured_root", lambda s: None)
    root = session.shared_dir(spark)
    assert root and session.shared_dir(spark) == root
    assert session.run_dir(spark, "x").startswith(root.rstrip("/"))


def test_headers_decide_on_the_given_text(spark):
    rows = spark.createDataFrame([("HTTP/1.1 200 OK", "x/y", "")], "status_line string, content_type string, html string")
    assert rows.select(fetches.fetch_outcome(F.col("html")).alias("o")).first().o == "empty"
    assert re.search("crawl_queue", str(tables.JDBC_NAMES))
