"""Crawl steps and rounds on a small web, and the streams of links."""

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from spindrift.operators.fetches import classify_fetch, content_store
from spindrift.operators.robots import parse_robots
from spindrift.plans.crawl import crawl, crawl_step
from spindrift.sources import statelog, tables
from spindrift.streaming.links import run_merge, stream_links
from spindrift.streaming.run import run_available

T0 = datetime(2024, 1, 1)
A1, A2, B1 = "http://a.example/1", "http://a.example/2", "http://b.example/1"
WEB = [
    (1, A1, f'<a href="/2"> <a href="{B1}">'),
    (2, A2, "none"),
    (3, B1, f'<a href="{A1}">'),
]


def web(spark, rows=WEB):
    pages = spark.createDataFrame(rows, tables.PAGES_SCHEMA)
    return pages.withColumns({name: F.lit(value) for name, value in tables.DEFAULT_HEADERS.items()})


def no_rules(spark):
    return parse_robots(spark.createDataFrame([], "host string, body string"))


def start(spark, urls=(A1,), domains=(("a.example", T0 - timedelta(seconds=1)),)):
    ids = {name: i for i, (name, _) in enumerate(domains, 1)}
    queue = [(i, u, T0, ids.get(u.split("/")[2]) if "//" in u else None) for i, u in enumerate(urls, 1)]
    return tables.empty_state(spark).with_tables(
        queue=spark.createDataFrame(queue, tables.STATE_SCHEMAS["queue"]),
        domain=spark.createDataFrame([(ids[n], n, at) for n, at in domains], tables.STATE_SCHEMAS["domain"]),
    )


@pytest.fixture(params=["few", "many"])
def size(request, monkeypatch):
    """Both ways to meet the large tables: the small side is sent, or both are shuffled."""
    if request.param == "many":
        monkeypatch.setattr("spindrift.plans.crawl.FEW_ROWS", -1)
        monkeypatch.setattr("spindrift.streaming.links.FEW_ROWS", -1)


def outcomes(df):
    return sorted((r.round, r.url, r.outcome) for r in df.collect())


def test_rounds_end_when_known_urls_are_skipped(spark, tmp_path, size):
    state, tried = crawl(
        start(spark), web(spark), no_rules(spark), T0, rounds=9, skip_known=True,
        directory=str(tmp_path / "run"), content=str(tmp_path / "content"),
    )
    assert outcomes(tried) == [(1, A1, "html"), (2, A2, "html"), (2, B1, "html")]
    assert state.queue.count() == 0
    hosts = {r.id: r.name for r in state.domain.collect()}
    assert {(r.path, hosts[r.domain_id], r.scheme_id) for r in state.url.collect()} == {
        ("/2", "a.example", 0), ("/1", "b.example", 0), ("/1", "a.example", 0),
    }
    assert {r.url for r in state.tried.collect()} == {A1, A2, B1}
    visits = {r.name: r.next_visit for r in state.domain.collect()}
    assert visits == dict.fromkeys(("a.example", "b.example"), T0 + timedelta(seconds=20))
    stored = tables.read_content(spark, str(tmp_path / "content"))
    assert {(r.url, r.body) for r in stored.collect()} == {(u, h) for _, u, h in WEB}


def test_rounds_go_on_without_it(spark):
    _, tried = crawl(start(spark), web(spark), no_rules(spark), T0, rounds=3)
    assert outcomes(tried) == [(1, A1, "html"), (2, A2, "html"), (2, B1, "html"), (3, A1, "html")]


def test_no_rounds(spark):
    state, tried = crawl(start(spark, urls=()), web(spark), no_rules(spark), T0, rounds=3)
    assert tried.count() == 0 and state.queue.count() == 0


def test_outcomes_of_one_step(spark, size):
    names = ("due", "late", "equal", "shut", "gone", "moved", "pdf", "void")
    urls = [f"http://{n}.example/p" for n in names] + ["nonsense", "http://new.example/"]
    early, hour = T0 - timedelta(hours=1), T0 + timedelta(hours=1)
    domains = [(f"{n}.example", {"late": hour, "equal": T0}.get(n, early)) for n in names] + [("new.example", T0)]
    pages = spark.createDataFrame(
        [
            (urls[0], "HTTP/1.1 200 OK", "Text/HTML", '<a href="http://late.example/p"> <a href="ftp://f.example/x"> <a href="//n.example?q">'),
            (urls[5], "HTTP/1.1 301 Moved Permanently", "text/html", "<a href='/x'>"),
            (urls[6], "HTTP/1.0 200 OK", "application/pdf", "%PDF <a href='/in-pdf'>"),
            (urls[7], "HTTP/1.1 200 OK", None, ""),
            (urls[3], "HTTP/1.1 200 OK", "text/html", "x"),
        ],
        "url string, status_line string, content_type string, body string",
    )
    rules = parse_robots(
        spark.createDataFrame([("shut.example", "User-agent: *\nDisallow: /")], "host string, body string")
    )
    state = start(spark, urls, domains)
    step = crawl_step(state, pages, rules, T0, n=100)
    assert {r.url: r.outcome for r in step.outcomes.collect()} == {
        urls[0]: "html", urls[1]: "not_due", urls[2]: "not_due", urls[3]: "blocked", urls[4]: "skipped",
        urls[5]: "skipped", urls[6]: "other", urls[7]: "empty", "nonsense": "invalid", urls[9]: "not_due",
    }
    # What is not due stays; a link to a queued URL is not added again; ftp is never added.
    assert {r.url for r in step.state.queue.collect()} == {
        urls[1], urls[2], urls[9], "http://n.example?q", "http://pdf.example/in-pdf",
    }
    visits = {r.name: r.next_visit for r in step.state.domain.collect()}
    assert {n for n, at in visits.items() if at == T0 + timedelta(seconds=5)} == {"due.example", "pdf.example"}
    assert visits["n.example"] == T0
    assert {r.path for r in step.state.url.collect()} == {"/p", "/", "/in-pdf"}
    assert {r.url for r in step.fetched.collect()} == {urls[0], urls[6]}
    assert {r.name for r in step.state.protocols.collect()} == {"http", "https"}


def test_due_first_and_places(spark):
    domains = [("a.example", T0 + timedelta(hours=1)), ("b.example", T0 - timedelta(hours=1))]
    state = start(spark, [A1, B1], domains)
    first = crawl_step(state, web(spark), no_rules(spark), T0, n=1)
    assert [(r.url, r.outcome) for r in first.outcomes.collect()] == [(A1, "not_due")]
    first = crawl_step(state, web(spark), no_rules(spark), T0, n=1, due_first=True)
    assert [(r.url, r.outcome) for r in first.outcomes.collect()] == [(B1, "html")]


def test_pages_by_bucket_and_newest_copy(spark, tmp_path):
    pages = web(spark).withColumn("fetched_at", F.lit(T0).cast("timestamp_ntz"))
    newer = pages.withColumn("html", F.lit('<a href="/newer">')).withColumn("fetched_at", F.lit(T0 + timedelta(days=1)).cast("timestamp_ntz"))
    tables.write_pages(pages.unionByName(newer), str(tmp_path / "pages"), buckets=8)
    laid_out = spark.read.parquet(str(tmp_path / "pages"))
    step = crawl_step(start(spark), laid_out, no_rules(spark), T0)
    assert [(r.url, r.outcome) for r in step.outcomes.collect()] == [(A1, "html")]
    assert [r.url for r in step.state.queue.collect()] == ["http://a.example/newer"]


def test_copies_of_one_page_are_stored_once(spark):
    fetches = spark.createDataFrame(
        [(1, f"http{s}://a.example/p#{i}", f"body {i}", T0 + timedelta(seconds=i % 7)) for i in range(50) for s in ("", "s")],
        "domain_id bigint, url string, body string, fetched_at timestamp_ntz",
    ).withColumns({name: F.lit(value) for name, value in tables.DEFAULT_HEADERS.items()})
    stored = content_store(classify_fetch(fetches)).collect()
    assert [(r.url, r.body) for r in stored] == [("https://a.example/p#6", "body 6")]


def arriving(spark, path):
    return tables.stream_pages(spark, f"{path}/*", "*.parquet", files_per_trigger=1)


def test_stream_links_over_batches(spark, tmp_path):
    for number, row in enumerate(WEB + [(4, "https://a.example/1", '<a href="http://b.example/1#x">')]):
        spark.createDataFrame([row], tables.PAGES_SCHEMA).coalesce(1).write.parquet(f"{tmp_path}/in/{number}")
    got = run_available(stream_links(arriving(spark, f"{tmp_path}/in")), "s", str(tmp_path / "out"))
    assert sorted((r.scheme, r.host, r.path) for r in got.collect()) == [
        ("http", "a.example", "/1"), ("http", "a.example", "/2"), ("http", "b.example", "/1"),
    ]
    timed = arriving(spark, f"{tmp_path}/in").withColumn("seen_at", F.lit(T0) + F.make_dt_interval(secs=F.col("page_id").cast("decimal(18,6)")))
    bounded = stream_links(timed, seen_at="seen_at", watermark="1 hour")
    assert sorted(run_available(bounded, "w", str(tmp_path / "out-w")).collect()) == sorted(got.collect())


def test_stream_merge_is_idempotent_and_goes_on(spark, tmp_path, size):
    directory = str(tmp_path / "merge")

    def clock(batch):
        return T0 + timedelta(seconds=batch)

    spark.createDataFrame(WEB[:1], tables.PAGES_SCHEMA).coalesce(1).write.parquet(f"{tmp_path}/in/0")
    spark.createDataFrame(WEB[1:], tables.PAGES_SCHEMA).coalesce(1).write.parquet(f"{tmp_path}/in/1")
    state = run_merge(arriving(spark, f"{tmp_path}/in"), start(spark), directory, clock)
    assert {r.url for r in state.queue.collect()} == {A1, A2, B1}
    assert state.url.count() == 3
    again = run_merge(arriving(spark, f"{tmp_path}/in"), None, directory, clock)
    assert sorted(again.queue.collect()) == sorted(state.queue.collect())
    spark.createDataFrame([(9, B1, '<a href="/late">')], tables.PAGES_SCHEMA).coalesce(1).write.parquet(f"{tmp_path}/in/2")
    more = run_merge(arriving(spark, f"{tmp_path}/in"), None, directory, clock)
    assert {r.url for r in more.queue.collect()} == {A1, A2, B1, "http://b.example/late"}
    assert more.url.count() == 4
    assert sorted(statelog.load_version(spark, directory, 0).queue.collect()) == sorted(start(spark).queue.collect())


@pytest.mark.parametrize("partitions", [1, 7])
def test_step_does_not_depend_on_partitions(spark, partitions):
    state = start(spark, [A1, B1], [("a.example", T0 - timedelta(1)), ("b.example", T0 - timedelta(1))])
    mixed = state.with_tables(queue=state.queue.repartition(partitions), domain=state.domain.repartition(partitions))
    step = crawl_step(mixed, web(spark).repartition(partitions), no_rules(spark), T0)
    # a/2 has the only new id, as b/1 and a/1 were queued before the step.
    assert sorted(tuple(r) for r in step.state.queue.collect()) == [(3, A2, T0, 1)]
