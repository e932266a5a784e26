"""Dimensions, ids, queue and reports: properties and brute force."""

import fnmatch
import random
from datetime import datetime
from hashlib import md5

import pytest
from compare import plans_cut
from pyspark.sql import functions as F

from spindrift.operators import dims, frontier, report, store
from spindrift.sources import tables

NOW = datetime(2024, 1, 1)


def now():
    return F.lit(NOW).cast("timestamp_ntz")


def names(spark, *values):
    return spark.createDataFrame([(v,) for v in values], "name string")


def rows(df):
    return sorted(tuple(r) for r in df.collect())


@pytest.mark.parametrize("digits", [1, 2, 4])
def test_ids_do_not_depend_on_buckets_or_partitions(spark, digits):
    values = [f"h{i}" for i in range(500)]
    order = {v: i + 7 for i, v in enumerate(sorted(values, key=lambda v: (md5(v.encode()).hexdigest(), v)))}
    df = names(spark, *values).repartition(digits * 3)
    assert dict(dims.assign_ids(df, ["name"], 7, digits).collect()) == order


def test_upsert_is_idempotent_and_keeps_ids(spark):
    dim = spark.createDataFrame([(4, "a"), (9, "b")], tables.STATE_SCHEMAS["protocols"])
    once = dims.upsert_dim(dim, names(spark, "c", "a", "c", None, "d"))
    twice = dims.upsert_dim(once, names(spark, "d", "a"))
    got = rows(once)
    assert {n for _, n in got} == set("abcd")
    assert (4, "a") in got and (9, "b") in got
    assert sorted(i for i, _ in got) == [4, 9, 10, 11]
    assert rows(twice) == got


def test_protocols_are_fixed(spark):
    empty = spark.createDataFrame([], tables.STATE_SCHEMAS["protocols"])
    got = rows(dims.upsert_protocols(empty, names(spark, "ftp", "https")))
    assert got == [(0, "http"), (1, "https"), (2, "ftp")]


def test_new_domain_waits(spark):
    empty = spark.createDataFrame([], tables.STATE_SCHEMAS["domain"])
    grown = dims.upsert_domain(empty, names(spark, "a.example"), now())
    assert rows(grown) == [(1, "a.example", NOW)]
    batch = spark.createDataFrame([(1, "a.example")], "id bigint, host string")
    assert frontier.due(batch, grown, now()).count() == 0
    assert frontier.due(batch, grown, now() + frontier.seconds(1)).count() == 1


def test_content_types_equal_brute_force(spark):
    rng = random.Random(3)
    entries = {i + 1: v for i, v in enumerate(["text/html; charset=utf-8", "TEXT/plain", "text/html", "a%b", "image/x_y"])}
    looked = ["text/html", "text", "", "%", "_", "plain", "pdf", "PDF", "html; ", "a%b", "axb", "image/x-y"]
    looked += ["".join(rng.choice("tex/hml") for _ in range(rng.randrange(1, 4))) for _ in range(20)]
    dim = spark.createDataFrame(list(entries.items()), "id bigint, value string")
    grown, ids = dims.content_type_ids(dim, spark.createDataFrame([(v,) for v in looked], "value string"))
    found = {v: min((i for i, e in entries.items() if v.lower() in e.lower()), default=None) for v in looked}
    got = dict(ids.collect())
    assert got.keys() == found.keys()
    assert {v: i for v, i in got.items() if i <= 5} == {v: i for v, i in found.items() if i}
    added = sorted({v.lower() for v, i in found.items() if i is None}, key=lambda v: (md5(v.encode()).hexdigest(), v))
    assert {v: got[v] for v in got if got[v] > 5} == {
        v: 6 + added.index(v.lower()) for v, i in found.items() if i is None
    }
    assert rows(grown)[:5] == sorted(entries.items()) and grown.count() == 5 + len(added)


def test_domain_patterns_equal_brute_force(spark):
    known = ["a.com", "abc.com", "x_y.org", "x-y.org", "xay.org", "b\\c.net", "é.fr", "a.co.uk"]
    hosts = ["a.com", "A.COM", "_.com", "%", "%.org", "x_y.org", "___.com", "%a%", "_%", "b\\c.net", "_.fr", "no.such", "a._o%"]
    hosts += ["%.c%m", "a%", "%m", "%xay%", "%zzz%", "_%y%", "%%", "b\\%", "%.org%g", "a%b%", "%uk", "%a_", "", "%\u00e9%"]
    domain = spark.createDataFrame([(i, n, NOW) for i, n in enumerate(known)], tables.STATE_SCHEMAS["domain"])
    df = spark.createDataFrame([(h,) for h in hosts], "host string")

    def like(name, host):
        # fnmatch has the same two wildcards under other names.
        return fnmatch.fnmatchcase(name, host.lower().replace("_", "?").replace("%", "*"))

    got = {(r.host, r.name) for r in dims.match_domains(df, domain, pattern=True).collect()}
    assert got == {(h, n) for h in hosts for n in known if like(n, h)}
    equal = {(r.host, r.name) for r in dims.match_domains(df, domain).collect()}
    assert equal == {(h, n) for h in hosts for n in known if n == h.lower()}


def test_names_are_indexed_by_grams_that_hosts_ask_for(spark):
    """No table of all substrings: of long names, only the grams asked for are kept."""
    names = [(i, f"host{i:04}.{'x' * 200}.example", NOW) for i in range(300)]
    domain = spark.createDataFrame(names, tables.STATE_SCHEMAS["domain"])
    hosts = spark.createDataFrame([("%t0007%",), ("%xample",), ("%t01_7.%",), ("host02%",)], "host string")
    with plans_cut() as found:
        got = {(r.host, r.domain_id) for r in dims.match_domains(hosts, domain, pattern=True).collect()}
    want = {("%t0007%", 7)} | {("%xample", i) for i in range(300)} | {("%t01_7.%", i) for i in range(107, 200, 10)}
    assert got == want | {("host02%", i) for i in range(200, 300)}
    index = [plan for plan in found if "_marked" in plan]
    assert len(index) == 1 and "LeftSemi" in index[0]


def queue(spark, data):
    return spark.createDataFrame(data, tables.STATE_SCHEMAS["queue"])


def test_enqueue_and_dequeue_conserve_rows(spark):
    before = queue(spark, [(3, "u1", NOW, 1), (5, "u2", NOW, 2)])
    links = spark.createDataFrame([("u2", 2), ("u3", 1), ("u3", 1), ("u4", 4)], "url string, domain_id bigint")
    after = frontier.enqueue(before, links, now())
    assert sorted(r.url for r in after.collect()) == ["u1", "u2", "u3", "u4"]
    assert sorted(r.id for r in after.collect()) == [3, 5, 6, 7]
    assert rows(frontier.enqueue(after, links, now())) == rows(after)
    done = spark.createDataFrame([(3,), (5,), (99,)], "id bigint")
    assert sorted(r.url for r in frontier.dequeue(after, done).collect()) == ["u3", "u4"]


def test_seeds_get_their_domain(spark):
    state = tables.empty_state(spark)
    urls = spark.createDataFrame([("http://A.example/1",), ("http://a.example/2",), ("http://a.example/2",), ("x",)], "url string")
    grown, domain = frontier.add_seeds(state.queue, state.domain, urls, now())
    assert rows(domain) == [(1, "a.example", NOW)]
    assert {(r.url, r.domain_id) for r in grown.collect()} == {
        ("http://A.example/1", 1), ("http://a.example/2", 1), ("x", None),
    }


def test_frontier_order_and_places(spark):
    base = [(i, f"http://h{i % 4}.example/{i}", datetime(2024, 1, 1, 0, 0, 20 - i // 4), i % 4) for i in range(20)]
    q = queue(spark, base)
    oldest = {d: min((r for r in base if r[3] == d), key=lambda r: (r[2], r[0])) for d in range(4)}
    want = sorted(oldest.values(), key=lambda r: (r[2], r[0]))
    assert [tuple(r) for r in frontier.frontier(q, 3).collect()] == want[:3]
    assert rows(frontier.frontier(q, None)) == sorted(want)
    later = datetime(2025, 1, 1)
    domain = spark.createDataFrame(
        [(d, f"h{d}.example", later if d == 0 else datetime(2023, 1, 1)) for d in range(4)], tables.STATE_SCHEMAS["domain"]
    )
    due_first = frontier.frontier(q, 3, True, domain, now())
    assert [tuple(r) for r in due_first.collect()] == [r for r in want if r[3] != 0]


def test_links_are_stored_once(spark):
    url = spark.createDataFrame([(1, "/a", 1, 0)], tables.STATE_SCHEMAS["url"])
    links = spark.createDataFrame(
        [("/a", 1, 0, "q"), ("/a", 1, 1, "q"), ("/a", 1, 1, "r"), ("/A", 1, 0, None)],
        "path string, domain_id bigint, scheme_id bigint, query string",
    )
    grown = store.insert_urls(url, links)
    assert {(r.path, r.domain_id, r.scheme_id) for r in grown.collect()} == {("/a", 1, 0), ("/a", 1, 1), ("/A", 1, 0)}
    assert rows(store.insert_urls(grown, links)) == rows(grown)
    found = {(r.path, r.scheme_id): r.url_id for r in dims.url_ids(links, url).collect()}
    assert found == {("/a", 0): 1, ("/a", 1): None, ("/A", 0): None}


@pytest.mark.parametrize("ids", [range(1, 96), [1], [-5, 0, 7, 10**15, 2**62], [5, 6, 7, 8 * 10**18]])
def test_page_index(spark, ids):
    df = spark.createDataFrame([(i,) for i in ids], "id bigint").repartition(5)
    got = {r.id: r.page for r in report.page_index(df).collect()}
    assert got == {i: n // 10 + 1 for n, i in enumerate(sorted(ids))}


def test_pages(spark):
    df = spark.range(1, 26)
    assert [r.id for r in report.page_of(df, 3).collect()] == [21, 22, 23, 24, 25]
    for first in (None, 0, 1):
        assert [r.id for r in report.page_of(df, first).collect()] == list(range(1, 11))
    assert report.page_of(df, 4).count() == 0
    assert tuple(report.page_summary(df).first()) == (25, 3)
    assert tuple(report.page_summary(df.limit(0)).first()) == (0, 0)


def test_state_round_trip(spark, tmp_path):
    state = tables.empty_state(spark)
    stored = tables.write_state(state.with_tables(queue=queue(spark, [(1, "u", NOW, None)])), str(tmp_path / "s"))
    assert rows(stored.queue) == [(1, "u", NOW, None)]
    assert rows(report.crawl_report(stored.url, stored.domain, stored.queue)) == [(0, 0, 1)]
    with pytest.raises(Exception, match="already exists"):
        tables.write_state(stored, str(tmp_path / "s"))
