"""Choosing rows by narrow columns and reading wide ones by place."""

from __future__ import annotations

import random
import re
from datetime import datetime, timedelta
from hashlib import md5

import pytest
from compare import plan, plans_cut
from pyspark.sql import functions as F

from spindrift.operators import fetches, places
from spindrift.plans import crawl as crawl_plan

T0 = datetime(2024, 1, 1)
CONTENT = "domain_id long, content_key string, url string, body string, fetched_at timestamp_ntz"


def lines(text: str, node: str) -> list[str]:
    return [line for line in text.splitlines() if re.match(rf"[\s+\-:*()\d]*{node}\b", line)]


@pytest.fixture(params=[True, False], ids=["sent", "sieved"])
def few(request, monkeypatch, spark):
    """Chosen places are sent to all tasks, or are too many for that."""
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    if not request.param:
        monkeypatch.setattr(places, "FEW_ROWS", -1)
        monkeypatch.setattr(crawl_plan, "FEW_ROWS", -1)
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield request.param
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def bodies(n=400):
    rng = random.Random(1)
    rows = []
    for _ in range(n):
        body = rng.choice([None, "", "same", f"text {rng.randrange(50)}"])
        at = rng.choice([None, T0, T0 + timedelta(seconds=rng.randrange(3))])
        rows.append((rng.choice([1, 2, None]), f"k{rng.randrange(12)}", f"u{rng.randrange(4)}", body, at))
    return rows + rows[:40]


def newest(rows):
    best = {}
    for row in rows:
        order = tuple((x is not None, x) for x in (row[4], row[2], md5(row[3].encode()).hexdigest() if row[3] is not None else None))
        if row[:2] not in best or best[row[:2]][0] < order:
            best[row[:2]] = order, row
    return {row for _, row in best.values()}


@pytest.mark.parametrize("from_file", [True, False])
def test_newest_content_is_that_of_a_plain_search(spark, tmp_path, few, from_file):
    rows = bodies()
    df = spark.createDataFrame(rows, CONTENT)
    if from_file:
        df.repartition(3).write.parquet(str(tmp_path / "c"))
        df = spark.read.parquet(str(tmp_path / "c"))
    assert places.has_places(df) == from_file
    got = [tuple(r) for r in fetches.newest_content(df).collect()]
    assert len(got) == len(set(got)) and set(got) == newest(rows)


def test_bodies_that_lose_are_neither_sorted_nor_shuffled(spark, tmp_path, few):
    df = spark.createDataFrame(bodies(), CONTENT)
    df.write.parquet(str(tmp_path / "c"))
    with plans_cut() as found:
        result = fetches.newest_content(spark.read.parquet(str(tmp_path / "c")))
    (choice,) = found
    # The choice moves places and digests; bodies are left behind in the scan's own stage.
    below = choice.split("Exchange")
    assert len(below) > 1 and all("body#" not in line for part in below[:-1] for line in part.splitlines())
    text = plan(result)
    assert not lines(text, "SortAggregate") and not lines(text, "HashAggregate.*body")
    moved = lines(text, "Exchange")
    if few:
        assert not [line for line in moved if "hashpartitioning(" in line]
    else:
        # Nothing is shuffled by place before the sieve.
        assert "_bits" in text and text.index("hashpartitioning(_file") < text.index("BroadcastHashJoin [_word")


def test_sieve_keeps_every_key_and_few_others(spark, monkeypatch):
    keys = spark.range(5000).select((F.col("id") * 7).alias("k"), F.col("id").cast("string").alias("s"))
    rows = spark.range(70_000).select(F.col("id").alias("k"), (F.col("id") / 7).cast("long").cast("string").alias("s"))
    kept = places.sieved(rows, keys, ["k", "s"])
    found = {r.k for r in kept.select("k").collect()}
    assert {7 * i for i in range(5000)} <= found and len(found) < 5000 + 1500
    monkeypatch.setattr(places, "SIEVE_WORDS", 8)
    assert places.sieve(keys, ["k"], places.words_for(10**9)).count() <= 8
    assert {7 * i for i in range(5000)} <= {r.k for r in places.sieved(rows, keys, ["k", "s"]).select("k").collect()}


def test_places_are_those_of_single_files(spark, tmp_path):
    spark.range(10).write.parquet(str(tmp_path / "a"))
    a = spark.read.parquet(str(tmp_path / "a"))
    assert places.has_places(a) and places.has_places(a.filter("id > 2").withColumn("x", F.lit(1)).select("x", "id"))
    assert not any(map(places.has_places, [
        a.union(a), a.join(a.select("id"), "id"), a.distinct(), spark.range(3), a.select(F.explode(F.sequence(F.lit(1), F.lit(2)))), a.limit(2),
    ]))
    assert places.with_places(a.union(a), "twice").select("_file", "_row").distinct().count() == 20


@pytest.mark.parametrize("from_file", [True, False])
def test_newest_snapshots_with_ties(spark, tmp_path, few, from_file):
    headers = ("HTTP/1.1 200 OK", "text/html")
    rows = [(f"http://h/{i % 20}", f"body {i}", *headers, T0 + timedelta(seconds=i % 3)) for i in range(200)]
    rows += [("http://h/none", "b", *headers, None), ("http://h/none", "a", *headers, None), ("http://h/none", "a", *headers, None)]
    pages = spark.createDataFrame(rows, "url string, body string, status_line string, content_type string, fetched_at timestamp_ntz")
    if from_file:
        pages.repartition(4).write.parquet(str(tmp_path / "p"))
        pages = spark.read.parquet(str(tmp_path / "p"))
    urls = [f"http://h/{i}" for i in range(0, 25, 2)] + ["http://h/none"]
    batch = spark.createDataFrame([(i, u, "h") for i, u in enumerate(urls)], "id long, url string, host string")
    got = {r.url: r.body for r in crawl_plan._fetch(batch, pages, few, None).collect()}
    want = {}
    for url, body, _, _, at in rows:
        if url in urls:
            want[url] = max(want.get(url, ()), (at or datetime.min, md5(body.encode()).hexdigest(), body))
    assert got == {url: best[2] for url, best in want.items()}
    only = crawl_plan._fetch(batch, pages, few, 5)
    assert {r.url: r.body for r in only.collect()} == got


def test_large_batch_shuffles_wanted_texts_only(spark, tmp_path, monkeypatch):
    """Batches of any size go as a sieve of one size; the texts that pass it are the ones shuffled."""
    monkeypatch.setattr(places, "FEW_ROWS", -1)
    monkeypatch.setattr(places, "SIEVE_WORDS", 64)
    pages = spark.range(20_000).select(
        F.concat(F.lit("http://p/"), "id").alias("url"), F.repeat(F.lit("text "), 100).alias("html"),
        F.lit("HTTP/1.1 200 OK").alias("status_line"), F.lit("text/html").alias("content_type"),
    )
    pages.write.parquet(str(tmp_path / "pages"))
    stored = spark.read.parquet(str(tmp_path / "pages"))
    batch = stored.limit(40).select(F.monotonically_increasing_id().alias("id"), "url", F.lit("p").alias("host"))
    fetched = crawl_plan._fetch(batch, stored, False, None)
    assert fetched.count() == 40
    passed = places.sieved(stored, batch, ["url"])
    assert 40 <= passed.count() < 400
    text = plan(fetched)
    assert "_bits" in text and not re.search(r"Exchange hashpartitioning\(url", text)
