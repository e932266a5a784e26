"""What the plans look like: pruned scans, hot keys split, one pass over texts.  (That none pairs rows without a key is part of test_oracle.)"""

import re

import pytest
from compare import plans_cut
from pyspark.sql import functions as F

from spindrift.operators import dims, frontier, links, robots, search, structure
from spindrift.plans import catalog
from spindrift.sources import tables

DIRECTORY = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_url_queries_do_not_read_page_texts(spark):
    for name in ("url_parts", "robots_blocked", "frontier", "due"):
        text = plan(catalog.QUERIES[name](spark, DIRECTORY))
        assert "FileScan parquet" in text
        assert not re.search(r"ReadSchema: struct<[^>]*html", text)


def test_links_are_taken_from_texts_once(spark):
    text = plan(catalog.QUERIES["links_per_host"](spark, DIRECTORY))
    initial = text.split("Initial Plan")[-1]
    assert initial.count("posexplode") == 1 and initial.count("FileScan") == 1
    # A filter on the scheme needs the scheme of the link only, not the whole resolution.
    kept = links.page_links(tables.read_pages(spark, DIRECTORY)).filter("scheme_supported")
    filters = [line for line in plan(kept).splitlines() if re.match(r"[\s+\-:*()\d]*Filter", line)]
    assert all("aggregate(" not in line for line in filters)


def test_oldest_per_domain_is_reduced_before_the_shuffle(spark):
    queue = spark.range(1000).selectExpr(
        "id", "concat('u', id) as url", "timestamp_ntz'2024-01-01' as added", "id % 30 as domain_id"
    )
    assert "partial_min_by" in plan(frontier.first_per_domain(queue))
    assert "TakeOrderedAndProject" in plan(frontier.frontier(queue))


def test_stored_index_is_read_by_bucket(spark, tmp_path):
    documents = spark.createDataFrame([(1, "a b b"), (2, "b c"), (3, "A, d!")], "doc_id bigint, text string")
    n_docs = documents.agg(F.count("*").alias("n"))
    search.write_index(search.postings(documents), str(tmp_path / "index"), 8)
    stored = spark.read.parquet(str(tmp_path / "index"))
    fresh = search.search(search.postings(documents), n_docs, ["a", "B"], 2)
    kept = search.search(stored, n_docs, ["a", "B"], 2)
    assert fresh.collect() == kept.collect()
    assert [r.doc_id for r in fresh.collect()] == [1, 2]


def test_index_takes_one_exchange(spark, tmp_path):
    """From texts to the stored segment, terms are shuffled once; repeated rows of a document are counted together."""
    rows = [(1, "a b b"), (2, "b c"), (3, "A, d!"), (3, "a e"), (4, None), (None, "b")]
    path, merged = str(tmp_path / "index"), str(tmp_path / "merged")
    spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3).write.parquet(str(tmp_path / "d"))
    documents = spark.read.parquet(str(tmp_path / "d"))
    with plans_cut() as found:
        search.index_documents(documents.filter("doc_id IS NULL OR doc_id < 3"), path, 8, 0)
        search.index_documents(documents.filter("doc_id >= 3"), path, 8, 1)
        search.index_documents(documents.filter("doc_id >= 3"), path, 8, 1)
    assert all(text.count("Exchange hashpartitioning") == 1 for text in found) and len(found) == 3
    search.merge_segments(spark, path, merged)
    want = sorted(map(tuple, search.postings(documents).collect()), key=str)
    for place in (path, merged):
        stored = spark.read.parquet(place)
        assert sorted(map(tuple, stored.select("term", "doc_id", "tf").collect()), key=str) == want
        n_docs = documents.agg(F.count("*").alias("n"))
        assert search.search(stored, n_docs, ["a", "B"], 2).collect() == search.search(search.postings(documents), n_docs, ["a", "B"], 2).collect()


def test_what_a_task_counts_does_not_grow_with_the_texts(spark, tmp_path, monkeypatch):
    """Larger texts take more tasks to deal out and to count their terms; rows of one document still meet."""
    monkeypatch.setattr(search, "DEALT_BYTES", 8000, raising=False)
    monkeypatch.setattr(search, "COUNTED_BYTES", 500, raising=False)
    words = F.array_join(F.transform(F.sequence(F.lit(0), F.lit(29)), lambda i: F.concat(F.lit("w"), (F.col("id") * 7 + i) % 61)), " ")
    texts = spark.range(0, 1200, 1, 12).select(F.when(F.col("id") > 0, F.col("id") % 1000).alias("doc_id"), words.alias("text"))
    texts.write.parquet(str(tmp_path / "d"))
    documents = spark.read.parquet(str(tmp_path / "d"))
    size = documents.agg(F.sum(F.octet_length("text"))).first()[0]
    with plans_cut() as found:
        search.index_documents(documents, str(tmp_path / "index"), 2)
    [text] = found
    assert text.count("Exchange hashpartitioning") == 1
    assert int(re.search(r"RoundRobinPartitioning\((\d+)\)", text)[1]) >= size / 8000
    assert int(re.search(r"hashpartitioning\(bucket#\d+, share#\w+, (\d+)\)", text)[1]) >= size / 500
    stored = spark.read.parquet(str(tmp_path / "index"))
    want = sorted(map(tuple, search.postings(documents).collect()), key=str)
    assert sorted(map(tuple, stored.select("term", "doc_id", "tf").collect()), key=str) == want
    # Two buckets over eight shares would leave at least a sixteenth of all rows in one file.
    most = stored.groupBy(F.input_file_name()).count().agg(F.max("count")).first()[0]
    assert most < len(want) / 16


def test_an_index_of_no_texts_is_empty(spark, tmp_path):
    nothing = spark.createDataFrame([(1, None), (None, "")], "doc_id bigint, text string")
    documents = spark.createDataFrame([(2, "a")], "doc_id bigint, text string")
    for segment, rows in enumerate((nothing, nothing.limit(0), documents)):
        search.index_documents(rows, str(tmp_path / "index"), 4, segment)
    stored = spark.read.parquet(str(tmp_path / "index"))
    assert [tuple(r) for r in stored.select("term", "doc_id", "tf").collect()] == [("a", 2, 1)]


def test_pages_are_read_by_bucket(spark, tmp_path):
    """A step reads only the folders of a bucketed snapshot that its batch falls in."""
    from spindrift.plans.crawl import _fetch

    tables.write_pages(tables.read_pages(spark, DIRECTORY), str(tmp_path / "pages"), 16)
    pages = spark.read.parquet(str(tmp_path / "pages"))
    batch = pages.orderBy("url").limit(1).select(F.lit(1).alias("id"), "url", F.lit("h").alias("host"))
    fetched = _fetch(batch, pages, True, 1)
    assert fetched.count() == 1
    assert re.search(r"PushedFilters: \[[^\]]*EqualTo\(url,http", plan(fetched))
    assert re.search(r"PartitionFilters: \[[^\]]*\(bucket#\d+ = \d+\)", plan(fetched))


@pytest.fixture
def small_skew_limits(spark):
    settings = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "64KB",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "64KB",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
        "spark.sql.files.maxPartitionBytes": "256KB",
    }
    before = {key: spark.conf.get(key, None) for key in settings}
    for key, value in settings.items():
        spark.conf.set(key, value) if value is not None else spark.conf.unset(key)
    yield
    for key, value in before.items():
        spark.conf.set(key, value) if value is not None else spark.conf.unset(key)


def hot_links(spark, path):
    """Links of which every third goes to one page of one host."""
    host = F.when(F.col("id") % 3 == 0, F.lit("hot.example")).otherwise(
        F.concat(F.lit("h"), F.col("id") % 997, F.lit(".example"))
    )
    rows = spark.range(0, 60_000, 1, 12).select(
        F.col("id").alias("page_id"),
        F.concat(F.lit("http://from.example/"), F.md5(F.col("id").cast("string"))).alias("url"),
        F.lit(0).alias("pos"),
        F.lit("x").alias("href"),
        host.alias("host"),
        F.lit("/").alias("path"),
        F.lit(True).alias("scheme_supported"),
    )
    rows.write.parquet(path)
    return spark.read.parquet(path)


def test_hot_host_is_split(spark, small_skew_limits, tmp_path):
    found = hot_links(spark, str(tmp_path / "links"))
    names = found.select(F.col("host").alias("name")).distinct()
    domain = dims.upsert_domain(tables.empty_state(spark).domain, names, F.lit("2024-01-01").cast("timestamp_ntz"))
    joined = dims.with_dim_id(found, domain, "host", "domain_id")
    assert joined.select(F.count("domain_id")).first()[0] == 60_000
    joined.write.format("noop").mode("overwrite").save()
    rows = joined.collect()
    assert len(rows) == 60_000 and "skew=true" in plan(joined)

    fetches = names.select(F.concat(F.lit("http://"), "name", F.lit("/")).alias("url"), F.lit("no").alias("status_line"))
    broken = structure.broken_links(found, fetches)
    assert len(broken.collect()) == 60_000 and "skew=true" in plan(broken)

    bodies = names.select(F.col("name").alias("host"), F.lit("User-agent: *\nDisallow: /").alias("body"))
    urls = found.select(F.concat(F.lit("http://"), "host", "path", F.lit("?"), F.md5("url")).alias("url"))
    judged = robots.robots_blocked(urls, robots.parse_robots(bodies))
    assert sum(r.blocked for r in judged.collect()) == 60_000 and "skew=true" in plan(judged)
