"""The registered queries: each operator on whole tables, or on state derived from them."""

from __future__ import annotations

from collections.abc import Callable
from datetime import timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spindrift.functions.robots import robots_target
from spindrift.functions.urls import content_key, url_parts
from spindrift.operators import dims, fetches, frontier, links, report, robots, search, store, structure
from spindrift.operators.throttle import throttle
from spindrift.plans import derived
from spindrift.plans.crawl import crawl, crawl_step
from spindrift.session import cut_lineage, run_dir
from spindrift.sources import orderindex, tables
from spindrift.streaming.links import run_merge, stream_links
from spindrift.streaming.run import run_available
from spindrift.streaming.throttle import stream_throttle

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}

THROTTLE_DELAY = 6 * 3600
SEARCH_TERMS = ("the", "thand", "nicht", "para", "eau")
RULE_COLUMNS = ("host", "agent", "pos", "pattern", "regex", "rule_len", "allow")


def query(run: Query) -> Query:
    """Register a query under its function's name, less the ending that sets it apart from an operator."""
    QUERIES[run.__name__.removesuffix("_query")] = run
    return run


# Inputs that several queries share.


def pages_of(spark: SparkSession, directory: str) -> DataFrame:
    return tables.read_pages(spark, directory)


def mixed_links(spark: SparkSession, directory: str) -> DataFrame:
    """Normalized links of the pages with all forms of link."""
    return links.page_links(derived.mixed_pages(pages_of(spark, directory)))


def table(spark: SparkSession, directory: str, name: str) -> DataFrame:
    return spark.read.parquet(tables.table_path(directory, name))


def https_state(spark: SparkSession, directory: str):
    """The derived state with only the domains, links and queue rows of https pages known so far."""
    pages = pages_of(spark, directory).filter(F.startswith("url", F.lit("https:")))
    domain = derived.domain_table(pages)
    protocols = derived.protocol_table(spark)
    return tables.CrawlState(
        queue=derived.queue_table(pages, domain),
        domain=domain,
        protocols=protocols,
        url=derived.url_table(pages, domain, protocols),
        tried=spark.createDataFrame([], tables.STATE_SCHEMAS["tried"]),
    )


def link_targets(spark: SparkSession, directory: str) -> tuple[tables.CrawlState, DataFrame]:
    """The https state with domains grown by all link hosts, and the links with their ids."""
    state = https_state(spark, directory)
    found = cut_lineage(mixed_links(spark, directory).filter("scheme_supported"))
    domain = dims.upsert_domain(
        state.domain, found.select(F.col("host").alias("name")), derived.base_time()
    )
    named = dims.with_dim_id(found, domain, "host", "domain_id")
    return state.with_tables(domain=domain), dims.with_dim_id(named, state.protocols, "scheme", "scheme_id")


def rules_of(spark: SparkSession, directory: str) -> DataFrame:
    domain = derived.domain_table(pages_of(spark, directory))
    return robots.parse_robots(derived.robots_table(domain))


def fetches_of(spark: SparkSession, directory: str) -> DataFrame:
    return derived.fetch_table(pages_of(spark, directory))


def fetched_twice(spark: SparkSession, directory: str) -> DataFrame:
    """Classified fetches with their domain, each followed by a later one with another body."""
    first = fetches_of(spark, directory)
    again = first.withColumn("body", F.concat("body", F.lit(" again"))).withColumn(
        "fetched_at", F.col("fetched_at") + frontier.seconds(3600)
    )
    both = fetches.classify_fetch(first.unionByName(again)).withColumn("host", url_parts(F.col("url"))["host"])
    return dims.with_dim_id(both, derived.domain_table(pages_of(spark, directory)), "host", "domain_id")


# Sources and URL expressions.


@query
def links_per_host(spark, directory):
    found = links.page_links(pages_of(spark, directory))
    return found.groupBy("host").agg(F.count("*").alias("links"), F.count_distinct("path").alias("paths"))


@query
def read_pages(spark, directory):
    return pages_of(spark, directory)


@query
def url_parts_query(spark, directory):
    return pages_of(spark, directory).select("page_id", url_parts(F.col("url")).alias("p")).select("page_id", "p.*")


@query
def content_key_query(spark, directory):
    html = F.contains(F.lower("content_type"), F.lit(fetches.HTML_TYPE))
    return fetches_of(spark, directory).select(
        "url", content_key(url_parts(F.col("url")), html).alias("content_key")
    )


@query
def robots_target_query(spark, directory):
    return pages_of(spark, directory).select("page_id", robots_target(F.col("url")).alias("target"))


# Links.


@query
def extract_links(spark, directory):
    return links.extract_links(pages_of(spark, directory))


@query
def resolve_links(spark, directory):
    return links.resolve_links(links.extract_links(pages_of(spark, directory)))


@query
def resolve_links_mixed(spark, directory):
    return links.resolve_links(links.extract_links(derived.mixed_pages(pages_of(spark, directory))))


@query
def resolve_links_legacy(spark, directory):
    mixed = links.extract_links(derived.mixed_pages(pages_of(spark, directory)))
    return links.resolve_links(mixed, mode="legacy")


@query
def normalize_links(spark, directory):
    return mixed_links(spark, directory)


# Dimensions and stored links.


@query
def assign_ids(spark, directory):
    found = links.page_links(pages_of(spark, directory))
    return dims.assign_ids(found.select("host", "path").distinct(), ["host", "path"], start=101)


@query
def upsert_domain(spark, directory):
    return link_targets(spark, directory)[0].domain


@query
def upsert_protocol(spark, directory):
    schemes = mixed_links(spark, directory).select(F.col("scheme").alias("name"))
    return dims.upsert_protocols(derived.protocol_table(spark), schemes)


@query
def insert_urls(spark, directory):
    state, targets = link_targets(spark, directory)
    return store.insert_urls(state.url, targets)


@query
def url_ids(spark, directory):
    state, targets = link_targets(spark, directory)
    found = dims.url_ids(targets, state.url)
    return found.select("page_id", "pos", "resolved", "url_id")


@query
def content_type_ids(spark, directory):
    values = fetches_of(spark, directory).select(F.col("content_type").alias("value"))
    return dims.content_type_ids(content_types(spark), values)[1]


@query
def content_type_table(spark, directory):
    values = fetches_of(spark, directory).select(F.col("content_type").alias("value"))
    return dims.content_type_ids(content_types(spark), values)[0]


def content_types(spark: SparkSession) -> DataFrame:
    rows = [(1, "text/html; charset=utf-8"), (2, "text/plain"), (3, "text/html")]
    return spark.createDataFrame(rows, "id bigint, value string")


@query
def match_domains(spark, directory):
    hosts = mixed_links(spark, directory).select("host")
    return dims.match_domains(hosts, derived.domain_table(pages_of(spark, directory)))


@query
def match_domains_pattern(spark, directory):
    domain = derived.domain_table(pages_of(spark, directory))
    name = F.col("name")
    forms = F.array(
        name, F.replace(name, F.lit("."), F.lit("_")), F.regexp_replace(name, r"^[^.]*", "%")
    )
    return dims.match_domains(domain.select(F.explode(forms).alias("host")), domain, pattern=True)


# Queue.


@query
def enqueue(spark, directory):
    state, targets = link_targets(spark, directory)
    wanted = targets.select(F.col("resolved").alias("url"), "domain_id")
    return frontier.enqueue(state.queue, wanted, derived.base_time())


@query
def add_seeds(spark, directory):
    state = https_state(spark, directory)
    return frontier.add_seeds(
        state.queue, state.domain, pages_of(spark, directory).select("url"), derived.base_time()
    )[0]


@query
def dequeue(spark, directory):
    state, _ = derived.derived_state(spark, directory)
    judged = robots.robots_blocked(state.queue, rules_of(spark, directory))
    return frontier.dequeue(state.queue, judged.filter("blocked").select("id"))


@query
def split_valid(spark, directory):
    """Link values taken as URLs: only absolute ones have a host."""
    raw = mixed_links(spark, directory).select("page_id", "pos", F.col("href").alias("url"))
    valid, invalid = frontier.split_valid(raw)
    return valid.withColumn("valid", F.lit(True)).unionByName(invalid.withColumn("valid", F.lit(False)))


@query
def first_per_domain(spark, directory):
    return frontier.first_per_domain(derived.derived_state(spark, directory)[0].queue)


@query
def frontier_query(spark, directory):
    return frontier.frontier(derived.derived_state(spark, directory)[0].queue)


@query
def frontier_due_first(spark, directory):
    state, _ = derived.derived_state(spark, directory)
    return frontier.frontier(state.queue, 10, True, state.domain, derived.base_time())


@query
def due(spark, directory):
    state, _ = derived.derived_state(spark, directory)
    valid, _ = frontier.split_valid(state.queue)
    return frontier.due(valid, state.domain, derived.base_time())


@query
def update_next_visit(spark, directory):
    """Every domain with a successful fetch is visited again in five seconds."""
    domain = derived.domain_table(pages_of(spark, directory))
    hosts = fetched_twice(spark, directory).filter(F.col("outcome").isin("html", "other")).select("host")
    return frontier.update_next_visit(domain, hosts, derived.base_time())


# Robots.


@query
def parse_robots(spark, directory):
    """Rules of bodies that were written as a table and read back."""
    stored = run_dir(spark, "robots")
    domain = derived.domain_table(pages_of(spark, directory))
    derived.robots_table(domain).write.parquet(tables.table_path(stored, "robots"))
    return robots.parse_robots(tables.read_robots(spark, stored))


@query
def robots_blocked(spark, directory):
    urls = pages_of(spark, directory).select("page_id", "url")
    return robots.robots_blocked(urls, rules_of(spark, directory))


@query
def robots_agent_fallback(spark, directory):
    urls = pages_of(spark, directory).select("page_id", "url")
    rules = rules_of(spark, directory)
    by_agent = [
        robots.robots_blocked(urls, rules, agent).withColumn("agent", F.lit(agent)) for agent in ("Bot", "Other")
    ]
    return by_agent[0].unionByName(by_agent[1])


@query
def robots_blocked_links(spark, directory):
    """Every link of every page judged by its host's rules."""
    found = links.page_links(pages_of(spark, directory))
    urls = found.select("page_id", "pos", F.col("resolved").alias("url"))
    return robots.robots_blocked(urls, rules_of(spark, directory))


# Fetches and content.


@query
def classify_fetch(spark, directory):
    return fetches.classify_fetch(fetches_of(spark, directory)).select("url", "outcome")


@query
def content_store(spark, directory):
    return fetches.content_store(fetched_twice(spark, directory))


@query
def content_sink(spark, directory):
    """Content written by domain bucket and read back."""
    path = run_dir(spark, "content")
    tables.write_content(fetches.content_store(fetched_twice(spark, directory)), path, buckets=16)
    return spark.read.parquet(path).select("domain_id", "content_key", "url", F.md5("body").alias("body_md5"), "bucket")


# Reports.


@query
def link_list(spark, directory):
    state, _ = derived.derived_state(spark, directory)
    return report.link_list(state.url, state.domain, state.protocols)


@query
def crawl_report(spark, directory):
    """Counts of a state that was written and read back."""
    state, _ = derived.derived_state(spark, directory)
    stored = tables.write_state(state, run_dir(spark, "state"))
    return report.crawl_report(stored.url, stored.domain, stored.queue)


@query
def page_summary(spark, directory):
    return report.page_summary(derived.derived_state(spark, directory)[0].url)


@query
def page_of(spark, directory):
    return report.page_of(link_list(spark, directory), page=3)


@query
def page_of_stored(spark, directory):
    """The last row's page of a link list that was written in order in two parts."""
    listed, path = cut_lineage(link_list(spark, directory)), run_dir(spark, "ordered")
    half = listed.count() // 2
    orderindex.write_ordered(listed.filter(F.col("id") <= half), path, rows_per_file=100)
    orderindex.append_ordered(listed.filter(F.col("id") > half), path, rows_per_file=100)
    last = report.page_summary(listed).first().pages
    return orderindex.rows_at(spark, path, (last - 1) * report.PAGE_SIZE, report.PAGE_SIZE)


@query
def page_index(spark, directory):
    return report.page_index(link_list(spark, directory))


# Crawl steps.


def mixed_fetches(spark: SparkSession, directory: str) -> DataFrame:
    return derived.fetch_table(derived.mixed_pages(pages_of(spark, directory)))


def step_of(spark: SparkSession, directory: str):
    state, _ = derived.derived_state(spark, directory)
    return crawl_step(
        state, mixed_fetches(spark, directory), rules_of(spark, directory), derived.BASE, n=None
    )


@query
def crawl_step_outcomes(spark, directory):
    return step_of(spark, directory).outcomes


@query
def crawl_step_queue(spark, directory):
    return step_of(spark, directory).state.queue


@query
def crawl_step_domain(spark, directory):
    return step_of(spark, directory).state.domain


@query
def crawl_step_urls(spark, directory):
    return step_of(spark, directory).state.url


@query
def crawl_step_content(spark, directory):
    return fetches.content_store(step_of(spark, directory).fetched)


@query
def stored_pages_step(spark, directory):
    """A step over pages that were laid out by bucket and read back."""
    path = run_dir(spark, "pages")
    tables.write_pages(mixed_fetches(spark, directory), path, buckets=32)
    state, _ = derived.derived_state(spark, directory)
    stored = spark.read.parquet(path)
    return crawl_step(state, stored, rules_of(spark, directory), derived.BASE, n=None).outcomes


@query
def crawl_rounds(spark, directory):
    """Outcomes of three rounds that never try a URL twice."""
    state, _ = derived.derived_state(spark, directory)
    return crawl(
        state, mixed_fetches(spark, directory), rules_of(spark, directory), derived.BASE,
        rounds=3, n=None, skip_known=True,
    )[1]


# Time and streams.


@query
def throttle_query(spark, directory):
    return throttle(table(spark, directory, "events"), "user_id", "ts", "event_id", THROTTLE_DELAY)


@query
def throttle_hot_keys(spark, directory):
    """The same with every key solved as a hot one."""
    return throttle(table(spark, directory, "events"), "user_id", "ts", "event_id", THROTTLE_DELAY, hot_rows=0)


@query
def stream_links_query(spark, directory):
    arriving = tables.stream_pages(spark, directory, "pages.parquet")
    return run_available(stream_links(arriving), "stream-links")


def arriving_fetches(spark: SparkSession, directory: str) -> DataFrame:
    """Fetches with their headers, written as files and read as a stream."""
    path = run_dir(spark, "fetches")
    found = fetches_of(spark, directory).withColumnRenamed("body", "html")
    found.withColumn("page_id", F.xxhash64("url")).write.parquet(path)
    return tables.stream_pages(spark, path, "*.parquet")


@query
def stream_links_answered(spark, directory):
    """Links of successful fetches that robots rules allow."""
    arriving = arriving_fetches(spark, directory)
    return run_available(stream_links(arriving, rules=rules_of(spark, directory)), "stream-answered")


@query
def stream_merge_answered(spark, directory):
    """The queue after merging those links."""
    return run_merge(
        arriving_fetches(spark, directory), https_state(spark, directory), run_dir(spark, "merge-answered"),
        lambda batch: derived.BASE + timedelta(seconds=15 * batch), rules_of(spark, directory),
    ).queue


def merged_state(spark: SparkSession, directory: str) -> tables.CrawlState:
    arriving = tables.stream_pages(spark, directory, "pages.parquet")
    return run_merge(
        arriving, https_state(spark, directory), run_dir(spark, "stream-merge"),
        lambda batch: derived.BASE + timedelta(seconds=15 * batch),
    )


@query
def stream_merge_queue(spark, directory):
    return merged_state(spark, directory).queue


@query
def stream_merge_urls(spark, directory):
    return merged_state(spark, directory).url


@query
def stream_throttle_query(spark, directory):
    events = (
        spark.readStream.schema(table(spark, directory, "events").schema)
        .option("pathGlobFilter", "events.parquet")
        .parquet(directory)
    )
    return run_available(
        stream_throttle(events, "user_id", "ts", "event_id", THROTTLE_DELAY), "stream-throttle"
    )


# Link structure and search.


@query
def broken_links(spark, directory):
    return structure.broken_links(mixed_links(spark, directory), fetches_of(spark, directory))


@query
def link_structure_page(spark, directory):
    return structure.page_structure(mixed_links(spark, directory))


@query
def link_structure_host(spark, directory):
    return structure.host_structure(pages_of(spark, directory), mixed_links(spark, directory))


@query
def host_edges(spark, directory):
    return structure.host_edges(mixed_links(spark, directory))


@query
def inverted_index(spark, directory):
    return search.postings(table(spark, directory, "documents"))


@query
def term_frequency(spark, directory):
    return search.term_stats(search.postings(table(spark, directory, "documents")))


@query
def search_query(spark, directory):
    documents = table(spark, directory, "documents")
    n_docs = documents.agg(F.count("*").alias("n"))
    return search.search(search.postings(documents), n_docs, SEARCH_TERMS)


@query
def stored_search(spark, directory):
    """The same search in an index that was written by bucket in two segments, merged, and read back."""
    documents = table(spark, directory, "documents")
    path, merged = run_dir(spark, "index"), run_dir(spark, "merged-index")
    for segment in (0, 1):
        search.index_documents(documents.filter(F.pmod("doc_id", F.lit(2)) == segment), path, 32, segment)
    search.merge_segments(spark, path, merged)
    n_docs = documents.agg(F.count("*").alias("n"))
    return search.search(spark.read.parquet(merged), n_docs, SEARCH_TERMS)
