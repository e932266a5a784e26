"""Crawl state derived from the ``pages`` table, for trials and checks.

The test tables hold pages only; these rules make the queue, the dimensions,
robots bodies and fetch results that a crawl would have.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spindrift.functions.urls import url_parts
from spindrift.operators.dims import DIM_SCHEMA, FIXED_PROTOCOLS, assign_ids
from spindrift.operators.store import URL_KEY
from spindrift.session import cut_lineage
from spindrift.sources.tables import STATE_SCHEMAS, CrawlState, read_pages

BASE = datetime(2024, 1, 1)

ROBOTS = {
    1: "User-agent: *\nDisallow: /en/\nAllow: /en/2\n",
    2: "# whole-line comment\nUser-agent: *\nDisallow: /*.html$\nDisallow:\n",
    3: "User-agent: Bot\nDisallow: /\nUser-agent: *\nDisallow: /de/ # inline comment\n",
}

# How root-relative links are rewritten by their first letter, so that every
# form of link occurs, and several forms on one page.
LINK_FORMS = (
    ("a-d", "../"),
    ("e-h", ""),
    ("i-l", "//cdn.example.net/"),
    ("m-o", "?p="),
    ("p-r", "./"),
    ("s-t", "https://z.example.org/"),
    ("u-v", "mailto:"),
    ("w-z", "w/"),
)


def base_time():
    return F.lit(BASE).cast("timestamp_ntz")


def hosts(pages: DataFrame) -> DataFrame:
    return pages.select(url_parts(F.col("url"))["host"].alias("name")).filter("name is not null").distinct()


def domain_table(pages: DataFrame) -> DataFrame:
    """Hosts whose next visit is an hour before, at, or an hour after the base time."""
    hours = F.make_dt_interval(hours=(F.col("id") % 3 - 1).cast("int"))
    named = assign_ids(hosts(pages), ["name"])
    return cut_lineage(named.select("id", "name", (base_time() + hours).alias("next_visit")))


def protocol_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(FIXED_PROTOCOLS, DIM_SCHEMA)


def queue_table(pages: DataFrame, domain: DataFrame) -> DataFrame:
    """Every page URL, added in an order with ties."""
    offset = F.make_dt_interval(secs=(F.col("page_id") * 7919 % 100).cast("decimal(18,6)"))
    return pages.withColumn("host", url_parts(F.col("url"))["host"]).join(
        domain.select(F.col("name").alias("host"), F.col("id").alias("domain_id")), "host"
    ).select(F.col("page_id").alias("id"), "url", (base_time() + offset).alias("added"), "domain_id")


def url_table(pages: DataFrame, domain: DataFrame, protocols: DataFrame) -> DataFrame:
    parts = pages.select(url_parts(F.col("url")).alias("p")).select(
        F.col("p.host").alias("host"), F.col("p.scheme").alias("scheme"), F.coalesce("p.path", F.lit("/")).alias("path")
    )
    triples = (
        parts.distinct()
        .join(domain.select(F.col("name").alias("host"), F.col("id").alias("domain_id")), "host")
        .join(protocols.select(F.col("name").alias("scheme"), F.col("id").alias("scheme_id")), "scheme")
        .select(*URL_KEY)
    )
    return cut_lineage(assign_ids(triples, URL_KEY).select("id", *URL_KEY))


def robots_table(domain: DataFrame) -> DataFrame:
    body = F.coalesce(*[F.when(F.col("id") % 4 == k, F.lit(v)) for k, v in ROBOTS.items()])
    return domain.filter(F.col("id") % 4 != 0).select(F.col("name").alias("host"), body.alias("body"))


def fetch_table(pages: DataFrame) -> DataFrame:
    """Status, type and body by ``page_id % 10``."""
    kind = F.col("page_id") % 10
    status = (
        F.when(kind == 0, "HTTP/1.1 404 Not Found")
        .when(kind == 1, "HTTP/1.1 301 Moved Permanently")
        .when(kind == 4, "HTTP/1.0 200 OK")
        .otherwise("HTTP/1.1 200 OK")
    )
    content_type = (
        F.when(kind.isin(2, 3), "application/pdf").when(kind == 4, "text/html; charset=utf-8").otherwise("text/html")
    )
    return pages.select(
        "url",
        status.alias("status_line"),
        content_type.alias("content_type"),
        F.when(kind == 3, "").otherwise(F.col("html")).alias("body"),
        (base_time() + F.make_dt_interval(secs=F.col("page_id").cast("decimal(18,6)"))).alias("fetched_at"),
    )


def mixed_pages(pages: DataFrame) -> DataFrame:
    """Pages whose root-relative links are rewritten to all forms of link."""
    html = F.col("html")
    for letters, form in LINK_FORMS:
        html = F.regexp_replace(html, f'href="/([{letters}])', f'href="{form}$1')
    return pages.withColumn("html", html)


def derived_state(spark: SparkSession, directory: str) -> tuple[CrawlState, DataFrame]:
    """The state before a first step, and the pages it comes from."""
    pages = read_pages(spark, directory)
    domain, protocols = domain_table(pages), protocol_table(spark)
    return (
        CrawlState(
            queue=queue_table(pages, domain),
            domain=domain,
            protocols=protocols,
            url=url_table(pages, domain, protocols),
            tried=spark.createDataFrame([], STATE_SCHEMAS["tried"]),
        ),
        pages,
    )
