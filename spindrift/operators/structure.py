"""Broken links and link structure."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spindrift.functions.urls import url_parts
from spindrift.operators.fetches import is_ok
from spindrift.session import cut_lineage

# The causes that are not a status line.
NOT_IN_SNAPSHOT = "not in snapshot"


def fetch_status(fetches: DataFrame) -> DataFrame:
    """Per (host, path): whether any fetch succeeded, and the smallest status line of the others."""
    parts = url_parts(F.col("url"))
    return (
        fetches.select(parts.alias("p"), "status_line")
        .select(
            F.col("p.host").alias("host"),
            F.coalesce("p.path", F.lit("/")).alias("path"),
            "status_line",
            is_ok(F.col("status_line")).alias("ok"),
        )
        .groupBy("host", "path")
        .agg(
            F.bool_or("ok").alias("ok"),
            F.min(F.when(~F.col("ok"), F.coalesce("status_line", F.lit("no status")))).alias("failure"),
        )
    )


def broken_links(links: DataFrame, fetches: DataFrame) -> DataFrame:
    """Links to a page that is not in the snapshot or did not answer with success, and the cause.

    ``links`` are normalized; one row per link.  The join meets one status row
    per target.  These are written first, for the join to have a plain shuffle
    on both sides: only then does Spark split a target that very many links have.
    """
    cause = F.when(F.col("ok").isNull(), NOT_IN_SNAPSHOT).otherwise(F.col("failure"))
    return (
        links.filter("scheme_supported")
        .join(cut_lineage(fetch_status(fetches)), ["host", "path"], "left")
        .filter(~F.coalesce("ok", F.lit(False)))
        .select("page_id", "url", "pos", "href", "host", "path", cause.alias("cause"))
    )


def _with_hosts(links: DataFrame) -> DataFrame:
    return links.withColumn("from_host", url_parts(F.col("url"))["host"]).withColumnRenamed("host", "to_host")


def page_structure(links: DataFrame) -> DataFrame:
    """Per page with links: links out, distinct targets, internal and external links."""
    target = F.struct("to_host", "path")
    internal = F.col("to_host") == F.col("from_host")
    return (
        _with_hosts(links)
        .groupBy("page_id")
        .agg(
            F.count("*").alias("links_out"),
            F.count_distinct(target).alias("targets"),
            F.count_if(internal).alias("internal"),
            F.count_if(~internal).alias("external"),
        )
    )


def host_edges(links: DataFrame) -> DataFrame:
    """Number of links from host to host."""
    return _with_hosts(links).groupBy("from_host", "to_host").agg(F.count("*").alias("links"))


def host_structure(pages: DataFrame, links: DataFrame) -> DataFrame:
    """Per host: pages in the snapshot, links out and links in.

    Every input is counted by host before anything is combined.
    """
    edges = host_edges(links)
    zero = F.lit(0).cast("bigint")

    def counted(df: DataFrame, host: str, name: str, value) -> DataFrame:
        counts = {c: zero for c in ("pages", "links_out", "links_in")} | {name: value}
        return df.select(F.col(host).alias("host"), *[v.cast("bigint").alias(c) for c, v in counts.items()])

    by_page = pages.select(url_parts(F.col("url"))["host"].alias("host")).groupBy("host").agg(F.count("*").alias("n"))
    rows = (
        counted(by_page, "host", "pages", F.col("n"))
        .unionByName(counted(edges, "from_host", "links_out", F.col("links")))
        .unionByName(counted(edges, "to_host", "links_in", F.col("links")))
    )
    return rows.groupBy("host").agg(*[F.sum(c).alias(c) for c in ("pages", "links_out", "links_in")])
