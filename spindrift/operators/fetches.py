"""Fetch outcomes and stored content."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spindrift.functions.urls import content_key, url_parts
from spindrift.operators.places import PLACE, at_places, with_places
from spindrift.session import cut_lineage

# The status lines that count as success, and the page type.
OK_STATUS = ("HTTP/1.1 200 OK", "HTTP/1.0 200 OK")
HTML_TYPE = "text/html"


def is_ok(status_line: Column) -> Column:
    return F.coalesce(status_line.isin(*OK_STATUS), F.lit(False))


def fetch_outcome(body: Column | None = None) -> Column:
    """``html``, ``other``, ``empty`` or ``skipped`` by status line, content type and body."""
    body = F.col("body") if body is None else body
    html = F.contains(F.lower("content_type"), F.lit(HTML_TYPE))
    return (
        F.when(~is_ok(F.col("status_line")), "skipped")
        .when(html, "html")
        .when(F.coalesce(F.length(body), F.lit(0)) == 0, "empty")
        .otherwise("other")
    )


def classify_fetch(fetches: DataFrame) -> DataFrame:
    return fetches.withColumn("outcome", fetch_outcome())


def content_store(fetched: DataFrame) -> DataFrame:
    """The newest body per content key; ties go to the largest URL, then the largest body hash.

    ``fetched`` holds ``domain_id, url, body, fetched_at, outcome``.
    """
    keyed = (
        fetched.filter(F.col("outcome").isin("html", "other"))
        .withColumn("_parts", url_parts(F.col("url")))
        .withColumn("content_key", content_key(F.col("_parts"), F.col("outcome") == "html"))
    )
    return newest_content(keyed)


def narrow_order(*columns: str) -> Column:
    """The order of rows by some columns, then by ``_md5`` and place.

    Spark puts a projection's expression into the aggregate above it where it is
    used once, and would then sort rows with their texts; used twice, it stays.
    """
    return F.struct(*columns, "_md5", F.col("_md5").alias("_same"), *PLACE)


def newest_content(keyed: DataFrame) -> DataFrame:
    """One body per (domain, key).

    The row is chosen without its body, and tasks keep one row per key before
    the shuffle, so many copies of one page stay cheap.  Only chosen bodies move.
    """
    columns = ["domain_id", "content_key", "url", "body", "fetched_at"]
    placed = [c for c in PLACE if c in keyed.columns]
    rows = with_places(keyed.select(*columns, *placed), "keyed-bodies")
    narrow = rows.select("domain_id", "content_key", "fetched_at", "url", F.md5("body").alias("_md5"), *PLACE)
    newest = narrow.groupBy("domain_id", "content_key").agg(F.max(narrow_order("fetched_at", "url")).alias("row"))
    chosen = cut_lineage(newest.select(*[F.col(f"row.{c}").alias(c) for c in PLACE]))
    return at_places(rows, chosen).select(*columns)
