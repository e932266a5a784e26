"""Counts, the link list, and its pages."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spindrift.functions.urls import page_url
from spindrift.session import run_dir

PAGE_SIZE = 10

# Rows up to a page that may be kept by every task.
NEAR_ROWS = 10_000

# How far from a page, as a share of all rows, the values may lie that bound it.
MARGIN = 0.001

# Numbers that rise over partitions count rows in their low bits.
RANGE_BITS = 33


def crawl_report(url: DataFrame, domain: DataFrame, queue: DataFrame) -> DataFrame:
    """One row with the number of links, domains and queued URLs."""
    tables = {"links": url, "domains": domain, "queued": queue}
    counts = reduce(
        DataFrame.unionByName,
        [df.agg(F.count("*").alias("n")).withColumn("what", F.lit(name)) for name, df in tables.items()],
    )
    return counts.agg(*[F.max(F.when(F.col("what") == name, F.col("n"))).alias(name) for name in tables])


def page_summary(url: DataFrame, page_size: int = PAGE_SIZE) -> DataFrame:
    """Number of rows and of pages they fill."""
    total = F.count("*")
    return url.agg(total.alias("total"), F.ceil(total / page_size).alias("pages"))


def link_list(url: DataFrame, domain: DataFrame, protocols: DataFrame) -> DataFrame:
    """Every stored link with its scheme and host: ``id, http, host, url, link``."""
    return (
        url.join(domain.select(F.col("id").alias("domain_id"), F.col("name").alias("host")), "domain_id")
        .join(protocols.select(F.col("id").alias("scheme_id"), F.col("name").alias("http")), "scheme_id")
        .select("id", "http", "host", F.col("path").alias("url"))
        .withColumn("link", page_url(F.col("http"), F.col("host"), F.col("url")))
    )


def page_of(df: DataFrame, page: int | None = 1, page_size: int = PAGE_SIZE, order: str = "id") -> DataFrame:
    """The rows of one page; page 0 or none is the first.

    Near the top a task keeps no more rows than lie up to the page.  A deep page
    is closed in on: quantiles of the order column bound the values on it, the
    rows before them are counted, and only rows within are sorted.  A table kept
    with ``sources.orderindex`` has an index instead.
    """
    start = (max(page or 1, 1) - 1) * page_size
    if start <= NEAR_ROWS:
        return df.orderBy(order).offset(start).limit(page_size)
    kind = df.schema[order].dataType
    if not isinstance(kind, T.NumericType | T.DateType | T.TimestampType | T.TimestampNTZType):
        return in_order(df, order).filter((F.col("_place") >= start) & (F.col("_place") < start + page_size)).drop("_place").orderBy(order)
    # Quantiles know of no missing values, which come first.
    nulls = df.filter(F.col(order).isNull())
    missing = nulls.count()
    if start < missing:
        return df.orderBy(order).offset(start).limit(page_size)
    rows, start = df.filter(F.col(order).isNotNull()), start - missing
    while (n := rows.count()) > max(NEAR_ROWS, 2 * page_size) and start < n:
        wanted = [max(0.0, (start - 1) / n - MARGIN), min(1.0, (start + page_size + 1) / n + MARGIN)]
        low, high = rows.select(F.percentile_approx(order, wanted, round(4 / MARGIN))).first()[0]
        inside = (F.col(order) >= F.lit(low)) & (F.col(order) <= F.lit(high))
        before, kept = rows.agg(F.count_if(F.col(order) < F.lit(low)), F.count_if(inside)).first()
        if before > start or before + kept < min(n, start + page_size) or kept == n:
            break  # the quantiles were too rough, or all rows are equal
        rows, start = rows.filter(inside), start - before
    return rows.orderBy(order).offset(start).limit(page_size)


def page_index(
    df: DataFrame, page_size: int = PAGE_SIZE, order: str = "id"
) -> DataFrame:
    """Add ``page``, the page that each row falls on; ``order`` is a unique column."""
    return in_order(df, order).withColumn("page", F.floor(F.col("_place") / page_size) + 1).drop("_place")


def in_order(df: DataFrame, order: str) -> DataFrame:
    """The rows with ``_place``, their place in the order from 0.

    Rows are dealt by ranges and sorted once, and written with the numbers that
    they then have in their range: no second shuffle, and no window.  A range is
    shifted by the rows of the ranges before it, one number for each.
    """
    spark, path = df.sparkSession, run_dir(df.sparkSession, "in-order")
    laid = df.repartitionByRange(order).sortWithinPartitions(order).withColumn("_number", F.monotonically_increasing_id())
    laid.write.parquet(path)
    stored = spark.read.schema(laid.schema).parquet(path)
    spans = stored.withColumn("_range", F.shiftright("_number", RANGE_BITS))
    sizes = spans.groupBy("_range").count().orderBy("_range").collect()  # a row for each range
    offsets, before = [], 0
    for row in sizes:
        offsets.append((row["_range"], before - (row["_range"] << RANGE_BITS)))
        before += row["count"]
    shift = spark.createDataFrame(offsets, "_range long, _shift long")
    return (
        spans.join(F.broadcast(shift), "_range")
        .withColumn("_place", F.col("_number") + F.col("_shift"))
        .select(*df.columns, "_place")
    )
