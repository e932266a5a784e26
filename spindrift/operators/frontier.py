"""The URL queue: enqueue, dequeue, choice of a polite batch, next visits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spindrift.functions.urls import url_host
from spindrift.operators.dims import absent, assign_ids, near, next_id, upsert_domain, with_dim_id


def seconds(n: float) -> Column:
    return F.make_dt_interval(secs=F.lit(n))


def split_valid(queue: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Queue rows whose URL has a host, and those without; ``host`` is added to both."""
    hosted = queue.withColumn("host", url_host(F.col("url")))
    return hosted.filter(F.col("host").isNotNull()), hosted.filter(F.col("host").isNull())


def first_per_domain(queue: DataFrame) -> DataFrame:
    """The oldest queue row of each domain, ties by id.

    Each task reduces its rows to one per domain before the shuffle, so a domain
    with a third of the queue costs no more than any other.
    """
    oldest = F.min_by(F.struct(*queue.columns), F.struct("added", "id"))
    return queue.groupBy("domain_id").agg(oldest.alias("row")).select("row.*")


def due(batch: DataFrame, domain: DataFrame, now: Column, few: bool = False) -> DataFrame:
    """Rows whose host's next visit lies strictly before ``now``; ``batch`` holds ``host``."""
    open_now = domain.filter(F.col("next_visit") < now).select(F.col("name").alias("host"))
    if few:
        open_now = F.broadcast(near(open_now, batch, ["host"]))
    return batch.join(open_now, "host", "left_semi")


def frontier(
    queue: DataFrame,
    n: int | None = 10,
    due_first: bool = False,
    domain: DataFrame | None = None,
    now: Column | None = None,
) -> DataFrame:
    """One URL per domain, the ``n`` oldest of them; all of them without ``n``.

    A domain that is not due uses a place, unless ``due_first`` drops it before.
    """
    heads = first_per_domain(queue)
    if due_first:
        heads = due(heads.withColumn("host", url_host(F.col("url"))), domain, now).select(*queue.columns)
    return heads if n is None else heads.orderBy("added", "id").limit(n)


def new_queue_rows(
    queue: DataFrame, links: DataFrame, now: Column, few: bool = False, last: Column | None = None
) -> DataFrame:
    """The rows that the queue lacks; ``links`` holds ``url`` and ``domain_id``.

    Ids go on from ``last``, or from the largest in the queue.
    """
    fresh = links.groupBy("url").agg(F.min("domain_id").alias("domain_id"))
    start = next_id(queue) if last is None else last + 1
    added = assign_ids(absent(fresh, queue, ["url"], few), ["url"], start).withColumn("added", now)
    return added.select(*queue.columns)


def enqueue(
    queue: DataFrame, links: DataFrame, now: Column, few: bool = False, last: Column | None = None
) -> DataFrame:
    """The queue grown by the URLs it lacks."""
    return queue.unionByName(new_queue_rows(queue, links, now, few, last))


def add_seeds(
    queue: DataFrame, domain: DataFrame, urls: DataFrame, now: Column
) -> tuple[DataFrame, DataFrame]:
    """Queue and domains grown by URLs that a user hands in (column ``url``)."""
    seeds = urls.select("url").distinct().withColumn("host", url_host(F.col("url")))
    grown = upsert_domain(domain, seeds.select(F.col("host").alias("name")), now)
    return enqueue(queue, with_dim_id(seeds, grown, "host", "domain_id", "left"), now), grown


def dequeue(queue: DataFrame, done: DataFrame, few: bool = False) -> DataFrame:
    """The queue without the ids in ``done``."""
    return absent(queue, F.broadcast(done) if few else done, ["id"]).select(*queue.columns)


def update_next_visit(
    domain: DataFrame, hosts: DataFrame, now: Column, delay: float = 5, few: bool = False
) -> DataFrame:
    """Domains with ``next_visit = now + delay`` for the hosts just fetched; others as before."""
    visited = hosts.select(F.col("host").alias("name")).distinct().withColumn("_next", now + seconds(delay))
    return (
        domain.join(F.broadcast(visited) if few else visited, "name", "left")
        .withColumn("next_visit", F.coalesce("_next", "next_visit"))
        .select(*domain.columns)
    )
