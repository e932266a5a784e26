"""Links from pages as they arrive, and their merge into the stored tables."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spindrift.operators.dims import FEW_ROWS, absent, fixed_scheme_id, new_domains, with_dim_id, with_fixed_protocols
from spindrift.operators.fetches import fetch_outcome
from spindrift.operators.frontier import new_queue_rows
from spindrift.operators.links import page_links
from spindrift.operators.robots import robots_blocked
from spindrift.operators.store import new_urls
from spindrift.session import cut_lineage
from spindrift.sources.statelog import Change, latest_version, load_version, save_first, save_version
from spindrift.sources.tables import CrawlState

LINK_KEY = ["scheme", "host", "path"]


def followed(pages: DataFrame, rules: DataFrame | None = None, agent: str = "*") -> DataFrame:
    """The pages whose links count: successful answers at URLs that robots rules, if given, do not block."""
    if "status_line" in pages.columns:
        body = F.col("body" if "body" in pages.columns else "html")
        outcome = fetch_outcome(body)
        pages = pages.filter(outcome.isin("html", "other"))
    if rules is not None:
        pages = robots_blocked(pages, rules, agent).filter(~F.col("blocked")).drop("blocked")
    return pages


def stream_links(
    pages: DataFrame, mode: str = "rfc", seen_at: str | None = None, watermark: str | None = None,
    rules: DataFrame | None = None, agent: str = "*",
) -> DataFrame:
    """Links not seen before, by scheme, host and path, from pages that are ``followed``.

    The default remembers every link, as the link table does, and its state
    grows with the distinct links.  With ``seen_at`` (a timestamp column of the
    pages) and ``watermark`` a link is remembered for that long only.
    """
    pages = followed(pages, rules, agent)
    if watermark is None:
        found = page_links(pages, mode).filter("scheme_supported")
        return found.select(*LINK_KEY).dropDuplicates(LINK_KEY)
    timed = pages.withColumn("_seen", F.col(seen_at).cast("timestamp")).withWatermark("_seen", watermark)
    found = page_links(timed, mode, keep=["_seen"]).filter("scheme_supported")
    return found.select("_seen", *LINK_KEY).dropDuplicatesWithinWatermark(LINK_KEY).select(*LINK_KEY)


def merge_links(state: CrawlState, links: DataFrame, now: datetime) -> dict[str, Change]:
    """The changes that normalized links make: hosts, schemes, queue, and new stored triples.

    The links are written and counted; while they are few, they are sent to the
    large tables.
    """
    at = F.lit(now).cast("timestamp_ntz")
    named = links.filter("scheme_supported").select(F.col("resolved").alias("url"), "scheme", "host", "path")
    links = cut_lineage(named.distinct())
    few = links.count() <= FEW_ROWS
    met = new_domains(state.domain, links.select(F.col("host").alias("name")), at, few)
    domain = state.domain if met is None else state.domain.unionByName(met)
    targets = with_dim_id(links, domain, "host", "domain_id", few=few).withColumn(
        "scheme_id", fixed_scheme_id(F.col("scheme"))
    )
    queued = cut_lineage(new_queue_rows(state.queue, targets, at, few, state.last_id()))
    last = F.greatest(state.last_id(), F.coalesce(queued.agg(F.max("id")).scalar(), F.lit(0).cast("bigint")))
    return {
        "domain": Change(met),
        "protocols": Change(absent(with_fixed_protocols(state.protocols), state.protocols, ["name"])),
        "queue": Change(queued),
        "marks": Change(whole=links.sparkSession.range(1).select(F.lit("queue").alias("name"), last.alias("last"))),
        "url": Change(new_urls(state.url, targets, few)),
    }


def merge_batch(directory: str, now: Callable[[int], datetime]) -> Callable[[DataFrame, int], None]:
    """A ``foreachBatch`` function that merges normalized links into versions of the state.

    Batch ``b`` makes version ``b + 1`` from version ``b`` and its own links
    alone, so a batch that is tried again after a failure writes the same rows
    to the same place.
    """

    def merge(links: DataFrame, batch_id: int) -> None:
        spark = links.sparkSession
        state = load_version(spark, directory, batch_id)
        save_version(spark, merge_links(state, links, now(batch_id)), directory, batch_id + 1)

    return merge


def run_merge(
    pages: DataFrame, state: CrawlState | None, directory: str, now: Callable[[int], datetime],
    rules: DataFrame | None = None, agent: str = "*",
) -> CrawlState:
    """Merge the links of all pages available now that are ``followed``; gives the last version of the state.

    Without a ``state`` the run goes on from what is in ``directory``.
    """
    spark = pages.sparkSession
    if state is not None:
        save_first(state, directory)
    query = (
        page_links(followed(pages, rules, agent))
        .writeStream.foreachBatch(merge_batch(directory, now))
        .option("checkpointLocation", f"{directory}/progress")
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    return load_version(spark, directory, latest_version(spark, directory))
