"""One crawl step and repeated rounds, composed of the operators."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import datetime, timedelta
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spindrift.functions.urls import SUPPORTED_SCHEMES
from spindrift.operators.dims import (
    FEW_ROWS,
    absent,
    fixed_scheme_id,
    near,
    new_domains,
    with_dim_id,
    with_fixed_protocols,
)
from spindrift.operators.fetches import content_store, fetch_outcome
from spindrift.operators.frontier import (
    due,
    frontier,
    new_queue_rows,
    split_valid,
    update_next_visit,
)
from spindrift.operators.links import hrefs, link_parts
from spindrift.operators.places import PLACE, at_places, from_files, has_places, sieved, stored
from spindrift.operators.robots import robots_blocked
from spindrift.operators.store import new_urls
from spindrift.session import cut_lineage, run_dir, side_by_side
from spindrift.sources.statelog import Change, grown, load_version, save_first, save_version
from spindrift.sources.tables import CrawlState, layouts, page_bucket, write_content


# URLs of a batch that may be listed in a filter on the pages.
LISTED_URLS = 1_000


@dataclass(frozen=True)
class StepResult:
    """What a step did.

    ``changes`` holds what each table gains and loses, as ``save_version`` writes
    it; ``state`` is the new state.
    """

    before: CrawlState
    changes: dict[str, Change]
    outcomes: DataFrame
    fetched: DataFrame

    @property
    def state(self) -> CrawlState:
        return grown(self.before, self.changes)


def _both(one: DataFrame, more: DataFrame | None) -> DataFrame:
    return one if more is None else one.unionByName(more)


def _fetch(batch: DataFrame, pages: DataFrame, few: bool, n: int | None) -> DataFrame:
    """Batch rows with their newest snapshot, and the place it was read from.

    The snapshot is chosen by URL and time, without its text; the texts of
    copies with one time are compared only where there are such.  A small batch
    is sent to the pages, a large one as a sieve of its URLs, so that only texts
    that may be wanted are shuffled.
    """
    keys = ["url"]
    if counts := layouts(pages):
        keys = ["buckets", "bucket", "url"]
        batch = batch.withColumn("buckets", F.explode(F.array(*map(F.lit, counts))))
        batch = batch.withColumn("bucket", page_bucket(F.col("url"), F.col("buckets")))
        # No more small numbers than there are folders; they prune those that are read.
        folders = batch.groupBy("buckets").agg(F.collect_set("bucket").alias("own")).collect()
        terms = [(F.col("buckets") == r.buckets) & F.col("bucket").isin(r.own) for r in folders]
        pages = pages.filter(reduce(Column.__or__, terms, F.lit(False)))
    if n is not None and n <= LISTED_URLS:
        # So few URLs can be told to the scan, which skips files and row groups sorted by URL.
        pages = pages.filter(F.col("url").isin([row.url for row in batch.select("url").collect()]))
    body = F.col("body" if "body" in pages.columns else "html")
    taken_at = F.col("fetched_at") if "fetched_at" in pages.columns else F.lit(None).cast("timestamp_ntz")
    pages = pages.select(*keys, "status_line", "content_type", body.alias("body"), taken_at.alias("fetched_at"))
    wanted = batch if few else cut_lineage(batch)

    def of_batch(rows: DataFrame) -> DataFrame:
        return rows.join(F.broadcast(wanted), keys) if few else sieved(rows, wanted, ["url"]).join(wanted, keys)

    if has_places(pages):
        pages = from_files(pages)
        copies = of_batch(pages.select(*keys, "fetched_at", *PLACE))
    else:
        # Rows of other sources get places by being written, those of the batch alone.
        pages = copies = stored(of_batch(pages), "copies")
    row = ["url", "host", *PLACE]
    same_time = copies.groupBy("id", "fetched_at").agg(F.count("*").alias("n"), F.min(F.struct(*row)).alias("row"))
    newest = same_time.groupBy("id").agg(F.max(F.struct("fetched_at", "n", "row")).alias("top"))
    newest = cut_lineage(newest.select("id", "top.n", "top.fetched_at", "top.row.*"))
    chosen = newest.filter("n = 1").select("id", *row)
    tied = newest.filter("n > 1").select("id", F.col("fetched_at").alias("_at"))
    if not tied.isEmpty():
        same = copies.join(tied, "id").filter(F.equal_null("fetched_at", "_at")).select("id", *row)
        texts = at_places(pages.select("status_line", "content_type", "body", *PLACE), cut_lineage(same))
        narrow = texts.select("id", "url", "host", F.md5("body").alias("_md5"), "status_line", "content_type", *PLACE)
        order = F.struct("_md5", F.col("_md5").alias("_same"), "status_line", "content_type", *row)
        decided = narrow.groupBy("id").agg(F.max(order).alias("row"))
        chosen = cut_lineage(chosen.unionByName(decided.select("id", *[F.col(f"row.{c}").alias(c) for c in row])))
    texts = pages.select("status_line", "content_type", "body", *PLACE)
    return at_places(texts, chosen).select("id", "url", "host", "status_line", "content_type", "body", *PLACE)


def _with_domain(bodies: DataFrame, kept: DataFrame, domain: DataFrame, few: bool) -> DataFrame:
    """Bodies with ``domain_id``; the hosts come from the batch, not from the texts."""
    ids = domain.select(F.col("name").alias("host"), F.col("id").alias("domain_id"))
    return bodies.join(F.broadcast(near(ids, kept, ["host"])) if few else ids, "host")


def crawl_step(
    state: CrawlState,
    pages: DataFrame,
    rules: DataFrame,
    now: datetime,
    n: int | None = 10,
    delay: float = 5,
    *,
    agent: str = "*",
    mode: str = "rfc",
    due_first: bool = False,
    skip_known: bool = False,
) -> StepResult:
    """Try one batch of the queue; give the new state and one outcome row per URL tried.

    ``pages`` holds snapshots; ``rules`` are parsed robots rules.
    The verdicts and the links of the batch are written once to the shared
    folder; the new tables are plans on top of that.  ``fetched`` has the bodies
    to store, for ``content_store``.

    Batch and links are counted as they are written.  While they are few, they
    are sent to the large tables; else both sides are shuffled.
    """
    at = F.lit(now).cast("timestamp_ntz")
    batch = cut_lineage(frontier(state.queue, n, due_first, state.domain, at))

    few = batch.count() <= FEW_ROWS
    valid, invalid = split_valid(batch)
    met = new_domains(state.domain, valid.select(F.col("host").alias("name")), at, few)
    domain = _both(state.domain, met)
    open_now = due(valid, domain, at, few).select("id").withColumn("is_due", F.lit(True))
    judged = cut_lineage(
        robots_blocked(valid.join(open_now, "id", "left"), rules, agent, few).select(
            "id",
            "url",
            "host",
            F.when(F.col("is_due").isNull(), "not_due").when(F.col("blocked"), "blocked").alias("refused"),
        )
    )
    wanted = judged.filter(F.col("refused").isNull()).select("id", "url", "host")
    bodies = _fetch(wanted, pages, few, n).withColumn("outcome", fetch_outcome())
    stored = F.col("outcome").isin("html", "other")
    answers = cut_lineage(
        bodies.select("id", "url", "host", "outcome", F.when(stored, hrefs(F.col("body"))).alias("hrefs"))
    )

    outcomes = (
        judged.join(answers.select("id", "outcome"), "id", "left")
        .select("id", "url", F.coalesce("refused", "outcome", F.lit("skipped")).alias("outcome"))
        .unionByName(invalid.select("id", "url", F.lit("invalid").alias("outcome")))
    )

    kept = answers.filter(F.col("outcome").isin("html", "other"))
    found = kept.select(F.col("id").alias("page_id"), "url", F.posexplode("hrefs").alias("pos", "href"))
    links = link_parts(found, mode).filter(F.col("scheme").isin(*SUPPORTED_SCHEMES))
    targets = cut_lineage(links.select(F.col("resolved").alias("url"), "scheme", "host", "path").distinct())

    few_links = targets.count() <= FEW_ROWS
    linked = new_domains(domain, targets.select(F.col("host").alias("name")), at, few_links)
    domain = _both(domain, linked)
    targets = with_dim_id(targets, domain, "host", "domain_id", few=few_links).withColumn(
        "scheme_id", fixed_scheme_id(F.col("scheme"))
    )

    done = outcomes.filter(F.col("outcome") != "not_due")
    tried = absent(done.select("url").distinct(), state.tried, ["url"], few)
    fresh = targets
    if skip_known:
        fresh = absent(absent(targets, tried, ["url"]), state.tried, ["url"], few_links)
    queued, stored_links = side_by_side(
        lambda: cut_lineage(new_queue_rows(state.queue, fresh, at, few_links, state.last_id())),
        lambda: new_urls(state.url, targets, few_links),
    )
    protocols = with_fixed_protocols(state.protocols)
    # Domains that are new, or were visited now.
    visited = near(state.domain, kept.select(F.col("host").alias("name")), ["name"]) if few else state.domain.join(
        kept.select(F.col("host").alias("name")).distinct(), "name", "left_semi"
    )
    changed = update_next_visit(_both(_both(visited, met), linked), kept.select("host"), at, delay, few)
    last = F.greatest(state.last_id(), F.coalesce(queued.agg(F.max("id")).scalar(), F.lit(0).cast("bigint")))
    marks = state.protocols.sparkSession.range(1).select(F.lit("queue").alias("name"), last.alias("last"))
    return StepResult(
        state,
        {
            "marks": Change(whole=marks),
            "queue": Change(queued, done.select("id")),
            "domain": Change(changed),
            "protocols": Change(absent(protocols, state.protocols, ["name"])),
            "url": Change(stored_links),
            "tried": Change(tried),
        },
        outcomes,
        _with_domain(bodies.filter(stored).withColumn("fetched_at", at), kept, domain, few),
    )


def crawl(
    state: CrawlState,
    pages: DataFrame,
    rules: DataFrame,
    start: datetime,
    rounds: int,
    tick: float = 15,
    directory: str | None = None,
    content: str | None = None,
    **options,
) -> tuple[CrawlState, DataFrame]:
    """Steps until the queue is empty or ``rounds`` are done, ``tick`` seconds apart.

    Each round's changes are written as a new version and read back merged, so
    no plan grows with the number of rounds.  Gives the
    last state and all outcomes with their ``round``.  With ``content`` each
    round's bodies are written to a folder below it, for ``read_content``.
    """
    spark = state.queue.sparkSession
    directory = directory or run_dir(spark, "crawl")
    save_first(state, directory)
    state = load_version(spark, directory, 0)
    written = []
    for number in range(1, rounds + 1):
        if state.queue.isEmpty():
            break
        now = start + timedelta(seconds=tick * (number - 1))
        step = crawl_step(state, pages, rules, now, **options)
        beside = [lambda: step.outcomes.write.mode("overwrite").parquet(f"{directory}/outcomes/round={number}")]
        if content is not None:
            beside.append(lambda: write_content(content_store(step.fetched), f"{content}/round={number}"))
        save_version(spark, step.changes, directory, number, beside=beside)
        state = load_version(spark, directory, number)
        written.append(number)
    schema = "id bigint, url string, outcome string, round int"
    if not written:
        return state, spark.createDataFrame([], schema)
    return state, spark.read.schema(schema).parquet(f"{directory}/outcomes")
