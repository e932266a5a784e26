"""Dimensions kept by insert-if-absent: names, ids, and the look-ups on them.

Large joins carry no broadcast hints: Spark broadcasts a side when its measured
size is under its threshold, shuffles otherwise, and splits a hot key's partition.

``few=True`` is the caller's word, after a count, that the new rows are at most
``FEW_ROWS``.  Then they are sent to the large table, which is scanned where it
lies and not shuffled.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from spindrift.session import cut_lineage

# Schemes whose ids never change.
FIXED_PROTOCOLS = ((0, "http"), (1, "https"))
DIM_SCHEMA = "id bigint, name string"

# Rows that may be sent to every task.
FEW_ROWS = 50_000

# Length of the grams that names are indexed by, and the marks of a name's ends.
GRAM = 3
FIRST, LAST = "\x02", "\x03"


def bucketed_rank(df: DataFrame, bucket: Column, order: Sequence[str | Column], out: str) -> DataFrame:
    """Rank rows from 1 by ``(bucket, order)`` without a window over the whole table.

    Buckets are numbered in parallel and shifted by the sizes of the buckets
    before them.  The one unpartitioned window reads one row per bucket, so the
    caller must bound the number of buckets.  The rows are read twice, so the
    caller writes them first where work led to them.
    """
    tagged = df.withColumn("_bucket", bucket)
    before = W.orderBy("_bucket").rowsBetween(W.unboundedPreceding, -1)
    offsets = (
        tagged.groupBy("_bucket")
        .agg(F.count("*").alias("_size"))
        .select("_bucket", F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_offset"))
    )
    inside = F.row_number().over(W.partitionBy("_bucket").orderBy(*order))
    return (
        tagged.withColumn("_inside", inside)
        .join(offsets, "_bucket")
        .withColumn(out, F.col("_offset") + F.col("_inside"))
        .drop("_bucket", "_inside", "_offset")
    )


def assign_ids(df: DataFrame, keys: Sequence[str], start: int | Column = 1, digits: int = 4) -> DataFrame:
    """Add ``id``: consecutive numbers from ``start`` in order of the key's md5, then the key.

    ``keys`` must be unique and not NULL.  ``16 ** digits`` buckets share the
    work; the ids do not depend on how many there are.
    """
    return _number(cut_lineage(df), keys, start, digits)


def _number(df: DataFrame, keys: Sequence[str], start: int | Column, digits: int = 4) -> DataFrame:
    start = start if isinstance(start, Column) else F.lit(start)
    hashed = df.withColumn("_md5", F.md5(F.concat_ws("\n", *[F.col(k).cast("string") for k in keys])))
    ranked = bucketed_rank(hashed, F.substring("_md5", 1, digits), ["_md5", *keys], "_rank")
    return ranked.withColumn("id", (start + F.col("_rank") - 1).cast("bigint")).drop("_md5", "_rank")


def next_id(table: DataFrame) -> Column:
    """One past the largest id, as a scalar subquery of the plan that uses it."""
    return table.agg(F.coalesce(F.max("id"), F.lit(0)) + 1).scalar()


def near(table: DataFrame, rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The rows of a large table whose key occurs among a few ``rows``."""
    return table.join(F.broadcast(rows.select(*keys).distinct()), list(keys), "left_semi")


def absent(new: DataFrame, existing: DataFrame, keys: Sequence[str], few: bool = False) -> DataFrame:
    """Rows of ``new`` whose key is not in ``existing``."""
    known = existing.select(*keys)
    if few:
        # Distinct, these are no more than the new keys.
        known = F.broadcast(near(known, new, keys).distinct())
    return new.join(known, list(keys), "left_anti")


def upsert_dim(
    dim: DataFrame,
    names: DataFrame,
    key: str = "name",
    defaults: dict[str, Column] | None = None,
    few: bool = False,
) -> DataFrame:
    """The dimension grown by the distinct names it lacks."""
    added = new_dim_rows(dim, names, key, defaults, few)
    return dim if added is None else dim.unionByName(added)


def new_dim_rows(
    dim: DataFrame,
    names: DataFrame,
    key: str = "name",
    defaults: dict[str, Column] | None = None,
    few: bool = False,
) -> DataFrame | None:
    """The entries that the dimension lacks, or None.

    ``names`` holds the column ``key``; ``defaults`` fills the other columns.
    The new entries are written once, as ids are looked up in them many times.
    """
    missing = absent(names.select(key).filter(F.col(key).isNotNull()).distinct(), dim, [key], few)
    missing = cut_lineage(missing)
    if missing.isEmpty():
        return None
    return cut_lineage(_number(missing, [key], next_id(dim)).withColumns(defaults or {}).select(*dim.columns))


def upsert_domain(domain: DataFrame, hosts: DataFrame, now: Column, few: bool = False) -> DataFrame:
    """Domains grown by the hosts seen; a new one may be visited after ``now``."""
    return upsert_dim(domain, hosts, "name", {"next_visit": now}, few)


def new_domains(domain: DataFrame, hosts: DataFrame, now: Column, few: bool = False) -> DataFrame | None:
    """The domains that are missing for the hosts seen, or None."""
    return new_dim_rows(domain, hosts, "name", {"next_visit": now}, few)


def upsert_protocols(protocols: DataFrame, schemes: DataFrame) -> DataFrame:
    """Schemes grown by those seen; http and https keep their fixed ids."""
    return upsert_dim(with_fixed_protocols(protocols), schemes)


def with_fixed_protocols(protocols: DataFrame) -> DataFrame:
    fixed = protocols.sparkSession.createDataFrame(FIXED_PROTOCOLS, DIM_SCHEMA)
    return protocols.unionByName(absent(fixed, protocols, ["name"]).select(*protocols.columns))


def with_dim_id(
    df: DataFrame, dim: DataFrame, on: str, out: str, how: str = "inner", few: bool = False
) -> DataFrame:
    """Add the id of the dimension row whose name equals column ``on``."""
    ids = dim.select(F.col("name").alias(on), F.col("id").alias(out))
    if few:
        # Names are unique, so these are no more than the rows.
        ids = F.broadcast(near(ids, df, [on]))
    return df.join(ids, on, how)


def fixed_scheme_id(scheme: Column) -> Column:
    """Id of http or https, which needs no look-up; NULL for another scheme."""
    return F.coalesce(*[F.when(scheme == name, F.lit(id).cast("bigint")) for id, name in FIXED_PROTOCOLS])


def url_ids(links: DataFrame, url: DataFrame) -> DataFrame:
    """Add ``url_id``, the id of the stored link, or NULL."""
    keys = ["path", "domain_id", "scheme_id"]
    return links.join(url.select(*keys, F.col("id").alias("url_id")), keys, "left")


def _substrings(values: DataFrame, col: str, lengths: Column) -> DataFrame:
    """Every distinct substring of ``col`` whose length is in ``lengths``, per row."""
    size = F.length(col)

    def cuts(n: Column) -> Column:
        starts = F.sequence(F.lit(1), size - n + 1)
        return F.when(n <= size, F.transform(starts, lambda i: F.substr(F.col(col), i, n)))

    grams = F.array_distinct(F.flatten(F.filter(F.transform("_lengths", cuts), lambda a: a.isNotNull())))
    return values.withColumn("_lengths", lengths).withColumn("gram", F.explode(grams)).drop("_lengths")


def content_type_ids(dim: DataFrame, values: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Ids of content types by containment: ``(grown dimension, value -> id)``.

    A value gets the smallest id of an entry that contains it, without regard to
    case and with ``%`` and ``_`` taken literally.  Values contained nowhere are
    added, one entry per spelling without regard to case.  A missing value counts as
    empty, which every entry contains.

    Containment is an equality here: the entries' substrings of the lengths
    looked for, reduced to the smallest id each, are joined on the value itself.
    """
    wanted = values.select(F.coalesce("value", F.lit("")).alias("value")).distinct().withColumn("gram", F.lower("value"))
    lengths = wanted.agg(F.collect_set(F.length("gram"))).scalar()
    entries = dim.select("id", F.lower("value").alias("entry"))
    smallest = _substrings(entries, "entry", lengths).groupBy("gram").agg(F.min("id").alias("found"))
    matched = cut_lineage(wanted.join(smallest, "gram", "left"))

    missing = matched.filter(F.col("found").isNull()).groupBy("gram").agg(F.min("value").alias("value"))
    added = cut_lineage(assign_ids(missing, ["gram"], next_id(dim)))
    ids = matched.join(added.select("gram", F.col("id").alias("added")), "gram", "left").select(
        "value", F.coalesce("found", "added").alias("id")
    )
    return dim.unionByName(added.select(*dim.columns)), ids


def match_domains(hosts: DataFrame, domain: DataFrame, pattern: bool = False) -> DataFrame:
    """Pairs of host and domain: equal in lower case, or ``name LIKE host`` with ``pattern``.

    For the pattern form a host with wildcards is looked up by some of its literal
    characters, and LIKE then decides.  With ``_`` alone the length of the name
    and the place of the longest run are known, so a name is cut at the places
    that hosts of its length ask for.  With ``%`` a run may be anywhere: names
    are indexed by the grams of ``GRAM`` characters at most that hosts ask for,
    and each host is looked up by its rarest one.
    """
    wanted = hosts.select("host", F.lower("host").alias("_host")).filter(F.col("host").isNotNull()).distinct()
    names = domain.select(F.col("id").alias("domain_id"), "name", F.lower("name").alias("_name"))
    result = ["host", "domain_id", "name"]
    wild = F.col("_host").rlike("[%_]")
    plain = wanted.filter(~wild) if pattern else wanted
    equal = plain.join(names, F.col("_host") == F.col("_name")).select(result)
    if not pattern:
        return equal

    runs = F.split("_host", "[%_]", -1)
    longest = F.aggregate(
        runs, F.lit(""), lambda best, run: F.when(F.length(run) > F.length(best), run).otherwise(best)
    )
    keyed = wanted.filter(wild).withColumn("gram", longest)
    # LIKE's own escape character has no special meaning in a host.
    like = F.expr(r"_name LIKE replace(_host, '\\', '\\\\')")

    at, size = F.instr("_host", F.col("gram")), F.length("gram")
    fixed = keyed.filter(~F.contains("_host", F.lit("%"))).withColumns(
        {"_length": F.length("_host"), "_at": at, "_size": size}
    )
    shape = ["_length", "_at", "_size"]
    shapes = cut_lineage(fixed.select(shape).distinct())
    shapes = F.broadcast(shapes) if shapes.count() <= FEW_ROWS else shapes
    cut = names.withColumn("_length", F.length("_name")).join(shapes, "_length")
    cut = cut.withColumn("gram", F.substr("_name", F.col("_at"), F.col("_size")))
    placed = cut.join(fixed, [*shape, "gram"]).filter(like).select(result)

    free = wanted.filter(F.contains("_host", F.lit("%"))).withColumn("gram", F.explode(_pattern_grams("_host")))
    free = cut_lineage(free)
    lengths = free.agg(F.collect_set(F.length("gram"))).scalar()
    marked = names.withColumn("_marked", F.concat(F.lit(FIRST), "_name", F.lit(LAST)))
    asked = free.select("gram").distinct()
    asked = F.broadcast(asked) if asked.count() <= FEW_ROWS else asked
    index = cut_lineage(_substrings(marked, "_marked", lengths).join(asked, "gram", "left_semi").select("gram", "domain_id", "name", "_name"))
    often = index.groupBy("gram").agg(F.count("*").alias("_n"))
    # A host with a gram that no name has matches nothing.
    rarest = (
        free.join(often, "gram", "left").groupBy("host", "_host")
        .agg(F.min(F.struct(F.coalesce("_n", F.lit(0)).alias("_n"), "gram")).gram.alias("gram"))
    )
    anywhere = rarest.join(index, "gram").filter(like).select(result)
    return equal.unionByName(placed).unionByName(anywhere)


def _pattern_grams(host: str) -> Column:
    """Substrings that a name which matches the pattern holds, all of one length: ``GRAM``, or less if no run is so long.

    Runs at the pattern's ends are marked, as names are at theirs, so a gram may
    tell its place.
    """
    runs = F.split(host, "[%_]", -1)
    ends = F.transform(
        runs,
        lambda run, i: F.concat(
            F.when((i == 0) & (run != ""), FIRST).otherwise(""), run, F.when((i == F.size(runs) - 1) & (run != ""), LAST).otherwise("")
        ),
    )
    q = F.least(F.lit(GRAM), F.array_max(F.transform(ends, F.length)))
    long_enough = F.filter(ends, lambda run: F.length(run) >= q)
    cut = F.transform(
        long_enough, lambda run: F.transform(F.sequence(F.lit(1), F.length(run) - q + 1), lambda i: F.substr(run, i, q))
    )
    return F.array_distinct(F.flatten(cut))
