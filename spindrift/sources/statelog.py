"""Crawl state as a log: what each version adds and removes, merged when it is read.

A version writes the rows it adds and the ids it removes, so a large queue that
does not change costs nothing.  Every ``COMPACT_EVERY`` versions the changes
since the last base are merged into a new one.  Tables whose rows change are
kept by key bucket, and only buckets that changes fall in are written again; a
manifest tells which base holds which bucket.  Tables that only grow get one
run of files with the rows added since the last base.

A version's own row names the base it was written on, and is written last: a
version is read whole or not at all, and a base made meanwhile does not touch
it.  ``expire`` drops what no version within the readers' lease needs.

    <directory>/<table>/added/version=v      rows added or changed by v
    <directory>/<table>/removed/version=v    ids removed by v
    <directory>/<table>/base/base=b/bucket=i merged rows as of b
    <directory>/manifest/base=b              (name, bucket, held_by)
    <directory>/versions/version=v           (base, written_at)
"""

from __future__ import annotations

import time
from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spindrift.session import side_by_side
from spindrift.sources.tables import STATE_SCHEMAS, CrawlState

# Tables with rows that change or go, by their id.
KEYED = ("queue", "domain")
BUCKETS = 64
COMPACT_EVERY = 8
MANIFEST_SCHEMA = "name string, bucket int, held_by int"
VERSION_SCHEMA = "base int, written_at double"
ONE_RUN = -1


@dataclass(frozen=True)
class Change:
    """What happens to a table: rows added, or changed under an id that is there; ids removed; or all rows anew."""

    added: DataFrame | None = None
    removed: DataFrame | None = None
    whole: DataFrame | None = None

    def applied(self, before: DataFrame, keyed: bool) -> DataFrame:
        """The table after the change."""
        if self.whole is not None:
            return self.whole
        if self.removed is not None:
            before = before.join(self.removed.select("id"), "id", "left_anti").select(*before.columns)
        if self.added is None:
            return before
        if keyed and self.removed is None:
            before = before.join(self.added.select("id"), "id", "left_anti").select(*before.columns)
        return before.unionByName(self.added.select(*before.columns))


def grown(before: CrawlState, changes: dict[str, Change]) -> CrawlState:
    old = before.tables()
    return before.with_tables(
        **{
            name: change.whole if change.whole is not None else change.applied(old[name], name in KEYED)
            for name, change in changes.items()
        }
    )


def _schema(name: str, extra: str = "") -> T.StructType:
    return T.StructType.fromDDL(STATE_SCHEMAS[name] + extra)


def _bucket(buckets: int = BUCKETS) -> Column:
    return F.pmod(F.xxhash64("id"), F.lit(buckets)).cast("int")


def _written_base(name: str, rows: DataFrame, directory: str, base: int) -> None:
    """One base of a table, in buckets or as one run; buckets without rows have no folder."""
    path = f"{directory}/{name}/base/base={base}"
    if name not in KEYED:
        rows.write.mode("overwrite").parquet(path)
        return
    laid_out = rows.withColumn("bucket", _bucket()).hint("rebalance", "bucket").sortWithinPartitions("bucket", "id")
    laid_out.write.mode("overwrite").partitionBy("bucket").parquet(path)


def save_first(state: CrawlState, directory: str) -> None:
    """Version 0, which is its own base."""
    spark, tables = state.queue.sparkSession, state.marked().tables()
    marks = tables.pop("marks")
    side_by_side(
        *[lambda name=name, rows=rows: _written_base(name, rows, directory, 0) for name, rows in tables.items()],
        lambda: marks.write.mode("overwrite").parquet(f"{directory}/marks/added/version=0"),
    )
    held = [(name, i, 0) for name in KEYED for i in _buckets_of(spark, directory, name, 0)]
    held += [(name, ONE_RUN, 0) for name in tables if name not in KEYED]
    _write_rows(spark, held, MANIFEST_SCHEMA, f"{directory}/manifest/base=0")
    _write_version(spark, directory, 0, 0)


def _write_rows(spark: SparkSession, rows: list[tuple], schema: str, path: str) -> None:
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("overwrite").parquet(path)


def _write_version(spark: SparkSession, directory: str, version: int, base: int) -> None:
    _write_rows(spark, [(base, time.time())], VERSION_SCHEMA, f"{directory}/versions/version={version}")


def _filesystem(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()), where


def _children(spark: SparkSession, path: str) -> list[str]:
    """Names in a folder; none if it is not there."""
    fs, where = _filesystem(spark, path)
    return sorted(s.getPath().getName() for s in fs.listStatus(where)) if fs.exists(where) else []


def _numbers(spark: SparkSession, path: str, key: str) -> list[int]:
    return sorted(int(c.split("=")[1]) for c in _children(spark, path) if c.startswith(f"{key}="))


def _buckets_of(spark: SparkSession, directory: str, name: str, base: int) -> list[int]:
    return _numbers(spark, f"{directory}/{name}/base/base={base}", "bucket")


def versions(spark: SparkSession, directory: str) -> dict[int, tuple[int, float]]:
    """Base and time of each complete version."""
    rows = spark.read.schema(f"{VERSION_SCHEMA}, version int").parquet(f"{directory}/versions")
    return {r.version: (r.base, r.written_at) for r in rows.collect()}


def latest_version(spark: SparkSession, directory: str) -> int:
    """The number of the last complete version."""
    return max(versions(spark, directory))


def _complete_bases(spark: SparkSession, directory: str) -> list[int]:
    return [b for b in _numbers(spark, f"{directory}/manifest", "base") if "_SUCCESS" in _children(spark, f"{directory}/manifest/base={b}")]


def _manifest(spark: SparkSession, directory: str, base: int) -> list[tuple[str, int, int]]:
    """(name, bucket, base that holds it): at most ``BUCKETS`` rows for a table that changes, one for each run of the others."""
    rows = spark.read.schema(MANIFEST_SCHEMA).parquet(f"{directory}/manifest/base={base}").collect()
    return [(r.name, r.bucket, r.held_by) for r in rows]


def _base_paths(directory: str, name: str, held: list[tuple[str, int, int]]) -> list[str]:
    return [
        f"{directory}/{name}/base/base={base}" + ("" if bucket == ONE_RUN else f"/bucket={bucket}")
        for own, bucket, base in sorted(held)
        if own == name
    ]


def _since(spark: SparkSession, directory: str, name: str, kind: str, schema: T.StructType, base: int, version: int) -> DataFrame | None:
    """Rows that versions after ``base`` up to ``version`` wrote; later ones, whole or not, are pruned."""
    path = f"{directory}/{name}/{kind}"
    if version <= base or not any(base < v <= version for v in _numbers(spark, path, "version")):
        return None
    rows = spark.read.schema(schema.add("version", T.IntegerType())).parquet(path)
    return rows.filter((F.col("version") > base) & (F.col("version") <= version))


def save_version(
    spark: SparkSession, changes: dict[str, Change], directory: str, version: int, compact_every: int | None = None,
    beside: Sequence[Callable[[], None]] = (),
) -> None:
    """Write one version's changes, and a new base if it is time for one.

    Writing a version again replaces it.  The tables, and what else is to be
    written ``beside`` them, are written at once, the row that makes the version
    complete last.
    """

    def save(name: str, kind: str, rows: DataFrame) -> Callable[[], None]:
        return lambda: rows.write.mode("overwrite").parquet(f"{directory}/{name}/{kind}/version={version}")

    jobs = list(beside)
    for name, change in changes.items():
        added = change.whole if change.whole is not None else change.added
        jobs += [save(name, "added", added)] if added is not None else []
        jobs += [save(name, "removed", change.removed.select("id"))] if change.removed is not None else []
    side_by_side(*jobs)
    base = max(b for b in _complete_bases(spark, directory) if b < max(version, 1))
    _write_version(spark, directory, version, base)
    if version - base >= (compact_every or COMPACT_EVERY):
        compact(spark, directory, version)


def load_version(spark: SparkSession, directory: str, version: int) -> CrawlState:
    """The state as of a version."""
    base = versions(spark, directory)[version][0]
    held = _manifest(spark, directory, base)

    def load(name: str) -> DataFrame:
        if name == "marks":  # a row for each version
            marks = spark.read.schema(_schema(name, ", version int")).parquet(f"{directory}/marks/added")
            return marks.filter(F.col("version") == version).drop("version")
        paths, columns = _base_paths(directory, name, held), _schema(name).names
        rows = spark.read.schema(_schema(name)).parquet(*paths) if paths else spark.createDataFrame([], _schema(name))
        added = _since(spark, directory, name, "added", _schema(name), base, version)
        removed = _since(spark, directory, name, "removed", T.StructType.fromDDL("id bigint"), base, version)
        if name in KEYED and added is not None and name != "queue":
            # Of rows changed several times the last one counts.
            last = added.groupBy("id").agg(F.max_by(F.struct(*columns), "version").alias("row")).select("row.*")
            rows, added = rows.join(added.select("id"), "id", "left_anti").select(*columns), last
        if added is not None:
            rows = rows.unionByName(added.select(*columns))
        if removed is not None:
            rows = rows.join(removed.select("id"), "id", "left_anti").select(*columns)
        return rows

    return CrawlState(**{name: load(name) for name in STATE_SCHEMAS}, marks_tell=True)


def compact(spark: SparkSession, directory: str, version: int) -> None:
    """A new base as of a version: changed buckets written again, others kept where they are."""
    base = versions(spark, directory)[version][0]
    held, state = _manifest(spark, directory, base), load_version(spark, directory, version)
    new: list[tuple[str, int, int]] = []

    def merge(name: str) -> None:
        added = _since(spark, directory, name, "added", _schema(name), base, version)
        removed = _since(spark, directory, name, "removed", T.StructType.fromDDL("id bigint"), base, version)
        kept = [h for h in held if h[0] == name]
        if name not in KEYED:
            if added is not None:
                _written_base(name, added.drop("version"), directory, version)
                kept.append((name, ONE_RUN, version))
            new.extend(kept)
            return
        ids = [rows.select("id") for rows in (added, removed) if rows is not None]
        touched = sorted({r.bucket for rows in ids for r in rows.select(_bucket().alias("bucket")).distinct().collect()})
        if touched:
            rows = getattr(state, name).filter(_bucket().isin(touched))
            _written_base(name, rows, directory, version)
        found = _buckets_of(spark, directory, name, version) if touched else []
        new.extend([h for h in kept if h[1] not in touched] + [(name, i, version) for i in found])

    side_by_side(*[lambda name=name: merge(name) for name in STATE_SCHEMAS if name != "marks"])
    _write_rows(spark, sorted(new), MANIFEST_SCHEMA, f"{directory}/manifest/base={version}")


def expire(spark: SparkSession, directory: str, lease: float, now: float | None = None) -> list[int]:
    """Drop versions older than the lease, in seconds, but for the last one, and files that no version left needs.

    A reader may use a version for as long as the lease after it was written.
    Gives the versions dropped.
    """
    known = versions(spark, directory)
    limit = (time.time() if now is None else now) - lease
    old = [v for v, (_, at) in known.items() if at < limit and v != max(known)]
    left = {v: base for v, (base, _) in known.items() if v not in old}
    bases = {*left.values(), *[b for b in _complete_bases(spark, directory) if b >= max(left.values())]}
    needed = {h for b in bases for h in _manifest(spark, directory, b)}
    for v in old:  # first, so that nobody starts to read one
        _drop(spark, f"{directory}/versions/version={v}")
    oldest, first = min(left.values()), min(left)
    for name in STATE_SCHEMAS:
        unused = first - 1 if name == "marks" else oldest
        for kind in ("added", "removed"):
            for v in _numbers(spark, f"{directory}/{name}/{kind}", "version"):
                if v <= unused:
                    _drop(spark, f"{directory}/{name}/{kind}/version={v}")
        for b in _numbers(spark, f"{directory}/{name}/base", "base"):
            path = f"{directory}/{name}/base/base={b}"
            if not any(h[0] == name and h[2] == b for h in needed):
                if b < max(bases):
                    _drop(spark, path)
                continue
            for i in _numbers(spark, path, "bucket"):
                if (name, i, b) not in needed:
                    _drop(spark, f"{path}/bucket={i}")
    for b in _numbers(spark, f"{directory}/manifest", "base"):
        if b not in bases and b < max(bases):
            _drop(spark, f"{directory}/manifest/base={b}")
    return sorted(old)


def _drop(spark: SparkSession, path: str) -> None:
    fs, where = _filesystem(spark, path)
    fs.delete(where, True)
