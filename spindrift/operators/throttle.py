"""Politeness over a whole request log: accept an event only when its key has rested.

An event is accepted if ``ts > last accepted ts + delay`` for its key; the first
is always accepted, ties go to the smallest id.  Rows without key or time are
not events and left out.

Keys of ordinary size are read in order within hash partitions; a search in the
sorted times of a key leads from each accepted event to the next.  Keys above ``hot_rows`` are never held by one task: their time line is
solved as jumps (event -> next acceptable event) that are composed over blocks
of doubling length, then followed down from the first event.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spindrift.functions.times import from_micros, micros
from spindrift.operators.dims import FEW_ROWS
from spindrift.session import cut_lineage, run_dir

HOT_ROWS = 5_000_000
# Entries that one task may follow.
ROWS_AT_ONCE = 2_000_000


def throttle(
    events: DataFrame, key: str, ts: str, id: str, delay: float, hot_rows: int = HOT_ROWS
) -> DataFrame:
    """The accepted events as ``(key, ts, id)``; ``delay`` is in seconds."""
    step = round(delay * 1_000_000)
    if step <= 0:
        raise ValueError("delay must be positive")
    log = events.select(
        F.col(key).alias("key"),
        micros(F.col(ts), events.schema[ts].dataType).alias("us"),
        F.col(id).alias("id"),
    ).filter(F.col("us").isNotNull() & F.col("key").isNotNull())

    sizes = log.groupBy("key").agg(
        F.count("*").alias("n"), F.min("us").alias("first"), F.max("us").alias("last")
    )
    # A row per hot key: no more than a ``hot_rows``-th of the events.
    hot = cut_lineage(sizes.filter(F.col("n") > hot_rows))
    bounds = hot.agg(F.count("*").alias("keys"), F.min("first").alias("first"), F.max("last").alias("last")).first()
    if bounds["keys"] == 0:
        accepted = _accept_in_order(log, step)
    else:
        keys = hot.select("key")
        keys = F.broadcast(keys) if bounds["keys"] <= FEW_ROWS else keys
        usual = log.join(keys, "key", "left_anti")
        busy = log.join(keys, "key", "left_semi")
        accepted = _accept_in_order(usual, step).unionByName(
            _accept_by_jumps(busy, step, bounds["first"], bounds["last"])
        )
    restored = from_micros(F.col("us"), events.schema[ts].dataType)
    return accepted.select(F.col("key").alias(key), restored.alias(ts), F.col("id").alias(id))


def _accept_in_order(log: DataFrame, step: int) -> DataFrame:
    """One pass over each sorted partition; what is carried along is one key and one time."""

    def accept(batches: Iterator) -> Iterator:
        seen, rested = None, None
        for batch in batches:
            keys, times = batch.column("key"), batch.column("us").to_numpy()
            keep = np.zeros(len(times), bool)
            if len(times):
                new = pc.not_equal(keys.slice(1), keys.slice(0, len(keys) - 1)).to_numpy(zero_copy_only=False)
                edges = [0, *(np.flatnonzero(new) + 1).tolist(), len(times)]
                for start, end in zip(edges, edges[1:]):
                    key, own = keys[start].as_py(), times[start:end]
                    at = int(own.searchsorted(rested, side="right")) if key == seen else 0
                    seen = key
                    while at < len(own):
                        keep[start + at] = True
                        rested = int(own[at]) + step
                        at = int(own.searchsorted(rested, side="right"))
            yield batch.filter(pa.array(keep))

    return (
        log.repartition("key").sortWithinPartitions("key", "us", "id").mapInArrow(accept, log.schema)
    )


def _jumps(events: DataFrame, step: int) -> DataFrame:
    """(key, us, next, prev): for each event the first one after ``us + step``, and the one before it.

    Every event appears as itself and as the question what follows us + step.
    Both are dealt by ranges of (key, time), which Spark cuts by numbers of rows,
    so a burst is spread over tasks.  Read from the latest on, a question is
    answered by the event read last; what comes before the first event of a
    range is answered by the ranges before, one row for each range.
    """
    spark = events.sparkSession
    itself = events.select("key", F.col("us").alias("at"), F.lit(True).alias("is_event"))
    question = events.select("key", (F.col("us") + step).alias("at"), F.lit(False).alias("is_event"))
    # At one time, the question comes first: it sees later events only.
    order = [F.desc("key"), F.desc("at"), F.col("is_event")]
    rows = itself.unionByName(question).repartitionByRange(*order).sortWithinPartitions(*order)

    def answer(batches: Iterator) -> Iterator:
        part, key, at = TaskContext.get().partitionId(), None, None
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            keys, times = batch.column("key"), batch.column("at").to_numpy()
            event = batch.column("is_event").to_numpy(zero_copy_only=False)
            new = np.ones(n, bool)
            new[1:] = pc.not_equal(keys.slice(1), keys.slice(0, n - 1)).to_numpy(zero_copy_only=False)
            # The place of the event of its key read last before each row; -1 if this batch has none.
            seen = np.concatenate(([-1], np.maximum.accumulate(np.where(event, np.arange(n), -1))[:-1]))
            start = np.maximum.accumulate(np.where(new, np.arange(n), 0))
            has = seen >= start
            later = np.where(has, times[seen], 0)
            if at is not None and keys[0].as_py() == key:
                going_on = (start == 0) & ~has
                later[going_on], has[going_on] = at, True
            carried = at if keys[n - 1].as_py() == key else None
            key, own = keys[n - 1].as_py(), np.flatnonzero(event & (start == start[-1]))
            at = int(times[own[-1]]) if len(own) else carried
            columns = [keys, batch.column("at"), batch.column("is_event"), pa.array(np.full(n, part)), pa.array(later, pa.int64(), mask=~has)]
            yield pa.RecordBatch.from_arrays(columns, ["key", "at", "is_event", "part", "later"])

    kind, path = events.schema["key"].dataType, run_dir(spark, "jumps")
    told = rows.mapInArrow(answer, f"key {kind.simpleString()}, at long, is_event boolean, part long, later long")
    told.write.parquet(path)
    told = spark.read.schema(told.schema).parquet(path)
    ends = told.filter("is_event").groupBy("part").agg(F.min(F.struct("key", "at")).alias("last")).collect()
    known, before, last = {row.part: row["last"] for row in ends}, [], None
    for part in range(max(known, default=-1) + 2):
        if last is not None:
            before.append((part, last["key"], last["at"]))
        last = known.get(part, last)
    schema = T.StructType([T.StructField("part", T.LongType()), T.StructField("last_key", kind), T.StructField("last_at", T.LongType())])
    ranges = F.broadcast(spark.createDataFrame(before, schema))
    later = F.coalesce("later", F.when(F.col("last_key") == F.col("key"), F.col("last_at")))
    # An event read after another one is the one before it in time.
    both = told.join(ranges, "part", "left").select(
        "key",
        F.when(F.col("is_event"), later).otherwise(F.col("at") - step).alias("us"),
        F.when(~F.col("is_event"), later).alias("next"),
        F.when(F.col("is_event"), F.col("at")).alias("prev"),
    )
    return both.filter("us IS NOT NULL").groupBy("key", "us").agg(F.max("next").alias("next"), F.max("prev").alias("prev"))


def _follow(level: DataFrame) -> DataFrame:
    """The events taken of those left, key by key; the caller bounds their number."""

    def follow(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("us")
        times, to = rows.column("us").to_numpy(), rows.column("to").to_pylist()
        taken, at = [], 0
        while at < len(times):
            taken.append(at)
            at = int(times.searchsorted(to[at])) if to[at] is not None else len(times)
        return rows.select(["key", "us"]).take(pa.array(taken))

    return level.select("key", "us", "to").groupBy("key").applyInArrow(follow, level.select("key", "us").schema)


def _accept_by_jumps(log: DataFrame, step: int, first: int, last: int) -> DataFrame:
    """The same choice for hot keys, by joins on (key, time) only.

    A block of level ``j`` spans ``2**j`` delays.  It can only be entered at an
    event less than one delay after its start, or at the first event after that.
    For those entries level ``j`` stores the first event taken outside the block:
    the jump of level ``j - 1``, done again if it ends in the other half.  So the
    levels shrink by half.  Going back down, the taken entry of each block yields
    the entry of its second half, until blocks hold one taken event each.

    Once ``ROWS_AT_ONCE`` entries are left, they are followed at once.
    """
    events = cut_lineage(
        log.groupBy("key", "us").agg(F.min("id").alias("id")).withColumn("us", F.col("us") - F.lit(first))
    )
    span = last - first + 1
    level = cut_lineage(_jumps(events, step).select("key", "us", F.col("next").alias("to"), "prev"))

    def block(us: Column, size: int) -> Column:
        return us - us % F.lit(size)

    size, jumps, left = step, [], level.count()
    while size < span and left > ROWS_AT_ONCE:
        jumps.append((size, level.select("key", "us", "to")))
        size *= 2
        start = block(F.col("us"), size)
        entries = level.filter(F.col("prev").isNull() | (F.col("prev") < start + step)).select("key", "us", "prev", "to")
        onward = level.select("key", F.col("us").alias("to"), F.col("to").alias("beyond"))
        inside = block(F.col("to"), size) == start
        level = cut_lineage(
            entries.join(onward, ["key", "to"], "left").select(
                "key", "us", "prev", F.when(inside, F.col("beyond")).otherwise(F.col("to")).alias("to")
            )
        )

        left = level.count()

    if left <= ROWS_AT_ONCE:
        # What is left of each key leads from one entry of its blocks to the next.
        taken = cut_lineage(_follow(level))
    else:
        taken = level.filter(F.col("prev").isNull()).select("key", "us")
    for half, table in reversed(jumps):
        inside = block(F.col("to"), 2 * half) == block(F.col("us"), 2 * half)
        second = taken.join(table, ["key", "us"]).filter(inside).select("key", F.col("to").alias("us"))
        taken = cut_lineage(taken.unionByName(second))
    return taken.join(events, ["key", "us"]).select("key", (F.col("us") + F.lit(first)).alias("us"), "id")
