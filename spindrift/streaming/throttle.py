"""The politeness throttle on a stream."""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from spindrift.functions.times import from_micros, micros

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"

# Events in a block of a sorted run, and runs that are merged at once.
BLOCK_ROWS = 2_000
MOST_RUNS = 32


class Rest(StatefulProcessor):
    """Accepts a key's events in order of time.

    What is kept of a key is the time of its last accepted event, until a timer
    at the end of its rest.  The events of a micro-batch come in pieces without
    order: each piece that may still be accepted becomes a sorted run, whose
    blocks wait in a map of the state store, and runs are merged block by block.
    However many events a key has, one piece and a block of each of ``MOST_RUNS``
    runs are in memory.
    """

    def __init__(self, step: int, block_rows: int, most_runs: int):
        self.step, self.block_rows, self.most_runs = step, block_rows, most_runs

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "us bigint")
        self.blocks = handle.getMapState("blocks", "run int, block int", "rows binary")

    def handleInputRows(self, key, rows, timerValues) -> Iterator:
        import pandas as pd

        held = self.last.get()
        before = rested = held[0] + self.step if held is not None else None
        runs: list[tuple[int, int]] = []  # number and blocks of each waiting run
        number, only = 0, None
        for piece in rows:
            own = piece[["us", "id"]]
            if rested is not None:
                own = own[own["us"] > rested]
            # Of events at one time the smallest id is the one that counts.
            own = own.sort_values(["us", "id"]).drop_duplicates("us")
            if not len(own):
                continue
            if only is None and not runs:
                only = own
                continue
            for run in (only, own):
                if run is not None:
                    runs.append((number, self._store(number, [run])))
                    number += 1
            only = None
            if len(runs) >= self.most_runs:
                runs, number = [(number, self._store(number, self._merged(runs)))], number + 1
        for block in [only] if only is not None else self._merged(runs):
            taken, times, at = [], block["us"].to_numpy(), 0
            while at < len(times):
                at = int(times.searchsorted(rested, side="right")) if rested is not None else at
                if at < len(times):
                    taken.append(at)
                    rested = int(times[at]) + self.step
            if taken:
                chosen = block.iloc[taken]
                yield pd.DataFrame({"key": [key[0]] * len(chosen), "us": chosen["us"], "id": chosen["id"]})
        if rested is not None and rested != before:
            self._rest(rested, timerValues.getCurrentWatermarkInMs(), before is not None)

    def _rest(self, rested: int, watermark: int, known: bool) -> None:
        for timer in list(self.handle.listTimers()) if known else ():
            self.handle.deleteTimer(timer)
        clear_at = rested // 1000 + 1
        if clear_at > watermark:
            self.last.update((rested - self.step,))
            self.handle.registerTimer(clear_at)
        else:
            self.last.clear()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator:
        self.last.clear()
        return iter(())

    def _store(self, run: int, sorted_rows) -> int:
        """Write a run in blocks; gives their number."""
        import pandas as pd

        n, waiting = 0, None
        for rows in sorted_rows:
            waiting = rows if waiting is None else pd.concat([waiting, rows])
            while len(waiting) >= self.block_rows:
                self.blocks.updateValue((run, n), (self._packed(waiting.iloc[: self.block_rows]),))
                waiting, n = waiting.iloc[self.block_rows :], n + 1
        if waiting is not None and len(waiting):
            self.blocks.updateValue((run, n), (self._packed(waiting),))
            n += 1
        return n

    def _packed(self, rows) -> bytes:
        batch = pa.RecordBatch.from_pandas(rows, preserve_index=False)
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, batch.schema) as out:
            out.write_batch(batch)
        return sink.getvalue().to_pybytes()

    def _take(self, run: int, block: int):
        (packed,) = self.blocks.getValue((run, block))
        self.blocks.removeKey((run, block))
        return pa.ipc.open_stream(packed).read_pandas()

    def _merged(self, runs: list[tuple[int, int]]) -> Iterator:
        """All rows of some runs in order, in blocks: as far as the run that ends first has been read."""
        import pandas as pd

        left = {run: iter(range(blocks)) for run, blocks in runs}
        waiting = {run: self._take(run, next(it)) for run, it in left.items()}
        ends = [(int(rows["us"].iloc[-1]), run) for run, rows in waiting.items()]
        heapq.heapify(ends)
        while ends:
            end, first = heapq.heappop(ends)
            parts = []
            for run, rows in list(waiting.items()):
                upto = int(rows["us"].to_numpy().searchsorted(end, side="right"))
                if upto:
                    parts.append(rows.iloc[:upto])
                    waiting[run] = rows.iloc[upto:]
            block = next(left[first], None)
            if block is None:
                del waiting[first]
            else:
                rows = self._take(first, block)
                # Times of a run are distinct, so this block begins behind what was read.
                waiting[first] = rows
                heapq.heappush(ends, (int(rows["us"].iloc[-1]), first))
            if parts:
                yield pd.concat(parts).sort_values(["us", "id"]).drop_duplicates("us")


def stream_throttle(
    events: DataFrame, key: str, ts: str, id: str, delay: float, watermark: str = "1 day",
    block_rows: int = BLOCK_ROWS, most_runs: int = MOST_RUNS,
) -> DataFrame:
    """Accepted events as ``(key, ts, id)``; events behind the watermark are dropped.

    So are events that come after a later one of their key was accepted, within
    the watermark or not: what has been accepted stands.

    A key's state is the time of its last accepted event.  It is dropped once the
    watermark has passed the end of the rest, as any later event is then accepted.
    The state store is RocksDB's, so neither the states of all keys nor the
    events of one key in a micro-batch need fit into memory.
    """
    step = round(delay * 1_000_000)
    kind = events.schema[ts].dataType
    narrow = (
        events.select(F.col(key).alias("key"), micros(F.col(ts), kind).alias("us"), F.col(id).alias("id"))
        .filter(F.col("key").isNotNull() & F.col("us").isNotNull())
        .withColumn("ts", F.timestamp_micros("us"))
        .withWatermark("ts", watermark)
    )
    types = {f.name: f.dataType for f in narrow.schema.fields}
    accepted_schema = T.StructType(
        [T.StructField("key", types["key"]), T.StructField("us", T.LongType()), T.StructField("id", types["id"])]
    )
    events.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    accepted = narrow.groupBy("key").transformWithStateInPandas(
        Rest(step, block_rows, most_runs), accepted_schema, "Append", "EventTime"
    )
    restored = from_micros(F.col("us"), kind)
    return accepted.select(F.col("key").alias(key), restored.alias(ts), F.col("id").alias(id))
