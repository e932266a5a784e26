"""The throttle in batch and on streams."""

import random
from contextlib import contextmanager
from datetime import datetime, timedelta

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from pyspark.sql.readwriter import DataFrameWriter

from spindrift.operators import throttle as batch_throttle
from spindrift.operators.throttle import throttle
from spindrift.streaming.run import run_available
from spindrift.streaming.throttle import stream_throttle

START = datetime(2024, 1, 1)
SCHEMA = "key string, ts timestamp_ntz, id bigint"


@contextmanager
def paths_written():
    found, parquet = [], DataFrameWriter.parquet

    def write(self, path, *args, **kwargs):
        found.append(path)
        return parquet(self, path, *args, **kwargs)

    DataFrameWriter.parquet = write
    try:
        yield found
    finally:
        DataFrameWriter.parquet = parquet


def frame(spark, rows):
    return spark.createDataFrame([(k, START + timedelta(seconds=s), i) for k, s, i in rows], SCHEMA)


def expected(rows, delay):
    taken, last = set(), {}
    for key, s, i in sorted(rows, key=lambda r: (r[0], r[1], r[2])):
        if key not in last or s > last[key] + delay:
            last[key] = s
            taken.add((key, START + timedelta(seconds=s), i))
    return taken


def accepted(df):
    rows = [tuple(r) for r in df.collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


@pytest.mark.parametrize("hot_rows", [0, 3, 10**9])
def test_strict_delay(spark, hot_rows):
    rows = [("k", s, i) for i, s in enumerate((1, 3, 6, 7, 12))] + [("j", 5, 9), ("j", 5, 8)]
    got = accepted(throttle(frame(spark, rows), "key", "ts", "id", 5, hot_rows))
    assert got == expected(rows, 5) == {
        ("k", START + timedelta(seconds=1), 0), ("k", START + timedelta(seconds=7), 3), ("j", START + timedelta(seconds=5), 8),
    }


@pytest.mark.parametrize("seed,n,span,delay", [(1, 400, 50, 7), (2, 300, 100_000, 10), (3, 300, 3, 60), (4, 500, 1000, 1.5)])
def test_hot_keys_equal_brute_force(spark, seed, n, span, delay, monkeypatch):
    """One key holds most rows; dense, sparse, shorter than the delay, and with bursts."""
    rng = random.Random(seed)
    rows = [
        (rng.choice("aaaab"), round(rng.choice((rng.random(), 0.5)) * span + rng.random() * 3, 3), i) for i in range(n)
    ]
    for hot_rows in (0, n // 2):
        assert accepted(throttle(frame(spark, rows), "key", "ts", "id", delay, hot_rows)) == expected(rows, delay)
    monkeypatch.setattr(batch_throttle, "ROWS_AT_ONCE", 20 * (seed % 2))  # several levels, then all of them
    assert accepted(throttle(frame(spark, rows).repartition(5), "key", "ts", "id", delay, 0)) == expected(rows, delay)


def test_a_burst_beside_a_stray_date_is_spread_over_tasks(spark, tmp_path):
    """All events of a hot key within one second, and one a century away."""
    n = 40_000
    rows = spark.range(n).select(
        F.lit("k").alias("key"), F.timestamp_micros(F.lit(1_700_000_000_000_000) + F.col("id") * 25).alias("ts"), "id",
    ).unionByName(spark.createDataFrame([("k", datetime(1924, 1, 1), -1)], "key string, ts timestamp, id long"))
    before = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        with paths_written() as written:
            got = throttle(rows, "key", "ts", "id", 0.01, hot_rows=1000).collect()
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before)
    times, want, last = sorted(25 * i for i in range(n)), [-1], None
    for i, t in enumerate(times):
        if last is None or t > last + 10_000:
            want.append(i)
            last = t
    assert sorted(r.id for r in got) == want
    (jumps,) = [p for p in written if "/jumps-" in p]
    sizes = [r["count"] for r in spark.read.parquet(jumps).groupBy("part").count().collect()]
    assert len(sizes) >= 6 and max(sizes) < 0.3 * sum(sizes)


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.sampled_from("ab"), st.integers(0, 40)), min_size=1, max_size=40), st.integers(1, 9))
def test_any_log(spark, log, delay):
    rows = [(k, s, i) for i, (k, s) in enumerate(log)]
    df = frame(spark, rows)
    assert accepted(throttle(df, "key", "ts", "id", delay)) == expected(rows, delay)
    assert accepted(throttle(df, "key", "ts", "id", delay, 0)) == expected(rows, delay)


def write_batches(spark, path, batches):
    """One file per batch, in order of arrival."""
    for number, rows in enumerate(batches):
        frame(spark, rows).coalesce(1).write.mode("append").parquet(f"{path}/b{number:03d}")


def test_stream_equals_batch_over_many_batches(spark, tmp_path):
    rng = random.Random(5)
    rows = sorted(((rng.choice("abc"), rng.randrange(2000), i) for i in range(300)), key=lambda r: r[1])
    write_batches(spark, tmp_path / "in", [rows[i : i + 60] for i in range(0, 300, 60)])
    events = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/*")
    stream = stream_throttle(events, "key", "ts", "id", 20, "10 minutes")
    assert accepted(run_available(stream, "t", str(tmp_path / "out"))) == expected(rows, 20)


def test_stream_takes_a_large_key_in_pieces(spark, tmp_path):
    """One key holds a whole micro-batch, without order; pieces, blocks and runs are small."""
    rng = random.Random(8)
    rows = [("k", rng.randrange(3000), i) for i in range(1500)] + [("j", 5, 9000)]
    rng.shuffle(rows)
    write_batches(spark, tmp_path / "in", [rows])
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, "60")
    try:
        for number, options in enumerate([{"block_rows": 7, "most_runs": 3}, {}]):
            events = spark.readStream.schema(SCHEMA).parquet(f"{tmp_path}/in/*")
            stream = stream_throttle(events, "key", "ts", "id", 11, "1 day", **options)
            assert accepted(run_available(stream, "t", str(tmp_path / f"out{number}"))) == expected(rows, 11)
    finally:
        spark.conf.set(key, before)


def test_stream_goes_on_and_drops_late_events(spark, tmp_path):
    def run():
        events = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/*")
        return accepted(run_available(stream_throttle(events, "key", "ts", "id", 5, "1 minute"), "t", str(tmp_path / "out")))

    write_batches(spark, tmp_path / "in", [[("k", 0, 1), ("k", 3, 2)]])
    assert run() == expected([("k", 0, 1)], 5)
    frame(spark, [("k", 5, 3), ("k", 6, 4), ("j", 1000, 5)]).coalesce(1).write.parquet(f"{tmp_path}/in/b100")
    assert run() == expected([("k", 0, 1), ("k", 6, 4), ("j", 1000, 5)], 5)
    # The watermark is past 900 seconds now: too late for a new key, and the state of k is gone.
    frame(spark, [("m", 100, 6), ("k", 1001, 7)]).coalesce(1).write.parquet(f"{tmp_path}/in/b101")
    assert run() == expected([("k", 0, 1), ("k", 6, 4), ("j", 1000, 5), ("k", 1001, 7)], 5)
