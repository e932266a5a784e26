"""The state as a log: versions, merged reads, bases by bucket, and leases."""

from __future__ import annotations

import random
from datetime import datetime, timedelta
from pathlib import Path

import pytest

from spindrift.sources import statelog, tables
from spindrift.sources.statelog import Change, expire, latest_version, load_version, save_first, save_version

T0 = datetime(2024, 1, 1)


def frame(spark, name, rows):
    return spark.createDataFrame(rows, tables.STATE_SCHEMAS[name]).coalesce(1)


def start(spark, queue=40, domains=10):
    return tables.empty_state(spark).with_tables(
        queue=frame(spark, "queue", [(i, f"http://h{i % domains}/{i}", T0, i % domains + 1) for i in range(1, queue + 1)]),
        domain=frame(spark, "domain", [(i, f"h{i - 1}", T0) for i in range(1, domains + 1)]),
        protocols=frame(spark, "protocols", [(0, "http"), (1, "https")]),
    )


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def files(directory, name):
    return {str(p.relative_to(directory)) for p in Path(directory, name).rglob("*.parquet")}


def test_versions_are_those_of_a_plain_table(spark, tmp_path):
    rng, directory = random.Random(2), str(tmp_path)
    state = start(spark)
    save_first(state, directory)
    queue = {r[0]: r for r in rows(state.queue)}
    domain, url, want = {r[0]: r for r in rows(state.domain)}, [], {}
    want[0] = sorted(queue.values()), sorted(domain.values()), []
    for version in range(1, 8):
        gone = rng.sample(sorted(queue), rng.randint(0, 6))
        new = [(1000 * version + i, f"u{i}", T0, 1) for i in range(rng.randint(0, 4))]
        changed = [(i, f"h{i}", T0 + timedelta(seconds=version)) for i in rng.sample(range(1, 15), 3)]
        links = [(100 * version + i, "/", 1, 0) for i in range(2)]
        save_version(spark, {
            "queue": Change(frame(spark, "queue", new), spark.createDataFrame([(i,) for i in gone], "id long")),
            "domain": Change(frame(spark, "domain", changed)),
            "url": Change(frame(spark, "url", links)),
            "marks": Change(whole=frame(spark, "marks", [("queue", 1000 * version + 10)])),
        }, directory, version, compact_every=3)
        for i in gone:
            del queue[i]
        queue |= {r[0]: r for r in new}
        domain |= {r[0]: r for r in changed}
        url += links
        want[version] = sorted(queue.values()), sorted(domain.values()), sorted(url)
    assert latest_version(spark, directory) == 7
    assert [b for b, _ in statelog.versions(spark, directory).values()].count(0) == 4
    for version, (q, d, u) in want.items():
        held = load_version(spark, directory, version)
        assert (rows(held.queue), rows(held.domain), rows(held.url)) == (q, d, u)
        assert held.tried.count() == 0 and held.protocols.count() == 2
    assert load_version(spark, directory, 7).last_id().__class__ and rows(load_version(spark, directory, 7).marks) == [("queue", 7010)]

    # A reader of an old version keeps it while its lease lasts; what only dropped versions used goes.
    assert expire(spark, directory, lease=3600) == []
    reader = load_version(spark, directory, 6)
    times = {v: at for v, (_, at) in statelog.versions(spark, directory).items()}
    assert expire(spark, directory, lease=times[7] - times[6] + 0.001, now=times[7]) == [0, 1, 2, 3, 4, 5]
    assert (rows(reader.queue), rows(reader.domain), rows(reader.url)) == want[6]
    last = load_version(spark, directory, 7)
    assert (rows(last.queue), rows(last.domain), rows(last.url)) == want[7]
    assert not files(directory, "queue/added/version=1") and not Path(directory, "manifest", "base=0").exists()


def test_an_unchanged_queue_costs_no_row_and_bases_keep_other_buckets(spark, tmp_path):
    directory = str(tmp_path)
    save_first(start(spark, queue=400), directory)
    before = files(directory, "queue/base")
    for version in (1, 2):
        save_version(spark, {"domain": Change(frame(spark, "domain", [(1, "h0", T0 + timedelta(version))])), "queue": Change(frame(spark, "queue", []))}, directory, version, compact_every=2)
    assert sum(spark.read.parquet(f"{directory}/queue/added/version={v}").count() for v in (1, 2)) == 0
    assert files(directory, "queue/base") == before
    new = files(directory, "domain/base/base=2")
    assert len({Path(f).parent.name for f in new}) == 1
    save_version(spark, {"queue": Change(None, spark.createDataFrame([(7,)], "id long"))}, directory, 3)
    save_version(spark, {"queue": Change(None, spark.createDataFrame([(7,)], "id long"))}, directory, 4, compact_every=2)
    after = files(directory, "queue/base")
    assert before < after and len({Path(f).parent.name for f in after - before}) == 1
    kept = load_version(spark, directory, 3)
    assert kept.queue.count() == 399 and kept.queue.filter("id = 7").isEmpty()
    save_version(spark, {}, directory, 5)
    assert load_version(spark, directory, 5).queue.count() == 399
    assert rows(load_version(spark, directory, 5).domain)[0] == (1, "h0", T0 + timedelta(2))


def test_a_version_that_was_not_finished_does_not_count(spark, tmp_path, monkeypatch):
    directory = str(tmp_path)
    save_first(start(spark), directory)
    new = Change(frame(spark, "queue", [(99, "u", T0, 1)]))
    with monkeypatch.context() as m:
        m.setattr(statelog, "_write_version", lambda *a: 1 / 0)
        with pytest.raises(ZeroDivisionError):
            save_version(spark, {"queue": new}, directory, 1)
    assert latest_version(spark, directory) == 0
    assert load_version(spark, directory, 0).queue.count() == 40
    for _ in range(2):  # written again, it is the same version
        save_version(spark, {"queue": new}, directory, 1)
        assert load_version(spark, directory, 1).queue.count() == 41
