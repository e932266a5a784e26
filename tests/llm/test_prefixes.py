"""The prefix trie against brute force, on hostile rows and across many ranges."""

from __future__ import annotations

import hashlib
import random
import zlib
from collections import defaultdict

import pytest

from spindrift.llm.prefixes import prefix_trie

COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
CLASHING = ", a int, b int, depth int, part int, pos int, least int, weight int, owned int, total int, base int, h int, head int"
SCHEMA = f"conv_id long, turn long, role string, text string{CLASHING}"


def brute(rows):
    def digest(row):
        role, text = row[2] or "", row[3] or ""
        return hashlib.md5(f"{len(role)}:{role}:{text}".encode()).hexdigest()

    own = defaultdict(list)
    for row in sorted((r for r in rows if r[0] is not None), key=lambda r: (r[1] is not None, r[1] or 0, digest(r))):
        own[row[0]].append((row[2] or "", row[3] or ""))
    rebuilt = {}
    for c in own:
        h = zlib.crc32(str(c).encode()) % 6
        base = c - (abs(c) % 100 if c >= 0 else -(abs(c) % 100))
        rebuilt[c] = tuple(own.get(base, [])[:h] + own[c][h:])
    members = defaultdict(list)
    for c, turns in rebuilt.items():
        for d in range(len(turns) + 1):
            members[turns[:d]].append(c)
    children = defaultdict(list)
    for node in members:
        if node:
            children[node[:-1]].append(node)
    out = []
    for node, own_members in members.items():
        below = [n for n in members if n[: len(node)] == node]
        ends = sorted(c for c in own_members if rebuilt[c] == node)
        out.append((
            min(own_members), len(node), min(members[node[:-1]]) if node else None, len(own_members), len(children[node]),
            sum(not children[n] for n in below), sum((len(members[n]) - 1) * len(n[-1][1]) for n in below if n),
            hashlib.sha256(",".join(map(str, ends)).encode()).hexdigest(),
        ))
    return out


def key(row):
    return tuple((x is None, x) for x in row)


def same(spark, rows):
    df = spark.createDataFrame([(*r, *[None] * 12) for r in rows], SCHEMA)
    got = [tuple(r) for r in prefix_trie(df).select(*COLUMNS).collect()]
    assert sorted(got, key=key) == sorted(brute(rows), key=key)
    return got


def test_random_conversations(spark):
    rng = random.Random(1)
    rows = []
    for c in [*range(-3, 30), *range(95, 125), 200, 300, 301, 399, 10**12]:
        for t in range(rng.randint(1, 7)):
            rows.append((c, t, rng.choice(["user", "bot", None]), rng.choice(["a", "bé", "", None, "c" * 50])))
    rng.shuffle(rows)
    assert len(same(spark, rows)) > 50


def test_hostile_turns(spark):
    rows = [(1, None, None, None), (1, None, "user", "x"), (1, 3, "user", ""), (1, 3, "user", ""), (1, 3, "", "user"), (None, 1, "user", "lost")]
    rows += [(100 + i, 0, "user", "same") for i in range(8)] + [(205, 5, "r", "t"), (206, -1, "r", "t")]
    rows += [(7, 1, "user", "y" * 100_000)]
    same(spark, rows)


def test_no_conversations(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert prefix_trie(df).columns == COLUMNS
    assert prefix_trie(df).count() == 0
    assert prefix_trie(spark.createDataFrame([(None, 1, "user", "x", *[None] * 12)], SCHEMA)).count() == 0


@pytest.mark.parametrize("partitions", ["2", "23"])
def test_a_long_conversation_and_many_copies_over_ranges(spark, partitions):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        rows = [(4, t, "user", f"w{t % 9}") for t in range(400)] + [(5, t, "user", f"w{t % 9}") for t in range(400)]
        rows += [(1000 + i, t, "bot", "copy") for i in range(120) for t in range(6)]
        same(spark, rows)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
