"""The blocked sparse product against plain sets."""

from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from spindrift.llm import ngramjoin
from spindrift.llm.catalog import QUERIES
from spindrift.llm.common import table
from spindrift.llm.ngramjoin import N, PERCENT, Words, least_overlap, ngram_components, ngram_set, prefix_length, product_links

CLASHING = ", row int, own int, band int, label int, side int, digest int, chunk int, size int, component int"


def plain_set(text, n=N):
    words = [w for w in "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").replace("\t", " ").replace("\n", " ").split(" ") if w]
    size = min(n, len(words))
    return {tuple(words[i : i + size]) for i in range(len(words) - size + 1)} if words else set()


def joined(n, pairs):
    up = list(range(n))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in pairs:
        up[root(a)] = root(b)
    return [root(x) for x in range(n)]


def alike(x, y, percent=PERCENT):
    return bool(x and y) and 100 * len(x & y) >= percent * len(x | y)


def brute(rows, percent=PERCENT):
    sets = [plain_set(t) for _, t in rows]
    roots = joined(len(rows), [(a, b) for a in range(len(rows)) for b in range(a) if alike(sets[a], sets[b], percent)])
    least = {}
    for (doc_id, _), r in zip(rows, roots):
        if doc_id is not None:
            least[r] = min(least.get(r, doc_id), doc_id)
    return sorted(
        ((d, len(s), (least.get(r) if s else d)) for (d, _), s, r in zip(rows, sets, roots)), key=lambda r: [(x is None, x) for x in r]
    )


def test_bounds_hold_for_every_pair_of_sizes():
    for x in range(1, 60):
        for y in range(x, 60):
            for shared in range(x + 1):
                if 100 * shared >= PERCENT * (x + y - shared):
                    assert shared >= least_overlap(x, y, PERCENT)
                    assert x - shared < prefix_length(x, PERCENT) and y - shared < prefix_length(y, PERCENT)
                else:
                    assert shared < least_overlap(x, y, PERCENT)


def random_sets(rng, n, kinds, length):
    sets = []
    for _ in range(n):
        if sets and rng.random() < 0.7:
            own = set(rng.choice(sets))
            for _ in range(rng.randint(0, max(1, len(own) // 8))):
                own.discard(rng.choice(sorted(own)))
                own.add(rng.randrange(kinds))
        else:
            own = {rng.randrange(kinds) for _ in range(rng.randint(1, length))}
        sets.append(own or {1})
    return sets


def test_product_joins_up_what_all_pairs_do(monkeypatch):
    monkeypatch.setattr(ngramjoin, "SETTLE_EVERY", 3)
    rng = random.Random(5)
    for trial in range(300):
        percent = rng.choice([50, 80, 85, 95])
        sets = random_sets(rng, rng.randint(1, 30), rng.choice([10, 60, 500]), rng.choice([4, 20, 60]))
        arrays = [np.array(sorted(s), np.uint64) for s in sets]
        near = [(a, b) for a in range(len(sets)) for b in range(a) if alike(sets[a], sets[b], percent)]
        got = product_links(arrays, percent)
        assert all((max(p), min(p)) in near for p in got) and len(got) < len(sets)
        want = joined(len(sets), near)
        assert len(set(zip(want, joined(len(sets), got)))) == len(set(want)) == len(set(joined(len(sets), got)))
        # Two sides, each joined up within itself.
        side = np.array([rng.randint(0, 1) for _ in sets])
        inner = [(a, b) for a, b in near if side[a] == side[b]]
        label = np.array(joined(len(sets), inner))
        across = product_links(arrays, percent, label, side)
        both = joined(len(sets), inner + across)
        assert len(set(zip(want, both))) == len(set(want)) == len(set(both))


def prose(rng, n):
    return " ".join(rng.choices([f"w{i}" for i in range(400)], k=n))


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(6)
    texts = [None, "", " \t ", "one", "One", "one two", "one  two\nthree four", "A b c D", "a b c d", "é É", "x " * 500]
    line = prose(rng, 30)
    for _ in range(40):
        base = prose(rng, rng.choice([8, 40, 200])).split(" ")
        for _ in range(rng.randint(1, 5)):
            near = list(base)
            for _ in range(rng.randint(0, 3)):
                near[rng.randrange(len(near))] = "changed"
            texts.append(" ".join(near) + rng.choice(["", " " + line, " " + line]))
    texts += [prose(rng, 3000), texts[20], texts[20], texts[20].upper()]
    return [*enumerate(texts), (None, texts[20]), (None, "alone without id"), (5, "twice"), (5, "twice")]


def report(spark, rows, **options):
    df = spark.createDataFrame([(*r, *[None] * 9) for r in rows], f"doc_id long, text string{CLASHING}").repartition(5)
    got = [tuple(r) for r in ngram_components(df, **options).select("doc_id", "n_shingles", "component_id").collect()]
    return sorted(got, key=lambda r: [(x is None, x) for x in r])


@pytest.mark.parametrize("block_bytes", [ngramjoin.ROW_BLOCK_BYTES, 3000])
def test_components_are_those_of_all_pairs(spark, rows, block_bytes, monkeypatch):
    monkeypatch.setattr(ngramjoin, "CHUNK_BYTES", 4000)
    assert report(spark, rows, block_bytes=block_bytes) == brute(rows)


def test_one_group_of_near_copies_over_many_blocks(spark):
    rng = random.Random(7)
    base = prose(rng, 120).split(" ")
    texts = []
    for _ in range(250):
        near = list(base)
        for _ in range(rng.randint(0, 5)):
            near[rng.randrange(len(near))] = f"n{rng.randrange(50)}"
        texts.append(" ".join(near))
    rows = list(enumerate(texts))
    assert report(spark, rows, block_bytes=20_000) == brute(rows)


def test_no_documents(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert ngram_components(df).columns == ["doc_id", "n_shingles", "component_id"]
    assert ngram_components(df).count() == 0


def test_hashes_tell_sets_apart():
    words = Words()
    for text in ("a b c d e", "a b c d e a b c d", "x", "", "long " * 70):
        assert len(ngram_set(text.encode(), words)) == len(plain_set(text))


def test_whole_query_on_a_table(spark):
    directory = "/root/testdata/sf0.001"
    docs = [tuple(r) for r in table(spark, directory, "documents").select("doc_id", "text").collect()]
    got = QUERIES["op13_ngram_jaccard"](spark, directory).select("doc_id", "n_shingles", F.col("component_id")).collect()
    assert sorted(map(tuple, got)) == brute(docs)
