"""The operators as Spark jobs: brute force on small tables, hostile rows, and whole test tables."""

from __future__ import annotations

import base64
import hashlib
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from spindrift.llm import components, fmindex, hmm, packing, quality, repeats, setjoin, shards, simhash, vptree
from spindrift.llm.catalog import QUERIES
from spindrift.llm.common import identified, table
from spindrift.llm.fmindex import contamination, decontaminate, with_hits
from spindrift.llm.langid import language_report
from spindrift.llm.warc import archived_pages

SMALL = "/root/testdata/sf0.001"
# Names that the operators use themselves, as columns of the input.
CLASHING = "key string, shard int, bucket int, n int, part int, rank int, code int, node int, row int, doc int, tie int, hits int, starts int, score int"


@pytest.fixture(scope="module")
def hostile(spark):
    """Nulls, empty and very long texts, repeated rows and ids, and clashing column names."""
    rng = random.Random(4)
    words = ["alpha", "beta", "gamma", "delta", "Epsilon", "é", "the"]
    prose = " ".join(rng.choices(words, k=400))
    texts = [None, "", " ", prose, prose, prose[:700], prose.upper(), "x" * 30_000, "a\n\nb", " ".join(rng.choices(words, k=60_000))]
    rows = [(i, t) for i, t in enumerate(texts)] + [(3, prose), (None, prose), (None, None), (7, "other")]
    extra = [None] * 14
    schema = f"doc_id long, text string, lang string, source string, n_chars long, {CLASHING}"
    return spark.createDataFrame([(i, t, "en" if i else None, None, None, *extra) for i, t in rows], schema)


@pytest.fixture(scope="module")
def nothing(hostile):
    return hostile.filter("false")


def rows_of(df):
    return [tuple(r) for r in df.collect()]


# Packing.


def check_packing(docs, size):
    docs_rows = rows_of(docs.select("doc_id", "text"))
    out = packing.pack_documents(docs, max_tokens=size).collect()
    tokens = packing.CachedTokenizer(packing.tokenizer_path())
    want = Counter()
    for doc_id, text in docs_rows:
        ids = np.append(np.frombuffer(tokens.ids(text or ""), "<u4"), np.uint32(2))
        first = len(ids) % size or size
        edges = [0, *range(first, len(ids) + 1, size)]
        for i, (a, b) in enumerate(zip(edges, edges[1:])):
            want[doc_id, i, a, b - a, zlib.crc32(ids[a:b].astype("<u4").tobytes())] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in out) == want
    sequences = defaultdict(list)
    for r in out:
        sequences[r.sequence_id].append((r.offset, r.length))
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= size
    total = sum(r.length for r in out)
    assert len(sequences) <= -(-total // size) * 1.02 + 3


def test_packing_of_hostile_rows(hostile, nothing):
    check_packing(hostile, 64)
    assert rows_of(packing.pack_documents(nothing)) == []


def test_packing_of_documents(spark):
    check_packing(table(spark, SMALL, "documents"), 1024)


# Archives.


@pytest.mark.parametrize("version,least", [(1, 0), (2, 5)])
def test_archives(spark, version, least):
    pages = [(1, "http://h/a b", "one"), (0, "http://h/\n", "one"), (2, None, None), (3, "u", ""), (4, "", "z\r\n\r\nWARC/1.0\r\n\né"),
             (5, "v", "longer"), (5, "v", "longer"), (None, "w", "longer"), (9, "w" * 3000, "y" * 200_000)]
    df = spark.createDataFrame([(*p, "x", 1) for p in pages], "page_id long, url string, html string, record string, file int")
    got = Counter((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in archived_pages(df, version, least).collect())
    groups = defaultdict(list)
    for page_id, _, html in pages:
        groups[html or ""].append(page_id)
    want = Counter()
    for payload, ids in groups.items():
        data = payload.encode()
        first = min((i for i in ids if i is not None), default=None)
        seen = False
        for i in ids:
            revisit = len(data) >= least and not (i == first and not seen)
            seen |= i == first
            digest = base64.b32encode(hashlib.sha1(data).digest()).decode()
            want[i, len(data), digest, "revisit" if revisit else "response", first if revisit else None] += 1
    assert got == want
    assert rows_of(archived_pages(df.filter("false"), version)) == []


# Shards.


def test_shards(hostile, nothing):
    out = shards.shard_by_bytes(hostile, 4).collect()
    assert len(out) == hostile.count()
    by_text, slots, held = defaultdict(set), defaultdict(list), Counter()
    for r in out:
        by_text[r.text_crc32, r.size].add(r.shard)
        slots[r.shard].append(r.slot)
        held[r.shard] += r["size"]
    assert all(len(s) == 1 for s in by_text.values())
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert Counter(r["size"] for r in out) == Counter(len((t or "").encode()) + 1 for _, t in rows_of(hostile.select("doc_id", "text")))
    assert rows_of(shards.shard_by_bytes(nothing)) == []


def test_shards_have_the_smallest_capacity(spark, monkeypatch):
    monkeypatch.setattr(shards, "SLICES", 4)  # several rounds
    docs = table(spark, SMALL, "documents")
    out = shards.shard_by_bytes(docs, 16).collect()
    held = Counter()
    for r in out:
        held[r.shard] += r["size"]
    groups = defaultdict(int)
    for _, text in rows_of(docs.select("doc_id", "text")):
        groups[hashlib.sha256(text.encode()).hexdigest()] += len(text.encode()) + 1
    assert max(held.values()) == shards.smallest_capacity([groups[k] for k in sorted(groups)], 16)


@pytest.mark.parametrize("every", [2, 10])
def test_shards_of_a_table_with_a_frequent_text(spark, monkeypatch, every):
    monkeypatch.setattr(shards, "SLICES", 8)
    docs = spark.range(6000).select(
        F.col("id").alias("doc_id"),
        F.when(F.col("id") % every == 0, F.repeat(F.lit("copy "), 60)).otherwise(F.concat(F.lit("text "), F.col("id").cast("string"))).alias("text"),
    )
    held = Counter()
    for r in shards.shard_by_bytes(docs, 16).collect():
        held[r.shard] += r["size"]
    groups = defaultdict(int)
    for _, text in rows_of(docs):
        groups[hashlib.sha256(text.encode()).hexdigest()] += len(text.encode()) + 1
    assert max(held.values()) == shards.smallest_capacity([groups[k] for k in sorted(groups)], 16)


# Neighbours.


@pytest.mark.parametrize("factor", [1.0, vptree.FACTOR])
def test_neighbours(spark, factor):
    rng = np.random.default_rng(3)
    rows = [(int(i), [float(x) for x in v]) for i, v in enumerate(rng.normal(size=(300, 6)).astype(np.float32))]
    rows += [(400 + i, rows[0][1]) for i in range(40)]  # ties
    bad = [(500, None), (520, [0.0] * 6), (540, [1.0, None, 1.0, 1.0, 1.0, 1.0]), (560, [float("nan")] * 6), (580, [float("inf")] * 6), (600, []), (None, [1.0] * 6), (620, [1.0, 2.0])]
    df = spark.createDataFrame([(*r, 1) for r in rows + bad], "vec_id long, embedding array<float>, row int")
    out = vptree.neighbours(df, F.col("vec_id") % 20 == 0, 20, factor, shard_rows=100, block_rows=4, leaf=8)
    got = defaultdict(list)
    for r in out.orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.vec_id, r.score))
        assert r.rank == len(got[r.query_id])
    ids, wide = np.array([i for i, _ in rows]), np.array([v for _, v in rows], np.float32).astype(float)
    assert set(got) == {i for i in ids.tolist() if i % 20 == 0}
    found = 0
    for q, near in got.items():
        score = wide @ wide[list(ids).index(q)]
        order = [j for j in np.lexsort((ids, -np.round(score, 12))) if ids[j] != q][:20]
        if factor == 1.0:
            assert [i for i, _ in near] == ids[order].tolist()
        found += len({i for i, _ in near} & set(ids[order].tolist()))
        assert all(abs(s - score[list(ids).index(i)]) < 1e-12 for i, s in near)
    assert found >= 0.9 * 20 * len(got)
    assert rows_of(vptree.neighbours(df.filter("false"), F.lit(True))) == []


def test_recall_on_embeddings(spark):
    directory = "/root/testdata/sf0.01"
    rows = rows_of(table(spark, directory, "embeddings").select("vec_id", "embedding"))
    ids, wide = np.array([i for i, _ in rows]), np.array([v for _, v in rows], float)
    got = defaultdict(set)
    for r in QUERIES["op4_vantage_point_trees"](spark, directory).collect():
        got[r.query_id].add(r.vec_id)
    shared = 0
    for q in got:
        score = wide @ wide[ids == q][0]
        shared += len(got[q] & set([i for i in ids[np.argsort(-score)].tolist() if i != q][:20]))
    assert len(got) == (ids % 20 == 0).sum() and shared >= 0.9 * 20 * len(got)


# Decontamination.


def test_contamination(spark, hostile, nothing):
    items = spark.createDataFrame(
        [(1, "alpha beta", 1), (2, "", 1), (3, None, 1), (None, "gamma the", 1), (10, "B", 1), (10, "other", 1), (5, "é é é é é é é é é é é", 1)],
        "item_id long, text string, hits int",
    )
    got = contamination(hostile, items, 3).collect()
    from test_units import brute_hits

    texts = [(i, (t or "").encode()) for i, t in rows_of(hostile.select("doc_id", "text"))]
    known = [(None if i is None else str(i), (t or "").encode()) for i, t, _ in rows_of(items)]
    want = Counter()
    for (doc_id, _), (n, hit, found) in zip(texts, brute_hits([t for _, t in texts], known, 3)):
        digest = hashlib.sha256(",".join(found).encode()).hexdigest()
        want[doc_id, n, hit, len(found), digest, hit > 0] += 1
    assert Counter(map(tuple, got)) == want
    blocks = with_hits(hostile.select("doc_id", "text"), items, 3, block_bytes=20).select("doc_id", "hits").collect()
    whole = with_hits(hostile.select("doc_id", "text"), items, 3).select("doc_id", "hits").collect()
    key = lambda r: (r.doc_id is None, r.doc_id or 0, str(r.hits))
    assert sorted(blocks, key=key) == sorted(whole, key=key)
    assert rows_of(contamination(nothing, items)) == [] and not any(r.contaminated for r in contamination(hostile, items.filter("false")).collect())
    cut = decontaminate(hostile, items, 3)
    assert cut.columns == hostile.columns and cut.count() == hostile.count()
    pieces = decontaminate(hostile, items, 3, block_bytes=20)
    assert Counter(r.text for r in pieces.collect()) == Counter(r.text for r in cut.collect())
    assert not any(r.contaminated for r in contamination(cut.filter("doc_id = 0 or doc_id = 7"), items, 3).collect())


# Repeats.


def brute_repeats(rows, length):
    seen, out = set(), defaultdict(list)
    for doc_id, text in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0)):
        data = (text or "").encode()
        gone = np.zeros(len(data), bool)
        for i in range(len(data) - length + 1):
            part = data[i : i + length]
            if part in seen:
                gone[i : i + length] = True
            seen.add(part)
        runs = int((np.diff(np.concatenate(([0], gone.astype(int)))) == 1).sum())
        kept = bytes(np.frombuffer(data, np.uint8)[~gone])
        out[doc_id].append((len(data), int(gone.sum()), runs, hashlib.sha256(kept).hexdigest()))
    return {k: sorted(v) for k, v in out.items()}


@pytest.mark.parametrize("limits", [{}, {"hot_segments": 2}, {"shard_symbols": 500}])
def test_repeats(hostile, nothing, limits):
    few = hostile.filter("doc_id is null or doc_id < 7").coalesce(1)
    got = defaultdict(list)
    for r in repeats.repeat_report(few, 20, 8, **limits).collect():
        got[r.doc_id].append(tuple(r)[1:])
    # Rows that share an id may stand in either order, so their sums are compared.
    want = brute_repeats(rows_of(few.select("doc_id", "text")), 20)
    assert {k: sorted(x[0] for x in v) for k, v in got.items()} == {k: sorted(x[0] for x in v) for k, v in want.items()}
    assert {k: sum(x[1] for x in v) for k, v in got.items()} == {k: sum(x[1] for x in v) for k, v in want.items()}
    assert all(sorted(got[k]) == want[k] for k in want if len(want[k]) == 1)
    assert rows_of(repeats.repeat_report(nothing)) == []


def test_benchmark_blocks_are_bounded(spark):
    """Repeated rows are one item; an item larger than a block goes as pieces that hold all its windows."""
    rng = random.Random(7)
    giant = " ".join(f"w{rng.randrange(500)}" for _ in range(4000))
    rows = [("a", "one two three four five six seven eight nine ten eleven")] * 500 + [("g", giant), ("s", "short item"), ("n", None), (None, giant[:200])]
    benchmark = spark.createDataFrame(rows, "item_id string, text string")
    blocks = list(fmindex.item_blocks(benchmark, 2000, 10))
    assert sum(len(b) for b in blocks) < 400
    assert max(sum(len(t) for _, t in b) for b in blocks) < 4000
    windows = {(i, tuple(w[k : k + 10])) for b in blocks for i, t in b if i == "g" for w in [t.decode().split()] for k in range(len(w) - 9)}
    whole = giant.split()
    assert windows == {("g", tuple(whole[k : k + 10])) for k in range(len(whole) - 9)}
    texts = [giant[3000:3400], "x one two three four five six seven eight nine ten y", "a short item b", "nothing"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    one = with_hits(docs, benchmark).select("doc_id", "hits.*").collect()
    many = with_hits(docs, benchmark, block_bytes=2000).select("doc_id", "hits.*").collect()
    assert sorted(one) == sorted(many) and [len(r.starts) for r in sorted(one)] == [1, 1, 1, 0]


def test_repeats_of_documents(spark):
    docs = table(spark, SMALL, "documents")
    want = brute_repeats(rows_of(docs.select("doc_id", "text")), 100)
    assert {r.doc_id: [tuple(r)[1:]] for r in repeats.repeat_report(docs).collect()} == want
    cut = repeats.cut_repeats(docs)
    assert cut.columns == docs.columns
    assert all(r.n_chars == len(r.text) for r in cut.collect())


def test_hostile_rows_keep_their_columns(hostile):
    few = hostile.filter("doc_id is null or doc_id < 7")
    cut = repeats.cut_repeats(few, 20, 8)
    assert cut.schema == few.schema and cut.count() == few.count()


# Near duplicates.


def linked(codes, near):
    label = np.arange(len(codes))
    pairs = [(i, j) for i in range(len(codes)) for j in range(i + 1, len(codes)) if near(codes[i], codes[j])]
    simhash.join(label, np.array([a for a, _ in pairs], int), np.array([b for _, b in pairs], int))
    return label


@pytest.mark.parametrize("split_rows", [simhash.SPLIT_ROWS, 3])
def test_three_bits_link(spark, split_rows):
    rng = random.Random(8)
    codes = [0, *(rng.getrandbits(64) for _ in range(20))]
    for _ in range(150):
        codes.append(rng.choice(codes) ^ sum(1 << rng.randrange(64) for _ in range(rng.randint(1, 5))) % (1 << 64))
    codes = sorted(set(codes))
    signed = [c - (1 << 64) if c >> 63 else c for c in codes]
    df = spark.createDataFrame([(c, [c]) for c in signed], "node long, code array<long>")
    got = {r.node: r.component for r in components.components(simhash.links(df, simhash.EXACT, split_rows)).collect()}
    label = linked(codes, lambda a, b: (a ^ b).bit_count() <= 3)
    groups = defaultdict(list)
    for c, at in zip(signed, label):
        groups[int(at)].append(c)
    assert got == {c: min(g) for g in groups.values() if len(g) > 1 for c in g}


def test_fingerprints_of_hostile_rows(hostile, nothing):
    out = simhash.duplicates_report(hostile).collect()
    assert len(out) == hostile.count()
    zero = {r.doc_id: r.component_id for r in out if r.fingerprint == "0" * 16}
    assert zero == {0: 0, 1: 0, 2: 0, None: 0}
    assert {r.component_id for r in out if r.doc_id == 4} == {3}
    assert {r.component_id for r in out if r.doc_id == 6} == {6}  # upper case beyond ASCII is kept
    assert rows_of(simhash.duplicates_report(nothing)) == []


def test_one_of_each_group_stays(spark, hostile):
    kept = simhash.one_of_each(hostile, simhash.similar(0.8))
    assert kept.columns == hostile.columns
    texts = [r.text for r in kept.collect()]
    assert sum(not (t or "").split() for t in texts) == 1
    assert len(texts) == len({(t or "").encode().lower().strip() for t in texts}) == 8
    docs = table(spark, SMALL, "documents")
    rows = {r.doc_id: r.text.lower().split() for r in docs.collect()}
    sets = {k: {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} for k, w in rows.items()}
    ids = sorted(sets)
    label = linked(ids, lambda a, b: len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]))
    kept = {r.doc_id for r in simhash.one_of_each(docs, simhash.similar(0.8)).collect()}
    assert kept == {ids[i] for i in set(label.tolist())}


def kept_of(spark, texts):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    return {r.doc_id for r in simhash.one_of_each(docs, simhash.similar(0.8)).collect()}


def named(prefix, n):
    return [f"{prefix}{i}" for i in range(n)]


@pytest.mark.parametrize("block_bytes", [setjoin.BLOCK_BYTES, 2_000])
def test_every_similar_pair_is_linked(spark, block_bytes):
    """Near copies of each other at all degrees of similarity about the limit; what links must not depend on the blocks."""
    rng = random.Random(12)
    texts = []
    for family in range(12):
        words = named(f"f{family}w", rng.choice([20, 60, 150]))
        for _ in range(25):
            own = list(words)
            for _ in range(rng.randint(0, len(own) // 25 + 1)):
                own[rng.randrange(len(own))] = f"x{rng.random()}"
            texts.append(" ".join(own))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)
    held = setjoin.chunks(docs, 5)
    got = components.components(setjoin.links(held, simhash.similar(0.8), block_bytes)).collect()
    sets = {setjoin.digest(s): set(s.tolist()) for s in (setjoin.shingle_set(t.encode(), 5) for t in texts)}
    nodes = sorted(sets)
    label = linked(nodes, lambda a, b: len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]))
    groups = defaultdict(list)
    for node, at in zip(nodes, label.tolist()):
        groups[at].append(node)
    assert len({len(g) for g in groups.values()}) > 2
    assert {r.node: r.component for r in got} == {n: min(g) for g in groups.values() if len(g) > 1 for n in g}


def test_a_common_line_is_no_duplicate(spark):
    line = " ".join(named("line", 7))
    texts = [" ".join(named(body, 300)) + f" {line}" * 100 for body in "ab"]
    assert kept_of(spark, texts) == {0, 1}


def test_a_repeated_line_does_not_hide_a_duplicate(spark):
    body, line = " ".join(named("w", 300)), " ".join(named("line", 7))
    assert kept_of(spark, [f"{body} {line}", body + f" {line}" * 60]) == {0}


def test_pairs_at_the_limit_meet(spark):
    """Each pair has 90 of 112 shingles in common, which is just above the limit."""
    texts = []
    for pair in range(150):
        words = named(f"p{pair}w", 105)
        texts += [" ".join(words), " ".join(words[:94] + named(f"q{pair}w", 11))]
    assert kept_of(spark, texts) == set(range(0, 300, 2))


def test_identified_rows(spark):
    df = spark.createDataFrame([(1, "a"), (1, "a"), (None, "b"), (None, "c")], "doc_id long, text string")
    assert len({(r.doc, r.tie) for r in identified(df).collect()}) == 4


# Language, quality, language model.


def test_languages(spark, hostile, nothing):
    directory = "/root/testdata/sf0.01"
    want = {r.doc_id: r.lang for r in table(spark, directory, "documents").collect()}
    out = QUERIES["op7_string_kernel_language"](spark, directory).collect()
    held = [r for r in out if r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in out)
    assert sum(r.lang_pred == want[r.doc_id] for r in held) >= 0.95 * len(held)
    assert all(0 <= r.score <= 1 for r in out)
    got = [(r.doc_id, r.lang_pred) for r in language_report(hostile).collect()]
    assert len(got) == hostile.count() and {p for i, p in got if i in (0, 1, 2)} == {"und"} and (4, "en") in got
    assert rows_of(language_report(nothing)) == []
    assert {r.lang_pred for r in language_report(hostile.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}


def test_quality(spark, hostile, nothing):
    directory = "/root/testdata/sf0.01"
    labels = {r.doc_id: r.quality for r in table(spark, directory, "labels").collect()}
    out = QUERIES["op8_neighbour_vote_quality"](spark, directory).collect()
    assert len(out) == 1000 and all(r.predicted == (r.score >= 0.3) and 0 <= r.score <= 1 for r in out)
    held = [r for r in out if r.held_out and r.doc_id in labels]
    assert sum(r.predicted == labels[r.doc_id] for r in held) >= 0.95 * len(held)
    marks = spark.createDataFrame([(3, 1, 0), (3, 0, 0), (4, 1, 1), (None, 0, 0), (9, None, 0)], "doc_id long, quality int, score int")
    assert quality.quality_report(hostile, marks).count() == hostile.count()
    assert {r.score for r in quality.quality_report(hostile, marks.filter("false")).collect()} == {1.0}
    assert rows_of(quality.quality_report(nothing, marks)) == []
    kept = quality.keep_good(hostile, marks)
    assert kept.columns == hostile.columns


def check_scores(docs, **parameters):
    rows = rows_of(docs.select("doc_id", "text"))
    out = hmm.score_documents(docs, **parameters).collect()
    train = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 5 != 1
    tokens = [(i, [*(t or "").encode().lower().split(), None]) for i, t in rows]
    counts = Counter(w for i, words in tokens for w in words if train(i))
    n, v = sum(counts.values()), len(counts)
    want = Counter()
    for i, words in tokens:
        base = sum(np.log10((counts[w] + 0.5) / (n + 0.5 * (v + 1))) for w in words)
        want[i, not train(i), len(words), sum(counts[w] > 0 for w in words), n, round(base, 3)] += 1
    assert Counter((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 3)) for r in out) == want
    assert all(np.isfinite(r.score) and r.score <= 0 for r in out)
    return out


def test_scores(spark, hostile, nothing):
    out = check_scores(table(spark, SMALL, "documents"), chunk_tokens=5000)
    held = [r for r in out if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)
    check_scores(hostile, chunk_tokens=1000)
    assert rows_of(hmm.score_documents(nothing)) == []
    check_scores(hostile.filter("doc_id = 5"))  # crc32 says whether anything is learned at all


# The pipeline.


def test_pipeline(spark):
    docs = table(spark, SMALL, "documents")
    marked = {r.doc_id: r.predicted for r in quality.quality_report(docs, table(spark, SMALL, "labels")).collect()}
    good = corpus_pipeline.quality(spark, docs, SMALL)
    assert {r.doc_id for r in good.collect()} == {i for i, p in marked.items() if p}
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, SMALL).columns == docs.columns
    clean = corpus_pipeline.benchmark_passages(spark, docs, SMALL)
    assert clean.count() == docs.count()
    out = corpus_pipeline.run(spark, SMALL)
    kept = corpus_pipeline.near_duplicates(spark, good, SMALL)
    assert {r.doc_id for r in out.collect()} == {r.doc_id for r in kept.collect()}
    # Of each component of the fingerprints, the smallest doc_id stays.
    first = {r.component_id for r in simhash.duplicates_report(good).collect()}
    assert sorted(r.doc_id for r in kept.collect()) == sorted(first)


@pytest.mark.parametrize("empty", [False, True])
def test_pipeline_on_hostile_rows(spark, hostile, nothing, empty):
    docs = nothing if empty else hostile
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, SMALL)
        assert docs.columns == hostile.columns and docs.schema == hostile.schema
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, SMALL).collect()
    assert len({r.doc_id for r in packed}) == len({r.doc_id for r in docs.collect()})
    assert empty == (not packed)


def test_every_operator_has_a_query():
    assert sorted(int(name[2:].split("_")[0]) for name in QUERIES) == list(range(1, 14))
    assert len(corpus_pipeline.STAGES) == 5 and corpus_pipeline.ORACLE_SQL is None
