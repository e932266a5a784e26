"""Alignment of two tokenizers against a plain walk over bytes."""

from __future__ import annotations

import hashlib
import random
from collections import Counter, defaultdict
from types import SimpleNamespace

import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from spindrift.llm import alignment
from spindrift.llm.alignment import Aligned, Tokenizers, alignment_report, link_counts, paths, token_groups
from spindrift.llm.catalog import QUERIES
from spindrift.llm.common import table
from spindrift.llm.vocabularies import is_plain

COLUMNS = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
HARD_TEXTS = [
    None, "", " ", "  ", "\n\n a\tb", "plain words here", "▁ low line", "don't I'll ½ x² naïve 日本語 12٣ é", "<s> </s> <unk> <0x41>",
    "x<|endoftext|>y", "a\x00b\x1cc", "ﬁ ligature", "👩‍👩‍👧 family", "a" * 3000, "trail ", " nb", "é", "﻿mark", "𝔘nicode",
]


@pytest.fixture(scope="module")
def tools():
    return Tokenizers(*paths())


def plain(tools, text):
    """Both lists of (id, bytes), or nothing if they do not spell out the text."""
    a = tools.a.tokenizer.encode(" " + text, add_special_tokens=False).ids if text else []
    b = tools.b.model.encode(text) if text else []
    both = [[(i, tools.a_bytes[i].as_py()) for i in a], [(i, tools.b_bytes[i].as_py()) for i in b]]
    wanted = b" " + (text or "").encode()
    if not text or any(b"".join(x for _, x in side) != wanted for side in both):
        return [[], []]
    return both


def spans(side):
    at = 0
    for i, data in side:
        yield i, at, at + len(data)
        at += len(data)


def brute(tools, rows):
    counts, known = Counter(), []
    for doc_id, text in rows:
        a, b = (list(spans(side)) for side in plain(tools, text))
        links = [(i, j) for i, x, y in a for j, u, v in b if x < v and u < y]
        shared = sorted({y for _, _, y in a} & {y for _, _, y in b})
        groups = ";".join(
            "|".join(",".join(str(i) for i, _, y in side if low < y <= high) for side in (a, b))
            for low, high in zip([0, *shared], shared)
        )
        counts.update(links)
        known.append((doc_id, len(a), len(b), len(shared), links, groups))
    most = defaultdict(int)
    for (_, j), n in counts.items():
        most[j] = max(most[j], n)
    return counts, [
        (d, n_a, n_b, n, len(links), sum(counts[x] == most[x[1]] for x in links), sum(counts[x] for x in links),
         hashlib.sha256(groups.encode()).hexdigest() if groups else "")
        for d, n_a, n_b, n, links, groups in known
    ]


def key(row):
    return tuple((x is None, x) for x in row)


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(2)
    letters = ["a", "e", " ", " ", "th", "ing", "É", "日", "\n", "1", ".", "'s", "😀"]
    texts = HARD_TEXTS + ["".join(rng.choices(letters, k=rng.randint(1, 60))) for _ in range(60)]
    return [*enumerate(texts), (None, "no id"), (3, "again"), (3, "again")]


def test_report_and_counts_are_those_of_a_walk(spark, tools, rows, monkeypatch):
    counts, want = brute(tools, rows)
    df = spark.createDataFrame([(*r, 1, 2, 3) for r in rows], "doc_id long, text string, slice int, pair int, n int").repartition(3)
    got = [tuple(r) for r in alignment_report(df).select(*COLUMNS).collect()]
    assert sorted(got, key=key) == sorted(want, key=key)
    assert {(r.a_id, r.b_id): r.n for r in link_counts(df).collect()} == counts


def test_groups_cut_both_lists(spark, tools, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(2)
    want = {(d, t): plain(tools, t) for d, t in rows}
    got = token_groups(df.filter("doc_id IS NOT NULL")).collect()
    for row in got:
        assert sum(row.a_sizes) == len(row.a_ids) and sum(row.b_sizes) == len(row.b_ids)
        assert len(row.a_sizes) == len(row.b_sizes) and 0 not in row.a_sizes and 0 not in row.b_sizes
        a = b = 0
        for m, n in zip(row.a_sizes, row.b_sizes):
            stretch = [b"".join(entries[i].as_py() for i in ids) for entries, ids in
                       ((tools.a_bytes, row.a_ids[a : a + m]), (tools.b_bytes, row.b_ids[b : b + n]))]
            assert stretch[0] == stretch[1]
            a, b = a + m, b + n
    assert len(got) == sum(d is not None for d, _ in want) + 1


def test_ids_are_those_of_the_libraries(tools):
    rng = random.Random(4)
    plain = [chr(c) for c in range(0x250) if is_plain(chr(c))] + list("‐—‘’“”•€")
    alphabets = [plain, "ab  \n\n'stre .é", [chr(c) for c in range(0x300)], [chr(c) for c in range(1, 0x11000) if not 0xD800 <= c < 0xE000]]
    for n in range(6000):
        alphabet = alphabets[n % 4]
        text = "".join(rng.choices(alphabet, k=rng.randint(1, 40)))
        assert tools.a.ids(" " + text).tolist() == tools.a.tokenizer.encode(" " + text, add_special_tokens=False).ids, repr(text)
        assert tools.b.ids(text).tolist() == tools.b.model.encode(text), repr(text)


def test_sections_change_nothing(tools, monkeypatch):
    rng = random.Random(3)
    texts = [" ".join(rng.choices(["the", "Out", "é", "x1", "don't", "", "日本", "a.b", "\n"], k=400)) for _ in range(10)]
    whole = Aligned.of(texts, tools)
    monkeypatch.setattr(alignment, "SECTION_CHARS", 20)
    cut = Aligned.of(texts, tools)
    assert len(tools.sections(texts[0])) > 5
    assert cut.a == whole.a and cut.b == whole.b and cut.digests(tools) == whole.digests(tools)


def test_a_worker_aligns_a_slice_in_parts(spark, tools, monkeypatch):
    """Only the tokens of a part are held, and a link takes no more bytes than the number of pairs asks for."""
    rng = random.Random(5)
    rows = [(i, " ".join(rng.choices(["the", "Out", "é", "x1", "don't", "日本", "tokenizer"], k=30))) for i in range(60)]
    counts, want = brute(tools, rows)
    runs, sizes, of = [], [], Aligned.of
    monkeypatch.setattr(alignment, "SLICE_BYTES", 5000)
    monkeypatch.setattr(alignment, "PART_BYTES", 1000, raising=False)
    monkeypatch.setattr(alignment, "TaskContext", SimpleNamespace(get=lambda: SimpleNamespace(partitionId=lambda: 3)))
    monkeypatch.setattr(alignment, "written", lambda *_, **__: None)
    monkeypatch.setattr(Aligned, "of", lambda texts, tools: sizes.append(sum(len(t.encode()) for t in texts)) or of(texts, tools))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    monkeypatch.setattr(type(df), "mapInArrow", lambda self, run, schema: runs.append(run))
    alignment.slices(df, *paths())
    batch = pa.RecordBatch.from_pylist([{"doc_id": d, "text": t} for d, t in rows])
    found = [b.to_pylist()[0] for b in runs[0](iter([batch]))]
    assert max(sizes) <= 1000 and 1 < len(found) < len(sizes)
    assert [r["slice"] for r in found] == [(3 << 32) + i for i in range(len(found))]
    known = Counter()
    for r in found:
        assert len(r["links"]) == sum(r["n_links"]) and len(r["pairs"]) <= 256
        held = Counter(r["pairs"][i] for i in r["links"])
        assert held == dict(zip(r["pairs"], r["counts"]))
        known += held
    assert known == {a << 32 | b: n for (a, b), n in counts.items()}
    names = ("doc_ids", "n_a", "n_b", "n_groups", "n_links", "sha")
    assert [t for r in found for t in zip(*(r[n] for n in names))] == [(*w[:5], w[7]) for w in want]


def test_links_are_as_wide_as_their_pairs_ask_for():
    assert [alignment.width(n)(0).itemsize for n in (0, 1, 256, 257, 65536, 65537, 1 << 32)] == [1, 1, 1, 2, 2, 4, 4]


def test_slices_are_stored_in_small_groups_and_come_back_alone(spark, tools, monkeypatch):
    rng = random.Random(6)
    words = ["the", "Out", "é", "x1", "don't", "日本", "a.b", "tokenizer"]
    rows = [(i, " ".join(rng.choices(words, k=rng.randint(1, 400)))) for i in range(200)]
    at, store = [], alignment.written
    monkeypatch.setattr(alignment, "SLICE_BYTES", 4000)
    monkeypatch.setattr(alignment, "STORED", {**getattr(alignment, "STORED", {}), "parquet.block.size": "20000"}, raising=False)
    monkeypatch.setattr(alignment, "written", lambda df, name, **options: at.append(store(df, name, **options)) or at[-1])
    report = alignment_report(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1))
    plan = report._jdf.queryExecution().executedPlan().toString()
    assert "FlatMapGroupsInArrow" in plan and "MapInArrow" not in plan.replace("FlatMapGroupsInArrow", "")
    [path] = at[0].inputFiles()
    held = pq.ParquetFile(path.removeprefix("file://")).metadata
    assert held.num_rows > 20 and held.num_row_groups > 2
    assert sorted(tuple(r) for r in report.select(*COLUMNS).collect()) == sorted(brute(tools, rows)[1])


def test_no_documents(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert alignment_report(df).columns == COLUMNS and alignment_report(df).count() == 0
    only_empty = spark.createDataFrame([(1, None), (2, "")], "doc_id long, text string")
    assert sorted(tuple(r) for r in alignment_report(only_empty).collect()) == [(1, 0, 0, 0, 0, 0, 0, ""), (2, 0, 0, 0, 0, 0, 0, "")]


def test_whole_query_on_a_table(spark, tools):
    directory = "/root/testdata/sf0.001"
    docs = [tuple(r) for r in table(spark, directory, "documents").select("doc_id", "text").collect()]
    short = [(d, t) for d, t in docs if len(t or "") < 600]
    got = {r.doc_id: r for r in QUERIES["op12_token_alignment"](spark, directory).collect()}
    assert len(got) == len(docs)
    for row in brute(tools, short)[1]:
        assert tuple(got[row[0]])[:5] == row[:5] and got[row[0]].groups_sha256 == row[7]
    total = link_counts(table(spark, directory, "documents")).agg({"n": "sum"}).first()[0]
    assert total == sum(r.n_links for r in got.values())
