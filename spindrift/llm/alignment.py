"""Alignment of two tokenizers' tokens over the same texts, in Arrow.

Tokens of many texts are flat lists with the index of their text.  Their byte
lengths, added up, give the place where each ends, counted over all texts of a
slice, so that a place tells its text too.  A full outer hash join of the two
tokenizers' ends cuts the texts into the stretches that both see alike: each
stretch is one pair of overlapping tokens, and ends that both know close a
group.  Pairs are counted by ``Table.group_by`` for a slice, and Spark adds the
counts of all slices up.  A slice then gets back the sums of its own pairs, not
those of all.

A slice is aligned in parts, so that a worker holds the tokens of one part only.
Its links are bytes, as wide as the number of its pairs asks for, and it comes
back to a worker alone: besides the batch of texts that Spark sends, what a task
holds outside of the JVM's heap follows ``SLICE_BYTES``, not a partition's size.

Long texts are given to the tokenizers in sections, cut where neither joins
anything over the cut: before a single space between an ASCII letter or digit
and an ASCII letter.  Tokens, groups and links are the same as without cuts.

Defined cases: null and empty texts, and those whose tokens do not spell out the
text, have no tokens; a null or repeated doc_id is kept, each row being a
document; no rows give no rows; only ``doc_id`` and ``text`` are read of the
input, so other columns cannot clash.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spindrift.llm.common import batch_of, sliced, tidy, written
from spindrift.llm.vocabularies import ByteVocabulary, PieceVocabulary

SLICE_BYTES = 2 << 20
PART_BYTES = 1 << 18
SECTION_CHARS = 1 << 18
LOW = (1 << 32) - 1
CUT = re.compile(r"(?<=[A-Za-z0-9]) (?=[A-Za-z])")

GROUPS = pa.schema(
    [("doc_id", pa.int64()), ("a_ids", pa.list_(pa.int32())), ("b_ids", pa.list_(pa.int32())),
     ("a_sizes", pa.list_(pa.int32())), ("b_sizes", pa.list_(pa.int32()))]
)
SLICE = pa.schema(
    [("slice", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("n_a", pa.list_(pa.int64())), ("n_b", pa.list_(pa.int64())),
     ("n_groups", pa.list_(pa.int64())), ("n_links", pa.list_(pa.int64())), ("sha", pa.list_(pa.string())),
     ("links", pa.binary()), ("pairs", pa.list_(pa.int64())), ("counts", pa.list_(pa.int64()))]
)
# A row of slices is some MB: pages and row groups are looked at after each, not after a hundred.
STORED = {"parquet.page.size.row.check.min": "1", "parquet.block.size.row.check.min": "1", "parquet.block.size": str(16 << 20)}


def paths() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


class Tokenizers:
    """Two vocabularies, the bytes of their entries, and the digits of their ids with what may follow them."""

    def __init__(self, a_path: str, b_path: str):
        self.a, self.b = ByteVocabulary(a_path), PieceVocabulary(b_path)
        self.a_bytes, self.b_bytes = (pa.array(v.entries(), pa.binary()) for v in (self.a, self.b))
        n_a, n_b = len(self.a_bytes), len(self.b_bytes)
        ends = [(n_a, ","), (n_a, "|"), (n_b, ","), (n_b, ";")]
        self.digits = pa.array([f"{i}{end}" for n, end in ends for i in range(n)], pa.binary())

    def sections(self, text: str) -> list[str]:
        if len(text) <= SECTION_CHARS or not self.b.by_unit:
            return [text]
        found, at = [], 0
        while m := CUT.search(text, at + SECTION_CHARS):
            found.append(text[at : m.start()])
            at = m.end()
        return [*found, text[at:]]

    def encode(self, texts: list[str]) -> tuple[pa.ListArray, pa.ListArray]:
        """Both vocabularies' ids of each text; a space goes before it."""
        cut = [self.sections(t) if t else [] for t in texts]
        both = []
        for one in (lambda s: self.a.ids(" " + s), self.b.ids):
            found = [np.concatenate([np.empty(0, np.int32), *map(one, sections)]) for sections in cut]
            ends = cumulative(np.array([len(f) for f in found], np.int64)).astype(np.int32)
            both.append(pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([np.empty(0, np.int32), *found]))))
        return tuple(both)


_TOKENIZERS: dict[tuple[str, str], Tokenizers] = {}


def tokenizers(a_path: str, b_path: str) -> Tokenizers:
    """One pair for each worker process."""
    if (a_path, b_path) not in _TOKENIZERS:
        _TOKENIZERS[a_path, b_path] = Tokenizers(a_path, b_path)
    return _TOKENIZERS[a_path, b_path]


def buffer_of(strings: pa.Array) -> tuple[np.ndarray, memoryview]:
    """Offsets and joined bytes of a binary array that starts at its buffers' start."""
    offsets = np.frombuffer(strings.buffers()[1], np.int32)[: len(strings) + 1]
    return offsets, memoryview(strings.buffers()[2] or b"").cast("B")


def spelled(ids: pa.ListArray, entries: pa.Array, wanted: list[bytes]) -> np.ndarray:
    """Which lists of ids spell out the bytes that are wanted."""
    offsets, joined = buffer_of(entries.take(ids.flatten()))
    ends = offsets[ids.offsets.to_numpy()]
    return np.array([joined[a:b] == w for a, b, w in zip(ends, ends[1:], wanted)], bool)


def cumulative(sizes: np.ndarray) -> np.ndarray:
    return np.concatenate(([0], np.cumsum(sizes)))


@dataclass
class Aligned:
    """Tokens of a slice of texts and how they overlap.

    ``a_shared``, ``b_shared``: tokens that end where one of the other
    tokenizer ends; ``a_link``, ``b_link``: for each stretch, the tokens it is
    of, by their place in the flat lists.
    """

    a: pa.ListArray
    b: pa.ListArray
    a_shared: np.ndarray
    b_shared: np.ndarray
    a_link: np.ndarray
    b_link: np.ndarray

    @classmethod
    def of(cls, texts: list[str | None], tools: Tokenizers) -> Aligned:
        full = [t or "" for t in texts]
        a, b = tools.encode(full)
        wanted = [b" " + t.encode() if t else b"" for t in full]
        good = spelled(a, tools.a_bytes, wanted) & spelled(b, tools.b_bytes, wanted) & np.array([bool(t) for t in full], bool)
        if not good.all():
            a, b = (pc.if_else(pa.array(good), x, pa.scalar([], x.type)) for x in (a, b))
        ends = [
            pc.cumulative_sum(pc.cast(pc.binary_length(entries).take(ids.flatten()), pa.int64()))
            for ids, entries in ((a, tools.a_bytes), (b, tools.b_bytes))
        ]
        sides = [pa.table({"end": end, name: np.arange(len(end), dtype=np.int32)}) for end, name in zip(ends, ("a", "b"))]
        both = sides[0].join(sides[1], "end", join_type="full outer", use_threads=False).sort_by("end").combine_chunks()
        known = [both.column(c).is_valid().to_numpy() for c in ("a", "b")]
        shared = known[0] & known[1]
        # A stretch belongs to the first tokens that end with it or behind it.
        links = [pc.fill_null_backward(both.column(c)).to_numpy() for c in ("a", "b")]
        return cls(a, b, shared[known[0]], shared[known[1]], *links)

    @cached_property
    def docs(self) -> tuple[np.ndarray, np.ndarray]:
        """The text of each token."""
        return tuple(pc.list_parent_indices(x).to_numpy() for x in (self.a, self.b))

    def counts(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Tokens of both, groups and links of each text."""
        a_doc, b_doc = self.docs
        return tuple(
            np.bincount(x, minlength=len(self.a)) for x in (a_doc, b_doc, a_doc[self.a_shared], a_doc[self.a_link])
        )

    def pairs(self) -> np.ndarray:
        """The ids that each stretch links, as one number."""
        ids = [x.flatten().to_numpy(zero_copy_only=False).astype(np.int64) for x in (self.a, self.b)]
        return ids[0][self.a_link] << 32 | ids[1][self.b_link]

    def group_sizes(self) -> tuple[pa.ListArray, pa.ListArray]:
        """How many tokens each group of each text has."""
        groups = cumulative(self.counts()[2]).astype(np.int32)
        sizes = [np.diff(np.flatnonzero(s), prepend=-1).astype(np.int32) for s in (self.a_shared, self.b_shared)]
        return tuple(pa.ListArray.from_arrays(pa.array(groups), pa.array(s)) for s in sizes)

    def digests(self, tools: Tokenizers) -> list[str]:
        """SHA-256 of each text's groups in digits; an empty string without tokens."""
        a_ids, b_ids = (x.flatten().to_numpy(zero_copy_only=False) for x in (self.a, self.b))
        a_group, b_group = (np.cumsum(s) - s for s in (self.a_shared, self.b_shared))
        n = int(self.a_shared.sum())
        a_before, b_before = cumulative(np.bincount(a_group, minlength=n)), cumulative(np.bincount(b_group, minlength=n))
        # A group's tokens of the first kind stand before those of the second.
        order = np.empty(len(a_ids) + len(b_ids), np.int64)
        v_a, v_b = len(tools.a_bytes), len(tools.b_bytes)
        order[np.arange(len(a_ids)) + b_before[a_group]] = a_ids + v_a * self.a_shared
        order[np.arange(len(b_ids)) + a_before[b_group + 1]] = 2 * v_a + b_ids + v_b * self.b_shared
        offsets, joined = buffer_of(tools.digits.take(pa.array(order)))
        n_a, n_b, _, _ = self.counts()
        ends = offsets[cumulative(n_a + n_b)]
        return [hashlib.sha256(joined[i : j - 1]).hexdigest() if j > i else "" for i, j in zip(ends, ends[1:])]


def token_groups(docs: DataFrame, a_path: str | None = None, b_path: str | None = None) -> DataFrame:
    """(doc_id, a_ids, b_ids, a_sizes, b_sizes): both token lists, and how many of each make up each group."""
    a_path, b_path = a_path or paths()[0], b_path or paths()[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tools = tokenizers(a_path, b_path)
        for batch in sliced(batches, "text", SLICE_BYTES):
            own = Aligned.of(batch.column("text").to_pylist(), tools)
            yield batch_of(GROUPS, batch.column("doc_id"), own.a, own.b, *own.group_sizes())

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(
        tidy(run), "doc_id long, a_ids array<int>, b_ids array<int>, a_sizes array<int>, b_sizes array<int>"
    )


def width(n: int) -> type[np.unsignedinteger]:
    """The smallest kind of number for places in a list of ``n``."""
    return next(kind for kind in (np.uint8, np.uint16, np.uint32) if n <= np.iinfo(kind).max + 1)


def slice_row(number: int, batch: pa.RecordBatch, tools: Tokenizers) -> pa.RecordBatch:
    """The row of one slice; its texts are aligned part by part."""
    pairs, counts, shas = [], [], []
    for part in sliced([batch], "text", PART_BYTES):
        own = Aligned.of(part.column("text").to_pylist(), tools)
        pairs.append(own.pairs())
        counts.append(own.counts())
        shas += own.digests(tools)
    found = pa.array(np.concatenate(pairs))
    counted = pa.table({"pair": found}).group_by("pair", use_threads=False).aggregate([("pair", "count")]).combine_chunks()
    known = counted.column("pair").combine_chunks()
    links = pc.index_in(found, value_set=known).to_numpy().astype(width(len(known)))
    return batch_of(
        SLICE, [number], [batch.column("doc_id").to_pylist()], *([np.concatenate(x)] for x in zip(*counts)), [shas],
        [links.tobytes()], pa.ListArray.from_arrays([0, len(known)], known), [counted.column("pair_count").to_numpy()],
    )


def slices(docs: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """Documents as slices: what is known of each, and the different pairs of the slice with their counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tools, first = tokenizers(a_path, b_path), TaskContext.get().partitionId() << 32
        for number, batch in enumerate(sliced(batches, "text", SLICE_BYTES), first):
            yield slice_row(number, batch, tools)

    rows = docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(
        tidy(run),
        "slice long, doc_ids array<long>, n_a array<long>, n_b array<long>, n_groups array<long>, n_links array<long>, "
        "sha array<string>, links binary, pairs array<long>, counts array<long>",
    )
    return written(rows, "aligned-slices", **STORED)


def counted_pairs(held: DataFrame) -> DataFrame:
    """(pair, n): how many links hold each pair of ids, over all slices."""
    each = held.select(F.explode(F.arrays_zip("pairs", "counts")).alias("x"))
    return each.groupBy(F.col("x.pairs").alias("pair")).agg(F.sum("x.counts").alias("n"))


def link_counts(docs: DataFrame, a_path: str | None = None, b_path: str | None = None) -> DataFrame:
    """(a_id, b_id, n): how often tokens of both ids overlap, over all documents."""
    found = counted_pairs(slices(docs, a_path or paths()[0], b_path or paths()[1]))
    return found.select(
        F.shiftright("pair", 32).cast("int").alias("a_id"), F.col("pair").bitwiseAND(LOW).cast("int").alias("b_id"), "n"
    )


def alignment_report(docs: DataFrame, a_path: str | None = None, b_path: str | None = None) -> DataFrame:
    """Per document: tokens, groups and links, how many links are their B id's most frequent, and the sum of their counts."""
    held = slices(docs, a_path or paths()[0], b_path or paths()[1])
    totals = written(counted_pairs(held), "pair-counts").withColumn("b", F.col("pair").bitwiseAND(LOW))
    # One row for each entry of the second vocabulary at most.
    most = F.broadcast(totals.groupBy("b").agg(F.max("n").alias("most")))
    told = totals.join(most, "b").select("pair", F.when(F.col("n") == F.col("most"), -F.col("n")).otherwise(F.col("n")).alias("n"))
    asked = held.select("slice", F.posexplode("pairs").alias("at", "pair"))
    answers = asked.join(told, "pair").groupBy("slice").agg(F.sort_array(F.collect_list(F.struct("at", "n"))).n.alias("told"))
    out = pa.schema(
        [("doc_id", pa.int64()), ("n_a", pa.int64()), ("n_b", pa.int64()), ("n_groups", pa.int64()), ("n_links", pa.int64()),
         ("n_best", pa.int64()), ("count_sum", pa.int64()), ("groups_sha256", pa.string())]
    )

    def run(held: pa.Table) -> pa.Table:
        [row] = held.to_batches()
        of = {name: row.column(name)[0].values for name in ("doc_ids", "n_a", "n_b", "n_groups", "n_links", "sha", "told")}
        told = of["told"].to_numpy() if of["told"] is not None else np.empty(0, np.int64)
        links = np.frombuffer(row.column("links")[0].as_buffer(), width(len(told)))
        own = told[links]  # a negative count marks the most frequent
        ends = cumulative(of["n_links"].to_numpy())
        best, counts = cumulative(own < 0)[ends], cumulative(np.abs(own))[ends]
        return pa.Table.from_batches(
            [batch_of(out, of["doc_ids"], of["n_a"], of["n_b"], of["n_groups"], of["n_links"], np.diff(best), np.diff(counts), of["sha"])]
        )

    small = held.select("slice", "doc_ids", "n_a", "n_b", "n_groups", "n_links", "sha", "links")
    # The join has brought the slices together already; a group is one slice, and a worker gets one after the other.
    return small.join(answers, "slice", "left").groupBy("slice").applyInArrow(
        run, "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"
    )
