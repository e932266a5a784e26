"""SimHash fingerprints linked by multi-index hashing.

A fingerprint is cut into segments.  Fingerprints near each other agree in some
segment up to ``radius`` bits, so each segment has a table of its values, and
each fingerprint looks up the Hamming ball around its own value there and
verifies the whole distance of what it finds.

The tables are dealt out by Spark: a segment falls into ``radius + 1`` parts, of
which one agrees exactly if at most ``radius`` bits of the segment differ, so
rows with an equal part meet in one task, which holds that share of the table
and enumerates the balls over the other parts.  Equal fingerprints are one row
beforehand.  A part's value shared by more than ``split_rows`` fingerprints is
dealt out in pairs of blocks.  A task returns of the links that it has
verified those that join up the same fingerprints, nearest first, never all
pairs; ``components`` joins the links of all tasks.  Links by similarity of
shingle sets use no fingerprints: ``setjoin`` has them.

Defined cases: null text counts as empty; a text without words has fingerprint
zero and is linked like any other; texts with fewer words than a shingle are
one shingle; repeated rows are kept and share a fingerprint; a null doc_id
belongs to its fingerprint's component but never names one, and a component of
null ids alone has a null id; no rows give no rows; only ``doc_id`` and ``text``
are read of the input, so other columns cannot clash.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spindrift.llm import setjoin
from spindrift.llm.common import batch_of, identified, tidy, utf8, written
from spindrift.llm.components import components
from spindrift.llm.setjoin import shingle_hashes

COUNTED = 1 << 17
PAIRS_AT_ONCE = 1 << 18
GROUP_ROWS = 1 << 17
SPLIT_ROWS = 50_000
# Odd multipliers of a splitting generator; fixed values.
MIX_A, MIX_B, MIX_STEP = 0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0x9E3779B97F4A7C15


@dataclass(frozen=True)
class Plan:
    """What is linked: fingerprints of ``64 * words`` bits that differ in at most ``distance``."""

    shingle: int
    words: int
    segments: int
    radius: int
    distance: int

    @property
    def length(self) -> int:
        return 64 * self.words // self.segments

    def parts(self) -> list[tuple[int, int]]:
        """(first bit, bits) of the parts of a segment."""
        each = self.length // (self.radius + 1)
        cuts = [i * each for i in range(self.radius + 1)] + [self.length]
        return [(a, b - a) for a, b in zip(cuts, cuts[1:])]

    def balls(self, part: int) -> list[int]:
        """Differences within the radius that leave one part as it is."""
        first, bits = self.parts()[part]
        free = [i for i in range(self.length) if not first <= i < first + bits]
        return [sum(1 << i for i in c) for n in range(self.radius + 1) for c in combinations(free, n)]


# Exact for three bits: of two halves, one differs in at most one bit.
EXACT = Plan(shingle=3, words=1, segments=2, radius=1, distance=3)


@dataclass(frozen=True)
class Similar:
    """Links of sets of distinct shingles with at least this Jaccard similarity, every one of them."""

    similarity: float
    shingle: int


def similar(similarity: float, shingle: int = 5) -> Similar:
    return Similar(similarity, shingle)


def mixed(h: np.ndarray, word: int) -> np.ndarray:
    """The hash itself for word 0, for others a hash of it."""
    if not word:
        return h
    z = h + np.uint64(word * MIX_STEP & 0xFFFFFFFFFFFFFFFF)
    z = (z ^ (z >> np.uint64(30))) * np.uint64(MIX_A)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(MIX_B)
    return z ^ (z >> np.uint64(31))


def majority(hashes: list[np.ndarray], words: int) -> np.ndarray:
    """Fingerprints as (texts, words): a bit is 1 if more than half of a text's hashes have it."""
    out = np.zeros((len(hashes), words), np.uint64)
    sizes = np.array([len(h) for h in hashes], np.int64)
    full = np.flatnonzero(sizes)
    if not len(full):
        return out
    flat, starts = np.concatenate([hashes[i] for i in full]), np.concatenate(([0], np.cumsum(sizes[full])[:-1]))
    for word in range(words):
        ones = np.zeros((len(full), 64), np.int64)
        for at in range(0, len(flat), COUNTED):
            h = mixed(flat[at : at + COUNTED], word)
            bits = np.unpackbits(h.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            first = np.searchsorted(starts, at, "right") - 1
            last = np.searchsorted(starts, at + len(h), "left")
            inner = np.maximum(starts[first:last] - at, 0)
            ones[first:last] += np.add.reduceat(bits, inner, axis=0, dtype=np.int64)
        packed = np.packbits(2 * ones > sizes[full, None], axis=1, bitorder="little")
        out[full, word] = packed.view("<u8").ravel()
    return out


def fingerprints(docs: DataFrame, plan: Plan) -> DataFrame:
    """(doc_id, code) with the fingerprint as one long for each 64 bits."""
    schema = pa.schema([("doc_id", pa.int64()), ("code", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = utf8(batch.column("text"))
            for at in range(0, len(texts), 512):
                own = texts[at : at + 512]
                codes = majority([shingle_hashes(t, plan.shingle) for t in own], plan.words).view(np.int64)
                flat = pa.ListArray.from_arrays(
                    np.arange(len(own) + 1, dtype=np.int32) * plan.words, pa.array(codes.ravel())
                )
                yield batch_of(schema, batch.column("doc_id").slice(at, len(own)), flat)

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(tidy(run), "doc_id long, code array<long>")


def segment_values(codes: np.ndarray, plan: Plan, segment: int) -> np.ndarray:
    """Bits of one segment of each code, as unsigned numbers."""
    first, length = segment * plan.length, plan.length
    word, shift = divmod(first, 64)
    value = codes[:, word] >> np.uint64(shift)
    if shift + length > 64:
        value = value | (codes[:, word + 1] << np.uint64(64 - shift))
    return value & np.uint64((1 << length) - 1)


def table_rows(codes: DataFrame, plan: Plan) -> DataFrame:
    """A row for each segment and part: its key, and the fingerprint."""
    schema = pa.schema([("key", pa.int64()), ("node", pa.int64()), ("code", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            flat = batch.column("code").flatten()
            code = flat.to_numpy(zero_copy_only=False).view(np.uint64).reshape(n, plan.words)
            for segment in range(plan.segments):
                value = segment_values(code, plan, segment)
                for part, (first, bits) in enumerate(plan.parts()):
                    own = (value >> np.uint64(first)) & np.uint64((1 << bits) - 1)
                    key = (own.astype(np.int64) * plan.segments + segment) * (plan.radius + 1) + part
                    yield batch_of(schema, key, batch.column("node"), batch.column("code"))

    return codes.select("node", "code").mapInArrow(tidy(run), "key long, node long, code array<long>")


def dealt(rows: DataFrame, split_rows: int) -> DataFrame:
    """Rows with their group; a key of more than ``split_rows`` rows becomes pairs of blocks of its rows."""
    large = rows.groupBy("key").count().filter(F.col("count") > split_rows)
    blocks = large.select("key", F.ceil(F.col("count") / split_rows).cast("int").alias("blocks"))
    marked = rows.join(blocks, "key", "left").fillna(1, ["blocks"])
    own = F.pmod(F.hash("node"), F.col("blocks"))
    others = F.transform(
        F.sequence(F.lit(0), F.col("blocks") - 1),
        lambda other: F.least(own, other) * F.col("blocks") + F.greatest(own, other),
    )
    return marked.select("key", F.explode(others).alias("block"), "node", "code")


def forest(codes: np.ndarray, values: np.ndarray, groups: np.ndarray, plan: Plan, part: int) -> tuple[np.ndarray, np.ndarray]:
    """Links that join up all rows whose codes are near; ``groups`` tells apart what must not meet."""
    label = np.arange(len(codes))
    order = np.lexsort((values, groups))
    codes = codes[order]
    # One sortable number for (group, value): groups are runs, so their number is enough.
    run = np.cumsum(np.concatenate(([0], np.diff(groups[order]) != 0))).astype(np.uint64)
    keys = (run << np.uint64(plan.length)) | values[order]
    kept_a, kept_b = [], []
    for difference in plan.balls(part):
        near = keys ^ np.uint64(difference)
        high = np.searchsorted(keys, near, "right")
        if difference == 0:
            low = np.arange(len(keys)) + 1
            found = high - low
        else:
            low = np.searchsorted(keys, near, "left")
            found = np.where(near > keys, high - low, 0)
        some = np.flatnonzero(found > 0)
        total = np.cumsum(found[some])
        at = 0
        while at < len(some):
            done = total[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(total, done + PAIRS_AT_ONCE, "right")))
            rows, n = some[at:to], found[some[at:to]]
            a = np.repeat(rows, n)
            b = np.repeat(low[rows] - (np.cumsum(n) - n), n) + np.arange(len(a))
            apart = np.bitwise_count(codes[a] ^ codes[b]).sum(axis=1, dtype=np.int64)
            close = apart <= plan.distance
            for x, y in spanning(label, a[close], b[close], apart[close]):
                kept_a.append(x), kept_b.append(y)
            at = to
    none = np.empty(0, np.int64)
    return order[np.concatenate([none, *kept_a])], order[np.concatenate([none, *kept_b])]


def spanning(label: np.ndarray, a: np.ndarray, b: np.ndarray, apart: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Links between parts that ``label`` still tells apart: each part's nearest, until none is left."""
    order = np.argsort(apart, kind="stable")
    a, b = a[order], b[order]
    while len(a):
        la, lb = label[a], label[b]
        differ = la != lb
        a, b, la, lb = a[differ], b[differ], la[differ], lb[differ]
        if not len(a):
            return
        first = np.unique(np.concatenate([np.unique(x, return_index=True)[1] for x in (la, lb)]))
        yield a[first], b[first]
        join(label, a[first], b[first])


def join(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Give what the links (a, b) connect one label, the smallest."""
    while len(a):
        la, lb = label[a], label[b]
        differ = la != lb
        if not differ.any():
            return
        a, b, la, lb = a[differ], b[differ], la[differ], lb[differ]
        np.minimum.at(label, np.maximum(la, lb), np.minimum(la, lb))
        while (label != (up := label[label])).any():
            label[:] = up


def links(codes: DataFrame, plan: Plan, split_rows: int = SPLIT_ROWS) -> DataFrame:
    """Edges (a, b) between nodes that connect exactly what is linked in some table."""
    out = pa.schema([("a", pa.int64()), ("b", pa.int64())])
    rows = dealt(table_rows(codes, plan), split_rows)
    names = ["key", "block", "node"]

    def group_links(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        both = pa.Table.from_batches(held).combine_chunks()
        key, block, node = (both.column(c).to_numpy() for c in names)
        code = both.column("code").combine_chunks().flatten().to_numpy().view(np.uint64).reshape(-1, plan.words)
        kind = key % (plan.segments * (plan.radius + 1))
        a, b = [], []
        group = np.cumsum(np.concatenate(([0], (np.diff(key) != 0) | (np.diff(block) != 0))))
        for this in np.unique(kind):
            own = np.flatnonzero(kind == this)
            segment, part = divmod(int(this), plan.radius + 1)
            values = segment_values(code[own], plan, segment)
            one, other = forest(code[own], values, group[own], plan, part)
            a.append(node[own[one]]), b.append(node[own[other]])
        return batch_of(out, np.concatenate(a), np.concatenate(b))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Batches come in order of their groups; a group is never cut."""
        held: list[pa.RecordBatch] = []
        n = 0
        for batch in batches:
            if not batch.num_rows:
                continue
            if n >= GROUP_ROWS:
                key, block = (batch.column(c).to_numpy() for c in names[:2])
                last = held[-1].slice(held[-1].num_rows - 1)
                same = (key == last.column("key")[0].as_py()) & (block == last.column("block")[0].as_py())
                own = len(same) if same.all() else int(np.argmin(same))
                held.append(batch.slice(0, own))
                n += own
                if own == batch.num_rows:
                    continue
                yield group_links(held)
                held, n, batch = [], 0, batch.slice(own)
            held.append(batch)
            n += batch.num_rows
        if held:
            yield group_links(held)

    grouped = rows.repartition("key", "block").sortWithinPartitions("key", "block")
    return grouped.mapInArrow(tidy(run), "a long, b long")


def near_duplicates(docs: DataFrame, plan: Plan | Similar = EXACT, split_rows: int = SPLIT_ROWS) -> DataFrame:
    """(doc_id, code, component_id): the smallest doc_id that links lead to.

    The code of a plan with a similarity is a digest of the shingle set.
    """
    if isinstance(plan, Similar):
        held = setjoin.chunks(docs, plan.shingle)
        marked = setjoin.digests(held).withColumn("code", F.array("node"))
    else:
        marked = fingerprints(docs, plan)
        node = F.element_at("code", 1) if plan.words == 1 else F.xxhash64("code")
        marked = written(marked.withColumn("node", node), "fingerprints")
    codes = written(
        marked.groupBy("node", "code").agg(F.min("doc_id").alias("first")), "codes"
    )
    edges = setjoin.links(held, plan) if isinstance(plan, Similar) else links(codes, plan, split_rows)
    linked = written(components(edges), "components")
    named = codes.select("node", "first").join(linked, "node", "left").withColumn(
        "component", F.coalesce("component", "node")
    )
    least = named.groupBy("component").agg(F.min("first").alias("component_id"))
    names = written(named.join(least, "component").select("node", "component_id"), "component-names")
    return marked.join(names, "node").select("doc_id", "code", "component_id")


def duplicates_report(docs: DataFrame, plan: Plan = EXACT) -> DataFrame:
    found = near_duplicates(docs, plan)
    digits = F.concat_ws("", F.transform("code", lambda x: F.lower(F.lpad(F.hex(x), 16, "0"))))
    return found.select("doc_id", digits.alias("fingerprint"), "component_id")


def one_of_each(docs: DataFrame, plan: Plan | Similar) -> DataFrame:
    """The rows of ``docs`` less all but one of each group of near duplicates: that with the smallest doc_id.

    Of rows that share a doc_id or have none, which are different documents, the first read stays.
    """
    marked = identified(docs.select("doc_id", "text", F.struct(*docs.columns).alias("row")))
    ids = marked.select(F.xxhash64("doc", "tie").alias("doc_id"), "text", "doc", "tie")
    found = near_duplicates(ids.select("doc_id", "text"), plan)
    named = ids.select("doc_id", "doc", "tie").join(found.select("doc_id", "component_id"), "doc_id")
    kept = named.groupBy("component_id").agg(F.min(F.struct("doc", "tie")).alias("first")).select("first.*")
    return marked.join(kept, ["doc", "tie"], "left_semi").select("row.*")
