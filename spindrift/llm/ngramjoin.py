"""Jaccard join of n-gram sets as a blocked sparse matrix product.

Documents are rows and n-grams columns of a 0/1 matrix A; A times its transpose
holds the size of every intersection.  The product is never made as a whole:

* Equal texts are one row.  Columns are dealt into blocks by their hash; a block
  tells how many chunks of rows hold each of its columns.
* Columns are ordered rare ones first.  Two sets of at least the similarity
  share a column among as many first ones as may be missing in the other, plus
  one.  Rows connected by such columns, and by sizes that fit, are a row group.
* Row groups make row blocks of bounded bytes.  A row's product with the others
  of its block is accumulated over the first columns; pairs that the sizes then
  rule out are discarded, the others are accumulated over all columns.
* A row group larger than a block is cut by size bands, of which only equal and
  neighbouring ones can fit.  Its blocks are multiplied by themselves first, then
  in pairs, where rows that are joined up already are not multiplied again.

Links of verified pairs that join up the same rows go on, never all pairs.

N-grams are compared as 64-bit hashes of all their words; 48 bits of them count
columns, where a collision costs time only.

Defined cases: null text counts as empty; a text without words has no n-grams,
is linked with nothing and is a component of its own; a text with fewer words
than an n-gram is one n-gram; repeated rows are kept; a null doc_id belongs to
its text's component but never names one; no rows give no rows; only ``doc_id``
and ``text`` are read of the input, so other columns cannot clash.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spindrift.llm.common import batch_of, sliced, tidy, text_or_empty, utf8, written
from spindrift.llm.components import components

N, PERCENT = 4, 85
CHUNK_BYTES = 1 << 20
COUNT_BITS, LOW_BYTES = 48, 5
COLUMN_BLOCK = 1 << 21
ROW_BLOCK_BYTES = 1 << 21
SETTLE_EVERY = 128
WORDS_KNOWN = 200_000
# Odd multipliers of a splitting generator; fixed values.
MIX_A, MIX_B, MIX_STEP = 0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0x9E3779B97F4A7C15


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(MIX_A)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(MIX_B)
    return x ^ (x >> np.uint64(31))


class Words:
    """Hashes of words; those of frequent ones are remembered."""

    def __init__(self):
        self.known: dict[bytes, int] = {}

    def hashes(self, words: list[bytes]) -> np.ndarray:
        from xxhash import xxh3_64_intdigest

        known = self.known
        found = list(map(known.get, words))
        if None in found:
            for i, (word, value) in enumerate(zip(words, found)):
                if value is None:
                    found[i] = value = xxh3_64_intdigest(word)
                    if len(known) < WORDS_KNOWN and len(word) < 64:
                        known[word] = value
        return np.array(found, np.uint64)


def ngram_set(text: bytes, words: Words, n: int = N) -> np.ndarray:
    """Sorted hashes of the distinct runs of ``n`` words; of all words if they are fewer."""
    own = words.hashes(text.lower().split())
    if not len(own):
        return own
    size = min(n, len(own))
    total = np.zeros(len(own) - size + 1, np.uint64)
    for i in range(size):
        total = mixed(total + own[i : i + len(total)] + np.uint64(MIX_STEP))
    return np.unique(total)


def least_overlap(x: np.ndarray | int, y: np.ndarray | int, percent: int) -> np.ndarray | int:
    """The smallest intersection of sets of these sizes that is similar enough."""
    return -(-(x + y) * percent // (100 + percent))


def prefix_length(size: np.ndarray | int, percent: int) -> np.ndarray | int:
    """How many first columns of a set one of at least the similarity must meet."""
    return size + size * -percent // 100 + 1


def band_of(size, percent: int):
    """Sizes that fit lie in the same or in neighbouring bands."""
    return F.floor(F.log(size) / -math.log(percent / 100)).cast("int")


def chunks(docs: DataFrame) -> DataFrame:
    """(chunk, rows, digests, texts): each different text once, in chunks of about ``CHUNK_BYTES``."""
    schema = pa.schema(
        [("chunk", pa.int64()), ("rows", pa.list_(pa.int64())), ("digests", pa.list_(pa.binary())), ("texts", pa.list_(pa.binary()))]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = TaskContext.get().partitionId() << 36
        for batch in sliced(batches, "text", CHUNK_BYTES):
            rows = list(range(first, first + batch.num_rows))
            yield batch_of(schema, [first], [rows], [batch.column("digest").to_pylist()], [utf8(batch.column("text"))])
            first += batch.num_rows

    texts = docs.select("digest", "text").groupBy("digest").agg(F.first("text").alias("text"))
    return written(
        texts.mapInArrow(tidy(run), "chunk long, rows array<long>, digests array<binary>, texts array<binary>"), "ngram-chunks"
    )


def column_keys(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """The different columns of a chunk, cut to ``COUNT_BITS`` bits, in order, and how many of its rows hold each."""
    flat = np.concatenate([np.empty(0, np.uint64), *sets]) >> np.uint64(64 - COUNT_BITS)
    return np.unique(flat, return_counts=True)


def block_cuts(keys: np.ndarray, bits: int) -> np.ndarray:
    return np.searchsorted(keys, np.arange((1 << bits) + 1, dtype=np.uint64) << np.uint64(COUNT_BITS - bits))


def shared_columns(held: DataFrame, bits: int, n: int) -> DataFrame:
    """(chunk, block, at, chunks): which columns of a chunk others have too, by their place in the column block, and how many."""
    sent = pa.schema([("chunk", pa.int64()), ("block", pa.int32()), ("keys", pa.binary())])

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Words()
        for batch in batches:
            for chunk, texts in zip(batch.column("chunk").to_pylist(), batch.column("texts")):
                keys, _ = column_keys([ngram_set(t, words, n) for t in texts.as_py()])
                cuts = block_cuts(keys, bits)
                low = (keys & np.uint64((1 << (COUNT_BITS - bits)) - 1)).astype("<u8").view(np.uint8).reshape(-1, 8)[:, :LOW_BYTES].tobytes()
                own = np.flatnonzero(np.diff(cuts))
                yield batch_of(
                    sent, np.full(len(own), chunk), own.astype(np.int32), [low[cuts[i] * LOW_BYTES : cuts[i + 1] * LOW_BYTES] for i in own]
                )

    def add_up(rows: pa.Table) -> pa.Table:
        keys = rows.column("keys").to_pylist()
        wide = np.zeros((sum(map(len, keys)) // LOW_BYTES, 8), np.uint8)
        wide[:, :LOW_BYTES] = np.frombuffer(b"".join(keys), np.uint8).reshape(-1, LOW_BYTES)
        _, place, counts = np.unique(wide.view("<u8").ravel(), return_inverse=True, return_counts=True)
        often = counts[place].astype(np.uint32)
        ends = np.cumsum([len(k) // LOW_BYTES for k in keys])
        some = [np.flatnonzero(often[a:b] > 1) for a, b in zip([0, *ends], ends)]
        at = [s.astype(np.uint32).tobytes() for s in some]
        told = [often[a:b][s].tobytes() for a, b, s in zip([0, *ends], ends, some)]
        kept = pa.array([bool(x) for x in at])
        return pa.table(
            {"chunk": rows.column("chunk"), "block": rows.column("block"), "at": pa.array(at, pa.binary()), "chunks": pa.array(told, pa.binary())}
        ).filter(kept)

    parts = held.select("chunk", "texts").mapInArrow(tidy(send), "chunk long, block int, keys binary")
    return written(
        parts.groupBy("block").applyInArrow(tidy(add_up), "chunk long, block int, at binary, chunks binary"), "shared-columns"
    )


def first_columns(held: DataFrame, n: int, percent: int) -> DataFrame:
    """(row, digest, size, columns, own): each row's size, and if others have some of its first columns, those and its whole set."""
    total = held.agg(F.sum(F.aggregate("texts", F.lit(0).cast("long"), lambda s, t: s + F.octet_length(t)))).first()[0] or 0
    # About one n-gram for each six bytes; the number of blocks follows the input.
    bits = min(40, max(8, COUNT_BITS - 8 * LOW_BYTES, math.ceil(math.log2(max(1, total / 6 / COLUMN_BLOCK)))))
    shared = shared_columns(held, bits, n)
    told = shared.groupBy("chunk").agg(F.collect_list(F.struct("block", "at", "chunks")).alias("told"))
    schema = pa.schema(
        [("row", pa.int64()), ("digest", pa.binary()), ("size", pa.int64()), ("columns", pa.list_(pa.int64())), ("own", pa.binary())]
    )

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Words()
        for batch in batches:
            for rows, digests, texts, told in zip(*(batch.column(c) for c in ("rows", "digests", "texts", "told"))):
                sets = [ngram_set(t, words, n) for t in texts.as_py()]
                keys, here = column_keys(sets)
                cuts, chunks_with = block_cuts(keys, bits), np.ones(len(keys), np.int64)
                for answer in told.as_py() or []:
                    at = np.frombuffer(answer["at"], np.uint32)
                    chunks_with[cuts[answer["block"]] + at] = np.frombuffer(answer["chunks"], np.uint32)
                columns, own = [], []
                for s in sets:
                    place = np.searchsorted(keys, s >> np.uint64(64 - COUNT_BITS))
                    first = np.lexsort((s, chunks_with[place]))[: prefix_length(len(s), percent)] if len(s) else []
                    meets = (chunks_with[place[first]] > 1) | (here[place[first]] > 1) if len(s) else []
                    found = s[first][meets] if len(s) else s
                    columns.append(found.view(np.int64) if len(found) else None)
                    own.append(s.tobytes() if len(found) else None)
                yield batch_of(schema, rows.values, digests.values, [len(s) for s in sets], columns, own)

    return written(
        held.join(told, "chunk", "left").select("rows", "digests", "texts", "told")
        .mapInArrow(tidy(pick), "row long, digest binary, size long, columns array<long>, own binary"),
        "first-columns",
    )


def row_groups(found: DataFrame, percent: int) -> DataFrame:
    """(row, component) of rows that first columns connect, where sizes may fit."""
    each = written(found.select(F.explode("columns").alias("column"), "row", band_of(F.col("size"), percent).alias("band")), "columns")
    least = written(each.groupBy("column", "band").agg(F.min("row").alias("least"), F.max("row").alias("most")), "least-rows")
    inner = each.join(least.filter("least <> most"), ["column", "band"]).select(F.col("row").alias("a"), F.col("least").alias("b"))
    above = least.select("column", (F.col("band") - 1).alias("band"), F.col("least").alias("b"))
    across = least.join(above, ["column", "band"]).select(F.col("least").alias("a"), "b")
    return written(components(inner.unionByName(across)).withColumnRenamed("node", "row"), "row-groups")


def product_links(sets: list[np.ndarray], percent: int, labels: np.ndarray | None = None, sides: np.ndarray | None = None) -> list[tuple[int, int]]:
    """Links of verified pairs that join up what all similar pairs join up.

    ``labels``: rows known to be joined up; ``sides``: only rows of different
    sides are multiplied.
    """
    order = np.argsort([len(s) for s in sets], kind="stable")
    sets = [sets[i] for i in order]
    sizes = np.array([len(s) for s in sets], np.int64)
    n = len(sets)
    label = np.unique(labels[order], return_inverse=True)[1] if labels is not None else np.arange(n)
    side = sides[order] if sides is not None else None
    _, columns, counts = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    # Columns in this block's order, rare ones first; each row's in that order too.
    rank = np.empty(len(counts), np.int64)
    rank[np.lexsort((np.arange(len(counts)), counts))] = np.arange(len(counts))
    row_of = np.repeat(np.arange(n), sizes)
    entries = rank[columns]
    by_row = np.lexsort((entries, row_of))
    entries = entries[by_row]
    starts = np.concatenate(([0], np.cumsum(sizes)))
    lengths = np.minimum(prefix_length(sizes, percent), sizes)
    in_first = np.arange(len(entries)) - np.repeat(starts[:-1], sizes) < np.repeat(lengths, sizes)
    last = entries[starts[:-1] + lengths - 1]
    rest = sizes - lengths
    alone = int((counts == 1).sum())  # these columns hold no product
    used = in_first & (entries >= alone)
    by_column = np.lexsort((row_of[used], entries[used]))
    holders, own_columns = row_of[used][by_column], entries[used][by_column]
    cuts = np.searchsorted(own_columns, np.arange(alone, len(counts) + 1))
    open_columns = np.diff(cuts) > 1
    mark = np.zeros(len(counts), bool)
    links: list[tuple[int, int]] = []
    for x in range(n):
        if x % SETTLE_EVERY == 0 and x:
            # Columns whose rows are all joined up need no product any more.
            if (label == label[0]).all():
                break
            some = np.flatnonzero(np.diff(cuts) > 0)
            own = label[holders]
            same = np.minimum.reduceat(own, cuts[some]) == np.maximum.reduceat(own, cuts[some])
            open_columns[some[same]] = False
        first = entries[starts[x] : starts[x] + lengths[x]]
        first = first[first >= alone] - alone
        first = first[open_columns[first]]
        if not len(first):
            continue
        met = np.concatenate([holders[cuts[c] : cuts[c + 1]] for c in first.tolist()])
        met = met[(met > x) & (label[met] != label[x])]
        if side is not None:
            met = met[side[met] != side[x]]
        if not len(met):
            continue
        rows, overlap = np.unique(met, return_counts=True)
        needed = least_overlap(sizes[x], sizes[rows], percent)
        open_rest = np.where(last[rows] < last[x], rest[rows], rest[x])
        rows, needed = (v[(overlap + open_rest >= needed) & (sizes[x] >= needed)] for v in (rows, needed))
        if not len(rows):
            continue
        mark[entries[starts[x] : starts[x + 1]]] = True
        whole = np.concatenate([entries[starts[y] : starts[y + 1]] for y in rows.tolist()])
        products = np.add.reduceat(mark[whole], np.concatenate(([0], np.cumsum(sizes[rows])[:-1])), dtype=np.int64)
        mark[entries[starts[x] : starts[x + 1]]] = False
        for y in rows[products >= needed].tolist():
            if label[y] != label[x]:
                links.append((int(order[x]), int(order[y])))
                label[label == label[y]] = label[x]
    return links


def links(found: DataFrame, percent: int, block_bytes: int = ROW_BLOCK_BYTES) -> DataFrame:
    """Edges (a, b) between rows that connect exactly what is similar enough."""
    sets = written(
        found.filter("own IS NOT NULL").select("row", "own", band_of(F.col("size"), percent).alias("band"))
        .join(row_groups(found, percent), "row"),
        "row-sets",
    )
    size = F.sum(F.octet_length("own"))
    groups = sets.groupBy("component").agg(size.alias("bytes"))
    large = written(groups.filter(F.col("bytes") > block_bytes).select("component"), "large-groups")
    blocks = written(
        sets.join(large, "component").groupBy("component", "band").agg(F.ceil(size / block_bytes).cast("int").alias("blocks")),
        "row-blocks",
    )
    total = sets.agg(size).first()[0] or 0
    # Small groups share blocks; a negative number tells them from large groups.
    packs = max(1, math.ceil(total / block_bytes))
    placed = (
        sets.join(blocks, ["component", "band"], "left")
        .withColumn("own_block", F.pmod(F.hash("row"), F.coalesce("blocks", F.lit(1))))
        .withColumn("group", F.when(F.col("blocks").isNull(), -1 - F.pmod(F.xxhash64("component"), F.lit(packs))).otherwise(F.col("component")))
        .withColumn("at", F.when(F.col("blocks").isNull(), 0).otherwise(F.col("band")))
    )

    def numbers(rows: pa.Table, name: str) -> np.ndarray:
        return rows.column(name).to_numpy()

    def edges(rows: pa.Table, pairs: list[tuple[int, int]]) -> pa.Table:
        row, pairs = numbers(rows, "row"), np.array(pairs, np.int64).reshape(-1, 2)
        return pa.table({"a": row[pairs[:, 0]], "b": row[pairs[:, 1]]})

    def sets_of(rows: pa.Table) -> list[np.ndarray]:
        return [np.frombuffer(x, np.uint64) for x in rows.column("own").to_pylist()]

    def alone(rows: pa.Table) -> pa.Table:
        return edges(rows, product_links(sets_of(rows), percent))

    def across(rows: pa.Table) -> pa.Table:
        return edges(rows, product_links(sets_of(rows), percent, numbers(rows, "label"), numbers(rows, "side")))

    inner = written(placed.select("group", "at", "own_block", "row", "own").groupBy("group", "at", "own_block").applyInArrow(tidy(alone), "a long, b long"), "inner-links")
    if large.isEmpty():
        return inner
    labels = written(components(inner), "inner-components")
    marked = (
        placed.filter("blocks IS NOT NULL").join(labels.select(F.col("node").alias("row"), F.col("component").alias("label")), "row", "left")
        .select("component", "band", "own_block", "row", "own", F.coalesce("label", "row").alias("label"))
    )
    # Each row goes to the pairs of its block with those of its band and the neighbouring ones.
    near = blocks.select(
        "component", F.explode(F.array(F.col("band") - 1, F.col("band"), F.col("band") + 1)).alias("band"),
        F.col("band").alias("other_band"), F.col("blocks").alias("others"),
    )
    here, there = F.struct(F.col("band").alias("band"), F.col("own_block").alias("block")), F.struct(F.col("other_band").alias("band"), F.col("other").alias("block"))
    dealt = (
        marked.join(near, ["component", "band"])
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("others") - 1)))
        .select("component", here.alias("here"), there.alias("there"), "row", "own", "label")
        .filter("here <> there")
        .select(
            "component", F.least("here", "there").alias("one"), F.greatest("here", "there").alias("two"),
            (F.col("here") < F.col("there")).cast("int").alias("side"), "row", "own", "label",
        )
    )
    outer = dealt.groupBy("component", "one", "two").applyInArrow(tidy(across), "a long, b long")
    return written(inner.unionByName(outer), "block-links")


def ngram_components(docs: DataFrame, n: int = N, percent: int = PERCENT, block_bytes: int = ROW_BLOCK_BYTES) -> DataFrame:
    """(doc_id, n_shingles, component_id): set size, and the smallest doc_id that links lead to."""
    keyed = docs.select(
        F.col("doc_id").cast("long"), F.unhex(F.md5(text_or_empty().cast("binary"))).alias("digest"), text_or_empty().alias("text")
    )
    held = chunks(keyed)
    found = first_columns(held, n, percent)
    linked = written(components(links(found, percent, block_bytes)), "ngram-components")
    named = found.select("row", "digest", "size").join(linked.select(F.col("node").alias("row"), "component"), "row", "left")
    classes = written(named.select("digest", "size", F.coalesce("component", "row").alias("component")), "ngram-classes")
    members = keyed.select("doc_id", "digest").join(classes, "digest")
    least = written(members.groupBy("component").agg(F.min("doc_id").alias("least")), "least-members")
    return members.join(least, "component").select(
        "doc_id", F.col("size").alias("n_shingles"), F.when(F.col("size") > 0, F.col("least")).otherwise(F.col("doc_id")).alias("component_id")
    )
