"""All pairs of shingle sets with a Jaccard similarity, by prefix filtering; none is lost.

Shingles are ordered by how many rows hold them, rare ones first.  Two sets of
at least the similarity share a shingle within their prefixes, as many first
shingles as may be missing in the other, plus one.  A shingle that only one row
holds links nothing, so most documents have no candidate and go no further.

Documents are kept as chunks, one row each.  A chunk sends its distinct shingles
with their counts in buckets, where those of all chunks are added up, and gets
the sums back.  Hashes are cut to ``COUNT_BITS`` bits for this, so a count may be
too high, which costs time, but never too low.  Sets that share a shingle in
their prefixes are candidates; what candidates connect meets in one group, or
in pairs of blocks if it is over ``BLOCK_BYTES``, and is compared there as sets.
A pair is left out only if verified pairs connect its members already.
"""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spindrift.llm.common import batch_of, tidy, utf8, written
from spindrift.llm.components import components

SEED = 42
CHUNK_BYTES = 1 << 20
DOCS_AT_ONCE, CHUNKS_AT_ONCE = 1000, 8
COUNT_BITS = 40
BUCKET_SHINGLES = 1 << 21
BLOCK_BYTES = 1 << 21

CHUNK = pa.schema(
    [("chunk", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("of", pa.list_(pa.int64())),
     ("nodes", pa.list_(pa.int64())), ("texts", pa.list_(pa.binary())), ("shingles", pa.int64())]
)


def shingle_hashes(text: bytes, shingle: int) -> np.ndarray:
    """XXH64 of each run of ``shingle`` words joined by a space; of all words if they are fewer."""
    from xxhash import xxh64_intdigest

    words = text.lower().split()
    if not words:
        return np.empty(0, np.uint64)
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    n = max(1, len(words) - shingle + 1)
    spans = zip(starts[:n].tolist(), ends[min(shingle, len(words)) - 1 :].tolist())
    return np.fromiter((xxh64_intdigest(joined[a:b], SEED) for a, b in spans), np.uint64, n)


def written_by(df: DataFrame, name: str, rows: int) -> DataFrame:
    """The rows as a table; workers get so many input rows at once, as these are long."""
    conf = df.sparkSession.conf
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = conf.get(key)
    conf.set(key, rows)
    try:
        return written(df, name)
    finally:
        conf.set(key, before)


def shingle_set(text: bytes, shingle: int) -> np.ndarray:
    return np.unique(shingle_hashes(text, shingle))


def digest(own: np.ndarray) -> int:
    """A signed number of the sorted set, which stands for it."""
    from xxhash import xxh3_64_intdigest

    value = xxh3_64_intdigest(own.tobytes(), SEED)
    return value - (1 << 64) if value >> 63 else value


def prefix_length(n: int, similarity: float) -> int:
    """How many first shingles of a set of ``n`` one of at least the similarity must meet."""
    return n - math.ceil(similarity * n - 1e-9) + 1


def chunks(docs: DataFrame, shingle: int) -> DataFrame:
    """Documents as rows of about ``CHUNK_BYTES`` of text, with a text for each different set in them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk = TaskContext.get().partitionId() << 32
        ids, of, texts, held, n = [], [], {}, 0, 0

        def row() -> pa.RecordBatch:
            return batch_of(CHUNK, [chunk], [ids], [of], [list(texts)], [list(texts.values())], [n])

        for batch in batches:
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), utf8(batch.column("text"))):
                own = shingle_set(text, shingle)
                node = digest(own)
                ids.append(doc_id), of.append(node)
                held += 16
                if node not in texts:
                    texts[node] = text
                    held, n = held + len(text), n + len(own)
                if held >= CHUNK_BYTES:
                    yield row()
                    chunk, ids, of, texts, held, n = chunk + 1, [], [], {}, 0, 0
        if ids:
            yield row()

    rows = docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(
        tidy(run), "chunk long, doc_ids array<long>, of array<long>, nodes array<long>, texts array<binary>, shingles long"
    )
    return written_by(rows, "set-chunks", DOCS_AT_ONCE)


def digests(held: DataFrame) -> DataFrame:
    """(doc_id, node) of each document."""
    both = held.select(F.explode(F.arrays_zip("doc_ids", "of")).alias("x"))
    return both.select(F.col("x.doc_ids").alias("doc_id"), F.col("x.of").alias("node"))


def cut_hashes(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """The different hashes of all sets, cut to ``COUNT_BITS`` bits, in order, and how many sets hold each."""
    flat = np.concatenate([np.empty(0, np.uint64), *sets])
    return np.unique(flat >> np.uint64(64 - COUNT_BITS), return_counts=True)


def candidates(held: DataFrame, plan) -> DataFrame:
    """(node, tokens, set) of each set with shingles in its prefix that another row holds."""
    total = held.agg(F.sum("shingles")).first()[0] or 0
    bits = min(16, max(8, math.ceil(math.log2(max(1, total / BUCKET_SHINGLES)))))
    low = COUNT_BITS - bits
    sent = pa.schema([("chunk", pa.int64()), ("bucket", pa.int32()), ("low", pa.binary()), ("counts", pa.binary())])

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk, texts in zip(batch.column("chunk").to_pylist(), batch.column("texts")):
                values, counts = cut_hashes([shingle_set(t, plan.shingle) for t in texts.as_py()])
                cuts = np.searchsorted(values, np.arange((1 << bits) + 1, dtype=np.uint64) << np.uint64(low))
                lows, counts = (values & np.uint64((1 << low) - 1)).astype(np.uint32), counts.astype(np.uint32)
                own = np.flatnonzero(np.diff(cuts))
                spans = [slice(cuts[i], cuts[i + 1]) for i in own]
                yield batch_of(
                    sent, np.full(len(own), chunk), own.astype(np.int32),
                    [lows[x].tobytes() for x in spans], [counts[x].tobytes() for x in spans],
                )

    def add_up(rows: pa.Table) -> pa.Table:
        lows = [np.frombuffer(x, np.uint32) for x in rows.column("low").to_pylist()]
        counts = np.concatenate([np.frombuffer(x, np.uint32) for x in rows.column("counts").to_pylist()])
        values, place = np.unique(np.concatenate(lows), return_inverse=True)
        sums = np.minimum(np.bincount(place, counts, len(values)), (1 << 32) - 1).astype(np.uint32)[place]
        ends = np.cumsum([len(x) for x in lows])
        answers = [sums[b - len(x) : b].tobytes() for x, b in zip(lows, ends)]
        return pa.table(
            {"chunk": rows.column("chunk"), "bucket": rows.column("bucket"), "sums": pa.array(answers, pa.binary())}
        )

    counted = (
        held.select("chunk", "texts").mapInArrow(tidy(send), "chunk long, bucket int, low binary, counts binary")
        .groupBy("bucket").applyInArrow(tidy(add_up), "chunk long, bucket int, sums binary")
    )
    found = written_by(counted, "shingle-counts", CHUNKS_AT_ONCE)
    back = found.groupBy("chunk").agg(F.sort_array(F.collect_list(F.struct("bucket", "sums"))).sums.alias("sums"))
    out = pa.schema([("node", pa.int64()), ("tokens", pa.list_(pa.int64())), ("set", pa.binary())])

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for nodes, texts, sums in zip(*(batch.column(c) for c in ("nodes", "texts", "sums"))):
                sets = [shingle_set(t, plan.shingle) for t in texts.as_py()]
                values, _ = cut_hashes(sets)
                rows = np.frombuffer(b"".join(sums.as_py()), np.uint32)
                kept = []
                for node, own in zip(nodes.as_py(), sets):
                    often = rows[np.searchsorted(values, own >> np.uint64(64 - COUNT_BITS))]
                    first = np.lexsort((own, often))[: prefix_length(len(own), plan.similarity)]
                    tokens = own[first[often[first] > 1]]
                    if len(tokens):
                        kept.append((node, tokens.view(np.int64), own.tobytes()))
                if kept:
                    yield batch_of(out, *map(list, zip(*kept)))

    joined = held.select("chunk", "nodes", "texts").join(back, "chunk").select("nodes", "texts", "sums")
    rows = joined.mapInArrow(tidy(pick), "node long, tokens array<long>, set binary")
    return written_by(rows, "candidates", CHUNKS_AT_ONCE)


def alike(x: np.ndarray, y: np.ndarray, similarity: float) -> bool:
    shared = len(np.intersect1d(x, y, assume_unique=True))
    return shared >= similarity * (len(x) + len(y) - shared)


def forest(sets: list[np.ndarray], similarity: float) -> list[tuple[int, int]]:
    """Links of verified pairs that connect exactly what all pairs of at least the similarity connect."""
    flat, at, counts = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    rank = np.empty(len(flat), np.int64)
    rank[np.argsort(counts, kind="stable")] = np.arange(len(flat))
    once = int((counts == 1).sum())
    sizes = np.array([len(s) for s in sets])
    own = np.split(rank[at], np.cumsum(sizes)[:-1])
    up, links = list(range(len(sets))), []
    holders: dict[int, dict[int, list[int]]] = defaultdict(dict)  # by shingle, and by what they were linked to

    def root(x: int) -> int:
        while up[x] != x:
            up[x] = x = up[up[x]]
        return x

    for x in np.argsort(sizes, kind="stable").tolist():
        mine = np.sort(own[x])
        first = mine[: prefix_length(len(mine), similarity)]
        first = first[first >= once].tolist()
        tried: set[int] = set()
        for token in first:
            for linked, members in holders[token].items():
                for y in members:
                    if root(linked) == root(x):
                        break
                    if y in tried:
                        continue
                    tried.add(y)
                    if sizes[y] >= similarity * len(mine) - 1e-9 and alike(own[x], own[y], similarity):
                        links.append((x, y))
                        up[root(x)] = root(y)
        for token in first:
            holders[token].setdefault(root(x), []).append(x)
    return links


def links(held: DataFrame, plan, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Edges (a, b) between nodes that connect exactly what is similar enough."""
    found = candidates(held, plan)
    tokens = written(found.select(F.explode("tokens").alias("token"), "node").distinct(), "tokens")
    least = written(
        tokens.groupBy("token").agg(F.min("node").alias("least"), F.max("node").alias("most"))
        .filter("least <> most").select("token", "least"),
        "least-nodes",
    )
    stars = tokens.join(least, "token").filter("node <> least")
    linked = written(components(stars.select(F.col("node").alias("a"), F.col("least").alias("b"))), "candidate-groups")
    sets = written(found.select("node", "set").join(linked, "node").dropDuplicates(["node"]), "candidate-sets")
    large = sets.groupBy("component").agg(F.sum(F.octet_length("set")).alias("bytes")).filter(F.col("bytes") > block_bytes)
    blocks = written(large.select("component", F.ceil(F.col("bytes") / block_bytes).cast("int").alias("blocks")), "blocks")
    marked = sets.join(blocks, "component", "left").fillna(1, ["blocks"])
    own = F.pmod(F.hash("node"), F.col("blocks"))
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    dealt = marked.select("component", "blocks", own.alias("own"), other.alias("other"), "node", "set").select(
        "component", F.least("own", "other").alias("one"), F.greatest("own", "other").alias("two"), "own", "node", "set"
    )

    def compare(rows: pa.Table) -> pa.Table:
        node, side = rows.column("node").to_numpy(), rows.column("own").to_numpy()
        # Links within a block are found where it stands alone.
        alone = rows.column("one")[0].as_py() == rows.column("two")[0].as_py()
        pairs = forest([np.frombuffer(x, np.uint64) for x in rows.column("set").to_pylist()], plan.similarity)
        pairs = np.array([(a, b) for a, b in pairs if alone or side[a] != side[b]], np.int64).reshape(-1, 2)
        return pa.table({"a": node[pairs[:, 0]], "b": node[pairs[:, 1]]})

    return dealt.groupBy("component", "one", "two").applyInArrow(tidy(compare), "a long, b long")
