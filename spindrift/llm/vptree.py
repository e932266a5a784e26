"""Nearest neighbours by inner product with a vantage-point tree for each shard.

Rows are dealt evenly into shards of about ``shard_rows``; each shard's tree is
built in one task and kept as one row of a table.  Queries travel in blocks of
``block_rows``, one copy of a block for each shard, and every pair of a block
and a tree is searched in one go: a node's distances to all its live queries
are one matrix product.

The largest inner product becomes the smallest Euclidean distance once every
vector has one more component, the root of what its squared length lacks to the
shard's largest; queries get a zero there.  A child is passed by if ``factor``
times the least distance that the triangle inequality allows for it exceeds the
distance of the query's k-th best so far.  Factor one is exact search; larger
factors pass by more.  Scores are inner products of the original vectors in
double precision whatever the factor.

Defined cases: vectors that are null, empty or zero, or hold a null or
non-finite component, take no part; vectors meet only those of their own
length; a row never finds rows with its own vec_id; every row is a query of its
own, so repeated rows give repeated results; rows with a null vec_id take no
part, as they could not be named; equal scores go to the smaller vec_id; no
rows give no rows; only the id and the vector column are read, so other columns
cannot clash.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spindrift.llm.common import batch_of, tidy, written

SHARD_ROWS = 16_384
BLOCK_ROWS = 512
LEAF = 128
FACTOR = 1.5
PAIRS_AT_ONCE = 1 << 14
SLACK = 1e-9


class Tree:
    """A vantage-point tree over the rows of ``vectors``; leaves are stretches of ``order``."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, leaf: int = LEAF):
        self.ids, self.vectors = ids, vectors
        wide = vectors.astype(np.float64)
        square = np.einsum("ij,ij->i", wide, wide)
        self.most = float(square.max())
        full = np.column_stack([wide, np.sqrt(np.maximum(0.0, self.most - square))])
        self.order = np.arange(len(ids))
        self.nodes: list[tuple] = []  # ("leaf", start, end) or ("node", vantage, inner, outer, four distances)
        self.split(full, 0, len(ids), leaf)

    def split(self, full: np.ndarray, start: int, end: int, leaf: int) -> int:
        at = len(self.nodes)
        if end - start <= leaf:
            self.nodes.append(("leaf", start, end))
            return at
        self.nodes.append(())
        own = self.order[start:end]
        # A point far from the middle of a few parts its shard best.
        some = own[:: max(1, len(own) // 64)]
        vantage = int(some[np.argmax(np.square(full[some] - full[some].mean(axis=0)).sum(axis=1))])
        away = np.sqrt(np.square(full[own] - full[vantage]).sum(axis=1))
        rank = np.argsort(away, kind="stable")
        self.order[start:end], away = own[rank], away[rank]
        half = len(own) // 2
        inner = self.split(full, start, start + half, leaf)
        outer = self.split(full, start + half, end, leaf)
        self.nodes[at] = ("node", vantage, inner, outer, away[0], away[half - 1], away[half], away[-1])
        return at

    def pack(self) -> bytes:
        kept = self.ids[self.order], self.vectors[self.order]
        back = np.argsort(self.order)
        nodes = [n if n[0] == "leaf" else ("node", int(back[n[1]]), *n[2:]) for n in self.nodes]
        return pickle.dumps((*kept, self.most, nodes), protocol=5)


def exact_products(x: np.ndarray, rows: np.ndarray, y: np.ndarray, columns: np.ndarray) -> np.ndarray:
    """Inner products of pairs of rows; equal vectors give equal products."""
    out = np.empty(len(rows))
    for at in range(0, len(rows), PAIRS_AT_ONCE):
        part = slice(at, at + PAIRS_AT_ONCE)
        out[part] = (x[rows[part]] * y[columns[part]]).sum(axis=1)
    return out


class Search:
    """One block of queries against one packed tree."""

    def __init__(self, packed: bytes, ids: np.ndarray, queries: np.ndarray, k: int, factor: float):
        self.ids, vectors, self.most, self.nodes = pickle.loads(packed)
        self.vectors = vectors.astype(np.float64)
        self.own, self.queries, self.k, self.factor = ids, queries.astype(np.float64), k, factor
        self.square = np.einsum("ij,ij->i", self.queries, self.queries)
        self.score = np.full((len(ids), k), -np.inf)
        self.found = np.full((len(ids), k), np.iinfo(np.int64).max)
        self.looked = 0

    def distance(self, score: np.ndarray, who: np.ndarray) -> np.ndarray:
        return np.sqrt(np.maximum(0.0, self.square[who] + self.most - 2 * score))

    def leaf(self, who: np.ndarray, start: int, end: int) -> None:
        self.looked += len(who) * (end - start)
        last = self.score[who, -1]
        score = self.queries[who] @ self.vectors[start:end].T
        near = score >= (last - SLACK * (1 + np.abs(last)))[:, None]
        row, column = np.nonzero(near & (self.ids[start:end] != self.own[who][:, None]))
        # Products of blocks round by the blocks' shape; those that count are summed one by one in one order.
        score[row, column] = exact_products(self.queries, who[row], self.vectors, start + column)
        kept = score[row, column] >= last[row]
        row, column = row[kept], column[kept]
        if not len(row):
            return
        some, n = np.unique(row, return_counts=True)
        query = np.concatenate([np.repeat(some, self.k), row])
        scores = np.concatenate([self.score[who[some]].ravel(), score[row, column]])
        ids = np.concatenate([self.found[who[some]].ravel(), self.ids[start + column]])
        order = np.lexsort((ids, -scores, query))
        first = np.concatenate(([0], np.cumsum(n + self.k)[:-1]))
        best = order[(first[:, None] + np.arange(self.k)).ravel()].reshape(-1, self.k)
        self.score[who[some]], self.found[who[some]] = scores[best], ids[best]

    def home(self, at: int, who: np.ndarray) -> None:
        """First the leaf in which a query itself would stand, for a good k-th best to prune by."""
        node = self.nodes[at]
        if not len(who):
            return
        if node[0] == "leaf":
            self.leaf(who, *node[1:])
            return
        _, vantage, inner, outer, _, a, b, _ = node
        near = self.distance(self.queries[who] @ self.vectors[vantage], who) <= (a + b) / 2
        self.home(inner, who[near]), self.home(outer, who[~near])

    def visit(self, at: int, who: np.ndarray) -> None:
        node = self.nodes[at]
        if node[0] == "leaf":
            self.leaf(who, *node[1:])
            return
        _, vantage, inner, outer, *bounds = node
        d = self.distance(self.queries[who] @ self.vectors[vantage], who)
        for child, low, high in ((inner, *bounds[:2]), (outer, *bounds[2:])):
            least = np.maximum(0.0, np.maximum(d - high, low - d))
            last = self.score[who, -1]
            reach = np.where(np.isinf(last), np.inf, self.distance(np.where(np.isinf(last), 0, last), who))
            live = self.factor * least <= reach + SLACK * (1 + d)
            if live.any():
                self.visit(child, who[live])

    def run(self) -> None:
        everyone = np.arange(len(self.own))
        self.home(0, everyone)
        # What the home leaf gave only serves to prune: it is found again, so start from an empty result.
        kept, self.score = self.score, np.nextafter(self.score, -np.inf)
        self.found = np.full_like(self.found, np.iinfo(np.int64).max)
        self.score[:, :-1] = kept[:, -1:]
        self.score = np.nextafter(self.score, -np.inf)
        self.visit(0, everyone)


def usable(vector: Column) -> Column:
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return vector.isNotNull() & F.coalesce(finite, F.lit(False)) & F.exists(vector, lambda x: x != 0)


def packed(frame: DataFrame, keys: list[str], pack, name: str) -> DataFrame:
    """One row with a binary for each group of rows; groups are of bounded size."""

    def run(group: pa.Table) -> pa.Table:
        ids = group.column("vec_id").to_numpy()
        vectors = np.array(group.column("embedding").combine_chunks().flatten()).reshape(len(ids), -1)
        fixed = {k: pa.array([group.column(k)[0].as_py()], pa.int32()) for k in keys}
        return pa.table(fixed | {name: pa.array([pack(ids, vectors)], pa.binary())})

    return frame.groupBy(*keys).applyInArrow(tidy(run), ", ".join(f"{k} int" for k in keys) + f", {name} binary")


def neighbours(
    rows: DataFrame, is_query: Column, k: int = 20, factor: float = FACTOR,
    shard_rows: int = SHARD_ROWS, block_rows: int = BLOCK_ROWS, leaf: int = LEAF,
) -> DataFrame:
    """(query_id, rank, vec_id, score) for the rows of ``vec_id`` and ``embedding`` for which ``is_query`` holds."""
    own = F.col("embedding").cast("array<double>")
    good = rows.filter(F.col("vec_id").isNotNull() & usable(F.col("embedding"))).select(
        F.col("vec_id").cast("long"), own.alias("embedding"), F.size("embedding").alias("dim"),
        F.xxhash64(F.monotonically_increasing_id()).alias("row"), is_query.alias("is_query"),
    )
    good = written(good, "vectors")
    counts = good.agg(F.count("*").alias("n"), F.sum(F.col("is_query").cast("long")).alias("queries")).first()
    shards, blocks = max(1, -(-counts.n // shard_rows)), max(1, -(-(counts.queries or 0) // block_rows))
    trees = packed(
        good.withColumn("shard", F.pmod("row", F.lit(shards)).cast("int")), ["dim", "shard"],
        lambda ids, vectors: Tree(ids, vectors, leaf).pack(), "tree",
    )
    asked = packed(
        good.filter("is_query").withColumn("block", F.pmod("row", F.lit(blocks)).cast("int")), ["dim", "block"],
        lambda ids, vectors: pickle.dumps((ids, vectors), protocol=5), "queries",
    )
    each = written(asked, "query-blocks").withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))))
    pairs = written(trees, "trees").join(each, ["dim", "shard"]).select("block", "tree", "queries")
    out = pa.schema([("query_id", pa.int64()), ("query_row", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, tree, queries in zip(*(batch.column(c) for c in ("block", "tree", "queries"))):
                ids, vectors = pickle.loads(queries.as_buffer())
                search = Search(tree.as_buffer(), ids, vectors, k, factor)
                search.run()
                row, rank = np.nonzero(search.found != np.iinfo(np.int64).max)
                number = block.as_py() * (1 << 32) + row
                yield batch_of(out, ids[row], number, search.found[row, rank], search.score[row, rank])

    found = pairs.mapInArrow(tidy(run), "query_id long, query_row long, vec_id long, score double")
    order = Window.partitionBy("query_id", "query_row").orderBy(F.desc("score"), "vec_id")
    best = found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return best.select("query_id", "rank", "vec_id", "score")
