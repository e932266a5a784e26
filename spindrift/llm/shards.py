"""Minimax contiguous partition of documents into shards, with DataFrame functions only.

Equal texts form one group, which stays together.  Groups stand in the order of
their SHA-256.  The smallest shard capacity for which the groups, cut in that
order, fit into the given number of shards is found by binary search; each
capacity is checked greedily.

The driver never sees the groups.  It holds running totals at some boundaries,
first at 4,096 equal slices of the digest space.  A check that takes each cut
at the last known boundary shows that a capacity suffices; one that lets a cut
fall anywhere inside an unknown stretch shows that it does not.  Both are run
for some capacities between the two bounds, and the stretches that their cuts
stop in are split by one small aggregation a round.  Known boundaries stay, and
each round adds some, so the bounds close in until they meet: the capacity is
then exact, however unequal the groups are.

Defined cases: null text counts as empty; empty texts form a group like any
other; a null or repeated doc_id is kept, one slot for each row; no rows give
no rows; only ``doc_id`` and ``text`` are read of the input, so other columns
cannot clash.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Callable
from itertools import pairwise

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spindrift.llm.common import text_or_empty, written

BUCKET_DIGITS = 3
SLICES = 64
POINTS = 16
SLOT_BUCKETS = 1024


class Boundaries:
    """Known group boundaries by running total; ``counts[i]`` groups of one bucket end behind ``ends[i - 1]``, up to ``ends[i]``."""

    def __init__(self, ends: list[int], counts: list[int], buckets: list[int]):
        self.ends = [0, *ends]
        self.counts = [1, *counts]
        self.buckets = [-1, *buckets]

    @property
    def total(self) -> int:
        return self.ends[-1]

    def stretch(self, limit: int) -> int | None:
        """The stretch of several groups that the limit falls into, if it does."""
        i = bisect_right(self.ends, limit)
        return i if i < len(self.ends) and self.counts[i] > 1 else None

    def last_known(self, limit: int) -> int:
        return self.ends[bisect_right(self.ends, limit) - 1]

    def furthest(self, limit: int) -> int:
        """No boundary up to ``limit`` lies beyond this."""
        return self.last_known(limit) if self.stretch(limit) is None else limit

    def cuts(self, capacity: int, shards: int, step) -> list[int]:
        """Greedy cuts; the last is the total if the capacity suffices."""
        found, at = [], 0
        for _ in range(shards):
            at = min(self.total, step(at + capacity))
            found.append(at)
        return found

    def fits(self, capacity: int, shards: int, step) -> bool:
        return self.cuts(capacity, shards, step)[-1] == self.total

    def smallest(self, shards: int, step) -> int:
        low, high = -(-self.total // shards), self.total
        while low < high:
            middle = (low + high) // 2
            low, high = (low, middle) if self.fits(middle, shards, step) else (middle + 1, high)
        return low

    def stops(self, capacities: list[int], shards: int) -> list[int]:
        """Stretches that cuts of these capacities fall into."""
        found = set()
        for capacity in capacities:
            for step in (self.last_known, self.furthest):
                starts = [0, *self.cuts(capacity, shards, step)[:-1]]
                found |= {self.stretch(at + capacity) for at in starts}
        return sorted(found - {None})

    def split(self, parts: dict[int, list[tuple[int, int, int]]]) -> None:
        """Put in what is known of some stretches: least and greatest end, and number, of the groups of each slice."""
        for i in sorted(parts, reverse=True):
            new = []
            for least, greatest, n in sorted(parts[i]):
                new += [(least, 1)] + ([(greatest, n - 1)] if n > 1 else [])
            assert sum(n for _, n in new) == self.counts[i] and len(new) > 1 and new[-1][0] == self.ends[i]
            self.ends[i : i + 1] = [end for end, _ in new]
            self.counts[i : i + 1] = [n for _, n in new]
            self.buckets[i : i + 1] = [self.buckets[i]] * len(new)

    def even_cuts(self, capacity: int, shards: int) -> list[int]:
        """Known cuts within the capacity, each as near as may be to an equal share of what is left."""
        needed = [self.total]
        for _ in range(shards - 1):
            needed.append(self.ends[bisect_left(self.ends, max(0, needed[-1] - capacity))])
        needed.reverse()  # needed[s]: shards from s on can hold all that follows it
        found, at = [], 0
        for s in range(shards - 1):
            share = at + (self.total - at) // (shards - s)
            low = bisect_left(self.ends, max(at, needed[s]))
            high = bisect_right(self.ends, at + capacity) - 1
            i = min(max(bisect_left(self.ends, share), low), high)
            if i > low and share - self.ends[i - 1] < self.ends[i] - share:
                i -= 1
            at = self.ends[i]
            found.append(at)
        return found


def group_ends(keyed: DataFrame) -> tuple[DataFrame, Boundaries]:
    """Running total at each group's end, and the boundaries known so far: one for each bucket of digests."""
    bucket = F.conv(F.substring("key", 1, BUCKET_DIGITS), 16, 10).cast("int")
    groups = written(
        keyed.groupBy("key").agg(F.sum("size").alias("bytes")).withColumn("bucket", bucket), "shard-groups"
    )
    sums = groups.groupBy("bucket").agg(F.sum("bytes").alias("bytes"), F.count("*").alias("n"))
    buckets = sums.orderBy("bucket").collect()  # at most 16 ** BUCKET_DIGITS rows
    ends, starts, at = [], [], 0
    for row in buckets:
        starts.append((row.bucket, at))
        at += row.bytes
        ends.append(at)
    offsets = groups.sparkSession.createDataFrame(starts, "bucket int, before long")
    running = F.sum("bytes").over(Window.partitionBy("bucket").orderBy("key"))
    placed = groups.join(F.broadcast(offsets), "bucket").select("bucket", "key", (F.col("before") + running).alias("end"))
    known = Boundaries(ends, [row.n for row in buckets], [row.bucket for row in buckets])
    return written(placed, "shard-ends"), known


def slices_of(ends: DataFrame, known: Boundaries, stretches: list[int]) -> dict[int, list[tuple[int, int, int]]]:
    """Least and greatest end, and number, of the groups in equal slices of each stretch."""
    wanted = [(known.buckets[i], i, known.ends[i - 1], known.ends[i]) for i in stretches]
    # At most two stretches for each shard, capacity tried and way to cut.
    table = ends.sparkSession.createDataFrame(wanted, "bucket int, stretch long, low long, high long")
    width = F.col("high") - F.col("low")
    found = (
        ends.join(F.broadcast(table), "bucket").filter("end > low AND end <= high")
        .groupBy("stretch", F.floor((F.col("end") - F.col("low") - 1).cast("double") / width * SLICES).alias("slice"))
        .agg(F.min("end").alias("least"), F.max("end").alias("greatest"), F.count("*").alias("n"))
        .collect()  # at most SLICES rows for each stretch
    )
    parts: dict[int, list[tuple[int, int, int]]] = {i: [] for i in stretches}
    for row in found:
        parts[row.stretch].append((row.least, row.greatest, row.n))
    return parts


def settle(known: Boundaries, shards: int, look: Callable[[list[int]], dict[int, list[tuple[int, int, int]]]]) -> int:
    """The smallest capacity, with stretches split as far as it takes to be sure of it.

    ``look`` tells of some stretches what ``Boundaries.split`` takes.  A capacity that
    suffices only inside a stretch has a cut that stops there, so there is always one to split.
    """
    while True:
        enough = known.smallest(shards, known.last_known)
        least = known.smallest(shards, known.furthest)
        if least >= enough:
            return enough
        tried = sorted({least + (enough - least) * k // POINTS for k in range(POINTS + 1)})
        known.split(look(known.stops(tried, shards)))


def shard_by_bytes(docs: DataFrame, shards: int = 16) -> DataFrame:
    """Give each row a shard of near equal bytes and a slot there; equal texts share a shard."""
    text = text_or_empty()
    keyed = written(
        docs.select(
            "doc_id",
            (F.octet_length(text) + 1).cast("long").alias("size"),
            F.crc32(text.cast("binary")).alias("text_crc32"),
            F.sha2(text.cast("binary"), 256).alias("key"),
        ),
        "shard-keys",
    )
    ends, known = group_ends(keyed)
    capacity = settle(known, shards, lambda stretches: slices_of(ends, known, stretches))
    cuts = known.even_cuts(capacity, shards)
    keys = {0: ""} | {row.end: row.key for row in ends.filter(F.col("end").isin(cuts)).collect()}
    shard = sum((F.col("key") > keys[cut]).cast("int") for cut in cuts) if cuts else F.lit(0)
    placed = keyed.withColumn("shard", shard.cast("int")).withColumn(
        "part", F.pmod(F.xxhash64("doc_id", "text_crc32"), F.lit(SLOT_BUCKETS)).cast("int")
    )
    counts = placed.groupBy("shard", "part").agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy("shard").orderBy("part")) - F.col("n")
    offsets = counts.select("shard", "part", before.alias("before"))  # at most shards * SLOT_BUCKETS rows
    rank = F.row_number().over(Window.partitionBy("shard", "part").orderBy("doc_id", "text_crc32", "size"))
    return (
        placed.withColumn("rank", rank)
        .join(F.broadcast(offsets), ["shard", "part"])
        .select(
            "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard",
            (F.col("before") + F.col("rank") - 1).alias("slot"), F.lit(None).cast("int").alias("grown_shard"),
        )
    )


def smallest_capacity(sizes: list[int], shards: int) -> int:
    """The same capacity for sizes in a list, found by the same greedy check."""
    ends, at = [], 0
    for size in sizes:
        at += size
        ends.append(at)
    known = Boundaries(ends, [1] * len(ends), [0] * len(ends))
    assert all(b > a for a, b in pairwise(known.ends))
    return known.smallest(shards, known.last_known)
