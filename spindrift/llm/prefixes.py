"""Prefix trie of conversations by collapsing whole sequences.

Turns stand in order within their conversation; each conversation is rebuilt on
the first turns of another one.  Every row of a rebuilt conversation carries a
128-bit key of the sequence up to it, a running sum of mixed turn digests.
Conversations with the same last key are one weighted sequence with a list of
ends.  An anti-join with the proper prefixes tells which sequences are leaves.
What a node says about its subtree is then a sum over the weighted sequences
that start with it, so nothing is sent from node to node:

* members and leaves are sums over those sequences;
* each node is owned by its smallest member, and what a member owns is a suffix
  of it, so a subtree's own text is what its members own, cut at the node.

No conversation is held as one value and none is bound to one task: rows are
dealt by ranges of (conversation, turn), and each range's running sums are
shifted by what the ranges before it leave over, one row for each range.
Digests of ends are hashed from blocks of sorted ids, read as a stream.

Defined cases: null role or text is empty; turns with equal numbers stand in the
order of their MD5, null numbers first; repeated rows are turns of their own;
rows without a conversation are no turns; a conversation that is rebuilt to
nothing ends at the root; no conversations give no nodes; only ``conv_id``,
``turn``, ``role`` and ``text`` are read, so other columns cannot clash.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spindrift.llm.common import batch_of, tidy, written

GROUP, MOST_HEAD = 100, 5
BLOCK_IDS = 1 << 15
NO_ENDS = hashlib.sha256(b"").hexdigest()
# Odd multipliers of a splitting generator; fixed values.
MIX_A, MIX_B, MIX_STEP = 0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0x9E3779B97F4A7C15


def turns(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, digest, chars); a digest stands for role and text."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    digest = F.unhex(F.md5(F.concat_ws(":", F.length(role).cast("string"), role, text)))
    return conversations.filter("conv_id IS NOT NULL").select(
        F.col("conv_id").cast("long"), "turn", digest.alias("digest"), F.length(text).cast("long").alias("chars")
    )


def head_length(conv_id: Column) -> Column:
    """How many turns a conversation takes over from the first of its group."""
    return (F.crc32(conv_id.cast("string").cast("binary")) % (MOST_HEAD + 1)).cast("int")


def running(rows: DataFrame, order: list[str], values: Callable[[pa.RecordBatch], np.ndarray], names: list[str]) -> DataFrame:
    """Rows with running sums, within ``conv_id`` and in ``order``, of what ``values`` gives for a batch.

    Sums are 64-bit numbers that wrap around.  Rows are dealt by ranges of
    (conv_id, order), so a long conversation is spread over tasks.
    """
    kept = rows.schema
    fields = [f"{n} long" for n in names]
    dealt = rows.repartitionByRange("conv_id", *order).sortWithinPartitions("conv_id", *order)

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, last, carry = TaskContext.get().partitionId(), None, np.zeros(len(names), np.uint64)
        for batch in batches:
            if not batch.num_rows:
                continue
            conv = batch.column("conv_id").to_numpy()
            own = values(batch)
            sums = np.cumsum(own, axis=0, dtype=np.uint64)
            first = np.concatenate(([True], conv[1:] != conv[:-1]))
            at = np.maximum.accumulate(np.where(first, np.arange(len(conv)), 0))
            sums -= sums[at] - own[at]
            if conv[0] == last:
                sums[at == 0] += carry
            last, carry = conv[-1], sums[-1].copy()
            extra = [pa.array(s.view(np.int64)) for s in np.ascontiguousarray(sums.T)]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(np.full(len(conv), part, np.int64)), *extra], [*batch.schema.names, "part", *names]
            )

    ddl = ", ".join([f"{f.name} {f.dataType.simpleString()}" for f in kept] + ["part long", *fields])
    held = written(dealt.mapInArrow(tidy(local), ddl), "running")
    before = carried(held, names)

    def shift(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sums = np.stack([batch.column(n).to_numpy() for n in names], axis=1).view(np.uint64) if batch.num_rows else None
            if sums is not None:
                conv, part = batch.column("conv_id").to_numpy(), batch.column("part").to_numpy()
                for p in np.unique(part):
                    if p in before:
                        first, carry = before[p]
                        sums[(part == p) & (conv == first)] += carry
                extra = [pa.array(s.view(np.int64)) for s in np.ascontiguousarray(sums.T)]
                own = [batch.column(f.name) for f in kept]
                yield pa.RecordBatch.from_arrays([*own, *extra], [*kept.names, *names])

    return held.mapInArrow(tidy(shift), ", ".join([f"{f.name} {f.dataType.simpleString()}" for f in kept] + fields))


def carried(held: DataFrame, names: list[str]) -> dict[int, tuple[int, np.ndarray]]:
    """For each range that goes on with the conversation of the one before: that conversation, and its sums so far.

    Reads one row for each range.
    """
    count = F.struct("conv_id", F.col(names[0]).alias("no"), *[F.col(n).alias(f"last_{n}") for n in names])
    ranges = held.groupBy("part").agg(F.min("conv_id").alias("first"), F.max(count).alias("end")).orderBy("part").collect()
    before, last, sums = {}, None, np.zeros(len(names), np.uint64)
    for row in ranges:
        own = np.array([row.end[f"last_{n}"] for n in names], np.int64).view(np.uint64)
        if row["first"] == last:
            before[row.part] = last, sums
        sums = sums + own if row.end.conv_id == last else own
        last = row.end.conv_id
    return before


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(MIX_A)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(MIX_B)
    return x ^ (x >> np.uint64(31))


def turn_values(batch: pa.RecordBatch) -> np.ndarray:
    """One, two words that mix a turn's digest with its place, and its length."""
    words = np.frombuffer(b"".join(batch.column("digest").to_pylist()), "<u8").reshape(-1, 2)
    place = batch.column("pos").to_numpy().astype(np.uint64) * np.uint64(MIX_STEP)
    return np.stack(
        [np.ones(len(place), np.uint64), mixed(words[:, 0] + place), mixed(words[:, 1] + mixed(place)),
         batch.column("chars").to_numpy().astype(np.uint64)],
        axis=1,
    )


def rebuilt(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """All conversations, and their rebuilt turns: (conv_id, pos, digest, chars)."""
    held = written(turns(conversations), "turns")
    ordered = written(
        running(held, ["turn", "digest"], lambda batch: np.ones((batch.num_rows, 1), np.uint64), ["pos"]), "ordered-turns"
    )
    head = F.slice(F.sort_array(F.collect_list(F.struct("pos", "digest", "chars"))), 1, MOST_HEAD)
    heads = (
        ordered.filter((F.col("conv_id") % GROUP == 0) & (F.col("pos") <= MOST_HEAD))
        .groupBy(F.col("conv_id").alias("base")).agg(head.alias("head"))
    )
    convs = held.select("conv_id").distinct()
    taken = written(
        convs.withColumn("base", F.col("conv_id") - F.col("conv_id") % GROUP).withColumn("h", head_length(F.col("conv_id")))
        .join(heads, "base", "left")
        .select("conv_id", "h", F.slice(F.coalesce("head", F.array()), F.lit(1), F.col("h")).alias("head")),
        "taken-turns",
    )
    new = taken.select("conv_id", F.explode("head").alias("t")).select("conv_id", "t.pos", "t.digest", "t.chars")
    # A conversation whose group has too few turns to take over moves up.
    short = taken.select("conv_id", (F.col("h") - F.size("head")).alias("up")).filter("up > 0")
    own = (
        ordered.filter(F.col("pos") > head_length(F.col("conv_id"))).join(short, "conv_id", "left")
        .select("conv_id", (F.col("pos") - F.coalesce("up", F.lit(0))).alias("pos"), "digest", "chars")
    )
    return taken.select("conv_id"), new.unionByName(own)


def keyed(rows: DataFrame) -> DataFrame:
    """Rebuilt turns with the key of the sequence up to them, and of the one before."""
    sums = running(rows, ["pos"], turn_values, ["depth", "a", "b", "total"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                own = turn_values(batch)
                up = [(batch.column(n).to_numpy().view(np.uint64) - own[:, i]).view(np.int64) for n, i in (("a", 1), ("b", 2))]
                columns = [batch.column(n) for n in ("conv_id", "depth", "a", "b")]
                yield pa.RecordBatch.from_arrays(
                    [*columns, *map(pa.array, up), batch.column("chars"), batch.column("total")],
                    ["conv_id", "depth", "a", "b", "up_a", "up_b", "chars", "total"],
                )

    return sums.mapInArrow(
        tidy(run), "conv_id long, depth long, a long, b long, up_a long, up_b long, chars long, total long"
    )


def id_digests(members: DataFrame) -> DataFrame:
    """(a, b, depth, ends_sha256): SHA-256 of the decimal ids of each sequence, in order and comma-joined.

    Ids become blocks of bounded size in ranges of (sequence, id); a sequence's
    blocks are then hashed as they stream by.
    """
    key = ["a", "b", "depth"]
    blocks_ddl = "a long, b long, depth long, first long, ids string"
    blocks_schema = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("depth", pa.int64()), ("first", pa.int64()), ("ids", pa.string())])
    digest_schema = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("depth", pa.int64()), ("ends_sha256", pa.string())])

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            a, b, depth, conv = (batch.column(c).to_numpy() for c in (*key, "conv_id"))
            new = (a[1:] != a[:-1]) | (b[1:] != b[:-1]) | (depth[1:] != depth[:-1])
            cuts = np.union1d(np.flatnonzero(new) + 1, np.arange(0, len(a) + BLOCK_IDS, BLOCK_IDS).clip(max=len(a)))
            first, ids = cuts[:-1], batch.column("conv_id").to_pylist()
            joined = [",".join(map(str, ids[i:j])) for i, j in zip(cuts[:-1].tolist(), cuts[1:].tolist())]
            yield batch_of(blocks_schema, a[first], b[first], depth[first], conv[first], joined)

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state = None, None
        for batch in batches:
            done = []
            for *this, ids in zip(*(batch.column(c).to_pylist() for c in (*key, "ids"))):
                if this != now:
                    if state:
                        done.append((*now, state.hexdigest()))
                    now, state = this, hashlib.sha256(ids.encode())
                else:
                    state.update(b"," + ids.encode())
            if done:
                yield batch_of(digest_schema, *map(list, zip(*done)))
        if state:
            yield batch_of(digest_schema, *([x] for x in (*now, state.hexdigest())))

    sorted_ids = members.select(*key, "conv_id").repartitionByRange(*key, "conv_id").sortWithinPartitions(*key, "conv_id")
    cut = sorted_ids.mapInArrow(tidy(blocks), blocks_ddl)
    return (
        cut.repartition(*key).sortWithinPartitions(*key, "first")
        .mapInArrow(tidy(digests), "a long, b long, depth long, ends_sha256 string")
    )


def prefix_trie(conversations: DataFrame) -> DataFrame:
    """One row for each distinct prefix of the rebuilt conversations, the empty one included."""
    convs, rows = rebuilt(conversations)
    key = ["a", "b", "depth"]
    prefixes = written(keyed(rows), "prefixes")

    # Whole sequences: the last row of each conversation, or the root.
    last = prefixes.groupBy("conv_id").agg(F.max(F.struct("depth", "a", "b", "total")).alias("end"))
    zero = F.lit(0).cast("long")
    members = written(
        convs.join(last, "conv_id", "left").select(
            "conv_id", *[F.coalesce(F.col(f"end.{c}"), zero).alias(c) for c in (*key, "total")]
        ),
        "sequence-members",
    )
    sequences = written(
        members.groupBy(*key).agg(F.count("*").alias("weight"), F.min("conv_id").alias("least"), F.first("total").alias("length")),
        "sequences",
    )
    root = sequences.select(
        F.col("least").alias("conv_id"), *[zero.alias(c) for c in ("depth", "a", "b", "up_a", "up_b", "chars", "total")]
    )
    kept = written(
        prefixes.join(sequences.select(F.col("least").alias("conv_id")), "conv_id", "left_semi").unionByName(root),
        "sequence-prefixes",
    )

    # Leaves: sequences that are no proper prefix.
    proper = (
        kept.join(sequences.select(F.col("least").alias("conv_id"), F.col("depth").alias("whole")), "conv_id")
        .filter("depth < whole").select(*key).distinct()
    )
    leaves = sequences.join(proper, key, "left_anti").select("least", F.lit(1).cast("long").alias("leaf"))

    # Each node's text belongs to its smallest member.
    owners = kept.groupBy(*key).agg(F.min("conv_id").alias("least"), F.first("chars").alias("chars"))
    owned = owners.groupBy("least").agg(F.sum("chars").alias("owned"))
    whole = written(
        sequences.select("least", "weight", "length").join(owned, "least", "left").join(leaves, "least", "left")
        .select(F.col("least").alias("conv_id"), "weight", "length", F.coalesce("owned", zero).alias("owned"), F.coalesce("leaf", zero).alias("leaf")),
        "weighted-sequences",
    )
    nodes = written(
        kept.join(whole, "conv_id").groupBy(*key).agg(
            F.min(F.struct("conv_id", "owned", "length")).alias("owner"),
            F.sum("weight").alias("n_convs"),
            F.sum("leaf").alias("n_leaves"),
            F.sum(F.col("weight") * F.col("length")).alias("member_chars"),
            F.sum("owned").alias("owned"),
            *[F.first(c).alias(c) for c in ("up_a", "up_b", "chars", "total")],
        ),
        "trie-nodes",
    )
    above = F.col("total") - F.col("chars")
    all_chars = F.col("member_chars") - F.col("n_convs") * above
    own_chars = F.col("owned") - F.col("owner.owned") + F.col("owner.length") - above
    up = [F.col("up_a").alias("a"), F.col("up_b").alias("b"), (F.col("depth") - 1).alias("depth")]
    children = written(nodes.filter("depth > 0").select(*up).groupBy(*key).agg(F.count("*").alias("n_children")), "children")
    ends = written(id_digests(members), "ends")
    parents = nodes.select(
        F.col("a").alias("up_a"), F.col("b").alias("up_b"), (F.col("depth") + 1).alias("depth"),
        F.col("owner.conv_id").alias("parent_conv_id"),
    )
    told = nodes.join(children, key, "left").join(ends, key, "left")
    # The root's keys are zero, but no node is as deep as one above it.
    return told.join(parents, ["up_a", "up_b", "depth"], "left").select(
        F.col("owner.conv_id").alias("conv_id"),
        "depth",
        "parent_conv_id",
        "n_convs",
        F.coalesce("n_children", zero).alias("n_children"),
        "n_leaves",
        (all_chars - own_chars).alias("saved_tokens"),
        F.coalesce("ends_sha256", F.lit(NO_ENDS)).alias("ends_sha256"),
    )
