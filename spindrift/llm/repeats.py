"""Removal of byte strings that occur before, with Burrows-Wheeler transforms of text shards.

Every byte covered by a ``length``-byte string that also starts earlier goes:
earlier in a document with a smaller doc_id, or earlier in the same document.

Strings meet in shards by winnowing: of the ``gram``-byte hashes inside a
string the smallest, leftmost, is its anchor, so equal strings have equal
anchors at equal places, and the strings of one anchor are one segment of text.
Segments whose anchor occurs nowhere else hold nothing that repeats.  Of
segments with equal text the first stands for all; the others are removed
whole.  Where an anchor stands in different texts, their first segments are
dealt by anchor into shards of bounded size.

In a shard the segments are sorted by suffix to the depth of ``length``, which
gives its Burrows-Wheeler transform.  Intervals of suffixes that share a prefix
are then expanded breadth first, one symbol to the left at a time: an interval
whose end is a new boundary fixes the common prefix there to the present
length, so common prefixes come by increasing value, and the expansion stops at
``length``.  Boundaries never reached part no equal strings; of the suffixes
between two others, all but the first are repeats.

An anchor with more than ``hot_segments`` different segments would make a shard
too large: its strings are compared one by one instead, as digests that Spark
aggregates.

Defined cases: null text counts as empty; texts shorter than ``length`` hold no
string; rows that share a doc_id, or have a null one, are different documents
in the order in which they are read, null ones after all others; no rows give
no rows; only ``doc_id`` and ``text`` are read of the input, so other columns
cannot clash (``cut_repeats`` keeps all columns).
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spindrift.llm.common import batch_of, identified, sliced, tidy, utf8, written

LENGTH = 100
GRAM = 32
PIECE = 1 << 20
SHARD_SYMBOLS = 1 << 20
HOT_SEGMENTS = 4096
# An odd multiplier, its inverse modulo 2 ** 64, and odd mixing multipliers.
ROOT = 0x9E3779B97F4A7C15
ROOT_INVERSE = pow(ROOT, -1, 1 << 64)
MIX_A, MIX_B = 0xBF58476D1CE4E5B9, 0x94D049BB133111EB

SEGMENTS = pa.schema(
    [("doc", pa.int64()), ("tie", pa.int64()), ("start", pa.int64()), ("n", pa.int32()), ("anchor", pa.int64()),
     ("text_hash", pa.int64())]
)
_POWERS: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base ** 0, 1, ... modulo 2 ** 64; kept for the next piece."""
    if len(_POWERS.get(base, ())) < n:
        steps = np.full(n, base, np.uint64)
        steps[0] = 1
        _POWERS[base] = np.multiply.accumulate(steps)
    return _POWERS[base]


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(MIX_A)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(MIX_B)
    return x ^ (x >> np.uint64(31))


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """The least of each ``width`` neighbours, by running minima within blocks of that width."""
    n = len(x) - width + 1
    blocks = np.pad(x, (0, -len(x) % width), constant_values=np.iinfo(x.dtype).max).reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[:n], ahead[width - 1 : width - 1 + n])


def segments_of(data: np.ndarray, valid: np.ndarray, length: int, gram: int):
    """Segments of the strings that start where ``valid`` is true: (start, strings, anchor hash, text hash)."""
    width = length - gram + 1
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum((data.astype(np.uint64) + np.uint64(1)) * powers(ROOT, len(data))[: len(data)])))
    back = powers(ROOT_INVERSE, len(data) + 1)
    grams = mixed((sums[gram:] - sums[:-gram]) * back[: len(sums) - gram])
    least = sliding_min(grams, width)
    new = np.concatenate(([True], (least[1:] != least[:-1]) | ~valid[: len(least) - 1]))
    first = np.flatnonzero(new & valid[: len(least)])
    stop = np.flatnonzero(np.concatenate((new | ~valid[: len(least)], [True])))
    last = stop[np.searchsorted(stop, first, "right")] - 1
    view = np.lib.stride_tricks.sliding_window_view(grams, width)
    anchor = np.empty(len(first), np.int64)
    for at in range(0, len(first), 1 << 16):
        own = first[at : at + (1 << 16)]
        anchor[at : at + (1 << 16)] = own + (view[own] == least[own][:, None]).argmax(axis=1)
    # A run of strings whose smallest hash occurs again further on: each goes to the next occurrence.
    again = np.flatnonzero(last > anchor)
    if len(again):
        sizes = last[again] + width - first[again]
        run = np.repeat(again, sizes)
        place = np.repeat(first[again] - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())
        same = grams[place] == least[first[run]]
        run, place = run[same], place[same]
        before = np.concatenate(([-1], place[:-1]))
        before[np.concatenate(([True], run[1:] != run[:-1]))] = -1
        begin, end = np.maximum(first[run], before + 1), np.minimum(last[run], place)
        good = begin <= end
        rest = np.ones(len(first), bool)
        rest[again] = False
        first, last = np.concatenate((first[rest], begin[good])), np.concatenate((last[rest], end[good]))
        anchor = np.concatenate((anchor[rest], place[good]))
    text = (sums[last + length] - sums[first]) * back[first]
    text = mixed(text + mixed((last - first).astype(np.uint64) * np.uint64(256) + (anchor - first).astype(np.uint64)))
    return first, last - first + 1, grams[anchor].view(np.int64), text.view(np.int64)


def pieces(docs: list[int], texts: list[bytes], length: int) -> Iterator[tuple[list[int], list[int], bytes, list[int]]]:
    """Texts joined to about ``PIECE`` bytes; longer ones cut, with ``length`` - 1 bytes more to complete each string."""
    held: tuple[list, list, list, list] = ([], [], [], [])
    size = 0
    for doc, text in zip(docs, texts):
        for at in range(0, max(1, len(text) - length + 1), PIECE):
            part = text[at : at + PIECE + length - 1]
            if len(part) < length:
                continue
            for x, v in zip(held, (doc, at, part, len(part))):
                x.append(v)
            size += len(part)
            if size >= PIECE:
                yield held[0], held[1], b"".join(held[2]), held[3]
                held, size = ([], [], [], []), 0
    if size:
        yield held[0], held[1], b"".join(held[2]), held[3]


def segments(docs: DataFrame, length: int, gram: int) -> DataFrame:
    """All segments of ``doc``, ``tie`` and ``text``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, "text", 8 << 20):
            doc, tie = batch.column("doc").to_numpy(), batch.column("tie").to_numpy()
            for rows, offsets, data, sizes in pieces(list(range(len(doc))), utf8(batch.column("text")), length):
                ends = np.cumsum(sizes)
                valid = np.ones(len(data), bool)
                for end in ends:
                    valid[end - length + 1 : end] = False
                first, n, anchor, text = segments_of(np.frombuffer(data, np.uint8), valid, length, gram)
                part = np.searchsorted(ends, first, "right")
                own = np.array(rows)[part]
                start = first - (ends - sizes)[part] + np.array(offsets)[part]
                yield batch_of(SEGMENTS, doc[own], tie[own], start, n.astype(np.int32), anchor, text)
        _POWERS.clear()

    schema = "doc long, tie long, start long, n int, anchor long, text_hash long"
    return docs.select("doc", "tie", "text").mapInArrow(tidy(run), schema)


# One shard.


def ordered(high: np.ndarray, low: np.ndarray, bits: int) -> np.ndarray:
    """Order of pairs of numbers, each below 2 ** bits or, for ``high``, what 63 bits leave."""
    n = len(high)
    if n <= 1 << 21 and bits + 21 + int(high.max()).bit_length() <= 63:
        packed = (high.astype(np.int64) << (bits + 21)) | (low.astype(np.int64) << 21) | np.arange(n)
        return np.sort(packed) & ((1 << 21) - 1)
    return np.lexsort((low, high))


def depth_order(text: np.ndarray, length: int) -> np.ndarray:
    """Suffixes in the order of their first ``length`` symbols; beyond the end stand zeros."""
    n = len(text)
    bits = max(21, n.bit_length())

    def ahead(x: np.ndarray, by: int) -> np.ndarray:
        out = np.zeros_like(x)
        out[: max(0, n - by)] = x[by:]
        return out

    pair = (text.astype(np.int64) << 9) | ahead(text.astype(np.int64), 1)
    order = ordered(pair, ahead(pair, 2), max(18, 1))
    four = (pair << 18) | ahead(pair, 2)
    rank = np.empty(n, np.int64)
    rank[order] = np.concatenate(([1], 1 + np.cumsum(np.diff(four[order]) != 0)))
    depth = 4
    while depth < length:
        step = min(depth, length - depth)
        second = ahead(rank, step)
        order = ordered(rank, second, bits)
        new = (np.diff(rank[order]) != 0) | (np.diff(second[order]) != 0)
        rank[order] = np.concatenate(([1], 1 + np.cumsum(new)))
        depth += step
    return order


def boundaries(text: np.ndarray, order: np.ndarray, length: int) -> np.ndarray:
    """For each suffix in order: does it share less than ``length`` symbols with the one before it?

    Symbol zero parts segments: what it would extend, or holds inside, is not expanded.
    """
    n = len(text)
    last = text[order - 1]  # the transform
    back = np.empty(n, np.int64)  # each symbol's row, when its suffix gets that symbol in front
    back[np.argsort(last, kind="stable")] = np.arange(n)
    known = 4
    wide = np.concatenate((text, np.zeros(known, text.dtype))).astype(np.int64)
    starts = (wide[:n] << 27) | (wide[1 : n + 1] << 18) | (wide[2 : n + 2] << 9) | wide[3 : n + 3]
    starts = starts[order]
    parted = np.concatenate(([True], np.diff(starts) != 0, [True]))
    low = np.flatnonzero(parted)[:-1]
    high = np.flatnonzero(parted)[1:]
    inside = wide[order[low][:, None] + np.arange(known - 1)] != 0
    good = inside.all(axis=1)
    low, high = low[good], high[good]
    for _ in range(known, length):
        if not len(low):
            break
        one = high - low == 1
        single = low[one][last[low[one]] != 0]
        a, b = low[~one], high[~one]
        sizes = b - a
        place = np.repeat(a - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())
        owner = np.repeat(np.arange(len(a)), sizes)
        real = last[place] != 0
        place, owner = place[real], owner[real]
        kind = (owner << 9) | last[place]
        if n <= 1 << 21:
            packed = np.sort((kind << 21) | back[place])
            kind, row = packed >> 21, packed & ((1 << 21) - 1)
        else:
            by = np.lexsort((back[place], kind))
            kind, row = kind[by], back[place][by]
        edge = np.flatnonzero(np.concatenate(([True], np.diff(kind) != 0)))[: len(kind)]
        first = np.concatenate((row[edge], back[single]))
        end = np.concatenate((row[np.append(edge[1:], len(kind)) - 1] if len(kind) else row[:0], back[single])) + 1
        new = ~parted[end]
        low, high = first[new], end[new]
        parted[high] = True
    return parted[:-1]


def repeated_starts(parts: list[bytes], length: int) -> np.ndarray:
    """Where in the joined parts, with a separator after each, a string starts that starts earlier too."""
    sizes = np.array([len(p) for p in parts])
    joined = np.frombuffer(b"\0".join(parts) + b"\0", np.uint8).astype(np.uint16) + 1
    ends = np.cumsum(sizes + 1) - 1
    joined[ends] = 0
    valid = np.ones(len(joined), bool)
    for k in range(length):
        valid[np.maximum(ends - k, 0)] = False
    order = depth_order(joined, length)
    group = np.cumsum(boundaries(joined, order, length)) - 1
    order, group = order[valid[order]], group[valid[order]]
    if not len(order):
        return order
    edge = np.flatnonzero(np.concatenate(([True], np.diff(group) != 0)))
    earliest = np.minimum.reduceat(order, edge)
    sizes = np.diff(np.append(edge, len(order)))
    return np.sort(order[order != np.repeat(earliest, sizes)])


def shard_spans(shard: pa.Table, length: int) -> pa.Table:
    """Byte spans to remove from the documents of a shard's segments."""
    shard = shard.sort_by([("doc", "ascending"), ("tie", "ascending"), ("start", "ascending")])
    parts = shard.column("content").to_pylist()
    begins = np.cumsum([0, *(len(p) + 1 for p in parts)])[:-1]
    found = repeated_starts(parts, length)
    edge = np.concatenate(([True], np.diff(found) != 1))[: len(found)]
    first = found[edge]
    last = found[np.append(np.flatnonzero(edge)[1:], len(found)) - 1] if len(found) else found
    part = np.searchsorted(begins, first, "right") - 1
    shift = shard.column("start").to_numpy()[part] - begins[part]
    return pa.table(
        {"doc": shard.column("doc").to_numpy()[part], "tie": shard.column("tie").to_numpy()[part],
         "start": first + shift, "end": last + shift + length}
    )


# All documents.


def contents(docs: DataFrame, wanted: DataFrame, length: int) -> DataFrame:
    """Texts of the wanted segments; of hot ones (shard -1) a digest for each string."""
    schema = pa.schema(
        [("shard", pa.int32()), ("doc", pa.int64()), ("tie", pa.int64()), ("start", pa.int64()), ("content", pa.binary())]
    )
    lists = wanted.groupBy("doc", "tie").agg(F.collect_list(F.struct("start", "n", "shard")).alias("wanted"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, "text", 4 << 20):
            rows = zip(*(batch.column(c).to_pylist() for c in ("doc", "tie", "wanted")), utf8(batch.column("text")))
            out: tuple[list, ...] = ([], [], [], [], [])
            for doc, tie, segs, text in rows:
                for seg in segs:
                    start, n, shard = seg["start"], seg["n"], seg["shard"]
                    if shard >= 0:
                        each = [(start, text[start : start + n + length - 1])]
                    else:
                        each = [(i, hashlib.blake2b(text[i : i + length], digest_size=16).digest()) for i in range(start, start + n)]
                    for at, content in each:
                        for x, v in zip(out, (shard, doc, tie, at, content)):
                            x.append(v)
                if len(out[0]) > 20_000:
                    yield batch_of(schema, *out)
                    out = ([], [], [], [], [])
            yield batch_of(schema, *out)

    joined = docs.select("doc", "tie", "text").join(written(lists, "wanted-segments"), ["doc", "tie"])
    return joined.mapInArrow(tidy(run), "shard int, doc long, tie long, start long, content binary")


def repeat_spans(
    docs: DataFrame, length: int = LENGTH, gram: int = GRAM,
    shard_symbols: int = SHARD_SYMBOLS, hot_segments: int = HOT_SEGMENTS,
) -> DataFrame:
    """(doc, tie, start, end) of bytes to remove, in overlapping spans."""
    place = F.struct("doc", "tie", "start")
    every = written(segments(docs, length, gram), "segments")
    common = written(every.groupBy("anchor").count().filter("count > 1").select("anchor"), "common-anchors")
    shared = written(every.join(common, "anchor", "left_semi"), "shared-segments")
    texts = written(
        shared.groupBy("anchor", "text_hash").agg(F.min(place).alias("first"), F.max("n").alias("n"), F.count("*").alias("copies")),
        "segment-texts",
    )
    span = ["doc", "tie", "start", "end"]
    copies = (
        shared.join(texts.filter("copies > 1").select("anchor", "text_hash", "first"), ["anchor", "text_hash"])
        .filter(place != F.col("first"))
        .select("doc", "tie", "start", (F.col("start") + F.col("n") + length - 1).alias("end"))
    )
    several = written(texts.groupBy("anchor").count().filter("count > 1"), "several-texts")
    first = texts.join(several, "anchor").select("anchor", "first.*", "n", "count")
    symbols = first.agg(F.sum(F.col("n") + length).alias("n")).first().n or 0
    shards = max(1, -(-symbols // shard_symbols))
    shard = F.when(F.col("count") <= hot_segments, F.pmod("anchor", F.lit(shards))).otherwise(-1).cast("int")
    held = written(contents(docs, first.withColumn("shard", shard), length), "segment-contents")
    within = held.filter("shard >= 0").groupBy("shard").applyInArrow(
        tidy(lambda shard: shard_spans(shard, length)), "doc long, tie long, start long, end long"
    )
    strings = held.filter("shard < 0")
    earliest = written(
        strings.groupBy("content").agg(F.min(place).alias("first"), F.count("*").alias("n")).filter("n > 1"), "hot-strings"
    )
    hot = strings.join(earliest, "content").filter(place != F.col("first")).select(
        "doc", "tie", "start", (F.col("start") + length).alias("end")
    )
    return copies.select(*span).unionByName(within.select(*span)).unionByName(hot.select(*span))


def merged_spans(starts: np.ndarray, ends: np.ndarray) -> tuple[list[int], list[int]]:
    """Maximal runs: spans that touch or overlap are one."""
    order = np.argsort(starts, kind="stable")
    starts, ends = starts[order], np.maximum.accumulate(ends[order])
    new = np.concatenate(([True], starts[1:] > ends[:-1]))
    edge = np.flatnonzero(new)
    return starts[edge].tolist(), ends[np.append(edge[1:], len(ends)) - 1].tolist()


def with_spans(docs: DataFrame, length: int, gram: int, **limits: int) -> DataFrame:
    """Documents with ``starts`` and ``ends`` of their maximal repeated spans, null where there is none."""
    known = identified(docs)
    schema = pa.schema(
        [("doc", pa.int64()), ("tie", pa.int64()), ("starts", pa.list_(pa.int64())), ("ends", pa.list_(pa.int64()))]
    )
    spans = repeat_spans(known, length, gram, **limits)
    lists = spans.groupBy("doc", "tie").agg(F.collect_list("start").alias("starts"), F.collect_list("end").alias("ends"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            both = [
                merged_spans(np.array(a), np.array(b))
                for a, b in zip(batch.column("starts").to_pylist(), batch.column("ends").to_pylist())
            ]
            yield batch_of(schema, batch.column("doc"), batch.column("tie"), [a for a, _ in both], [b for _, b in both])

    narrow = written(lists.mapInArrow(tidy(run), "doc long, tie long, starts array<long>, ends array<long>"), "repeat-spans")
    return known.join(narrow, ["doc", "tie"], "left")


def without(data: bytes, starts: list[int], ends: list[int]) -> bytes:
    edges = [0, *(x for pair in zip(starts, ends) for x in pair), len(data)]
    return b"".join(data[a:b] for a, b in zip(edges[::2], edges[1::2]))


def repeat_report(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, **limits: int) -> DataFrame:
    """Per document: its bytes, how many of them repeat, in how many spans, and a digest of the rest."""
    schema = pa.schema(
        [("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()),
         ("kept_sha256", pa.string())]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = utf8(batch.column("text"))
            starts, ends = (batch.column(c).to_pylist() for c in ("starts", "ends"))
            kept = [without(t, a or [], b or []) for t, a, b in zip(texts, starts, ends)]
            yield batch_of(
                schema, batch.column("doc_id"), [len(t) for t in texts], [len(t) - len(k) for t, k in zip(texts, kept)],
                [len(a or []) for a in starts], [hashlib.sha256(k).hexdigest() for k in kept],
            )

    rows = docs.select(F.col("doc_id").cast("long"), "text")
    found = with_spans(rows, length, gram, **limits).select("doc_id", "text", "starts", "ends")
    return found.mapInArrow(tidy(run), "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def without_repeats(text: str, starts: list[int], ends: list[int]) -> str:
    """The text without its repeated spans, less the characters that a span only partly covers."""
    data = text.encode()
    whole = []
    for a, b in zip(starts, ends):
        while a < b and data[a] & 0xC0 == 0x80:
            a += 1
        while a < b < len(data) and data[b] & 0xC0 == 0x80:
            b -= 1
        whole.append((a, b))
    return without(data, [a for a, _ in whole], [b for _, b in whole]).decode()


def cut_repeats(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, **limits: int) -> DataFrame:
    """The rows with repeated strings cut out of their texts; columns as they were, ``n_chars`` following the text."""
    schema = docs.schema
    names = schema.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.column("row").flatten()
            old = rows[names.index("text")]
            texts = [
                without_repeats(t, a, b) if a else t
                for t, a, b in zip(old.to_pylist(), batch.column("starts").to_pylist(), batch.column("ends").to_pylist())
            ]
            rows[names.index("text")] = pa.array(texts, old.type)
            yield pa.RecordBatch.from_arrays(rows, names)

    marked = docs.select("doc_id", "text", F.struct(*names).alias("row"))
    cut = with_spans(marked, length, gram, **limits).select("row", "starts", "ends").mapInArrow(tidy(run), schema)
    return cut.withColumn("n_chars", F.length("text").cast(schema["n_chars"].dataType)) if "n_chars" in names else cut
