"""Best-fit packing of token pieces into sequences, by bin completion with branch and bound.

Pieces have whole lengths from 1 to ``max_tokens``, so however many rows there
are, the packing problem is one row for each length: how many pieces have it.
That histogram is made by Spark, and bin completion works on it: around the
longest piece left it enumerates fillings of the rest of the sequence, best fit
first and without those that another dominates, and lays each filling out as
often as the histogram allows.  Branches whose waste already exceeds that of
the best packing known are cut; best-fit decreasing gives the first such
packing.  The plan, at most some thousand ranges of ranks, goes back to Spark,
where each piece looks up its sequence and offset by its rank among the pieces
of its length.

Defined cases: null text counts as empty and gives the one token ``eos``; a
null or repeated doc_id is kept, each row being a document; no rows give no
rows; only ``doc_id`` and ``text`` are read of the input, so other columns
cannot clash.  A special token's text inside a document becomes that token, as
the tokenizer does by default.
"""

from __future__ import annotations

import json
import os
import re
import zlib
from array import array
from collections.abc import Callable, Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spindrift.llm.common import batch_of, sliced, tidy, written
from spindrift.llm.vocabularies import PLAIN

MAX_TOKENS = 1024
EOS = 2
NODE_LIMIT = 2_000
BRANCHES = 4
FILL_STEPS = 20_000
RANK_BUCKETS = 256
CACHE = 150_000
PART_CACHE = 250_000

PIECES = pa.schema(
    [("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()),
     ("ids_crc32", pa.int64()), ("ids", pa.list_(pa.int32()))]
)

# The word pattern of the byte-level vocabulary, in its general
# form and for texts whose characters all lie below U+0250.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
LATIN = "A-Za-zªµºÀ-ÖØ-öø-ɏ"
LATIN_NUMBERS = "0-9²³¹¼½¾"
LATIN_PATTERN = (
    rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{LATIN}]+| ?[{LATIN_NUMBERS}]+| ?[^\s{LATIN}{LATIN_NUMBERS}]+|\s+(?!\S)|\s+"
)


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


class CachedTokenizer:
    """Ids of whole texts as little-endian 32-bit bytes.

    A plain text is cut before its single spaces, where no word of the pattern
    can reach across, and each part is tokenized once while the cache has room.
    Other texts go to the tokenizer as they are.
    """

    def __init__(self, path: str):
        import regex
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.any_special = re.compile("|".join(map(re.escape, self.special))) if self.special else None
        self.words, self.latin_words = regex.compile(PATTERN).findall, re.compile(LATIN_PATTERN).findall
        self.wide = re.compile("[^\x00-ɏ]").search
        # Runs of white space before a space are words across parts.
        self.runs = re.compile(r"\s\s ").search
        self.parts: dict[str, bytes] = {}
        self.known: dict[str, bytes] = {}
        self.model_ids = self.ranked_ids(path) or self.tokenizer_ids

    def tokenizer_ids(self, word: str) -> list[int]:
        return self.tokenizer.encode(word, add_special_tokens=False).ids

    def ranked_ids(self, path: str) -> Callable[[str], list[int]] | None:
        """A quicker way to the same ids, if the vocabulary's ids follow its order of merges."""
        import tiktoken

        with open(path, encoding="utf-8") as file:
            model = json.load(file)["model"]
        vocabulary, merges = model["vocab"], model.get("merges", [])
        merged = [vocabulary.get("".join(m if isinstance(m, list) else m.split(" ", 1))) for m in merges]
        # The model writes each byte as one printable character.
        printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
        others = [b for b in range(256) if b not in set(printable)]
        byte = {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(others)}
        if None in merged or any(a >= b for a, b in pairwise(merged)) or not vocabulary.keys() >= byte.keys():
            return None
        if model.get("ignore_merges") or merged and merged[0] <= max(vocabulary[c] for c in byte):
            return None
        kept = {vocabulary[c] for c in byte} | set(merged)
        ranks = {bytes(byte[c] for c in word): i for word, i in vocabulary.items() if i in kept}
        encoding = tiktoken.Encoding("words", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        return encoding._encode_single_piece

    def word(self, word: str) -> bytes:
        ids = self.known.get(word)
        if ids is None:
            ids = array("I", self.model_ids(word)).tobytes()
            if len(self.known) < CACHE:
                self.known[word] = ids
        return ids

    def part(self, part: str) -> bytes:
        words = self.words(part) if self.wide(part) else self.latin_words(part)
        ids = b"".join(map(self.word, words))
        return ids

    def plain(self, text: str) -> bytes:
        if self.runs(text):
            return b"".join(map(self.word, (self.words if self.wide(text) else self.latin_words)(text)))
        parts = text.split(" ")
        made = list(map(self.parts.get, parts))  # the cache holds parts that follow a space
        made[0] = self.part(parts[0])
        i = -1
        for _ in range(made.count(None)):
            i = made.index(None, i + 1)
            made[i] = self.part(" " + parts[i])
            if len(self.parts) < PART_CACHE and len(parts[i]) < 100:
                self.parts[parts[i]] = made[i]
        return b"".join(made)

    def ids(self, text: str) -> bytes:
        if PLAIN.fullmatch(text) is None:  # the tokenizer alone knows its classes of these characters
            return array("I", self.tokenizer_ids(text)).tobytes()
        if not self.any_special or not self.any_special.search(text):
            return self.plain(text)
        made, at = [], 0
        for m in self.any_special.finditer(text):
            made += [self.plain(text[at : m.start()]), np.uint32(self.tokenizer.token_to_id(m[0])).tobytes()]
            at = m.end()
        return b"".join([*made, self.plain(text[at:])])


_TOKENIZERS: dict[str, CachedTokenizer] = {}


def cached_tokenizer(path: str) -> CachedTokenizer:
    """One for each worker process, for as long as a task lasts."""
    if path not in _TOKENIZERS:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        _TOKENIZERS[path] = CachedTokenizer(path)
    return _TOKENIZERS[path]


def token_pieces(
    docs: DataFrame, path: str, max_tokens: int = MAX_TOKENS, eos: int = EOS, with_ids: bool = False
) -> DataFrame:
    """Pieces of each document's tokens; only the first of a long document is shorter than ``max_tokens``."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = cached_tokenizer(path)
        end = np.uint32(eos).tobytes()
        for batch in sliced(batches, "text", 8 << 20):
            doc, piece, start, length, crc, ids = [], [], [], [], [], []
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
                data = tokens.ids(text or "") + end
                n = len(data) // 4
                at, to = 0, n % max_tokens or max_tokens
                for i in range(-(-n // max_tokens)):
                    own = data[4 * at : 4 * to]
                    doc.append(doc_id), piece.append(i), start.append(at), length.append(to - at)
                    crc.append(zlib.crc32(own))
                    ids.append(np.frombuffer(own, "<u4").astype(np.int32) if with_ids else None)
                    at, to = to, to + max_tokens
            yield batch_of(PIECES, doc, piece, start, length, crc, ids)
        _TOKENIZERS.clear()  # the process goes on to other work, which needs the memory

    schema = "doc_id long, piece int, start long, length long, ids_crc32 long, ids array<int>"
    made = docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(tidy(cut), schema)
    return made if with_ids else made.drop("ids")


# The plan, on the histogram of lengths.

Filling = tuple[tuple[int, int], ...]  # (length, copies), longest first


def best_fit(counts: dict[int, int], size: int) -> list[tuple[Filling, int]]:
    """Best-fit decreasing; equal sequences are kept as one with their number."""
    by_room: dict[int, dict[Filling, int]] = {}
    done: list[tuple[Filling, int]] = []
    for length in sorted(counts, reverse=True):
        left = counts[length]
        while left:
            room = min((r for r in by_room if r >= length), default=None)
            if room is None:
                per = min(size // length, left)
                filling, number = ((length, per),), left // per
                left -= per * number
                rest = size - per * length
            else:
                open_ones = by_room[room]
                old, there = open_ones.popitem()
                if not open_ones:
                    del by_room[room]
                per = min(room // length, left)
                number = min(there, left // per)
                if there > number:
                    by_room.setdefault(room, {})[old] = there - number
                filling, rest = (*old, (length, per)), room - per * length
                left -= per * number
            if rest:
                same = by_room.setdefault(rest, {})
                same[filling] = same.get(filling, 0) + number
            else:
                done.append((filling, number))
    return done + [x for fillings in by_room.values() for x in fillings.items()]


def fillings(counts: dict[int, int], lengths: list[int], room: int, most_waste: int) -> Iterator[tuple[Filling, int]]:
    """Ways to fill ``room`` and their waste, least waste first, then longest pieces first.

    A single piece dominates every set of the same sum, as does a longer piece
    the shorter ones that add up to it; hence the order, and the end of a sum's
    enumeration at a single piece.
    """
    usable = [x for x in lengths if x <= room]
    steps = [FILL_STEPS]

    def exact(target: int, at: int, left: int) -> Iterator[tuple[int, ...]]:
        if target == 0:
            yield ()
            return
        if not left:
            return
        if counts.get(target, 0) and at < len(usable) and target <= usable[at]:
            yield (target,)
            return
        for i in range(at, len(usable)):
            length = usable[i]
            steps[0] -= 1
            if steps[0] < 0 or length * left < target:
                return
            if length < target:
                most = min(counts[length], target // length)
                for copies in range(min(most, left), 0, -1):
                    for rest in exact(target - copies * length, i + 1, left - copies):
                        yield (length,) * copies + rest

    floor = usable[-1] if usable else room + 1
    for waste in range(0, min(room, most_waste) + 1):
        target = room - waste
        if target and target < floor:
            continue
        for depth in (2, 3, 8, room):  # few pieces first: they leave the short ones for later
            found = False
            for pieces in exact(target, 0, min(depth, target)):
                found = True
                yield tuple((x, pieces.count(x)) for x in dict.fromkeys(pieces)), waste
            if found or steps[0] < 0:
                break
        steps[0] = max(steps[0], FILL_STEPS // 20)


def least_bins(counts: dict[int, int], size: int) -> int:
    """No packing has fewer: pieces over half a sequence stand apart, and those beside which nothing fits waste their rest."""
    least = -(-sum(length * n for length, n in counts.items()) // size)
    for small in {x for x in counts if 2 * x <= size} | {0}:
        full = sum(n for x, n in counts.items() if x > size - small)
        half = sum(n for x, n in counts.items() if size - small >= x and 2 * x > size)
        room = sum((size - x) * n for x, n in counts.items() if size - small >= x and 2 * x > size)
        rest = sum(x * n for x, n in counts.items() if small <= x and 2 * x <= size)
        least = max(least, full + half + max(0, -(-(rest - room) // size)))
    return least


def plan_bins(
    counts: dict[int, int], size: int = MAX_TOKENS, node_limit: int = NODE_LIMIT, branches: int = BRANCHES
) -> list[tuple[Filling, int]]:
    """Fillings and how often each is used; as few sequences as the search finds within ``node_limit`` nodes."""
    total = sum(length * n for length, n in counts.items())
    least = least_bins(counts, size)
    best = best_fit(counts, size)
    best_n = sum(n for _, n in best)
    left = {length: n for length, n in counts.items() if n}
    lengths = sorted(left, reverse=True)
    path: list[tuple[Filling, int, Iterator, int]] = []
    used = waste = nodes = 0

    def options() -> tuple[int, Iterator]:
        longest = next(x for x in lengths if left[x])
        left[longest] -= 1
        allowed = (best_n - 1) * size - total - waste
        present = [x for x in lengths if left[x]]
        found = []
        if allowed >= 0:
            for filling in fillings(left, present, size - longest, allowed):
                found.append(filling)
                if len(found) >= branches:
                    break
        left[longest] += 1
        return longest, iter(found)

    pending = options() if left and best_n > least else None
    while pending and nodes < node_limit:
        nodes += 1
        longest, choices = pending
        choice = next(choices, None)
        if choice is None:
            if not path:
                break
            filling, times, pending_choices, lost = path.pop()
            for length, copies in filling:
                left[length] += copies * times
            used, waste = used - times, waste - lost
            pending = (filling[0][0], pending_choices)
            continue
        rest, room = choice
        filling = ((longest, 1 + dict(rest).get(longest, 0)), *(x for x in rest if x[0] != longest))
        times = min(left[length] // copies for length, copies in filling)
        if room:  # a wasteful filling is tried no more often than the best packing's waste allows
            times = max(1, min(times, ((best_n - 1) * size - total - waste) // room))
        for length, copies in filling:
            left[length] -= copies * times
        used, waste = used + times, waste + times * room
        path.append((filling, times, choices, times * room))
        if not any(left.values()):
            if used < best_n:
                best, best_n = [(f, n) for f, n, _, _ in path], used
            if best_n == least:
                break
            pending = (longest, iter(()))
        elif used + -(-(total - used * size + waste) // size) >= best_n:
            pending = (longest, iter(()))
        else:
            pending = options()
    return best


def plan_ranges(plan: list[tuple[Filling, int]]) -> list[tuple[int, int, int, int, int, int]]:
    """(length, first rank, last rank, copies, first sequence, offset) of each length in each filling."""
    ranges, given, sequence = [], {}, 0
    for filling, times in plan:
        offset = 0
        for length, copies in filling:
            first = given.get(length, 0)
            given[length] = first + copies * times
            ranges.append((length, first, given[length], copies, sequence, offset))
            offset += copies * length
        sequence += times
    return ranges


def pack(pieces: DataFrame, max_tokens: int = MAX_TOKENS, plan: Callable = plan_bins) -> DataFrame:
    """Pieces with their ``sequence_id`` and ``offset``."""
    spark = pieces.sparkSession
    histogram = pieces.groupBy("length").count().orderBy("length").collect()  # at most max_tokens rows
    ranges = plan_ranges(plan({row.length: row["count"] for row in histogram}, max_tokens))
    part = F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(RANK_BUCKETS)).cast("int")
    parted = pieces.withColumn("part", part)
    sizes = parted.groupBy("length", "part").agg(F.count("*").alias("n"))  # at most max_tokens * RANK_BUCKETS rows
    before = F.sum("n").over(Window.partitionBy("length").orderBy("part")) - F.col("n")
    order = Window.partitionBy("length", "part").orderBy("doc_id", "piece", "ids_crc32", "start")
    ranked = (
        parted.withColumn("rank", F.row_number().over(order))
        .join(sizes.select("length", "part", before.alias("before")), ["length", "part"])
        .withColumn("rank", F.col("before") + F.col("rank") - 1)
    )
    schema = "length long, first long, last long, copies long, sequence long, offset long"
    places = spark.createDataFrame(ranges, schema).groupBy("length").agg(
        F.sort_array(F.collect_list(F.struct("last", "first", "copies", "sequence", "offset"))).alias("places")
    )
    # The range that holds a rank: its number is how many ranges end at or before the rank.
    found = F.get("places", F.size(F.filter("places", lambda p: p["last"] <= F.col("rank"))))
    index = F.col("rank") - F.col("at.first")
    return (
        ranked.join(F.broadcast(places), "length")  # as bounded as the histogram
        .withColumn("at", found)
        .withColumn("sequence_id", F.col("at.sequence") + F.floor(index / F.col("at.copies")))
        .withColumn("offset", F.col("at.offset") + index % F.col("at.copies") * F.col("length"))
        .drop("part", "before", "rank", "places", "at")
    )


def pack_documents(
    docs: DataFrame, path: str | None = None, max_tokens: int = MAX_TOKENS, eos: int = EOS, with_ids: bool = False
) -> DataFrame:
    pieces = written(token_pieces(docs, path or tokenizer_path(), max_tokens, eos, with_ids), "token-pieces")
    return pack(pieces, max_tokens)
