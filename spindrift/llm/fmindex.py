"""Benchmark decontamination with an FM-index for each shard of documents.

Windows of ``window`` words are taken from every benchmark item.  A task cuts
its documents into shards, builds an FM-index over each shard's words, and
looks for all windows at once: backward search narrows their intervals with
ranks from a wavelet matrix, occurrences are located by walking to sampled
suffix positions, and what they cover is merged to spans.

The alphabet of an index is the benchmark's vocabulary.  Any other word cannot
lie inside a window, so it parts the text, and so do the ends of documents;
stretches shorter than the shortest window hold no occurrence and are left out
of the index, which loses nothing.

Texts stay where they are: no row is shuffled.  The benchmark goes to the tasks
in blocks of at most ``block_bytes`` of its text, one pass over the documents
for each block, so what is broadcast has a bound whatever its size.

Defined cases: null or word-less texts have no words and no hits; an item
without words has no windows; an item with a null id marks its words and is not
listed; items that share an id are listed once; repeated documents are kept and
reported each; an empty benchmark leaves all documents clean; of the inputs
only ``doc_id`` and ``text``, and ``item_id`` and ``text``, are read, so other
columns cannot clash (``decontaminate`` keeps all columns of its input).
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spindrift.llm.common import batch_of, sliced, tidy, utf8, written

WINDOW = 10
SAMPLE = 16
SHARD_BYTES = 8 << 20
BLOCK_BYTES = 16 << 20
# Words: ASCII digits and letters, and everything beyond ASCII.
WORDS = re.compile(rb"[0-9a-z\x80-\xff]+")

HITS = pa.schema(
    [("n_words", pa.int64()), ("starts", pa.list_(pa.int32())), ("ends", pa.list_(pa.int32())),
     ("items", pa.list_(pa.string()))]
)


def words_of(text: bytes) -> list[bytes]:
    """Words after lower-casing A to Z; no byte of a longer character is an ASCII one."""
    return WORDS.findall(text.lower())


class Phrases:
    """The windows of some items: a vocabulary, distinct windows by length, and the items of each."""

    def __init__(self, items: list[tuple[str | None, bytes]], window: int = WINDOW):
        self.vocabulary: dict[bytes, int] = {}
        found: dict[tuple[int, ...], set[str | None]] = {}
        for item_id, text in items:
            words = [self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in words_of(text)]
            for at in range(max(1, len(words) - window + 1) if words else 0):
                found.setdefault(tuple(words[at : at + window]), set()).add(item_id)
        self.names = sorted({i for ids in found.values() for i in ids if i is not None})
        number = {name: i for i, name in enumerate(self.names)}
        self.shortest = min(map(len, found), default=0)
        self.groups = []  # (windows, starts of their items, items)
        for n in sorted({len(w) for w in found}):
            own = [w for w in found if len(w) == n]
            lists = [[number[i] for i in found[w] if i is not None] for w in own]
            starts = np.concatenate(([0], np.cumsum([len(x) for x in lists])))
            flat = np.array([x for ids in lists for x in ids], np.int64)
            self.groups.append((np.array(own, np.int64), starts, flat))


def suffix_order(text: np.ndarray) -> np.ndarray:
    """The suffix array, by doubling the length compared; its last number must be the only smallest one."""
    _, rank = np.unique(text, return_inverse=True)
    rank = rank.astype(np.int64)
    n, length = len(text), 1
    while True:
        second = np.zeros(n, np.int64)
        second[: n - length] = rank[length:] + 1
        pair = rank * (n + 1) + second
        order = np.argsort(pair, kind="stable")
        new = np.concatenate(([0], np.cumsum(np.diff(pair[order]) != 0)))
        rank[order] = new
        if new[-1] == n - 1:
            return order
        length *= 2
        if length >= n:
            return order


class FMIndex:
    """Counts and places of number sequences in a text of numbers above zero, with zeros where nothing may match.

    ``largest`` is the largest number that may be looked for.
    """

    def __init__(self, text: np.ndarray, largest: int, sample: int = SAMPLE):
        full = np.concatenate((text + 1, [0]))
        suffixes = suffix_order(full)
        last = full[suffixes - 1]
        self.n = len(full)
        self.bits = (largest + 1).bit_length()
        self.before = np.concatenate(([0], np.cumsum(np.bincount(full, minlength=1 << self.bits))))
        # Wavelet matrix: each level sorts by one bit, highest first, and counts its ones.
        self.ones, self.zeros, now = [], [], last
        for level in reversed(range(self.bits)):
            bit = (now >> level) & 1
            self.ones.append(np.concatenate(([0], np.cumsum(bit))).astype(np.int32))
            self.zeros.append(len(now) - int(bit.sum()))
            now = np.concatenate((now[bit == 0], now[bit == 1]))
        self.last = last
        kept = suffixes % sample == 0
        self.kept_before = np.concatenate(([0], np.cumsum(kept))).astype(np.int32)
        self.samples = suffixes[kept]

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often each symbol stands in the transform before each place."""
        low, high = np.zeros_like(at), at
        for level, ones, zeros in zip(reversed(range(self.bits)), self.ones, self.zeros):
            one = (symbol >> level) & 1 == 1
            low = np.where(one, zeros + ones[low], low - ones[low])
            high = np.where(one, zeros + ones[high], high - ones[high])
        return high - low

    def search(self, patterns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The suffix interval of each row, empty where it does not occur; last symbols first."""
        low, high = np.zeros(len(patterns), np.int64), np.full(len(patterns), self.n, np.int64)
        live = np.arange(len(patterns))
        for symbols in patterns.T[::-1] + 1:
            own = symbols[live]
            low[live] = self.before[own] + self.rank(own, low[live])
            high[live] = self.before[own] + self.rank(own, high[live])
            live = live[high[live] > low[live]]
        return low, np.maximum(low, high)

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text positions of suffixes: steps back to the nearest sampled one, and the steps added."""
        out, at, steps = np.empty(len(rows), np.int64), rows.copy(), 0
        live = np.arange(len(rows))
        while len(live):
            kept = self.kept_before[at + 1] > self.kept_before[at]
            out[live[kept]] = self.samples[self.kept_before[at[kept]]] + steps
            live, at = live[~kept], at[~kept]
            symbol = self.last[at]
            at = self.before[symbol] + self.rank(symbol, at)
            steps += 1
        return out


def stretches(ids: np.ndarray, parts: np.ndarray, shortest: int) -> np.ndarray:
    """Places of words in stretches of at least ``shortest`` known words within one document."""
    known = np.concatenate(([False], ids > 0, [False]))
    edge = known[1:] != known[:-1]
    new = np.zeros(len(ids) + 1, bool)
    new[parts] = True
    starts = np.flatnonzero(known[1:-1] & (edge[:-1] | new[:-1]))
    cuts = np.flatnonzero(edge | new)
    ends = cuts[np.searchsorted(cuts, starts, "right")] if len(starts) else starts
    long = ends - starts >= shortest
    starts, sizes = starts[long], (ends - starts)[long]
    return np.repeat(starts - np.concatenate(([0], np.cumsum(sizes)[:-1])), sizes) + np.arange(sizes.sum())


def shard_hits(texts: list[bytes], phrases: Phrases) -> list[tuple[int, list[int], list[int], list[str]]]:
    """For each text of a shard: its words, the spans that windows cover, as word places, and the items."""
    get = phrases.vocabulary.get
    counts, known = [], []
    for text in texts:
        words = words_of(text)
        counts.append(len(words))
        known.append(np.fromiter((get(w, 0) for w in words), np.int64, len(words)))
    ids = np.concatenate(known) if known else np.empty(0, np.int64)
    first = np.concatenate(([0], np.cumsum(counts))).astype(np.int64)
    cover = np.zeros(len(ids) + 1, np.int64)
    pairs = []  # document * number of items + item
    place = stretches(ids, first[:-1], phrases.shortest) if phrases.shortest else np.empty(0, np.int64)
    if len(place):
        # A zero wherever neighbours in the index are not neighbours in one document.
        document = np.searchsorted(first, place, "right") - 1
        apart = np.flatnonzero((np.diff(place) != 1) | (np.diff(document) != 0)) + 1
        index = FMIndex(np.insert(ids[place], apart, 0), len(phrases.vocabulary))
        place = np.insert(place, apart, -1)
        for windows, starts, items in phrases.groups:
            low, high = index.search(windows)
            n = high - low
            which = np.repeat(np.arange(len(windows)), n)
            at = place[index.locate(np.repeat(low - (np.cumsum(n) - n), n) + np.arange(n.sum()))]
            np.add.at(cover, at, 1)
            np.add.at(cover, at + windows.shape[1], -1)
            each = (starts[1:] - starts[:-1])[which]
            item = items[np.repeat(starts[which] - (np.cumsum(each) - each), each) + np.arange(each.sum())]
            doc = np.repeat(np.searchsorted(first, at, "right") - 1, each)
            pairs.append(np.unique(doc * max(1, len(phrases.names)) + item))
    hit = np.cumsum(cover)[:-1] > 0
    hit = np.concatenate(([False], hit, [False]))
    begins, stops = np.flatnonzero(hit[1:] & ~hit[:-1]), np.flatnonzero(hit[:-1] & ~hit[1:])
    found = np.unique(np.concatenate(pairs)) if pairs else np.empty(0, np.int64)
    owner, item = np.divmod(found, max(1, len(phrases.names)))
    out = []
    for i, n in enumerate(counts):
        a, b = np.searchsorted(begins, [first[i], first[i + 1]])
        c, d = np.searchsorted(owner, [i, i + 1])
        # A span that runs on into the next document ends here and begins there.
        s = [int(x - first[i]) for x in begins[a:b]]
        e = [int(min(x, first[i + 1]) - first[i]) for x in stops[a:b]]
        j = int(np.searchsorted(begins, first[i])) - 1
        if n and j >= 0 and begins[j] < first[i] < stops[j]:
            s.insert(0, 0), e.insert(0, int(min(stops[j], first[i + 1]) - first[i]))
        out.append((n, s, e, [phrases.names[x] for x in item[c:d]]))
    return out


def found_hits(batch: pa.RecordBatch, phrases: Phrases) -> Iterator[tuple[pa.RecordBatch, list[tuple]]]:
    """A batch cut into shards, and the hits in each, with those of earlier blocks of items."""
    names = batch.schema.names
    texts = batch.column("text") if "text" in names else batch.column("row").field("text")
    for shard in sliced(iter([batch.append_column("_text", texts)]), "_text", SHARD_BYTES):
        found = shard_hits(utf8(shard.column("_text")), phrases)
        if "hits" in names:
            found = [merged(x, y) for x, y in zip(shard.column("hits").to_pylist(), found)]
        yield shard.select(names), found


def hit_pass(docs: DataFrame, items: list[tuple[str | None, bytes]], window: int) -> DataFrame:
    """Add ``hits`` of one block of items to rows that have ``text``, or a ``row`` with it, and the hits so far."""
    shared = docs.sparkSession.sparkContext.broadcast(Phrases(items, window))
    kind = "struct<n_words: bigint, starts: array<int>, ends: array<int>, items: array<string>>"
    names = [c for c in docs.columns if c != "hits"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, found in found_hits(batch, shared.value):
                hits = pa.StructArray.from_arrays(
                    [pa.array([x[i] for x in found], f.type) for i, f in enumerate(HITS)], fields=list(HITS)
                )
                yield pa.RecordBatch.from_arrays([*(rows.column(c) for c in names), hits], [*names, "hits"])

    fields = ", ".join(f"`{c}` {t}" for c, t in docs.dtypes if c != "hits")
    return docs.mapInArrow(tidy(run), f"{fields}, hits {kind}")


def merged(old: dict, new: tuple) -> tuple:
    """Hits of two blocks of items: spans that touch or overlap become one."""
    n, starts, ends, items = new
    spans: list[list[int]] = []
    for a, b in sorted([*zip(old["starts"], old["ends"]), *zip(starts, ends)]):
        if spans and a <= spans[-1][1]:
            spans[-1][1] = max(spans[-1][1], b)
        else:
            spans.append([a, b])
    return n, [a for a, _ in spans], [b for _, b in spans], sorted({*old["items"], *items})


def item_pieces(benchmark: DataFrame, window: int, piece_bytes: int) -> DataFrame:
    """(item_id, text): different items once, very long ones as pieces that hold all their windows between them."""
    items = benchmark.select(F.col("item_id").cast("string").alias("item_id"), "text").filter("text is not null").distinct()
    words = F.regexp_extract_all(F.col("text"), F.lit(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"), F.lit(0))
    # A word has two bytes at least with what parts it from the next.
    most = max(1, piece_bytes // 16)
    starts = F.sequence(F.lit(0), F.greatest(F.lit(0), F.size("words") - window), F.lit(most))
    cut = F.transform(starts, lambda at: F.array_join(F.slice("words", at + 1, F.lit(most + window - 1)), " "))
    long_item = F.octet_length("text") > piece_bytes
    short = items.filter(~long_item)
    pieces = items.filter(long_item).select("item_id", words.alias("words")).select("item_id", F.explode(cut).alias("text"))
    return short.unionByName(pieces.distinct())


def item_blocks(
    benchmark: DataFrame, block_bytes: int, window: int = WINDOW
) -> Iterator[list[tuple[str | None, bytes]]]:
    """Items of the benchmark, about ``block_bytes`` of text at a time; at least one block."""
    items = item_pieces(benchmark, window, max(64, block_bytes // 8))
    size = items.agg(F.sum(F.octet_length("text")).alias("n")).first().n or 0
    blocks = max(1, -(-2 * size // block_bytes)) if size > block_bytes else 1
    numbered = items.withColumn("block", F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)))
    for block in range(blocks):
        yield [(r.item_id, r.text.encode()) for r in numbered.filter(F.col("block") == block).collect()]


def with_hits(
    docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_bytes: int = BLOCK_BYTES
) -> DataFrame:
    """Add ``hits``, to rows without such a column: number of words, spans of words that benchmark windows cover, and the items they belong to."""
    done = False
    for items in item_blocks(benchmark, block_bytes, window):
        docs = hit_pass(written(docs, "hits") if done else docs, items, window)
        done = True
    return docs


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """Per document: its words, how many are hit, and a digest of the items that hit it."""
    found = with_hits(docs.select("doc_id", "text"), benchmark, window).select("doc_id", "hits")
    items = F.array_sort("hits.items")
    spans = F.zip_with("hits.ends", "hits.starts", lambda b, a: (b - a).cast("long"))
    return found.select(
        "doc_id",
        F.col("hits.n_words").alias("n_words"),
        F.aggregate(spans, F.lit(0).cast("long"), lambda x, y: x + y).alias("n_hit"),
        F.size(items).cast("long").alias("n_items"),
        F.sha2(F.array_join(items, ",").cast("binary"), 256).alias("items_sha256"),
        (F.size("hits.starts") > 0).alias("contaminated"),
    )


def cut_words(text: str, starts: list[int], ends: list[int]) -> str:
    """The text without the words of some spans; what stands between words stays, except inside a span."""
    data = text.encode()
    places = [m.span() for m in WORDS.finditer(data.lower())]
    kept, at = [], 0
    for a, b in zip(starts, ends):
        kept.append(data[at : places[a][0]])
        at = places[b - 1][1]
    return b"".join([*kept, data[at:]]).decode()


def decontaminate(
    docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_bytes: int = BLOCK_BYTES
) -> DataFrame:
    """The rows with benchmark passages cut out of their texts; columns as they were, ``n_chars`` following the text."""
    schema = docs.schema
    names = schema.names
    marked = docs.select(F.struct(*names).alias("row"))
    *earlier, last = item_blocks(benchmark, block_bytes, window)
    for items in earlier:
        marked = written(hit_pass(marked, items, window), "hits")
    shared = docs.sparkSession.sparkContext.broadcast(Phrases(last, window))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, found in found_hits(batch, shared.value):
                columns = rows.column("row").flatten()
                old = columns[names.index("text")]
                texts = [cut_words(t, s, e) if s else t for t, (_, s, e, _) in zip(old.to_pylist(), found)]
                columns[names.index("text")] = pa.array(texts, old.type)
                yield pa.RecordBatch.from_arrays(columns, names)

    cut = marked.mapInArrow(tidy(run), schema)
    return cut.withColumn("n_chars", F.length("text").cast(schema["n_chars"].dataType)) if "n_chars" in names else cut
