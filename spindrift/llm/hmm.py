"""A hidden Markov language model of words.

A state emits the class of a word, a hash of its last three bytes, and a class
emits the word by its share of the class's training tokens; both shares keep
half a count for what was never seen, so every text has a likelihood.  All
training documents train it: Baum-Welch counts are made where the documents are
stored, added up by Spark, and only the sums, as many as the model has
parameters, come to the driver.  The scaled forward recursion then gives each
document's exact likelihood.

Documents are kept as chunks of about ``CHUNK_TOKENS`` tokens, one row each,
with tokens as numbers of the chunk's own words.  Words of all chunks meet once,
in one shuffle by word, to be counted over the whole corpus; a word comes there
once for each chunk, so frequent ones are no larger than others.  The counts
return to the chunks by a shuffle of numbers.

Defined cases: null text counts as empty, which is the end token alone; a null
doc_id counts as the empty text when folds are dealt and is kept; repeated rows
are kept and counted each; without training documents all counts are zero and
the model is uniform; no rows give no rows; only ``doc_id`` and ``text`` are
read of the input, so other columns cannot clash.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spindrift.llm.common import batch_of, crc_mod, tidy, utf8, written

CHUNK_TOKENS = 1 << 20
CLASSES = 4096
END = CLASSES  # the end token's own class
STATES = 8
ROUNDS = 4
SMOOTH = 0.1
SEED = 7

CHUNK = pa.schema(
    [("chunk", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("train", pa.binary()), ("sizes", pa.binary()),
     ("tokens", pa.binary()), ("classes", pa.binary()), ("words", pa.list_(pa.binary())), ("counts", pa.list_(pa.int32()))]
)
CHUNK_SQL = (
    "chunk long, doc_ids array<long>, train binary, sizes binary, tokens binary, classes binary, "
    "words array<binary>, counts array<int>"
)


class Chunk:
    """Documents gathered until they are enough for a row."""

    def __init__(self):
        self.number: dict[bytes, int] = {b"": 0}  # the end token is the empty word
        self.doc_ids, self.train, self.sizes, self.tokens = [], [], [], []
        self.held = 0

    def add(self, doc_id: int | None, text: bytes, train: bool) -> None:
        number = self.number
        tokens = [number.setdefault(w, len(number)) for w in text.lower().split()]
        tokens.append(0)
        self.doc_ids.append(doc_id), self.train.append(train), self.sizes.append(len(tokens))
        self.tokens.append(np.array(tokens, np.int32))
        self.held += len(tokens)

    def row(self, chunk: int) -> pa.RecordBatch:
        sizes, train, tokens = np.array(self.sizes, np.int32), np.array(self.train), np.concatenate(self.tokens)
        words = list(self.number)
        classes = np.array([zlib.crc32(w[-3:]) % CLASSES for w in words], np.uint16)
        classes[0] = END
        counts = np.bincount(tokens[np.repeat(train, sizes)], minlength=len(words)).astype(np.int32)
        binaries = (train.tobytes(), sizes.tobytes(), tokens.tobytes(), classes.tobytes())
        return batch_of(CHUNK, [chunk], [self.doc_ids], *([b] for b in binaries), [words], [counts])


def chunks(docs: DataFrame, chunk_tokens: int) -> DataFrame:
    """Documents with ``train`` marks as rows of about ``chunk_tokens`` tokens."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = TaskContext.get().partitionId() << 32
        done, now = 0, Chunk()
        for batch in batches:
            rows = zip(batch.column("doc_id").to_pylist(), utf8(batch.column("text")), batch.column("train").to_pylist())
            for row in rows:
                now.add(*row)
                if now.held >= chunk_tokens:
                    yield now.row(first + done)
                    done, now = done + 1, Chunk()
        if now.held:
            yield now.row(first + done)

    return docs.select(F.col("doc_id").cast("long"), "text", "train").mapInArrow(tidy(run), CHUNK_SQL)


def corpus_counts(stored: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(chunk, counts of its words over all training documents), and per class its tokens and words."""
    each = stored.select(
        "chunk", F.posexplode(F.arrays_zip("words", "counts")).alias("place", "of")
    ).select("chunk", "place", F.col("of.words").alias("word"), F.col("of.counts").alias("own"))
    by_word = Window.partitionBy("word")
    counted = written(
        each.withColumn("count", F.sum("own").over(by_word))
        .withColumn("first", F.row_number().over(by_word.orderBy("chunk")) == 1)
        .select(
            "chunk", "place", "count",
            F.when(F.col("first"), F.substring("word", -3, 3)).alias("ending"),
            (F.col("first") & (F.octet_length("word") == 0)).alias("end"),
        ),
        "word-counts",
    )
    kind = F.when(F.col("end"), END).otherwise(F.crc32("ending") % CLASSES).cast("int")
    sums = (
        counted.filter("ending is not null and count > 0").groupBy(kind.alias("class"))
        .agg(F.sum("count").alias("tokens"), F.count("*").alias("words"))
    )

    def in_place(rows: pa.Table) -> pa.Table:
        found = np.zeros(rows.num_rows, np.int64)
        found[rows.column("place").to_numpy()] = rows.column("count").to_numpy()
        return pa.table({"chunk": rows.column("chunk")[:1], "found": pa.array([found.tobytes()], pa.binary())})

    narrow = counted.select("chunk", "place", "count")
    return narrow.groupBy("chunk").applyInArrow(tidy(in_place), "chunk long, found binary"), sums


@dataclass
class Model:
    start: np.ndarray  # (states,)
    step: np.ndarray  # (states, states)
    emit: np.ndarray  # (classes, states)

    @staticmethod
    def seeded(tokens: np.ndarray, states: int) -> Model:
        """Near the corpus's own class shares, with states that tend to stay."""
        noise = np.random.default_rng(SEED).gamma(2.0, size=(len(tokens), states))
        step = np.full((states, states), 0.2 / max(1, states - 1))
        np.fill_diagonal(step, 0.8 if states > 1 else 1.0)
        return Model.of(np.ones(states), step, (tokens[:, None] + SMOOTH) * noise)

    @staticmethod
    def of(start: np.ndarray, step: np.ndarray, emit: np.ndarray) -> Model:
        return Model(start / start.sum(), step / step.sum(axis=1, keepdims=True), emit / emit.sum(axis=0, keepdims=True))


class Lanes:
    """Documents side by side, longest first, their tokens in order of time."""

    def __init__(self, kinds: np.ndarray, sizes: np.ndarray):
        self.order = np.argsort(-sizes, kind="stable")
        self.sizes = sizes[self.order]
        begins = (np.cumsum(sizes) - sizes)[self.order]
        longest = int(self.sizes[0]) if len(sizes) else 0
        # live[t]: how many documents have a token at time t
        self.live = np.searchsorted(-self.sizes, -np.arange(longest), "left") if longest else np.empty(0, int)
        self.at = np.concatenate(([0], np.cumsum(self.live)))
        lane = np.arange(self.at[-1]) - np.repeat(self.at[:-1], self.live)
        self.lane = lane
        self.kinds = kinds[begins[lane] + np.repeat(np.arange(longest), self.live)]

    def forward(self, model: Model) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Scaled state shares of each token, its scale, and its emission row."""
        emitted = model.emit.astype(np.float32)[self.kinds]
        share, scale = np.empty_like(emitted), np.empty(len(emitted), np.float32)
        step, now = model.step.astype(np.float32), None
        for t, n in enumerate(self.live.tolist()):
            a, b = self.at[t], self.at[t + 1]
            now = model.start.astype(np.float32) * emitted[a:b] if now is None else (now[:n] @ step) * emitted[a:b]
            own = np.maximum(now.sum(axis=1), 1e-30)
            now /= own[:, None]
            share[a:b], scale[a:b] = now, own
        return share, scale, emitted

    def log10(self, model: Model) -> np.ndarray:
        """Log likelihood of each document's classes, in the order given."""
        _, scale, _ = self.forward(model)
        out = np.empty(len(self.sizes))
        out[self.order] = np.bincount(self.lane, np.log10(scale.astype(np.float64)), minlength=len(self.sizes))
        return out

    def counts(self, model: Model) -> np.ndarray:
        """Expected starts, steps and emissions, as one row of numbers."""
        share, scale, emitted = self.forward(model)
        states = share.shape[1]
        step = model.step.astype(np.float32)
        back = np.ones((0, states), np.float32)
        moves = np.zeros((states, states))
        if not len(self.live):
            return np.zeros(states + states * states + model.emit.size)
        for t in range(len(self.live) - 1, -1, -1):
            a, b = self.at[t], self.at[t + 1]
            n = len(back)
            now = np.ones((b - a, states), np.float32)
            if n:
                after = slice(b, b + n)
                ahead = emitted[after] * back / scale[after, None]
                moves += share[a : a + n].T @ ahead
                now[:n] = ahead @ step.T
            share[a:b] *= now  # from here on the token's posterior
            back = now
        emissions = np.stack(
            [np.bincount(self.kinds, share[:, s], minlength=model.emit.shape[0]) for s in range(states)], axis=1
        )
        starts = share[: self.at[1]].sum(axis=0)
        return np.concatenate([starts, (moves * model.step).ravel(), emissions.ravel()])


def lanes_of(row: dict, training: bool) -> Lanes:
    sizes, tokens = np.frombuffer(row["sizes"], np.int32), np.frombuffer(row["tokens"], np.int32)
    kinds = np.frombuffer(row["classes"], np.uint16)[tokens]
    if training:
        train = np.frombuffer(row["train"], bool)
        kinds, sizes = kinds[np.repeat(train, sizes)], sizes[train]
    return Lanes(kinds, sizes)


def train(stored: DataFrame, tokens: np.ndarray, states: int = STATES, rounds: int = ROUNDS) -> Model:
    """Baum-Welch over all training documents, ``rounds`` times."""
    spark = stored.sparkSession
    model = Model.seeded(tokens, states)
    out = pa.schema([("slot", pa.int32()), ("value", pa.float64())])
    columns = ["train", "sizes", "tokens", "classes"]
    for _ in range(rounds):
        shared = spark.sparkContext.broadcast(model)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = None
            for batch in batches:
                for i in range(batch.num_rows):
                    row = {c: batch.column(c)[i].as_buffer() for c in columns}
                    own = lanes_of(row, training=True).counts(shared.value)
                    total = own if total is None else total + own
            if total is not None:
                some = np.flatnonzero(total)
                yield batch_of(out, some.astype(np.int32), total[some])

        sums = stored.select(*columns).mapInArrow(tidy(run), "slot int, value double").groupBy("slot").agg(F.sum("value").alias("value"))
        full = np.zeros(states + states * states + model.emit.size)
        for slot, value in sums.collect():  # as many rows as the model has parameters
            full[slot] = value
        shared.unpersist()
        start, step, emit = np.split(full, [states, states + states * states])
        prior = (tokens[:, None] + SMOOTH) / (tokens.sum() + SMOOTH * len(tokens))
        model = Model.of(
            start + SMOOTH, step.reshape(states, states) + SMOOTH, emit.reshape(-1, states) + SMOOTH * prior + 1e-9
        )
    return model


SCORES = pa.schema(
    [("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()),
     ("train_tokens", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64())]
)


def score_documents(
    docs: DataFrame, states: int = STATES, rounds: int = ROUNDS, chunk_tokens: int = CHUNK_TOKENS
) -> DataFrame:
    """Likelihoods of all documents under a model learned from those whose crc32 modulo 5 is not 1."""
    spark = docs.sparkSession
    marked = docs.select("doc_id", "text", (crc_mod("doc_id", 5) != 1).alias("train"))
    stored = written(chunks(marked, chunk_tokens), "chunks")
    found, sums = corpus_counts(stored)
    tokens, words = np.zeros(CLASSES + 1), np.zeros(CLASSES + 1)
    for row in sums.collect():  # a row for each class
        tokens[row["class"]], words[row["class"]] = row.tokens, row.words
    model = train(stored, tokens, states, rounds)
    shared = spark.sparkContext.broadcast(model)
    n, v = int(tokens.sum()), int(words.sum())
    base = np.log10(n + 0.5 * (v + 1))
    in_class = np.log10(tokens + 0.5 * (words + 1))
    in_class[END] = np.log10(tokens[END] + 0.5)  # there is no other end

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = {c: batch.column(c)[i].as_buffer() for c in ("train", "sizes", "tokens", "classes", "found")}
                sizes, own = np.frombuffer(row["sizes"], np.int32), np.frombuffer(row["tokens"], np.int32)
                seen = np.frombuffer(row["found"], np.int64)
                word, kind = np.log10(seen + 0.5), np.frombuffer(row["classes"], np.uint16)
                starts = np.cumsum(sizes) - sizes
                add = lambda x: np.add.reduceat(x[own], starts)
                classes = lanes_of(row, training=False).log10(shared.value)
                known = add((seen > 0).astype(np.int64))
                plain = add(word)
                yield batch_of(
                    SCORES, batch.column("doc_ids")[i].values, ~np.frombuffer(row["train"], bool),
                    sizes.astype(np.int64), known, np.full(len(sizes), n), plain - sizes * base,
                    classes + plain - add(in_class[kind]),
                )

    schema = (
        "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    )
    joined = stored.select("chunk", "doc_ids", "train", "sizes", "tokens", "classes").join(written(found, "counts"), "chunk")
    return joined.drop("chunk").mapInArrow(tidy(run), schema)
