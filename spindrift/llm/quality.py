"""Quality by nearest-neighbour voting among latent-semantic vectors.

A bounded sample of labelled rows gives the terms' weights, the latent space and
the voters.  Terms are hashed runs of three bytes, runs of three character
classes, and how often words and lines repeat.  Every document is projected
into the latent space; blocks of documents are multiplied with all voters,
which gives exact cosines, and the nearest ones vote with their similarity as
weight.

Defined cases: null text counts as empty; a text without terms has no
neighbours and gets the voters' mean label; with no labelled rows every score
is 1; several labels of one doc_id count as their mean, null ones not at all;
of rows that share a labelled doc_id one is a voter; repeated rows are kept; a
null doc_id counts as the empty text when folds are dealt and is never a voter;
no rows give no rows; of the inputs only ``doc_id``, ``text`` and ``quality``
are read, so other columns cannot clash (``keep_good`` keeps all columns).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spindrift.llm.common import batch_of, crc_mod, release, tidy, utf8

SAMPLE = 2_000
FIT_TERMS = 2048
RANK = 64
NEIGHBOURS = 25
POWER = 4
THRESHOLD = 0.3
TERM_BITS = 12
BLOCK = 256
REPEAT_WEIGHT = 3.0
SPREAD = np.uint64(0x9E3779B97F4A7C15)  # an odd multiplier; fixed value

# Character classes, in order: others, upper, lower, digit, space, line end, beyond ASCII, then punctuation.
PUNCTUATION = [b"!?", b".", b",;:", b"|", b"%$&#*@", b"'\"`", b"()[]{}", b"-_=+~", b"/\\<>"]
CLASSES = np.zeros(256, np.int64)
CLASSES[65:91], CLASSES[97:123], CLASSES[48:58], CLASSES[128:] = 1, 2, 3, 6
CLASSES[list(b" \t")], CLASSES[list(b"\n\r")] = 4, 5
for _number, _signs in enumerate(PUNCTUATION):
    CLASSES[list(_signs)] = 7 + _number
SHAPES = 16**3
TERMS = (1 << TERM_BITS) + SHAPES + 2


def term_weights(text: bytes) -> np.ndarray:
    """Root shares of the text's terms: byte runs, class runs, repeated words and repeated lines."""
    out = np.zeros(TERMS, np.float32)
    data = np.frombuffer(text, np.uint8)
    if len(data) < 3:
        data = np.pad(data, (0, 3 - len(data)), constant_values=32) if len(data) else data
    if not len(data):
        return out
    wide = data.astype(np.uint64)
    runs = ((wide[:-2] << np.uint64(16)) | (wide[1:-1] << np.uint64(8)) | wide[2:]) * SPREAD >> np.uint64(64 - TERM_BITS)
    kind = CLASSES[data]
    shapes = (kind[:-2] * 16 + kind[1:-1]) * 16 + kind[2:]
    n = len(runs)
    out[: 1 << TERM_BITS] = np.bincount(runs.astype(np.int64), minlength=1 << TERM_BITS) / n
    out[1 << TERM_BITS : -2] = np.bincount(shapes, minlength=SHAPES) / n
    words, lines = text.split(), [x for x in text.split(b"\n") if x]
    out[-2] = REPEAT_WEIGHT * sum(map(bytes.__eq__, words, words[1:])) / max(1, len(words) - 1)
    out[-1] = REPEAT_WEIGHT * (1 - len(set(lines)) / len(lines)) if lines else 0
    return np.sqrt(out)


@dataclass
class Model:
    space: np.ndarray  # (terms, rank)
    voters: np.ndarray  # (voters, rank), of length one
    labels: np.ndarray

    def vectors(self, weights: np.ndarray) -> np.ndarray:
        out = weights @ self.space
        length = np.linalg.norm(out, axis=1, keepdims=True)
        return np.divide(out, length, out=np.zeros_like(out), where=length > 0)

    def score(self, texts: list[bytes]) -> np.ndarray:
        if not len(self.labels):
            return np.ones(len(texts))
        near = self.vectors(np.stack([term_weights(t) for t in texts])) @ self.voters.T
        k = min(NEIGHBOURS, len(self.labels))
        best = np.argpartition(-near, k - 1, axis=1)[:, :k]
        weight = np.maximum(0, np.take_along_axis(near, best, axis=1).astype(np.float64)) ** POWER
        total = weight.sum(axis=1)
        vote = (weight * self.labels[best]).sum(axis=1) / np.where(total > 0, total, 1)
        return np.clip(np.where(total > 0, vote, self.labels.mean()), 0, 1)


def fit(weights: np.ndarray, labels: np.ndarray) -> Model:
    if not len(labels):
        return Model(np.zeros((TERMS, 1), np.float32), np.zeros((0, 1), np.float32), labels)
    # In blocks of terms: the driver holds the weights once.
    blocks = [slice(at, at + FIT_TERMS) for at in range(0, TERMS, FIT_TERMS)]
    rarity = np.log(1 + len(labels) / (1 + np.concatenate([(weights[:, b] > 0).sum(axis=0) for b in blocks]))).astype(np.float32)
    rarity[-2:] = 1
    # The right singular vectors, by way of the smaller Gram matrix of rows.
    gram = np.zeros((len(labels), len(labels)))
    for b in blocks:
        scaled = weights[:, b] * rarity[b]
        gram += scaled @ scaled.T
    values, left = np.linalg.eigh(gram)
    values, left = values[::-1][:RANK], left[:, ::-1][:, :RANK].copy()
    del gram
    good = values > max(values[0], 1e-12) * 1e-9
    left = (left[:, good] / np.sqrt(values[good])).astype(np.float32)
    space = np.concatenate([rarity[b, None] ** 2 * (weights[:, b].T @ left) for b in blocks])
    model = Model(space, np.zeros((0, 1), np.float32), labels)
    model.voters = model.vectors(weights)
    return model


def voters(docs: DataFrame, labels: DataFrame, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Term weights and labels of about ``most`` labelled rows, drawn evenly by a hash of their ids."""
    mean = labels.filter("doc_id is not null and quality is not null").groupBy("doc_id").agg(
        F.avg("quality").alias("label")
    )
    scale = 1 << 30
    n = mean.count()
    share = int(scale * min(1.0, most / max(1, n)))
    drawn = mean.filter(F.pmod(F.xxhash64("doc_id"), F.lit(scale)) < share).collect()
    small = docs.sparkSession.createDataFrame([(r.doc_id, float(r.label)) for r in drawn], "doc_id long, label double")
    schema = pa.schema(
        [("doc_id", pa.int64()), ("label", pa.float64()), ("place", pa.binary()), ("weight", pa.binary())]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            full = [term_weights(t) for t in utf8(batch.column("text"))]
            places = [np.flatnonzero(w).astype(np.int32) for w in full]
            values = [w[p].tobytes() for w, p in zip(full, places)]
            yield batch_of(schema, batch.column("doc_id"), batch.column("label"), [p.tobytes() for p in places], values)

    own = docs.select(F.col("doc_id").cast("long"), "text").join(F.broadcast(small), "doc_id")
    rows = (
        own.mapInArrow(tidy(run), "doc_id long, label double, place binary, weight binary")
        .dropDuplicates(["doc_id"]).orderBy("doc_id").collect()
    )
    found = np.array([r.label for r in rows])
    weights = np.zeros((len(rows), TERMS), np.float32)
    for out in weights[::-1]:
        row = rows.pop()
        out[np.frombuffer(row.place, np.int32)] = np.frombuffer(row.weight, np.float32)
    return weights, found


def broadcast_model(learn_from: DataFrame, labels: DataFrame, most: int):
    """The fitted model at every task; what the driver needed to fit it is given back."""
    model = learn_from.sparkSession.sparkContext.broadcast(fit(*voters(learn_from, labels, most)))
    release()
    return model


def scored(docs: DataFrame, learn_from: DataFrame, labels: DataFrame, most: int = SAMPLE) -> DataFrame:
    """Add ``score`` to rows that have ``text``."""
    model = broadcast_model(learn_from, labels, most)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK):
                own = batch.slice(at, BLOCK)
                score = pa.array(model.value.score(utf8(own.column("text"))), pa.float64())
                yield pa.RecordBatch.from_arrays([*own.columns, score], [*own.schema.names, "score"])

    fields = ", ".join(f"`{c}` {t}" for c, t in docs.dtypes)
    return docs.mapInArrow(tidy(run), f"{fields}, score double")


def training_fold(rows: DataFrame) -> DataFrame:
    return rows.filter(crc_mod("doc_id", 5) != 0)


def quality_report(docs: DataFrame, labels: DataFrame) -> DataFrame:
    rows = docs.select(F.col("doc_id").cast("long"), "text", (crc_mod("doc_id", 5) == 0).alias("held_out"))
    found = scored(rows, training_fold(docs), training_fold(labels))
    return found.select(
        "doc_id", "held_out", "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted")
    )


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows that are not rejected, with their columns."""
    model = broadcast_model(training_fold(docs), training_fold(labels), SAMPLE)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK):
                own = batch.slice(at, BLOCK)
                yield own.filter(pa.array(model.value.score(utf8(own.column("text"))) >= threshold))

    return docs.mapInArrow(tidy(run), docs.schema)
