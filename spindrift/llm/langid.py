"""Language identification with a string kernel.

Texts are compared by the blended-spectrum presence kernel: the n-grams of one
to four bytes that both hold, over the root of the product of how many each
holds.  A bounded sample of labelled rows trains it: some of them are Nyström
landmarks, and kernel ridge regression on the landmark features learns one
language against the rest at a time.

N-grams are held exactly, and those that no landmark holds do not count: a very
long text holds more and more of these whatever its language.

A text's kernel values with all landmarks are one product of its presence row
with the landmarks' presence matrix, and its scores are a product of those with
the regression weights; the two matrices are multiplied once, so that scoring a
batch is a product of presence rows with one column for each language.

Defined cases: a text that is null or has no letter is ``und`` with score 0; if
no row can be learned from, every text is; languages that differ in case or
white space are different labels; repeated rows are kept; a null doc_id counts
as the empty text when folds are dealt; no rows give no rows; only ``doc_id``,
``text`` and ``lang`` are read, so other columns cannot clash.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spindrift.llm.common import batch_of, crc_mod, tidy

LONGEST = 4
PIECE = 1 << 20
SAMPLE_PER_LANGUAGE = 500
LANDMARKS = 300
RIDGE = 1e-2
SHARPNESS = 5.0


def presence(text: str) -> np.ndarray:
    """The n-grams that the lower-cased text holds, as numbers in order: the length and the bytes."""
    data = np.frombuffer(text.lower().encode(), np.uint8).astype(np.uint64)
    there = np.empty(0, np.int64)
    for at in range(0, len(data), PIECE):
        own = data[at : at + PIECE + LONGEST - 1]
        code, found = np.zeros(len(own), np.uint64), []
        for n in range(1, min(LONGEST, len(own)) + 1):
            code = (code[: len(own) - n + 1] << np.uint64(8)) | own[n - 1 :]
            found.append(np.unique(code + np.uint64(n << 40)).view(np.int64))
        there = np.union1d(there, np.concatenate(found)) if at else np.concatenate(found)
    return there


def places(vocabulary: np.ndarray, there: np.ndarray) -> np.ndarray:
    """Where in the sorted vocabulary the n-grams are that it has."""
    if not len(vocabulary):
        return np.empty(0, np.int64)
    at = np.searchsorted(vocabulary, there)
    at[at == len(vocabulary)] = 0
    return at[vocabulary[at] == there]


@dataclass
class Model:
    languages: list[str]
    vocabulary: np.ndarray  # n-grams of the landmarks, in order
    weights: np.ndarray  # (n-grams and a row of zeros, languages)
    offsets: np.ndarray

    def scores(self, rows: list[np.ndarray]) -> np.ndarray:
        """Presence rows times weights, each over the root of how many known n-grams it has."""
        rows = [places(self.vocabulary, r) for r in rows]
        sizes = np.array([max(1, len(r)) for r in rows])
        starts = np.concatenate(([0], np.cumsum(sizes)[:-1]))
        flat = np.concatenate([r if len(r) else [len(self.vocabulary)] for r in rows])
        return np.add.reduceat(self.weights[flat], starts, axis=0) / np.sqrt(sizes)[:, None] + self.offsets

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        known = [i for i, t in enumerate(texts) if t and self.languages and any(map(str.isalpha, t))]
        names, sure = ["und"] * len(texts), np.zeros(len(texts))
        if known:
            raw = SHARPNESS * self.scores([presence(texts[i]) for i in known])
            share = np.exp(raw - raw.max(axis=1, keepdims=True))
            share /= share.sum(axis=1, keepdims=True)
            for i, best, s in zip(known, share.argmax(axis=1), share.max(axis=1)):
                names[i], sure[i] = self.languages[best], s
        return names, sure


def fit(rows: list[tuple[str, np.ndarray]]) -> Model:
    """Train on (language, presence) rows."""
    languages = sorted({lang for lang, _ in rows})
    if not rows:
        return Model([], np.empty(0, np.int64), np.zeros((1, 0)), np.zeros(0))
    chosen = np.linspace(0, len(rows) - 1, min(LANDMARKS, len(rows))).astype(int)
    vocabulary = np.unique(np.concatenate([rows[i][1] for i in chosen]))
    known = [places(vocabulary, there) for _, there in rows]
    scale = np.array([1 / np.sqrt(max(1, len(own))) for own in known])
    # The landmarks that hold an n-gram, one n-gram after the other.
    held = np.concatenate([known[i] for i in chosen])
    order = np.argsort(held, kind="stable")
    holders = np.repeat(np.arange(len(chosen)), [len(known[i]) for i in chosen])[order]
    counts = np.bincount(held, minlength=len(vocabulary))
    starts = np.cumsum(counts) - counts
    near = np.zeros((len(rows), len(chosen)))
    for i, own in enumerate(known):
        n = counts[own]
        at = np.repeat(starts[own] - (np.cumsum(n) - n), n) + np.arange(n.sum())
        near[i] = np.bincount(holders[at], minlength=len(chosen)) * scale[i] * scale[chosen]
    values, vectors = np.linalg.eigh(near[chosen])
    good = values > values.max() * 1e-6
    root = vectors[:, good] / np.sqrt(values[good])  # Nyström features are near @ root
    features = np.column_stack([near @ root, np.ones(len(rows))])
    target = np.where(np.array([[lang == x for x in languages] for lang, _ in rows]), 1.0, -1.0)
    weigh = np.array([1 / sum(x == lang for x, _ in rows) for lang, _ in rows])[:, None]
    penalty = np.diag([RIDGE / len(languages)] * (features.shape[1] - 1) + [0.0]) + 1e-9 * np.eye(features.shape[1])
    solved = np.linalg.solve(features.T @ (weigh * features) + penalty, features.T @ (weigh * target))
    by_mark, weights = root @ solved[:-1], np.zeros((len(vocabulary) + 1, len(languages)))
    for i, own in zip(chosen, by_mark):
        weights[known[i]] += scale[i] * own
    return Model(languages, vocabulary, weights, solved[-1])


def training_rows(docs: DataFrame, per_language: int) -> list[tuple[str, np.ndarray]]:
    """About ``per_language`` rows of each language, drawn evenly over all rows, as presence rows."""
    counts = docs.groupBy("lang").count().orderBy("lang").collect()  # as many as there are labels
    if not counts:
        return []
    scale = 1 << 30
    most = F.lit(0)
    for row in counts:
        most = F.when(F.col("lang") == row.lang, int(scale * min(1.0, per_language / row["count"]))).otherwise(most)
    draw = F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(scale))
    schema = pa.schema([("lang", pa.string()), ("there", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch_of(schema, batch.column("lang"), [presence(t).tobytes() for t in batch.column("text").to_pylist()])

    drawn = docs.filter(draw < most).select("lang", "text").mapInArrow(tidy(run), "lang string, there binary")
    rows = [(r.lang, np.frombuffer(r.there, np.int64)) for r in drawn.collect()]
    return sorted(rows, key=lambda r: (r[0], len(r[1]), r[1].tolist()))


def identify(docs: DataFrame, learn_from: DataFrame, per_language: int = SAMPLE_PER_LANGUAGE) -> DataFrame:
    """Add ``lang_pred`` and ``score`` to rows with ``doc_id``, ``text`` and ``held_out``."""
    labelled = learn_from.filter("lang is not null and text is not null").select("lang", "text")
    model = docs.sparkSession.sparkContext.broadcast(fit(training_rows(labelled, per_language)))
    schema = pa.schema(
        [("doc_id", pa.int64()), ("held_out", pa.bool_()), ("lang_pred", pa.string()), ("score", pa.float64())]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                own = batch.slice(at, 256)
                yield batch_of(
                    schema, own.column("doc_id"), own.column("held_out"),
                    *model.value.predict(own.column("text").to_pylist()),
                )

    rows = docs.select(F.col("doc_id").cast("long"), "held_out", "text")
    return rows.mapInArrow(tidy(run), "doc_id long, held_out boolean, lang_pred string, score double")


def language_report(docs: DataFrame) -> DataFrame:
    folds = docs.select("doc_id", "text", "lang", (crc_mod("doc_id", 4) == 2).alias("held_out"))
    return identify(folds, folds.filter(~F.col("held_out")))
