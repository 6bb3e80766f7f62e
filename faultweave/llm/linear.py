"""Hashed features of texts and sparse linear models over them, for the classifiers.

A text's features are hashed n-grams: runs of words, and stems, the first bytes of words.
A feature's value is the square root of its count, the whole scaled to length 1; or, with
``binary``, 1 if it occurs.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches
from .words import CASED, MARKS, TOKENS, WORDS, U, Words, buffers, chunks, mix, ngrams, scan

BITS = 20


@dataclass(frozen=True)
class Space:
    """Which n-grams make the features: orders of words, and stem lengths."""

    words: tuple[int, ...] = (1, 2)
    stems: tuple[int, ...] = ()
    lower: bool = True
    bits: int = BITS
    binary: bool = False
    marks: str = "kept"  # by words; or "apart", as words of their own; or "dropped"
    ditto: bool = False  # a word that repeats the one before stands as a ditto mark


_DITTO = mix(np.array([0xD1770], U))[0]


def with_dittos(w: Words) -> np.ndarray:
    """Word hashes, those of repeats of the word before replaced by one mark."""
    same = np.zeros(len(w.hash), bool)
    same[1:] = w.hash[1:] == w.hash[:-1]
    same[w.first[:-1][w.first[:-1] < len(same)]] = False
    return np.where(same, _DITTO, w.hash)


def stem(w: Words, length: int) -> np.ndarray:
    """Hash of the first ``length`` bytes, A-Z folded, of words longer than that."""
    at = w.begin[w.end - w.begin > length]
    out = np.zeros(len(at), U)
    for k in range(length):
        byte = w.data[at + k].astype(U)
        byte[(byte >= U(65)) & (byte <= U(90))] += U(32)
        out = out * U(257) + byte
    return mix(out ^ U(0x5354 + length))


def features(w: Words, space: Space) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each text its distinct slots and their values."""
    kinds: list[tuple[np.ndarray, np.ndarray]] = []
    words = with_dittos(w) if space.ditto else w.hash
    for n in space.words:
        kinds.append((ngrams(words, n), np.arange(max(0, len(words) - n + 1)) + n))
    mask, shift = U((1 << space.bits) - 1), U(64 - space.bits)
    slots = [((h >> shift) & mask, upto) for h, upto in kinds]
    stems = []
    for length in space.stems:
        places = np.flatnonzero(w.end - w.begin > length)
        stems.append(((stem(w, length) >> shift) & mask, places))
    for i in range(len(w)):
        a, b = int(w.first[i]), int(w.first[i + 1])
        parts = [s[a : max(a, b - n + 1)] for (s, _), n in zip(slots, space.words, strict=True)]
        for s, places in stems:
            lo, hi = np.searchsorted(places, (a, b))
            parts.append(s[lo:hi])
        found, counts = np.unique(np.concatenate(parts), return_counts=True) if b > a else (np.zeros(0, U), np.zeros(0, np.int64))
        if space.binary:
            yield found.astype(np.int64), np.ones(len(found))
            continue
        value = np.sqrt(counts.astype(np.float64))
        yield found.astype(np.int64), value / max(np.sqrt(value @ value), 1e-12)


def over(texts: pa.Array, space: Space) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """``features`` of a string column."""
    table = WORDS if space.marks == "dropped" else TOKENS if space.lower else CASED
    data, offsets = buffers(texts)
    for i, j in chunks(offsets):
        w = scan(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], table, MARKS if space.marks == "apart" else None)
        yield from features(w, space)


def sigmoid(x):
    return 1.0 / (1.0 + np.exp(-np.clip(x, -35, 35)))


class Ftrl:
    """Logistic regression by follow-the-regularised-leader updates, one example after
    the other, with a rate for each weight and L1 sparsity. Slot 0 to ``size - 1`` are
    features; the last is the bias."""

    def __init__(self, size: int, alpha: float = 0.5, beta: float = 1.0, l1: float = 0.02, l2: float = 0.1) -> None:
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2
        self.z, self.n = np.zeros(size + 1), np.zeros(size + 1)

    def weights(self, at=slice(None)) -> np.ndarray:
        z = self.z[at]
        w = (np.sign(z) * self.l1 - z) / ((self.beta + np.sqrt(self.n[at])) / self.alpha + self.l2)
        return np.where(np.abs(z) <= self.l1, 0.0, w)

    def update(self, slots: np.ndarray, values: np.ndarray, label: float, weight: float = 1.0) -> None:
        at = np.append(slots, len(self.z) - 1)
        x = np.append(values, 1.0)
        w = self.weights(at)
        g = (sigmoid(w @ x) - label) * weight * x
        n = self.n[at]
        self.z[at] += g - (np.sqrt(n + g * g) - np.sqrt(n)) / self.alpha * w
        self.n[at] = n + g * g

    def fit(self, rows: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, epochs: int, weights: np.ndarray | None = None, seed: int = 1) -> np.ndarray:
        order = np.random.default_rng(seed)
        for _ in range(epochs):
            for i in order.permutation(len(rows)):
                self.update(*rows[i], labels[i], 1.0 if weights is None else weights[i])
        # Some slots at a time: temporaries of all of them would be most of the task's memory.
        out, step = np.empty(len(self.z)), 1 << 16
        for i in range(0, len(out), step):
            out[i : i + step] = self.weights(slice(i, i + step))
        return out


def score(rows, model: np.ndarray) -> np.ndarray:
    """Probabilities: sparse dot products with the model, the bias last."""
    return sigmoid(np.array([model[s] @ v + model[-1] for s, v in rows]))


def score_column(docs: DataFrame, model: np.ndarray, space: Space, text: str = "text"):
    """A column with ``score`` of the texts of ``docs``. Only the text goes to Python."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("double")
    def scores(texts: pa.Array) -> pa.Array:
        return pa.array(score(over(texts, space), sent.value), pa.float64())

    return scores(F.col(text))


def training_rows(docs: DataFrame, labels: DataFrame, columns: list[str], most: int) -> DataFrame:
    """``doc_id, text`` and the label columns of at most ``most`` labelled documents: all
    if there are no more, else those with the least hash of the id. Only ids and labels
    are sorted. Rows without a label are left out; of an id's label rows and texts the
    least counts.
    """
    bounded_batches(docs.sparkSession)
    labelled = labels.where(F.col("doc_id").isNotNull() & F.greatest(*[F.col(c).isNull().cast("int") for c in columns], F.lit(0)).eqNullSafe(0))
    labelled = labelled.groupBy("doc_id").agg(F.min(F.struct(*columns)).alias("y"))
    picked = labelled.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most).select("doc_id", *[F.col(f"y.{c}").cast("double").alias(c) for c in columns])
    found = docs.select("doc_id", "text").join(F.broadcast(picked), "doc_id")
    return found.groupBy("doc_id").agg(F.min("text").alias("text"), *[F.min(c).alias(c) for c in columns])


FEATURE_ROWS = "doc_id long, y array<double>, slots binary, vals binary"


def feature_table(rows: DataFrame, columns: list[str], space: Space) -> DataFrame:
    """Training rows as packed features; texts stay on the executors."""

    def run(batches):
        for batch in batches:
            found = list(over(batch.column(1), space))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(2), pa.array([s.astype(np.int32).tobytes() for s, _ in found], pa.binary()), pa.array([v.astype(np.float32).tobytes() for _, v in found], pa.binary())],
                ["doc_id", "y", "slots", "vals"],
            )

    return rows.select("doc_id", "text", F.array(*columns).alias("y")).mapInArrow(run, FEATURE_ROWS)


def unpack(slots, vals, order) -> list[tuple[np.ndarray, np.ndarray]]:
    """Rows of a packed column pair, as views: a bounded sample still is some 100 MB."""
    rows = [(np.frombuffer(s.as_buffer(), np.int32), np.frombuffer(v.as_buffer(), np.float32)) for s, v in zip(slots, vals, strict=True)]
    return [rows[i] for i in order]
