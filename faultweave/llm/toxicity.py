"""Toxicity by a classifier chain.

The categories are predicted one after the other. Each has a linear model over hashed
words and word stems; a later one also gets the earlier categories' probabilities as
features. For training these come from models that did not see the document (folds by
hash of the id), so that the later model learns how far to trust them; for scoring they
come from the models of all training rows.

The models are learnt in one task from a bounded sample of labelled documents (``most``,
by default 12,000; with fewer labelled rows all of them). Every whole text is scored.

Defined results: a null or empty text has no features; its probabilities come from the
biases and the chain. Without any labelled row all are 0.5. Equal texts have equal
probabilities. An empty table gives an empty result; extra columns do not matter.
"""

from __future__ import annotations

import zlib
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .linear import Ftrl, Space, feature_table, over, score, sigmoid, training_rows, unpack

SPACE = Space(words=(1,), stems=(4, 5), binary=True, marks="dropped")
MOST = 12_000
THRESHOLD = 0.3
#: Rate and L1: few strong weights, so that long clean texts do not add up noise.
RATE, SPARSE = 1.0, 4.0
FOLDS = 3


def _logit(p: np.ndarray) -> np.ndarray:
    p = np.clip(p, 1e-4, 1 - 1e-4)
    return np.log(p / (1 - p)) / 4


def _chained(rows, earlier: list[np.ndarray], size: int):
    """Rows with a slot more for each earlier category."""
    if not earlier:
        return rows
    slots = np.arange(size, size + len(earlier))
    more = np.stack([_logit(p) for p in earlier], 1)
    return [(np.concatenate([s, slots]), np.concatenate([v, m])) for (s, v), m in zip(rows, more, strict=True)]


def learn_chain(rows, labels: np.ndarray, folds: np.ndarray, size: int, epochs: int = 3) -> list[np.ndarray]:
    """Weights of each category of ``labels`` (a column each), the bias last."""
    models, earlier = [], []
    width = size + labels.shape[1]
    for k in range(labels.shape[1]):
        x, y = _chained(rows, earlier, size), labels[:, k]
        held = np.full(len(x), 0.5)
        for f in range(FOLDS) if k + 1 < labels.shape[1] else ():
            inside, outside = np.flatnonzero(folds != f), np.flatnonzero(folds == f)
            if len(inside) and len(outside):
                w = Ftrl(width, alpha=RATE, l1=SPARSE).fit([x[i] for i in inside], y[inside], epochs)
                held[outside] = score([x[i] for i in outside], w)
        models.append(Ftrl(width, alpha=RATE, l1=SPARSE).fit(x, y, epochs))
        earlier.append(held)
    return models


def learn(docs: DataFrame, labels: DataFrame, categories: Sequence[str], most: int = MOST, space: Space = SPACE) -> np.ndarray:
    """The chain's weights, a row for each category."""
    size, n = 1 << space.bits, len(categories)
    rows = feature_table(training_rows(docs, labels, list(categories), most), list(categories), space)

    def fit(table: pa.Table) -> pa.Table:
        order = np.argsort(table.column("doc_id").to_numpy(), kind="stable")
        y = np.array(table.column("y").to_pylist(), float).reshape(-1, n)[order]
        folds = np.array([zlib.crc32(str(d).encode()) % FOLDS for d in table.column("doc_id").to_pylist()])[order]
        models = learn_chain(unpack(table.column("slots"), table.column("vals"), order), y, folds, size)
        kept = [np.flatnonzero(m).astype(np.int32) for m in models]
        return pa.table({"k": pa.array(range(n), pa.int32()), "slots": pa.array([i.tobytes() for i in kept], pa.binary()), "vals": pa.array([m[i].astype(np.float32).tobytes() for m, i in zip(models, kept, strict=True)], pa.binary())})

    chain = np.zeros((n, size + n + 1), np.float32)
    for r in rows.groupBy(F.lit(0).alias("one")).applyInArrow(fit, "k int, slots binary, vals binary").collect():
        chain[r.k, np.frombuffer(r.slots, np.int32)] = np.frombuffer(r.vals, np.float32)
    return chain


def score_chain(rows, chain: np.ndarray, size: int) -> np.ndarray:
    """Probabilities, a row for each text and a column for each category."""
    rows, out = list(rows), []
    base = np.array([[w[s] @ v for w in chain] for s, v in rows]).reshape(len(rows), len(chain))
    for k, w in enumerate(chain):
        total = base[:, k] + w[-1]
        for j, p in enumerate(out):
            total = total + w[size + j] * _logit(p)
        out.append(sigmoid(total))
    return np.stack(out, 1)


def toxicity_scores(docs: DataFrame, labels: DataFrame, most: int = MOST, threshold: float = THRESHOLD) -> DataFrame:
    """``doc_id, junk_score, toxic_score, toxic``. The chain is junk (``quality`` 0), then
    toxic: what marks junk can then neither count for nor against toxicity twice."""
    labels = labels.select("doc_id", (1 - F.col("quality")).alias("junk"), "toxic")
    chain = docs.sparkSession.sparkContext.broadcast(learn(docs, labels, ["junk", "toxic"], most))

    @F.arrow_udf("struct<junk:double,toxic:double>")
    def scores(texts: pa.Array) -> pa.Array:
        p = score_chain(over(texts, SPACE), chain.value, 1 << SPACE.bits)
        return pa.StructArray.from_arrays([pa.array(p[:, 0]), pa.array(p[:, 1])], ["junk", "toxic"])

    out = docs.select("doc_id", scores(F.col("text")).alias("p"))
    return out.select("doc_id", F.col("p.junk").alias("junk_score"), F.col("p.toxic").alias("toxic_score"), (F.col("p.toxic") >= threshold).cast("int").alias("toxic"))
