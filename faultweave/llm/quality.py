"""Quality classifier: logistic regression on hashed word n-grams, learnt by
follow-the-regularised-leader updates, scored as sparse dot products.

Words stand between white space, letter case kept; runs of marks are words of their own,
and a word that repeats the one before it stands as a ditto mark, so that n-grams of words
never seen in training still tell of shouting, broken marks and endless repeats.

The model is learnt in one task from a bounded sample of labelled documents (``most``,
by default 12,000; with fewer labelled rows all of them) and has ``2 ** bits`` weights,
which is what is broadcast. Every whole text is scored.

Defined results: a null or empty text has no features; its score is the bias alone.
Without any labelled row every score is 0.5. Equal texts have equal scores. An empty table
gives an empty result; extra columns do not matter, but ``score`` and ``predicted`` are
replaced by ``scored``.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .linear import Ftrl, Space, feature_table, score_column, training_rows, unpack

SPACE = Space(words=(1, 2), lower=False, marks="apart", ditto=True)
MOST = 12_000
THRESHOLD = 0.3


def held_out(folds: int = 5, fold: int = 0):
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % folds == fold, F.lit(False))


def learn(docs: DataFrame, labels: DataFrame, label: str = "quality", most: int = MOST, space: Space = SPACE, epochs: int = 3) -> np.ndarray:
    """The weights, bias last."""
    rows = feature_table(training_rows(docs, labels, [label], most), [label], space)
    size = 1 << space.bits

    def fit(table: pa.Table) -> pa.Table:
        # In the order of ids without a sorted copy of the features.
        order = np.argsort(table.column("doc_id").to_numpy(), kind="stable")
        y = np.array([v[0] for v in table.column("y").to_pylist()])[order]
        x = unpack(table.column("slots"), table.column("vals"), order)
        model = Ftrl(size).fit(x, y, epochs)
        kept = np.flatnonzero(model).astype(np.int32)
        return pa.table({"slots": pa.array([kept.tobytes()], pa.binary()), "vals": pa.array([model[kept].astype(np.float32).tobytes()], pa.binary())})

    found = rows.groupBy(F.lit(0).alias("one")).applyInArrow(fit, "slots binary, vals binary").collect()
    model = np.zeros(size + 1, np.float32)
    for r in found:
        model[np.frombuffer(r.slots, np.int32)] = np.frombuffer(r.vals, np.float32)
    return model


def scored(docs: DataFrame, model: np.ndarray, space: Space = SPACE, threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` with ``score`` and ``predicted``; all other columns are kept."""
    docs = docs.drop(*[c for c in docs.columns if c.lower() in ("score", "predicted")])
    out = docs.withColumn("score", score_column(docs, model, space))
    return out.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def quality_scores(docs: DataFrame, labels: DataFrame, most: int = MOST) -> DataFrame:
    """``doc_id, held_out, score, predicted``: learnt from the rows that are not held out."""
    model = learn(docs.where(~held_out()), labels.where(~held_out()), most=most)
    return scored(docs.select("doc_id", held_out().alias("held_out"), "text"), model).drop("text")
