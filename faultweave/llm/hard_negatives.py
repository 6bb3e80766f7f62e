"""Hard negatives: rows of another label that score nearly as high as a positive.

A row's score is the integer inner product of its vector with an anchor's. For each anchor
the best rows of its own label are its positives; for each positive the best rows of other
labels whose score lies in a window below the positive's are its hard negatives.

Both are searches of all rows for a stated set of anchors. Rows are dealt into shards of
bounded size and anchors into blocks; a task meets one shard and one block, and searches by
the threshold algorithm (``Shard``): for each dimension the shard's rows are a list sorted
by value; an anchor reads the lists from the end that its sign prefers, some depth at a
time, looks up and scores each row it meets for the first time, and stops when the most that
an unread row could score, the threshold, falls strictly below the last score wanted in each
window. What the shards find is merged; the best of all are among the best of a shard.

Defined results: rows with a null label, a null vector or a null or non-finite component,
or another length than most vectors, take no part. A row of the anchor's own id is no
positive of it. Ties go to the smaller id, null last. Rows that repeat are rows of their own.
Anchors without positives and windows without rows give nothing, and so do positives of
a score below zero, whose windows are empty. Vectors whose products do not fit a long are an
error. Clashing column names do not matter: only id, label and vector are read.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.stage import discard
from ..operators.twolevel import BUCKET, in_ranges
from .common import bounded_batches, staged
from .vectors import dimension, scaled, with_length

SCALE = 256
POSITIVES = 5
NEGATIVES = 10
#: A negative's score lies between these hundredths of the positive's.
LOW, HIGH = 30, 90
#: Components that a shard holds, and anchors in a block.
SHARD_SIZE = 1 << 21
ANCHORS = 256
#: The first depth to which lists are read; each next step reads four times as deep.
DEPTH = 64
_NONE = np.iinfo(np.int64).max


class Shard:
    """Rows as one sorted list for each dimension."""

    def __init__(self, data: np.ndarray, ids: np.ndarray) -> None:
        self.data, self.ids = data, ids
        self.up = np.ascontiguousarray(np.argsort(data, axis=0, kind="stable").T.astype(np.int32))
        self.down = self.up[:, ::-1]
        self.exact = np.abs(data).max(initial=0) ** 2 * data.shape[1] < 2**53

    def _score(self, rows: np.ndarray, anchor: np.ndarray) -> np.ndarray:
        if self.exact and np.abs(anchor).max(initial=0) ** 2 * len(anchor) < 2**53:
            return (self.data[rows] @ anchor).astype(np.int64)
        return (self.data[rows].astype(np.int64) * anchor.astype(np.int64)).sum(axis=1)

    def _threshold(self, anchor: np.ndarray, plus: np.ndarray, minus: np.ndarray, depth: int) -> float:
        """No row that stands below ``depth`` in all lists scores more. A double may be
        off by its rounding, which is added."""
        high = self.data[self.down[plus, depth], plus] @ anchor[plus]
        low = self.data[self.up[minus, depth], minus] @ anchor[minus]
        return high + low + (0 if self.exact else (abs(high) + abs(low)) * 2**-40)

    def best(self, anchor: np.ndarray, wanted: np.ndarray, windows: Sequence[tuple[float, float]], k: int) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each window ``(low, high)`` the first ``k`` of the ``wanted`` rows whose
        score lies in it, best first, and their scores."""
        n = len(self.data)
        plus, minus = np.flatnonzero(anchor > 0), np.flatnonzero(anchor < 0)
        met, score = np.zeros(n, bool), np.zeros(n, np.int64)
        known = np.zeros(n, bool)
        open_, depth, step = list(windows), 0, DEPTH
        while open_ and depth < n:
            upto = min(n, depth + step)
            if len(plus) + len(minus):
                met[self.down[plus, depth:upto].ravel()] = True
                met[self.up[minus, depth:upto].ravel()] = True
            else:
                met[:], upto = True, n  # an anchor of zeros: no list comes first
            fresh = np.flatnonzero(met & ~known & wanted)
            score[fresh] = self._score(fresh, anchor)
            known |= met
            depth, step = upto, step * 4
            if depth < n and not known.all():
                most = self._threshold(anchor, plus, minus, depth)
                open_ = [w for w in open_ if w[1] >= w[0] and most >= self._last(score, known & wanted, w, k, most)]
            else:
                break
        known &= wanted
        return [self._first(score, known, w, k) for w in windows]

    @staticmethod
    def _last(score: np.ndarray, known: np.ndarray, window: tuple[float, float], k: int, most: float) -> float:
        """The score that an unread row has to reach: the k-th in the window so far."""
        low, high = window
        if most >= high:
            return low  # above all that the window takes: not worth looking
        inside = score[known & (score >= low) & (score <= high)]
        return low if len(inside) < k else np.partition(inside, len(inside) - k)[len(inside) - k]

    def _first(self, score: np.ndarray, known: np.ndarray, window: tuple[float, float], k: int) -> tuple[np.ndarray, np.ndarray]:
        low, high = window
        rows = np.flatnonzero(known & (score >= low) & (score <= high))
        if len(rows) > k:
            rows = rows[score[rows] >= np.partition(score[rows], len(rows) - k)[len(rows) - k]]
        rows = rows[np.lexsort((self.ids[rows], -score[rows]))][:k]
        return rows, score[rows]


def _ids(column: pa.ChunkedArray) -> np.ndarray:
    return np.asarray(column.cast(pa.int64()).fill_null(_NONE))


def _out(anchors: list, turns: list, ids: list, scores: list) -> pa.Table:
    def whole(x: list) -> np.ndarray:
        return np.concatenate(x) if x else np.zeros(0, np.int64)

    found = whole(ids)
    return pa.table({"anchor": pa.array(whole(anchors)), "turn": pa.array(whole(turns).astype(np.int32)), "found": pa.array(found, mask=found == _NONE), "score": pa.array(whole(scores))})


_FOUND = "anchor long, turn int, found long, score long"


def _search(rows: DataFrame, anchors: DataFrame, f) -> DataFrame:
    """``f`` on each shard with each block of anchors that is sent to it."""
    return rows.groupBy("shard", "block").cogroup(anchors.groupBy("shard", "block")).applyInArrow(f, _FOUND)


def _best(found: DataFrame, keys: Sequence[str], k: int) -> DataFrame:
    """The best ``k`` for each key, with ``rank`` from 1."""
    order = Window.partitionBy(*keys).orderBy(F.desc("score"), F.asc_nulls_last("found"))
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def hard_negatives(
    rows: DataFrame, is_anchor: Column, id_column: str = "vec_id", label: str = "label", vector: str = "embedding",
    positives: int = POSITIVES, negatives: int = NEGATIVES, low: int = LOW, high: int = HIGH, scale: int = SCALE, shard_size: int = SHARD_SIZE, block: int = ANCHORS,
) -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score``."""
    bounded_batches(rows.sparkSession)
    size = dimension(rows.where(F.col(label).isNotNull()), vector)
    rows = with_length(rows.where(F.col(label).isNotNull()), vector, size)
    rows = rows.select(F.monotonically_increasing_id().alias("row"), F.col(id_column).cast("long").alias("id"), F.col(label).cast("string").alias("label"), F.col(vector).alias("vector"), F.coalesce(is_anchor, F.lit(False)).alias("is_anchor"))
    table = staged(rows, "vectors")
    order = [F.col("label"), F.xxhash64("row"), F.col("row")]
    dealt = in_ranges(table.drop("is_anchor"), order, max(1, shard_size // max(size, 1)))
    shards = dealt.withColumnRenamed(BUCKET, "shard")
    asking = in_ranges(table.where("is_anchor").drop("is_anchor"), order, block).withColumnRenamed(BUCKET, "block")
    discard(table)
    n_shards, n_blocks = (t.agg(F.max(c)).first()[0] for t, c in ((shards, "shard"), (asking, "block")))
    if n_blocks is None:
        return shards.where(F.lit(False)).selectExpr("id AS anchor_id", "id AS positive_id", "0 AS rank", "id AS negative_id", "row AS positive_score", "row AS negative_score")

    def anchor_columns(table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        return np.asarray(table["row"]), _ids(table["id"]), np.asarray(table["label"].to_pandas(), object), scaled(table["vector"], size, scale, 1)

    def near(key, shard: pa.Table, anchors: pa.Table) -> pa.Table:
        """The best rows of the anchor's label."""
        out: tuple[list, list, list, list] = ([], [], [], [])
        if shard.num_rows and anchors.num_rows:
            labels, data, ids = np.asarray(shard["label"].to_pandas(), object), scaled(shard["vector"], size, scale, 1), _ids(shard["id"])
            row, own, label_of, a = anchor_columns(anchors)
            for name in set(label_of):
                same = np.flatnonzero(labels == name)
                part = Shard(data[same], ids[same])
                for i in np.flatnonzero(label_of == name):
                    ((at, score),) = part.best(a[i], part.ids != own[i], [(-np.inf, np.inf)], positives)
                    for x, y in zip(out, (np.full(len(at), row[i]), np.zeros(len(at), np.int64), part.ids[at], score), strict=True):
                        x.append(y)
        return _out(*out)

    def hard(key, shard: pa.Table, anchors: pa.Table) -> pa.Table:
        """The best rows of other labels in each window."""
        out: tuple[list, list, list, list] = ([], [], [], [])
        if shard.num_rows and anchors.num_rows:
            labels, part = np.asarray(shard["label"].to_pandas(), object), Shard(scaled(shard["vector"], size, scale, 1), _ids(shard["id"]))
            row, _, label_of, a = anchor_columns(anchors)
            for i, windows in enumerate(anchors["windows"].to_pylist()):
                found = part.best(a[i], labels != label_of[i], [(w["low"], w["high"]) for w in windows], negatives)
                for w, (at, score) in zip(windows, found, strict=True):
                    for x, y in zip(out, (np.full(len(at), row[i]), np.full(len(at), w["turn"]), part.ids[at], score), strict=True):
                        x.append(y)
        return _out(*out)

    # First round: a block meets the shards that hold one of its labels.
    meet = shards.select("shard", "label").distinct().join(asking.select("block", "label").distinct(), "label").select("shard", "block").distinct()
    meet = staged(meet, "meetings")
    found = _search(shards.join(meet, "shard"), asking.join(meet, "block"), near)
    best = _best(found, ["anchor"], positives).select("anchor", F.col("rank").alias("turn"), F.col("found").alias("positive_id"), F.col("score").alias("positive_score"))
    best = staged(best, "positives")
    # Second: every block meets every shard. Scores are integers, so windows are too.
    bounds = best.where("positive_score >= 0").select("anchor", F.struct("turn", F.call_function("div", F.col("positive_score") * low + 99, F.lit(100)).alias("low"), F.call_function("div", F.col("positive_score") * high, F.lit(100)).alias("high")).alias("w"))
    bounds = bounds.groupBy("anchor").agg(F.sort_array(F.collect_list("w")).alias("windows"))
    asked = staged(asking.join(bounds, asking["row"] == bounds["anchor"]).drop("anchor"), "asking")
    found = _search(
        shards.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(n_blocks)))),
        asked.withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(n_shards)))),
        hard,
    )
    merged = staged(_best(found, ["anchor", "turn"], negatives), "negatives")
    out = merged.join(best, ["anchor", "turn"]).join(asking.select(F.col("row").alias("anchor"), F.col("id").alias("anchor_id")), "anchor")
    discard(dealt, meet, asked)
    return out.select("anchor_id", "positive_id", "rank", F.col("found").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
