"""Line deduplication that can be extended and taken back.

A line's key is its text, white space stripped at both ends and A-Z folded, as a digest
of 128 bits. The exact state is a log of references, a row for each key and document that
comes to hold it (1) or ceases to (-1); from it come, per key, the number of documents and
the largest id. Keys of at least ``min_chars`` code points in at least ``min_docs``
documents are frequent: their lines go from all documents but the one with the largest id.
Cuckoo filters, a shard for every ``SHARD_KEYS`` frequent keys, screen lines before the
exact table decides; a key is looked up in its own shard only. Inserting and deleting
documents appends to the log what changed, counts the touched keys anew, and puts into or
takes out of the filters just the keys that became or ceased to be frequent.

Defined results: null and empty texts are one empty line and keep it. Rows with one id
count as one document. Rows without an id count for no key and lose every frequent line.
A text of which no line is left is empty. Extra columns are kept, but ``n_lines`` and
``n_dropped`` are replaced; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, replace
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.stage import discard
from .common import BROADCAST_ROWS, join_by_group, quoted, small_side, staged, unused, with_row_key
from .cuckoo import CuckooFilter, Full

#: Fixed value: what is stripped from both ends of a line.
BLANK = b" \t\n\x0b\x0c\r"
MIN_CHARS = 40
MIN_DOCS = 5
SHARD_KEYS = 50_000
#: Filters together up to this size are sent to every task to screen lines; beyond it the
#: join with the exact table alone decides.
SCREEN_BYTES = 64 << 20
#: Parts that the log of references may have before it is written anew.
MOST_PARTS = 16


def line_key(line: bytes, min_chars: int = MIN_CHARS) -> bytes | None:
    """The digest of a line's key, or None if the key is too short to count."""
    key = line.strip(BLANK).lower()
    if len(key) < min_chars or (len(key) < 4 * min_chars and len(key.decode("utf-8", "replace")) < min_chars):
        return None
    return hashlib.blake2b(key, digest_size=16).digest()


def line_keys(docs: DataFrame, min_chars: int = MIN_CHARS, carry: Sequence[str] = ()) -> DataFrame:
    """``key, doc_id``: the distinct keys of each row. ``carry`` names more long columns."""
    names = ["doc_id", *carry]

    def packed(keys: list, rows: list, batch: pa.RecordBatch) -> pa.RecordBatch:
        at = pa.array(rows, pa.int64())
        return pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), *(batch.column(k).take(at) for k in range(len(names)))], ["key", *names])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, rows = [], []
            for i, t in enumerate(batch.column(len(names))):
                found = {line_key(x, min_chars) for x in (t.as_py() or "").encode().split(b"\n")}
                found.discard(None)
                keys += found
                rows += [i] * len(found)
                if len(keys) > 100_000:
                    yield packed(keys, rows, batch)
                    keys, rows = [], []
            yield packed(keys, rows, batch)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), *carry, "text").mapInArrow(run, ", ".join(["key binary", *(f"{c} long" for c in names)]))


@dataclass(frozen=True)
class LineState:
    """The tables of an incremental run."""

    parts: tuple[DataFrame, ...]  # key, doc_id, change
    frequent: DataFrame  # key, n_docs, max_doc
    filters: DataFrame  # shard, filter
    shards: int
    min_chars: int = MIN_CHARS
    min_docs: int = MIN_DOCS

    @property
    def log(self) -> DataFrame:
        return reduce(DataFrame.unionByName, self.parts)

    @property
    def references(self) -> DataFrame:
        """``key, doc_id``: which document holds which key now."""
        return held(self.log)


def held(log: DataFrame) -> DataFrame:
    return log.groupBy("key", "doc_id").agg(F.sum("change").alias("change")).where("change > 0").select("key", "doc_id")


def shard_of(shards: int):
    """The shard of column ``key``: digests are even, so their first bytes decide."""
    return (F.conv(F.hex(F.substring("key", 1, 4)), 16, 10).cast("long") % shards).cast("int")


def shards_of(keys: list[bytes], shards: int) -> np.ndarray:
    return np.frombuffer(b"".join(keys), ">u4").reshape(-1, 4)[:, 0].astype(np.int64) % shards


class Screens:
    """The filters by shard. A key is looked up in the filter of its own shard."""

    def __init__(self, filters: dict[int, bytes], shards: int) -> None:
        self.shards = shards
        self.filters = {shard: CuckooFilter.load(raw) for shard, raw in filters.items()}

    def contains(self, keys: list[bytes]) -> np.ndarray:
        out = np.zeros(len(keys), bool)
        own = shards_of(keys, self.shards)
        for shard in np.unique(own).tolist():
            if shard in self.filters:
                at = np.flatnonzero(own == shard)
                out[at] = self.filters[shard].contains([keys[i] for i in at.tolist()])
        return out


def screens(state: LineState) -> Screens:
    return Screens({r.shard: bytes(r.filter) for r in state.filters.collect()}, state.shards)


def _frequent(references: DataFrame, min_docs: int) -> DataFrame:
    counts = references.groupBy("key").agg(F.count(F.lit(1)).alias("n_docs"), F.max("doc_id").alias("max_doc"))
    return counts.where(F.col("n_docs") >= min_docs)


def _built(frequent: DataFrame, shards: int) -> DataFrame:
    def build(table: pa.Table) -> pa.Table:
        keys = table.column("key").to_pylist()
        return pa.table({"shard": table.column("shard").slice(0, 1), "filter": pa.array([CuckooFilter.of(keys).dump()], pa.binary())})

    keyed = frequent.select("key", shard_of(shards).alias("shard"))
    return staged(keyed.groupBy("shard").applyInArrow(build, "shard int, filter binary"), "line-filters")


def start(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> LineState:
    """The state of a first set of documents."""
    found = line_keys(docs.where(F.col("doc_id").isNotNull()), min_chars)
    log = staged(found.groupBy("key", "doc_id").agg(F.lit(1).alias("change")), "line-references")
    frequent = staged(_frequent(log, min_docs), "line-counts")
    shards = max(1, -(-frequent.count() // SHARD_KEYS))
    return LineState((log,), frequent, _built(frequent, shards), shards, min_chars, min_docs)


def _moved(state: LineState, change: DataFrame) -> LineState:
    """The state after a staged change of the log. Only touched keys are counted anew, and
    only filters of their shards are written anew."""
    parts = (*state.parts, change)
    touched = staged(change.select("key").distinct(), "line-touched")
    log = reduce(DataFrame.unionByName, parts)
    now = staged(_frequent(held(log.join(small_side(touched), "key", "left_semi")), state.min_docs), "line-recounted")
    frequent = staged(state.frequent.join(small_side(touched), "key", "left_anti").unionByName(now), "line-counts")
    up = now.join(state.frequent, "key", "left_anti").select("key", F.lit(True).alias("up"))
    down = state.frequent.join(small_side(touched), "key", "left_semi").join(now, "key", "left_anti").select("key", F.lit(False).alias("up"))
    changes = staged(up.unionByName(down).withColumn("shard", shard_of(state.shards)), "line-changes")

    def update(old: pa.Table, new: pa.Table) -> pa.Table:
        raw = old.column("filter").to_pylist()
        filter_ = CuckooFilter.load(raw[0]) if raw else CuckooFilter.sized(SHARD_KEYS)
        rows = list(zip(new.column("key").to_pylist(), new.column("up").to_pylist(), strict=True))
        filter_.delete([k for k, u in rows if not u])
        try:
            filter_.insert([k for k, u in rows if u])
            dumped = filter_.dump()
        except Full:
            dumped = b""
        return pa.table({"shard": new.column("shard").slice(0, 1), "filter": pa.array([dumped], pa.binary())})

    mine = changes.select("shard").distinct()
    old = state.filters.join(mine, "shard", "left_semi")
    filters = state.filters.join(mine, "shard", "left_anti").unionByName(old.groupBy("shard").cogroup(changes.groupBy("shard")).applyInArrow(update, "shard int, filter binary"))
    filters, shards = staged(filters, "line-filters"), state.shards
    if filters.where(F.octet_length("filter") == 0).limit(1).count():
        shards = max(1, -(-frequent.count() // SHARD_KEYS))
        filters = _built(frequent, shards)
    discard(touched, changes, now)
    if len(parts) > MOST_PARTS:
        parts = (staged(held(log).withColumn("change", F.lit(1)), "line-references"),)
    return replace(state, parts=parts, frequent=frequent, filters=filters, shards=shards)


def insert_documents(state: LineState, docs: DataFrame) -> LineState:
    """The state with more documents; ids may be new or old."""
    found = line_keys(docs.where(F.col("doc_id").isNotNull()), state.min_chars)
    found = staged(found.groupBy("key", "doc_id").agg(F.lit(1).alias("change")), "line-found")
    there = held(state.log.join(small_side(found.select("doc_id").distinct()), "doc_id", "left_semi"))
    change = staged(found.join(there, ["key", "doc_id"], "left_anti"), "line-references")
    discard(found)
    return _moved(state, change)


def delete_documents(state: LineState, ids: DataFrame) -> LineState:
    """The state without the documents in ``ids`` (column ``doc_id``)."""
    there = held(state.log.join(small_side(ids.select(F.col("doc_id").cast("long").alias("doc_id")).distinct()), "doc_id", "left_semi"))
    return _moved(state, staged(there.withColumn("change", F.lit(-1)), "line-references"))


DROPPED = "struct<text:string,n_lines:long,n_dropped:long>"
_SCHEMA = pa.struct([("text", pa.string()), ("n_lines", pa.int64()), ("n_dropped", pa.int64())])


def drop_lines(docs: DataFrame, state: LineState, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """``docs`` with ``text`` replaced and ``n_lines`` (before) and ``n_dropped`` added.

    Up to ``broadcast_rows`` frequent keys the filters and the exact table go to every
    task. Beyond that lines travel to the exact table: a shuffle by key, then the keys to
    drop to their rows. The result is the same.
    """
    (kept,) = unused(docs.columns, "_kept")
    rest = [c for c in docs.columns if c.lower() not in ("text", "n_lines", "n_dropped")]
    if state.frequent.count() <= broadcast_rows:
        out = _drop_in_place(docs, state, kept)
    else:
        out = _drop_by_shuffle(docs, state, kept)
    return out.select(*quoted(rest), *[F.col(kept)[c].alias(c) for c in ("text", "n_lines", "n_dropped")])


class Exact:
    """Frequent keys with the largest id that holds them, as sorted arrays."""

    def __init__(self, keys: list[bytes], top: list[int]) -> None:
        raw = np.frombuffer(b"".join(keys), np.uint64).reshape(-1, 2)
        order = np.lexsort((raw[:, 1], raw[:, 0]))
        self.a, self.b, self.top = raw[order, 0], raw[order, 1], np.array(top, np.int64)[order]

    def get(self, keys: list[bytes]) -> dict[bytes, int]:
        if not keys:
            return {}
        raw, out = np.frombuffer(b"".join(keys), np.uint64).reshape(-1, 2), {}
        lo, hi = np.searchsorted(self.a, raw[:, 0]), np.searchsorted(self.a, raw[:, 0], "right")
        for key, b, i, j in zip(keys, raw[:, 1].tolist(), lo.tolist(), hi.tolist(), strict=True):
            for k in range(i, j):
                if int(self.b[k]) == b:
                    out[key] = int(self.top[k])
        return out


def _drop_in_place(docs: DataFrame, state: LineState, name: str) -> DataFrame:
    sc = docs.sparkSession.sparkContext
    frequent = state.frequent.select("key", "max_doc").toArrow()
    exact = sc.broadcast(Exact(frequent.column("key").to_pylist(), frequent.column("max_doc").to_pylist()))
    filters = sc.broadcast(screens(state))
    min_chars = state.min_chars

    @F.arrow_udf(DROPPED)
    def kept(ids: pa.Array, texts: pa.Array) -> pa.Array:
        doc_ids, raws = ids.to_pylist(), [(t.as_py() or "").encode() for t in texts]
        split = [r.split(b"\n") for r in raws]
        keys = [[line_key(x, min_chars) for x in lines] for lines in split]
        flat = list({k for ks in keys for k in ks if k is not None})
        maybe = filters.value.contains(flat)
        hits = exact.value.get([k for k, m in zip(flat, maybe, strict=True) if m])
        rows = []
        for i, raw, lines, ks in zip(doc_ids, raws, split, keys, strict=True):
            gone = [k in hits and (i is None or i < hits[k]) for k in ks]
            n = sum(gone)
            text = b"\n".join(x for x, g in zip(lines, gone, strict=True) if not g) if n else raw
            rows.append({"text": text.decode(), "n_lines": len(lines), "n_dropped": n})
        return pa.array(rows, _SCHEMA)

    return docs.withColumn(name, kept(F.col("doc_id").cast("long"), F.col("text")))


def _drop_by_shuffle(docs: DataFrame, state: LineState, name: str) -> DataFrame:
    # Keys come back by row, not by id: rows without an id are many rows, not one key.
    keyed, (a, b) = with_row_key(docs)
    found = line_keys(keyed, state.min_chars, [a, b])
    size = state.filters.agg(F.sum(F.octet_length("filter"))).first()[0] or 0
    if size <= SCREEN_BYTES:
        filters = docs.sparkSession.sparkContext.broadcast(screens(state))

        def screen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                yield batch.filter(pa.array(filters.value.contains(batch.column(0).to_pylist())))

        found = found.mapInArrow(screen, found.schema)
    lost = join_by_group(found, state.frequent, "key", "n_docs", "inner").where(F.col("doc_id").isNull() | (F.col("doc_id") < F.col("max_doc")))
    (gone,) = unused([*docs.columns, a, b, name], "_lost")
    lost = lost.groupBy(a, b).agg(F.collect_set("key").alias(gone))
    joined = keyed.join(lost.hint("shuffle_hash"), [a, b], "left")
    min_chars = state.min_chars

    @F.arrow_udf(DROPPED)
    def kept(texts: pa.Array, losts: pa.Array) -> pa.Array:
        rows = []
        for t, lost in zip(texts, losts, strict=True):
            raw, keys = (t.as_py() or "").encode(), set(lost.as_py() or ())
            lines = raw.split(b"\n")
            left = [x for x in lines if line_key(x, min_chars) not in keys] if keys else lines
            rows.append({"text": b"\n".join(left).decode(), "n_lines": len(lines), "n_dropped": len(lines) - len(left)})
        return pa.array(rows, _SCHEMA)

    return joined.withColumn(name, kept(F.col("text"), F.col(gone)))


def dedup_lines(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    """A first set of documents without its frequent lines."""
    return drop_lines(docs, start(docs, min_chars, min_docs))
