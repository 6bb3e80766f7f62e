"""Vectors as codes: the nearest entry of a small codebook for each part of a vector.

Vectors are cut into parts, and each part position has its own codebook. All distinct parts
with their numbers of rows are one table, sorted, so that it reads as a trie: its levels are
the position and then the part's components. A task goes through its stretch of the trie
depth first, some leaves at a time (``Walk``): a node's distances to all entries are those
of its parent plus one component's, so prefixes that parts share are added up once, and the
path to the last leaf is carried over to the next ones. Leaves take the nearest entry and
add their rows to its sums.

Components become integers, so sums are exact and do not depend on how rows are dealt out.
What goes through the driver are the codebooks, ``entries`` times the dimension.

Defined results: rows whose vector is null, or holds null or non-finite components, or is
not as long as most vectors are, are left out; the length is one that can be cut into equal
parts. The codebooks start with the first rows by id (null last), then by vector; a row that
occurs twice counts twice. With fewer rows than entries there are as many entries as rows.
No rows: an empty result. Components so large that a distance would not fit a long are an
error. Columns named ``code`` or ``error`` are replaced, all others stay.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.stage import discard
from .common import BROADCAST_BYTES, BROADCAST_ROWS, bounded_batches, join_by_group, quoted, staged, unused
from .vectors import dimension, scaled, with_length

PARTS = 8
ENTRIES = 16
ROUNDS = 6
SCALE = 4096
#: Vectors that a task encodes at a time.
STEP = 4096
_BIAS = 1 << 31


@dataclass(frozen=True)
class Codebooks:
    """``entries[position, entry]`` are integer vectors, as long as a part."""

    entries: np.ndarray

    def digest(self) -> str:
        """SHA-256 of all components by position, entry and place."""
        return hashlib.sha256(",".join(map(str, self.entries.ravel().tolist())).encode()).hexdigest()


class Walk:
    """A depth-first walk over parts in order of position and components."""

    def __init__(self, books: np.ndarray) -> None:
        self.books = books
        self.last: tuple[int, np.ndarray] | None = None
        self.path: list[np.ndarray] = []

    def leaves(self, position: np.ndarray, part: np.ndarray) -> np.ndarray:
        """The squared distances of the next leaves to all entries of their position."""
        n, depth = part.shape
        if n == 0:
            return np.zeros((0, self.books.shape[1]), np.int64)
        # new[i, d]: the node at level d above leaf i was not met at the leaf before.
        new = np.ones((n, depth), bool)
        new[1:] = part[1:] != part[:-1]
        new[1:, 0] |= position[1:] != position[:-1]
        if self.last is not None:
            new[0] = part[0] != self.last[1]
            new[0, 0] |= position[0] != self.last[0]
        np.logical_or.accumulate(new, axis=1, out=new)
        above, at = np.zeros((1, self.books.shape[1]), np.int64), np.zeros(n, np.int64)
        path = []
        for d in range(depth):
            first = np.flatnonzero(new[:, d])
            step = part[first, d, None] - self.books[position[first], :, d]
            here = above[at[first]] + step * step
            if not new[0, d]:
                here = np.concatenate([self.path[d][None], here])
            at = np.cumsum(new[:, d]) - int(new[0, d])
            above = here
            path.append(here[-1])
        self.last, self.path = (int(position[-1]), part[-1].copy()), path
        return above[at]


def _to_bytes(part: np.ndarray) -> np.ndarray:
    """Integers as bytes whose order is the order of the numbers."""
    return np.ascontiguousarray((part.astype(np.int64) + _BIAS).astype(">u4"))


def _from_bytes(column: pa.Array, depth: int) -> np.ndarray:
    _, _, data = column.buffers()
    start = column.offset * 4 * depth
    return np.frombuffer(data, ">u4", len(column) * depth, start).astype(np.int64).reshape(-1, depth) - _BIAS


def distinct_parts(rows: DataFrame, vector: str, size: int, parts: int = PARTS, scale: int = SCALE) -> DataFrame:
    """``position, part, n`` for each distinct part, a sorted table. A part is its
    components in four bytes each, ordered as the numbers are."""
    width = size // parts * 4

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data = _to_bytes(scaled(batch.column(0), size, scale, 2))
            n = len(data) * parts
            places = pa.py_buffer(np.arange(n + 1, dtype=np.int32) * np.int32(width))
            part = pa.Array.from_buffers(pa.binary(), n, [None, places, pa.py_buffer(data)])
            yield pa.RecordBatch.from_arrays([pa.array(np.tile(np.arange(parts, dtype=np.int16), len(data))), part], ["position", "part"])

    cuts = rows.select(*quoted([vector])).mapInArrow(cut, "position short, part binary")
    # Counted before it is dealt into ranges, so that a part of very many rows is one row.
    counted = cuts.groupBy("position", "part").agg(F.count(F.lit(1)).alias("n"))
    return staged(counted.repartitionByRange("position", "part").sortWithinPartitions("position", "part"), "parts")


def _sums(parts: DataFrame, books: np.ndarray) -> dict[int, tuple[int, list[int]]]:
    """For each entry in use, numbered over all positions: its rows and the sums of their
    components."""
    _, entries, depth = books.shape

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        way, cells = Walk(books), np.zeros(books.shape, np.int64)
        rows = np.zeros(books.shape[:2], np.int64)
        flat, count = cells.reshape(-1, depth), rows.reshape(-1)
        for batch in batches:
            if not batch.num_rows:
                continue
            position, n = np.asarray(batch.column(0)).astype(np.int64), np.asarray(batch.column(2))
            part = _from_bytes(batch.column(1), depth)
            cell = position * entries + np.argmin(way.leaves(position, part), axis=1)
            order = np.argsort(cell, kind="stable")
            starts = np.flatnonzero(np.diff(cell[order], prepend=-1))
            at = cell[order][starts]
            flat[at] += np.add.reduceat((part * n[:, None])[order], starts, axis=0)
            count[at] += np.add.reduceat(n[order], starts)
        used = np.flatnonzero(count)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(count[used]), pa.array(flat[used].tolist(), pa.list_(pa.int64()))], ["cell", "n", "sums"])

    found = parts.mapInArrow(walk, "cell long, n long, sums array<long>").select("cell", "n", F.posexplode("sums").alias("d", "x"))
    # Sums over all tasks may pass a long; there are as many rows as the codebooks have components.
    total = found.groupBy("cell", "d").agg(F.sum(F.col("n")).alias("n"), F.sum(F.col("x").cast("decimal(38,0)")).alias("x"))
    out: dict[int, tuple[int, list[int]]] = {}
    for r in total.orderBy("cell", "d").collect():
        out.setdefault(r["cell"], (r["n"], []))[1].append(int(r["x"]))
    return out


def learn(rows: DataFrame, id_column: str, vector: str, size: int, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> Codebooks:
    """Codebooks from all rows, which are whole vectors of length ``size``."""
    first = rows.select(*quoted([id_column, vector])).orderBy(F.asc_nulls_last(quoted([id_column])[0]), *quoted([vector])).limit(entries).collect()
    start = scaled(pa.array([r[1] for r in first], pa.list_(pa.float64())), size, scale, 2).astype(np.int64)
    books = np.ascontiguousarray(start.reshape(len(first), parts, size // parts).transpose(1, 0, 2))
    table = distinct_parts(rows, vector, size, parts, scale)
    for _ in range(rounds):
        after = books.copy()
        flat = after.reshape(-1, size // parts)
        for cell, (n, sums) in _sums(table, books).items():
            flat[cell] = [x // n for x in sums]
        if np.array_equal(after, books):
            break  # further rounds change nothing
        books = after
    discard(table)
    return Codebooks(books)


def encode(rows: DataFrame, vector: str, size: int, books: Codebooks, scale: int = SCALE) -> DataFrame:
    """``rows`` with ``code`` (an entry's number for each part, two hex digits each) and
    ``error`` (the squared distances summed). Each task walks the trie of the parts it has
    at a time; nothing is shuffled."""
    parts, _, depth = books.entries.shape
    entries = books.entries
    fields = [f for f in rows.schema.fields if f.name.lower() not in ("code", "error")]
    rows = rows.select(*quoted(f.name for f in fields))
    at = [f.name for f in fields].index(vector)
    digits = np.array([f"{i:02x}" for i in range(entries.shape[1])], "S2")

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for begin in range(0, whole.num_rows, STEP):
                batch = whole.slice(begin, STEP)
                n = batch.num_rows
                data = scaled(batch.column(at), size, scale, 2).astype(np.int64).reshape(n, parts, depth)
                nearest, error = np.empty((n, parts), np.int64), np.zeros(n, np.int64)
                way = Walk(entries)
                for p in range(parts):
                    keys = _to_bytes(data[:, p]).view(f"V{4 * depth}").ravel()
                    _, one, back = np.unique(keys, return_index=True, return_inverse=True)
                    distance = way.leaves(np.full(len(one), p), data[one, p])
                    best = np.argmin(distance, axis=1)
                    nearest[:, p] = best[back]
                    error += distance[np.arange(len(one)), best][back]
                code = np.ascontiguousarray(digits[nearest]).view(f"S{2 * parts}").ravel()
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(code.astype(str)), pa.array(error)], [*batch.schema.names, "code", "error"])

    return rows.mapInArrow(walk, T.StructType([*fields, T.StructField("code", T.StringType()), T.StructField("error", T.LongType())]))


def compress(rows: DataFrame, id_column: str = "vec_id", vector: str = "embedding", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> tuple[DataFrame, Codebooks]:
    """The usable rows with code and error, and the codebooks."""
    bounded_batches(rows.sparkSession)
    size = dimension(rows, vector, parts)
    if not size:
        books = Codebooks(np.zeros((parts, 0, 0), np.int64))
        return rows.where(F.lit(False)).withColumns({"code": F.lit("").cast("string"), "error": F.lit(0).cast("long")}), books
    rows = with_length(rows, vector, size)
    books = learn(rows, id_column, vector, size, parts, entries, rounds, scale)
    return encode(rows, vector, size, books, scale), books


def with_group_error(rows: DataFrame, group: str = "label", name: str = "label_error") -> DataFrame:
    """Add the errors summed over rows of equal ``group``, nulls together. ``rows`` is a
    table, as it is read more than once; a group may hold most rows."""
    key, n = unused([*rows.columns, name], "_group", "_n")
    value = quoted([group])[0]
    rows = rows.drop(*[c for c in rows.columns if c.lower() == name]).withColumn(key, F.struct(value.isNull().alias("none"), value.alias("value")).cast("string"))
    sums = staged(rows.groupBy(key).agg(F.count(F.lit(1)).alias(n), F.sum("error").alias(name)), "groups")
    count, wide = sums.agg(F.count(F.lit(1)), F.sum(F.octet_length(key) + 48)).first()
    if count <= BROADCAST_ROWS and (wide or 0) <= BROADCAST_BYTES:
        return rows.join(F.broadcast(sums), key).drop(key, n)
    return join_by_group(rows, sums, key, n).drop(key, n)
