"""Near duplicates by SimHash fingerprints of 64 bits.

Texts are lower-cased (A-Z), cut into words at white space, and each run of ``shingle``
words is hashed (XXH64); a bit of the fingerprint is set if it is set in more than half the
hashes, repeats included. Fingerprints that differ in at most ``RADIUS`` bits are linked,
and documents whose fingerprints are linked, or are the same, form components.

Only distinct fingerprints are compared. Two that differ in at most two bits agree in at
least two of four pieces of 16 bits, so each is dealt to six buckets, by two pieces each:
no link is lost, and no pairs are made outside a bucket. A bucket of more than ``BLOCK``
fingerprints is dealt into blocks, and its blocks meet in pairs, so no task holds it whole.

A task compares what it has bit-sliced (``Planes``): plane ``b`` holds bit ``b`` of 64
fingerprints in each machine word. For a word and one fingerprint the differing bits are
added up plane by plane in two carry-save bits, for 64 distances at once, and a word is left
as soon as all its distances have passed the radius. Of the links found in a bucket those of
a spanning forest go on, which connect the same fingerprints.

Defined results: fewer words than a shingle are one shingle; no words, an empty or a null
text have fingerprint zero, linked like any other. Rows that repeat are rows of their own.
A component's number is its smallest id; null where all its ids are null. Columns other than
id and text are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.stage import discard
from .common import bounded_batches, join_by_group, quoted, staged
from .components import components
from .words import buffers

SHINGLE = 3
SEED = 42
#: Bits. Two pieces of four agree at this distance; the two carry bits count to three.
RADIUS = 2
#: Fingerprints of a bucket that meet in one task.
BLOCK = 4096
#: Bytes of a text that are cut into words at a time, hashes whose bits are counted at a
#: time, and pairs of a fingerprint and a word of others that are compared at a time.
PIECE, HASHES, PAIRS = 1 << 20, 1 << 16, 1 << 15
U = np.uint64
_ONE, _ALL = U(1), U(0xFFFFFFFFFFFFFFFF)
_SPACE = re.compile(rb"[\x20\x09-\x0D]")
_CUTS = [(i, j) for i in range(4) for j in range(i)]


def _shingles(text: bytes, n: int = SHINGLE) -> Iterator[list[int]]:
    """Hashes of a text's shingles, piece by piece."""
    before: list[bytes] = []
    any_yet, begin = False, 0
    while begin < len(text) or begin == 0:
        space = _SPACE.search(text, begin + PIECE)
        end = space.start() if space else len(text)
        words = before + text[begin:end].lower().split()
        begin = end + 1
        if len(words) >= n:
            joined = b" ".join(words)
            ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
            starts = np.concatenate([[0], ends[:-1]])
            any_yet = True
            yield [xxhash.xxh64_intdigest(joined[s:e], SEED) for s, e in zip(starts[: len(words) - n + 1].tolist(), (ends[n - 1 :] - 1).tolist(), strict=True)]
            before = words[len(words) - n + 1 :]
        else:
            before = words
    if before and not any_yet:
        yield [xxhash.xxh64_intdigest(b" ".join(before), SEED)]


def _bits(values: np.ndarray) -> np.ndarray:
    """A row of 64 bits for each value, the lowest first."""
    return np.unpackbits(values.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")


class _Counter:
    """Counts the hashes of texts and their bits."""

    def __init__(self, n: int) -> None:
        self.n, self.set = np.zeros(n, np.int64), np.zeros((n, 64), np.int64)
        self.waiting: list[int] = []
        self.of: list[tuple[int, int]] = []

    def add(self, i: int, hashes: list[int]) -> None:
        for k in range(0, len(hashes), HASHES):
            part = hashes[k : k + HASHES]
            self.waiting += part
            self.of.append((i, len(part)))
            if len(self.waiting) >= HASHES:
                self.flush()

    def flush(self) -> None:
        if self.waiting:
            texts, sizes = (np.array(x, np.int64) for x in zip(*self.of, strict=True))
            starts = np.cumsum(sizes) - sizes
            np.add.at(self.n, texts, sizes)
            np.add.at(self.set, texts, np.add.reduceat(_bits(np.array(self.waiting, U)), starts, axis=0, dtype=np.int64))
        self.waiting, self.of = [], []

    def fingerprints(self) -> np.ndarray:
        self.flush()
        return np.packbits(self.set * 2 > self.n[:, None], axis=1, bitorder="little").view("<u8").ravel()


def fingerprints(docs: DataFrame, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """``id, fp`` (the 64 bits as a long) for each row."""
    bounded_batches(docs.sparkSession)
    kind = docs.schema[id_column].dataType.simpleString()

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = buffers(batch.column(1))
            count = _Counter(batch.num_rows)
            for i in range(batch.num_rows):
                for hashes in _shingles(data[offsets[i] : offsets[i + 1]].tobytes()):
                    count.add(i, hashes)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(count.fingerprints().view(np.int64))], ["id", "fp"])

    return docs.select(*quoted([id_column, text])).mapInArrow(read, f"id {kind}, fp long")


class Planes:
    """Fingerprints as bit planes: word ``w`` of plane ``b`` has bit ``b`` of the
    fingerprints from ``64 * w`` on."""

    def __init__(self, values: np.ndarray) -> None:
        self.values = values
        padded = np.zeros(-(-len(values) // 64) * 64, U)
        padded[: len(values)] = values
        self.planes = np.ascontiguousarray(np.packbits(_bits(padded).T, axis=1, bitorder="little")).view("<u8")

    def near(self, low: np.ndarray, high: np.ndarray, order: np.ndarray, radius: int = RADIUS) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Places ``i, j`` of fingerprints at most ``radius`` apart, where ``i`` is compared
        with those from ``low[i]`` to before ``high[i]``. ``order``: the planes in the order
        they are added up; planes left out are known to be equal."""
        if not 0 <= radius <= 2:
            raise ValueError("two carry bits tell distances of up to two from larger ones")
        first, words = low >> 6, np.where(high > low, ((high - 1) >> 6) - (low >> 6) + 1, 0)
        upto = np.cumsum(words)
        for begin in range(0, int(upto[-1]) if len(upto) else 0, PAIRS):
            pair = np.arange(begin, min(begin + PAIRS, int(upto[-1])))
            i = np.searchsorted(upto, pair, "right")
            w = first[i] + pair - (upto[i] - words[i])
            a, b = np.maximum(low[i] - 64 * w, 0).astype(U), np.minimum(high[i] - 64 * w, 64).astype(U)
            yield from self._sums(i, w, (_ALL << a) & (_ALL >> (U(64) - b)), order, radius)

    def _sums(self, i: np.ndarray, w: np.ndarray, open_: np.ndarray, order: np.ndarray, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        own = self.values[i]
        ones, twos = np.zeros(len(i), U), np.zeros(len(i), U)
        for turn, b in enumerate(order, 1):
            differs = self.planes[b][w] ^ (U(0) - ((own >> U(b)) & _ONE))
            carry = ones & differs
            ones ^= differs
            open_ &= ~(twos & carry)  # four
            twos |= carry
            if turn % 4 == 0 or turn == len(order):
                past = (twos & ones, twos, twos | ones)[2 - radius]
                alive = (open_ & ~past) != 0
                if not alive.all():
                    i, w, own, open_, ones, twos, past = (x[alive] for x in (i, w, own, open_, ones, twos, past))
                    if not len(i):
                        return
        lanes = np.unpackbits((open_ & ~past).astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        pair, lane = np.nonzero(lanes)
        yield i[pair], w[pair] * 64 + lane


def _join(root: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Roots after linking ``a`` and ``b``: the smallest place of each component."""
    while True:
        x, y = root[a], root[b]
        apart = x != y
        if not apart.any():
            return root
        np.minimum.at(root, np.maximum(x, y)[apart], np.minimum(x, y)[apart])
        while not np.array_equal(up := root[root], root):
            root = up


def _forest(cut: int, group: np.ndarray, side: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links that connect what is near in each group. Rows are in order of group and side;
    where a group has two sides, only rows of different sides are compared."""
    n = len(values)
    starts = np.flatnonzero(np.diff(group, prepend=group[0] - 1))
    begin = np.repeat(starts, np.diff(np.append(starts, n)))
    crossing = np.repeat(np.add.reduceat(side, starts), np.diff(np.append(starts, n))) > 0
    second = np.repeat(np.add.reduceat(1 - side, starts), np.diff(np.append(starts, n)))
    high = np.where(side == 1, begin + second, np.where(crossing, begin, np.arange(n)))
    order = np.array([b for b in range(64) if b // 16 not in _CUTS[cut]])
    root = np.arange(n)
    for a, b in Planes(values).near(begin, high, order):
        root = _join(root, a, b)
    at = np.flatnonzero(root != np.arange(n))
    return values[at], values[root[at]]


def _buckets(fp: Column) -> Column:
    pieces = [F.shiftrightunsigned(fp, 16 * i).bitwiseAND(0xFFFF) for i in range(4)]
    return F.array(*[F.struct(F.lit(c).alias("cut"), F.shiftleft(pieces[i], 16).bitwiseOR(pieces[j]).alias("bits")) for c, (i, j) in enumerate(_CUTS)])


def links(distinct: DataFrame, block: int = BLOCK) -> DataFrame:
    """``a, b``: links between the distinct fingerprints ``fp`` (a table) that connect all
    that are near."""
    dealt = distinct.select("fp", F.explode(_buckets(F.col("fp"))).alias("k")).select("fp", F.shiftleft("k.bits", 3).bitwiseOR(F.col("k.cut").cast("long")).alias("key"))
    counts = staged(dealt.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "buckets")
    rows = join_by_group(dealt, counts, "key", "n", how="inner")
    n_blocks = F.ceil(F.col("n") / block).cast("int")
    rows = rows.withColumn("own", F.pmod(F.xxhash64("fp"), n_blocks).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), n_blocks - 1)))
    rows = rows.select("key", F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"), (F.col("own") > F.col("other")).cast("int").alias("side"), "fp")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def forest(rows: pa.Table) -> Iterator[pa.RecordBatch]:
            key, low, high, side, fp = (np.asarray(rows.column(c)) for c in range(5))
            new = np.ones(len(key), bool)
            new[1:] = (key[1:] != key[:-1]) | (low[1:] != low[:-1]) | (high[1:] != high[:-1])
            group = np.cumsum(new)
            for cut in range(len(_CUTS)):
                mine = np.flatnonzero((key & 7) == cut)
                if len(mine):
                    a, b = _forest(cut, group[mine], side[mine].astype(np.int64), fp[mine].view(U))
                    yield pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], ["a", "b"])

        held: list[pa.RecordBatch] = []
        n = 0
        for batch in batches:
            held.append(batch)
            n += batch.num_rows
            if n >= 4 * block:
                # What has come so far but for the last group, which may go on.
                rows = pa.Table.from_batches(held)
                last = [rows.column(c)[n - 1].as_py() for c in range(3)]
                same = np.logical_and.reduce([np.asarray(rows.column(c)) == last[c] for c in range(3)])
                whole = int(np.argmax(same))
                yield from forest(rows.slice(0, whole)) if whole else ()
                held = rows.slice(whole).to_batches()
                n -= whole
        if n:
            yield from forest(pa.Table.from_batches(held))

    together = rows.repartition("key", "low", "high").sortWithinPartitions("key", "low", "high", "side", "fp")
    return together.mapInArrow(compare, "a long, b long").distinct()


def near_duplicates(docs: DataFrame, id_column: str = "doc_id", text: str = "text", block: int = BLOCK) -> DataFrame:
    """For each document ``id_column``, ``fingerprint`` (16 hex digits) and
    ``component_id``."""
    found = staged(fingerprints(docs, id_column, text), "fingerprints")
    distinct = staged(found.groupBy("fp").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("least")), "distinct")
    edges = staged(links(distinct, block), "links")
    joined = components(edges)
    linked = staged(distinct.join(joined, distinct["fp"] == joined["node"], "left").select("fp", "n", "least", F.coalesce("component", "fp").alias("component")), "linked")
    least = staged(linked.groupBy("component").agg(F.min("least").alias("component_id"), F.count(F.lit(1)).alias("m")).where("m > 1"), "least")
    many = join_by_group(linked, least, "component", "m", how="left")
    ids = staged(many.select("fp", "n", F.when(F.col("m").isNull(), F.col("least")).otherwise(F.col("component_id")).alias("component_id")), "ids")
    discard(edges, linked, least)
    out = join_by_group(found, ids, "fp", "n", how="inner")
    return out.select(F.col("id").alias(id_column), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
