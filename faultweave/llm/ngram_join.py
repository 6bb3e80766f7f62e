"""N-gram Jaccard self-join of documents by MinHash banding.

A document is the set of its runs of ``n`` words, case folded; one with fewer words is
the set of its whole word sequence. Documents with equal sets form one class at once, and
only classes are compared. Band and row counts are the cheapest that find a pair at the
threshold with the target recall. Classes that share a band are candidates: they are tied
to their band's smallest member, and the connected groups are compared inside. A group is
cut into blocks of bounded size, so that classes with one smallest member stay together,
and every pair of blocks in which some band meets is one task: a large group spreads over
many tasks, blocks of a loose group that share nothing are not compared, and no pair
becomes a row. A task compares full n-gram sets, of all pairs that share a band and may
reach the threshold by size; it returns each class's number of links and links enough to
keep the linked together.

Defined results: a null or empty text, and one without words, is the empty set; such
documents equal each other (similarity 1) and nothing else. Rows with equal id and text
are rows of one class. Rows without an id count as documents; a class's id is its
smallest id, or null. Extra columns do not matter; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.stage import discard
from .common import join_by_group, quoted, row_key, small_side, staged, with_row_key
from .components import components
from .words import U, Words, buffers, chunks, mix, ngrams, scan

N = 5
THRESHOLD = 0.8
RECALL = 0.9995
#: Classes, and n-grams of all of them, that a block holds at most (a single longer
#: document is a block alone).
BLOCK_ROWS = 400
BLOCK_GRAMS = 400_000


def banding(threshold: float, recall: float, least_rows: int = 5) -> tuple[int, int]:
    """``(bands, rows)``: of those that find a pair at ``threshold`` with probability
    ``recall``, the one with the fewest hashes. Fewer rows find more unlike pairs."""
    options = [(int(np.ceil(np.log(1 - recall) / np.log(1 - threshold**r))), r) for r in range(least_rows, 17)]
    return min(options, key=lambda o: o[0] * o[1])


def gram_sets(w: Words, n: int = N) -> Iterator[np.ndarray]:
    """The distinct n-grams of each text, sorted."""
    grams = ngrams(w.hash, n)
    for i in range(len(w)):
        a, b = int(w.first[i]), int(w.first[i + 1])
        if b - a >= n:
            yield np.unique(grams[a : b - n + 1])
        else:
            yield ngrams(w.hash[a:b], b - a) if b > a else np.zeros(0, U)


class MinHash:
    def __init__(self, bands: int, rows: int, seed: int = 1) -> None:
        self.bands, self.rows = bands, rows
        draws = mix(np.arange(1, 2 * bands * rows + 1, dtype=U) + U(seed << 32))
        self.times, self.plus = (draws[::2] | U(1))[:, None], draws[1::2][:, None]

    def band_hashes(self, grams: np.ndarray) -> np.ndarray:
        """One value for each band; empty sets get none."""
        low = np.full(len(self.times), ~U(0))
        for i in range(0, len(grams), 2048):
            low = np.minimum(low, (grams[None, i : i + 2048] * self.times + self.plus).min(1))
        out = np.zeros(self.bands, U)
        for r in range(self.rows):
            out = mix(out * U(0x9E3779B97F4A7C15) + low[r :: self.rows])
        return mix(out + np.arange(self.bands, dtype=U))


def set_key(grams: np.ndarray) -> bytes:
    """128 bits that equal sets share."""
    if not len(grams):
        return bytes(16)
    return np.array([mix(grams.copy()).sum(dtype=U), mix(grams ^ U(0x5EED)).sum(dtype=U) + U(len(grams))], U).tobytes()


SIGNED = "row struct<a:long,b:long>, doc_id long, key binary, n int, bands binary"


def signatures(docs: DataFrame, bands: int, rows: int, n: int = N) -> DataFrame:
    """For each row its key, id, set key, set size and band hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        minhash = MinHash(bands, rows)
        for batch in batches:
            data, offsets = buffers(batch.column(2))
            keys, sizes, hashes = [], [], []
            for i, j in chunks(offsets):
                for grams in gram_sets(scan(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]), n):
                    keys.append(set_key(grams))
                    sizes.append(len(grams))
                    hashes.append(minhash.band_hashes(grams).tobytes() if len(grams) else b"")
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(keys, pa.binary()), pa.array(sizes, pa.int32()), pa.array(hashes, pa.binary())], ["row", "doc_id", "key", "n", "bands"])

    return docs.select(row_key().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.lower("text").alias("text")).mapInArrow(run, SIGNED)


def alike(both, a, b, threshold: float):
    """Whether ``both`` common ones of ``a`` and ``b`` reach the Jaccard threshold."""
    return both >= threshold * (a + b - both) - 1e-9


def shared_counts(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of all left with all right sets. N-grams that only one
    side holds are left out; the others are taken some columns at a time."""
    l_all, r_all = np.concatenate(left), np.concatenate(right)
    vocabulary = np.intersect1d(l_all, r_all)
    out = np.zeros((len(left), len(right)), np.float32)

    def placed(sets: list[np.ndarray], flat: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
        at = np.searchsorted(vocabulary, flat)
        at[at == len(vocabulary)] = 0
        fine = vocabulary[at] == flat if len(vocabulary) else np.zeros(len(flat), bool)
        order = np.argsort(at[fine], kind="stable")
        return at[fine][order], owner[fine][order]

    (lv, lo), (rv, ro) = placed(left, l_all), placed(right, r_all)
    step = 4096
    for v in range(0, len(vocabulary), step):
        x, y = np.zeros((len(left), step), np.float32), np.zeros((len(right), step), np.float32)
        a, b = np.searchsorted(lv, (v, v + step))
        x[lo[a:b], lv[a:b] - v] = 1
        a, b = np.searchsorted(rv, (v, v + step))
        y[ro[a:b], rv[a:b] - v] = 1
        out += x @ y.T
    return out


def linked(left: list[np.ndarray], right: list[np.ndarray], left_bands: np.ndarray, right_bands: np.ndarray, threshold: float) -> np.ndarray:
    """Which pairs share a band and have the similarity."""
    near = np.zeros((len(left), len(right)), bool)
    for k in range(left_bands.shape[1]):
        near |= left_bands[:, k, None] == right_bands[None, :, k]
    a, b = np.array([len(s) for s in left], np.float64)[:, None], np.array([len(s) for s in right], np.float64)[None, :]
    near &= alike(np.minimum(a, b), a, b, threshold)
    if near.sum() > 2000:
        return near & alike(shared_counts(left, right).astype(np.float64), a, b, threshold)
    for i, j in zip(*np.nonzero(near), strict=True):
        near[i, j] = alike(len(np.intersect1d(left[i], right[j], assume_unique=True)), len(left[i]), len(right[j]), threshold)
    return near


def joined(hit: np.ndarray, left: np.ndarray, right: np.ndarray) -> Iterator[tuple[int, int]]:
    """For each id with a link the smallest id that links lead to, where another."""
    up, across = left.copy(), right.copy()
    top = np.iinfo(np.int64).max
    while True:
        u = np.minimum(up, np.where(hit, across[None, :], top).min(1, initial=top))
        v = np.minimum(across, np.where(hit, u[:, None], top).min(0, initial=top))
        if (u == up).all() and (v == across).all():
            break
        up, across = u, v
    for ids, least in ((left, up), (right, across)):
        yield from ((int(x), int(y)) for x, y in zip(ids, least, strict=True) if x != y)


LINKS = "a long, b long, sets long, docs long"


def spread(classes: DataFrame, *keep: str) -> DataFrame:
    """``band, value`` of each class, a row for each band, with the columns in ``keep``."""
    values = F.transform(F.sequence(F.lit(0), (F.octet_length("bands") / 8 - 1).cast("int")), lambda i: F.xxhash64(F.substring(F.col("bands"), i * 8 + 1, F.lit(8))))
    return classes.select(*keep, F.posexplode(values).alias("band", "value"))


def blocks(groups: DataFrame, classes: DataFrame, candidates: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The classes in groups with their ``block`` (null where the group is one block), and
    the pairs of blocks ``component, block, one, two`` that a block takes part in."""
    size = F.ceil(F.greatest(F.count(F.lit(1)) / BLOCK_ROWS, F.sum("n") / BLOCK_GRAMS)).cast("int")
    homes = candidates.groupBy(F.col("a").alias("class")).agg(F.min("b").alias("home"))
    members = groups.join(classes.select("class", "key", "copies", "n", "bands"), "class").join(homes, "class", "left")
    members = staged(members.withColumn("home", F.coalesce("home", "class")), "members")
    large = members.groupBy("component").agg(size.alias("parts")).where("parts > 1")
    near = members.groupBy("component", "home").agg(size.alias("home_parts")).where("home_parts > 1")
    placed = members.join(small_side(staged(large, "large")), "component", "left").join(small_side(staged(near, "near")), ["component", "home"], "left")
    block = F.when(F.col("home_parts").isNotNull(), F.xxhash64("home", F.pmod(F.xxhash64("class"), "home_parts"))).otherwise(F.pmod(F.xxhash64("home"), "parts"))
    placed = staged(placed.select("component", "class", "key", "copies", "bands", F.when(F.col("parts").isNotNull(), block).alias("block")), "blocks")
    discard(members)
    at = spread(placed.where("block is not null"), "component", "block").distinct()
    two = at.select("component", F.col("block").alias("other"), "band", "value")
    pairs = at.join(two, ["component", "band", "value"]).select("component", F.least("block", "other").alias("one"), F.greatest("block", "other").alias("two")).distinct()
    pairs = staged(pairs, "block-pairs")
    both = pairs.select("component", F.col("one").alias("block"), "one", "two").unionByName(pairs.where("one != two").select("component", F.col("two").alias("block"), "one", "two"))
    return placed, both


def verify(members: DataFrame, pairs: DataFrame, threshold: float) -> DataFrame:
    """Rows ``(a, null, sets, docs)``: linked classes and documents of class ``a`` in a
    task; rows ``(a, b, 0, 0)``: links that keep the linked together.

    ``members`` has ``component, block, class, copies, grams, bands``; a block goes to all
    ``pairs`` that it takes part in. A group that is one block is one task.
    """
    tasks = members.join(small_side(pairs), ["component", "block"], "left")
    tasks = tasks.withColumns({c: F.coalesce(c, F.lit(0).cast("long")) for c in ("block", "one", "two")})

    def compare(table: pa.Table) -> pa.Table:
        one, two = table.column("one")[0].as_py(), table.column("two")[0].as_py()
        block, ids = table.column("block").to_numpy(), table.column("class").to_numpy()
        copies = table.column("copies").to_numpy()
        sets = [np.frombuffer(g, U) for g in table.column("grams").to_pylist()]
        bands = np.array([np.frombuffer(b, U) for b in table.column("bands").to_pylist()])
        left, right = np.flatnonzero(block == one), np.flatnonzero(block == two)
        rows: list[tuple] = []
        if len(left) and len(right):
            hit = linked([sets[i] for i in left], [sets[i] for i in right], bands[left], bands[right], threshold)
            if one == two:
                np.fill_diagonal(hit, False)
            rows += [(a, b, 0, 0) for a, b in set(joined(hit, ids[left], ids[right]))]
            for own, h, other in [(left, hit, right)] if one == two else [(left, hit, right), (right, hit.T, left)]:
                rows += [(int(ids[i]), None, int(x), int(y)) for i, x, y in zip(own, h.sum(1), h @ copies[other], strict=True) if x]
        columns = list(zip(*rows, strict=True)) if rows else [[]] * 4
        return pa.table({name: pa.array(c, pa.int64()) for name, c in zip(("a", "b", "sets", "docs"), columns, strict=True)})

    return tasks.groupBy("component", "one", "two").applyInArrow(compare, LINKS)


def near_duplicates(docs: DataFrame, n: int = N, threshold: float = THRESHOLD, recall: float = RECALL) -> DataFrame:
    """``row, doc_id, class, class_id, n_links, n_linked_texts, n_grams`` for each row of
    ``docs``: the id of its class (the smallest document id that links lead to), the number
    of other documents it is linked with, and of other n-gram sets. ``class`` is a number
    that names the class even if no document of it has an id."""
    bands, rows = banding(threshold, recall)
    signed = staged(signatures(docs, bands, rows, n), "signatures")
    # A class is named by a number of its own, drawn from its key: ids may repeat or be null.
    # The row with the least key speaks for it.
    classes = signed.groupBy("key").agg(F.min("doc_id").alias("least_id"), F.count(F.lit(1)).alias("copies"), F.min("bands").alias("bands"), F.first("n").alias("n"), F.min("row").alias("speaker"))
    classes = staged(classes.withColumn("class", F.xxhash64("key")), "classes")
    values = spread(classes.where("n > 0"), "class")
    hubs = values.groupBy("band", "value").agg(F.min("class").alias("hub"), F.count(F.lit(1)).alias("members")).where("members > 1").drop("members")
    candidates = staged(values.join(hubs, ["band", "value"]).where(F.col("class") != F.col("hub")).select(F.col("class").alias("a"), F.col("hub").alias("b")).distinct(), "candidates")
    members, pairs = blocks(components(candidates).withColumnRenamed("node", "class"), classes, candidates)
    # Full n-gram sets, of one row for each class in a group.
    wanted = members.join(classes.select("class", "speaker"), "class").select(F.col("speaker.a").alias("ra"), F.col("speaker.b").alias("rb"), "component", "block", "class", "copies", "bands")
    wanted = staged(wanted, "wanted")
    discard(candidates, members)
    texts = docs.select(row_key().alias("k"), F.lower("text").alias("text")).select(F.col("k.a").alias("ra"), F.col("k.b").alias("rb"), "text")
    full = texts.join(small_side(wanted), ["ra", "rb"])
    if repeated_rows(signed).limit(1).count():
        full = full.dropDuplicates(["ra", "rb"])
    links = staged(verify(_with_sets(full, n), pairs, threshold), "links")
    discard(wanted)
    counts = links.where("b is null").groupBy("a").agg(F.sum("sets").alias("sets"), F.sum("docs").alias("docs")).withColumnRenamed("a", "class")
    joined = components(links.where("b is not null").select("a", "b")).withColumnRenamed("node", "class")
    named = classes.select("class", "key", "least_id", "copies").join(joined, "class", "left").withColumn("component", F.coalesce("component", "class")).join(counts, "class", "left")
    named = staged(named, "classes-linked")
    discard(links, classes)
    heads = named.groupBy("component").agg(F.min("least_id").alias("class_id"))
    facts = named.join(heads, "component").select("key", F.col("component").alias("class"), "class_id", (F.coalesce("docs", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("sets", F.lit(0)).alias("n_linked_texts"), "copies")
    facts = staged(facts, "facts")
    discard(named)
    return join_by_group(signed.select("row", "doc_id", "key", "n"), facts, "key", "copies", "inner").select("row", "doc_id", "class", "class_id", "n_links", "n_linked_texts", F.col("n").alias("n_grams"))


def _with_sets(rows: DataFrame, n: int) -> DataFrame:
    """Members with their full n-gram sets."""
    names = ["component", "block", "class", "copies", "bands"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = buffers(batch.column("text"))
            for i, j in chunks(offsets):
                w = scan(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                grams = pa.array([g.tobytes() for g in gram_sets(w, n)], pa.binary())
                part = batch.slice(i, j - i)
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in names), grams], [*names, "grams"])

    schema = "component long, block long, class long, copies long, bands binary, grams binary"
    return rows.select("text", *names).mapInArrow(run, schema)


def repeated_rows(found: DataFrame) -> DataFrame:
    """Row keys that more than one row has."""
    return found.groupBy("row").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("row")


def keep_one(docs: DataFrame, found: DataFrame) -> DataFrame:
    """``docs`` with one document of each class of ``near_duplicates``: that with the
    smallest id. Only keys of rows that go travel; rows that repeat it go too."""
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row")
    heads = staged(found.groupBy("class").agg(F.min(order).alias("head"), F.count(F.lit(1)).alias("members")).where("members > 1"), "heads")
    gone = join_by_group(found.select("row", "class"), heads, "class", "members", "inner").where(F.col("row") != F.col("head.row"))
    keyed, (a, b) = with_row_key(docs)
    gone = staged(gone.select(F.col("row.a").alias(a), F.col("row.b").alias(b)).distinct(), "gone")
    kept = keyed.join(small_side(gone), [a, b], "left_anti")
    again = staged(repeated_rows(found).select(F.col("row.a").alias(a), F.col("row.b").alias(b)), "repeated")
    if again.limit(1).count():
        again = small_side(again)
        once = kept.join(again, [a, b], "left_semi").dropDuplicates([a, b])
        kept = kept.join(again, [a, b], "left_anti").unionByName(once)
    return kept.select(*quoted(docs.columns))
