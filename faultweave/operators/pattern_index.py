"""Matching by a table of patterns of any length.

The table is never collected and stands in no plan. Each literal that a pattern needs is
filed under one run of its characters, twelve of them or, if it is shorter, six or three:
the run that the fewest literals have (an index, ``pattern_index``). A bitmap of all runs
filed tells which runs of a line may be in the index; only with these the line is joined
with it. The patterns found that way are candidates, which are looked at in full: first
whether the line holds the literal, then whether the regex finds it. Of those that do the
least priority wins. Only matches, with all their columns, are shuffled, to bring together
those of one line; and, if the index is not small, lines that have runs in the bitmap.

Runs are counted and marked by hashes, in tables of bounded size: equal hashes of
different runs cost time, but a candidate is always checked by its literal.

Patterns without a literal of three characters cannot be found like this. They are tried on
every line, all in one row that each task gets, in order of priority.

Defined results: as of ``match_lines`` with the patterns in order of ``priority``, equal
priorities by name; ``priority`` is that of the table. A regex, category or severity that is
not valid is an error. Lines without text match nothing.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.enums import CATEGORIES, SEVERITIES
from ..functions.patterns import Pattern, java_form, n_groups, required_literals
from ..functions.timestamps import with_log_time
from .stage import staged

#: Rows and bytes of an index that is broadcast.
MOST_ROWS, MOST_BYTES = 500_000, 64 << 20
#: Characters of a run, for literals of at least as many; each twice the one before.
GRAMS = (3, 6, 12)
#: Counts by hash from which the rarity of runs is read.
SLOTS_LOG2 = 20
#: The bitmap has 2 to the power of so many bits: 32 bits a run within these bounds (64 MB).
BITS_LOG2 = (16, 29)
#: Characters of text handled at a time.
PIECE = 1 << 18
#: Keys by which lines that a pattern without literals matches pass the join.
MARKERS = 1024
U = np.uint64
_BASE = U(0x9E3779B97F4A7C15)
_PLACES = np.array([1, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3], U)
#: What is known of a pattern that matches, in the order in which the least one wins.
_HIT = ("priority", "name", "category_rank", "severity_rank", "n_groups", "regex")
_PREPARED = "priority long, name string, category string, category_rank int, severity string, severity_rank int, causal_weight int, regex string, n_groups int, literals array<string>"


def _windows(texts: pa.Array, sizes: Sequence[int] = GRAMS) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """The runs of ``sizes`` characters, some places at a time: the size, each run's row,
    its place in its row and its hash."""
    texts = pc.fill_null(texts, "")
    points = np.frombuffer("".join(texts.to_pylist()).encode("utf-32-le", "surrogatepass"), np.uint32)
    lengths = pc.utf8_length(texts).to_numpy(zero_copy_only=False).astype(np.int64)
    begin, row = np.cumsum(lengths) - lengths, np.repeat(np.arange(len(lengths)), lengths)
    for a in range(0, len(points), PIECE):
        x = points[a : a + PIECE + GRAMS[-1] - 1].astype(U)
        for n in GRAMS:
            if len(x) < n:
                break
            h = (x[:-2] * _BASE + x[1:-1]) * _BASE + x[2:] if n == GRAMS[0] else h[: -(n // 2)] * _BASE ** U(n // 2) + h[n // 2 :]
            if n in sizes:
                at = np.arange(a, a + min(len(h), PIECE))
                at = at[row[at] == row[at + n - 1]]
                yield n, row[at], at - begin[row[at]], _mixed(h[at - a] + U(n))


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> U(30))) * U(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> U(27))) * U(0x94D049BB133111EB)
    return h ^ (h >> U(31))


def _lists(row: np.ndarray, values: np.ndarray, n: int) -> pa.Array:
    """For each of ``n`` rows its values, each once."""
    order = np.lexsort((values, row))
    row, values = row[order], values[order]
    new = np.ones(len(row), bool)
    new[1:] = (row[1:] != row[:-1]) | (values[1:] != values[:-1])
    row, values = row[new], values[new]
    return pa.ListArray.from_arrays(pa.array(np.searchsorted(row, np.arange(n + 1)).astype(np.int32)), pa.array(values))


def _filed_runs(literals: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Row, size, place and hash of the runs under which literals may be filed: those of
    the largest size that a literal has."""
    size = np.array(GRAMS)[np.searchsorted(GRAMS, pc.utf8_length(literals).to_numpy(zero_copy_only=False), "right") - 1]
    found = [(row[k], np.full(k.sum(), n), place[k], h[k]) for n, row, place, h in _windows(literals) for k in [size[row] == n]]
    return tuple(map(np.concatenate, zip(*found, strict=True)))


def with_literals(table: DataFrame, regex: str = "regex") -> DataFrame:
    """Add ``literals`` to a table of regexes, valid or not."""

    @F.arrow_udf("array<string>")
    def literals(regexes: pa.Array) -> pa.Array:
        return pa.array([None if r is None else list(required_literals(r)) for r in regexes.to_pylist()], pa.list_(pa.string()))

    return table.withColumn("literals", literals(regex))


def prepared(table: DataFrame) -> DataFrame:
    """The table ``priority, name, category, severity, regex`` with what matching needs:
    the regex in Java's spelling, its number of groups, its literals and ranks."""
    categories = list(CATEGORIES)

    def prepare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for r in batch.to_pylist():
                p = Pattern(r["name"], r["category"], r["severity"], r["regex"])
                rows.append((r["priority"], p.name, p.category, categories.index(p.category), p.severity, SEVERITIES.index(p.severity), CATEGORIES[p.category], java_form(p.regex), n_groups(p.regex), list(p.literals)))
            columns = zip(*rows, strict=True) if rows else [[]] * 10
            kinds = [pa.int64(), pa.string(), pa.string(), pa.int32(), pa.string(), pa.int32(), pa.int32(), pa.string(), pa.int32(), pa.list_(pa.string())]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], [c.split()[0] for c in _PREPARED.split(", ")])

    # Reading a regex costs far more than moving it: a table in few files is dealt out.
    return table.select(F.col("priority").cast("long").alias("priority"), "name", "category", "severity", "regex").repartition("name").mapInArrow(prepare, _PREPARED)


def pattern_index(patterns: DataFrame) -> DataFrame:
    """``gram, literal, rule, run`` for each literal of ``prepared`` patterns that have only
    literals of three characters and more; ``run`` is the hash of ``gram``."""
    literals = patterns.where(_is_filed()).select(F.explode("literals").alias("literal"), F.struct(*_HIT).alias("rule"))
    shift = U(64 - SLOTS_LOG2)

    @F.arrow_udf("array<long>")
    def slots(texts: pa.Array) -> pa.Array:
        if not len(texts):
            return pa.array([], pa.list_(pa.int64()))
        row, _, _, h = _filed_runs(texts)
        return _lists(row, (h >> shift).astype(np.int64), len(texts))

    # How many literals have a run of each slot: as many numbers for a table of any length.
    found = literals.select(F.explode(slots("literal")).alias("slot")).groupBy("slot").agg(F.count(F.lit(1)).alias("n")).toArrow()
    counts = np.zeros(1 << SLOTS_LOG2, np.int64)
    counts[found.column("slot").to_numpy()] = found.column("n").to_numpy()
    sent = literals.sparkSession.sparkContext.broadcast(counts)

    @F.arrow_udf("struct<gram:string,run:long>")
    def rarest(texts: pa.Array) -> pa.Array:
        kinds = [pa.string(), pa.int64()]
        if not len(texts):
            return pa.StructArray.from_arrays([pa.array([], k) for k in kinds], ["gram", "run"])
        row, n, place, h = _filed_runs(texts)
        order = np.lexsort((h, sent.value[h >> shift], row))
        first = order[np.unique(row[order], return_index=True)[1]]
        grams = [t[i : i + k] for t, i, k in zip(texts.to_pylist(), place[first].tolist(), n[first].tolist(), strict=True)]
        return pa.StructArray.from_arrays([pa.array(grams, kinds[0]), pa.array(h[first].view(np.int64), kinds[1])], ["gram", "run"])

    return literals.withColumn("filed", rarest("literal")).select("filed.gram", "literal", "rule", "filed.run")


def _bitmap(index: DataFrame) -> np.ndarray:
    """A bitmap in which the places of all runs of the index are marked."""
    least, most = BITS_LOG2
    log2 = min(most, max(least, (32 * index.count()).bit_length()))

    @F.arrow_udf("array<long>")
    def places(runs: pa.Array) -> pa.Array:
        h = runs.to_numpy(zero_copy_only=False).astype(np.int64).view(U)
        at = (h[:, None] * _PLACES >> U(64 - log2)).astype(np.int64) + 1
        return pa.ListArray.from_arrays(pa.array(np.arange(len(h) + 1, dtype=np.int32) * len(_PLACES)), pa.array(at.ravel()))

    place = F.col("place")
    marked = index.select(F.explode(places("run")).alias("place"))
    marked = marked.groupBy(F.bitmap_bucket_number(place).alias("block")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(place)).alias("bits")).toArrow()
    bits = np.zeros((1 << log2) // 8, np.uint8)
    for block, held in zip(marked.column("block").to_pylist(), marked.column("bits"), strict=True):
        at, held = (block - 1) * 4096, np.frombuffer(held.as_buffer(), np.uint8)
        bits[at : at + len(held)] = held[: len(bits) - at]
    return bits


def _marked(bits: np.ndarray, h: np.ndarray) -> np.ndarray:
    """The numbers of the hashes all of whose places are marked."""
    left, shift = np.arange(len(h)), U(64 - (len(bits) * 8).bit_length() + 1)
    for odd in _PLACES:
        place = h[left] * odd >> shift
        left = left[(bits[place >> U(3)] >> (place & U(7)).astype(np.uint8)) & 1 == 1]
    return left


def _is_filed() -> Column:
    return (F.size("literals") > 0) & F.forall("literals", lambda x: F.char_length(x) >= GRAMS[0])


def broadcast_if_small(df: DataFrame, width: Column) -> DataFrame:
    """Marked to be broadcast if a count proves it small; ``width``: bytes of a row."""
    n, size = df.agg(F.count(F.lit(1)), F.sum(width + 64)).first()
    return F.broadcast(df) if n <= MOST_ROWS and (size or 0) <= MOST_BYTES else df.hint("merge")


def match_by_table(lines: DataFrame, table: DataFrame, literal_prefilter: bool = True) -> DataFrame:
    """The matches of ``lines``: their columns and those that ``match_lines`` adds."""
    # Lines differ much in length: a bounded number of bytes goes to Python at a time.
    lines.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", "8m")
    patterns = staged(prepared(table), "patterns")
    filed = _is_filed() if literal_prefilter else F.lit(False)
    # One row, also if there is no pattern.
    rest = patterns.where(~filed).agg(F.sort_array(F.collect_list(F.struct(*_HIT, "literals"))).alias("_rest"))
    low = F.lower("line")

    def holds(p: Column) -> Column:
        found = F.rlike(F.col("line"), p["regex"])
        wanted = (F.size(p["literals"]) == 0) | F.exists(p["literals"], lambda x: F.contains(F.col("_low"), x))
        return wanted & found if literal_prefilter else found

    keep = [f"`{c}`" for c in lines.columns]
    rows = lines.select("*", F.monotonically_increasing_id().alias("_id"), low.alias("_low")).join(F.broadcast(rest))
    # Generators' rows are made once; columns would be worked out again in each of their
    # uses. Their outer forms add no filter, which would be another use.
    first = F.transform(F.array(F.get(F.filter("_rest", holds), F.lit(0))), lambda p: F.when(p.isNotNull(), F.struct(*[p[c].alias(c) for c in _HIT])))
    rows = rows.select(*keep, "_id", "_low", F.explode_outer(first).alias("_free"))
    if literal_prefilter:
        index = staged(pattern_index(patterns), "pattern-index")
        sizes = [r[0] for r in index.select(F.char_length("gram")).distinct().collect()]
        sent = index.sparkSession.sparkContext.broadcast(_bitmap(index))

        @F.arrow_udf("array<long>")
        def runs(texts: pa.Array) -> pa.Array:
            found = [(row[k], h[k].view(np.int64)) for _, row, _, h in _windows(texts, sizes) for k in [_marked(sent.value, h)]]
            row, h = map(np.concatenate, zip(*found, strict=True)) if found else (np.zeros(0, np.int64),) * 2
            return _lists(row, h, len(texts))

        # A line that a pattern without literals matches brings that match as one more row,
        # by one of many keys: no task gets all of them.
        index = index.drop("gram").unionByName(index.sparkSession.range(MARKERS).select(F.col("id").alias("run")), allowMissingColumns=True)
        index = broadcast_if_small(index, F.coalesce(F.octet_length(F.to_json(F.struct(*index.columns))), F.lit(0)))
        marker = F.when(F.col("_free").isNull(), F.array().cast("array<long>")).otherwise(F.array(F.col("_id") % MARKERS))
        found = rows.select(*keep, "_id", "_free", runs("_low").alias("_runs"))
        found = found.select(*keep, "_id", "_free", F.explode_outer(F.concat(marker, "_runs")).alias("run")).join(index, "run")
        # The regex of a candidate is not looked at before its literal has been found.
        hit = F.when(F.col("literal").isNull(), F.col("_free").isNotNull()).when(F.contains(low, "literal"), F.rlike("line", F.col("rule.regex")))
        found = found.where(hit).select(*keep, "_id", F.when(F.col("literal").isNull(), F.col("_free")).otherwise(F.col("rule")).alias("_hit"))
        whole = F.struct(*keep)
        found = found.groupBy("_id").agg(F.min("_hit").alias("_hit"), F.any_value(whole).alias("_line")).select("_line.*", "_hit")
    else:
        found = rows.where(F.col("_free").isNotNull()).select(*keep, F.col("_free").alias("_hit"))

    def named(rank: str, names: Sequence) -> Column:
        return F.get(F.array(*map(F.lit, names)), F.col(f"_hit.{rank}"))

    about = {
        "priority": F.col("_hit.priority"),
        "pattern": F.col("_hit.name"),
        "category": named("category_rank", list(CATEGORIES)),
        "category_rank": F.col("_hit.category_rank"),
        "severity": named("severity_rank", SEVERITIES),
        "severity_rank": F.col("_hit.severity_rank"),
        "causal_weight": named("category_rank", list(CATEGORIES.values())),
    }
    n, regex = F.col("_hit.n_groups"), F.col("_hit.regex")
    groups = F.when(n > 0, F.transform(F.sequence(F.lit(1), n), lambda g: F.call_function("regexp_extract", F.col("line"), regex, g)))
    return with_log_time(found.withColumns({**about, "submatch": groups}).drop("_hit"))
