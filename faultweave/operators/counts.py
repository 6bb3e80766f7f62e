"""Counts of lines and matches, by category and severity."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..functions.enums import CATEGORIES, SEVERITIES, category_rank, severity_rank
from ..functions.patterns import DEFAULT_PATTERNS, Pattern
from .match import matches_of, with_pattern
from .stage import staged

#: The counts of ``counted_matches``: by kind and name.
Counts = dict[tuple[str, str], int]


def counted_matches(lines: DataFrame, patterns: Sequence[Pattern] = DEFAULT_PATTERNS, literal_prefilter: bool = True) -> tuple[DataFrame, Counts]:
    """The matches as a table, and the counts of ``result_summary``, which are taken while
    the table is written: lines are read and classified once. The metrics sit in the stage
    that writes, whose tasks count once each however often they are tried."""
    names = [("lines", "all"), ("matches", "all"), *(("category", c) for c in CATEGORIES), *(("severity", s) for s in SEVERITIES)]
    sums = [F.count(F.lit(1)), F.count("pattern"), *(F.count_if(F.col(kind) == name) for kind, name in names[2:])]
    seen = Observation()
    classified = with_pattern(lines, patterns, literal_prefilter).observe(seen, *[c.alias(f"n{i}") for i, c in enumerate(sums)])
    table = staged(matches_of(classified, patterns), "matches")
    found = seen.get
    return table, {name: found.get(f"n{i}", 0) for i, name in enumerate(names)}


def summary_rows(spark: SparkSession, counts: Counts) -> DataFrame:
    """``result_summary`` of counts that are known."""
    rows = [(kind, name, n) for (kind, name), n in counts.items() if n or name == "all"]
    return spark.createDataFrame(rows, "kind string, name string, n long")


def counts_by(classified: DataFrame, column: str) -> DataFrame:
    """Matches by ``category`` (enum order) or ``severity`` (greatest first); none, no row."""
    out = classified.where(F.col(column).isNotNull()).groupBy(column).agg(F.count(F.lit(1)).alias("n"))
    rank = category_rank if column == "category" else lambda c: -severity_rank(c)
    return out.orderBy(rank(F.col(column)))


def result_summary(classified: DataFrame) -> DataFrame:
    """``kind, name, n``: lines, matches, and matches by category and severity, in one
    pass over the classified lines."""
    sets = classified.groupingSets([["category"], ["severity"], []], "category", "severity").agg(F.count(F.lit(1)).alias("lines"), F.count("pattern").alias("matches"), F.grouping_id().alias("g"))
    # grouping_id: the bit of a column that is summed over is set.
    one = F.explode(
        F.when(F.col("g") == 3, F.array(_row("lines", F.lit("all"), F.col("lines")), _row("matches", F.lit("all"), F.col("matches"))))
        .when((F.col("g") == 1) & F.col("category").isNotNull(), F.array(_row("category", F.col("category"), F.col("matches"))))
        .when((F.col("g") == 2) & F.col("severity").isNotNull(), F.array(_row("severity", F.col("severity"), F.col("matches"))))
    )
    return sets.select(one.alias("r")).select("r.kind", "r.name", "r.n")


def _row(kind: str, name, n):
    return F.struct(F.lit(kind).alias("kind"), name.alias("name"), n.cast("long").alias("n"))


def sources_of(lines: DataFrame) -> DataFrame:
    """The sources that have lines, in one sorted array."""
    return lines.select("source").distinct().agg(F.sort_array(F.collect_set("source")).alias("sources"))
