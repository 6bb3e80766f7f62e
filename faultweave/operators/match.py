"""Classification of log lines by the first of an ordered list of failure patterns."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.enums import CATEGORIES, SEVERITIES
from ..functions.patterns import DEFAULT_PATTERNS, Pattern, java_form
from ..functions.timestamps import with_log_time


def _contains_any(low: Column, literals: Sequence[str]) -> Column:
    return reduce(or_, [F.contains(low, F.lit(x)) for x in literals])


def _screen(patterns: Sequence[Pattern]) -> list[str]:
    """Literals such that every line any pattern wants contains one; those that contain a
    shorter one add nothing."""
    every = {x for p in patterns for x in p.literals}
    return sorted(x for x in every if not any(y != x and y in x for y in every))


def first_match(line: Column, low: Column, patterns: Sequence[Pattern], literal_prefilter: bool = True) -> Column:
    """The number of the first pattern that finds the line, or null. ``low`` is the line
    in lower case. Without ``literal_prefilter`` the regexes alone decide."""
    if not patterns:
        return F.lit(None).cast("int")

    # The regexes stand in a lambda, which is not compiled: their code would be larger
    # than a Java method may be, and their own matching takes the time anyway.
    def tried(x: Column) -> Column:
        chain = None
        for i, p in enumerate(patterns):
            hit = F.rlike(x["line"], F.lit(java_form(p.regex)))
            if literal_prefilter and p.literals:
                hit = _contains_any(x["low"], p.literals) & hit
            chain = F.when(hit, i) if chain is None else chain.when(hit, i)
        return chain

    found = F.get(F.transform(F.array(F.struct(line.alias("line"), low.alias("low"))), tried), F.lit(0))
    if literal_prefilter and all(p.literals for p in patterns):
        # Most lines hold no literal at all: they leave after one look.
        return F.when(_contains_any(low, _screen(patterns)), found)
    return found


def with_pattern(lines: DataFrame, patterns: Sequence[Pattern] = DEFAULT_PATTERNS, literal_prefilter: bool = True) -> DataFrame:
    """All lines, with ``priority, pattern, category, severity`` and their ranks and the
    causal weight, null where no pattern matches."""
    # A generator's row is made once: as a plain column the regexes would be tried again in
    # every filter that Spark moves below them. The outer form adds no filter of its own.
    # The generator would also lower the line again for each literal, so that comes before.
    (low,) = [n for n in ("_low", "_low_", "_low__") if n not in lines.columns][:1]
    once = F.explode_outer(F.array(first_match(F.col("line"), F.col(low), patterns, literal_prefilter))).alias("priority")
    out = lines.withColumn(low, F.lower("line")).select("*", once).drop(low)
    categories = list(CATEGORIES)

    def of(values: list) -> Column:
        return F.get(F.array(*map(F.lit, values)), F.col("priority"))

    return out.withColumns({
        "pattern": of([p.name for p in patterns]),
        "category": of([p.category for p in patterns]),
        "category_rank": of([categories.index(p.category) for p in patterns]),
        "severity": of([p.severity for p in patterns]),
        "severity_rank": of([SEVERITIES.index(p.severity) for p in patterns]),
        "causal_weight": of([CATEGORIES[p.category] for p in patterns]),
    })


def submatch(line: Column, patterns: Sequence[Pattern]) -> Column:
    """The groups of the matching pattern as texts, unmatched ones empty; null if it has
    none."""
    import re

    out = F.lit(None).cast("array<string>")
    for i, p in enumerate(patterns):
        form = java_form(p.regex)
        n = re.compile(p.regex.removeprefix("(?i)")).groups
        if n:
            out = F.when(F.col("priority") == i, F.array(*[F.regexp_extract(line, form, g) for g in range(1, n + 1)])).otherwise(out)
    return out


def filter_failures(lines: DataFrame, patterns: Sequence[Pattern] = DEFAULT_PATTERNS, literal_prefilter: bool = True) -> DataFrame:
    """The lines that some pattern matches, as they are."""
    return with_pattern(lines, patterns, literal_prefilter).where(F.col("priority").isNotNull()).select(*lines.columns)


def match_lines(lines: DataFrame, patterns: Sequence[Pattern] = DEFAULT_PATTERNS, literal_prefilter: bool = True) -> DataFrame:
    """The matches: matched lines with pattern columns, groups and time."""
    return matches_of(with_pattern(lines, patterns, literal_prefilter), patterns)


def matches_of(classified: DataFrame, patterns: Sequence[Pattern] = DEFAULT_PATTERNS) -> DataFrame:
    """The matches among the lines of ``with_pattern``."""
    found = classified.where(F.col("priority").isNotNull())
    return with_log_time(found.withColumn("submatch", submatch(F.col("line"), patterns)))


def patterns_table(spark, patterns: Sequence[Pattern] = DEFAULT_PATTERNS) -> DataFrame:
    rows = [(i, p.name, p.category, p.severity, p.regex, list(p.literals)) for i, p in enumerate(patterns)]
    return spark.createDataFrame(rows, "priority int, name string, category string, severity string, regex string, literals array<string>")


def match_lines_table(lines: DataFrame, table: DataFrame, literal_prefilter: bool = True) -> DataFrame:
    """``match_lines`` with the patterns of a table ``priority, name, category, severity,
    regex`` of any length."""
    from .pattern_index import match_by_table

    return match_by_table(lines, table, literal_prefilter)
