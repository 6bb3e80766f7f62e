"""Severities and categories, their order and the categories' causal weights."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed values, in order.
SEVERITIES = ("INFO", "WARN", "ERROR", "CRITICAL", "FATAL")
#: Fixed values, in order, with the causal weight of each.
CATEGORIES = {"OOM Kill": 7, "Timeout": 2, "DB Lock": 4, "Panic": 3, "Signal": 5, "Disk I/O": 6, "Network": 1}


def _lookup(values: dict, key: Column, otherwise: Column) -> Column:
    entries = [F.lit(x) for pair in values.items() for x in pair]
    return F.coalesce(F.element_at(F.create_map(*entries), key), otherwise)


def severity_rank(name: Column) -> Column:
    """0 for INFO to 4 for FATAL, null for other names."""
    return _lookup({s: i for i, s in enumerate(SEVERITIES)}, name, F.lit(None))


def severity_name(rank: Column) -> Column:
    return _lookup(dict(enumerate(SEVERITIES)), rank, F.lit("UNKNOWN"))


def category_rank(name: Column) -> Column:
    return _lookup({c: i for i, c in enumerate(CATEGORIES)}, name, F.lit(None))


def category_name(rank: Column) -> Column:
    return _lookup(dict(enumerate(CATEGORIES)), rank, F.lit("Unknown"))


def causal_weight(name: Column) -> Column:
    """How likely a category causes the others: 7 to 1, or 0 for other names."""
    return _lookup(dict(CATEGORIES), name, F.lit(0))
