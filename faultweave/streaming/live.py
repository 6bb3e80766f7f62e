"""The same analysis on lines that keep arriving.

Rows later than the watermark allows are left out by Spark; matches without a time have no
place in windows and sessions and stay in ``stream_matches``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.enums import severity_name
from ..functions.patterns import DEFAULT_PATTERNS, Pattern
from ..operators.match import match_lines
from ..operators.stage import staged
from ..operators.twolevel import BUCKET, BUCKET_ROWS, in_ranges, with_previous, with_running_sum
from .sessions import joined_sessions, window_summaries


def stream_matches(lines: DataFrame, patterns: Sequence[Pattern] = DEFAULT_PATTERNS) -> DataFrame:
    """Matches with pattern and time; no state."""
    return match_lines(lines, patterns)


def _timed(matches: DataFrame, watermark: str) -> DataFrame:
    rows = matches.where(F.col("ts").isNotNull())
    return rows.withWatermark("ts", watermark) if matches.isStreaming else rows


def stream_counts(matches: DataFrame, window: str = "1 minute", watermark: str = "1 minute") -> DataFrame:
    """Matches by category and severity in each window of time."""
    out = _timed(matches, watermark).groupBy(F.window("ts", window), "category", "severity").agg(F.count(F.lit(1)).alias("n"))
    return out.select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), "category", "severity", "n")


def stream_chains(matches: DataFrame, window_s: float = 5.0, watermark: str = "1 minute", by_source: bool = False, place: str | None = None) -> DataFrame:
    """Chains of timed matches: sessions whose gaps are at most the window, over all sources
    or by source. The root is the first match of the greatest causal weight; equal times go
    by source, ``place`` (a column with the line's number, if there is one) and line.
    Streams go through ``sessions``, tables over all sources through ranges of time, so that
    no task holds them all."""
    if not matches.isStreaming and not by_source:
        return _table_chains(matches, window_s)
    timed = _timed(matches, watermark)
    at = F.col(place) if place else F.lit(0)
    if not matches.isStreaming:
        return _table_chains_by_source(timed, window_s, at)
    sums = window_summaries(timed, window_s, ["source"] if by_source else [], at)
    found = joined_sessions(sums, window_s, F.col("source") if by_source else F.lit("all"))

    def time(name: str) -> Column:
        return F.timestamp_micros(F.col(f"{name}_sec") * 1_000_000 + F.call_function("div", F.col(f"{name}_nano"), F.lit(1000))).alias(name)

    return found.select("chain_key", time("start"), time("last"), F.col("root_category").alias("category"), severity_name(F.col("severity_rank")).alias("severity"), "size", "root_pattern", "root_source", "root_line")


def _table_chains_by_source(timed: DataFrame, window_s: float, place: Column) -> DataFrame:
    root = F.min(F.struct((-F.col("causal_weight")).alias("weight"), "ts_sec", "ts_nano", "source", place.alias("place"), "line", "category", "pattern"))
    out = timed.groupBy(F.session_window("ts", f"{int(window_s * 1_000_000)} microseconds"), F.col("source").alias("chain_key")).agg(root.alias("root"), F.max("severity_rank").alias("severity_rank"), F.count(F.lit(1)).alias("size"), F.max("ts").alias("last"))
    return out.select(
        "chain_key", F.col("session_window.start").alias("start"), "last", F.col("root.category").alias("category"), severity_name(F.col("severity_rank")).alias("severity"),
        "size", F.col("root.pattern").alias("root_pattern"), F.col("root.source").alias("root_source"), F.col("root.line").alias("root_line"),
    )


def _table_chains(matches: DataFrame, window_s: float, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    whole = staged(matches.where(F.col("ts").isNotNull()).withColumn("_row", F.monotonically_increasing_id()), "timed")
    keys = whole.select("_row", F.unix_micros("ts").alias("_us"), "causal_weight", "severity_rank", "category", "pattern", "source")
    order = [F.col("_us"), F.col("source"), F.col("_row")]
    rows = with_previous(in_ranges(keys, order, bucket_rows), [BUCKET], order, F.col("_us"))
    fresh = F.coalesce(F.col("_us") - F.col("prev") > int(window_s * 1_000_000), F.lit(True)).cast("int")
    rows = staged(rows.withColumn("_fresh", fresh).drop("prev"), "timed-gaps")
    rows = with_running_sum(rows, [BUCKET], [F.col("pos")], F.col("_fresh"), "_chain")
    root = F.max(F.struct("causal_weight", (-F.col("_us")).alias("early"), "category", "pattern", "source", "_row"))
    out = rows.groupBy("_chain").agg(root.alias("root"), F.min("_us").alias("start"), F.max("_us").alias("last"), F.max("severity_rank").alias("severity_rank"), F.count(F.lit(1)).alias("size"))
    out = out.withColumn("_row", F.col("root._row")).join(whole.select("_row", "line"), "_row")
    return out.select(
        F.lit("all").alias("chain_key"), F.timestamp_micros("start").alias("start"), F.timestamp_micros("last").alias("last"), F.col("root.category").alias("category"), severity_name(F.col("severity_rank")).alias("severity"),
        "size", F.col("root.pattern").alias("root_pattern"), F.col("root.source").alias("root_source"), F.col("line").alias("root_line"),
    )
