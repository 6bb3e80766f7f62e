"""Global order without a global window.

Rows are put into buckets that are themselves ordered, so that the order of all rows is
the order by bucket, then inside the bucket. Windows run inside buckets, in parallel; one
summary row for each bucket carries what crosses their edges. Results do not depend on the
size of the buckets. Each function reads its rows twice, so they should come from a table.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .stage import staged

#: Rows that a bucket holds, about, and how many buckets there are at most: the cuts are
#: known to the driver.
BUCKET_ROWS = 1_000_000
MOST_BUCKETS = 20_000
BUCKET = "_bucket"


def in_ranges(rows: DataFrame, order: Sequence[Column], bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """``rows`` (a table) as a table of buckets, ranges of the order with about
    ``bucket_rows`` rows each, or more where that would be over ``MOST_BUCKETS``. The cuts
    are quantiles of the whole key, so a time that very many rows share is cut too."""
    n = min(MOST_BUCKETS, max(1, -(-rows.count() // bucket_rows)))
    return staged(rows.repartitionByRange(n, *order).withColumn(BUCKET, F.spark_partition_id()), "ranges")


def _keys(bucket: Sequence[str]) -> Column:
    return F.struct(*bucket)


def _attach(rows: DataFrame, summary: DataFrame, bucket: Sequence[str]) -> DataFrame:
    """Join summary rows by bucket. Buckets may be null in parts, so keys are structs."""
    summary = summary.withColumn("_key", _keys(bucket)).drop(*bucket)
    return rows.withColumn("_key", _keys(bucket)).join(summary, "_key").drop("_key")


def with_position(rows: DataFrame, bucket: Sequence[str], order: Sequence[Column], name: str = "pos") -> DataFrame:
    """Add each row's place in the order of all, from 0."""
    inside = Window.partitionBy(*bucket).orderBy(*order)
    counts = rows.groupBy(*bucket).agg(F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy(*bucket).rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    out = _attach(rows.withColumn(name, F.row_number().over(inside)), counts, bucket)
    return out.withColumn(name, (F.col(name) + F.col("_before") - 1).cast("long")).drop("_before")


def with_previous(rows: DataFrame, bucket: Sequence[str], order: Sequence[Column], payload: Column, name: str = "prev", position: str = "pos") -> DataFrame:
    """Add the payload of the row before in the order of all, null for the first, and each
    row's place from 0."""
    inside = Window.partitionBy(*bucket).orderBy(*order)
    rows = rows.withColumn("_own", payload)
    marked = rows.withColumn(name, F.lag("_own").over(inside)).withColumn(position, F.row_number().over(inside))
    ends = rows.groupBy(*bucket).agg(F.max_by("_own", F.struct(*order)).alias("_last"), F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy(*bucket)
    ends = ends.withColumn("_edge", F.lag("_last").over(before)).withColumn("_before", F.coalesce(F.sum("_n").over(before.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("_last", "_n")
    out = _attach(marked, ends, bucket)
    out = out.withColumn(name, F.when(F.col(position) == 1, F.col("_edge")).otherwise(F.col(name)))
    return out.withColumn(position, (F.col(position) + F.col("_before") - 1).cast("long")).drop("_own", "_edge", "_before")


def with_running_sum(rows: DataFrame, bucket: Sequence[str], order: Sequence[Column], value: Column, name: str, kind: str = "long") -> DataFrame:
    """Add the sum of ``value`` up to and with each row in the order of all, of type ``kind``."""
    inside = Window.partitionBy(*bucket).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("_value", value)
    sums = rows.groupBy(*bucket).agg(F.sum("_value").alias("_sum"))
    before = Window.orderBy(*bucket).rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.withColumn("_before", F.coalesce(F.sum("_sum").over(before), F.lit(0))).drop("_sum")
    out = _attach(rows.withColumn(name, F.sum("_value").over(inside)), sums, bucket)
    return out.withColumn(name, (F.col(name) + F.col("_before")).cast(kind)).drop("_value", "_before")


def with_last(rows: DataFrame, bucket: Sequence[str], order: Sequence[Column], value: Column, name: str) -> DataFrame:
    """Add the last ``value`` that is not null, up to and with each row in the order of
    all."""
    inside = Window.partitionBy(*bucket).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("_value", value)
    ends = rows.groupBy(*bucket).agg(F.max_by("_value", F.when(F.col("_value").isNotNull(), F.struct(*order))).alias("_end"))
    before = Window.orderBy(*bucket).rowsBetween(Window.unboundedPreceding, -1)
    ends = ends.withColumn("_before", F.last("_end", True).over(before)).drop("_end")
    out = _attach(rows.withColumn(name, F.last("_value", True).over(inside)), ends, bucket)
    return out.withColumn(name, F.coalesce(name, "_before")).drop("_value", "_before")
