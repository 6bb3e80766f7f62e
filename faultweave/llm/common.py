"""Helpers shared by the training-data operators."""

from __future__ import annotations

import uuid
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators import stage
from ..operators.stage import shared_dir

#: Rows and bytes of a table that may be broadcast. Above one of them the shuffled form of
#: a join is used.
BROADCAST_ROWS = 500_000
BROADCAST_BYTES = 64 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stage_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/stage-{uuid.uuid4().hex}/{name}"


def staged(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder and read back: later steps start from the
    files, so a lost executor does not make Spark redo what came before."""
    bounded_batches(df.sparkSession)
    return stage.staged(df, name)


def bounded_batches(spark: SparkSession, size: str = "8m") -> None:
    """Keep what goes to and from Python at a time small: texts differ much in length, and
    a batch stands in the JVM's and in Python's memory at once, for every core."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", size)


def unused(columns: Iterable[str], *names: str) -> list[str]:
    """``names``, each with as many underscores more as make it differ from all columns.
    Letter case does not tell columns apart in Spark."""
    taken = {c.lower() for c in columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def quoted(columns: Iterable[str]) -> list[Column]:
    return [F.col("`" + c.replace("`", "``") + "`") for c in columns]


def _width(value: Column, kind: T.DataType) -> Column:
    """About how many bytes a value takes."""
    if isinstance(kind, (T.StringType, T.BinaryType)):
        return F.coalesce(F.octet_length(value), F.lit(0)) + 16
    if isinstance(kind, T.StructType):
        return sum((_width(value[f.name], f.dataType) for f in kind), F.lit(8))
    if isinstance(kind, T.ArrayType):
        return F.coalesce(F.aggregate(value, F.lit(16).cast("long"), lambda n, x: n + _width(x, kind.elementType)), F.lit(16))
    return F.lit(8)


def small_side(df: DataFrame, limit: int = BROADCAST_ROWS, most: int = BROADCAST_BYTES) -> DataFrame:
    """``df`` marked for broadcast if a count of its rows and bytes proves it small;
    otherwise hinted for a shuffled hash join. The result of the join is the same."""
    width = sum((_width(c, f.dataType) for c, f in zip(quoted(df.columns), df.schema, strict=True)), F.lit(16).cast("long"))
    rows, size = df.agg(F.count(F.lit(1)), F.sum(width)).first()
    return F.broadcast(df) if rows <= limit and (size or 0) <= most else df.hint("shuffle_hash")


def join_by_group(rows: DataFrame, groups: DataFrame, key: str, n: str, how: str = "left", hot_share: int = 1000) -> DataFrame:
    """Join one-row-per-key ``groups`` (a table, as it is read three times) onto ``rows``
    when a key may hold a large share of all rows. ``n`` is the column of ``groups`` with
    the number of rows of the key.

    Keys with more than 1/``hot_share`` of all rows number fewer than ``hot_share``: a
    proven bound, so these are broadcast; all other keys are joined by a shuffle.
    """
    (hot_name,) = unused([*rows.columns, *groups.columns], "_hot")
    total = groups.agg(F.sum(n)).first()[0] or 0
    bound = max(total // hot_share, 1000)
    hot, cold = groups.where(F.col(n) > bound), groups.where(F.col(n) <= bound)
    keys = F.broadcast(hot.select(key, F.lit(True).alias(hot_name)))
    marked = rows.join(keys, key, "left")
    cold_rows = marked.where(F.col(hot_name).isNull()).drop(hot_name).join(cold, key, how)
    hot_rows = marked.where(F.col(hot_name)).drop(hot_name).join(F.broadcast(hot), key)
    return cold_rows.unionByName(hot_rows)


def row_key(doc_id: str = "doc_id", text: str = "text") -> Column:
    """A key of 128 bits for a document row. Rows with equal keys have equal id and text."""
    return F.struct(
        F.xxhash64(F.lit(1), F.col(doc_id).isNull(), doc_id, F.col(text).isNull(), text).alias("a"),
        F.xxhash64(F.lit(2), text, F.col(text).isNull(), doc_id, F.col(doc_id).isNull()).alias("b"),
    )


def with_row_key(docs: DataFrame) -> tuple[DataFrame, list[str]]:
    """``docs`` with the two halves of each row's key, and the names of these columns."""
    k, a, b = unused(docs.columns, "_key", "_key_a", "_key_b")
    return docs.withColumn(k, row_key()).withColumns({a: F.col(k)["a"], b: F.col(k)["b"]}).drop(k), [a, b]
