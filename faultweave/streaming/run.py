"""Streams that run to the end of what is there and are then read as tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.types import StructType


def run_available(stream: DataFrame, path: str) -> int:
    """Run ``stream`` over all that has arrived, in micro-batches, adding to the table
    ``path/rows``; progress and state stay in ``path/checkpoint``, so that a later call goes
    on from there. Returns how many rows came too late for the watermark (rows that were
    summed up before count as one)."""
    query = stream.writeStream.outputMode("append").format("parquet").option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).start(f"{path}/rows")
    query.awaitTermination()
    return sum(int(op["numRowsDroppedByWatermark"]) for p in query.recentProgress for op in p["stateOperators"])


def rows_of(spark, path: str, schema: StructType) -> DataFrame:
    """What a stream has written to ``path`` so far."""
    return spark.read.schema(schema).parquet(f"{path}/rows")
