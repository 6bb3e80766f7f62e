"""Log lines from files and tables.

Lines end at newlines only; one carriage return before it goes; blank lines stay; no line
follows the last newline. Line numbers are exact, from 1 for each file. A file that cannot
be read is an error. Over-long lines are kept unless a limit is set.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.stage import discard, staged

STDIN = "stdin"
#: Rows and bytes of a block table that is broadcast.
MOST_BLOCKS, MOST_BYTES = 500_000, 64 << 20


def without_return(line: Column) -> Column:
    return F.when(F.endswith(line, F.lit("\r")), F.substring(line, F.lit(1), F.char_length(line) - 1)).otherwise(line)


def _scan(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    rows = spark.read.option("lineSep", "\n").text(list(paths))
    return rows.select(F.col("_metadata.file_path").alias("source"), F.col("_metadata.file_block_start").alias("_block"), F.monotonically_increasing_id().alias("_id"), without_return(F.col("value")).alias("line"))


def with_line_numbers(lines: DataFrame) -> DataFrame:
    """``source, line_num, line`` from a scan: a line's number in its block plus the lines
    of the file's blocks before. The block table has a row for each block; it is counted
    when this is called and broadcast if that proves it small, so that no line is
    shuffled."""
    blocks = lines.groupBy("source", "_block").agg(F.min("_id").alias("_first"), F.count(F.lit(1)).alias("_n"))
    before = F.sum("_n").over(Window.partitionBy("source").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1))
    blocks = blocks.withColumn("_before", F.coalesce(before, F.lit(0))).drop("_n")
    blocks = staged(blocks, "blocks")
    n, size = blocks.agg(F.count(F.lit(1)), F.sum(F.octet_length("source") + 64)).first()
    small = n <= MOST_BLOCKS and (size or 0) <= MOST_BYTES
    out = lines.join(F.broadcast(blocks) if small else blocks, ["source", "_block"])
    return out.select("source", (F.col("_id") - F.col("_first") + F.col("_before") + 1).cast("long").alias("line_num"), "line")


def read_logs(spark: SparkSession, paths: str | Sequence[str], max_line_bytes: int | None = None) -> DataFrame:
    """``source, line_num, line`` of text files, packed ones included, as one set."""
    lines = with_line_numbers(_scan(spark, [paths] if isinstance(paths, str) else paths))
    return lines if max_line_bytes is None else lines.where(F.octet_length("line") <= max_line_bytes)


def dropped_lines(lines: DataFrame, max_line_bytes: int) -> DataFrame:
    """How many lines of each source a limit leaves out."""
    return lines.where(F.octet_length("line") > max_line_bytes).groupBy("source").agg(F.count(F.lit(1)).alias("dropped"))


def lines_from_table(df: DataFrame, source: Column, text: Column, first: Column | None = None) -> DataFrame:
    """``source, line_num, line`` from a column that holds whole logs. ``first`` is the
    number of each text's first line, 1 unless given."""
    parts = F.split(text, "\n", -1)
    # The outer form keeps Spark from splitting every text twice to look at the size.
    out = df.select(source.alias("source"), (first if first is not None else F.lit(1)).alias("_first"), F.endswith(text, F.lit("\n")).alias("_ended"), F.size(parts).alias("_n"), F.posexplode_outer(parts).alias("_pos", "_line"))
    out = out.where(F.col("_pos").isNotNull() & ~((F.col("_pos") == F.col("_n") - 1) & (F.col("_line") == "")))
    return out.select("source", (F.col("_first") + F.col("_pos")).cast("long").alias("line_num"), without_return(F.col("_line")).alias("line"))


def stream_logs(spark: SparkSession, folder: str, source: str = STDIN, max_files: int = 100) -> DataFrame:
    """``source, line`` of files that keep arriving in a folder."""
    rows = spark.readStream.option("lineSep", "\n").option("maxFilesPerTrigger", max_files).text(folder)
    return rows.select(F.lit(source).alias("source"), without_return(F.col("value")).alias("line"))


def stream_files(spark: SparkSession, folder: str, max_files: int = 100) -> DataFrame:
    """``source, line`` of files that keep arriving in folders ``source=<name>`` and, of each
    line's file, what tells the order: ``_time, _path, _block``."""
    rows = spark.readStream.schema("value string, source string").option("lineSep", "\n").option("maxFilesPerTrigger", max_files).text(folder)
    meta = F.col("_metadata")
    return rows.select("source", without_return(F.col("value")).alias("line"), meta["file_modification_time"].alias("_time"), meta["file_path"].alias("_path"), meta["file_block_start"].alias("_block"))


class LineNumbers:
    """Numbers the lines of a stream, for ``foreachBatch``: files of one source are one log
    that goes on, in order of their times and paths.

    A line's number is its place in its block of a file, plus the lines of the source's
    blocks before it in the batch, plus the last number of the source before the batch. Only
    the table of blocks is grouped and ordered; lines are joined with it and stay where they
    are if it is small. The last numbers, a row for each source, are kept for each batch in
    ``path/numbers``, the lines in ``path/rows``, both by batch: a batch that is run again
    after a failure starts from the numbers before it and replaces what it had written.
    """

    def __init__(self, path: str) -> None:
        self.path = path

    def __call__(self, lines: DataFrame, batch: int) -> None:
        spark = lines.sparkSession
        # Written once: both uses must see the lines in the same pieces.
        kept = staged(lines.withColumn("_id", F.monotonically_increasing_id()), "arrived")
        place = ["source", "_time", "_path", "_block"]
        blocks = kept.groupBy(*place).agg(F.min("_id").alias("_first"), F.count(F.lit(1)).alias("_n"))
        before = F.sum("_n").over(Window.partitionBy("source").orderBy(*place[1:]).rowsBetween(Window.unboundedPreceding, -1))
        last = self._numbers(spark, batch)
        blocks = blocks.withColumn("_before", F.coalesce(before, F.lit(0))).join(last, "source", "left")
        blocks = staged(blocks.withColumn("_start", F.coalesce("last", F.lit(0)) + F.col("_before")).drop("last", "_before"), "blocks")
        n, size = blocks.agg(F.count(F.lit(1)), F.sum(F.octet_length("_path") + F.octet_length("source") + 64)).first()
        joined = kept.join(F.broadcast(blocks) if n <= MOST_BLOCKS and (size or 0) <= MOST_BYTES else blocks, place)
        out = joined.select("source", (F.col("_start") + F.col("_id") - F.col("_first") + 1).cast("long").alias("line_num"), "line")
        out.write.mode("overwrite").parquet(f"{self.path}/rows/batch={batch}")
        ends = blocks.groupBy("source").agg(F.max(F.col("_start") + F.col("_n")).alias("last"))
        ends.unionByName(last.join(ends, "source", "left_anti")).write.mode("overwrite").parquet(f"{self.path}/numbers/batch={batch}")
        discard(kept, blocks)

    def _numbers(self, spark: SparkSession, batch: int) -> DataFrame:
        schema = "source string, last long"
        return spark.read.schema(schema).parquet(f"{self.path}/numbers/batch={batch - 1}") if batch else spark.createDataFrame([], schema)

    def table(self, spark: SparkSession) -> DataFrame:
        """All lines numbered so far."""
        return spark.read.schema("source string, line_num long, line string").parquet(f"{self.path}/rows").select("source", "line_num", "line")

    def run_available(self, lines: DataFrame) -> None:
        """Number all that has arrived; a later call goes on behind it."""
        lines.writeStream.foreachBatch(self).option("checkpointLocation", f"{self.path}/checkpoint").trigger(availableNow=True).start().awaitTermination()
