"""Reports as tables, text lines and JSON."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import clip_line, display_time, format_count, location, truncate_line
from ..functions.timestamps import ZERO
from ..operators.counts import Counts, counts_by, result_summary, summary_rows
from ..operators.stage import discard, staged
from ..sources.files import read_logs


def _totals(lines: DataFrame | Counts, chains: DataFrame) -> DataFrame:
    """Lines and matches in all. ``lines`` are classified lines, or the counts that
    ``counted_matches`` took of them, which saves reading them again."""
    if isinstance(lines, dict):
        return chains.sparkSession.createDataFrame([(lines["lines", "all"], lines["matches", "all"])], "lines long, matches long")
    return lines.agg(F.count(F.lit(1)).alias("lines"), F.count("pattern").alias("matches"))


def summary_report(lines: DataFrame | Counts, chains: DataFrame, sources: Sequence[str]) -> DataFrame:
    """One row: lines, matches and chains in short form, and the sources as given."""
    both = _totals(lines, chains).withColumn("_one", F.lit(1)).join(chains.agg(F.count(F.lit(1)).alias("chains")).withColumn("_one", F.lit(1)), "_one")
    return both.select(*[format_count(F.col(c)).alias(c) for c in ("lines", "matches", "chains")], F.array(*map(F.lit, sources)).cast("array<string>").alias("sources"))


def category_breakdown(classified: DataFrame) -> DataFrame:
    return counts_by(classified, "category").withColumnRenamed("category", "name")


def severity_breakdown(classified: DataFrame) -> DataFrame:
    return counts_by(classified, "severity").withColumnRenamed("severity", "name")


def chain_list(chains: DataFrame) -> DataFrame:
    return chains.select("id", "category", "severity", F.col("size").alias("errors"), truncate_line(F.col("root_line"), 60).alias("root_line"))


def chain_detail(members: DataFrame, chains: DataFrame) -> DataFrame:
    """A row for each match: root lines clipped at 120 characters, others cut to 100; the
    span only if above 0."""
    root = F.col("role") == "root"
    # Only roots ask for the span; a chain of very many matches is not joined by its id.
    spans = chains.select(F.col("root_pos").alias("pos"), F.when(F.col("time_span_ms") > 0, F.col("time_span_ms")).alias("span_ms"))
    return members.join(spans, "pos", "left").select(
        "id", "role", "cascade_pos", "category", "pattern", location(F.col("source"), F.col("line_num")).alias("location"),
        F.when(root, display_time(F.col("ts"))).alias("time"),
        F.when(root, clip_line(F.col("line"), 120)).otherwise(truncate_line(F.col("line"), 100)).alias("line"),
        F.when(root, F.col("span_ms")).alias("span_ms"),
    )


def text_lines(chains: DataFrame) -> DataFrame:
    """``id, text``: the paragraph of each chain in the text report."""
    parts = [
        F.format_string("Chain #%d [%s] %s", "id", "category", "severity"),
        F.concat(F.lit("  Root: "), location(F.col("root_source"), F.col("root_line_num"))),
        F.concat(F.lit("  "), clip_line(F.col("root_line"), 200)),
        F.when(F.col("cascade_size") > 0, F.format_string("  Cascade: %d errors", "cascade_size")),
    ]
    return chains.select("id", F.concat_ws("\n", *parts).alias("text"))


def report_text(lines: DataFrame | Counts, chains: DataFrame) -> DataFrame:
    """``id, text`` with the counts as row 0, or what there is to say if no chain is."""
    both = _totals(lines, chains).withColumn("_one", F.lit(1)).join(chains.agg(F.count(F.lit(1)).alias("chains")).withColumn("_one", F.lit(1)), "_one")
    head = F.when(F.col("chains") == 0, F.lit("No failures detected.")).otherwise(F.format_string("Lines scanned: %d\nMatches found: %d\nFailure chains: %d", "lines", "matches", "chains"))
    return both.select(F.lit(0).cast("long").alias("id"), head.alias("text")).unionByName(text_lines(chains))


def _stamp(sec: Column, nano: Column) -> Column:
    """RFC 3339 in UTC, the fraction without end zeros; no time is the zero time."""
    fraction = F.rtrim(F.lpad(nano.cast("string"), 9, "0"), F.lit("0"))
    text = F.date_format(F.timestamp_seconds(sec), "yyyy-MM-dd'T'HH:mm:ss")
    # Year 0 has its own name in dates before the era.
    year_0 = F.concat(F.lit("0000"), F.substring(F.date_format(F.timestamp_seconds(sec + 63113904000), "yyyy-MM-dd'T'HH:mm:ss"), 5, 15))
    text = F.when(sec < ZERO, year_0).otherwise(text)
    return F.when(sec.isNull(), F.lit("0001-01-01T00:00:00Z")).otherwise(F.concat(text, F.when(fraction != "", F.concat(F.lit("."), fraction)).otherwise(""), F.lit("Z")))


def _match(prefix: str = "") -> Column:
    def c(name: str) -> Column:
        return F.col(prefix + name)

    return F.struct(
        F.struct(c("source").alias("source"), c("line_num").alias("line_num"), c("line").alias("line")).alias("entry"),
        F.struct(c("pattern").alias("name"), c("category").alias("category"), c("severity").alias("severity")).alias("pattern"),
        F.when(F.size("submatch") > 0, F.col("submatch")).alias("submatch"),
        _stamp(c("ts_sec"), c("ts_nano")).alias("timestamp"),
    )


def chain_json(members: DataFrame, chains: DataFrame) -> DataFrame:
    """``id, json``: a document for each chain with its cascade inside. A chain is one
    document here, so this suits chains that fit in memory; write ``chains`` and
    ``chain_members`` as tables otherwise. Nulls and empty cascades are left out."""
    rows = members.withColumn("match", _match())
    parts = rows.groupBy("id").agg(
        F.max(F.when(F.col("role") == "root", F.col("match"))).alias("root_cause"),
        F.transform(F.sort_array(F.collect_list(F.when(F.col("role") == "cascade", F.struct("cascade_pos", "match")))), lambda x: x["match"]).alias("cascade"),
    )
    whole = parts.join(chains.select("id", "time_span_ms", "category", "severity"), "id")
    body = F.struct("id", "root_cause", F.when(F.size("cascade") > 0, F.col("cascade")).alias("cascade"), "time_span_ms", "category", "severity")
    return whole.select("id", F.to_json(body).alias("json"))


def _heads(counts: DataFrame) -> DataFrame:
    """One row with the totals of ``kind, name, n``."""

    def by(kind: str) -> Column:
        return F.map_from_entries(F.array_sort(F.filter(F.collect_list(F.when(F.col("kind") == kind, F.struct("name", "n"))), lambda x: x.isNotNull())))

    return counts.agg(F.max(F.when(F.col("kind") == "lines", F.col("n"))).alias("total_lines"), F.max(F.when(F.col("kind") == "matches", F.col("n"))).alias("total_matches"), by("category").alias("by_category"), by("severity").alias("by_severity"))


def _totals_json(sources: Sequence[str]) -> Column:
    return F.to_json(F.struct("total_lines", "total_matches", "by_category", "by_severity", F.array(*map(F.lit, sources)).cast("array<string>").alias("sources")))


def report_json(lines: DataFrame | Counts, members: DataFrame, chains: DataFrame, sources: Sequence[str]) -> DataFrame:
    """One row ``json`` with everything. For chains that fit in memory together."""
    counts = summary_rows(chains.sparkSession, lines) if isinstance(lines, dict) else result_summary(lines)

    one = _heads(counts).withColumn("_one", F.lit(1))
    docs = chain_json(members, chains).agg(F.transform(F.sort_array(F.collect_list(F.struct("id", "json"))), lambda x: x["json"]).alias("docs")).withColumn("_one", F.lit(1))
    body = _totals_json(sources)
    listed = F.when(F.size("docs") == 0, F.lit("null")).otherwise(F.concat(F.lit("["), F.array_join("docs", ","), F.lit("]")))
    return one.join(docs, "_one").select(F.concat(F.lit('{"chains":'), listed, F.lit(","), F.substring(body, F.lit(2), F.length(body))).alias("json"))


def json_pieces(lines: DataFrame | Counts, members: DataFrame, chains: DataFrame, sources: Sequence[str]) -> DataFrame:
    """``id, at, text``: the document of ``report_json`` in pieces, of which none holds more
    than one match; in order of ``id`` and ``at`` they are the document. Nothing is joined
    or grouped by chain."""
    counts = summary_rows(chains.sparkSession, lines) if isinstance(lines, dict) else result_summary(lines)
    match = F.to_json(_match())
    comma = F.when(F.col("id") > 1, ",").otherwise("")
    any_chain = chains.agg((F.count(F.lit(1)) > 0).alias("any"))
    head = any_chain.select(F.lit(0).cast("long").alias("id"), F.lit(0).cast("long").alias("at"), F.concat(F.lit('{"chains":'), F.when(F.col("any"), "[").otherwise("null")).alias("text"))
    sizes = chains.select(F.col("root_pos").alias("pos"), (F.col("size") > 1).alias("more"))
    roots = members.where(F.col("role") == "root").join(sizes, "pos")
    roots = roots.select("id", F.lit(0).cast("long").alias("at"), F.concat(comma, F.format_string('{"id":%d,"root_cause":', "id"), match, F.when(F.col("more"), ',"cascade":[').otherwise("")).alias("text"))
    cascade = members.where(F.col("role") == "cascade").select("id", F.col("cascade_pos").alias("at"), F.concat(F.when(F.col("cascade_pos") > 1, ",").otherwise(""), match).alias("text"))
    rest = F.to_json(F.struct("time_span_ms", "category", "severity"))
    ends = chains.select("id", F.col("size").cast("long").alias("at"), F.concat(F.when(F.col("size") > 1, "]").otherwise(""), F.lit(","), F.substring(rest, F.lit(2), F.length(rest))).alias("text"))
    body = _totals_json(sources)
    tail = _heads(counts).withColumn("_one", F.lit(1)).join(any_chain.withColumn("_one", F.lit(1)), "_one")
    tail = tail.select(F.lit(2**62).alias("id"), F.lit(0).cast("long").alias("at"), F.concat(F.when(F.col("any"), "]").otherwise(""), F.lit(","), F.substring(body, F.lit(2), F.length(body))).alias("text"))
    return head.unionByName(roots).unionByName(cascade).unionByName(ends).unionByName(tail)


def text_pieces(lines: DataFrame | Counts, chains: DataFrame) -> DataFrame:
    """``id, at, text``: the paragraphs of the text report."""
    return report_text(lines, chains).select("id", F.lit(0).cast("long").alias("at"), "text")


def write_pieces(pieces: DataFrame, path: str, files: int = 0, piece_rows: int = 1_000_000) -> None:
    """Write pieces as text files that are one document, read in order of their names. A
    file is a range of the order, so many tasks write, a long chain's too; Spark commits
    the files together."""
    kept = staged(pieces, "pieces")
    files = files or max(1, -(-kept.count() // piece_rows))
    kept.repartitionByRange(files, "id", "at").sortWithinPartitions("id", "at").select("text").write.option("lineSep", "\n").text(path)
    discard(kept)


def read_pieces(spark: SparkSession, path: str) -> DataFrame:
    """``line_num, text``: the lines of a document that was written as ordered files."""
    lines = read_logs(spark, path)
    sizes = lines.groupBy("source").agg(F.count(F.lit(1)).alias("_n"))
    # A row for each file.
    before = F.sum("_n").over(Window.orderBy("source").rowsBetween(Window.unboundedPreceding, -1))
    starts = staged(sizes.select("source", F.coalesce(before, F.lit(0)).alias("_before")), "starts")
    return lines.join(starts, "source").select((F.col("line_num") + F.col("_before")).alias("line_num"), F.col("line").alias("text"))
