"""From raw documents to a training mix.

``STAGES`` are ``(name, function)`` pairs; a function takes ``(spark, docs, sf_dir)`` and
returns a DataFrame, which is written and read again as the next one's ``docs``. All but
the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from faultweave.llm import decontam, line_dedup, mixing, ngram_join, quality
from faultweave.llm.common import staged, table
from faultweave.llm.linear import score_column
from faultweave.operators.stage import discard


#: The last classifier learnt, by application and state of its tables: two stages use the
#: same one.
_learnt: dict = {}


def _state(spark: SparkSession, path: str) -> tuple:
    """What tells a table from what it was before: its size, files and time."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    sums = files.getContentSummary(place)
    return path, sums.getLength(), sums.getFileCount(), files.getFileStatus(place).getModificationTime()


def _quality_score(spark: SparkSession, docs: DataFrame, sf_dir: str) -> Column:
    """The classifier's score of ``docs``, learnt from the labelled ones of all documents."""
    key = (spark.sparkContext.applicationId, *(_state(spark, f"{sf_dir}/{t}.parquet") for t in ("documents", "labels")))
    if key not in _learnt:
        known, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
        model = quality.learn(known.where(~quality.held_out()), labels.where(~quality.held_out()))
        _learnt.clear()
        _learnt[key] = model
    return score_column(docs, _learnt[key], quality.SPACE)


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier does not reject."""
    return docs.where(_quality_score(spark, docs, sf_dir) >= quality.THRESHOLD)


def fresh_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, each without the lines that many share."""
    kept = line_dedup.dedup_lines(docs)
    return kept.withColumn("n_chars", F.char_length("text").cast("long")).select(*docs.columns)


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates."""
    return ngram_join.keep_one(docs, staged(ngram_join.near_duplicates(docs), "near"))


def no_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return decontam.without_contaminated(docs, decontam.contaminated(docs, table(spark, sf_dir, "benchmark")))


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What the mix takes of each document; the better its quality, the likelier. A stage
    returns documents only, so their quality is scored anew."""
    return mixing.mix(docs, weight=_quality_score(spark, docs, sf_dir), keep=("lang",)).select("doc_id", "source", "lang", "size", "source_size", "target", "taken", "epochs")


STAGES = [
    ("quality", good_quality),
    ("lines", fresh_lines),
    ("near_duplicates", one_of_each),
    ("benchmark", no_benchmark),
    ("mix", source_mix),
]

#: The classifier has no SQL; each stage is tested against a plain version of it.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        docs = staged(stage(spark, docs, sf_dir), f"stage-{name}")
        if before is not None:
            discard(before)
        before = docs
    return docs
