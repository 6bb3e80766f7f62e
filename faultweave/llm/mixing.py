"""Mixing sources to target weights by Efraimidis-Spirakis sampling.

Every document gets the key ``-ln(u) / w``: ``u`` a uniform number drawn from a hash of
seed, id and text, ``w`` its quality weight. Small keys first, this is weighted sampling
without replacement. Each source's target is first met by complete epochs; what is left
is taken from the head of one more epoch in key order, by a prefix sum of sizes, and the
document at the budget's edge is taken up to the budget. A source may hold any share of
all rows, and so may repeats of one row: documents are cut into ranges of bounded size by
quantiles of the whole order, sorted range by range, and joined up by the ranges' sums.

Defined results: a null text has size 0 and takes 0. Null sources are one source, last
in order. Rows with equal id and text are interchangeable; ties of keys go by id, then
text hash. An empty table gives an empty result. Extra columns do not matter unless
``keep`` names them; of these, names of the operator's own columns are left out. Null
weights and weights below 10^-6 count as 10^-6.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.twolevel import BUCKET, in_ranges, with_position, with_running_sum
from .common import join_by_group, quoted, staged

#: Word pattern: white space is exactly these bytes.
WORD = "[^\\x20\\x09-\\x0D]+"
BLANK = "[\\x20\\x09-\\x0D]+"
#: Documents that one task sorts, about.
BUCKET_ROWS = 20_000


def word_count(text: Column) -> Column:
    """How many words a text has. Each is cut to one letter, then what stands between goes:
    ``regexp_count`` makes an array of all words first, many times a text of short ones."""
    letters = F.regexp_replace(F.coalesce(text, F.lit("")), F.lit(WORD), F.lit("x"))
    return F.octet_length(F.regexp_replace(letters, F.lit(BLANK), F.lit(""))).cast("long")


def uniform(seed: int, doc_id: str = "doc_id", text: str = "text") -> Column:
    """A number above 0 and below 1 from 48 bits of an MD5 that any engine can compute."""
    digest = F.md5(F.concat_ws(":", F.lit(str(seed)), F.coalesce(F.col(doc_id).cast("string"), F.lit("")), F.md5(F.coalesce(F.col(text), F.lit("")))))
    return (F.conv(F.substring(digest, 1, 12), 16, 10).cast("double") + 0.5) / float(1 << 48)


def length_weight(size: Column, chars: Column) -> Column:
    """A stand-in for tables without a quality score, from 0.2 to 1: texts whose words are
    about 6 letters long weigh most."""
    return F.greatest(F.lit(0.2), F.lit(1.0) - F.abs(chars / F.greatest(size, F.lit(1)) - 6.0) / 10.0)


def targets(sources: DataFrame, weights: Sequence[float], share: float, most: float) -> DataFrame:
    """Add ``target``, and ``base``, the sizes of all sources before, to a table with
    ``source, source_size``, one row for each source.

    Sources share ``share`` of all sizes by weight, none above ``most`` times its size.
    Passing on what is above until nothing is equals ``min(most * size, x * weight)``
    for the one ``x`` at which the sum is right: capped sources are those with the least
    ``most * size / weight``, found by prefix sums in that order. Sources may be many, such
    as hosts: places and sums come from two-level windows, and three numbers to the driver.
    """
    name = F.col("source").asc_nulls_last()
    s = in_ranges(sources, [name])
    s = with_running_sum(with_position(s, [BUCKET], [name], "rank"), [BUCKET], [name], F.col("source_size"), "base")
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.col("rank") % len(weights) + 1).cast("int"))
    s = s.drop(BUCKET).withColumn("base", F.col("base") - F.col("source_size")).withColumn("w", w).withColumn("cap", F.col("source_size") * F.lit(float(most)))
    order = [F.col("turn"), name]
    s = in_ranges(staged(s.withColumn("turn", F.col("cap") / F.col("w")), "mix-turns"), order)
    capped = with_running_sum(s, [BUCKET], order, F.col("cap"), "capped", "double")
    capped = with_running_sum(capped, [BUCKET], order, F.col("w"), "weighed", "double")
    total, total_w = s.agg(F.sum("source_size"), F.sum("w")).first()
    # The water level if all before this one are capped; the first at which this one is not.
    level = (F.lit((total or 0) * share) - (F.col("capped") - F.col("cap"))) / (F.lit(total_w or 0.0) - (F.col("weighed") - F.col("w")))
    (first,) = capped.agg(F.min(F.when(level <= F.col("turn"), F.struct("turn", level.alias("level"))))["level"]).first()
    target = F.col("cap") if first is None else F.least(F.col("cap"), F.lit(first) * F.col("w"))
    return s.withColumn("target", target).drop(BUCKET, "rank", "w", "cap", "turn")


def mix(
    docs: DataFrame,
    weights: Sequence[float] = (5.0, 2.0, 1.0),
    share: float = 1.5,
    most: float = 2.0,
    seed: int = 7,
    weight: Column | None = None,
    keep: Sequence[str] = (),
) -> DataFrame:
    """``doc_id, source, size, source_size, target, taken, epochs, sample_key`` and the
    columns in ``keep``, a row for each row of ``docs``. ``taken`` counts the words that
    the mix takes from a document, repeats included. ``weight`` is the quality weight, any
    column of ``docs`` such as a classifier's score; without it words' lengths stand in.
    """
    own = {"doc_id", "source", "size", "source_size", "target", "taken", "epochs", "sample_key"}
    keep = [c for c in keep if c.lower() not in own]
    # Columns to keep travel as one, so that their names meet none of this function's.
    extra = [F.struct(*quoted(keep)).alias("extra")] if keep else []
    words = word_count(F.col("text"))
    letters = F.char_length(F.coalesce(F.col("text"), F.lit(""))).cast("double")
    given = [weight.cast("double").alias("given")] if weight is not None else []
    rows = docs.select("doc_id", "source", *extra, words.alias("size"), uniform(seed).alias("u"), letters.alias("chars"), F.xxhash64("text").alias("tie"), *given)
    heavy = F.greatest(F.coalesce("given", F.lit(0.0)), F.lit(1e-6)) if given else length_weight(F.col("size"), F.col("chars"))
    rows = rows.withColumns({"sample_key": -F.log("u") / heavy, "row": F.monotonically_increasing_id()})
    rows = staged(rows.drop("u", "chars", *["given"] * len(given)), "mix-keys")
    by_source = staged(rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("source_rows")), "mix-sources")
    name = F.sha2(F.coalesce(F.concat(F.lit("="), "source"), F.lit("null")), 256)
    plan = staged(targets(by_source, weights, share, most).withColumn("sid", name).drop("source"), "mix-targets")
    # One running sum over all sources in turn; what stands before a source is taken off.
    order = [F.col("source").asc_nulls_last(), F.col("sample_key"), F.col("doc_id").asc_nulls_last(), F.col("tie"), F.col("row")]
    rows = with_running_sum(in_ranges(rows, order, BUCKET_ROWS), [BUCKET], order, F.col("size"), "upto")
    rows = join_by_group(rows.withColumn("sid", name), plan, "sid", "source_rows", "inner")
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    left = F.round(F.col("target") - F.col("epochs") * F.col("source_size")).cast("long")
    part = F.greatest(F.lit(0), F.least(F.col("size"), left - (F.col("upto") - F.col("base") - F.col("size"))))
    rows = rows.withColumn("epochs", epochs).withColumn("taken", (F.col("epochs") * F.col("size") + part).cast("long"))
    return rows.select("doc_id", "source", *[F.col("extra")[c].alias(c) for c in keep], "size", "source_size", "target", "taken", "epochs", "sample_key")
