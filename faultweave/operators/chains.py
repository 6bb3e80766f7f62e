"""Failure chains: matches in time order, cut where the log falls silent.

Order, gaps and chains are worked out on narrow rows, keys and times in ranges of bounded
size; what the matches hold besides is joined once, at the end.

Differences from a single-machine run, all deliberate: equal times are ordered by source
and line number; a cascade that is sorted again puts untimed rows last, by line number.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.enums import severity_name
from ..functions.text import span_ms
from ..functions.timestamps import ZERO
from .stage import discard, staged
from .twolevel import BUCKET, BUCKET_ROWS, in_ranges, with_last, with_position, with_previous, with_running_sum

#: The window in seconds unless another is given, which merging always has;
#: lines nearer than this belong together if there is no time.
WINDOW_S = 5.0
NEAR_LINES = 50
#: Chains, by their numbers, that one task of a merge sorts.
MERGE_CHAINS = 100_000
_NANO = 1_000_000_000
#: Times further apart than this many seconds are past every window.
_FAR_S = 9_000_000_000


def _ordered(matches: DataFrame, bucket_rows: int) -> tuple[DataFrame, DataFrame, list[Column]]:
    """The matches as a table with a number for each row; keys and times by range; the
    order: timed matches by time, then untimed, by source and line."""
    whole = staged(matches.withColumn("_row", F.monotonically_increasing_id()), "matches")
    keys = whole.select("_row", F.col("ts_sec").isNull().cast("int").alias("_untimed"), "source", "line_num", "ts_sec", "ts_nano", "category")
    order = [F.col("_untimed"), F.coalesce("ts_sec", F.lit(0)), F.coalesce("ts_nano", F.lit(0)), F.col("source"), F.col("line_num"), F.col("_row")]
    return whole, in_ranges(keys, order, bucket_rows), order


def _whole(whole: DataFrame, found: DataFrame, *columns: str) -> DataFrame:
    return whole.join(found.select("_row", *columns), "_row").drop("_row")


def order_matches(matches: DataFrame, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """Add ``pos``, from 0: timed matches by time, then untimed by source and line."""
    whole, keys, order = _ordered(matches, bucket_rows)
    return _whole(whole, with_position(keys, [BUCKET], order), "pos")


def gap_breaks(window_s: float) -> tuple[Column, Column]:
    """The gap to match ``prev`` in ns (null if past all windows), and whether it breaks."""
    if window_s <= 0:
        raise ValueError("the window must be above 0 seconds")
    prev = F.col("prev")
    timed = F.col("ts_sec").isNotNull() & prev["ts_sec"].isNotNull()
    apart = F.col("ts_sec") - prev["ts_sec"]
    near = (F.col("source") == prev["source"]) & (F.col("line_num") - prev["line_num"] < NEAR_LINES)
    gap = F.when(timed & (apart < _FAR_S), apart * _NANO + (F.col("ts_nano") - prev["ts_nano"])).when(~timed, F.when(near, 0).otherwise(int(WINDOW_S * _NANO) + 1))
    gap = F.when(prev.isNotNull(), gap)
    return gap.cast("long"), prev.isNull() | gap.isNull() | (gap > int(window_s * _NANO))


def match_gaps(matches: DataFrame, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """Add ``gap_ns`` to the match before."""
    whole, keys, order = _ordered(matches, bucket_rows)
    rows = with_previous(keys, [BUCKET], order, F.struct("ts_sec", "ts_nano", "source", "line_num"))
    return _whole(whole, rows.withColumn("gap_ns", gap_breaks(WINDOW_S)[0]), "gap_ns")


def assign_chains(matches: DataFrame, window_s: float = WINDOW_S, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """Add ``pos`` and ``chain_seq``, from 1: a new chain where the gap is above the
    window, neighbours of one category merged where it is 5 s or less."""
    broken = gap_breaks(window_s)[1].cast("int")
    whole, keys, order = _ordered(matches, bucket_rows)
    rows = with_previous(keys, [BUCKET], order, F.struct("ts_sec", "ts_nano", "source", "line_num"))
    breaks = staged(rows.select("_row", BUCKET, "pos", "category", "ts_sec", "ts_nano", broken.alias("_break")), "breaks")
    discard(keys)
    rows = with_running_sum(breaks, [BUCKET], [F.col("pos")], F.col("_break"), "chain_seq")
    if window_s < WINDOW_S:
        rows = staged(rows, "unmerged")
        rows = rows.join(merge_chains(rows), "chain_seq").drop("chain_seq").withColumnRenamed("merged_seq", "chain_seq")
    out = staged(_whole(whole, rows, "pos", "chain_seq"), "assigned")
    discard(whole, breaks)
    return out


def merge_chains(rows: DataFrame) -> DataFrame:
    """``chain_seq, merged_seq``: runs of chains whose first matches have one category and
    that start 5 s or less after the end of the one before, both timed."""
    when = F.struct("ts_sec", "ts_nano")
    chains = rows.groupBy("chain_seq").agg(F.min_by("category", "pos").alias("category"), F.min_by(when, F.col("pos")).alias("start"), F.max_by(when, F.col("pos")).alias("end"))
    chains = staged(chains.withColumn("_cb", F.floor(F.col("chain_seq") / MERGE_CHAINS)), "heads")
    chains = with_previous(chains, ["_cb"], [F.col("chain_seq")], F.struct("category", "end"))
    a, b = F.col("prev.end"), F.col("start")
    apart = b["ts_sec"] - a["ts_sec"]
    near = (apart < _FAR_S) & (apart * _NANO + (b["ts_nano"] - a["ts_nano"]) <= int(WINDOW_S * _NANO))
    joins = F.coalesce((F.col("prev.category") == F.col("category")) & near, F.lit(False))
    chains = with_running_sum(chains, ["_cb"], [F.col("chain_seq")], F.when(joins, 0).otherwise(1), "merged_seq")
    return chains.select("chain_seq", "merged_seq")


_ROOT = ("pos", "source", "line_num", "line", "pattern", "category", "severity", "ts_sec", "ts_nano")


def chain_summary(rows: DataFrame) -> DataFrame:
    """A row for each chain: root cause (the first match of the greatest causal weight),
    category, greatest severity, size, span from root to the last of the cascade."""
    root = F.max_by(F.struct(*_ROOT), F.struct("causal_weight", (-F.col("pos")).alias("early")))
    base = rows.groupBy("chain_seq").agg(
        root.alias("root"),
        F.max("severity_rank").alias("severity_rank"),
        F.count(F.lit(1)).alias("size"),
        F.min("pos").alias("first_pos"),
        F.max(F.struct("pos", "ts_sec", "ts_nano")).alias("last"),
    )
    # Where the root is the last match, the cascade ends with the one before it.
    late = base.where((F.col("size") > 1) & (F.col("root.pos") == F.col("last.pos"))).select("chain_seq", (F.col("last.pos") - 1).alias("pos"))
    other = rows.select("chain_seq", "pos", "ts_sec", "ts_nano").join(late, ["chain_seq", "pos"]).select("chain_seq", F.struct("pos", "ts_sec", "ts_nano").alias("other"))
    base = base.join(other, "chain_seq", "left")
    end = F.coalesce("other", "last")
    span = span_ms(F.col("root.ts_sec"), F.col("root.ts_nano"), end["ts_sec"], end["ts_nano"])
    return base.select(
        "chain_seq",
        F.col("root.category").alias("category"),
        severity_name(F.col("severity_rank")).alias("severity"),
        "severity_rank",
        "size",
        (F.col("size") - 1).alias("cascade_size"),
        F.coalesce(F.when(F.col("size") > 1, span), F.lit(0)).cast("long").alias("time_span_ms"),
        "first_pos",
        *[F.col(f"root.{c}").alias(f"root_{c}") for c in _ROOT],
    )


def _ranking(rows: DataFrame, bucket_rows: int) -> tuple[DataFrame, list[Column]]:
    """The keys of chains (a table) by range of their rank, and its order."""
    keys = rows.select("chain_seq", (-F.col("severity_rank")).alias("_sv"), F.coalesce("root_ts_sec", F.lit(ZERO)).alias("_t"), F.coalesce("root_ts_nano", F.lit(0)).alias("_n"))
    order = [F.col(c) for c in ("_sv", "_t", "_n", "chain_seq")]
    return in_ranges(keys, order, bucket_rows), order


def rank_chains(chains: DataFrame, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """Add ``id``, from 1: greatest severity first, then time of the root (untimed as year
    1), then the chains' own order."""
    rows = staged(chains, "chains")
    keys, order = _ranking(rows, bucket_rows)
    ids = with_position(keys, [BUCKET], order, "id")
    out = staged(rows.join(ids.select("chain_seq", (F.col("id") + 1).alias("id")), "chain_seq"), "ranked")
    discard(rows, keys)
    return out


def ranked_page(chains: DataFrame, offset: int = 0, limit: int = 20, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """``chain_page`` of chains that are not ranked yet. The ranges of the rank are counted,
    and only those that the page meets are sorted: the counts, one for each range, tell which
    and how many chains stand before them."""
    rows = staged(chains, "chains")
    keys, order = _ranking(rows, bucket_rows)
    before, met, first = 0, [], None
    for r in keys.groupBy(BUCKET).agg(F.count(F.lit(1)).alias("n")).orderBy(BUCKET).collect():
        if before < offset + limit and before + r["n"] > offset:
            met.append(r[BUCKET])
            first = before if first is None else first
        before += r["n"]
    ids = with_position(keys.where(F.col(BUCKET).isin(met)), [BUCKET], order, "id")
    ids = ids.select("chain_seq", (F.col("id") + 1 + (first or 0)).alias("id"))
    return rows.join(chain_page(ids, offset, limit), "chain_seq")


def ranked_chains(matches: DataFrame, window_s: float = WINDOW_S, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """Matches to ranked chains."""
    return rank_chains(chain_summary(assign_chains(matches, window_s, bucket_rows)), bucket_rows)


def chain_members(rows: DataFrame, chains: DataFrame, window_s: float = WINDOW_S, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """A row for each match of ranked chains: ``id``, ``role`` (root or cascade) and
    ``cascade_pos`` from 1. A cascade whose root was not its first match is in time order
    again, the first match in the root's place among equal times."""
    when = F.struct("ts_sec", "ts_nano", F.when(F.col("ts_sec").isNull(), F.col("line_num")).alias("untimed"))
    # A chain's head meets the row of its first match and is handed on along the positions,
    # which a chain has without gaps; nothing is joined by chain.
    heads = chains.select(F.col("first_pos").alias("pos"), F.struct("chain_seq", "id", "first_pos", "root_pos").alias("_own"))
    keys = rows.select("pos", "chain_seq", when.alias("_when")).join(heads, "pos", "left")
    keys = staged(keys.withColumn(BUCKET, F.floor(F.col("pos") / bucket_rows)), "heads")
    own = F.when(F.col("_own").isNotNull(), F.struct("_own.*", F.col("_when").alias("when")))
    out = with_last(keys, [BUCKET], [F.col("pos")], own, "_head")
    out = out.where(F.col("chain_seq") == F.col("_head.chain_seq")).select("pos", "_when", "_head.*")
    swapped = F.col("root_pos") != F.col("first_pos")
    is_root = F.col("pos") == F.col("root_pos")
    is_first = F.col("pos") == F.col("first_pos")
    ahead = F.col("pos") - F.col("first_pos")
    out = staged(out, "headed")
    discard(keys)
    if window_s > WINDOW_S:
        # All untimed matches are one chain here, of many sources, and may be most of all:
        # the cascades that need it are sorted together, and each counts from its first.
        untimed = F.col("_when.ts_sec").isNull()
        place = F.when(is_first, F.col("root_pos")).otherwise(F.col("pos"))
        again = out.where(swapped & ~is_root).select("chain_seq", "pos", untimed.cast("int").alias("_untimed"), F.coalesce("_when.ts_sec", F.lit(0)).alias("_s"), F.coalesce("_when.ts_nano", F.lit(0)).alias("_n"), F.when(untimed, F.col("_when.untimed")).otherwise(0).alias("_l"), place.alias("_place"))
        order = [F.col(c) for c in ("chain_seq", "_untimed", "_s", "_n", "_l", "_place", "pos")]
        again = with_previous(in_ranges(staged(again, "resorted"), order, bucket_rows), [BUCKET], order, F.col("chain_seq"), position="_at")
        again = staged(again.select(BUCKET, "pos", "_at", F.when(F.col("prev").isNull() | (F.col("prev") != F.col("chain_seq")), F.col("_at")).alias("_start")), "places")
        again = with_last(again, [BUCKET], [F.col("_at")], F.col("_start"), "_first")
        again = again.select("pos", (F.col("_at") - F.col("_first") + 1).alias("_again"))
        out = out.join(again, "pos", "left").withColumn("_k", F.coalesce("_again", ahead))
    else:
        # Positions follow from the order of all matches: those between the first match and
        # the root move up by one, but those that equal the first, which stand behind it and
        # let it pass.
        tie = F.col("_when").eqNullSafe(F.col("when"))
        between = swapped & (F.col("pos") > F.col("first_pos")) & (F.col("pos") < F.col("root_pos"))
        ties = out.where(between & tie).groupBy(F.col("first_pos").alias("pos")).agg(F.count(F.lit(1)).alias("_ties"))
        out = out.join(ties, "pos", "left")
        place = F.when(is_first, 1 + F.coalesce("_ties", F.lit(0))).when(between & ~tie, ahead + 1).otherwise(ahead)
        out = out.withColumn("_k", F.when(swapped, place).otherwise(ahead))
    out = out.select("pos", "id", F.when(is_root, "root").otherwise("cascade").alias("role"), F.when(~is_root, F.col("_k")).cast("long").alias("cascade_pos"))
    return rows.join(out, "pos")


def cascade_preview(members: DataFrame, n: int = 5) -> DataFrame:
    """The first ``n`` of each cascade with the number of others."""
    sizes = members.groupBy("id").agg(F.count("cascade_pos").alias("cascade_size"))
    shown = members.where(F.col("cascade_pos") <= n)
    return shown.join(sizes, "id").withColumn("more", F.greatest(F.col("cascade_size") - n, F.lit(0)))


def chain_page(chains: DataFrame, offset: int = 0, limit: int = 20) -> DataFrame:
    return chains.where((F.col("id") > offset) & (F.col("id") <= offset + limit))


def member_page(members: DataFrame, chain_id: int, offset: int = 0, limit: int = 10) -> DataFrame:
    """Cascade rows of one chain with the number of those after the page."""
    rows = members.where((F.col("id") == chain_id) & F.col("cascade_pos").isNotNull())
    size = rows.groupBy("id").agg(F.count(F.lit(1)).alias("cascade_size"))
    page = rows.where((F.col("cascade_pos") > offset) & (F.col("cascade_pos") <= offset + limit))
    return page.join(size, "id").withColumn("remaining", F.greatest(F.col("cascade_size") - (offset + limit), F.lit(0)))
