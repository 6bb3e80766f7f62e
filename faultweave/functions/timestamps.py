"""Times at the head of log lines.

A head has one of three shapes, and all that the shape takes in must be a valid time:
ISO-like dates with ``-`` (``T`` or blank, a zone only after ``T``) or ``/`` (blank only),
a month name without a year, or ``dd/Mon/yyyy:time``. Without a zone times are UTC.
Times without a year lie in year 0. The zero time, 0001-01-01 00:00:00, is none.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The shapes, and what of them is a time.
ISO_SHAPE = r"^[0-9]{4}[-/][0-9]{2}[-/][0-9]{2}[T ][0-9]{2}:[0-9]{2}:[0-9]{2}[.,]?[0-9]*(?:Z|[+-][0-9]{2}:?[0-9]{2})?"
MONTH_SHAPE = r"^[A-Z][a-z]{2}[\t\n\f\r ]+[0-9]{1,2}[\t\n\f\r ]+[0-9]{2}:[0-9]{2}:[0-9]{2}"
SLASH_SHAPE = r"^[0-9]{2}/[A-Z][a-z]{2}/[0-9]{4}:[0-9]{2}:[0-9]{2}:[0-9]{2}"
MONTHS = "Jan01Feb02Mar03Apr04May05Jun06Jul07Aug08Sep09Oct10Nov11Dec12"
ZERO = -62135596800


def extract_ts_text(line: Column) -> Column:
    """The text of the line's head that has the shape of a time, or null. The first
    characters tell which shape it can be, so one regex at most is tried."""
    first = F.ascii(line)
    digit = (first >= ord("0")) & (first <= ord("9"))
    day_first = F.substring(line, 3, 1) == "/"

    def head(shape: str) -> Column:
        return F.nullif(F.regexp_extract(line, shape, 0), F.lit(""))

    return F.when(digit & day_first, head(SLASH_SHAPE)).when(digit, head(ISO_SHAPE)).when((first >= ord("A")) & (first <= ord("Z")), head(MONTH_SHAPE))


def _month(name: Column) -> Column:
    """Two digits. Only the first letter of a name is a capital, so it is found at its own
    place."""
    at = F.instr(F.lit(MONTHS), name)
    return F.when(at > 0, F.substring(F.lit(MONTHS), at + 3, F.lit(2)))


def _plain(t: Column) -> Column:
    """``yyyy-mm-dd hh:mm:ss`` of a head; the shape has proven where its digits are. Null
    where a name is no month or a day stands between other characters than blanks."""
    day = F.substring(t, F.lit(4), F.char_length(t) - 11)
    month_first = F.concat(F.lit("0000-"), _month(F.substring(t, 1, 3)), F.lit("-"), F.lpad(F.when(F.translate(day, " 0123456789", "") == "", F.trim(day)), 2, "0"), F.lit(" "), F.right(t, F.lit(8)))
    day_first = F.concat(F.substring(t, 8, 4), F.lit("-"), _month(F.substring(t, 4, 3)), F.lit("-"), F.substring(t, 1, 2), F.lit(" "), F.substring(t, 13, 8))
    return F.when(F.ascii(t) >= ord("A"), month_first).when(F.substring(t, 3, 1) == "/", day_first).otherwise(F.translate(F.substring(t, 1, 19), "/", "-"))


def _is_iso(t: Column) -> Column:
    return (F.ascii(t) < ord("A")) & (F.substring(t, 3, 1) != "/")


def _tail(t: Column) -> Column:
    """Of what follows the seconds: the fraction with its mark, and the zone."""
    x = F.substring(t, F.lit(20), F.char_length(t))
    sign = F.greatest(F.instr(x, F.lit("+")), F.instr(x, F.lit("-")))
    end = F.when(sign > 0, sign - 1).when(F.endswith(x, F.lit("Z")), F.char_length(x) - 1).otherwise(F.char_length(x))
    return F.when(_is_iso(t) & (x != ""), F.struct(F.substring(x, F.lit(1), end).alias("fraction"), F.substring(x, end + 1, F.lit(9)).alias("zone")))


def _valid(t: Column, tail: Column) -> Column:
    """What the shape of ISO-like heads takes in and is no time: two separators, a mark
    without digits or digits without a mark, a zone after a blank or without its colon."""
    fraction, zone = tail["fraction"], tail["zone"]
    same, is_t = F.substring(t, 5, 1) == F.substring(t, 8, 1), F.substring(t, 11, 1) == "T"
    marked = (fraction == "") | ((F.ascii(fraction) < ord("0")) & (F.char_length(fraction) > 1))
    zoned = zone.isin("", "Z") | ((F.substring(zone, 4, 1) == ":") & (F.substring(zone, 2, 2) <= "24") & (F.substring(zone, 5, 2) <= "60"))
    tail_valid = marked & ((zone == "") | is_t) & zoned
    return ~_is_iso(t) | (same & (~is_t | (F.substring(t, 5, 1) == "-")) & F.coalesce(tail_valid, F.lit(True)))


def with_log_time(df: DataFrame, line: str = "line") -> DataFrame:
    """Add ``ts_sec``, ``ts_nano`` (both null: no time) and ``ts`` (null before year 1).

    What several columns need is a generator's row, which is made once; as columns built on
    columns the steps would be copied into one another wherever a filter is pushed down.
    """
    t, tail, at = F.col("_head"), F.col("_tail"), F.col("_sec")
    zone = F.col("_tail.zone")
    offset = (F.substring(zone, 2, 2).cast("int") * 3600 + F.substring(zone, 5, 2).cast("int") * 60) * F.when(F.substring(zone, 1, 1) == "-", -1).otherwise(1)
    second = F.unix_seconds(F.concat(_plain(t), F.lit("Z")).try_cast("timestamp")) - F.when(F.char_length(zone) > 1, offset).otherwise(0)
    nano = F.coalesce(F.rpad(F.nullif(F.substring(F.col("_tail.fraction"), 2, 9), F.lit("")), 9, "0").cast("int"), F.lit(0))
    out = df.select("*", F.explode_outer(F.array(extract_ts_text(F.col(line)))).alias("_head"))
    out = out.select("*", F.explode_outer(F.array(_tail(t))).alias("_tail"))
    # The zero time is none.
    out = out.select("*", F.explode_outer(F.array(F.when(_valid(t, tail), F.struct(second.alias("s"), nano.alias("n"))))).alias("_time"))
    is_time = F.col("_time.s").isNotNull() & ((F.col("_time.s") != ZERO) | (F.col("_time.n") != 0))
    out = out.select("*", F.when(is_time, F.col("_time.s")).alias("_sec"), F.when(is_time, F.col("_time.n")).alias("_nano"))
    micros = at * 1_000_000 + F.call_function("div", F.col("_nano"), F.lit(1000))
    new = {"ts_sec": at, "ts_nano": F.col("_nano"), "ts": F.when(at >= ZERO, F.timestamp_micros(micros))}
    return out.withColumns(new).drop("_head", "_tail", "_time", "_sec", "_nano")
