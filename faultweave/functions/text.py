"""Display forms of lines, counts and times. Lengths are in characters."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def truncate_line(line: Column, n: int) -> Column:
    """At most ``n`` characters, the last three dots if cut."""
    return F.when(F.char_length(line) <= n, line).otherwise(F.concat(F.substring(line, 1, n - 3), F.lit("...")))


def clip_line(line: Column, n: int) -> Column:
    """The first ``n`` characters, and three dots if there were more."""
    return F.when(F.char_length(line) <= n, line).otherwise(F.concat(F.substring(line, 1, n), F.lit("...")))


def format_count(n: Column) -> Column:
    """Plain below 1,000, else one decimal and K, M or B; halves round up."""
    out = F.when(n < 1000, n.cast("string"))
    for limit, unit, mark in ((10**6, 10**3, "K"), (10**9, 10**6, "M"), (None, 10**9, "B")):
        tenths = F.call_function("div", n + unit // 20, F.lit(unit // 10))
        shown = F.concat(F.call_function("div", tenths, F.lit(10)).cast("string"), F.lit("."), (tenths % 10).cast("string"), F.lit(mark))
        out = out.when(n < limit, shown) if limit else out.otherwise(shown)
    return out


def location(source: Column, line_num: Column) -> Column:
    return F.concat_ws(":", source, line_num.cast("string"))


def span_ms(sec_from: Column, nano_from: Column, sec_to: Column, nano_to: Column) -> Column:
    """Whole milliseconds from one time to another, towards zero; may be negative."""
    return F.call_function("div", (sec_to - sec_from) * 1_000_000_000 + (nano_to - nano_from), F.lit(1_000_000)).cast("long")


def display_time(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd HH:mm:ss.SSS")
