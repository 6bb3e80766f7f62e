from datetime import datetime, timezone

from faultweave.functions.timestamps import with_log_time


def at(*parts):
    return int(datetime(*parts, tzinfo=timezone.utc).timestamp())


T = at(2024, 1, 15, 10, 30, 1)
NONE = (None, None)
TABLE = [
    ("2024-01-15T10:30:01Z x", (T, 0)), ("2024-01-15T10:30:01.123456789Z x", (T, 123456789)), ("2024-01-15T10:30:01,5Z x", (T, 500000000)),
    ("2024-01-15T10:30:01.1234567891Z x", (T, 123456789)), ("2024-01-15T10:30:01+05:30 x", (at(2024, 1, 15, 5, 0, 1), 0)), ("2024-01-15T10:30:01-05:30 x", (at(2024, 1, 15, 16, 0, 1), 0)),
    ("2024-01-15T10:30:01+0530 x", NONE), ("2024-01-15T10:30:01 x", (T, 0)), ("2024-01-15 10:30:01 x", (T, 0)), ("2024/01/15 10:30:01 x", (T, 0)),
    ("2024-01-15 10:30:01,123 x", (T, 123000000)), ("2024-01-15 10:30:01.123456 x", (T, 123456000)), ("2024-01-15 10:30:01Z x", NONE), ("2024/01/15T10:30:01 x", NONE),
    ("2024-01/15 10:30:01 x", NONE), ("2024-01-15 10:30:01 +0000 x", (T, 0)), ("2024-01-15 10:30:01, x", NONE), ("2024-01-15 10:30:015 x", NONE),
    ("2024-02-30T10:30:01Z x", NONE), ("2024-01-15T24:00:00Z x", NONE), ("2024-01-15T10:30:60Z x", NONE), ("Jan 15 10:30:01 host x", (-62165971799, 0)),
    ("Jan  5 10:30:01 host x", (-62165971799 - 10 * 86400, 0)), ("Feb 29 10:30:01 x", (-62165971799 + 45 * 86400, 0)), ("Foo 15 10:30:01 x", NONE), ("Jan\t15 10:30:01 x", NONE),
    ("15/Jan/2024:10:30:01 +0000 x", (T, 0)), (" 2024-01-15T10:30:01Z", NONE), ("[2024-01-15T10:30:01Z] x", NONE), ("0001-01-01T00:00:00Z x", NONE),
    ("0001-01-01T00:00:00.5Z x", (-62135596800, 500000000)), ("2024-01-15T10:30:01-05 x", (T, 0)), ("2024-01-15T10:30:01+25:00 x", NONE), ("", NONE), (None, NONE),
]


def test_table(spark):
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(TABLE)], "i int, line string")
    rows = with_log_time(df).select("i", "ts_sec", "ts_nano").orderBy("i").collect()
    assert [(TABLE[r.i][0], (r.ts_sec, r.ts_nano)) for r in rows] == TABLE


def test_display_column(spark):
    df = spark.createDataFrame([("2024-01-15T10:30:01.5Z x",), ("Jan 15 10:30:01 x",)], "line string")
    rows = with_log_time(df).selectExpr("unix_micros(ts) AS us").collect()
    assert [r.us for r in rows] == [T * 10**6 + 500000, None]
