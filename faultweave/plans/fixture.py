"""Log lines derived from the table ``events``, alike in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Messages of error events, in turn. No message holds a single quote.
MESSAGES = (
    "Out of memory: killed process 42 (sorter)",
    "memory cgroup out of memory: Kill process 42",
    "memory cgroup out of memory",
    "out of memory kill 5",
    "OOMKilled box a of b",
    "java.lang.OutOfMemoryError: Java heap space",
    "connection timed out at a:1",
    "connection timeout",
    "request timed out",
    "request timeout",
    "read tcp a->b: i/o timeout",
    "read tcp a->b: timeout",
    "context canceled i/o timeout",
    "context deadline exceeded",
    "HTTP timeout",
    "deadlock detected among 7 writers",
    "Lock wait timeout exceeded after 50 s",
    "could not obtain lock on a row of x",
    "lock on row (id=1)",
    "fatal error: x",
    "nonfatal error: x",
    "goroutine 12 [running]:",
    "KeyError: x",
    "unhandledPromiseRejection",
    "signal: aborted",
    "SIGTERM: leaving",
    "signal: killed",
    "core dumped",
    "no space left on device",
    "x EIO y",
    "EIOx",
    "too many open files",
    "connection refused to store1:7000",
    "dns says NXDOMAIN for a",
    "no route to host",
    "broken pipe",
)
START = "2024-01-15 08:00:00"


def log_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``source, line_num, line``: a line for each event, its time a second after the one
    before, in a form that changes from event to event; errors carry a message."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "user_id", "event_type")
    t = F.timestamp_add("SECOND", F.col("event_id"), F.to_timestamp_ntz(F.lit(START)))
    form = F.col("event_id") % 11

    def stamp(pattern: str):
        return F.date_format(t, pattern)

    head = (
        F.when(form < 5, stamp("yyyy-MM-dd'T'HH:mm:ss'Z'"))
        .when(form == 5, stamp("yyyy/MM/dd HH:mm:ss"))
        .when(form == 6, F.lit("-"))
        .when(form == 7, F.concat(stamp("yyyy-MM-dd HH:mm:ss"), F.lit(",250")))
        .when(form == 8, stamp("MMM dd HH:mm:ss"))
        .when(form == 9, stamp("dd/MMM/yyyy:HH:mm:ss"))
        .otherwise(F.concat(stamp("yyyy-MM-dd'T'HH:mm:ss"), F.lit("+05:30")))
    )
    message = F.get(F.array(*map(F.lit, MESSAGES)), (F.col("event_id") % len(MESSAGES)).cast("int"))
    body = F.when(F.col("event_type") == "error", F.concat(F.lit(" ERROR "), message)).otherwise(F.concat(F.lit(" INFO "), F.col("event_type")))
    return e.select(F.concat(F.lit("svc-"), (F.col("user_id") % 8).cast("string"), F.lit(".log")).alias("source"), (F.col("event_id") + 1).alias("line_num"), F.concat(head, body).alias("line"))


def log_lines_sql() -> str:
    messages = ", ".join(f"'{m}'" for m in MESSAGES)
    return f"""
        SELECT 'svc-' || (user_id % 8) || '.log' AS source, event_id + 1 AS line_num,
               CASE WHEN f < 5 THEN strftime(t, '%Y-%m-%dT%H:%M:%SZ') WHEN f = 5 THEN strftime(t, '%Y/%m/%d %H:%M:%S') WHEN f = 6 THEN '-'
                    WHEN f = 7 THEN strftime(t, '%Y-%m-%d %H:%M:%S') || ',250' WHEN f = 8 THEN strftime(t, '%b %d %H:%M:%S')
                    WHEN f = 9 THEN strftime(t, '%d/%b/%Y:%H:%M:%S') ELSE strftime(t, '%Y-%m-%dT%H:%M:%S') || '+05:30' END
               || CASE WHEN event_type = 'error' THEN ' ERROR ' || list_extract([{messages}], (event_id % {len(MESSAGES)})::INT + 1) ELSE ' INFO ' || event_type END AS line
        FROM (SELECT *, event_id % 11 AS f, TIMESTAMP '{START}' + to_seconds(event_id) AS t FROM events)"""


#: What is added to the log lines that arrive as files: a match that ends all windows of
#: time, in a file of its own, and behind it one that comes too late.
END = "9999-12-31T23:59:59Z ERROR broken pipe"
LATE = "2024-01-15T08:00:00Z ERROR broken pipe"


def arriving(spark: SparkSession, sf_dir: str, folder: str, part: int, parts: int = 3) -> None:
    """Add one of ``parts`` of the log lines, in order of time, to ``folder`` as files by
    source; part ``parts`` is the end, the next one the late line."""
    if part < parts:
        lines = log_lines(spark, sf_dir)
        most = lines.agg(F.max("line_num")).first()[0] or 0
        mine = lines.where(F.floor((F.col("line_num") - 1) * parts / most) == part)
        rows = mine.repartition("source").sortWithinPartitions("source", "line_num").select("source", F.col("line").alias("value"))
    else:
        rows = spark.createDataFrame([("end.log", END if part == parts else LATE)], "source string, value string")
    rows.write.mode("append").partitionBy("source").text(folder)


def _nine(number: Column) -> Column:
    """A number in nine characters: cut behind them if it is longer, as SQL's ``lpad`` does."""
    return F.lpad(number.cast("string"), 9, "0")


def _text(*parts: str | Column) -> Column:
    """The parts one after the other; null if one of them is."""
    return F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])


def order_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A log line for each order; without text if a part of it is null."""
    o = spark.read.parquet(f"{sf_dir}/orders.parquet")
    line = _text(F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss"), "Z ERROR order ", o.o_orderkey, " of Customer#", _nine(o.o_custkey), " is ", o.o_orderstatus, ", ", o.o_orderpriority)
    return o.select(F.lit("orders").alias("source"), F.col("o_orderkey").alias("line_num"), line.alias("line"))


def rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Patterns, some for each customer, part and supplier, and one without a literal. A row
    without a key has none."""

    def of(table: str, key: str, first: int, name: str, category: str, severity: str, regex) -> DataFrame:
        rows = spark.read.parquet(f"{sf_dir}/{table}.parquet")
        number = F.col(key)
        rows = rows.where(number.isNotNull())
        return rows.select((number * 4 + first).alias("priority"), _text(f"{name}_", number).alias("name"), F.lit(category).alias("category"), F.lit(severity).alias("severity"), regex(number).alias("regex"))

    return (
        of("customer", "c_custkey", 1_000_000, "open", "DB Lock", "ERROR", lambda n: _text(r"(?i)order (\d+) of customer#", _nine(n), " is [ep]"))
        .unionByName(of("customer", "c_custkey", 1_000_003, "low", "Timeout", "WARN", lambda n: _text("Customer#", _nine(n), r" is (\w), \d-LOW")))
        .unionByName(of("part", "p_partkey", 2, "part", "Disk I/O", "FATAL", lambda n: _text("order ", n, " of (C)")))
        .unionByName(of("supplier", "s_suppkey", 1, "supplier", "Network", "CRITICAL", lambda n: _text("Supplier#", _nine(n), " (refused)")))
        .unionByName(spark.sql(r"SELECT 2000000 AS priority, 'sevens' AS name, 'Signal' AS category, 'WARN' AS severity, r'\b\d{3}77\b' AS regex"))
    )


#: The same in SQL, each rule with the text that a line has to hold, and each line with
#: those of the texts that it holds.
RULES_SQL = r"""order_lines AS (SELECT o_orderkey AS line_num, strftime(o_orderdate, '%Y-%m-%dT%H:%M:%SZ') || ' ERROR order ' || o_orderkey || ' of Customer#' || lpad(o_custkey::VARCHAR, 9, '0') || ' is ' || o_orderstatus || ', ' || o_orderpriority AS line,
        ['order ' || o_orderkey || ' of ', ' of customer#' || lpad(o_custkey::VARCHAR, 9, '0') || ' is ', 'customer#' || lpad(o_custkey::VARCHAR, 9, '0') || ' is '] AS texts FROM orders),
    rules AS (SELECT c_custkey * 4 + 1000000 AS priority, 'open_' || c_custkey AS name, 'DB Lock' AS category, 'ERROR' AS severity, '(?i)order (\d+) of customer#' || lpad(c_custkey::VARCHAR, 9, '0') || ' is [ep]' AS regex, ' of customer#' || lpad(c_custkey::VARCHAR, 9, '0') || ' is ' AS literal FROM customer
    UNION ALL SELECT c_custkey * 4 + 1000003, 'low_' || c_custkey, 'Timeout', 'WARN', 'Customer#' || lpad(c_custkey::VARCHAR, 9, '0') || ' is (\w), \d-LOW', 'customer#' || lpad(c_custkey::VARCHAR, 9, '0') || ' is ' FROM customer
    UNION ALL SELECT p_partkey * 4 + 2, 'part_' || p_partkey, 'Disk I/O', 'FATAL', 'order ' || p_partkey || ' of (C)', 'order ' || p_partkey || ' of ' FROM part
    UNION ALL SELECT s_suppkey * 4 + 1, 'supplier_' || s_suppkey, 'Network', 'CRITICAL', 'Supplier#' || lpad(s_suppkey::VARCHAR, 9, '0') || ' (refused)', 'supplier#' || lpad(s_suppkey::VARCHAR, 9, '0') || ' ' FROM supplier
    UNION ALL SELECT 2000000, 'sevens', 'Signal', 'WARN', '\b\d{3}77\b', NULL)"""


#: Heads that are nearly times, or times of an odd form: what stands before the clock,
#: what behind it, and in SQL the seconds and nanoseconds that it is; ``t`` is the event's
#: time and ``s`` the second of its day.
ODD_TIMES = (
    ("'2024-02-30T'", "'Z'", "NULL", "NULL"),
    ("'Feb 29 '", "' host'", "-62167219200 + 59 * 86400 + s", "0"),
    ("'2024-01-15T'", "'+0530'", "NULL", "NULL"),
    ("'2024-01-15 '", "', x'", "NULL", "NULL"),
    ("'2024-01-15 '", "'Z'", "NULL", "NULL"),
    ("'2024-01/15 '", "''", "NULL", "NULL"),
    ("'2024/01/15T'", "''", "NULL", "NULL"),
    ("'2024-01-15T'", "'.123456789123Z'", "1705276800 + s", "123456789"),
    ("'2024-01-15T'", "',5-14:00'", "1705276800 + s + 50400", "500000000"),
    ("'2024-01-15T'", "'-25:00'", "NULL", "NULL"),
    ("'Foo 15 '", "''", "NULL", "NULL"),
    ("'Jan	15 '", "''", "NULL", "NULL"),
    ("'Jan  5 '", "''", "-62167219200 + 4 * 86400 + s", "0"),
    ("'2024-01-15T'", "'5Z'", "NULL", "NULL"),
    ("'29/Feb/2023:'", "''", "NULL", "NULL"),
    ("'[2024-01-15 '", "']'", "NULL", "NULL"),
    ("'2024-01-15 '", "' +0000'", "1705276800 + s", "0"),
)


def odd_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``event_id, line``: the forms of ``ODD_TIMES`` in turn, every fifth clock of which
    has a second of 60."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "ts")
    clock = F.when(F.col("event_id") % 5 == 0, F.concat(F.date_format("ts", "HH:mm"), F.lit(":60"))).otherwise(F.date_format("ts", "HH:mm:ss"))

    def of(at: int) -> Column:
        return F.get(F.array(*[F.lit(x[at][1:-1]) for x in ODD_TIMES]), (F.col("event_id") % len(ODD_TIMES)).cast("int"))

    return e.select("event_id", F.concat(of(0), clock, of(1)).alias("line"))


ODD_TIMES_SQL = f"""SELECT event_id, CASE WHEN event_id % 5 > 0 THEN CASE event_id % {len(ODD_TIMES)} {" ".join(f"WHEN {i} THEN {x[2]}" for i, x in enumerate(ODD_TIMES))} END END::BIGINT AS ts_sec,
    CASE WHEN event_id % 5 > 0 THEN CASE event_id % {len(ODD_TIMES)} {" ".join(f"WHEN {i} THEN {x[3]}" for i, x in enumerate(ODD_TIMES))} END END::INT AS ts_nano
    FROM (SELECT event_id, date_part('hour', ts) * 3600 + date_part('minute', ts) * 60 + date_part('second', ts) AS s FROM events)"""


#: Regexes in which it is not plain what a line must contain.
ODD_RULES = (
    r"(abc|def)xyz", r"ab|longer", r"(?i)^Start\.end$", r"\d+", r"[abc]def(ghijkl)mn", r"a\(b\)c|x{3}yz", r"(a[)]b)cde", r"(?:^|\s)^twice", r"one(two(three)four)five|six", r"[^\]]tail of set",
    r"back\\slash|\tTab", r"été|日", r"(?i)(?:^|\s)MixedCase: \w+$", r"equal|EQUAL|same5", r"price \$5\.00", r"a+bc*def?ghi", r")odd(|paren", r"\.\.\.", r"end$|$", r"[open set",
)


def literal_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``name, regex``: the rules for orders, the default patterns and odd ones."""
    from ..functions.patterns import DEFAULT_PATTERNS

    fixed = [(p.name, p.regex) for p in DEFAULT_PATTERNS] + [(f"odd_{i}", r) for i, r in enumerate(ODD_RULES)]
    return rules(spark, sf_dir).select("name", "regex").unionByName(spark.createDataFrame(fixed, "name string, regex string"))


def literals_sql() -> str:
    """What a line must contain, read off each regex character by character. ``depth``:
    open groups, in which nothing counts; ``mode``: 1 behind a backslash, 2 in a set; ``run``:
    the plain characters since the last that was not; ``best``: the longest run."""
    from ..functions.patterns import DEFAULT_PATTERNS

    def q(text: str) -> str:
        return "'" + text.replace("'", "''") + "'"

    fixed = ", ".join(f"({q(n)}, {q(r)})" for n, r in [(p.name, p.regex) for p in DEFAULT_PATTERNS] + [(f"odd_{i}", r) for i, r in enumerate(ODD_RULES)])

    def without(head: str, column: str) -> str:
        return f"CASE WHEN starts_with({column}, {q(head)}) THEN substr({column}, {len(head) + 1}) ELSE {column} END"

    return f"""WITH RECURSIVE {RULES_SQL}, every AS (SELECT name, regex FROM rules UNION ALL SELECT * FROM (VALUES {fixed}) f(name, regex)),
    h1 AS (SELECT name, {without("(?i)", "regex")} AS x FROM every), h2 AS (SELECT name, {without("(?:^|" + chr(92) + "s)", "x")} AS x FROM h1), h3 AS (SELECT name, {without("^", "x")} AS x FROM h2),
    whole AS (SELECT name, CASE WHEN suffix(x, '$') THEN substr(x, 1, length(x) - 1) ELSE x END AS x FROM h3),
    parts AS (SELECT name, unnest(string_split(x, '|')) AS part, generate_subscripts(string_split(x, '|'), 1) AS n FROM whole),
    steps AS (SELECT name, n, part AS rest, 0 AS depth, 0 AS mode, false AS grouped, '' AS run, '' AS best FROM parts
        UNION ALL SELECT name, n, substr(rest, 2),
            CASE WHEN depth > 0 AND c = '(' THEN depth + 1 WHEN depth > 0 AND c = ')' THEN depth - 1 WHEN depth = 0 AND mode = 0 AND c = '(' THEN 1 ELSE depth END,
            CASE WHEN mode = 1 THEN 0 WHEN mode = 2 AND c <> ']' THEN 2 WHEN mode = 2 THEN 0 WHEN c = chr(92) AND length(rest) > 1 THEN 1 WHEN c = '[' THEN 2 ELSE 0 END,
            CASE WHEN mode = 0 THEN depth > 0 ELSE grouped END,
            CASE WHEN mode = 1 AND NOT grouped THEN CASE WHEN contains('sdwbSDWB', c) THEN '' ELSE run || c END
                WHEN mode > 0 OR depth > 0 OR (c = chr(92) AND length(rest) > 1) THEN run WHEN c = '[' OR contains('()*+?{{}}.^$', c) THEN '' ELSE run || c END,
            CASE WHEN length(run) > length(best) THEN run ELSE best END
        FROM (SELECT *, substr(rest, 1, 1) AS c FROM steps WHERE rest <> '')),
    ends AS (SELECT name, n, lower(CASE WHEN length(run) > length(best) THEN run ELSE best END) AS literal FROM steps WHERE rest = '')
    SELECT name, coalesce(string_agg(literal, '|' ORDER BY n) FILTER (strlen(literal) >= 3), '') AS literals FROM ends GROUP BY name"""
