import random

import duckdb
import pytest

from faultweave.functions.patterns import DEFAULT_PATTERNS, Pattern
from faultweave.operators.match import match_lines, match_lines_table, patterns_table
from faultweave.operators.pattern_index import pattern_index, prepared
from faultweave.plans.queries import QUERIES, SQL

from test_match import TRUTH, lines


def rows(df):
    return sorted((r.line_num, r.line, r.pattern, r.category_rank, r.severity_rank, r.causal_weight, tuple(r.submatch or ()), r.ts_sec) for r in df.collect())


def test_default_list(spark):
    df = lines(spark, [t for t, _ in TRUTH] + ["2024-01-15T10:30:01Z ERROR broken pipe"])
    table = patterns_table(spark).repartition(3)
    for prefilter in (True, False):
        got = match_lines_table(df, table, prefilter)
        assert rows(got) == rows(match_lines(df, literal_prefilter=prefilter))
        assert set(got.columns) == set(match_lines(df).columns)


def many(seed, n):
    """Patterns that share pieces, some short, some without literals, some with groups."""
    dice = random.Random(seed)
    words = ["disk", "net", "日", "日本語", "abc", "ab", "timeout", "ét", "node-17", "x" * 9]
    out = []
    for i in range(n):
        a, b = dice.choice(words), dice.choice(words)
        regex = dice.choice((f"{a} {b}", f"(?i){a}.*{b}", f"{a} (\\d+)|{b}!", f"({a}|{b}) {i % 7}", r"\d\d" + str(i % 9), f"{a}{i}"))
        out.append(Pattern(f"p{i}", dice.choice(("Panic", "Network", "Disk I/O")), dice.choice(("WARN", "FATAL")), regex))
    return out, words


@pytest.mark.parametrize("n", [1, 60])
def test_equals_the_list(spark, n):
    patterns, words = many(n, n)
    dice = random.Random(5)
    texts = [" ".join(dice.choice((*words, "DISK", "Net", str(dice.randrange(400)), "!")) for _ in range(dice.randrange(9))) for _ in range(300)]
    df = lines(spark, [*texts, None, "", "disk " * 20_000 + "node-17399"])
    assert rows(match_lines_table(df, patterns_table(spark, patterns))) == rows(match_lines(df, patterns))


def test_index_and_odd_tables(spark):
    patterns = [Pattern("a", "Panic", "WARN", "common one|common two"), Pattern("b", "Panic", "WARN", "common"), Pattern("c", "Panic", "WARN", "abc"), Pattern("d", "Panic", "WARN", r"\d")]
    found = {(r.literal, r.gram) for r in pattern_index(prepared(patterns_table(spark, patterns))).collect()}
    assert {x for x, _ in found} == {"common one", "common two", "common", "abc"} and ("abc", "abc") in found and ("common", "common") in found
    assert dict(found)["common one"] in "ommon one" and all(g in x for x, g in found)
    df = lines(spark, ["a common one", "abcommon", "7", "abc 7", "none"])
    empty = patterns_table(spark, patterns).limit(0)
    assert match_lines_table(df, empty).collect() == [] and match_lines_table(df, patterns_table(spark, patterns[3:])).count() == 2
    # Equal priorities go by name, and the table's own numbers stay.
    table = spark.createDataFrame([(7, "z", "Panic", "WARN", "abc"), (7, "y", "Panic", "WARN", r"\d"), (9, "x", "Panic", "WARN", "common")], "priority int, name string, category string, severity string, regex string")
    assert sorted((r.line_num, r.priority, r.pattern) for r in match_lines_table(df, table).collect()) == [(1, 9, "x"), (2, 7, "z"), (3, 7, "y"), (4, 7, "y")]
    with pytest.raises(Exception, match="unknown category"):
        match_lines_table(df, spark.createDataFrame([(1, "z", "Nothing", "WARN", "abc")], table.schema)).collect()


def test_no_pattern_in_the_plan(spark):
    found = match_lines_table(lines(spark, ["x"]), patterns_table(spark, DEFAULT_PATTERNS))
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "goroutine" not in plan and "Join" in plan


def shuffled(spark, run):
    """Rows that the shuffles of ``run`` write."""
    sc = spark.sparkContext
    context = sc._jsc.sc()

    def written():
        context.listenerBus().waitUntilEmpty(30_000)
        stages = context.statusStore().stageList(None, False, False, sc._gateway.new_array(sc._jvm.double, 0), sc._jvm.java.util.ArrayList())
        return {stages.apply(i).stageId(): stages.apply(i).shuffleWriteRecords() for i in range(stages.size())}

    before = written()
    run()
    return sum(n for stage, n in written().items() if stage not in before)


def test_lines_are_shuffled_by_few_runs(spark, monkeypatch):
    """With an index that is not small, lines go only where one of their runs is filed."""
    monkeypatch.setattr("faultweave.operators.pattern_index.MOST_ROWS", 0)
    patterns = [Pattern(f"p{i}", "Panic", "WARN", f"node {i:06d} is (down)") for i in range(40)] + [Pattern("short", "Network", "FATAL", "of [xy]"), Pattern("sevens", "Signal", "WARN", r"\b777\b")]
    df = lines(spark, [f"2024-01-15T08:00:00Z ERROR node {i:06d} is down, {i * 7919 % 100_000} of {i * 104_729 % 1_000_003} packets of its port are lost" for i in range(2_000)] + ["node 000003 is 777", "777 of x"])
    table = patterns_table(spark, patterns)
    assert rows(match_lines_table(df, table)) == rows(match_lines(df, patterns))
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert shuffled(spark, lambda: match_lines_table(df, table).collect()) < 20_000
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_equal_priority_and_name(spark):
    """Of rules with one priority and name only one that matches gives a row."""
    table = spark.createDataFrame([(1, "a", "Panic", "WARN", "abc"), (1, "a", "Network", "FATAL", "xyz (\\d)")], "priority int, name string, category string, severity string, regex string")
    found = match_lines_table(lines(spark, ["an abc", "an xyz 7", "abc xyz 8"]), table).collect()
    assert sorted((r.line_num, r.category, r.severity, r.submatch) for r in found) == [(1, "Panic", "WARN", None), (2, "Network", "FATAL", ["7"]), (3, "Panic", "WARN", None)]


#: Rules that share a priority, lines that share a number, keys of over nine characters, negative ones and nulls.
SHARED = """CREATE TABLE customer AS SELECT unnest([7, 7, 8, 250000, 1000000005, 1000000007, -5, NULL])::BIGINT AS c_custkey;
    CREATE TABLE part AS SELECT unnest([9, 9, 11, NULL])::BIGINT AS p_partkey;
    CREATE TABLE supplier AS SELECT unnest([1, 1, NULL])::BIGINT AS s_suppkey;
    CREATE TABLE orders AS SELECT a::BIGINT AS o_orderkey, b::BIGINT AS o_custkey, c AS o_orderstatus, d AS o_orderpriority, e::TIMESTAMP AS o_orderdate FROM (VALUES
        (600001, 250000, 'P', '2-HIGH', '1998-02-06'), (600002, 250000, 'F', '5-LOW', '1998-02-06'), (10077, 3, 'F', '2-HIGH', '1998-02-06'), (5, 7, 'P', '2-HIGH', '1998-02-06'), (5, 8, 'F', '2-HIGH', '1998-02-06'),
        (5, NULL, 'F', '2-HIGH', '1998-02-06'), (6, 7, 'P', '5-LOW', '1998-02-06'), (9, 3, 'F', '2-HIGH', '1998-02-06'), (11, 3, 'F', '2-HIGH', '1998-02-06'), (11, 7, 'P', '2-HIGH', '1998-02-06'), (12, 8, 'P', '5-LOW', '1998-02-06'),
        (700000, 1000000007, 'P', '2-HIGH', '1998-02-06'), (700001, -5, 'P', '2-HIGH', '1998-02-06'), (700002, NULL, 'P', '2-HIGH', '1998-02-06'), (NULL, 8, 'P', '2-HIGH', '1998-02-06'), (NULL, 8, 'P', '5-LOW', '1998-02-06'),
        (700003, 8, NULL, '2-HIGH', '1998-02-06'), (700004, 8, 'P', NULL, '1998-02-06'), (700005, 8, 'P', '5-LOW', NULL), (13, 4, 'F', '2-HIGH', '1998-02-06')) v(a, b, c, d, e)"""


@pytest.mark.parametrize("shared, small", [("all", True), ("all", False), ("rules", True), ("lines", True), ("none", True)])
def test_query_equals_sql_where_keys_are_shared(spark, tmp_path, monkeypatch, shared, small):
    if not small:
        monkeypatch.setattr("faultweave.operators.pattern_index.MOST_ROWS", 0)
    con = duckdb.connect()
    con.execute(SHARED)
    for table, key in (("customer", "c_custkey"), ("part", "p_partkey"), ("supplier", "s_suppkey"), ("orders", "o_orderkey")):
        if shared == "none" or (shared != "all" and (table == "orders") != (shared == "lines")):
            con.execute(f"CREATE OR REPLACE TABLE {table} AS SELECT DISTINCT ON ({key}) * FROM {table} WHERE {key} IS DISTINCT FROM 250000 ORDER BY ALL")
        con.execute(f"COPY {table} TO '{tmp_path}/{table}.parquet' (FORMAT parquet)")
    df = QUERIES["pattern_table_large"](spark, str(tmp_path))
    want = con.execute(SQL["pattern_table_large"])
    columns = [c[0] for c in want.description]
    key = lambda r: tuple(map(str, r))
    assert df.columns == columns and sorted((tuple(r) for r in df.collect()), key=key) == (rows := sorted(want.fetchall(), key=key))
    assert len(rows) > len({r[0] for r in rows}) or shared == "none"
