"""Streams against the same work on tables."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from faultweave.operators import chains as C
from faultweave.operators.match import match_lines
from faultweave.sources.files import LineNumbers, read_logs, stream_files
from faultweave.streaming.live import stream_chains, stream_counts, stream_matches
from faultweave.streaming.run import rows_of, run_available

TEXTS = ("ERROR broken pipe", "ERROR Cannot allocate memory", "ERROR deadlock detected", "INFO fine", "panic: x")


def lines_of(seed, n=240):
    """Lines of four sources, no two at one time, with pauses of all lengths; some have no
    time."""
    dice, at = random.Random(seed), datetime(2024, 1, 15, 23, 58)
    out = []
    for _ in range(n):
        at += timedelta(microseconds=dice.choice((1, 250_000, 4_999_999, 5_000_000, 5_000_001, 12_000_000)) + dice.randrange(3))
        head = at.strftime("%Y-%m-%dT%H:%M:%S.%fZ") if dice.random() < 0.95 else "-"
        out.append((f"s{dice.randrange(4)}", f"{head} {dice.choice(TEXTS)}"))
    return out


def put(folder, name, lines):
    for source in {s for s, _ in lines}:
        (folder / f"source={source}").mkdir(parents=True, exist_ok=True)
        (folder / f"source={source}" / name).write_text("".join(t + "\n" for s, t in lines if s == source))


def expected(spark, lines, window_s):
    rows = match_lines(spark.createDataFrame([(s, i, t) for i, (s, t) in enumerate(lines)], "source string, line_num long, line string"))
    chains = C.chain_summary(C.assign_chains(rows.where("ts IS NOT NULL"), window_s))
    return sorted((r.size, r.severity, r.category, r.root_source, r.root_line, r.root_pattern) for r in chains.collect())


@pytest.mark.parametrize(("partitions", "window_s"), [(1, 5.0), (5, 7.5)])
def test_chains_equal_those_of_tables(spark, tmp_path, partitions, window_s):
    """At any number of partitions, over a restart, with rows out of order and a late one."""
    lines = lines_of(partitions)
    folder = tmp_path / "in"
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", str(partitions))
    try:

        def run():
            found = stream_matches(stream_files(spark, str(folder)).select("source", "line"))
            stream = stream_chains(found, window_s, "30 seconds")
            return run_available(stream, str(tmp_path / "out")), stream

        parts = [lines[:100], lines[100:130], lines[130:], [("end", "2024-03-01T00:00:00Z broken pipe")], [("end", "2024-01-16T00:00:00Z panic: late")]]
        parts[1].reverse()
        late = []
        for i, part in enumerate(parts):
            put(folder, f"{i}.log", part)
            if i != 1:
                n, stream = run()
                late.append(n)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    got = rows_of(spark, str(tmp_path / "out"), stream.schema)
    assert late == [0, 0, 0, 1]
    assert sorted((r.size, r.severity, r.category, r.root_source, r.root_line, r.root_pattern) for r in got.collect()) == expected(spark, lines, window_s)


def test_chains_by_source(spark, tmp_path):
    lines = lines_of(7, 120)
    put(tmp_path / "in", "1.log", [*lines, *[(s, "2024-03-01T00:00:00Z broken pipe") for s in sorted({s for s, _ in lines})]])
    stream = stream_chains(stream_matches(stream_files(spark, str(tmp_path / "in")).select("source", "line")), by_source=True)
    run_available(stream, str(tmp_path / "out"))
    got = [(r.chain_key, r.size, r.category, r.root_line) for r in rows_of(spark, str(tmp_path / "out"), stream.schema).collect()]
    table = match_lines(spark.createDataFrame([(s, i, t) for i, (s, t) in enumerate(lines)], "source string, line_num long, line string"))
    want = [(r.chain_key, r.size, r.category, r.root_line) for r in stream_chains(table, by_source=True).collect()]
    assert sorted(got) == sorted(want) and len({k for k, *_ in got}) == 4
    for source in {s for s, _ in lines}:
        mine = [x for x in lines if x[0] == source]
        assert sorted((size, c, line) for k, size, c, line in got if k == source) == sorted((size, c, line) for size, _, c, _, line, _ in expected(spark, mine, 5.0))


def test_counts_of_a_stream(spark, tmp_path):
    lines = lines_of(8)
    put(tmp_path / "in", "1.log", [*lines, ("end", "2024-03-01T00:00:00Z broken pipe")])
    matches = stream_matches(stream_files(spark, str(tmp_path / "in")).select("source", "line"))
    stream = stream_counts(matches, watermark="1 second")
    run_available(stream, str(tmp_path / "out"))
    table = match_lines(spark.createDataFrame([(s, i, t) for i, (s, t) in enumerate(lines)], "source string, line_num long, line string"))
    assert sorted(map(tuple, rows_of(spark, str(tmp_path / "out"), stream.schema).collect())) == sorted(map(tuple, stream_counts(table).collect()))


def test_line_numbers_go_on(spark, tmp_path):
    """Files of two sources that arrive one by one have the numbers of one whole file."""
    folder, out, whole = tmp_path / "in", str(tmp_path / "out"), tmp_path / "whole"
    dice = random.Random(3)
    text = {"a": "", "b": ""}
    for i in range(3):
        for source in ("a", "b")[: 1 if i == 1 else 2]:
            lines = "".join(f"{source} {i} {k}" + dice.choice(("", "\r", " x" * 40)) + "\n" for k in range(dice.randrange(1, 400))) + "\n"
            put(folder, f"{i}.log", [(source, t) for t in lines[:-1].split("\n")])
            text[source] += lines
        if i != 1:
            LineNumbers(out).run_available(stream_files(spark, str(folder), 1))
    whole.mkdir()
    for source, all_ in text.items():
        (whole / f"{source}.log").write_text(all_)
    want = read_logs(spark, str(whole)).withColumn("source", F.regexp_extract("source", r"(\w)\.log", 1))
    assert sorted(map(tuple, LineNumbers(out).table(spark).collect())) == sorted(map(tuple, want.collect()))


def test_a_batch_that_is_run_again(spark, tmp_path):
    """It starts from the numbers before it and replaces its rows."""
    numbers = LineNumbers(str(tmp_path))
    rows = spark.createDataFrame([("a", t, 1, "p", 0) for t in ("x", "y", "z")], "source string, line string, _time int, _path string, _block long").coalesce(1)
    for batch in (0, 1, 1, 2, 2):
        numbers(rows if batch != 1 else rows.limit(2), batch)
    assert sorted(map(tuple, numbers.table(spark).collect())) == [("a", i, t) for i, t in enumerate("xyzxyxyz", 1)]
    assert spark.read.parquet(f"{tmp_path}/numbers/batch=2").collect()[0]["last"] == 8
