import gzip

from pyspark.sql import functions as F

from faultweave.sources.files import dropped_lines, lines_from_table, read_logs


def test_exact_numbers_over_splits(spark, tmp_path):
    spark.conf.set("spark.sql.files.maxPartitionBytes", "100000")
    try:
        texts = {}
        for name, n in (("a.log", 20000), ("b.log", 7), ("empty.log", 0)):
            lines = [f"line {i} " + ("é" * (i % 40)) if i % 9 else "" for i in range(n)]
            ends = [b"\r\n" if i % 3 == 0 else b"\n" for i in range(n)]
            raw = b"".join(t.encode() + e for t, e in zip(lines, ends, strict=True))
            (tmp_path / name).write_bytes(raw if name != "b.log" else raw.rstrip(b"\r\n"))
            texts[name] = lines
        (tmp_path / "c.log").write_bytes(b"\xff\xfe bad\nok\n")
        (tmp_path / "d.log.gz").write_bytes(gzip.compress(b"x\ny\n"))
        got = {}
        for r in read_logs(spark, [str(tmp_path)]).collect():
            got.setdefault(r.source.rsplit("/", 1)[1], {})[r.line_num] = r.line
        assert got["a.log"] == dict(enumerate(texts["a.log"], 1))
        assert got["b.log"] == dict(enumerate(texts["b.log"], 1))
        assert "empty.log" not in got and len(got["c.log"]) == 2 and got["d.log.gz"] == {1: "x", 2: "y"}
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_line_limit(spark, tmp_path):
    (tmp_path / "a.log").write_text("short\n" + "x" * 50 + "\n")
    assert [r.line for r in read_logs(spark, str(tmp_path), 10).collect()] == ["short"]
    assert [r.dropped for r in dropped_lines(read_logs(spark, str(tmp_path)), 10).collect()] == [1]


def test_lines_from_table(spark):
    df = spark.createDataFrame([("a", "x\r\n\ny\n"), ("b", ""), ("c", None), ("d", "z")], "s string, t string")
    rows = lines_from_table(df, F.col("s"), F.col("t")).orderBy("source", "line_num").collect()
    assert [tuple(r) for r in rows] == [("a", 1, "x"), ("a", 2, ""), ("a", 3, "y"), ("d", 1, "z")]
