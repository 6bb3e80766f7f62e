import os
import re
import subprocess
import sys
from collections import defaultdict

from pyspark.sql import functions as F

from faultweave.llm import mixing
from faultweave.llm.mixing import mix

from conftest_text import filler


def shares(sizes, weights=(5, 2, 1), share=1.5, most=2.0):
    """Sharing out round by round, as it is told."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: [ord(c) for c in s]) + [None] * (None in sizes)
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    out, left, open_ = {}, share * sum(sizes.values()), set(names)
    while open_:
        level = left / sum(w[s] for s in open_)
        over = [s for s in open_ if level * w[s] > most * sizes[s]]
        if not over:
            out |= {s: level * w[s] for s in open_}
            break
        for s in over:
            out[s] = most * sizes[s]
            left -= out[s]
            open_.remove(s)
    return out


def check(docs, rows):
    out = mix(docs).collect()
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0d]+", t or ""))
    sizes = defaultdict(int)
    for r in rows:
        sizes[r[2] if len(r) > 2 else "s"] += size(r[1])
    assert sorted((str(r.doc_id), r.size) for r in out) == sorted((str(r[0]), size(r[1])) for r in rows)
    want, taken = shares(dict(sizes)), defaultdict(int)
    for r in out:
        assert r.source_size == sizes[r.source] and abs(r.target - want[r.source]) < 1e-6 * max(1, want[r.source])
        assert 0 <= r.taken <= 2 * r.size and r.taken >= r.epochs * r.size
        taken[r.source] += r.taken
    assert all(abs(taken[s] - want[s]) <= 1 for s in sizes)
    return out


def test_targets_and_reruns(docs_of, monkeypatch):
    monkeypatch.setattr(mixing, "BUCKET_ROWS", 7)
    sources = ["hot"] * 6 + ["b", "B", "é", None]
    rows = [(i, filler(i, 5 + i % 40), sources[i % 10]) for i in range(300)]
    docs = docs_of(rows)
    key = lambda r: (r.doc_id, r.taken, r.sample_key)
    assert sorted(map(key, check(docs, rows))) == sorted(map(key, mix(docs.repartition(7)).collect()))


def test_small_keys_first(docs_of):
    rows = [(i, filler(i, 20), s) for s, n in (("a", 50), ("z", 400)) for i in range(n)]
    for source in "az":
        out = sorted((r for r in check(docs_of(rows), rows) if r.source == source), key=lambda r: r.sample_key)
        more = [r.taken - r.epochs * r.size for r in out]
        full = [m == r.size for m, r in zip(more, out, strict=True)]
        assert full == sorted(full, reverse=True) and sum(0 < m < r.size for m, r in zip(more, out, strict=True)) <= 1


def test_odd_rows(docs_of, odd_rows):
    docs = docs_of(odd_rows)
    check(docs, odd_rows)
    assert mix(docs.limit(0)).count() == 0
    assert [r.taken for r in mix(docs_of([(1, None), (2, "")])).collect()] == [0, 0]


def test_weights_and_clashing_columns(docs_of):
    rows = [(i, filler(i, 20)) for i in range(600)]
    docs = docs_of(rows).withColumnsRenamed({"key": "tie", "n_chars": "Size"}).withColumn("good", (F.col("doc_id") % 2) * 0.9 + 0.05)
    out = mix(docs.withColumn("rest", F.lit(1)), share=0.5, weight=F.col("good"), keep=("tie", "Size", "rest"))
    assert out.columns == ["doc_id", "source", "tie", "rest", "size", "source_size", "target", "taken", "epochs", "sample_key"]
    taken = {k: sum(r.taken > 0 for r in out.collect() if r.doc_id % 2 == k) for k in (0, 1)}
    assert taken[1] > 3 * taken[0] > 0
    assert mix(docs, weight=F.lit(None)).where("taken is null").count() == 0


def test_word_count(docs_of):
    rows = [(1, None), (2, ""), (3, " \t\n\x0b\x0c\r"), (4, "a"), (5, " x\x1cy\x85z    \U0001f600$1\\ \r\n"), (6, "ä\x00b "), (7, "\n" * 50_000 + "one two" + " " * 50_000)]
    out = docs_of(rows).select("doc_id", mixing.word_count(F.col("text")).alias("n")).collect()
    assert {r.doc_id: r.n for r in out} == {i: len(re.findall(r"[^\x20\x09-\x0d]+", t or "")) for i, t in rows}


def test_long_text_of_short_words(tmp_path):
    """Ten million words in one text of 20 MB, with a heap of 600 MB."""
    code = """
from pyspark.sql import SparkSession
from faultweave.llm.mixing import mix
spark = SparkSession.builder.master("local[1]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "2").getOrCreate()
docs = spark.range(1).selectExpr("id AS doc_id", "repeat(concat(id, ' b '), 5000000) AS text", "'s' AS source")
print("size", mix(docs).first()["size"])
"""
    env = os.environ | {"PYSPARK_SUBMIT_ARGS": "--driver-memory 600m pyspark-shell", "TMPDIR": str(tmp_path)}
    ran = subprocess.run([sys.executable, "-c", code], env=env, cwd=tmp_path, capture_output=True, text=True, timeout=250)
    assert "size 10000000" in ran.stdout, ran.stderr[-2000:]
