import os
import re
from collections import defaultdict

import duckdb
import pytest

import __spark_entry__ as entry
import corpus_pipeline
from faultweave.llm import quality, queries

from test_line_dedup import brute as lines_of
from test_mixing import shares
from test_ngram_join import brute as groups_of

DATA = "/root/testdata/sf0.001"


def test_registered():
    names = list(entry.queries())
    assert "pipeline" in names and all(any(n.startswith(f"op{k}_") for n in names) for k in range(1, 11))
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "lines", "near_duplicates", "benchmark", "mix"]


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no data")
def test_stages_take_effect(spark, tmp_path):
    docs, sizes = spark.read.parquet(f"{DATA}/documents.parquet"), []
    columns = docs.columns
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, DATA)
        if name != "mix":
            assert out.columns == columns and out.dtypes == docs.dtypes
        out.write.parquet(str(tmp_path / str(k)))
        before, docs = docs, spark.read.parquet(str(tmp_path / str(k)))
        sizes.append(docs.count())
        ids = {r.doc_id for r in before.select("doc_id").collect()}
        assert {r.doc_id for r in docs.select("doc_id").collect()} <= ids
    assert sizes[0] <= 200 and sizes[0] == sizes[1] > sizes[2] > sizes[3] == sizes[4] > 100


def test_odd_rows(spark, docs_of, odd_rows, tmp_path):
    docs = docs_of(odd_rows)
    docs.select("doc_id", "text", "lang", "source", "n_chars").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(3, 1, 0), (2, 0, 0)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(1, None)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() >= 1


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no data")
@pytest.mark.parametrize("name", queries.ORACLE_SQL)
def test_against_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "benchmark", "labels"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    df, want = queries.queries()[name](spark, DATA), con.execute(queries.ORACLE_SQL[name])
    columns = [c[0] for c in want.description]
    assert sorted(columns) == sorted(df.columns)
    key = lambda r: tuple(map(str, r))
    assert sorted((tuple(r) for r in df.select(*columns).collect()), key=key) == sorted(want.fetchall(), key=key)


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no data")
def test_stages_by_brute_force(spark, tmp_path):
    """Each stage against a plain version of it, on what its predecessor kept."""
    stages, docs = dict(corpus_pipeline.STAGES), spark.read.parquet(f"{DATA}/documents.parquet")

    def through(name):
        nonlocal docs
        before = [(r.doc_id, r.text, r.source) for r in docs.collect()]
        stages[name](spark, docs, DATA).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        return before, docs.collect()

    before, after = through("quality")
    score = {r.doc_id: r.predicted for r in quality.quality_scores(spark.read.parquet(f"{DATA}/documents.parquet"), spark.read.parquet(f"{DATA}/labels.parquet")).collect()}
    assert sorted(r.doc_id for r in after) == sorted(i for i, _, _ in before if score[i])
    before, after = through("lines")
    assert sorted((str(r.doc_id), r.text) for r in after) == sorted(r[:2] for r in lines_of([b[:2] for b in before]))
    assert all(r.n_chars == len(r.text) for r in after)
    before, after = through("near_duplicates")
    heads = {i for i, group, _ in groups_of([b[:2] for b in before]) if i == group}
    assert {str(r.doc_id) for r in after} == heads and len(heads) < len(before)
    con = duckdb.connect()
    con.register("documents", docs.toArrow())
    con.execute(f"CREATE VIEW benchmark AS SELECT * FROM '{DATA}/benchmark.parquet'")
    held = {r[0] for r in con.execute(f"SELECT doc_id FROM ({queries.ORACLE_SQL['op3_decontamination']})").fetchall()}
    before, after = through("benchmark")
    assert held and {r.doc_id for r in after} == {i for i, _, _ in before} - held
    before, after = through("mix")
    sizes, taken = defaultdict(int), defaultdict(int)
    size = {i: len(re.findall(r"[^\x20\x09-\x0d]+", t or "")) for i, t, _ in before}
    for i, _, s in before:
        sizes[s] += size[i]
    want = shares(dict(sizes))
    for r in after:
        assert r.size == size[r.doc_id] and 0 <= r.taken <= 2 * r.size and abs(r.target - want[r.source]) < 1e-6 * max(1, r.target)
        taken[r.source] += r.taken
    assert len(after) == len(before) and all(abs(taken[s] - want[s]) <= 1 for s in sizes)
