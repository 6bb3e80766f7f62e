import math

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from faultweave.llm.hard_negatives import Shard, hard_negatives
from faultweave.llm.queries import op13_hard_negatives, oracle_sql


def plain(rows, positives=5, negatives=10, every=10):
    rows = [r for r in rows if r[2] is not None and r[1] is not None and all(x is not None and math.isfinite(x) for x in r[1])]
    cut = [(r[0], [math.floor(256 * x) for x in r[1]], r[2]) for r in rows]
    out = []
    for a in cut:
        if a[0] is None or a[0] % every:
            continue

        def best(found, k):
            scored = [(sum(x * y for x, y in zip(a[1], v, strict=True)), i) for i, v, _ in found]
            return sorted(scored, key=lambda s: (-s[0], s[1] is None, s[1] or 0))[:k], scored

        tops, _ = best([r for r in cut if r[2] == a[2] and r[0] != a[0]], positives)
        _, others = best([r for r in cut if r[2] != a[2]], 0)
        for score, i in tops:
            inside = sorted((s for s in others if 30 * score <= 100 * s[0] <= 90 * score), key=lambda s: (-s[0], s[1] is None, s[1] or 0))
            out += [(a[0], i, k, n, score, s) for k, (s, n) in enumerate(inside[:negatives], 1)]
    return sorted(map(str, out))


def vectors(n, size=8, seed=2):
    dice = np.random.default_rng(seed)
    middle = dice.normal(0, 0.4, (4, size))
    return [(i, [float(np.float32(x)) for x in middle[i % 4] + dice.normal(0, 0.15, size)], int((i + i // 9) % 4)) for i in range(n)]


def table(spark, rows):
    return spark.createDataFrame([(*r, 1, "y", False) for r in rows], "vec_id long, embedding array<float>, label int, row int, shard string, is_anchor boolean")


@pytest.mark.parametrize(("n", "sizes"), [(300, {}), (300, {"shard_size": 8 * 40, "block": 3}), (30, {"shard_size": 8, "block": 1})])
def test_equals_plain_loops(spark, n, sizes):
    rows = vectors(n)
    got = hard_negatives(table(spark, rows), F.col("vec_id") % 10 == 0, **sizes)
    assert got.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    want = plain(rows)
    assert want and sorted(str(tuple(r)) for r in got.collect()) == want


def test_odd_rows(spark):
    rows = vectors(80)
    rows += [(500, None, 1), (510, [None] * 8, 1), (520, [float("nan")] * 8, 1), (530, [0.5] * 8, None), (540, [], 1)]
    rows += [(10, rows[10][1], rows[10][2]), (601, rows[20][1], rows[20][2]), (602, rows[20][1], rows[20][2]), (None, rows[30][1], 2), (700, [0.0] * 8, 1), (710, [-0.9] * 8, 3), (711, [0.9] * 8, 3)]
    odd = [r for r in rows if r[1] != []]
    got = hard_negatives(table(spark, rows), F.col("vec_id") % 10 == 0, shard_size=8 * 16, block=4)
    assert sorted(str(tuple(r)) for r in got.collect()) == plain(odd)


def test_nothing_to_search(spark):
    anchor = F.col("vec_id") % 10 == 0
    assert hard_negatives(table(spark, []), anchor).collect() == []
    assert hard_negatives(table(spark, vectors(5)[1:]), anchor).collect() == []
    assert hard_negatives(table(spark, [(10, [0.5] * 8, 1)]), anchor).collect() == []


def test_threshold_stops_early_and_stays_exact():
    """Long tails: the best rows stand at the heads of few lists."""
    dice = np.random.default_rng(4)
    data = np.floor(dice.pareto(1.5, (20_000, 4)) * 100)
    data[7] = data[8] = data.max(0)
    shard = Shard(data, np.arange(20_000)[::-1].copy())
    anchor = np.array([3.0, 0.0, 5.0, 1.0])
    scored = []
    score = shard._score
    shard._score = lambda rows, a: scored.append(len(rows)) or score(rows, a)
    ((rows, got),) = shard.best(anchor, np.ones(20_000, bool), [(-np.inf, np.inf)], 5)
    assert sum(scored) < 10_000
    true = (data @ anchor).astype(int)
    want = sorted(range(20_000), key=lambda i: (-true[i], 20_000 - i))[:5]
    assert rows.tolist() == want == [8, 7, *want[2:]] and got.tolist() == true[want].tolist()


def test_sql_agrees(spark, tmp_path):
    rows = [(i * 5, v, label) for i, v, label in vectors(200, 6)] + [(1000, None, 1), (1100, [1.0] * 6, None), (1400, [0.3] * 6, 9), (1407, [0.3] * 6, 9)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{tmp_path}/embeddings.parquet/*.parquet'")
    got = op13_hard_negatives(spark, str(tmp_path))
    want = con.execute(f"SELECT {', '.join(got.columns)} FROM ({oracle_sql()['op13_hard_negatives']})").fetchall()
    assert want and sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, want))
