import math

import duckdb
import numpy as np
import pytest

from faultweave.llm.queries import oracle_sql
from faultweave.llm.vector_codes import Walk, compress, with_group_error


def plain(rows, parts=8, entries=16, rounds=6):
    """Codes and errors by plain loops over Python integers."""
    rows = [r for r in rows if r[1] is not None and all(x is not None and math.isfinite(x) for x in r[1])]
    rows = sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    whole = [[math.floor(4096 * x) for x in r[1]] for r in rows]
    k = len(whole[0]) // parts
    cut = [[v[p * k : (p + 1) * k] for p in range(parts)] for v in whole]
    books = [[list(v[p]) for v in cut[:entries]] for p in range(parts)]

    def nearest(p, x):
        return min((sum((a - b) ** 2 for a, b in zip(x, c, strict=True)), e) for e, c in enumerate(books[p]))

    for _ in range(rounds):
        at = [[nearest(p, v[p])[1] for v in cut] for p in range(parts)]
        for p in range(parts):
            for e in range(len(books[p])):
                mine = [v[p] for v, i in zip(cut, at[p], strict=True) if i == e]
                if mine:
                    books[p][e] = [sum(x) // len(mine) for x in zip(*mine, strict=True)]
    out = []
    for r, v in zip(rows, cut, strict=True):
        found = [nearest(p, v[p]) for p in range(parts)]
        out.append((r[0], "".join(f"{e:02x}" for _, e in found), sum(d for d, _ in found)))
    return out, books


def table(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int, code int, `_group` string")


def vectors(n, size=16, seed=1, levels=9):
    dice = np.random.default_rng(seed)
    return [(i, [float(np.float32(x)) for x in dice.integers(-levels, levels, size) / 64], int(i % 3), 5, "x") for i in range(n)]


def as_rows(df):
    return sorted((r.vec_id is None, r.vec_id, r.code, r.error) for r in df.collect())


@pytest.mark.parametrize("n", [1, 5, 16, 200])
def test_equals_plain_loops(spark, n):
    rows = vectors(n)
    coded, books = compress(table(spark, rows).repartition(3))
    want, plain_books = plain(rows)
    assert as_rows(coded) == sorted((r[0] is None, *r) for r in want)
    assert books.entries.tolist() == plain_books


def test_odd_rows(spark):
    good = vectors(40)
    odd = [(100, None, 1, 5, "x"), (101, [None] * 16, 1, 5, "x"), (102, [0.0] * 15 + [float("nan")], 1, 5, "x"), (103, [float("inf")] * 16, 1, 5, "x"), (104, [], 1, 5, "x"), (105, [1.0] * 8, None, 5, "x")]
    more = [good[3], good[3], (None, good[0][1], None, None, None), (50, [-0.0001] * 16, None, 5, "x")]
    coded, books = compress(table(spark, good + odd + more))
    want, plain_books = plain(good + more)
    assert as_rows(coded) == sorted((r[0] is None, *r) for r in want)
    assert books.entries.tolist() == plain_books
    assert coded.columns == ["vec_id", "embedding", "label", "_group", "code", "error"]
    summed = with_group_error(coded).collect()
    by = {}
    for r in summed:
        by.setdefault(r.label, []).append(r)
    assert all(r.label_error == sum(x.error for x in rows) for rows in by.values() for r in rows) and len(by[None]) == 2


def test_empty_and_too_large(spark):
    coded, books = compress(table(spark, [(1, None, 1, 5, "x")]))
    assert coded.collect() == [] and {"code", "error"} <= set(coded.columns)
    with pytest.raises(Exception, match="too large"):
        compress(table(spark, [(1, [1e30] * 8, 1, 5, "x")]))[0].collect()


def test_walk_carries_its_path():
    dice = np.random.default_rng(3)
    books = dice.integers(-50, 50, (2, 4, 5))
    part = dice.integers(-2, 2, (300, 5))
    position = np.repeat([0, 1], 150)
    order = np.lexsort((*part.T[::-1], position))
    position, part = position[order], part[order]
    walk = Walk(books)
    got = np.concatenate([walk.leaves(position[i : i + 7], part[i : i + 7]) for i in range(0, 300, 7)])
    assert (got == ((part[:, None] - books[position]) ** 2).sum(2)).all()


def test_sql_agrees_on_odd_rows(spark, tmp_path):
    from faultweave.llm.queries import op11_vector_codes

    rows = vectors(60, 64) + [(100, None, 1, 5, "x"), (101, [None] * 64, 1, 5, "x"), (102, [float("nan")] * 64, None, 5, "x"), (103, [0.5] * 64, None, 5, "x"), (104, [0.25] * 64, None, 5, "x"), (104, [0.25] * 64, None, 5, "x")]
    table(spark, rows).select("vec_id", "embedding", "label").write.parquet(f"{tmp_path}/embeddings.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{tmp_path}/embeddings.parquet/*.parquet'")
    got = op11_vector_codes(spark, str(tmp_path))
    want = con.execute(f"SELECT {', '.join(got.columns)} FROM ({oracle_sql()['op11_vector_codes']})").fetchall()
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, want))
