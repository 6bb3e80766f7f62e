import random
from collections import defaultdict

import numpy as np

from faultweave.llm import line_dedup as L
from faultweave.llm.cuckoo import CuckooFilter

LONG = "A line that is long enough to count as one that documents share"
BLANK = " \t\n\x0b\x0c\r"


def brute(rows):
    def key(line):
        return "".join(c.lower() if "A" <= c <= "Z" else c for c in line.strip(BLANK))

    holders = defaultdict(set)
    for i, t in rows:
        for x in (t or "").split("\n"):
            if i is not None and len(key(x)) >= 40:
                holders[key(x)].add(i)
    out = []
    for i, t in rows:
        lines = (t or "").split("\n")
        left = [x for x in lines if not (len(holders[key(x)]) >= 5 and (i is None or i < max(holders[key(x)])))]
        out.append((str(i), "\n".join(left), len(lines), len(lines) - len(left)))
    return sorted(out)


def rows_of(df):
    return sorted((str(r.doc_id), r.text, r.n_lines, r.n_dropped) for r in df.collect())


def sample(n=60):
    dice = random.Random(1)
    pool = [f"{LONG} number {k} " + "é" * (k % 5) for k in range(12)] + ["short", "", "ä" * 39, "ä" * 40, "x" * 40]
    rows = [(dice.randrange(40), "\n".join(dice.choice([x, f"  {x.upper() if x.isascii() else x}\t\r"]) for x in dice.choices(pool, k=dice.randint(0, 6)))) for _ in range(n)]
    return rows + [(None, LONG + " number 1 é\nown"), (100, None), (101, "")]


def test_both_ways(docs_of, odd_rows):
    for rows in (sample(), odd_rows, [(i, LONG) for i in (1, 2, 2, 3, 4, 5)], [(1, LONG), (1, LONG)] * 4):
        docs = docs_of(rows)
        state = L.start(docs)
        assert rows_of(L.drop_lines(docs, state)) == brute(rows)
        shuffled = L.drop_lines(docs, state, broadcast_rows=-1)
        assert rows_of(shuffled) == brute(rows) and set(docs.columns) < set(shuffled.columns)
    assert L.dedup_lines(docs.limit(0)).count() == 0


def test_insert_and_delete(docs_of, spark):
    rows = sample(90)
    docs, first, more = docs_of(rows), docs_of(rows[:40]), docs_of(rows[40:])
    whole = L.start(docs)
    grown = L.insert_documents(L.start(first), more)
    back = L.delete_documents(grown, spark.createDataFrame([(i,) for i in {r[0] for r in rows[40:]} - {r[0] for r in rows[:40]}], "doc_id long"))
    table = lambda s: sorted((bytes(r.key), r.n_docs, r.max_doc) for r in s.frequent.collect())
    assert table(grown) == table(whole) and rows_of(L.drop_lines(docs, grown)) == brute(rows)
    kept = {r[0] for r in rows[:40]}
    rest = [r for r in rows if r[0] in kept]
    assert table(back) == table(L.start(docs_of(rest)))
    for state in (grown, back):
        assert L.screens(state).contains([bytes(r.key) for r in state.frequent.collect()]).all()
    # What was there before is not written again: the log only grows by what changed.
    assert len(grown.parts) == 2 and len(back.parts) == 3
    again = L.insert_documents(grown, more)
    assert again.parts[-1].count() == 0 and table(again) == table(grown)


def test_parts_are_joined_up(docs_of, spark, monkeypatch):
    monkeypatch.setattr(L, "MOST_PARTS", 2)
    rows = sample(60)
    state = L.start(docs_of(rows[:20]))
    for k in (20, 40):
        state = L.insert_documents(state, docs_of(rows[k : k + 20]))
    ids = sorted({r[0] for r in rows if r[0] is not None})[:10]
    back = L.insert_documents(L.delete_documents(state, spark.createDataFrame([(i,) for i in ids], "doc_id long")), docs_of([r for r in rows if r[0] in ids]))
    for s in (state, back):
        assert len(s.parts) <= 2 and rows_of(L.drop_lines(docs_of(rows), s)) == brute(rows)


def test_a_lookup_touches_one_shard(docs_of, monkeypatch):
    monkeypatch.setattr(L, "SHARD_KEYS", 4)
    docs = docs_of(sample(90))
    state = L.start(docs)
    keys = [bytes(r.key) for r in state.frequent.collect()]
    assert state.shards > 1 and rows_of(L.drop_lines(docs, state)) == rows_of(L.drop_lines(docs, state, broadcast_rows=-1))
    made, asked = L.screens(state), []
    monkeypatch.setattr(CuckooFilter, "contains", lambda self, ks: asked.extend(ks) or np.ones(len(ks), bool))
    assert made.contains(keys).all() and sorted(asked) == sorted(keys)


def test_clashing_columns(docs_of):
    rows = sample(30)
    docs = docs_of(rows).withColumnsRenamed({"score": "n_lines", "key": "_kept"}).selectExpr("*", "1 AS _key_a", "2 AS _lost", "3 AS N_dropped")
    for most in (L.BROADCAST_ROWS, -1):
        out = L.drop_lines(docs, L.start(docs), most)
        assert rows_of(out) == brute(rows) and sorted(out.columns) == sorted(["doc_id", "lang", "source", "n_chars", "_kept", "_key_a", "_lost", "text", "n_lines", "n_dropped"])


def test_cuckoo_filter():
    dice = np.random.default_rng(2)
    keys = [dice.bytes(16) for _ in range(20_000)]
    made = CuckooFilter.of(keys[:10_000])
    assert made.contains(keys[:10_000]).all() and made.contains(keys[10_000:]).mean() < 0.002
    made.delete(keys[:5_000])
    assert made.contains(keys[5_000:10_000]).all() and made.contains(keys[:5_000]).mean() < 0.002
    assert CuckooFilter.load(made.dump()).contains(keys[5_000:10_000]).all() and not made.contains([]).size
