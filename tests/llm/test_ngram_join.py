import random

from faultweave.llm import ngram_join as J
from faultweave.llm.components import components


def grams(text):
    import re

    w = [x for x in re.split(r"[\x00-/:-@\[-`{-\x7f]+", (text or "").lower()) if x]
    return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()


def brute(rows):
    """Links (by row number) and the classes' least ids."""
    sets = [grams(t) for _, t in rows]
    alike = lambda a, b: a == b or (a and b and len(a & b) >= 0.8 * len(a | b) - 1e-9)
    links = [[j for j in range(len(rows)) if j != i and alike(sets[i], sets[j])] for i in range(len(rows))]
    top = list(range(len(rows)))
    for _ in rows:
        for i, js in enumerate(links):
            for j in js:
                top[i] = top[j] = min(top[i], top[j])
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[top[i]] = min(least.get(top[i], d), d)
    return sorted((str(rows[i][0]), str(least.get(top[i])), len(links[i])) for i in range(len(rows)))


def check(docs, rows):
    out = J.near_duplicates(docs)
    assert sorted((str(r.doc_id), str(r.class_id), r.n_links) for r in out.collect()) == brute(rows)
    return out


def test_odd_rows(docs_of, odd_rows):
    docs = docs_of(odd_rows)
    kept = J.keep_one(docs, check(docs, odd_rows))
    assert kept.columns == docs.columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == ["1", "3", "6", "7"]
    empty = docs.limit(0)
    assert J.near_duplicates(empty).count() == 0 and J.keep_one(empty, J.near_duplicates(empty)).count() == 0


def test_near_copies(docs_of, monkeypatch):
    """A large group of near copies over several blocks, and chains of drifting texts."""
    monkeypatch.setattr(J, "BLOCK_ROWS", 16)
    dice = random.Random(3)
    vocabulary = ["".join(dice.choice("bcdfgaeiou") for _ in range(6)) for _ in range(4000)]
    rows, base = [], [dice.choice(vocabulary) for _ in range(120)]
    for i in range(60):
        words = list(base)
        for _ in range(dice.randint(0, 3)):
            words[dice.randrange(len(words))] = dice.choice(vocabulary)
        rows.append((1000 - i, " ".join(words)))
    for chain in range(4):
        words = [dice.choice(vocabulary) for _ in range(100)]
        for step in range(12):
            rows.append((2000 + 100 * chain + step, " ".join(words)))
            words[10 * step % 100] = dice.choice(vocabulary)
    rows += [(5000 + i, " ".join(dice.choice(vocabulary) for _ in range(dice.randint(1, 30)))) for i in range(60)]
    check(docs_of(rows), rows)


def test_banding():
    bands, rows = J.banding(0.8, 0.9995)
    assert 1 - (1 - 0.8**rows) ** bands >= 0.9995 and bands * rows <= 128


def test_components(spark):
    pairs = [(i, i + 1) for i in range(1, 40)] + [(100, 200), (300, 200), (50, 50)]
    got = {r.node: r.component for r in components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert got == {**{i: 1 for i in range(1, 41)}, 100: 100, 200: 100, 300: 100}


def test_clashing_columns(docs_of):
    rows = [(1, "a b c d e f g"), (2, "a b c d e f g"), (3, "other words stand in this text")]
    docs = docs_of(rows).withColumnsRenamed({"score": "_key", "key": "_Key_b"})
    kept = J.keep_one(docs, J.near_duplicates(docs))
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == [1, 3]
