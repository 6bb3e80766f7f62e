import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from faultweave.llm import lm

from conftest_text import filler

def held():
    return F.crc32(F.col("doc_id").cast("string")) % 7 == 2


def brute(rows, order):
    """Counts of all n-grams and the backed-off probabilities, straight from the texts."""
    fold = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    texts = [(i, i is not None and zlib.crc32(str(i).encode()) % 7 == 2, [0] * (order - 1) + re.findall(r"[^\x20\x09-\x0d]+", (t or "").translate(fold)) + [None]) for i, t in rows]
    c, seen, kinds, failures = Counter(), Counter(), Counter(), Counter()
    for _, held_out, w in texts:
        if not held_out:
            for k in range(order - 1, len(w)):
                c.update(tuple(w[k - j : k + 1]) for j in range(order))
    for g, x in c.items():
        if len(g) > 1:
            seen[g[:-1]] += x
            kinds[g[:-1]] += 1
    words = [g for g in c if len(g) == 1]
    n, v = sum(c[g] for g in words), len(words)

    def p(g, steps=0):
        failures[steps] += 1
        if len(g) == 1:
            return (c[g] + 1) / (n + v + 1)
        h = g[:-1]
        if c[g]:
            return (c[g] - lm.DISCOUNT) / seen[h] + lm.DISCOUNT * kinds[h] / seen[h] * p(g[1:])
        return (lm.DISCOUNT * kinds[h] / seen[h] if seen[h] else 1) * p(g[1:], steps + 1)

    out = []
    for i, held_out, w in texts:
        own = range(order - 1, len(w))
        base = sum(math.log10((c[w[k],] + 1) / (n + v + 1)) for k in own)
        out.append((str(i), not held_out, len(own), sum(c[w[k],] > 0 for k in own), n, round(base, 4), round(sum(math.log10(p(tuple(w[k - order + 1 : k + 1]))) for k in own), 4)))
    return sorted(out), failures


def got(df):
    return sorted((str(r.doc_id), r.train, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 4), round(r.score, 4)) for r in df.collect())


@pytest.mark.parametrize("order", [2, 3, 4])
def test_odd_rows(docs_of, odd_rows, order):
    docs = docs_of(odd_rows)
    assert got(lm.score_texts(docs, ~held(), order)) == brute(odd_rows, order)[0]
    assert lm.score_texts(docs.limit(0), ~held(), order).count() == 0


@pytest.mark.parametrize("order", [2, 3, 4])
def test_many_chunks_and_hot_contexts(docs_of, odd_rows, monkeypatch, order):
    """A state of several tokens fails to ever shorter ones, down to the empty one; frequent
    contexts are split; words outside the book travel as hashes."""
    monkeypatch.setattr(lm, "BUCKET_KEYS", 500)
    monkeypatch.setattr(lm, "CHUNK_BYTES", 20_000)
    monkeypatch.setattr(lm, "BOOK", 40)
    monkeypatch.setattr(lm, "HOT_BITS", 6)
    rows = odd_rows + [(i, filler(i % 50, 40).title() + " of the " * (i % 9) + filler(i % 7, 5)) for i in range(10, 250)]
    want, failures = brute(rows, order)
    assert failures[order - 1]
    assert got(lm.score_texts(docs_of(rows), ~held(), order)) == want


def test_packing():
    dice = np.random.default_rng(1)
    for top in (1, 200, 70_000, 1 << 40):
        x = dice.integers(0, top, 1000)
        assert (lm._unpack(lm._pack(x), 1000) == x).all()
    assert len(lm._unpack(lm._pack(x[:0]), 0)) == 0
