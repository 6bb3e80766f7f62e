import math
import os
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from faultweave.llm import quality, toxicity
from faultweave.llm.linear import Ftrl, Space, over, score, training_rows

from conftest_text import filler

DATA = "/root/testdata/sf0.1"


def auc(labels, scores):
    order = np.argsort(np.argsort(scores)) + 1.0
    y = np.asarray(labels) == 1
    return (order[y].sum() - y.sum() * (y.sum() + 1) / 2) / (y.sum() * (~y).sum())


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no data")
def test_held_out_quality(spark):
    docs, labels = spark.read.parquet(f"{DATA}/documents.parquet"), spark.read.parquet(f"{DATA}/labels.parquet")
    rows = quality.quality_scores(docs, labels).join(labels, "doc_id").where("held_out").collect()
    assert auc([r.quality for r in rows], [r.score for r in rows]) > 0.999
    assert sum(r.predicted == r.quality for r in rows) / len(rows) > 0.99
    assert sum(r.predicted == 0 and r.quality == 1 for r in rows) <= 0.01 * len(rows)


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no data")
def test_held_out_toxicity(spark):
    docs, labels = spark.read.parquet(f"{DATA}/documents.parquet"), spark.read.parquet(f"{DATA}/labels.parquet")
    rows = toxicity.toxicity_scores(docs, labels.where(~quality.held_out())).join(labels.where(quality.held_out()).select("doc_id", F.col("toxic").alias("y")), "doc_id").collect()
    assert auc([r.y for r in rows], [r.toxic_score for r in rows]) > 0.98
    caught = [r.toxic for r in rows if r.y]
    assert sum(caught) / len(caught) > 0.8 and sum(r.toxic for r in rows if not r.y) <= 0.01 * len(rows)


def labels_of(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")


def test_odd_rows(spark, docs_of, odd_rows):
    docs = docs_of(odd_rows)
    labels = labels_of(spark, [(1, 1, 0), (2, 0, 0), (3, 1, 1), (3, 1, 1), (4, 0, None), (6, 1, 0), (None, 1, 1), (99, 0, 1)])
    good = quality.quality_scores(docs, labels).collect()
    toxic = toxicity.toxicity_scores(docs, labels).collect()
    assert len(good) == len(toxic) == len(odd_rows)
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in good) and all(0 <= r.toxic_score <= 1 for r in toxic)
    assert len({r.score for r in good if r.doc_id in (1, 2, 5)}) == 1 and len({r.score for r in good if r.doc_id in (3, 4)}) == 1
    none = labels.limit(0)
    assert {r.score for r in quality.quality_scores(docs, none).collect()} == {0.5}
    assert {r.toxic_score for r in toxicity.toxicity_scores(docs, none).collect()} == {0.5}
    assert quality.quality_scores(docs.limit(0), labels).count() == 0 and toxicity.toxicity_scores(docs.limit(0), labels).count() == 0


def test_held_out_rows_teach_nothing(spark, docs_of):
    held = [i for i in range(200) if zlib.crc32(str(i).encode()) % 5 == 0]
    docs = docs_of([(i, f"word{i} other{i % 3}") for i in range(200)])
    a = labels_of(spark, [(i, i % 2, 0) for i in range(200)])
    b = labels_of(spark, [(i, 1 - i % 2 if i in held else i % 2, 0) for i in range(200)])
    get = lambda x: {r.doc_id: (r.held_out, r.score) for r in quality.quality_scores(docs, x).collect()}
    assert get(a) == get(b) and sorted(i for i, (h, _) in get(a).items() if h) == held


def test_sparse_score_is_the_dot_product():
    space = Space(words=(1, 2), stems=(3,), bits=10, marks="apart", ditto=True)
    rows = list(over(pa.array(["One two two", None, "", "Éa 12!!"]), space))
    model = np.random.default_rng(1).normal(size=1025)
    for (slots, values), p in zip(rows, score(rows, model), strict=True):
        dense = np.zeros(1024)
        dense[slots] = values
        assert abs(1 / (1 + np.exp(-(dense @ model[:-1] + model[-1]))) - p) < 1e-12
        assert not len(values) or abs(values @ values - 1) < 1e-9


def test_ftrl_and_chain_learn():
    dice = np.random.default_rng(4)
    rows, labels = [], []
    for _ in range(600):
        a, b = dice.integers(2, size=2)
        rows.append((np.array([a, 2 + b, 4 + dice.integers(20)]), np.ones(3)))
        labels.append((a, a & b))
    y, folds = np.array(labels, float), np.arange(600) % 3
    model = Ftrl(32).fit(rows, y[:, 0], 3)
    assert ((score(rows, model) > 0.5) == y[:, 0]).all()
    p = toxicity.score_chain(rows, np.array(toxicity.learn_chain(rows, y, folds, 32)), 32)
    assert ((p > 0.5) == y).mean() > 0.99


def plain_ftrl(rows, labels, epochs, alpha, l1, beta=1.0, l2=0.1):
    """Follow-the-regularised-leader in plain loops over named features."""
    z, n = defaultdict(float), defaultdict(float)

    def weight(f):
        return 0.0 if abs(z[f]) <= l1 else ((l1 if z[f] > 0 else -l1) - z[f]) / ((beta + math.sqrt(n[f])) / alpha + l2)

    turns = np.random.default_rng(1)
    for _ in range(epochs):
        for i in turns.permutation(len(rows)):
            x = rows[i] | {"bias": 1.0}
            w = {f: weight(f) for f in x}
            p = 1 / (1 + math.exp(-sum(w[f] * v for f, v in x.items())))
            for f, v in x.items():
                g = (p - labels[i]) * v
                z[f] += g - (math.sqrt(n[f] + g * g) - math.sqrt(n[f])) / alpha * w[f]
                n[f] += g * g
    return {f: weight(f) for f in list(z)}


def plain_score(x, w):
    return 1 / (1 + math.exp(-sum(w.get(f, 0.0) * v for f, v in (x | {"bias": 1.0}).items())))


def labelled(n=60):
    rows, labels = [], []
    for i in range(n):
        text = " ".join(filler(1000 + i, 5).title().split() + ["so", "good,"] * (i % 2) + ["Bad!!", "no", "no", "no"] * (i % 3 == 0) + ["viletoken"] * (i % 5 == 0))
        rows.append((i, text))
        labels.append((i, int(i % 3 != 0), int(i % 5 == 0)))
    return rows + [(n, None), (n + 1, ""), (n + 2, "No no, NO!! no no")], labels


def test_quality_by_brute_force(spark, docs_of):
    """From the text to the score: own words, n-grams by name, plain loops."""
    rows, labels = labelled()

    def features(text):
        words = [w for piece in re.findall(r"[^ \t\n\x0b\x0c\r]+", text or "") for w in re.findall(r"[!-/:-@\[-`{-~]+|[^!-/:-@\[-`{-~]+", piece)]
        words = ["<ditto>" if k and words[k - 1] == w else w for k, w in enumerate(words)]
        counts = Counter([(w,) for w in words] + list(zip(words, words[1:], strict=False)))
        size = math.sqrt(sum(counts.values()))
        return {f: math.sqrt(c) / size for f, c in counts.items()}

    held = lambda i: zlib.crc32(str(i).encode()) % 5 == 0
    train = [i for i, _, _ in labels if not held(i)]
    x = {i: features(t) for i, t in rows}
    w = plain_ftrl([x[i] for i in train], [labels[i][1] for i in train], 3, 0.5, 0.02)
    for r in quality.quality_scores(docs_of(rows), labels_of(spark, labels)).collect():
        p = plain_score(x[r.doc_id], w)
        assert abs(r.score - p) < 1e-5 and r.held_out == held(r.doc_id) and r.predicted == int(r.score >= 0.3)


def test_toxicity_by_brute_force(spark, docs_of):
    """The chain with out-of-fold probabilities, from the text on."""
    rows, labels = labelled()

    def features(text):
        words = re.findall(r"[0-9a-z\x80-\U0010ffff]+", (text or "").lower())
        return {("w", w): 1.0 for w in words} | {(k, w[:k]): 1.0 for w in words for k in (4, 5) if len(w) > k}

    def logit(p):
        p = min(max(p, 1e-4), 1 - 1e-4)
        return math.log(p / (1 - p)) / 4

    x = {i: features(t) for i, t in rows}
    ids, junk, toxic = [r[0] for r in labels], [1 - r[1] for r in labels], [r[2] for r in labels]
    fold = [zlib.crc32(str(i).encode()) % 3 for i in ids]
    fit = lambda xs, ys: plain_ftrl(xs, ys, 3, 1.0, 4.0)
    unseen = {}
    for f in range(3):
        inside = [k for k in range(len(ids)) if fold[k] != f]
        w = fit([x[ids[k]] for k in inside], [junk[k] for k in inside])
        unseen |= {k: plain_score(x[ids[k]], w) for k in range(len(ids)) if fold[k] == f}
    first = fit([x[i] for i in ids], junk)
    second = fit([x[i] | {"junk": logit(unseen[k])} for k, i in enumerate(ids)], toxic)
    for r in toxicity.toxicity_scores(docs_of(rows), labels_of(spark, labels)).collect():
        p = plain_score(x[r.doc_id], first)
        q = plain_score(x[r.doc_id] | {"junk": logit(p)}, second)
        assert abs(r.junk_score - p) < 1e-5 and abs(r.toxic_score - q) < 1e-5


def test_repeated_ids_and_clashing_columns(spark, docs_of):
    docs = docs_of([(1, "b b b"), (1, "a a a")] + [(i, f"w{i}") for i in range(2, 9)])
    labels = labels_of(spark, [(i, i % 2, 0) for i in range(1, 9)])
    assert training_rows(docs, labels, ["quality"], 100).where("doc_id = 1").collect()[0].text == "a a a"
    out = quality.scored(docs.withColumn("Predicted", F.lit("x")), quality.learn(docs, labels))
    assert sorted(out.columns) == sorted(["doc_id", "text", "lang", "source", "n_chars", "key", "score", "predicted"]) and out.count() == 9
