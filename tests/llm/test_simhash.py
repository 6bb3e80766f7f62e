import random
import re

import numpy as np
import pytest
import xxhash

from conftest_text import filler
from faultweave.llm import simhash
from faultweave.llm.simhash import Planes, fingerprints, links, near_duplicates


def plain_fingerprint(text):
    text = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    runs = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(r.encode(), 42) for r in runs]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))


def plain_components(prints, radius=2):
    """The smallest place that each is linked with, by search."""
    out = [None] * len(prints)
    for start in range(len(prints)):
        if out[start] is None:
            out[start], open_ = start, [start]
            while open_:
                i = open_.pop()
                for j in range(len(prints)):
                    if out[j] is None and (prints[i] ^ prints[j]).bit_count() <= radius:
                        out[j] = start
                        open_.append(j)
    return out


def check(spark, rows, df=None):
    """``rows`` are ``(doc_id, text)`` in order of ``doc_id``."""
    rows = sorted(rows, key=lambda r: (r[0] is None, r[0] or 0))
    prints = [plain_fingerprint(t) for _, t in rows]
    roots = plain_components(prints)
    want = sorted((str(d), f"{p:016x}", rows[r][0]) for (d, _), p, r in zip(rows, prints, roots, strict=True))
    got = near_duplicates(df if df is not None else spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted((str(r.doc_id), r.fingerprint, r.component_id) for r in got.collect()) == want


def test_odd_rows(spark, docs_of, odd_rows):
    # An id of null comes last, so that no other id is reached through it alone.
    check(spark, odd_rows, docs_of(odd_rows))


def test_near_copies(spark):
    rows = []
    for i in range(60):
        words = filler(i, 300).split()
        for k in range(i % 4 + 1):
            changed = list(words)
            for _ in range(k):
                changed[random.Random(i * 7 + k).randrange(300)] = "other"
            rows.append((len(rows), " ".join(changed) if k < 3 else "\t".join(changed).upper()))
    check(spark, rows)


def test_pieces_of_long_texts(monkeypatch):
    text = (filler(5, 500) + "\n\x0b É " + "x" * 90).encode()
    whole = [h for part in simhash._shingles(text) for h in part]
    for size in (1, 7, 64, 1000):
        monkeypatch.setattr(simhash, "PIECE", size)
        assert [h for part in simhash._shingles(text) for h in part] == whole


def near_values(n, seed):
    """Values of which many are near: chains of one or two changed bits."""
    dice = random.Random(seed)
    out = [dice.getrandbits(64)]
    while len(out) < n:
        base = dice.choice(out) if dice.random() < 0.7 else dice.getrandbits(64)
        for _ in range(dice.randint(1, 3)):
            base ^= 1 << dice.randrange(64)
        out.append(base)
    return np.array(out, np.uint64)


@pytest.mark.parametrize("radius", [0, 1, 2])
def test_planes(radius):
    values = near_values(500, radius)
    low, high = np.zeros(500, np.int64), np.arange(500)
    got = {(int(i), int(j)) for a, b in Planes(values).near(low, high, np.arange(64), radius) for i, j in zip(a, b, strict=True)}
    assert got == {(i, j) for i in range(500) for j in range(i) if (int(values[i]) ^ int(values[j])).bit_count() <= radius}


@pytest.mark.parametrize("block", [4096, 5])
def test_links_keep_all_components(spark, block):
    """Buckets within one block, and buckets that are many pairs of blocks."""
    values = [int(v) for v in {int(x) for x in near_values(400, 9)}]
    signed = [v - (1 << 64) if v >> 63 else v for v in values]
    found = links(spark.createDataFrame([(v,) for v in signed], "fp long"), block).collect()
    root = list(range(len(values)))
    at = {v: i for i, v in enumerate(signed)}

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for r in found:
        assert ((r.a ^ r.b) & (1 << 64) - 1) and {r.a, r.b} <= set(signed)
        a, b = sorted((top(at[r.a]), top(at[r.b])))
        root[b] = a
    want = plain_components(values)
    assert [min(j for j in range(len(values)) if top(j) == top(i)) for i in range(len(values))] == want


def test_empty_table_and_strings(spark):
    empty = spark.createDataFrame([], "doc_id long, text string, fp int, id string")
    assert near_duplicates(empty).collect() == []
    named = spark.createDataFrame([("b", "one two three four"), ("a", "One TWO three  four")], "doc_id string, text string")
    assert sorted((r.doc_id, r.component_id) for r in near_duplicates(named).collect()) == [("a", "a"), ("b", "a")]
    assert fingerprints(empty).columns == ["id", "fp"]
