"""Language-model scoring by a weighted backoff automaton.

The model is an n-gram model of any ``order`` over all training tokens, all n-grams kept.
Its automaton has the empty state, whose arcs carry the smoothed unigrams, and a state for
every context of up to ``order - 1`` tokens. A state's arcs carry its n-grams; its failure
arc leads to the state without the oldest token, with the weight that is left over. A text
is read from left to right, the state carried from token to token: where the state has an
arc for the token its weight counts, else the failure arc's, and the next shorter state is
tried, down to the empty one. With h' for h without its oldest token the weights are

    p(w)      = (c(w) + 1) / (N + V + 1)
    p(w | h)  = (c(h, w) - D) / c(h) + left(h) * p(w | h')    if c(h, w) > 0
    left(h)   = D * kinds(h) / c(h), kinds(h) the number of tokens seen after h

and those of a context never seen are the shorter one's. Before a text's first token
stands the start, as often as the context is long.

Nothing of the model is ever in one place. Texts are encoded once, some megabytes of them
as one row (a chunk): token numbers, and the chunk's own vocabulary as 64-bit hashes. A
chunk asks for the counts of its n-grams of all orders in one go. They go to buckets as a
tree: by first word, below it the second words, below these the third. A bucket adds up
what all chunks counted and answers each with what it asked for, so a chunk gets back the
part of the automaton that its texts can reach. c(h) is the count of h as an n-gram of the
order below; a word's own count is that of all n-grams it begins.

Contexts that hold more than 1/``HOT`` of all tokens (fewer than ``HOT`` an order) are
split over ``SALTS`` buckets by their next token: words where their tree begins, longer
contexts by taking what stands below them out of the tree. What the buckets tell of such a
context adds up. Which contexts are split changes no result. On the way words stand as
places in a book of the most frequent ones (at most ``BOOK``, broadcast), all others as
hashes. Words of one hash count as one word; for 10^9 distinct words that is expected for
less than one pair.

Defined results: a null text counts as empty; its only token is the end. Rows without an
id are training rows. Repeated rows count as often as they occur. With no training row
N and V are 0. Extra columns do not matter; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.stage import discard
from .common import staged
from .words import TOKENS, U, mix, scans

ORDER = 3
CHUNK_BYTES = 8 << 20
BUCKET_KEYS = 1_000_000
SALTS = 16
HOT_BITS = 10
HOT = 1 << HOT_BITS
BOOK = 1_000_000
DISCOUNT = 0.5
#: The end of a text, and what stands before its first token.
END, START = mix(np.array([0xE0D], U))[0], mix(np.array([0x57A27], U))[0]


def _pack(x: np.ndarray) -> bytes:
    """Whole numbers from 0 on, as few bytes each as the largest needs, byte by byte."""
    if not len(x):
        return b""
    width = max(1, (int(x.max()).bit_length() + 7) // 8)
    planes = x.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].T.tobytes()
    return bytes([width]) + pa.compress(planes, "zstd", asbytes=True)


def _unpack(raw: bytes, n: int) -> np.ndarray:
    out = np.zeros((n, 8), np.uint8)
    if n:
        out[:, : raw[0]] = np.frombuffer(pa.decompress(raw[1:], n * raw[0], "zstd", asbytes=True), np.uint8).reshape(raw[0], n).T
    return out.view("<u8").reshape(-1).astype(np.int64)


def _gram(head: np.ndarray, tail: np.ndarray) -> np.ndarray:
    """The hash of an n-gram, from its context's and its last word's."""
    return mix(head * U(0x9E3779B97F4A7C15) + mix(tail) + U(1))


def often(tokens: np.ndarray, sizes: np.ndarray, words: np.ndarray, order: int) -> list[dict]:
    """The chunk's n-grams, of orders 2 to ``order - 1``, that hold more than 1/``HOT`` of
    its tokens. Only n-grams whose parts do so are looked at."""
    out, limit, n = [], max(1, len(tokens) >> HOT_BITS), len(words)
    starts = np.cumsum(sizes) - sizes
    frequent = np.bincount(tokens, minlength=n)[tokens] > limit
    at, fine, heads, first = tokens, frequent, words, np.array([START], U)
    for level in range(2, order):
        before, open_ = np.empty(len(tokens), np.int64), np.empty(len(tokens), bool)
        before[1:], open_[1:] = at[:-1], fine[:-1]
        before[starts], open_[starts] = len(heads), True
        pick = np.flatnonzero(frequent & open_)
        codes, of, counts = np.unique(before[pick] * n + tokens[pick], return_inverse=True, return_counts=True)
        heads, first = _gram(np.append(heads, first)[codes // max(1, n)], words[codes % max(1, n)]), _gram(first, np.array([START], U))
        many = counts > limit
        out += [{"level": level, "hash": h, "n": c} for h, c in zip(heads[many].view(np.int64).tolist(), counts[many].tolist(), strict=True)]
        at, fine = np.zeros(len(tokens), np.int64), np.zeros(len(tokens), bool)
        at[pick], fine[pick] = of, many[of]
    return out


ENCODED = "chunk long, doc_ids array<long>, train binary, sizes binary, n_tokens long, tokens binary, n_words long, words binary, counts binary, n_train long, n_texts long, often array<struct<level:int,hash:long,n:long>>"


def encode(docs: DataFrame, train, order: int) -> DataFrame:
    """Texts as chunks. ``train`` is a boolean column."""
    kinds = [pa.int64(), pa.list_(pa.int64()), pa.binary(), pa.binary(), pa.int64(), pa.binary(), pa.int64(), pa.binary(), pa.binary(), pa.int64(), pa.int64(), pa.list_(pa.struct([("level", pa.int32()), ("hash", pa.int64()), ("n", pa.int64())]))]
    names = ["chunk", "doc_ids", "train", "sizes", "n_tokens", "tokens", "n_words", "words", "counts", "n_train", "n_texts", "often"]

    def chunk(number: int, ids: list, train: list, parts: list[np.ndarray]) -> pa.RecordBatch:
        sizes = np.array([len(p) for p in parts], np.int64)
        words, tokens, seen = np.unique(np.concatenate(parts), return_inverse=True, return_counts=True)
        order_ = np.argsort(-seen, kind="stable")
        rank = np.empty(len(words), np.int64)
        rank[order_] = np.arange(len(words))
        words, tokens = words[order_], rank[tokens]
        used = np.repeat(np.array(train, bool), sizes)
        counts = np.bincount(tokens[used], minlength=len(words))
        row = [number, ids, np.array(train, np.uint8).tobytes(), sizes.tobytes(), len(tokens), _pack(tokens), len(words), words.tobytes(), _pack(counts), int(used.sum()), sum(train), often(tokens, sizes, words, order)]
        return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(row, kinds, strict=True)], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        ids, used, parts, held = [], [], [], 0
        end = np.array([END], U)
        for batch in batches:
            all_ids, flags = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for i, w in scans(batch.column(2), TOKENS):
                for k in range(len(w)):
                    parts.append(np.concatenate([w.hash[w.first[k] : w.first[k + 1]], end]))
                ids += all_ids[i : i + len(w)]
                used += flags[i : i + len(w)]
                held += len(w.data)
                if held >= CHUNK_BYTES:
                    yield chunk(number, ids, used, parts)
                    ids, used, parts, held, number = [], [], [], 0, number + 1
        if ids:
            yield chunk(number, ids, used, parts)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(train, F.lit(True)).alias("train"), "text")
    return staged(rows.mapInArrow(run, ENCODED), "encoded")


def _runs(sorted_buckets: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """``(bucket, from, to)`` of each run of equal values."""
    edges = np.concatenate([[0], np.flatnonzero(np.diff(sorted_buckets)) + 1, [len(sorted_buckets)]])
    if len(sorted_buckets):
        for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
            yield int(sorted_buckets[a]), a, b


def _bits(keys: int) -> int:
    """Buckets as a power of 2, of about ``BUCKET_KEYS`` keys."""
    return max(1, int(np.ceil(np.log2(max(1, keys / BUCKET_KEYS)))))


def _table(rows: list[tuple], schema: str) -> pa.RecordBatch:
    named = [x.split() for x in schema.split(", ")]
    kind = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary(), "array<binary>": pa.list_(pa.binary()), "array<long>": pa.list_(pa.int64())}
    columns = list(zip(*rows, strict=True)) if rows else [[]] * len(named)
    return pa.RecordBatch.from_arrays([pa.array(c, kind[k]) for c, (_, k) in zip(columns, named, strict=True)], [n for n, _ in named])


def word_totals(chunks: DataFrame) -> DataFrame:
    """``word, n``: the words of the training texts and their counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for words, n, counts in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                words, counts = np.frombuffer(words, np.int64), _unpack(counts, n)
                yield pa.RecordBatch.from_arrays([pa.array(words[counts > 0]), pa.array(counts[counts > 0])], ["word", "n"])

    found = chunks.select("words", "n_words", "counts").mapInArrow(run, "word long, n long")
    return staged(found.groupBy("word").agg(F.sum("n").alias("n")), "word-totals")


class Book:
    """The most frequent words by place. Place 0 is none, place 1 the start."""

    def __init__(self, words: np.ndarray) -> None:
        self.words = np.concatenate([np.zeros(1, U), np.array([START], U), words])
        self.order = np.argsort(self.words).astype(np.int32)
        self.sorted = self.words[self.order]

    def places(self, words: np.ndarray) -> np.ndarray:
        at = np.minimum(np.searchsorted(self.sorted, words), len(self.sorted) - 1)
        return np.where(self.sorted[at] == words, self.order[at], 0).astype(np.int64)


def make_book(totals: DataFrame, total: int) -> tuple[Book, np.ndarray]:
    """The book, and the words that hold more than 1/``HOT`` of all tokens. Words go by
    classes: fewer than 2^k hold more than 1/2^k. The book has as many whole classes as it
    can hold."""
    by_class = totals.withColumn("class", F.floor(F.log2(F.lit(float(total)) / F.col("n"))).cast("int"))
    held, last = 0, -1
    for r in sorted(by_class.where(F.col("class") < BOOK.bit_length() + 4).groupBy("class").count().collect()):
        held += r["count"]
        if held > BOOK:
            break
        last = r["class"]
    found = by_class.where(F.col("class") <= last).select("word", "n", "class").toArrow()
    word, n, of = (found.column(i).to_numpy() for i in range(3))
    order = np.lexsort((word, -n))
    return Book(word.view(U)[order]), word.view(U)[of < HOT_BITS]


class Opened(NamedTuple):
    """A chunk with its words in the order of the book, those that are not in it last."""

    tokens: np.ndarray
    sizes: np.ndarray
    train: np.ndarray  # by token
    words: np.ndarray  # hashes; the last is the start
    codes: np.ndarray  # places in the book, 0 for none

    @classmethod
    def of(cls, row: dict, book: Book) -> Opened:
        words = np.frombuffer(row["words"], U)
        codes = book.places(words)
        turn = np.lexsort((words, np.where(codes > 0, codes, len(book.words))))
        rank = np.empty(len(words), np.int64)
        rank[turn] = np.arange(len(words))
        sizes = np.frombuffer(row["sizes"], np.int64)
        train = np.repeat(np.frombuffer(row["train"], np.uint8).astype(bool), sizes)
        return cls(rank[_unpack(row["tokens"], row["n_tokens"])], sizes, train, np.append(words[turn], START), np.append(codes[turn], 1))


class Level(NamedTuple):
    """The distinct n-grams of one order in a chunk, by context, then word."""

    before: np.ndarray  # by token: the number of its context, the state carried to it
    gram: np.ndarray  # by token: the number of its n-gram
    first: np.ndarray  # by n-gram: a token where it stands
    context: np.ndarray  # by n-gram
    word: np.ndarray  # by n-gram
    heads: np.ndarray  # by context: its words

    @property
    def n_contexts(self) -> int:
        return len(self.heads)


def levels(c: Opened, order: int) -> Iterator[Level]:
    """The orders from 2 on. Contexts are the n-grams of the order below, by their numbers;
    the last one is the start."""
    n = len(c.words) - 1
    starts = np.cumsum(c.sizes) - c.sizes
    gram, heads = c.tokens, np.arange(n)[:, None]
    for level in range(2, order + 1):
        before = np.empty(len(c.tokens), np.int64)
        before[1:] = gram[:-1]
        before[starts] = len(heads)
        heads = np.concatenate([heads, np.full((1, level - 1), n)])
        codes, first, gram = np.unique(before * n + c.tokens, return_index=True, return_inverse=True)
        context, word = codes // max(1, n), codes % max(1, n)
        yield Level(before, gram, first, context, word, heads)
        if level < order:
            heads = np.column_stack([heads[context], word])


def _hash(c: Opened, heads: np.ndarray) -> np.ndarray:
    out = c.words[heads[:, 0]]
    for k in range(1, heads.shape[1]):
        out = _gram(out, c.words[heads[:, k]])
    return out


class Part(NamedTuple):
    """N-grams of one order in the order of the contexts they stand below."""

    level: int
    grams: np.ndarray
    ends: np.ndarray  # where the n-grams of each context end, with a 0 before

    @classmethod
    def of(cls, level: int, grams: np.ndarray, below: np.ndarray, n: int) -> Part:
        """``below`` are the places of the n-grams' contexts, of which there are ``n``."""
        return cls(level, grams[np.argsort(below, kind="stable")], np.concatenate([[0], np.cumsum(np.bincount(below, minlength=n))]))


class Asked(NamedTuple):
    """What a chunk asks of the buckets: a forest. Its contexts, by bucket, have below them
    n-grams, and these the n-grams of the next order. A context that is split stands in
    each of its buckets, maybe with nothing below it."""

    level: int  # the order of the first n-grams
    bucket: np.ndarray  # by context in the forest
    context: np.ndarray  # by context in the forest: its number
    heads: np.ndarray
    parts: list[Part]

    @classmethod
    def of(cls, c: Opened, g: Level, level: int, hashes: np.ndarray, hot: np.ndarray, bits: int, mine: np.ndarray) -> Asked:
        """``mine`` tells the contexts that take part."""
        split, grams = np.isin(hashes, hot), np.flatnonzero(mine[g.context])
        at = g.context[grams]
        width = np.where(np.bincount(at, minlength=len(hashes)) > 0, np.where(split, SALTS, 1), 0)
        start = np.cumsum(width) - width
        context = np.repeat(np.arange(len(hashes)), width)
        salt = (np.arange(len(context)) - start[context] + 1).astype(U)
        bucket = (mix(np.where(split[context], hashes[context] ^ mix(salt), hashes[context])) >> U(64 - bits)).astype(np.int64)
        # Two parts of a context may meet in one bucket: they are one.
        runs, place = np.unique(bucket * len(hashes) + context, return_inverse=True)
        own = place[start[at] + np.where(split[at], (c.words[g.word[grams]] % U(SALTS)).astype(np.int64), 0)]
        return cls(level, runs // len(hashes), runs % len(hashes), g.heads, [Part.of(level, grams, own, len(runs))])

    def slices(self) -> Iterator[tuple[int, int, int, list[tuple[int, int]]]]:
        """``(bucket, contexts from, to, n-grams from, to of each part)``."""
        for bucket, a, b in _runs(self.bucket):
            spans, lo, hi = [], a, b
            for p in self.parts:
                lo, hi = int(p.ends[lo]), int(p.ends[hi])
                spans.append((lo, hi))
            yield bucket, a, b, spans


def forests(c: Opened, gs: list[Level], bits: int, hot: dict[int, np.ndarray]) -> list[Asked]:
    """The tree from the first words on, and what is taken out of it: n-grams below hot
    contexts of two words or more, and below these."""
    out = [Asked.of(c, gs[0], 2, _hash(c, gs[0].heads), hot[2], bits, np.ones(gs[0].n_contexts, bool))]
    apart = None
    for level, g in enumerate(gs[1:], 3):
        hashes, before = _hash(c, g.heads), gs[level - 3]
        own = np.isin(hashes, hot[level])
        if apart is not None:
            own[:-1] |= apart[before.context]
        apart, last = own, out[0].parts[-1]
        place = np.full(len(before.word), -1)
        place[last.grams] = np.arange(len(last.grams))
        grams = np.flatnonzero(~apart[g.context])
        out[0].parts.append(Part.of(level, grams, place[g.context[grams]], len(last.grams)))
        out.append(Asked.of(c, g, level, hashes, hot[level], bits, apart))
    return out


def _squeeze(c: Opened, at: np.ndarray) -> bytes:
    """Words as places in the book, then the hashes of those that are not in it."""
    codes = c.codes[at]
    packed = _pack(codes)
    return len(packed).to_bytes(4, "little") + packed + c.words[at[codes == 0]].tobytes()


def _words(raw: bytes, n: int, book: Book) -> np.ndarray:
    size = int.from_bytes(raw[:4], "little")
    codes = _unpack(raw[4 : 4 + size], n)
    out = book.words[codes]
    out[codes == 0] = np.frombuffer(raw[4 + size :], U)
    return out


#: What a bucket says to a chunk: the counts of its n-grams by order, by context the kinds
#: of tokens that follow it, and of the first contexts how often they occur.
ANSWER = "chunk long, level int, place long, counts array<binary>, kinds array<binary>, totals binary"


def gram_counts(chunks: DataFrame, book, hot: dict[int, np.ndarray], bits: int, order: int) -> DataFrame:
    """Answers for each chunk about its n-grams of all orders from 2 on."""
    asks = "bucket int, level int, chunk long, place long, n_runs long, heads array<binary>, n array<long>, lengths array<binary>, tails array<binary>, counts array<binary>"

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                c = Opened.of(row, book.value)
                gs = list(levels(c, order))
                seen = [np.bincount(g.gram[c.train], minlength=len(g.word)) for g in gs]
                rows = []
                for forest in forests(c, gs, bits, hot):
                    for bucket, a, b, spans in forest.slices():
                        heads, lo, hi, parts = forest.heads[forest.context[a:b]], a, b, []
                        for p, (x, y) in zip(forest.parts, spans, strict=True):
                            mine = p.grams[x:y]
                            parts.append((y - x, _pack(np.diff(p.ends[lo : hi + 1])), _squeeze(c, gs[p.level - 2].word[mine]), _pack(seen[p.level - 2][mine])))
                            lo, hi = x, y
                        rows.append((bucket, forest.level, row["chunk"], a, b - a, [_squeeze(c, heads[:, k]) for k in range(heads.shape[1])], *map(list, zip(*parts, strict=True))))
                        if len(rows) == 64:
                            yield _table(rows, asks)
                            rows = []
                yield _table(rows, asks)

    def answer(table: pa.Table) -> pa.Table:
        asked = table.to_pylist()

        def heads_of(r: dict) -> np.ndarray:
            out = _words(r["heads"][0], r["n_runs"], book.value)
            for raw in r["heads"][1:]:
                out = _gram(out, _words(raw, r["n_runs"], book.value))
            return out

        above, at = np.unique(np.concatenate([heads_of(r) for r in asked]), return_inverse=True)
        sizes, totals = [r["n_runs"] for r in asked], None
        counts, kinds = [[] for _ in asked], [[] for _ in asked]
        for k in range(len(asked[0]["n"])):
            below = np.repeat(at, np.concatenate([_unpack(r["lengths"][k], n) for r, n in zip(asked, sizes, strict=True)]))
            keys = _gram(above[below], np.concatenate([_words(r["tails"][k], r["n"][k], book.value) for r in asked]))
            number = np.concatenate([_unpack(r["counts"][k], r["n"][k]) for r in asked])
            keys, first, mine = np.unique(keys, return_index=True, return_inverse=True)
            sums = np.bincount(mine, number, len(first)).astype(np.int64)
            follow = np.bincount(below[first[sums > 0]], minlength=len(above))
            if totals is None:
                total = np.bincount(below[first], sums, len(above)).astype(np.int64)
                totals = [_pack(total[x]) for x in np.split(at, np.cumsum(sizes)[:-1])]
            for i, x in enumerate(np.split(at, np.cumsum(sizes)[:-1])):
                kinds[i].append(_pack(follow[x]))
            above, at, sizes = keys, mine, [r["n"][k] for r in asked]
            for i, x in enumerate(np.split(mine, np.cumsum(sizes)[:-1])):
                counts[i].append(_pack(sums[x]))
        return pa.Table.from_batches([_table([(r["chunk"], r["level"], r["place"], c, n, t) for r, c, n, t in zip(asked, counts, kinds, totals, strict=True)], ANSWER)])

    asked = chunks.select("chunk", "train", "sizes", "n_tokens", "tokens", "words").mapInArrow(ask, asks)
    return asked.groupBy("level", "bucket").applyInArrow(answer, ANSWER)


SCORED = "doc_id long, train boolean, n_tokens long, n_known long, base_score double, score double"


class Arcs(NamedTuple):
    """The automaton's states of one length, as far as a chunk's texts reach them."""

    before: np.ndarray  # by token: the state
    gram: np.ndarray  # by token: the arc asked for
    there: np.ndarray  # by arc: whether the state has it
    weight: np.ndarray  # by arc
    left: np.ndarray  # by state: the weight of the failure arc


def traverse(c: Opened, base: np.ndarray, arcs: list[Arcs]) -> np.ndarray:
    """Log10 probability of each token. All tokens that wait at states of one length take
    their arc or the failure arc at once."""
    out = np.zeros(len(c.tokens))
    waiting = np.arange(len(c.tokens))
    for a in reversed(arcs):
        arc = a.gram[waiting]
        taken = a.there[arc]
        out[waiting[taken]] += np.log10(a.weight[arc[taken]])
        waiting = waiting[~taken]
        out[waiting] += np.log10(a.left[a.before[waiting]])
    out[waiting] += np.log10(base[c.tokens[waiting]])
    return out


def score_chunks(chunks: DataFrame, answers: DataFrame, book, hot: dict[int, np.ndarray], bits: int, order: int, total: int, distinct: int, n_texts: int) -> DataFrame:
    """Puts each chunk's part of the automaton together and traverses its texts."""

    def score(chunk: pa.Table, answered: pa.Table) -> pa.Table:
        row = chunk.to_pylist()[0]
        c = Opened.of(row, book.value)
        gs = list(levels(c, order))
        replies = {(r["level"], r["place"]): r for r in answered.to_pylist()}
        counts = [np.zeros(len(g.word), np.int64) for g in gs]
        kinds = [np.zeros(g.n_contexts, np.int64) for g in gs]
        count = np.zeros(gs[0].n_contexts, np.int64)
        for forest in forests(c, gs, bits, hot):
            for _, a, b, spans in forest.slices():
                r, at = replies[forest.level, a], forest.context[a:b]
                if forest.level == 2:
                    count[at] += _unpack(r["totals"], b - a)
                for k, (p, (x, y)) in enumerate(zip(forest.parts, spans, strict=True)):
                    # A context stands once in a bucket; one of two words or more has the
                    # number that it has as an n-gram.
                    kinds[p.level - 2][at] += _unpack(r["kinds"][k], len(at))
                    at = p.grams[x:y]
                    counts[p.level - 2][at] = _unpack(r["counts"][k], y - x)
        count = count[:-1]
        count[c.words[:-1] == END] = n_texts
        base = (count + 1.0) / (total + distinct + 1.0)
        known = (count > 0)[c.tokens].astype(np.int64)
        arcs, weight, gram = [], base, c.tokens
        for g, own, follow in zip(gs, counts, kinds, strict=True):
            # A context is an n-gram of the order below: its count is known.
            seen = np.append(count, n_texts)
            left = np.where(follow > 0, DISCOUNT * follow / np.maximum(seen, 1), 1.0)
            lower = weight[gram[g.first]]
            weight = np.maximum(own - DISCOUNT, 0.0) / np.maximum(seen[g.context], 1) + left[g.context] * lower
            count, gram = own, g.gram
            arcs.append(Arcs(g.before, gram, own > 0, weight, left))
        starts = np.cumsum(c.sizes) - c.sizes
        return pa.table({
            "doc_id": pa.array(row["doc_ids"], pa.int64()),
            "train": pa.array(np.frombuffer(row["train"], np.uint8).astype(bool)),
            "n_tokens": pa.array(c.sizes),
            "n_known": pa.array(np.add.reduceat(known, starts)),
            "base_score": pa.array(np.add.reduceat(np.log10(base)[c.tokens], starts)),
            "score": pa.array(np.add.reduceat(traverse(c, base, arcs), starts)),
        })

    picked = chunks.select("chunk", "doc_ids", "train", "sizes", "n_tokens", "tokens", "words")
    return picked.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(score, SCORED)


def score_texts(docs: DataFrame, train, order: int = ORDER) -> DataFrame:
    """``doc_id, train, n_tokens, n_known, train_tokens, base_score, score`` for each row.
    ``order`` is 2 or more."""
    chunks = encode(docs, train, order)
    size = chunks.agg(F.sum("n_train"), F.sum("n_tokens"), F.sum("n_texts")).first()
    total, tokens, n_texts = (int(x or 0) for x in size)
    totals = word_totals(chunks)
    distinct = totals.count()
    made, frequent = make_book(totals, total)
    discard(totals)
    book = docs.sparkSession.sparkContext.broadcast(made)
    start = np.array([START], U)
    hot, first = {2: np.append(frequent, start)}, start
    frequent = chunks.select(F.explode("often").alias("x")).groupBy("x.level", "x.hash").agg(F.sum("x.n").alias("n")).where(F.col("n") > tokens >> HOT_BITS)
    found = frequent.collect() if order > 2 else []
    for level in range(3, order + 1):
        first = _gram(first, start)
        hot[level] = np.append(np.array([r.hash for r in found if r.level == level - 1], np.int64).view(U), first)
    bits = _bits(tokens * (order - 1))
    answers = gram_counts(chunks, book, hot, bits, order)
    out = score_chunks(chunks, answers, book, hot, bits, order, total, distinct, n_texts)
    return out.withColumn("train_tokens", F.lit(total).cast("long"))
