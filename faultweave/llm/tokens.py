"""Token counts with a whole-token shortcut.

The byte-level BPE library cuts a text at special strings, then by a fixed pattern into
pre-tokens, and merges inside each pre-token only. So the count of a text is a sum over
pre-tokens. Offline, on the driver and once for a tokenizer, ``whole_tokens`` asks the
library about every vocabulary string and keeps those that are a single pre-token and a
single token; the proof is broadcast (its size is that of the vocabulary). Such pre-tokens
count 1 by a table look-up; only the others go through the merges, each distinct one
once per worker and batch.

Defined results: a null text counts as empty (0 tokens). Long texts are counted whole.
Repeated rows and extra columns do not matter; an empty table gives an empty result.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: White space of the library's pattern, which differs from Python's.
SPACE = "\t-\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
#: Fixed value: the published pattern of byte-level BPE, with that white space.
PATTERN = rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{SPACE}\p{{L}}\p{{N}}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+"
#: Distinct merged pre-tokens that a worker remembers.
REMEMBERED = 200_000


class Counter:
    """Counts the tokens of texts for one tokenizer file."""

    def __init__(self, path: str, proof: tuple[frozenset[str], tuple[str, str]] | None = None) -> None:
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.tokenizer = Tokenizer.from_file(path)
        self.split = regex.compile(PATTERN).findall
        self.specials = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.at_special = regex.compile("|".join(map(regex.escape, sorted(self.specials, key=len, reverse=True))) or r"(?!)")
        self.whole, odd = proof or (whole_tokens(path), odd_characters(path))
        self.maybe, self.strange = map(re.compile, odd)
        self.known: dict[str, int] = {}

    def merged(self, pieces: list[str]) -> int:
        """Tokens of pre-tokens that the shortcut does not cover."""
        known = self.known
        new = list({p for p in pieces if p not in known})
        if new:
            if len(known) + len(new) > REMEMBERED:
                known.clear()
                new = list(set(pieces))
            for i in range(0, len(new), 4096):
                part = new[i : i + 4096]
                known.update(zip(part, map(len, self.tokenizer.encode_batch_fast(part, add_special_tokens=False)), strict=True))
        return sum(map(known.__getitem__, pieces))

    def count(self, text: str) -> int:
        if self.maybe.search(text) and self.strange.search(text):
            return len(self.tokenizer.encode(text, add_special_tokens=False))
        total, parts = 0, [text]
        if self.specials and any(s in text for s in self.specials):
            parts = self.at_special.split(text)
            total = len(parts) - 1
        whole = self.whole
        for part in parts:
            pieces = self.split(part)
            rest = [p for p in pieces if p not in whole]
            total += len(pieces) - len(rest) + (self.merged(rest) if rest else 0)
        return total


@lru_cache(maxsize=2)
def whole_tokens(path: str) -> frozenset[str]:
    """Vocabulary strings proven to be one pre-token and one token when they stand alone."""
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    special = {t.content for t in tokenizer.get_added_tokens_decoder().values()}
    texts = [t for t in (tokenizer.decode([i]) for i in range(tokenizer.get_vocab_size())) if t and "�" not in t and not any(s in t for s in special)]
    pattern = regex.compile(PATTERN)
    out = []
    for i in range(0, len(texts), 4096):
        part = texts[i : i + 4096]
        for text, code in zip(part, tokenizer.encode_batch(part, add_special_tokens=False), strict=True):
            if len(code) == 1 and pattern.findall(text) == [text]:
                out.append(text)
    return frozenset(out)


#: Code points whose class is proven; texts with others are counted by the library alone.
TRIED = ((0x0, 0x2FFF), (0x3000, 0x9FFF), (0xAC00, 0xD7A3), (0xFF00, 0xFFEF))


@lru_cache(maxsize=2)
def odd_characters(path: str) -> tuple[str, str]:
    """Two patterns: a quick one that finds a candidate, and the characters that the two
    pattern libraries class differently (their Unicode versions differ) or that were not
    tried. Texts that hold one of the latter are counted by the library alone.

    Proof by trial: behind a letter, a digit and a mark, a character joins the one that
    it is of a kind with.
    """
    from tokenizers import Tokenizer

    pre = Tokenizer.from_file(path).pre_tokenizer
    mine = regex.compile(PATTERN)

    def alike(chars: str) -> bool:
        text = "".join(f"a{c}a1{c}1!{c}!" for c in chars)
        return [s for _, s in pre.pre_tokenize_str(text)] == [m.span() for m in mine.finditer(text)]

    odd = []
    for low, high in TRIED:
        for start in range(low, high + 1, 64):
            chars = "".join(map(chr, range(start, min(start + 64, high + 1))))
            if not alike(chars):
                odd += [c for c in chars if not alike(c)]
    least = min(odd, default=chr(0x3000))
    fine = "".join(f"{chr(low)}-{chr(high)}" for low, high in TRIED)
    return f"[{re.escape(least)}-\U0010ffff]", f"[^{fine}]" + (f"|[{re.escape(''.join(odd))}]" if odd else "")


def token_counts(docs: DataFrame, tokenizer: str, limit: int = 512, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, n_bytes, n_tokens, over_limit`` for each row. ``tokenizer`` is the path
    of a byte-level BPE .json file that the driver and every executor can open."""
    proof = docs.sparkSession.sparkContext.broadcast((whole_tokens(tokenizer), odd_characters(tokenizer)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = Counter(tokenizer, proof.value)
        for batch in batches:
            counts = [counter.count(t.as_py() or "") for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(counts, pa.int64())], ["doc_id", "n_bytes", "n_tokens"])

    picked = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"), F.coalesce(F.octet_length(text), F.lit(0)).cast("long").alias("n_bytes"))
    return picked.mapInArrow(run, "doc_id long, n_bytes long, n_tokens long").withColumn("over_limit", F.col("n_tokens") > limit)
