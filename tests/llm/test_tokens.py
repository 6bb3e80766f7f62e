import public_tokenizers
import pytest
from tokenizers import Tokenizer

from faultweave.llm.tokens import Counter, token_counts, whole_tokens

PATH = public_tokenizers.path("byte_bpe_50k.json")
TEXTS = ["", "a", "hello world", "a <|endoftext|> b<|endoftext|>", "<|endoftext|", "  \n\n x\t\ty  ", " \x1c\x1d a\x85b\xa0c", "日本語 テスト １２３", "don't 'S we'll I'Ve", "͸x ֈy", "👩‍👩‍👧 ok", "x" * 3000, "﻿a   b", "1a2b_3-4", "ß Ǆ ⅷ ²", "Ᲊ Ɤ"]


def test_counts_equal_the_library():
    library, counter = Tokenizer.from_file(PATH), Counter(PATH)
    assert [counter.count(t) for t in TEXTS] == [len(library.encode(t, add_special_tokens=False)) for t in TEXTS]


def test_any_text():
    hypothesis = pytest.importorskip("hypothesis")
    library, counter = Tokenizer.from_file(PATH), Counter(PATH)

    @hypothesis.settings(max_examples=300, deadline=None)
    @hypothesis.given(hypothesis.strategies.text())
    def check(text):
        assert counter.count(text) == len(library.encode(text, add_special_tokens=False))

    check()


def test_shortcut_is_proven():
    library = Tokenizer.from_file(PATH)
    sample = sorted(whole_tokens(PATH))[::97]
    assert all(len(library.encode(t, add_special_tokens=False)) == 1 for t in sample) and len(sample) > 400


def test_rows(docs_of, odd_rows):
    library = Tokenizer.from_file(PATH)
    out = token_counts(docs_of(odd_rows), PATH).collect()
    want = sorted((str(i), len((t or "").encode()), n := len(library.encode(t or "", add_special_tokens=False)), n > 512) for i, t in odd_rows)
    assert sorted((str(r.doc_id), r.n_bytes, r.n_tokens, r.over_limit) for r in out) == want
    assert token_counts(docs_of(odd_rows).limit(0), PATH).count() == 0
