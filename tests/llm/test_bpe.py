import hashlib
import random

import numpy as np
import pytest

from evidex.llm import bpe

public_tokenizers = pytest.importorskip("public_tokenizers")
tokenizers = pytest.importorskip("tokenizers")


@pytest.fixture(scope="module")
def library():
    return tokenizers.Tokenizer.from_file(bpe.default_vocabulary())


def test_same_tokens_as_the_library(library):
    random.seed(1)
    bits = ["a", "aa", "the", " the", "ing", " ", "  ", "\n", "\t", "é", "ß", "日本", "𝒳", "1", "23", "'s", "'ll", "!!", "<|endoftext|>", "<|end", "\x1c", "\x85", " ", "\x00"]
    texts = ["".join(random.choices(bits, k=random.randint(0, 30))) for _ in range(3000)] + ["a" * 5000, "ab" * 3000]
    v = bpe.vocabulary(bpe.default_vocabulary())
    got = [np.frombuffer(x, "<u4").tolist() for x in v.encode(texts)]
    want = [x.ids for x in library.encode_batch(texts, add_special_tokens=False)]
    assert got == want
    assert [v.decode(np.array(x, "<u4").tobytes()) for x in want] == [library.decode(x, skip_special_tokens=False) for x in want]


def test_decoding_single_tokens(library):
    v = bpe.vocabulary(bpe.default_vocabulary())
    for i in range(0, 50257, 11):
        assert v.decode(np.array([i], "<u4").tobytes()) == library.decode([i], skip_special_tokens=False)


def test_odd_documents(spark, odd_docs, odd_rows, no_docs, library):
    got = sorted(map(tuple, bpe.digests(odd_docs).collect()), key=repr)
    want = []
    for d, t in odd_rows:
        ids = library.encode(t or "", add_special_tokens=False).ids
        want.append((d, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()))
    assert got == sorted(want, key=repr)
    assert bpe.digests(no_docs).count() == 0
    tokens = bpe.encode(odd_docs)
    assert sorted(map(repr, (r[0] for r in bpe.decode(tokens).select("text").collect()))) == sorted(repr(t or "") for _, t in odd_rows)
