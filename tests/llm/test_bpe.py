import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
import tiktoken

from jobweave.llm import bpe


@pytest.fixture(scope="module")
def ranks():
    return bpe.read_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))


@pytest.fixture(scope="module")
def library(ranks):
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_random_texts(ranks, library):
    rng = random.Random(2)
    encoder = bpe.Encoder(ranks, public_tokenizers.PATTERN, kept=500)
    block = ["".join(rng.choices(["a", "ab", "the", " ", "  ", "\n", "é", "日本", "한국어", "́", "123", "'s", "!!", "😀", "aaaa", "\t", "İ", "\x00", "<|endoftext|>"], k=rng.randrange(40))) for _ in range(1500)]
    for i in range(0, len(block), 300):
        ids, sizes = encoder.encode(block[i : i + 300])
        for text, own in zip(block[i : i + 300], np.split(ids, np.cumsum(sizes)[:-1]), strict=True):
            assert own.tolist() == library.encode_ordinary(text) and encoder.vocabulary.decode(own) == text.encode()


def test_lower_rank_goes_first():
    """A merge that makes a pair of lower rank must yield to it."""
    ranks = {bytes([b]): b for b in range(256)} | {b"ab": 300, b"abab": 260, b"ba": 400, b"aba": 299}
    library = tiktoken.Encoding("own", pat_str=r"\w+", mergeable_ranks=dict(ranks), special_tokens={})
    encoder = bpe.Encoder(ranks, r"\w+")
    for text in ("abababab", "aabbaabab", "babab", "ababa", "a" * 50 + "b"):
        assert encoder.encode([text])[0].tolist() == library.encode_ordinary(text)


def test_one_long_word(ranks, library):
    text = "ab" * 60_000 + "x" * 50_000
    assert bpe.Encoder(ranks, public_tokenizers.PATTERN).encode([text])[0].tolist() == library.encode_ordinary(text)


def test_frames(spark, ranks, library):
    rows = [(1, "Hello wörld", "k"), (None, None, None), (2, "", "e"), (2, "", "e")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_tokens string")
    got = bpe.digests(docs, ranks, public_tokenizers.PATTERN, with_ids=True).collect()
    for r, (_, text, _) in zip(got, rows, strict=True):
        ids = library.encode_ordinary(text or "")
        assert (r.ids, r.n_tokens) == (ids, len(ids))
        assert r.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest() and r.decoded_sha256 == hashlib.sha256((text or "").encode()).hexdigest()
    back = bpe.decoded(bpe.encoded(docs, ranks, public_tokenizers.PATTERN), ranks)
    assert [(r.doc_id, r.text, r.n_tokens) for r in back.collect()] == [(d, t or "", k) for d, t, k in rows]
    assert bpe.digests(docs.limit(0), ranks, public_tokenizers.PATTERN).count() == 0
