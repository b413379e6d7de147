import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from jobweave.llm import tokenfile as K
from tests.conftest import TESTDATA


@pytest.fixture(scope="module")
def definition():
    with open(public_tokenizers.path("word_bpe_49k.json"), encoding="utf-8") as f:
        return f.read()


@pytest.mark.parametrize(("count", "ids"), [(1, 5), (5, 65536), (3000, 65536), (10_000, 7), (4096, 300), (2049, 1)])
def test_coder(count, ids):
    rng = np.random.default_rng(count)
    values = rng.integers(0, ids, count) if ids != 300 else np.minimum(rng.zipf(1.3, count), 299)
    payload = K.pack([7, None], np.array([count - 1, 1]), values, 512)
    docs, sizes, got = K.unpack(payload)
    assert docs == [7, None] and sizes.tolist() == [count - 1, 1] and (got == values).all()


def test_repeats_compress():
    values = np.tile(np.arange(20) * 997, 500)
    assert len(K.pack([1], np.array([len(values)]), values)) < len(values)  # below half of 16 bits an id


def test_damage_is_found():
    values = np.arange(3000) * 7 % 5000
    payload = bytearray(K.pack([1], np.array([3000]), values))
    for at in (2, 30, len(payload) - 900):
        broken = bytearray(payload)
        broken[at] ^= 64
        with pytest.raises(ValueError, match="checksum|segment"):
            K.unpack(bytes(broken))


def test_file(spark, definition, tmp_path):
    rows = [(5, "Hello wörld|x don't 3.5, ok"), (None, "a b | c"), (1, ""), (1, "x" * 50), (2, None), (3, "İstanbul ΣΑΣ é <|endoftext|>　end"), (7, "a<|startoftext|>b <|ENDOFTEXT|> |<|endoftext|>| c"), (7, "a <|endoftext|> b"), (4, "long " * 3000)]
    docs = spark.createDataFrame([(d, t, "k") for d, t in rows], "doc_id long, text string, start string")
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))
    library = Tokenizer.from_str(definition)
    expected, at = [], 0
    for d, t in order:
        ids = [*library.encode(t or "", add_special_tokens=False).ids, 2]
        expected.append((d, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    got = sorted(K.round_trip(docs, definition).collect(), key=lambda r: r.start)
    assert [tuple(r) for r in got] == expected
    path = str(tmp_path / "ids")
    K.write(docs.drop("start"), definition, path, block=64, lanes=3)  # many segments
    read = {(r.doc_id, r.n_tokens): r.ids for r in K.read(spark, path).collect()}
    assert read[4, 3001] == [*library.encode("long " * 3000, add_special_tokens=False).ids, 2]
    assert sorted((tuple(r) for r in K.positions(spark, path).collect()), key=lambda r: r[1]) == expected
    assert K.round_trip(docs.limit(0), definition).count() == 0


def test_against_zlib_at_equal_blocks(spark, definition):
    """Ids of the documents of sf0.001: fewer bytes than zlib at blocks of the same ids."""
    rows = spark.read.parquet(f"{TESTDATA}/sf0.001/documents.parquet").orderBy("doc_id").collect()
    ids, sizes = K.Tokens(definition, 2).encode(pa.array([r.text for r in rows], pa.string()))
    assert ids.tolist() == [i for r in rows for i in [*Tokenizer.from_str(definition).encode(r.text or "", add_special_tokens=False).ids, 2]]
    rival = sum(len(zlib.compress(ids[i : i + K.BLOCK].astype("<u2").tobytes(), 9)) for i in range(0, len(ids), K.BLOCK))
    payload = K.pack([r.doc_id for r in rows], sizes, ids)
    assert len(payload) - 13 * len(rows) < 0.85 * rival
    assert (K.unpack(payload)[2] == ids).all()


def test_chunks_as_the_library(definition):
    """Letters of either case, marks, all kinds of white space, combining marks, special tokens and what only looks like them."""
    rng, library, tokens = np.random.default_rng(5), Tokenizer.from_str(definition), K.Tokens(definition, 2)
    parts = [*"aAbIİKk'st '|<>\t\n\r\x0b\x0c\x1c\x85\u2028\u3000é日1²ſΣσς\u0307\u0301\x7f\x00", "<|endoftext|>", "<|ENDOFTEXT|>", "<|startoftext|>"]
    texts = ["".join(rng.choice(parts, rng.integers(0, 30))) for _ in range(3000)] + [None, "", " \n "]
    ids, sizes = tokens.encode(pa.array(texts))
    ends = np.cumsum(sizes)
    for text, a, b in zip(texts, ends - sizes, ends, strict=True):
        assert ids[a:b].tolist() == [*library.encode(text or "", add_special_tokens=False).ids, 2]
    again = tokens.encode(pa.array(texts).slice(100, 50))
    assert again[0].tolist() == ids[ends[99] : ends[149]].tolist()
    assert tokens.encode(pa.array([], pa.string()))[0].tolist() == []


def test_blocks_are_independent():
    """A block's words don't depend on the blocks beside it."""
    rng = np.random.default_rng(2)
    ids, prior = rng.integers(0, 50, 4000), np.ones(50, np.int64)
    words = K._compress(ids, 1000, prior)
    other = np.concatenate([rng.integers(0, 50, 1000), ids[1000:2000], rng.integers(0, 50, 2000)])
    assert (K._compress(other, 1000, prior)[1] == words[1]).all()


def test_positions_over_many_segments(spark, definition, tmp_path):
    docs = spark.range(3000).selectExpr("id as doc_id", "concat('text ', id, repeat(' word', int(id % 7))) as text").repartition(5)
    path = str(tmp_path / "ids")
    K.write(docs, definition, path, block=16, lanes=20)
    assert spark.read.parquet(path).count() > 20
    at = 0
    for r in K.positions(spark, path).orderBy("doc_id").collect():
        assert r.start == at
        at += r.n_tokens


def test_common_chunks_stay(definition, monkeypatch):
    """When the kept chunks grow too many, those of most blocks stay; a stop after a word makes no new chunk."""
    monkeypatch.setattr(K, "KEPT", 40)
    library, tokens, learnt = Tokenizer.from_str(definition), K.Tokens(definition, 2), []
    learn = tokens.learn
    monkeypatch.setattr(tokens, "learn", lambda new: (learnt.append(new), learn(new)))
    for k in range(20):
        texts = [f"Common words, stay common. x{k}y{k} a.b I'S, 1. é. <|endoftext|>. A, " + " ".join(f"rare{k}q{i}" for i in range(12)), "common.", ".", ", words", None]
        ids, sizes = tokens.encode(pa.array(texts))
        expected = [[*library.encode(t or "", add_special_tokens=False).ids, 2] for t in texts]
        assert ids.tolist() == sum(expected, []) and sizes.tolist() == [len(e) for e in expected]
    for chunk in ("common", "words", "stay", ",", "."):
        assert sum(new.count(chunk) for new in learnt) == 1
    assert not {"common.", "words,"} & {w for new in learnt for w in new} and len(tokens.number) < 80


def test_many_ids_and_long_blocks():
    """All 65,536 ids, up to four levels of sixteen; a block ends in a word of its own, not in four."""
    rng = np.random.default_rng(8)
    for d, n, block in ((65536, 40_000, 2048), (257, 5000, 1024), (16, 3000, 700), (17, 40, 1024)):
        ids = np.concatenate([rng.permutation(d), rng.integers(0, d, n)])
        table, counts, words, sums = K.compress(ids, block)
        sizes = np.array([len(w) for w in words])
        assert (K.expand(table, counts, np.concatenate(words), sizes, np.array(sums), len(ids), block) == ids).all()
    assert len(K._compress(np.zeros(1, np.int64), 1024, np.ones(1, np.int64))[0]) == 1
    with pytest.raises(ValueError, match="block"):
        K.compress(np.zeros(3, np.int64), 1 << 20)
