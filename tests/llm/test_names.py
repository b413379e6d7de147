"""Further columns of any name, and empty tables, through the operators that pass columns on."""

import public_tokenizers

from jobweave.llm import bpe, linededup, neardup, toxicity


def table(spark):
    return spark.createDataFrame([(1, "one two three four five", 7, "x", "p", 0.5, 9), (2, "six seven eight nine ten", 8, "y", "q", 0.6, 9)], ["doc_id", "text", "a.b", "ids", "th", "score", "kept_doc"])


def test_bpe(spark):
    ranks = bpe.read_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    rows = bpe.encoded(table(spark), ranks, public_tokenizers.PATTERN)
    assert rows.columns == ["doc_id", "a.b", "th", "score", "kept_doc", "ids"]
    back = bpe.decoded(rows, ranks).orderBy("doc_id").collect()
    assert [(r.text, r["a.b"], r.th) for r in back] == [("one two three four five", 7, "p"), ("six seven eight nine ten", 8, "q")]
    assert bpe.encoded(table(spark).limit(0), ranks, public_tokenizers.PATTERN).count() == 0


def test_toxicity(spark):
    docs, labels = table(spark), spark.createDataFrame([], "doc_id long, toxic int")
    kept = toxicity.accepted(docs, labels)
    assert kept.columns == docs.columns and sorted(r.score for r in kept.collect()) == [0.5, 0.6]
    assert toxicity.scored(docs, None, 0.0).columns == ["doc_id", "text", "a.b", "ids", "th", "kept_doc", "score"]


def test_near_documents(spark):
    docs = table(spark)
    kept = neardup.representatives(docs.unionByName(docs))
    assert kept.columns == docs.columns and sorted(tuple(r) for r in kept.collect()) == sorted(tuple(r) for r in docs.collect())
    assert neardup.representatives(docs.limit(0)).count() == 0 and linededup.remaining(docs.limit(0)).count() == 0
