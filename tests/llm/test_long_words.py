"""Long words without blanks: pieces, borders and windows give the ids of a whole contraction."""

import random

import pytest

from lumenspool.llm import bpe, ngram_lm, queries


@pytest.fixture(scope="module")
def both():
    import tiktoken

    own = bpe.DuckBpe(queries.tokenizer_path("byte_bpe_multi_50k.tiktoken"))
    return own, tiktoken.Encoding("own", pat_str=r"[\s\S]+", mergeable_ranks=own.ranks, special_tokens={})


ALPHABETS = {"letters": "abcdefghijklmnopqrstuvwxyz", "base64": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/", "few": "abe", "one": "a", "two": "ab"}


@pytest.mark.parametrize("kind", sorted(ALPHABETS))
def test_long_words_equal_tiktoken(both, kind):
    own, whole = both
    rng = random.Random(kind)
    words = ["".join(rng.choice(ALPHABETS[kind]) for _ in range(n)).encode() for n in [*range(62, 70), *range(80, 400, 37), 3000, 100_000]]
    words += [bytes(rng.randrange(256) for _ in range(n)) for n in (64, 500)] + ["".join(rng.choice(["the", "ing", "Straße", "中文", "tion"]) for _ in range(200)).encode()]
    for word, ids in zip(words, own.encode(words), strict=True):
        assert ids == whole._core_bpe.encode_single_piece(word)


def test_queries_are_cut_by_rows(both, monkeypatch):
    own, whole = both
    monkeypatch.setattr(bpe, "ROWS", 500)
    words = [("x" * n + "yz").encode() for n in range(1, 61)] + [b"q" * 200]
    assert own.encode(words) == [whole._core_bpe.encode_single_piece(w) for w in words]


def test_more_types_than_ids_are_refused(spark, monkeypatch):
    monkeypatch.setattr(ngram_lm, "MOST_TYPES", 2)
    docs = spark.createDataFrame([(k, "a b c d") for k in range(9)], "doc_id long, text string")
    with pytest.raises(ValueError, match="word types"):
        ngram_lm.fit(docs)
