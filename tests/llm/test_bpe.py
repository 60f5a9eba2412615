import hashlib
import random

import pytest

tiktoken = pytest.importorskip("tiktoken")
P = pytest.importorskip("public_tokenizers")

from helixframe.llm import bpe  # noqa: E402

FILE = P.path("byte_bpe_multi_50k.tiktoken")


@pytest.fixture(scope="module")
def vocabulary():
    with open(FILE, "rb") as f:
        return bpe.Vocabulary(bpe.read_ranks(f))


@pytest.fixture(scope="module")
def library(vocabulary):
    return tiktoken.Encoding("t", pat_str=P.PATTERN, mergeable_ranks=vocabulary.ranks, special_tokens={})


def test_same_ids_as_the_library(vocabulary, library):
    encoder = bpe.Encoder(vocabulary, P.PATTERN)
    rng = random.Random(5)
    alphabet = list("abcdeth \n\t\r\x1c\x85\xa0 'sSéñß中文テ😀١½Ⅷ²_.-!#10​́")
    tokens = [t.decode("utf-8", "ignore") for t in vocabulary.tokens]
    for k in range(3000):
        pool, n = (alphabet, rng.randint(0, 40)) if k % 2 else (tokens, rng.randint(1, 12))
        text = "".join(rng.choice(pool) for _ in range(n))
        ids = encoder.encode(text)
        assert ids == library.encode_ordinary(text)
        assert encoder.decode(ids) == text.encode()


def test_long_piece_takes_linear_time(vocabulary, library):
    text = "abcdefghij" * 20_000
    assert bpe.Encoder(vocabulary, P.PATTERN).encode(text) == library.encode_ordinary(text)


def test_every_merge_is_found(vocabulary):
    assert all(vocabulary.left[i] != i for i in range(vocabulary.size) if len(vocabulary.tokens[i]) > 1)


def test_memo_bound_changes_nothing(vocabulary, library, monkeypatch):
    monkeypatch.setattr(bpe, "MEMO_PIECES", 3)
    monkeypatch.setattr(bpe, "MEMO_PAIRS", 3)
    text = "the quick brown fox jumps over the lazy dog and the quick brown cat " * 3
    assert bpe.Encoder(vocabulary, P.PATTERN).encode(text) == library.encode_ordinary(text)


def test_frames(spark, docs, library):
    shared = bpe.share(spark, FILE, P.PATTERN)
    out = bpe.encode(docs.withColumnRenamed("size", "ids"), shared)
    assert out.columns == ["doc_id", "text", "source", "ids"]
    rows = bpe.decode(out, shared).collect()
    assert len(rows) == 9
    for r in rows:
        assert list(r["ids"]) == library.encode_ordinary(r["text"] or "")
        assert bytes(r["bytes"]) == (r["text"] or "").encode()
    digests = {r["doc_id"]: r for r in bpe.round_trip(docs, shared).collect()}
    ids = library.encode_ordinary("short")
    assert digests[8]["n_tokens"] == len(ids)
    assert digests[8]["ids_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
    assert digests[4]["decoded_sha256"] == hashlib.sha256(b"").hexdigest()
    assert bpe.round_trip(docs.limit(0), shared).count() == 0
