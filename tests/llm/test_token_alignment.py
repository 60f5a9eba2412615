import hashlib
import json
from collections import Counter

import public_tokenizers
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from helixframe.llm import token_alignment as ta
from helixframe.llm.byte_level import byte_of_char

A_FILE, B_FILE = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
TEXTS = [
    "hello wörld", None, "", "a▁b", "x", "  \n", "<|endoftext|> </s> <unk> <0x0A>", "naïve 你好 \U0001f9ff́ \t tab", "the the the the", "one two, three; four|five",
    "the the the the", "word " * 4000, "ﬁ Å     x‍", "\x00\x01", "Don't we'll 12345 67", "a" * 5000, " " * 30_000 + "x",
]


@pytest.fixture(scope="module")
def shared(spark):
    return ta.share(spark, A_FILE, B_FILE, public_tokenizers.PATTERN)


class Plain:
    """Token by token, and every pair of tokens compared."""

    def __init__(self):
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(A_FILE)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=B_FILE)
        at = byte_of_char()
        self.a_bytes = {i: bytes(at[c] for c in t) for t, i in json.load(open(A_FILE))["model"]["vocab"].items() if t != "<|endoftext|>"}

    def b_token(self, i):
        piece = self.b.id_to_piece(i)
        return bytes([int(piece[3:5], 16)]) if self.b.is_byte(i) else piece.replace("▁", " ").encode()

    def spans(self, tokens):
        out, at = [], 0
        for i, b in tokens:
            out.append((i, at, at + len(b)))
            at += len(b)
        return out

    def align(self, text):
        want = (" " + (text or "")).encode()
        a = self.spans([(i, self.a_bytes[i]) for i in self.a.encode(" " + (text or ""), add_special_tokens=False).ids])
        b = self.spans([(i, self.b_token(i)) for i in self.b.encode(text or "")])
        joined = b"".join(self.a_bytes[i] for i, _, _ in a), b"".join(self.b_token(i) for i, _, _ in b)
        if not text or joined != (want, want):
            return 0, 0, [], []
        ends = sorted({e for _, _, e in a} & {e for _, _, e in b})
        groups = [[[i for i, _, e in side if lo < e <= hi] for side in (a, b)] for lo, hi in zip([0, *ends], ends)]
        # Only tokens near each other can overlap; b is in order.
        links, first = [], 0
        for i, s, e in a:
            while b[first][2] <= s:
                first += 1
            k = first
            while k < len(b) and b[k][1] < e:
                links.append((i, b[k][0]))
                k += 1
        return len(a), len(b), groups, links


def plain(texts):
    each = [Plain().align(t) for t in texts] if len(texts) < 4 else [p.align(t) for p in [Plain()] for t in texts]
    count = Counter(pair for *_, links in each for pair in set(links))
    most = Counter()
    for (a, _), n in count.items():
        most[a] = max(most[a], n)
    out = []
    for n_a, n_b, groups, links in each:
        text = ";".join("|".join(",".join(map(str, side)) for side in g) for g in groups)
        out.append((
            n_a, n_b, len(groups), len(links), sum(count[x] == most[x[0]] for x in links), sum(count[x] for x in links), hashlib.sha256(text.encode()).hexdigest() if n_a else "",
        ))
    return out


COLUMNS = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


@pytest.mark.parametrize("most", [ta.BROADCAST_PAIRS, 3])
def test_same_as_token_by_token(spark, shared, most):
    docs = spark.createDataFrame([(k, t) for k, t in enumerate(TEXTS)], "doc_id long, text string").repartition(3)
    aligned = docs.transform(ta.align, shared, hashed=True)
    got = {r["doc_id"]: tuple(r[c] for c in COLUMNS) for r in ta.score(aligned, ta.pair_counts(aligned), most).collect()}
    assert [got[k] for k in range(len(TEXTS))] == plain(TEXTS)


def test_partial_counts_are_merged(spark, shared, monkeypatch):
    docs = spark.createDataFrame([(k, t) for k, t in enumerate(TEXTS)], "doc_id long, text string")
    want = sorted(map(tuple, ta.pair_counts(ta.align(docs, shared)).collect()))
    monkeypatch.setattr(ta, "PARTIAL", 2)
    monkeypatch.setattr(ta, "CHUNK", 10)
    assert sorted(map(tuple, ta.pair_counts(ta.align(docs.repartition(5), shared)).collect())) == want


def test_ids_groups_and_links(spark, shared):
    row = ta.align(spark.createDataFrame([("hello wörld",)], "text string"), shared).first()
    a, b = row["a_ids"], row["b_ids"]
    groups = [[list(map(int, s.split(","))) for s in g.split("|")] for g in row["groups"].split(";")]
    assert sum((g[0] for g in groups), []) == a and sum((g[1] for g in groups), []) == b
    assert set(zip(row["link_a"], row["link_b"])) >= {(a[0], b[0]), (a[-1], b[-1])} and sum(row["link_times"]) == row["n_links"]


def test_other_columns_nulls_repeats_and_an_empty_table(spark, shared):
    names = ["row", "_text", "pair", "docs", "best", "at", "key", "a.b", "N_A", "link_a"]
    docs = spark.createDataFrame([(None, "one two"), (1, "one two"), (1, "one two"), (2, None)], "doc_id long, text string").select("*", *[F.lit(c).alias(c) for c in names])
    for most in (ta.BROADCAST_PAIRS, 0):
        aligned = ta.align(docs, shared, hashed=True)
        out = ta.score(aligned, ta.pair_counts(aligned), most)
        assert len({c.lower() for c in out.columns}) == len(out.columns)
        rows = out.collect()
        assert all(r[c] == c for r in rows for c in names if c not in ("N_A", "link_a"))
        assert sorted((str(r["doc_id"]), r["count_sum"]) for r in rows) == [("1", 6), ("1", 6), ("2", 0), ("None", 6)]
    empty = ta.align(docs.where("false"), shared, hashed=True)
    assert ta.score(empty, ta.pair_counts(empty)).count() == 0
    assert isinstance(ta.align(docs, shared).schema["a_ids"].dataType, T.ArrayType)
