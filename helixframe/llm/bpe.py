"""Exact byte-level BPE: encoding by backtracking over longest matches, and decoding."""

from __future__ import annotations

import base64
import hashlib
from array import array
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import packed, quoted, unpacked

#: Bounds of the memos that each Python worker keeps, in entries. They save time only: a full memo is emptied.
MEMO_PIECES, MEMO_PAIRS = 600_000, 500_000
#: Pieces longer than this many characters are encoded but not kept.
MEMO_CHARS = 64


def read_ranks(lines: Iterable[bytes]) -> dict[bytes, int]:
    """Ranks from lines of ``base64(token) rank``; a token's id is its rank."""
    return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


class Vocabulary:
    """Tables over a rank list: the automaton, each token's next shorter prefix token, and its last merge.

    Bytes stand as Latin-1 characters, so that the automaton, which takes text, sees one character for each byte.
    """

    def __init__(self, ranks: dict[bytes, int]):
        import ahocorasick

        self.ranks = ranks
        self.size = max(ranks.values()) + 1
        self.tokens: list[bytes] = [b""] * self.size
        for token, rank in ranks.items():
            self.tokens[rank] = token
        self.automaton = ahocorasick.Automaton()
        for token, rank in ranks.items():
            self.automaton.add_word(token.decode("latin-1"), rank)
        self.automaton.make_automaton()
        self.lengths = list(map(len, self.tokens))
        self._memo: dict[tuple[int, int], bool] = {}
        self.prefix = array("i", [-1] * self.size)
        self.left, self.right = array("i", range(self.size)), array("i", range(self.size))
        self.merged: dict[tuple[int, int], int] = {}
        for rank in range(self.size):
            token = self.tokens[rank]
            for n in range(len(token) - 1, 0, -1):
                if (p := ranks.get(token[:n])) is not None:
                    self.prefix[rank] = p
                    break
        for rank in range(self.size):
            self._find_merge(rank)
        self._memo.clear()

    def _find_merge(self, rank: int) -> None:
        """The two tokens whose merge makes this one: earlier tokens that stay apart until their merge."""
        token, p = self.tokens[rank], self.prefix[rank]
        while p >= 0:
            rest = self.ranks.get(token[len(self.tokens[p]):])
            if rest is not None and p < rank and rest < rank and self._apart(p, rest, rank):
                self.left[rank], self.right[rank] = p, rest
                self.merged[p, rest] = rank
                return
            p = self.prefix[p]

    def _apart(self, a: int, b: int, limit: int) -> bool:
        """Whether tokens a and b, side by side, are never merged across their border by a merge below ``limit``.

        Undoes their merges latest first; at each step the two tokens at the border must not have a merge that
        would have come before the one just undone.
        """
        merged, left, right = self.merged, self.left, self.right
        while True:
            if merged.get((a, b), limit) < limit:
                return False
            a_whole, b_whole = right[a] == a, left[b] == b
            if a_whole and b_whole:
                return True
            # The later of the two merges is undone; of equal ones the left came first.
            if b_whole or (not a_whole and a > b):
                limit, a = a, right[a]
            else:
                limit, b = b + 1, left[b]

    def compatible(self, a: int, b: int) -> bool:
        """Whether BPE leaves tokens a and b side by side; remembered for each pair."""
        key = (a, b)
        known = self._memo.get(key)
        if known is None:
            if len(self._memo) >= MEMO_PAIRS:
                self._memo.clear()
            known = self._memo[key] = self._apart(a, b, self.size)
        return known

    def encode_piece(self, piece: bytes) -> list[int]:
        """Ids of one piece between split points, as merging by rank would give them, in linear time.

        Takes the longest token that starts at a place; where no token that fits its left neighbour leads on, goes
        back one token and tries its next shorter prefix. A place found hopeless is never tried again.
        """
        whole = self.ranks.get(piece)
        if whole is not None:
            return [whole]
        longest = [-1] * len(piece)
        lengths = self.lengths
        # For one start, later ends are longer.
        for end, rank in self.automaton.iter(piece.decode("latin-1")):
            longest[end + 1 - lengths[rank]] = rank
        prefix, compatible = self.prefix, self.compatible
        n, at, out = len(piece), 0, []
        hopeless = set()
        token = longest[0]
        while at < n:
            end = at + lengths[token]
            if end not in hopeless and (not out or compatible(out[-1], token)):
                out.append(token)
                at = end
                if at < n:
                    token = longest[at]
            elif prefix[token] >= 0:
                token = prefix[token]
            else:
                hopeless.add(at)
                token = out.pop()
                at -= lengths[token]
        return out


class Encoder:
    """Encodes whole texts: splits by the pattern, encodes each match, remembers short matches."""

    def __init__(self, vocabulary: Vocabulary, pattern: str):
        import regex

        self.vocabulary = vocabulary
        # In the tokenizer's own regular expressions \s is Unicode's White_Space.
        self.find = regex.compile(pattern.replace("\\s", "\\p{White_Space}").replace("\\S", "\\P{White_Space}")).findall
        self.pieces: dict[str, list[int]] = {}

    def _piece(self, piece: str) -> list[int]:
        got = self.vocabulary.encode_piece(piece.encode("utf-8", "surrogatepass"))
        if len(piece) <= MEMO_CHARS:
            if len(self.pieces) >= MEMO_PIECES:
                self.pieces.clear()
            self.pieces[piece] = got
        return got

    def encode(self, text: str) -> list[int]:
        ids: list[int] = []
        known, new = self.pieces.get, self._piece
        for piece in self.find(text):
            ids += known(piece) or new(piece)
        return ids

    def decode(self, ids: Iterable[int]) -> bytes:
        return b"".join(map(self.vocabulary.tokens.__getitem__, ids))


#: One encoder for each Python worker and vocabulary.
_ENCODERS: dict[int, Encoder] = {}


def _encoder(shared: Broadcast) -> Encoder:
    key = shared.value["key"]
    if key not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[key] = Encoder(shared.value["vocabulary"], shared.value["pattern"])
    return _ENCODERS[key]


def _state(self: Vocabulary) -> dict:
    return {k: v for k, v in self.__dict__.items() if k != "automaton"}


def _restore(self: Vocabulary, state: dict) -> None:
    import ahocorasick

    self.__dict__.update(state)
    self.automaton = ahocorasick.Automaton()
    for token, rank in self.ranks.items():
        self.automaton.add_word(token.decode("latin-1"), rank)
    self.automaton.make_automaton()


Vocabulary.__getstate__, Vocabulary.__setstate__ = _state, _restore


def share(spark: SparkSession, rank_file: str, pattern: str) -> Broadcast:
    """Broadcast the tables of a vocabulary: the size of the rank file, whatever the input."""
    with open(rank_file, "rb") as lines:
        vocabulary = Vocabulary(read_ranks(lines))
    return spark.sparkContext.broadcast({"key": rank_file + pattern, "vocabulary": vocabulary, "pattern": pattern})


def encode(docs: DataFrame, shared: Broadcast, text: str = "text", ids: str = "ids") -> DataFrame:
    """Add ``ids array<int>`` to each row (a column of that name, in any case, is replaced); null and empty text give no ids.

    Rows are independent: no shuffle, one Arrow batch of rows in memory at a time. Without special tokens.
    """
    rows = packed(docs, text=F.col(quoted(text)))
    schema = T.StructType([rows.schema["row"], T.StructField(ids, T.ArrayType(T.IntegerType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(shared)
        for batch in batches:
            got = [encoder.encode(t or "") for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(got, pa.list_(pa.int32()))], names=schema.names)

    return unpacked(rows.mapInArrow(run, schema), **{ids: F.col(quoted(ids))})


def decode(rows: DataFrame, shared: Broadcast, ids: str = "ids", out: str = "bytes") -> DataFrame:
    """Add ``bytes binary``: the bytes that ``ids`` stand for; null ids give empty bytes. Unknown ids raise."""
    given = packed(rows, ids=F.col(quoted(ids)))
    schema = T.StructType([given.schema["row"], T.StructField(out, T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(shared)
        for batch in batches:
            got = [encoder.decode(x or ()) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(got, pa.binary())], names=schema.names)

    return unpacked(given.mapInArrow(run, schema), **{out: F.col(quoted(out))})


def round_trip(docs: DataFrame, shared: Broadcast, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Encode each text and decode its ids again: ``key, n_tokens, ids_sha256, decoded_sha256``.

    The same encoder as ``encode``, digested in the worker, so that the ids need not leave it. A null or empty text has no ids;
    repeated rows and null keys are rows like others; no rows give no rows; other columns are not read.
    """
    schema = docs.select(key).schema.add("n_tokens", T.LongType()).add("ids_sha256", T.StringType()).add("decoded_sha256", T.StringType())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(shared)
        numbers = [str(i) for i in range(encoder.vocabulary.size)]
        for batch in batches:
            n, ids_hash, bytes_hash = [], [], []
            for t in batch.column(1).to_pylist():
                ids = encoder.encode(t or "")
                n.append(len(ids))
                ids_hash.append(hashlib.sha256(",".join(map(numbers.__getitem__, ids)).encode()).hexdigest())
                bytes_hash.append(hashlib.sha256(encoder.decode(ids)).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n, pa.int64()), pa.array(ids_hash, pa.string()), pa.array(bytes_hash, pa.string())],
                names=schema.names,
            )

    return docs.select(key, text).mapInArrow(run, schema)
