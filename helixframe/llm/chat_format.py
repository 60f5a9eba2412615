"""Chat formatting: rendered conversations, their tokens, and a loss mask aligned by offsets.

A turn is rendered as ``<|turn|>role<|text|>text<|end|>``. Inside roles and texts a backslash is doubled and ``<|`` becomes
``<\\|``, so marks never occur there and the template can be read back. Marks are tokens of their own, so tokens never
lie across a turn's edge, and the tokens of a conversation are those of its turns one after another: a long conversation is
rendered in pieces of whole turns without any change to its text, tokens or mask.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable, Iterator, Sequence

import numpy as np
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .byte_level import ByteLevelEncoder
from .common import staged
from .conversations import COLUMNS, in_order, in_tasks, partition

TURN, TEXT, END = MARKS = ("<|turn|>", "<|text|>", "<|end|>")
#: The role whose texts are under the loss mask.
LEARNED = "assistant"
#: Turns, or characters of text, after which a piece of a conversation ends.
PIECE_TURNS, PIECE_CHARS = 256, 1 << 20
#: Pieces of a conversation that wait in memory; one with more is read back in a pass of its own.
WAITING = 8


def escape(text: str) -> str:
    return text.replace("\\", "\\\\").replace("<|", "<\\|")


def unescape(text: str) -> str:
    return re.sub(r"\\(.)", r"\1", text, flags=re.DOTALL)


def render(turns: Iterable[tuple[str, str]]) -> tuple[str, list[tuple[int, int]]]:
    """The text of some turns, and where (in bytes, in order) texts under the loss mask stand in it."""
    out, spans, at = [], [], 0
    for role, text in turns:
        head, body = f"{TURN}{escape(role)}{TEXT}", escape(text)
        start = at + len(head.encode("utf-8", "surrogatepass"))
        stop = start + len(body.encode("utf-8", "surrogatepass"))
        if role == LEARNED and body:
            spans.append((start, stop))
        out += head, body, END
        at = stop + len(END)
    return "".join(out), spans


def token_mask(ends: np.ndarray, spans: Sequence[tuple[int, int]]) -> np.ndarray:
    """Which tokens share bytes with a span: both are in order, so each span's first and last token are found by binary search."""
    covered = np.zeros(len(ends) + 1, dtype=np.int64)
    if spans:
        starts, stops = np.array(spans, dtype=np.int64).T
        begins = np.concatenate([[0], ends[:-1]])
        first, past = np.searchsorted(ends, starts, "right"), np.searchsorted(begins, stops, "left")
        np.add.at(covered, first, 1)
        np.add.at(covered, past, -1)
    return np.cumsum(covered[:-1]) > 0


def read_back(formatted: str, ends: Sequence[int], loss: Sequence[bool]) -> tuple[list[tuple[str, str]], list[str]]:
    """The turns of a rendered text, and the texts under its mask: one for each run of masked tokens, unescaped."""
    body = "(.*?)"
    turns = [(unescape(r), unescape(t)) for r, t in re.findall(re.escape(TURN) + body + re.escape(TEXT) + body + re.escape(END), formatted, re.DOTALL)]
    data, learned, edges = formatted.encode("utf-8", "surrogatepass"), [], np.flatnonzero(np.diff(np.concatenate([[0], np.asarray(loss, dtype=np.int8), [0]])))
    for first, past in zip(edges[::2], edges[1::2]):
        learned.append(unescape(data[ends[first - 1] if first else 0 : ends[past - 1]].decode("utf-8", "surrogatepass")))
    return turns, learned


def share(spark: SparkSession, vocabulary: str, pattern: str) -> Broadcast:
    """Broadcast a vocabulary file: its size, whatever the input."""
    with open(vocabulary, encoding="utf-8") as f:
        return spark.sparkContext.broadcast({"key": f"{vocabulary} {pattern}", "spec": f.read(), "pattern": pattern})


#: One encoder for each Python worker.
_ENCODERS: dict[str, ByteLevelEncoder] = {}


def _encoder(shared: Broadcast) -> ByteLevelEncoder:
    key = shared.value["key"]
    if key not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[key] = ByteLevelEncoder(shared.value["spec"], shared.value["pattern"], MARKS)
    return _ENCODERS[key]


def pieces(given: Iterator[tuple], encoder: ByteLevelEncoder, part: int, piece_turns: int) -> Iterator[tuple]:
    """``conv_id, part, piece, n_turns, formatted, ids, ends, loss`` from rows in order."""

    def made(conv, piece: int, turns: list) -> tuple:
        formatted, spans = render(turns)
        ids = encoder.encode(formatted)
        ends = np.cumsum(encoder.lengths[ids])
        return conv, part, piece, len(turns), formatted, ids.astype(np.int32), ends, token_mask(ends, spans)

    now, piece, turns, chars = None, 0, [], 0
    for conv, _, role, text in given:
        if turns and (conv != now or len(turns) >= piece_turns or chars >= PIECE_CHARS):
            yield made(now, piece, turns)
            piece, turns, chars = piece + 1 if conv == now else 0, [], 0
        now = conv
        turns.append((role or "", text or ""))
        chars += len(text or "")
    if turns:
        yield made(now, piece, turns)


PIECES = T.StructType([
    T.StructField("part", T.IntegerType()), T.StructField("piece", T.IntegerType()), T.StructField("n_turns", T.LongType()), T.StructField("formatted", T.StringType()),
    T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("ends", T.ArrayType(T.LongType())), T.StructField("loss", T.ArrayType(T.BooleanType())),
])


def format_conversations(rows: DataFrame, shared: Broadcast, piece_turns: int = PIECE_TURNS) -> DataFrame:
    """``conv_id, part, piece, n_turns, formatted, ids, ends, loss``: each conversation's turns in order, rendered and encoded.

    ``ids`` are tokens, ``ends`` the byte of ``formatted`` where each ends, ``loss`` whether it belongs to an assistant's text.
    A conversation is one row unless it has more than ``piece_turns`` turns or ``PIECE_CHARS`` characters or lies across the
    edge of a partition; its rows follow each other by (``part``, ``piece``). Reads ``conv_id, turn, role, text`` and no other
    column. Null roles and texts are empty; rows of a null ``conv_id`` are one conversation; turns are in the order of
    ``in_order`` (null turns first, ties by role and text), and repeated rows are repeated turns. No rows give no rows.
    """
    return in_tasks(in_order(rows.select(*COLUMNS)), T.StructType([rows.schema["conv_id"], *PIECES]), lambda given: pieces(given, _encoder(shared), partition(), piece_turns))


class Digest:
    """Sums of a conversation, piece by piece."""

    def __init__(self):
        self.turns, self.learned = hashlib.sha256(), hashlib.sha256()
        self.n_turns = self.loss_chars = self.formatted_chars = 0

    def add(self, formatted: str, ends: Sequence[int], loss: Sequence[bool]) -> None:
        turns, learned = read_back(formatted, ends, loss)
        for role, text in turns:
            self.turns.update(f"{role}\n{text}\n".encode("utf-8", "surrogatepass"))
        for text in learned:
            self.learned.update(text.encode("utf-8", "surrogatepass"))
        self.n_turns += len(turns)
        self.loss_chars += sum(map(len, learned))
        self.formatted_chars += len(formatted)

    def row(self) -> tuple:
        return self.n_turns, self.turns.hexdigest(), self.loss_chars, self.learned.hexdigest(), self.formatted_chars


DIGEST = T.StructType([
    T.StructField("n_turns", T.LongType()), T.StructField("turns_sha256", T.StringType()), T.StructField("loss_chars", T.LongType()), T.StructField("loss_sha256", T.StringType()), T.StructField("formatted_chars", T.LongType()),
])


def digests_inside(given: Iterator[tuple], most: int) -> Iterator[tuple]:
    """From a partition's pieces in order: digests of the conversations that lie inside it; the pieces of the others.

    Others are the first and the last, which may go on in another partition, and those of more than ``most`` pieces.
    """
    none, blank = (None,) * len(DIGEST), (None,) * len(OPEN)
    now, begun, first, passed, waiting = None, False, True, False, []
    for conv, part, piece, _, formatted, _, ends, loss in given:
        if begun and conv != now:
            if first:
                yield from ((now, *none, *w) for w in waiting)
            elif not passed:
                sums = Digest()
                for w in waiting:
                    sums.add(*w[2:])
                yield (now, *sums.row(), *blank)
            first, passed, waiting = False, False, []
        now, begun = conv, True
        waiting.append((part, piece, formatted, ends, loss))
        if passed or len(waiting) > most:
            yield from ((now, *none, *w) for w in waiting)
            waiting, passed = [], True
    yield from ((now, *none, *w) for w in waiting)


def digests_through(given: Iterator[tuple]) -> Iterator[tuple]:
    """Digests of conversations whose pieces come in order; one piece is in memory."""
    now, sums = None, None
    for conv, formatted, ends, loss in given:
        if sums is None or conv != now:
            if sums is not None:
                yield (now, *sums.row())
            now, sums = conv, Digest()
        sums.add(formatted, ends, loss)
    if sums is not None:
        yield (now, *sums.row())


OPEN = T.StructType([PIECES[c] for c in ("part", "piece", "formatted", "ends", "loss")])


def digest_conversations(rows: DataFrame, shared: Broadcast, piece_turns: int = PIECE_TURNS, most: int = WAITING) -> DataFrame:
    """``conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars`` of each conversation, read back from its pieces.

    Rows, pieces and ties as in ``format_conversations``. Conversations inside a partition are digested in the task that
    formats them. Two a partition, and very long ones, are digested in a second pass over their pieces in order: a hash of a
    whole text has to be taken in order, so one task reads a conversation through, a piece at a time.
    """
    conv = rows.schema["conv_id"]
    found = staged(in_tasks(in_order(rows.select(*COLUMNS)), T.StructType([conv, *DIGEST, *OPEN]), lambda given: digests_inside(pieces(given, _encoder(shared), partition(), piece_turns), most)))
    left = found.where("part IS NOT NULL").repartition("conv_id").sortWithinPartitions("conv_id", "part", "piece").select("conv_id", "formatted", "ends", "loss")
    return found.where("part IS NULL").select("conv_id", *DIGEST.names).union(in_tasks(left, T.StructType([conv, *DIGEST]), digests_through))


def with_trial(rows: DataFrame, conv_id: int, text: str) -> DataFrame:
    """Some conversations and one more, whose user and assistant both say ``text``."""
    role = F.when(F.col("id") == 0, "user").otherwise(LEARNED)
    trial = rows.sparkSession.range(2).select(F.lit(conv_id).cast("long").alias("conv_id"), F.col("id").alias("turn"), role.alias("role"), F.lit(text).alias("text"))
    return rows.select(*COLUMNS).unionByName(trial)
