"""Alignment of two tokenizers over the same bytes, and how often their tokens meet in a corpus.

Inside a task all tokens of a few megabytes of text are columns of Arrow tables: lists are flattened beside the number of
their document, token ends are sums of byte lengths that start again at each document, and a hash join on (document,
end) finds the places where both tokenizers cut. Between two neighbouring cuts of either tokenizer lies one token of
each, so the outer join, in order, is also the list of overlapping pairs. Partial counts of pairs come from
``Table.group_by``; Spark merges them.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .byte_level import ByteLevelEncoder
from .common import packed, quoted, staged, unpacked, unstage

#: Characters of text that are aligned as one Arrow table; a longer text is a table of its own.
CHUNK = 1 << 20
#: Pairs in a partial count before it is sent on.
PARTIAL = 1 << 20
#: Pair counts (24 bytes each) that are broadcast; more are joined.
BROADCAST_PAIRS = 1 << 21
#: B's ids fit into so many bits beside A's.
SHIFT = 16


class Pair:
    """Both tokenizers and the bytes of their entries."""

    def __init__(self, a_json: str, b_model: bytes, pattern: str):
        import sentencepiece

        self.a = ByteLevelEncoder(a_json, pattern)
        self.b = sentencepiece.SentencePieceProcessor(model_proto=b_model)
        b_bytes = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i in range(self.b.get_piece_size()) for p in [self.b.id_to_piece(i)]]
        self.bytes = {"a": pa.array(self.a.tokens, pa.binary()), "b": pa.array(b_bytes, pa.binary())}
        self.lengths = {"a": self.a.lengths, "b": np.array([len(x) for x in b_bytes], dtype=np.int64)}
        n_a, n_b = len(self.a.tokens), len(b_bytes)
        #: Ids as text: A before A, A at a group's end, B before B, B at a group's end.
        self.written = pa.array([f"{i}{mark}" for n, mark in ((n_a, ","), (n_a, "|"), (n_b, ","), (n_b, ";")) for i in range(n)])

    def encode_b(self, texts: list[str]) -> list[list[int]]:
        return self.b.encode(texts, num_threads=1)


def _lists(parts: list) -> pa.ListArray:
    ends = np.concatenate([[0], np.cumsum([len(x) for x in parts])]).astype(np.int32)
    flat = np.concatenate([np.asarray(x, dtype=np.int32) for x in parts]) if parts else np.zeros(0, np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(flat, pa.int32()))


def _same_bytes(pair: Pair, side: str, lists: pa.ListArray, want: list[bytes]) -> np.ndarray:
    """Which documents' tokens join up to the bytes wanted."""
    joined = pair.bytes[side].take(lists.flatten())
    starts = np.frombuffer(joined.buffers()[1], np.int32, len(joined) + 1)[lists.offsets.to_numpy()] if len(joined) else np.zeros(len(lists) + 1, np.int64)
    data = joined.buffers()[2].to_pybytes() if len(joined) else b""
    return np.array([data[starts[k] : starts[k + 1]] == w for k, w in enumerate(want)], dtype=bool)


def _ends(pair: Pair, side: str, lists: pa.ListArray) -> pa.Table:
    """``key`` (document and byte end, as one number) and the place of each token of a batch."""
    flat, doc = lists.flatten(), pc.list_parent_indices(lists)
    total = pc.cumulative_sum(pa.array(pair.lengths[side][flat.to_numpy()]))
    # The sum starts again at each document: less what was there when it began.
    before = np.concatenate([[0], total.to_numpy()])[lists.offsets.to_numpy()[:-1]] if len(flat) else np.zeros(len(lists), np.int64)
    end = pc.subtract(total, pa.array(before).take(doc))
    key = pc.add(pc.shift_left(doc.cast(pa.int64()), 32), end)
    return pa.table({"key": key, side: pa.array(np.arange(len(flat)))})


def align_texts(pair: Pair, texts: list[str | None]) -> pa.Table:
    """One row a text: ``a_ids, b_ids``, ``groups`` (as ``a1,a2|b1;a3|b2``), counts, and its distinct linked pairs.

    Columns ``n_a, n_b, n_groups, n_links``; ``link_a, link_b, link_times``: each pair of ids that overlap in the text and
    how many pairs of their occurrences do. No tokens for null and empty texts and those that a tokenizer does not give
    back byte by byte.
    """
    n, texts = len(texts), [t or "" for t in texts]
    want = [(" " + t).encode("utf-8", "surrogatepass") for t in texts]
    a = _lists([pair.a.encode(" " + t) if t else () for t in texts])
    b = _lists(pair.encode_b(texts) if texts else [])
    whole = _same_bytes(pair, "a", a, want) & _same_bytes(pair, "b", b, want) & np.array([bool(t) for t in texts], dtype=bool)
    if not whole.all():
        a, b = (_lists([v.values.to_numpy() if keep else () for v, keep in zip(x, whole)]) for x in (a, b))
    a_flat, b_flat = a.flatten().to_numpy(), b.flatten().to_numpy()
    both = _ends(pair, "a", a).join(_ends(pair, "b", b), keys="key", join_type="full outer", use_threads=False).sort_by("key")
    doc = (both["key"].to_numpy() >> 32).astype(np.int64)
    at_a, at_b = both["a"].combine_chunks(), both["b"].combine_chunks()
    cut = pc.and_(at_a.is_valid(), at_b.is_valid()).to_numpy(zero_copy_only=False)
    # A document's last end is common, so filling from behind stays inside it.
    of_a = pc.fill_null_backward(at_a).to_numpy().astype(np.int64)
    of_b = pc.fill_null_backward(at_b).to_numpy().astype(np.int64)
    # Groups: a token belongs to the first cut at or after its end.
    group = np.cumsum(cut) - cut
    group_a, group_b = group[at_a.is_valid().to_numpy(zero_copy_only=False)], group[at_b.is_valid().to_numpy(zero_copy_only=False)]
    n_groups = int(cut.sum())
    per_a, per_b = np.bincount(group_a, minlength=n_groups), np.bincount(group_b, minlength=n_groups)
    last = lambda g: np.append(g[1:] != g[:-1], True) if len(g) else np.zeros(0, bool)
    # A group's tokens of A stand before those of B.
    written = np.zeros(len(a_flat) + len(b_flat), dtype=np.int64)
    before_b, up_to_a = np.concatenate([[0], np.cumsum(per_b)]), np.cumsum(per_a)
    n_a_words, n_b_words = len(pair.lengths["a"]), len(pair.lengths["b"])
    if len(written):
        written[np.arange(len(a_flat)) + before_b[group_a]] = a_flat + n_a_words * last(group_a)
        written[np.arange(len(b_flat)) + up_to_a[group_b]] = 2 * n_a_words + b_flat + n_b_words * last(group_b)
    n_a, n_b = np.diff(a.offsets.to_numpy()), np.diff(b.offsets.to_numpy())
    tokens = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(n_a + n_b)]).astype(np.int32)), pair.written.take(pa.array(written)))
    groups = pc.utf8_slice_codeunits(pc.binary_join(tokens, ""), 0, -1) if n else pa.array([], pa.string())
    ids = (a_flat[of_a].astype(np.int64) << SHIFT) | b_flat[of_b] if len(doc) else np.zeros(0, np.int64)
    linked = pa.table({"at": pa.array((doc << 32) | ids)}).group_by("at", use_threads=False).aggregate([([], "count_all")]).sort_by("at")
    at, times = linked["at"].to_numpy(), linked["count_all"].combine_chunks().cast(pa.int32())
    starts = pa.array(np.searchsorted(at, np.arange(n + 1, dtype=np.int64) << 32).astype(np.int32))
    listed = lambda values: pa.ListArray.from_arrays(starts, values)
    counted = lambda where: pa.array(np.bincount(where, minlength=n).astype(np.int64))
    return pa.table({
        "a_ids": a, "b_ids": b, "groups": groups, "n_a": pa.array(n_a.astype(np.int64)), "n_b": pa.array(n_b.astype(np.int64)),
        "n_groups": counted(doc[cut]), "n_links": counted(doc),
        "link_a": listed(pa.array(((at >> SHIFT) & 0xFFFF).astype(np.int32))), "link_b": listed(pa.array((at & 0xFFFF).astype(np.int32))), "link_times": listed(times),
    })


#: One pair of tokenizers for each Python worker.
_PAIRS: dict[str, Pair] = {}


def _pair(shared: Broadcast) -> Pair:
    key = shared.value["key"]
    if key not in _PAIRS:
        _PAIRS.clear()
        _PAIRS[key] = Pair(shared.value["a"], shared.value["b"], shared.value["pattern"])
    return _PAIRS[key]


def share(spark: SparkSession, a_json: str, b_model: str, pattern: str) -> Broadcast:
    """Broadcast both vocabulary files: their size, whatever the input."""
    with open(a_json, encoding="utf-8") as a, open(b_model, "rb") as b:
        return spark.sparkContext.broadcast({"key": f"{a_json} {b_model} {pattern}", "a": a.read(), "b": b.read(), "pattern": pattern})


LINKS = T.StructType([T.StructField(f"link_{c}", T.ArrayType(T.IntegerType())) for c in ("a", "b", "times")])
COUNTS = T.StructType([T.StructField(c, T.LongType()) for c in ("n_a", "n_b", "n_groups", "n_links")])


def _chunks(texts: pa.Array) -> Iterator[tuple[int, int]]:
    """Runs of rows with about ``CHUNK`` characters."""
    size, first = pc.fill_null(pc.utf8_length(texts), 0).to_numpy(), 0
    total = 0
    for k, s in enumerate(size):
        total += s
        if total >= CHUNK:
            yield first, k + 1
            first, total = k + 1, 0
    if first < len(size):
        yield first, len(size)


def align(docs: DataFrame, shared: Broadcast, text: str = "text", hashed: bool = False) -> DataFrame:
    """Add ``a_ids, b_ids, groups, n_a, n_b, n_groups, n_links, link_a, link_b, link_times`` (see ``align_texts``) to each row.

    With ``hashed``, ``groups_sha256`` (empty for a text without tokens) stands in place of ids and groups. Columns of these
    names are replaced, others stay. Rows are independent: no shuffle. Repeated rows and null ids are rows like others;
    an empty table gives an empty one.
    """
    lists = T.StructType([T.StructField("a_ids", T.ArrayType(T.IntegerType())), T.StructField("b_ids", T.ArrayType(T.IntegerType())), T.StructField("groups", T.StringType())])
    own = T.StructType([*(T.StructType([T.StructField("groups_sha256", T.StringType())]) if hashed else lists), *COUNTS, *LINKS])
    rows = packed(docs, _text=F.col(text))
    schema = T.StructType([rows.schema["row"], *own])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair = _pair(shared)
        for batch in batches:
            for lo, hi in _chunks(batch.column(1)):
                found = align_texts(pair, batch.column(1).slice(lo, hi - lo).to_pylist())
                if hashed:
                    found = found.append_column("groups_sha256", pa.array([hashlib.sha256(g.encode()).hexdigest() if g else "" for g in found["groups"].to_pylist()], pa.string()))
                columns = [found[c].combine_chunks() for c in own.names]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), *columns], names=schema.names)

    out = rows.mapInArrow(run, schema)
    return unpacked(out, **{c: F.col(c) for c in own.names})


def _counted(table: pa.Table) -> pa.Table:
    return table.group_by("pair", use_threads=False).aggregate([("docs", "sum")]).rename_columns(["pair", "docs"])


def pair_counts(aligned: DataFrame) -> DataFrame:
    """``pair, docs, best``: rows whose text links A's and B's id (``pair`` = a << 16 | b), and whether that is its A id's most.

    Partial counts of up to ``PARTIAL`` pairs in each task are merged by Spark.
    """
    schema = T.StructType([T.StructField("pair", T.LongType()), T.StructField("docs", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept = None
        for batch in batches:
            a, b = (batch.column(k).flatten().to_numpy().astype(np.int64) for k in (0, 1))
            new = _counted(pa.table({"pair": pa.array((a << SHIFT) | b), "docs": pa.array(np.ones(len(a), np.int64))}))
            kept = new if kept is None else _counted(pa.concat_tables([kept, new]))
            if len(kept) >= PARTIAL:
                yield from kept.to_batches()
                kept = None
        if kept is not None:
            yield from kept.to_batches()

    partial = aligned.select("link_a", "link_b").mapInArrow(run, schema)
    counts = staged(partial.groupBy("pair").agg(F.sum("docs").alias("docs")))
    most = counts.groupBy(F.shiftright("pair", SHIFT).alias("a")).agg(F.max("docs").alias("most"))
    joined = counts.withColumn("a", F.shiftright("pair", SHIFT)).join(most, "a")
    out = staged(joined.select("pair", "docs", (F.col("docs") == F.col("most")).alias("best")))
    unstage(counts)
    return out


def _beside_links(aligned: DataFrame) -> DataFrame:
    """The links, and all other columns as one struct."""
    rest = [c for c in aligned.columns if c not in LINKS.names]
    return aligned.select(F.struct(*[F.col(quoted(c)) for c in rest]).alias("row"), *LINKS.names)


def _scored_by_broadcast(aligned: DataFrame, counts: DataFrame, out: T.StructType) -> DataFrame:
    """Pair counts as sorted arrays in each worker; rows as they are."""
    table = counts.toArrow().sort_by("pair")
    shared = aligned.sparkSession.sparkContext.broadcast({c: table[c].to_numpy() for c in table.column_names})
    rows = _beside_links(aligned)
    schema = T.StructType([rows.schema["row"], *out])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs, docs, best = (shared.value[c] for c in ("pair", "docs", "best"))
        for batch in batches:
            lists = batch.column(1)
            a, b, times = (batch.column(k).flatten().to_numpy().astype(np.int64) for k in (1, 2, 3))
            at = np.searchsorted(pairs, (a << SHIFT) | b)
            row = pc.list_parent_indices(lists).to_numpy()
            sums = []
            for value in (best, docs):
                total = np.zeros(len(batch), np.int64)
                np.add.at(total, row, times * value[at] if len(at) else times)
                sums.append(pa.array(total))
            yield pa.RecordBatch.from_arrays([batch.column(0), *sums], names=schema.names)

    return unpacked(rows.mapInArrow(run, schema), **{c: F.col(c) for c in out.names})


def _scored_by_join(aligned: DataFrame, counts: DataFrame, out: T.StructType) -> DataFrame:
    """Pairs of each row meet their counts in a join; rows are told apart by a number."""
    rows = staged(_beside_links(aligned).withColumn("at", F.monotonically_increasing_id()))
    links = rows.select("at", F.explode(F.arrays_zip(*LINKS.names)).alias("l"))
    pair = F.shiftleft(F.col("l.link_a").cast("long"), SHIFT) + F.col("l.link_b")
    met = links.select("at", pair.alias("pair"), F.col("l.link_times").alias("times")).join(counts, "pair")
    sums = met.groupBy("at").agg(F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("n_best"), F.sum(F.col("times") * F.col("docs")).alias("count_sum"))
    both = rows.drop(*LINKS.names).join(sums, "at", "left")
    return unpacked(both, **{c: F.coalesce(c, F.lit(0)).cast("long") for c in out.names})


def score(aligned: DataFrame, counts: DataFrame, most: int = BROADCAST_PAIRS) -> DataFrame:
    """Replace the links of ``align`` by ``n_best`` and ``count_sum``: links whose count is their A id's highest, and the sum of counts.

    ``counts`` is ``pair_counts`` of the same rows. Up to ``most`` pairs are broadcast, more are joined: the same results.
    """
    out = T.StructType([T.StructField("n_best", T.LongType()), T.StructField("count_sum", T.LongType())])
    return (_scored_by_broadcast if counts.count() <= most else _scored_by_join)(aligned, counts, out)
