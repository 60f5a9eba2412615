"""N-gram Jaccard self-join with adaptive multi-match prefixes, and its connected components."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import staged, unstage
from .components import connected_components

#: The frequency sketch has about as many counters as there are rows, but 2 ** 18 at least and 2 ** 22 (16 MB) at most.
SKETCH_BITS = (18, 22)
#: Longest extension of a prefix: at most this many tokens must match.
MOST_MATCHES = 4
#: Token lists up to this length are paired directly; longer ones through pivots.
DIRECT = 32
#: Sets of a long list that are compared as one block, and columns of a block that are multiplied at once.
SETS, COLUMNS = 256, 4096
#: How often sets that share too little with all others of their blocks are looked for, before blocks are multiplied.
ROUNDS = 2
#: Up to this many ids of texts are broadcast, more are shuffled.
BROADCAST_IDS = 300_000
#: Texts that are compared with one pivot in one group.
BLOCK = 64
#: Fixed odd multipliers and a seed for byte values; any would do.
_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)
_BASE = 0xC2B2AE3D27D4EB4F
_VALUES = np.random.default_rng(20240229).integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)
#: Multipliers of the places in a shingle, drawn apart from the base, for shingles of up to 64 words.
_PLACES = np.random.default_rng(20240301).integers(1, 1 << 63, 64, dtype=np.uint64) | np.uint64(1)
_INK = ~np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _up_to(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2 ** 64, at least n of each."""
    if len(_powers[0]) < n:
        size = 1 << n.bit_length()
        for k, base in enumerate((_BASE, pow(_BASE, -1, 1 << 64))):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            _powers[k] = np.cumprod(steps)
    return _powers[0], _powers[1]


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * _B
    x = (x ^ (x >> np.uint64(29))) * _A
    return x ^ (x >> np.uint64(32))


def word_hashes(text: str | None) -> np.ndarray:
    """A 64-bit hash of each ``[^\\x20\\x09-\\x0D]+`` word, A-Z lower-cased, from prefix sums over the bytes."""
    # bytes.lower knows ASCII only.
    b = np.frombuffer((text or "").encode("utf-8", "surrogatepass").lower(), np.uint8)
    if not len(b):
        return np.zeros(0, np.uint64)
    edges = np.flatnonzero(np.diff(_INK[b], prepend=False, append=False))
    power, inverse = _up_to(len(b) + 1)
    sums = np.zeros(len(b) + 1, np.uint64)
    np.cumsum(_VALUES[b] * power[: len(b)], out=sums[1:])
    starts = edges[::2]
    return (sums[edges[1::2]] - sums[starts]) * inverse[starts]


def shingles(text: str | None, words: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of a text's word shingles; a shorter text is one shingle, one without words none."""
    ids = word_hashes(text)
    n = len(ids)
    if not n:
        return ids
    k = min(words, n)
    ids = _mix(ids)
    h = np.full(n - k + 1, k, np.uint64)
    for i in range(k):
        h += ids[i: n - k + 1 + i] * _PLACES[i]
    h = _mix(h)
    h.sort()
    return h[np.concatenate([[True], h[1:] != h[:-1]])]


def _plan_prefix(tokens: np.ndarray, f: np.ndarray, num: int, den: int) -> tuple[int, int]:
    """Prefix length and number of matches asked for, by the least estimated cost.

    A prefix of p + l - 1 of the rarest tokens must share l tokens with any partner. Its cost is the length of the
    token lists it scans, and a verification, as long as the set, for each candidate; at most (list lengths) / l
    documents can share l tokens.
    """
    n = len(tokens)
    p = n - -(-n * num // den) + 1
    most = min(MOST_MATCHES, n - p + 1)
    scan = np.cumsum(f[: p + most - 1])
    ls = np.arange(1, most + 1)
    scans = scan[p - 1 + ls - 1]
    ls_cost = scans + n * np.maximum(scans - (p + ls - 1), 0) / ls
    l = int(np.argmin(ls_cost)) + 1
    return p + l - 1, l


class _Order:
    """One total order of tokens: by sketched frequency, then by hash."""

    def __init__(self, counts: np.ndarray):
        self.counts = counts
        self.shift = np.uint64(64 - int(len(counts)).bit_length() + 1)
        self.base = float(np.median(counts))

    def sorted(self, tokens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        c = self.counts[(tokens >> self.shift).astype(np.int64)]
        at = np.lexsort((tokens, c))
        return tokens[at], np.maximum(c[at] - self.base, 1.0)


def sketch(docs: DataFrame, words: int, bits: int) -> np.ndarray:
    """Counters of all shingles of all documents: ``2 ** bits`` numbers, the only thing the driver gets, as Arrow.

    A task sends its counters as blocks of bytes, not a row each: their number is tasks times counters, which both grow.
    """
    schema, wide = T.StructType([T.StructField("block", T.IntegerType()), T.StructField("shift", T.IntegerType()), T.StructField("n", T.BinaryType())]), 1 << min(bits, 16)

    def rows(found: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*found), (pa.int32(), pa.int32(), pa.binary()), strict=True)], names=schema.names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << bits, np.int64)
        for batch in batches:
            for text in batch.column(0):
                at = (shingles(text.as_py(), words) >> np.uint64(64 - bits)).astype(np.int64)
                if len(at) < 1 << 14:
                    np.add.at(total, at, 1)
                else:
                    total += np.bincount(at, minlength=len(total))
        # Blocks of counters, a byte of each counter at a time: a task's counters are small, and most have one byte.
        for block, part in enumerate(total.reshape(-1, wide)):
            for shift in range(0, int(part.max()).bit_length(), 8):
                yield rows([(block, shift, (part >> shift & 255).astype(np.uint8).tobytes())])

    def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[int, np.ndarray] = {}
        for batch in batches:
            for block, shift, n in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                total = totals.setdefault(block, np.zeros(wide, np.int64))
                total += np.frombuffer(n, np.uint8).astype(np.int64) << shift
        for block, total in totals.items():
            yield rows([(block, 0, np.minimum(total, (1 << 32) - 1).astype(np.uint32).tobytes())])

    got = docs.select("text").mapInArrow(run, schema).repartition("block").mapInArrow(added, schema).toArrow()
    out = np.zeros((1 << bits) // wide * wide, np.uint32).reshape(-1, wide)
    for block, n in zip(got.column("block").to_pylist(), got.column("n").to_pylist(), strict=True):
        out[block] = np.frombuffer(n, np.uint32)
    return out.reshape(-1)


def prefixes(docs: DataFrame, shared: Broadcast, words: int, num: int, den: int) -> DataFrame:
    """Per row: ``doc_id, th, s1, s2, n, l, tokens``; equal shingle sets have equal ``s1, s2``, 128 bits of a hash of the set.

    Sizes n, and d later, are bigint: the size tests multiply them by products of num and den.
    """
    schema = T.StructType([
        T.StructField("doc_id", T.LongType()), T.StructField("th", T.LongType()), T.StructField("s1", T.LongType()), T.StructField("s2", T.LongType()),
        T.StructField("n", T.LongType()), T.StructField("l", T.IntegerType()), T.StructField("tokens", T.ArrayType(T.LongType())),
    ])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        order = shared.value
        for batch in batches:
            ones, twos, sizes, ls, tokens = [], [], [], [], []
            for text in batch.column(2):
                s = shingles(text.as_py(), words)
                sizes.append(len(s))
                if not len(s):
                    ones.append(None)
                    twos.append(None)
                    ls.append(0)
                    tokens.append(())
                    continue
                h = xxhash.xxh3_128_intdigest(s.tobytes())
                ones.append((h >> 64) - (1 << 63))
                twos.append((h & ((1 << 64) - 1)) - (1 << 63))
                ranked, f = order.sorted(s)
                length, l = _plan_prefix(ranked, f, num, den)
                ls.append(l)
                tokens.append(ranked[:length].view(np.int64))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0), batch.column(1), pa.array(ones, pa.int64()), pa.array(twos, pa.int64()), pa.array(sizes, pa.int64()),
                    pa.array(ls, pa.int32()), pa.array(tokens, pa.list_(pa.int64())),
                ],
                names=schema.names,
            )

    return docs.select("doc_id", F.xxhash64("text").alias("th"), "text").mapInArrow(run, schema)


def _verified(grouped: DataFrame, words: int, num: int, den: int) -> DataFrame:
    """Compare the full sets of each pair ``a, b``: ``a, b, big, near, far, n, d, diff``.

    ``grouped`` holds texts ``b, blk, node, big, text``, sorted, the text of b first in each group of ``b, blk``: one set of b
    and one text of another member are in memory. For a pair with ``big`` b is the pivot of a long list; d is the size of the
    difference of a and b, and ``diff`` the difference itself, unless they are far.
    """
    schema = T.StructType([
        T.StructField("a", T.LongType()), T.StructField("b", T.LongType()), T.StructField("big", T.BooleanType()),
        T.StructField("near", T.BooleanType()), T.StructField("far", T.BooleanType()), T.StructField("n", T.LongType()),
        T.StructField("d", T.LongType()), T.StructField("diff", T.ArrayType(T.LongType())),
    ])
    kinds = (pa.int64(), pa.int64(), pa.bool_(), pa.bool_(), pa.bool_(), pa.int64(), pa.int64(), pa.list_(pa.int64()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pivot, y = None, None
        for batch in batches:
            rows = []
            for b, node, big, text in zip(*(batch.column(c) for c in ("b", "node", "big", "text")), strict=True):
                b, a, big = b.as_py(), node.as_py(), big.as_py()
                if a == b:
                    pivot, y = b, shingles(text.as_py(), words)
                    continue
                if pivot != b:
                    raise ValueError("a group without its pivot")
                x = shingles(text.as_py(), words)
                n, m = len(x), len(y)
                both = np.concatenate([x, y])
                both.sort(kind="stable")
                inter = int((both[1:] == both[:-1]).sum())
                near = den * inter >= num * (n + m - inter)
                d = n + m - 2 * inter
                # No member near b can reach a, for their differences to b are too unlike in size, and a shares less than
                # a third with b. What shares more is compared through the differences, however far.
                far = d * (den + num) * num > (den - num) * (n * num + 2 * n * den + m * num) and 2 * d > n + m
                diff = ()
                if big and not far and d:
                    diff = np.setxor1d(x, y, True).view(np.int64)
                rows.append((a, b, big, near, far, n, d, diff))
            cols = list(zip(*rows, strict=True)) if rows else [()] * 8
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], names=schema.names)

    return grouped.mapInArrow(run, schema)


def _alike(n: str, m: str, num: int, den: int) -> str:
    return f"{den} * least({n}, {m}) >= {num} * greatest({n}, {m})"


def _reaches(x: str, y: str, before: str, num: int, den: int) -> str:
    """Whether sets that share a token at their places ``pos``, and at most ``before`` tokens that come earlier, may be linked."""
    earlier = f"least({before}, {x}pos, {y}pos)" if before else "0"
    return f"(least({x}n - {x}pos, {y}n - {y}pos) + {earlier}) * {den + num} >= ({x}n + {y}n) * {num}"


def _need(d: str, other: str, n: str, num: int, den: int) -> str:
    """Tokens that a difference of size d shares with one of size ``other`` or more of a linked member; n is the set's size.

    x and y are linked only if |Dx ^ Dy| = |Dx| + |Dy| - 2 |Dx & Dy| is at most n (den - num) / num.
    """
    return f"greatest(0, ({d} + {other} - ({n} * {den - num}) div {num} + 1) div 2)"


def _having(tokens: DataFrame, others: DataFrame) -> DataFrame:
    """Of ``b, node, need, token`` the tokens that ``others`` of the same b have, of members that have ``need`` such tokens."""
    met = tokens.join(others.select("b", "token").distinct(), ["b", "token"], "left_semi")
    # One member's difference at a time.
    return met.withColumn("c", F.count("*").over(Window.partitionBy("b", "node"))).where("c >= need").drop("c")


def _across(found: DataFrame, num: int, den: int) -> DataFrame:
    """``b, node, near``: members near a long list's pivot and others that may be linked with each other, from their differences to it.

    Near members are linked through the pivot, and far ones with none of them. A member that is not near shares at
    least one token of its difference with a linked near one. Each side keeps the members that have enough tokens in common
    with the other side as a whole, twice.
    """
    ball = found.where("big AND NOT far")
    mid, near = ball.where("NOT near"), ball.where("near")
    bounds = near.groupBy("b").agg(F.min("d").alias("least_near")).join(mid.groupBy("b").agg(F.min("d").alias("least_mid")), "b")

    def tokens(side: DataFrame, least: str) -> DataFrame:
        need = F.expr(f"greatest(1, {_need('d', least, 'n', num, den)})")
        return side.join(bounds, "b").select("b", F.col("a").alias("node"), need.alias("need"), F.explode("diff").alias("token"))

    mids, nears, old = tokens(mid, "least_near"), tokens(near, "least_mid"), []
    for _ in range(2):
        nears = staged(_having(nears, mids))
        mids = staged(_having(mids, nears))
        old += [nears, mids]
    left = staged(nears.select("b", "node", F.lit(True).alias("near")).union(mids.select("b", "node", F.lit(False))).distinct())
    for used in old:
        unstage(used)
    return left


def _linked(x: list[np.ndarray], y: list[np.ndarray] | None, num: int, den: int) -> np.ndarray:
    """Which sets of x, or of x and y, are linked: a matrix of booleans, from the numbers of tokens that they share.

    A set that shares less than num / den of its tokens with all others together is linked with none of them and left out.
    """
    sets = x + (y or [])
    sizes = np.array([len(s) for s in sets], np.int64)
    owner, tokens = np.repeat(np.arange(len(sets)), sizes), np.concatenate(sets)
    inside = np.ones(len(tokens), bool)
    for _ in range(ROUNDS):
        _, column, count = np.unique(tokens[inside], return_inverse=True, return_counts=True)
        owners = owner[inside]
        live = np.bincount(owners, count[column] > 1, len(sets)) * den >= sizes * num
        inside[inside] = (count[column] > 1) & live[owners]
    kept = np.flatnonzero(np.bincount(owner[inside], minlength=len(sets)))
    row, column = np.searchsorted(kept, owner[inside]), np.unique(tokens[inside], return_inverse=True)[1]
    cut = np.searchsorted(kept, len(x)) if y is not None else len(kept)
    shared = np.zeros((cut, len(kept) - cut if y is not None else cut), np.float32)
    by_column = np.argsort(column, kind="stable")
    row, column = row[by_column], column[by_column]
    # Numbers up to 2 ** 24 are exact.
    for lo in range(0, int(column[-1]) + 1 if len(column) else 0, COLUMNS):
        part = slice(*np.searchsorted(column, [lo, lo + COLUMNS]))
        has = np.zeros((len(kept), COLUMNS), np.float32)
        has[row[part], column[part] - lo] = 1
        shared += has[:cut] @ (has[cut:] if y is not None else has).T
    left, right = kept[:cut], kept[cut:] if y is not None else kept
    inter = shared.astype(np.int64)
    found = den * inter >= num * (sizes[left][:, None] + sizes[right][None, :] - inter)
    out = np.zeros((len(x), len(sets) - len(x) if y is not None else len(x)), bool)
    out[np.ix_(left, right - (len(x) if y is not None else 0))] = found
    return out


def _forest(linked: np.ndarray) -> list[tuple[int, int]]:
    """Edges that join what a symmetric matrix links, one less than there are members in each component."""
    left, edges = np.ones(len(linked), bool), []
    for start in range(len(linked)):
        todo = [start] if left[start] else []
        left[start] = False
        while todo:
            at = todo.pop()
            new = np.flatnonzero(linked[at] & left).tolist()
            left[new] = False
            edges += [(at, k) for k in new]
            todo += new
    return edges


def _links_of_blocks(grouped: DataFrame, words: int, num: int, den: int) -> DataFrame:
    """Links ``a, b`` that join what is linked in each pair of blocks of sets.

    ``grouped`` holds texts ``b, i, j, blk, node, text``, sorted: of group b those of block i, and of block j unless it is i.
    The sets of two blocks are in memory.
    """
    schema = T.StructType([T.StructField("a", T.LongType()), T.StructField("b", T.LongType())])

    def links(key: tuple, blocks: tuple) -> pa.RecordBatch:
        (left, x), (right, y) = blocks
        if key[1] == key[2]:
            edges = [(left[k], left[m]) for k, m in _forest(_linked(x, None, num, den))]
        else:
            nodes, met = left + right, _linked(x, y, num, den) if x and y else np.zeros((len(x), len(y)), bool)
            square = np.zeros((len(nodes), len(nodes)), bool)
            square[: len(x), len(x):], square[len(x):, : len(x)] = met, met.T
            edges = [(nodes[k], nodes[m]) for k, m in _forest(square)]
        return pa.RecordBatch.from_arrays([pa.array([e[k] for e in edges], pa.int64()) for k in (0, 1)], names=schema.names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, blocks = None, None
        for batch in batches:
            for b, i, j, blk, node, text in zip(*(batch.column(c) for c in ("b", "i", "j", "blk", "node", "text")), strict=True):
                key, blk = (b.as_py(), i.as_py(), j.as_py()), blk.as_py()
                if key != now:
                    if now is not None:
                        yield links(now, blocks)
                    now, blocks = key, (([], []), ([], []))
                nodes, sets = blocks[int(blk != key[1])]
                nodes.append(node.as_py())
                sets.append(shingles(text.as_py(), words))
        if now is not None:
            yield links(now, blocks)

    return grouped.mapInArrow(run, schema)


def near_duplicates(docs: DataFrame, words: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """Per row ``doc_id, n_shingles, class_id, component_id, th, component_th`` under links of Jaccard similarity >= num / den.

    ``docs`` needs ``doc_id, text``; other columns are passed over. ``class_id`` is the least ``doc_id`` with the same
    shingle set, ``component_id`` the least one reachable by links. Texts without words (null, empty) have 0 shingles,
    no links, and their own id as component. Rows with a null ``doc_id`` are linked with nothing and get null ids.
    Repeated rows have equal sets, so one class; rows of one id with different texts are judged separately. ``th`` is
    ``xxhash64`` of the row's text, and the text of ``component_id`` that stands for the component has ``component_th``.
    An empty table gives an empty result.

    Equal sets are merged first. Each set's rarest tokens are its prefix, longer where candidates are estimated to
    be many, and then more tokens must match. Every token list is linked through a pivot, the member with the largest
    share of its prefix in lists (of a family of edited copies, the text they were made from): each member is compared with
    one of the list, so a group of copies costs as many comparisons as it has members. Of a long list, members that are not near the
    pivot are then compared with each other, and with those near members that their differences to the pivot allow, as products
    of blocks of sets: in a family of copies edited apart most share most tokens with most others, so lists of tokens tell
    little there. Last, all pairs of short lists that share enough prefix tokens and may link different components are
    compared. No list, component or set of links is ever in one task or on the driver.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    bits = min(max(docs.count().bit_length(), SKETCH_BITS[0]), SKETCH_BITS[1])
    shared = spark.sparkContext.broadcast(_Order(sketch(docs, words, bits)))
    rows = staged(prefixes(docs, shared, words, num, den))
    usable = rows.where("doc_id IS NOT NULL AND s1 IS NOT NULL")
    fat = usable.groupBy("s1", "s2").agg(F.min(F.struct("doc_id", "th")).alias("of"), F.first("n").alias("n"), F.first("l").alias("l"), F.first("tokens").alias("tokens"))
    # Numbers of sets; fixed once they are written.
    fat = staged(fat.withColumn("node", F.monotonically_increasing_id()))
    entries = fat.select("node", "n", "l", F.size("tokens").alias("long"), F.posexplode("tokens").alias("pos", "key"))
    # Position pos belongs to the prefixes for this many matches and more.
    entries = entries.select("key", "node", "n", "l", F.greatest(F.expr(f"pos - (n - (n * {num} + {den - 1}) div {den} + 1) + 2"), F.lit(1)).cast("int").alias("layer"), "pos", "long")
    # Written first, so that both sides of the join are plain shuffles, which adaptive execution can split.
    shared_keys = staged(entries.groupBy("key").agg(F.count("*").alias("size")).where("size > 1"))
    central = F.count("*").over(Window.partitionBy("node")) / F.col("long")
    lists = staged(entries.join(shared_keys, "key").select("key", "node", "n", "l", "layer", "pos", "size", central.alias("central")))
    # Tokens are not needed again: only narrow tables stay on disk.
    nodes, slim = staged(fat.drop("tokens")), staged(rows.drop("tokens"))
    for used in (fat, rows, shared_keys):
        unstage(used)
    rows, usable = slim, slim.where("doc_id IS NOT NULL AND s1 IS NOT NULL")
    repeated = not usable.groupBy("doc_id", "th").agg(F.count("*").alias("k")).where("k > 1").isEmpty()
    texts = docs.where("doc_id IS NOT NULL").withColumn("th", F.xxhash64("text"))
    kept: list[DataFrame] = []

    def with_texts(dealt: DataFrame) -> DataFrame:
        wanted = staged(dealt.join(nodes.select("node", "of.*"), "node"))
        kept.append(wanted)
        few = wanted.count() <= BROADCAST_IDS
        # Few ids are broadcast, so that texts are filtered where they are read; more are joined by a shuffle.
        got = texts.join(F.broadcast(wanted) if few else wanted, ["doc_id", "th"]).select(*dealt.columns, "text")
        return got.dropDuplicates(dealt.columns) if repeated else got

    def verify(pairs: DataFrame) -> DataFrame:
        pairs = staged(pairs.select("a", "b", "big"))
        # A pivot's text goes once to each group of about BLOCK members, so a hot pivot is many groups.
        blocks = pairs.groupBy("b").agg(F.ceil(F.count("*") / BLOCK).alias("k"))
        dealt = pairs.join(blocks, "b").select("b", F.pmod(F.xxhash64("a"), F.col("k")).cast("int").alias("blk"), F.col("a").alias("node"), "big")
        dealt = dealt.union(dealt.select("b", "blk", F.col("b"), F.lit(False)).distinct())
        got = with_texts(dealt).repartition("b", "blk").sortWithinPartitions("b", "blk", F.col("node") != F.col("b"))
        done = staged(_verified(got, words, num, den))
        kept.append(done)
        unstage(pairs)
        unstage(kept[-2])
        return done

    def all_pairs(groups: DataFrame, across: bool) -> DataFrame:
        """Links within groups ``b, node, near``, or across the two sides of each: every two blocks meet in one place."""
        kept.append(staged(groups))
        sizes = kept[-1].groupBy("b").agg(*[F.ceil(F.count_if(side) / SETS).cast("int").alias(k) for k, side in (("k", ~F.col("near")), ("k_near", F.col("near")))])
        dealt = kept[-1].join(sizes, "b").withColumn("blk", F.pmod(F.xxhash64("node"), F.when(F.col("near"), F.col("k_near")).otherwise(F.col("k"))).cast("int"))
        if across:
            # Near blocks have negative numbers.
            meets = F.when(F.col("near"), F.sequence(F.lit(0), F.col("k") - 1)).otherwise(F.transform(F.sequence(F.lit(1), F.col("k_near")), lambda x: -x))
            dealt = dealt.where("k > 0 AND k_near > 0").withColumn("blk", F.when(F.col("near"), -1 - F.col("blk")).otherwise(F.col("blk")))
        else:
            meets = F.sequence(F.lit(0), F.col("k") - 1)
        dealt = dealt.withColumn("other", F.explode(meets))
        dealt = dealt.select("b", F.least("blk", "other").alias("i"), F.greatest("blk", "other").alias("j"), "blk", "node")
        got = with_texts(dealt).repartition("b", "i", "j").sortWithinPartitions("b", "i", "j", "blk")
        kept.append(staged(_links_of_blocks(got, words, num, den)))
        return kept[-1]

    # Linked sets share a token of layer 1; if its list is long, they are found there, else among short lists, by as many
    # shared tokens as the smaller l asks for.
    wide = F.col("size") > DIRECT
    direct = lists.where(~wide & (F.col("layer") <= F.col("l")))
    start = direct.union(lists.where(wide & (F.col("layer") == 1)))
    first = F.min(F.struct((-F.col("central")).alias("c"), F.xxhash64("node").alias("h"), "node", "n", "l", "layer", "pos")).alias("p")
    pivots = staged(start.groupBy("key").agg(first))
    kept.append(pivots)
    star = start.join(pivots.select("key", F.col("p.node").alias("pivot"), F.col("p.n").alias("pn"), F.col("p.l").alias("pl"), F.col("p.layer").alias("player"), F.col("p.pos").alias("ppos")), "key").withColumn("big", wide)
    reach = f"abs(n - pn) * {(den + num) * num} <= {den - num} * (n * {num + 2 * den} + pn * {num}) OR 2 * abs(n - pn) <= n + pn"
    star = star.withColumn("meets", F.when(F.col("big"), F.expr(reach)).otherwise(F.expr(_alike("n", "pn", num, den) + " AND greatest(layer, player) <= least(l, pl) AND " + _reaches("", "p", "", num, den))))
    found = verify(star.where("meets AND node <> pivot").groupBy(F.col("node").alias("a"), F.col("pivot").alias("b")).agg(F.max("big").alias("big")))
    links = found.where("near").select("a", "b")
    others = star.where("big AND node <> pivot").select(F.col("pivot").alias("b"), "node").distinct().join(found.where("near").select("b", F.col("a").alias("node")), ["b", "node"], "left_anti")
    if not others.isEmpty():
        # Near members are linked through the pivot, and far ones with none of them.
        links = links.union(all_pairs(others.withColumn("near", F.lit(False)), False))
        if not found.where("big AND NOT far AND NOT near").isEmpty():
            kept.append(_across(found, num, den))
            links = links.union(all_pairs(kept[-1], True))

    labels = connected_components(links)
    # Tokens that a member may also share in long lists, which are not paired here.
    long_lists = lists.where(wide & (F.col("layer") <= F.col("l"))).groupBy("node").agg(F.count("*").alias("more"))
    direct = direct.join(labels, "node", "left").join(long_lists, "node", "left")
    direct = staged(direct.withColumns({"label": F.coalesce("label", "node"), "more": F.coalesce("more", F.lit(0))}))
    kept.append(direct)
    sides = [direct.select("key", *[F.col(c).alias(f"{side}_{c}") for c in ("node", "n", "l", "layer", "pos", "label", "more")]) for side in "lr"]
    met = sides[0].join(sides[1], "key").where(f"l_node < r_node AND l_label <> r_label AND {_alike('l_n', 'r_n', num, den)} AND greatest(l_layer, r_layer) <= least(l_l, r_l)")
    pair = [F.least("l_node", "r_node").alias("a"), F.greatest("l_node", "r_node").alias("b")]
    # The first token that a linked pair shares here has all the others behind it, but for those in long lists.
    first = F.max(F.expr(_reaches("l_", "r_", "least(l_more, r_more)", num, den))).alias("reaches")
    met = met.groupBy(*pair).agg(F.countDistinct("key").alias("shared"), F.min(F.least("l_l", "r_l")).alias("asked"), F.min(F.least("l_more", "r_more")).alias("elsewhere"), first)
    enough = met.where("reaches AND shared + elsewhere >= asked").select("a", "b")
    late = verify(enough.withColumn("big", F.lit(False))).where("near").select("a", "b")
    if not late.isEmpty():
        labels = connected_components(links.union(late))
    classes = nodes.select("node", "s1", "s2", F.col("of").alias("rep")).join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    least = classes.groupBy("label").agg(F.min("rep").alias("least"))
    classes = staged(classes.join(least, "label").select("s1", "s2", F.col("rep.doc_id").alias("class_id"), F.col("least.doc_id").alias("component_id"), F.col("least.th").alias("component_th")))
    for used in (lists, nodes, *kept):
        unstage(used)
    out = rows.select("doc_id", "th", "s1", "s2", F.col("n").alias("n_shingles")).join(classes, ["s1", "s2"], "left")
    known = F.col("doc_id").isNotNull()
    return out.select(
        "doc_id", "n_shingles", F.when(known, F.coalesce("class_id", "doc_id")).alias("class_id"), F.when(known, F.coalesce("component_id", "doc_id")).alias("component_id"),
        "th", F.when(known, F.coalesce("component_th", "th")).alias("component_th"),
    )
