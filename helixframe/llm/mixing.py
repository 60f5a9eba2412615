"""Mixing sources to target weights in fixed-length blocks, with built-in functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import packed, quoted, running_sum, staged, unpacked, unstage, words

#: Three primes below 2 ** 31 and three below 2 ** 22. At least one of three does not divide a count.
PRIMES = (2147483647, 2147483629, 2147483587)
SHORT_PRIMES = (4194301, 4194287, 4194277)
ROUNDS = 3
#: Places among all slots are looked up by cells of this many.
CELL = 256
#: Documents of one bucket are laid out in one task.
DOCS_PER_BUCKET = 2_000


def with_permutation(df: DataFrame, n: str, prefix: str, *seed: Column) -> DataFrame:
    """Add the constants of a pseudorandom permutation of ``0 .. n - 1``; for ``n`` up to 2 ** 41."""
    def prime(ps):
        return F.when(F.col(n) % ps[0] != 0, F.lit(ps[0])).when(F.col(n) % ps[1] != 0, F.lit(ps[1])).otherwise(F.lit(ps[2])).cast("long")

    bits = F.char_length(F.bin(F.col(n))) - 1
    return df.withColumns(
        {
            f"{prefix}a": F.when(F.col(n) < (1 << 31), prime(PRIMES)).otherwise(prime(SHORT_PRIMES)),
            f"{prefix}top": F.call_function("shiftleft", F.lit(1).cast("long"), bits),
            f"{prefix}shift": F.greatest(F.floor(bits / 2).cast("int"), F.lit(1)),
            **{f"{prefix}b{k}": F.pmod(F.xxhash64(*seed, F.lit(k)), F.col(n)) for k in range(ROUNDS)},
        }
    )


def permute(df: DataFrame, index: str, n: str, prefix: str, out: str) -> DataFrame:
    """Add column ``out``: where the permutation of ``with_permutation`` takes ``index``.

    Each round maps x to a * x + b mod n, and between rounds the part below the largest power of two is xor-ed with
    its own high bits; both steps are one-to-one.
    """
    df = df.withColumn(out, F.col(index).cast("long"))
    for k in range(ROUNDS):
        df = df.withColumn(out, F.pmod(F.col(f"{prefix}a") * F.col(out) + F.col(f"{prefix}b{k}"), F.col(n)))
        if k < ROUNDS - 1:
            folded = F.col(out).bitwiseXOR(F.call_function("shiftright", F.col(out), F.col(f"{prefix}shift")))
            df = df.withColumn(out, F.when(F.col(out) < F.col(f"{prefix}top"), folded).otherwise(F.col(out)))
    return df


def size_of(text: Column) -> Column:
    """Number of ``[^\\x20\\x09-\\x0D]+`` words; null gives 0."""
    return F.coalesce(F.regexp_count(text, F.lit("[^ \\t\\n\\x0b\\f\\r]+")), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = (3, 1, 2), share: float = 1.5, cap: int = 2) -> DataFrame:
    """One row ``source, weight, source_size, target`` for each source of ``sizes`` (``source, size``).

    Sources in code-point order, null last, get the weights in turn. They share ``share`` times all sizes by weight;
    a target stops at ``cap`` times its source's size and the excess is shared again by weight. That fixed point is
    ``min(level * weight, cap * size)`` with the level at which all targets add up: the largest, over the number of
    capped sources in order of cap per weight, of (total - their caps) / (weights of the rest). The windows run over
    one row per source.
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    order = Window.orderBy(F.col("source").isNull(), F.col("source"))
    at = F.pmod(F.row_number().over(order) - 1, F.lit(len(weights)))
    per = per.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), at + 1).cast("long"))
    every = Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    before = Window.orderBy(F.col("source_size") / F.col("weight"), F.col("source").isNull(), "source").rowsBetween(Window.unboundedPreceding, -1)
    per = per.withColumns(
        {
            "_total": F.lit(share) * F.sum("source_size").over(every),
            "_capped": F.coalesce(F.sum(cap * F.col("source_size")).over(before), F.lit(0)),
            "_rest": F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0)),
        }
    )
    level = F.max((F.col("_total") - F.col("_capped")) / F.col("_rest")).over(every)
    per = per.withColumn("_level", level)
    return per.select(
        "source", "weight", "source_size",
        F.least(F.col("_level") * F.col("weight"), (cap * F.col("source_size")).cast("double")).alias("target"),
    )


def lay_out(rows: DataFrame, n_rows: int, tie: list[str]) -> DataFrame:
    """``row, source, size, start, stop``: each row's place in the word stream of its source.

    ``rows`` has ``row, source, size`` and the columns of ``tie``. A source's stream runs bucket by bucket; a bucket's
    place comes from the sums of the buckets before it, so no task ever sees a whole source. ``tie`` gives the order in a
    bucket, so reruns agree.
    """
    buckets = max(1, -(-n_rows // DOCS_PER_BUCKET))
    tagged = rows.withColumns({"h": F.xxhash64(*tie), "bucket": F.pmod(F.xxhash64(*tie), F.lit(buckets)).cast("int")})
    sums = tagged.groupBy("source", "bucket").agg(F.sum("size").alias("n"))
    offsets = running_sum(sums, ["source"], "bucket", "n", "offset").select(F.col("source").alias("s"), F.col("bucket").alias("b"), "offset")
    inside = Window.partitionBy("source", "bucket").orderBy("h", *tie, "size").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = tagged.withColumn("end", F.sum("size").over(inside)).join(offsets, F.col("source").eqNullSafe(F.col("s")) & (F.col("bucket") == F.col("b")))
    return placed.select("row", "source", "size", (F.col("offset") + F.col("end") - F.col("size")).alias("start"), (F.col("offset") + F.col("end")).alias("stop"))


def with_blocks(targets: DataFrame, block_words: int) -> DataFrame:
    """``source, blocks, wanted, first``: a source's number of blocks, the slots it shall fill (``round(target * blocks /
    source_size)``), and the slots of the sources before it. One row per source is in one task."""
    t = targets.where(F.col("source_size") > 0).withColumn("blocks", F.ceil(F.col("source_size") / block_words).cast("long"))
    t = t.withColumn("wanted", F.round(F.col("target") * F.col("blocks") / F.col("source_size")).cast("long")).where("wanted > 0")
    order = Window.orderBy(F.col("source").isNull(), "source").rowsBetween(Window.unboundedPreceding, -1)
    return t.select("source", "blocks", "wanted", F.coalesce(F.sum("wanted").over(order), F.lit(0)).cast("long").alias("first"))


def drawn_counts(sources: DataFrame, n_slots: int, shard_slots: int, seed: int) -> DataFrame:
    """``shard, source, first, wanted, drawn``: a multinomial draw of source counts for each output shard.

    Each slot draws a place among all wanted slots by a hash of its number, and with it the source that the place
    belongs to. Places are looked up by cells of ``CELL``, which hold ``CELL`` sources at most, so the lookup is a plain join
    whatever the number of sources.
    """
    cells = sources.select("source", "first", "wanted", F.explode(F.sequence(F.floor(F.col("first") / CELL), F.floor((F.col("first") + F.col("wanted") - 1) / CELL))).alias("cell"))
    slots = sources.sparkSession.range(n_slots).select(
        F.floor(F.col("id") / shard_slots).alias("shard"), F.pmod(F.xxhash64(F.lit(seed), F.col("id")), F.lit(max(n_slots, 1))).alias("place")
    )
    slots = slots.groupBy("shard", F.floor(F.col("place") / CELL).alias("cell"), "place").agg(F.count("*").alias("times"))
    met = slots.join(cells, "cell").where("place >= first AND place < first + wanted")
    return met.groupBy("shard", "source", "first", "wanted").agg(F.sum("times").alias("drawn"))


def shard_counts(targets: DataFrame, block_words: int, shard_slots: int = 4096, seed: int = 17) -> DataFrame:
    """The number of blocks of each source in each output shard: ``shard, source, at, n, blocks``.

    Counts are a multinomial draw for each shard, corrected to the targets: in order of shards a source keeps its draws
    until it has what it wants, and the draws beyond go to the sources that were drawn too seldom, in order. About the
    square root of all slots change, all in the last shards. ``n`` of a source's blocks are in the shard, from its
    ``at``-th draw on; a source short of draws has two rows in some shards.
    """
    sources = staged(with_blocks(targets, block_words))
    n_slots = sources.agg(F.sum("wanted")).first()[0] or 0
    drawn = staged(drawn_counts(sources, n_slots, shard_slots, seed))
    ranked = running_sum(drawn, ["source"], "shard", "drawn", "at")
    ranked = staged(ranked.withColumn("n", F.least(F.greatest(F.col("wanted") - F.col("at"), F.lit(0)), F.col("drawn"))))
    # The freed slots of all shards in one line, and on it the sources that want more.
    freed = ranked.groupBy("shard").agg(F.sum(F.col("drawn") - F.col("n")).alias("free")).where("free > 0")
    freed = running_sum(freed.withColumn("all", F.lit(0)), ["all"], "shard", "free", "from")
    got = ranked.groupBy(F.col("source").alias("s")).agg(F.sum("drawn").alias("got"))
    short = sources.join(got, F.col("source").eqNullSafe(F.col("s")), "left").select("source", "wanted", "first", F.least(F.coalesce("got", F.lit(0)), "wanted").alias("got"))
    line = Window.orderBy("first").rowsBetween(Window.unboundedPreceding, -1)
    short = short.withColumn("lack", F.col("wanted") - F.col("got")).where("lack > 0").withColumn("start", F.coalesce(F.sum("lack").over(line), F.lit(0)))
    # Both sides cover the same line once, so each pair of neighbours overlaps: rows add up, they do not multiply.
    cell = F.explode(F.sequence(F.floor(F.col("a") / CELL), F.floor((F.col("b") - 1) / CELL))).alias("cell")
    left = freed.select("shard", F.col("from").alias("a"), (F.col("from") + F.col("free")).alias("b")).select("shard", F.col("a").alias("fa"), F.col("b").alias("fb"), cell)
    right = short.select("source", "got", F.col("start").alias("a"), (F.col("start") + F.col("lack")).alias("b")).select("source", "got", F.col("a").alias("sa"), F.col("b").alias("sb"), cell)
    low = F.greatest("fa", "sa", F.col("cell") * CELL)
    refill = left.join(right, "cell").withColumn("low", low).withColumn("n", F.least("fb", "sb", (F.col("cell") + 1) * CELL) - F.col("low")).where("n > 0")
    both = ranked.where("n > 0").select("shard", "source", "at", "n").union(refill.select("shard", "source", F.col("got") + F.col("low") - F.col("sa"), "n"))
    per = sources.select(F.col("source").alias("s"), "blocks")
    out = staged(both.join(per, F.col("source").eqNullSafe(F.col("s"))).select("shard", "source", F.col("at").cast("long").alias("at"), F.col("n").cast("long").alias("n"), "blocks"))
    for used in (sources, drawn, ranked):
        unstage(used)
    return out


def draw_slots(counts: DataFrame, seed: int = 17) -> DataFrame:
    """One row ``source, shard, block`` for each block that the mix takes, from the counts of ``shard_counts``.

    A source's k-th draw takes block ``permutation(k mod blocks)``: no block comes again before all have come. Each row of
    counts is at most a shard long, and they are dealt to a fixed number of tasks for each of them.
    """
    tasks = max(1, counts.sparkSession.sparkContext.defaultParallelism)
    runs = with_permutation(counts, "blocks", "p", F.lit(seed), F.col("source")).repartition(tasks, F.xxhash64("shard", "source", "at"))
    slots = runs.withColumn("k", F.explode(F.sequence(F.col("at"), F.col("at") + F.col("n") - 1)))
    slots = slots.withColumn("in", F.pmod("k", "blocks"))
    return permute(slots, "in", "blocks", "p", "block").select("source", "shard", "block")


def block_pieces(placed: DataFrame, block_words: int) -> DataFrame:
    """One row for each document and block that overlap: ``source, start, block, from_word, n`` (words of the document)."""
    at = placed.where("size > 0").select(
        "source", "start", "stop",
        F.explode(F.sequence(F.floor(F.col("start") / block_words), F.floor((F.col("stop") - 1) / block_words))).alias("block"),
    )
    low = F.greatest(F.col("start"), F.col("block") * block_words)
    return at.select(
        "source", "start", "block", (low - F.col("start")).alias("from_word"),
        (F.least(F.col("stop"), (F.col("block") + 1) * block_words) - low).alias("n"),
    )


def take_pieces(pieces: DataFrame, slots: DataFrame) -> DataFrame:
    """Join blocks by index: add ``times``, how often the mix takes the block; blocks it never takes are left out.

    Slots are exploded from one row per shard and source, so Spark expects few of them; the hint keeps it from broadcasting all.
    """
    times = slots.groupBy(F.col("source").alias("s"), F.col("block").alias("b")).agg(F.count("*").alias("times"))
    return pieces.join(times.hint("merge"), F.col("source").eqNullSafe(F.col("s")) & (F.col("block") == F.col("b"))).drop("s", "b")


def mix_amounts(sizes: DataFrame, tie: list[str], block_words: int = 32, shard_slots: int = 4096, **kw) -> DataFrame:
    """Per row of ``sizes`` (``source, size`` and the columns of ``tie``): add ``source_size, target, taken``.

    ``taken`` counts the words that the mix takes of the row, repeats included; it never passes twice the size.
    Null sources are one source; rows of size 0 take nothing; equal rows are each laid out once; an empty table
    gives an empty result. Other columns stay, those named like the added ones are replaced.
    """
    # Read four times below; 24 bytes or so a row, so the texts are read once.
    ties = {f"t{k}": F.col(quoted(c)) for k, c in enumerate(tie)}
    sizes = staged(packed(sizes, source=F.col("source"), size=F.col("size"), **ties))
    n_rows = sizes.count()
    targets = staged(source_targets(sizes, **kw))
    placed = staged(lay_out(sizes, n_rows, list(ties)))
    unstage(sizes)
    counts = shard_counts(targets, block_words, shard_slots)
    taken = (
        take_pieces(block_pieces(placed, block_words), draw_slots(counts))
        .groupBy(F.col("source").alias("s"), F.col("start").alias("t")).agg(F.sum(F.col("n") * F.col("times")).alias("taken"))
    )
    out = placed.join(
        taken.hint("merge"), F.col("source").eqNullSafe(F.col("s")) & (F.col("start") == F.col("t")) & (F.col("size") > 0), "left"
    ).drop("s", "t")
    per = targets.select(F.col("source").alias("s"), "source_size", "target")
    # One row per source on the right; the left is not shuffled for it when that is small.
    out = out.join(per, F.col("source").eqNullSafe(F.col("s")))
    return unpacked(out, source_size=F.col("source_size"), target=F.col("target"), taken=F.coalesce("taken", F.lit(0)).cast("long"))


def mixed_blocks(docs: DataFrame, block_words: int = 1024, shard_slots: int = 4096, **kw) -> DataFrame:
    """The mix itself: one row ``shard, slot, source, block, text`` for each slot of each output shard.

    ``text`` is the block's words joined by spaces (the last block of a source may be shorter); slots of a shard are in
    pseudorandom order. ``docs`` needs ``doc_id, text, source``; a null text has no words, rows without words are in no
    block, an empty table gives no shards. Equal rows each have their place.
    """
    # A block holds its words, so this is the one form of the mix that shuffles texts.
    rows = docs.select(F.struct("doc_id", "text").alias("row"), "source", size_of(F.col("text")).alias("size"), F.xxhash64("doc_id", "text").alias("t0"))
    targets = staged(source_targets(rows, **kw))
    placed = lay_out(rows, docs.count(), ["t0"]).where("size > 0").withColumn("words", words(F.col("row.text")))
    at = placed.select("source", "start", "stop", "words", F.explode(F.sequence(F.floor(F.col("start") / block_words), F.floor((F.col("stop") - 1) / block_words))).alias("block"))
    low = F.greatest(F.col("start"), F.col("block") * block_words)
    part = F.slice("words", (low - F.col("start") + 1).cast("int"), (F.least(F.col("stop"), (F.col("block") + 1) * block_words) - low).cast("int"))
    pieces = at.select(F.col("source").alias("s"), F.col("block").alias("b"), F.struct("start", part.alias("part")).alias("piece"))
    blocks = pieces.groupBy("s", "b").agg(F.sort_array(F.collect_list("piece")).alias("pieces"))
    blocks = blocks.select("s", "b", F.array_join(F.flatten(F.transform("pieces", lambda p: p["part"])), " ").alias("text"))
    slots = draw_slots(shard_counts(targets, block_words, shard_slots))
    met = slots.join(blocks, F.col("source").eqNullSafe(F.col("s")) & (F.col("block") == F.col("b")))
    order = Window.partitionBy("shard").orderBy(F.xxhash64("shard", "source", "block"), "source", "block")
    return met.select("shard", (F.row_number().over(order) - 1).alias("slot"), "source", "block", "text")


def mix_documents(docs: DataFrame, block_words: int = 32, shard_slots: int = 4096, **kw) -> DataFrame:
    """The documents of the mix: for each document and pass over its source, one row with the words taken then.

    ``docs`` needs ``doc_id, text, source``; other columns stay. A document whose blocks are taken twice gives two
    rows. Where all words are taken the text is unchanged; else it is the taken words joined by spaces.
    ``n_chars``, if there, is set to the new length. Documents without words are in no block and leave the mix.
    """
    kept = docs.columns
    whole = [x for c in ("doc_id", "source", "text") for x in (F.col(c).isNull(), F.col(c))]
    keyed = packed(docs, k1=F.xxhash64(*whole), k2=F.xxhash64(F.lit(5), *whole, F.lit(6)), source=F.col("source"), size=size_of(F.col("text")))
    keys = staged(keyed.select(F.struct("k1", "k2").alias("row"), "k1", "k2", "source", "size"))
    n_rows = keys.count()
    targets = staged(source_targets(keys, **kw))
    # Equal rows (one id, one text, one source) are laid out one after the other.
    placed = staged(lay_out(keys, n_rows, ["k1", "k2"]))
    unstage(keys)
    pieces = take_pieces(block_pieces(placed, block_words), draw_slots(shard_counts(targets, block_words, shard_slots)))
    per_doc = pieces.groupBy(F.col("source").alias("s"), F.col("start").alias("t")).agg(
        F.sort_array(F.collect_list(F.struct("from_word", "n", "times"))).alias("pieces"), F.max("times").alias("most")
    )
    plan = placed.where("size > 0").join(per_doc.hint("merge"), F.col("source").eqNullSafe(F.col("s")) & (F.col("start") == F.col("t")))
    passes = F.explode(F.sequence(F.lit(1).cast("long"), F.col("most"))).alias("pass")
    plan = plan.select("row.k1", "row.k2", "pieces", passes)
    plan = plan.select("k1", "k2", F.filter("pieces", lambda p: p["times"] >= F.col("pass")).alias("pieces"))
    # Equal rows share one text, so their passes can all hang on one of them; other columns are that row's. The join
    # keeps the partitioning of dropDuplicates, so texts are shuffled once.
    both = keyed.select("row", "k1", "k2", "size").dropDuplicates(["k1", "k2"]).join(plan.hint("merge"), ["k1", "k2"])
    got = F.aggregate("pieces", F.lit(0).cast("long"), lambda s, p: s + p["n"])
    both = both.withColumn("words", words(F.col("row.text")))
    part = F.array_join(F.flatten(F.transform("pieces", lambda p: F.slice("words", (p["from_word"] + 1).cast("int"), p["n"].cast("int")))), " ")
    both = both.withColumn("text", F.when((got == F.col("size")) | (F.size("words") == 0), F.col("row.text")).otherwise(part))
    fresh = {"text": F.col("text")}
    if "n_chars" in kept:
        fresh["n_chars"] = F.char_length("text").cast(docs.schema["n_chars"].dataType)
    return unpacked(both, **fresh).select(*map(quoted, kept))
