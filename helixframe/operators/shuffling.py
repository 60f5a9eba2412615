"""Epoch shuffles without a sort: a keyed permutation of row numbers for each epoch."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.staging import staged

#: Rounds of the permutation; each swaps or does not swap every number with a partner.
ROUNDS = 48


def numbered(df: DataFrame, key: str, out: str = "at", buckets: int = 256) -> tuple[DataFrame, int]:
    """Add gapless row numbers from 0 and say how many: rows are dealt to ``buckets`` by hash of a key and numbered in each.

    Numbers depend on keys alone if these differ. As many counts as buckets reach the driver; equal keys share a bucket.
    """
    dealt = staged(df.withColumn("_bucket", F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")))
    counts = {r["_bucket"]: r["n"] for r in dealt.groupBy("_bucket").agg(F.count("*").alias("n")).collect()}
    starts, total = [], 0
    for k in range(buckets):
        starts.append(total)
        total += counts.get(k, 0)
    inside = F.row_number().over(Window.partitionBy("_bucket").orderBy(F.xxhash64(F.lit(1), key), key)) - 1
    start = F.element_at(F.array(*[F.lit(s).cast("long") for s in starts]), F.col("_bucket") + 1)
    return dealt.withColumn(out, (start + inside).cast("long")).drop("_bucket"), total


def permuted(at: Column, n: int, *key: object) -> Column:
    """A number below ``n`` for each number below ``n``, one to one, by a key: a swap-or-not shuffle.

    In each round a number's partner is a constant less it (modulo n), and a hash of the greater of both says whether they
    swap; both partners see the same hash, so a round is one to one for every n, and nothing is sorted or looked up.
    """
    if n <= 1:
        return at
    name = ":".join(map(str, key))
    rounds = F.array(*[F.struct(F.lit(int.from_bytes(hashlib.sha256(f"{name}:{r}".encode()).digest()[:7], "big") % n).alias("k"), F.lit(f"{name}:{r}").alias("name")) for r in range(ROUNDS)])

    def swap(x: Column, r: Column) -> Column:
        partner = F.pmod(r["k"] - x, F.lit(n))
        return F.when(F.pmod(F.xxhash64(r["name"], F.greatest(x, partner)), F.lit(2)) == 1, partner).otherwise(x)

    return F.aggregate(rounds, at.cast("long"), swap)


def epoch_batches(df: DataFrame, n: int, epochs: int, size: int, seed: int = 0, at: str = "at") -> DataFrame:
    """``epoch, batch, slot`` beside each row, for every epoch: batches of ``size`` rows of a new order, the last one shorter.

    Each row is in one batch an epoch, reruns agree, and it is a projection: rows stay where they are until a reader groups them.
    """
    each = F.explode(F.array(*[F.struct(F.lit(e).alias("epoch"), permuted(F.col(at), n, seed, e).alias("place")) for e in range(epochs)]))
    rows = df.withColumn("_e", each)
    return rows.select(*df.columns, F.col("_e.epoch").alias("epoch"), F.floor(F.col("_e.place") / size).cast("int").alias("batch"), (F.col("_e.place") % size).cast("int").alias("slot"))
