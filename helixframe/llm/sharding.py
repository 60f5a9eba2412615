"""Consistent-hash sharding with virtual nodes and bounded loads."""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from .common import packed, quoted, running_sum, unpacked

#: The ring has 2 ** RING_BITS places.
RING_BITS = 16
#: Rows of one arc are ranked in 2 ** RUN_BITS runs.
RUN_BITS = 4


def ring(n_shards: int, vnodes: int) -> list[tuple[int, int]]:
    """Virtual nodes as sorted ``(place, shard)``; a shard's places do not depend on the number of shards.

    Where two virtual nodes hash to one place the later takes the next free place.
    """
    taken: dict[int, int] = {}
    for shard in range(n_shards):
        for v in range(vnodes):
            at = int.from_bytes(hashlib.sha256(f"{shard}/{v}".encode()).digest()[:8], "big") >> (64 - RING_BITS)
            while at in taken:
                at = (at + 1) % (1 << RING_BITS)
            taken[at] = shard
    return sorted(taken.items())


def spill_clockwise(loads: dict[int, int], nodes: list[tuple[int, int]], capacity: list[int]) -> list[tuple[int, int, int, int, int]]:
    """Deal each arc's keys to shards: ``(arc, first rank, end rank, shard, first slot)``.

    Each shard takes its own arcs' keys clockwise until it is full; what is left over goes on clockwise to the next
    virtual nodes whose shards have room. Works on one count per virtual node, never on keys.
    """
    used = [0] * len(capacity)
    out, over = [], []
    for arc, (_, shard) in enumerate(nodes):
        n = loads.get(arc, 0)
        take = min(n, capacity[shard] - used[shard])
        if take:
            out.append((arc, 0, take, shard, used[shard]))
            used[shard] += take
        if take < n:
            over.append((arc, take, n))
    for arc, done, n in over:
        at = arc
        while done < n:
            at = (at + 1) % len(nodes)
            shard = nodes[at][1]
            take = min(n - done, capacity[shard] - used[shard])
            if take:
                out.append((arc, done, done + take, shard, used[shard]))
                used[shard] += take
                done += take
    return out


def shard_rows(rows: DataFrame, key: str, n_shards: int, tie: list[str], vnodes: int = 64) -> DataFrame:
    """Add ``shard int, slot long, home_shard int`` to every row: counts of shards differ by one at most.

    ``key`` places a row on the ring; ``tie`` lists columns that order rows of one key, so that reruns agree. The
    load bound is the exact quota (rows / shards, rounded up for the first shards), so the shards fill completely;
    ``home_shard`` tells where the ring alone would put the row. Only one count for each of ``n_shards * vnodes``
    arcs reaches the driver, a fixed number. A null key is placed by the columns of ``tie``; repeated rows get
    different slots; an empty table gives an empty result. Columns named like the added ones are replaced.
    """
    spark = rows.sparkSession
    nodes = ring(n_shards, vnodes)
    bounds = [p for p, _ in nodes]
    # Arc a holds the places after virtual node a - 1, up to and with virtual node a; the last arc closes the ring.
    spans = [(a, bounds[a - 1] + 1 if a else 0, bounds[a]) for a in range(len(nodes))]
    spans += [(0, bounds[-1] + 1, (1 << RING_BITS) - 1)] * (bounds[-1] + 1 < 1 << RING_BITS)
    places = (
        spark.createDataFrame(spans, "arc int, lo int, hi int")
        .select("arc", F.explode(F.sequence("lo", "hi")).alias("place"))
    )
    ties = [f"t{k}" for k in range(len(tie))]
    packed_rows = packed(rows, key=F.col(quoted(key)), **{t: F.col(quoted(c)) for t, c in zip(ties, tie)})
    keyed = packed_rows.withColumn("h", F.when(F.col("key").isNull(), F.xxhash64(*ties)).otherwise(F.xxhash64("key")))
    keyed = keyed.withColumn("place", F.shiftrightunsigned("h", 64 - RING_BITS).cast("int"))
    # 65,536 rows of two ints, whatever the input.
    on_arc = keyed.join(F.broadcast(places), "place").drop("place")
    loads = {r["arc"]: r["n"] for r in on_arc.groupBy("arc").agg(F.count("*").alias("n")).collect()}
    total = sum(loads.values())
    capacity = [total // n_shards + (s < total % n_shards) for s in range(n_shards)]
    segments = spark.createDataFrame(
        [(*x, nodes[x[0]][1]) for x in spill_clockwise(loads, nodes, capacity)],
        T.StructType([
            T.StructField("on", T.IntegerType()), T.StructField("lo", T.LongType()), T.StructField("hi", T.LongType()),
            T.StructField("shard", T.IntegerType()), T.StructField("slot0", T.LongType()), T.StructField("home_shard", T.IntegerType()),
        ]),
    )
    # Rows of an arc are ranked in runs, by bits of a hash of key and tie, so an arc or a key with many rows is many tasks.
    on_arc = on_arc.withColumn("run", F.shiftrightunsigned(F.xxhash64("h", *ties), 64 - RUN_BITS).cast("int"))
    runs = running_sum(on_arc.groupBy("arc", "run").agg(F.count("*").alias("n")), ["arc"], "run", "n", "before")
    order = Window.partitionBy("arc", "run").orderBy("h", "key", *ties)
    ranked = on_arc.withColumn("inner", F.row_number().over(order).cast("long") - 1)
    ranked = ranked.join(runs.select("arc", "run", "before"), ["arc", "run"]).withColumn("rank", F.col("before") + F.col("inner"))
    # At most one segment for each arc and one more for each time that a shard fills up: bounded by arcs + shards.
    dealt = ranked.join(F.broadcast(segments), (F.col("arc") == F.col("on")) & (F.col("rank") >= F.col("lo")) & (F.col("rank") < F.col("hi")))
    return unpacked(dealt, shard=F.col("shard"), slot=F.col("slot0") + F.col("rank") - F.col("lo"), home_shard=F.col("home_shard"))
