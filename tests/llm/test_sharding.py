from collections import Counter

import pytest

from helixframe.llm import sharding


def test_rows_are_even_and_slots_gapless(spark):
    rows = [(k if k % 3 else 7, k % 11, "x") for k in range(1003)] + [(None, k, "y") for k in range(50)]
    df = spark.createDataFrame(rows, "doc_id long, crc long, shard string")
    out = sharding.shard_rows(df, "doc_id", 10, ["crc"])
    got = out.collect()
    assert len(got) == len(rows)
    counts = Counter(r["shard"] for r in got)
    assert max(counts.values()) - min(counts.values()) <= 1 and len(counts) == 10
    for s, n in counts.items():
        assert sorted(r["slot"] for r in got if r["shard"] == s) == list(range(n))


def test_few_move_when_a_shard_is_added(spark):
    df = spark.range(4000).selectExpr("id AS doc_id", "id AS t")
    place = lambda n: {r["doc_id"]: r["home_shard"] for r in sharding.shard_rows(df, "doc_id", n, ["t"]).collect()}
    a, b = place(10), place(11)
    moved = [k for k in a if a[k] != b[k]]
    assert all(b[k] == 10 for k in moved) and 0 < len(moved) < 1000


def test_spill_fills_shards_clockwise():
    nodes = [(10, 0), (20, 1), (30, 0), (40, 2)]
    dealt = sharding.spill_clockwise({0: 7, 1: 1, 2: 3, 3: 0}, nodes, [4, 4, 3])
    per = Counter()
    for arc, lo, hi, shard, slot in dealt:
        assert slot == per[shard]
        per[shard] += hi - lo
    assert per == {0: 4, 1: 4, 2: 3}


@pytest.mark.parametrize("n", [0, 1, 5])
def test_small_tables(spark, n):
    got = sharding.shard_rows(spark.range(n).selectExpr("id AS doc_id", "id AS t"), "doc_id", 10, ["t"])
    assert got.count() == n


def test_against_a_plain_version(spark):
    """Row by row: each shard's own rows first, then what is left over walks clockwise to the next shard with room."""
    import bisect

    from pyspark.sql import functions as F

    rows = [(k % 150 if k % 5 else 7, f"t{k}") for k in range(600)] + [(None, f"n{k}") for k in range(30)]
    df = spark.createDataFrame(rows, "doc_id long, t string")
    n, nodes = 7, sharding.ring(7, 8)
    hashed = df.select("doc_id", "t", F.when(F.col("doc_id").isNull(), F.xxhash64("t")).otherwise(F.xxhash64("doc_id")).alias("h"))
    hashed = hashed.withColumn("run", F.shiftrightunsigned(F.xxhash64("h", "t"), 64 - sharding.RUN_BITS)).collect()
    places = [p for p, _ in nodes]
    arcs = {}
    for r in hashed:
        place = (r["h"] & ((1 << 64) - 1)) >> (64 - sharding.RING_BITS)
        arcs.setdefault(bisect.bisect_left(places, place) % len(nodes), []).append(r)
    room = [len(rows) // n + (s < len(rows) % n) for s in range(n)]
    want, left = {}, []
    for arc in range(len(nodes)):
        own = nodes[arc][1]
        for r in sorted(arcs.get(arc, []), key=lambda r: (r["run"], r["h"], r["doc_id"] or -1, r["t"])):
            if room[own]:
                room[own] -= 1
                want[r["t"]] = (own, own)
            else:
                left.append((arc, r))
    for arc, r in left:
        at = (arc + 1) % len(nodes)
        while not room[nodes[at][1]]:
            at = (at + 1) % len(nodes)
        room[nodes[at][1]] -= 1
        want[r["t"]] = (nodes[at][1], nodes[arc][1])
    got = {r["t"]: (r["shard"], r["home_shard"]) for r in sharding.shard_rows(df, "doc_id", n, ["t"], vnodes=8).collect()}
    assert got == want
