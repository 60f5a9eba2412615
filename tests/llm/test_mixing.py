from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from helixframe.llm import mixing


def targets(sizes, weights=(3, 1, 2), share=1.5, cap=2):
    """Share by weight, cap, share the excess again, until nothing is above."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[k % len(weights)] for k, s in enumerate(order)}
    total, fixed = share * sum(sizes.values()), {}
    while True:
        free = [s for s in order if s not in fixed]
        left = total - sum(fixed.values())
        level = left / max(sum(weight[s] for s in free), 1e-12)
        above = [s for s in free if level * weight[s] > cap * sizes[s]]
        if not above:
            return fixed | {s: level * weight[s] for s in free}
        fixed |= {s: cap * sizes[s] for s in above}


@pytest.fixture
def sized(spark):
    rows = [(k, ["a", "b", "c", None, "hot"][k % 5 if k < 40 else 4], (k * 37) % 90) for k in range(200)]
    return rows, spark.createDataFrame(rows, "doc_id long, source string, size long")


def test_targets_and_amounts(sized):
    rows, df = sized
    sizes = defaultdict(int)
    for _, s, n in rows:
        sizes[s] += n
    want = targets(sizes)
    got = mixing.mix_amounts(df, ["doc_id"], block_words=16).collect()
    assert len(got) == len(rows)
    taken = defaultdict(int)
    for r in got:
        assert r["source_size"] == sizes[r["source"]]
        assert r["target"] == pytest.approx(want[r["source"]])
        assert 0 <= r["taken"] <= 2 * r["size"]
        taken[r["source"]] += r["taken"]
    for s, t in want.items():
        assert abs(taken[s] - t) <= 2 * 16
    again = mixing.mix_amounts(df.repartition(7), ["doc_id"], block_words=16)
    assert {(r["doc_id"], r["taken"]) for r in again.collect()} == {(r["doc_id"], r["taken"]) for r in got}


@pytest.mark.parametrize("n", [1, 2, 3, 7, 64, 1000, 1025])
def test_permutation_is_one_to_one(spark, n):
    df = mixing.with_permutation(spark.range(n).withColumn("n", F.lit(n).cast("long")), "n", "p", F.lit(3))
    got = [r["o"] for r in mixing.permute(df, "id", "n", "p", "o").orderBy("id").collect()]
    assert sorted(got) == list(range(n))
    if n >= 64:
        assert sum(a + 1 == b for a, b in zip(got, got[1:])) < n / 8


def test_permutation_of_large_counts_stays_in_range(spark):
    n = (1 << 40) + 12345
    df = spark.range(1000).select((F.col("id") * 1_000_000_007).alias("i"), F.lit(n).alias("n"))
    got = [r["o"] for r in mixing.permute(mixing.with_permutation(df, "n", "p", F.lit(3)), "i", "n", "p", "o").collect()]
    assert len(set(got)) == 1000 and all(0 <= x < n for x in got)


def plain_counts(spark, wanted, shard_slots, seed=17):
    """Counts by (shard, source), and each source's draws in order of shards, from one hash per slot; ``wanted`` is in order."""
    total = sum(n for _, n in wanted)
    places = [r["p"] for r in spark.range(total).select("id", F.pmod(F.xxhash64(F.lit(seed), F.col("id")), F.lit(max(total, 1))).alias("p")).orderBy("id").collect()]
    ends, line = [], 0
    for s, n in wanted:
        line += n
        ends.append((line, s))
    left, free, draws = dict(wanted), [], []
    for slot, place in enumerate(places):
        source = next(s for end, s in ends if place < end)
        if left[source]:
            left[source] -= 1
            draws.append((slot // shard_slots, source))
        else:
            free.append(slot // shard_slots)
    lacking = [s for s, _ in wanted for _ in range(left[s])]
    return draws + list(zip(free, lacking, strict=True))


@pytest.mark.parametrize("shard_slots", [4, 32, 1000])
def test_shard_counts_and_taken_against_a_plain_version(spark, sized, shard_slots):
    rows, df = sized
    block = 16
    targets = mixing.source_targets(df)
    order = sorted(targets.collect(), key=lambda r: (r["source"] is None, r["source"] or ""))
    blocks = {r["source"]: -(-r["source_size"] // block) for r in order}
    wanted = [(r["source"], int(r["target"] * blocks[r["source"]] / r["source_size"] + 0.5)) for r in order]
    plain = plain_counts(spark, wanted, shard_slots)
    got = Counter()
    counts = mixing.shard_counts(targets, block, shard_slots)
    for r in counts.collect():
        got[r["shard"], r["source"]] += r["n"]
    assert got == Counter(plain)
    assert all(sum(n for (k, _), n in got.items() if k == shard) == shard_slots for shard in range(sum(n for _, n in wanted) // shard_slots))
    # Blocks by each source's permutation, words of the blocks by place.
    times = Counter()
    for s, n in wanted:
        one = spark.range(blocks[s]).select("id", F.lit(blocks[s]).cast("long").alias("n"), F.lit(s).alias("source"))
        perm = [r["o"] for r in mixing.permute(mixing.with_permutation(one, "n", "p", F.lit(17), F.col("source")), "id", "n", "p", "o").orderBy("id").collect()]
        for k in range(n):
            times[s, perm[k % blocks[s]]] += 1
    placed = mixing.lay_out(df.select(F.struct("doc_id").alias("row"), "source", "size", F.col("doc_id").alias("t0")), len(rows), ["t0"])
    want = {r["row"]["doc_id"]: sum(times[r["source"], w // block] for w in range(r["start"], r["stop"])) for r in placed.collect()}
    assert {r["doc_id"]: r["taken"] for r in mixing.mix_amounts(df, ["doc_id"], block, shard_slots).collect()} == want


def test_slots_take_blocks_evenly(sized):
    rows, df = sized
    slots = mixing.draw_slots(mixing.shard_counts(mixing.source_targets(df), 16, shard_slots=32)).collect()
    per, shards = defaultdict(Counter), Counter()
    for r in slots:
        per[r["source"]][r["block"]] += 1
        shards[r["shard"]] += 1
    assert sorted(shards.values())[1:] == [32] * (len(shards) - 1)
    for counts in per.values():
        assert max(counts.values()) - min(counts.values()) <= 1 or min(counts.values()) >= 1
        assert max(counts.values()) <= 2


def test_blocks_of_the_mix(spark):
    rows = [(k, " ".join(f"w{k}_{j}" for j in range(k % 23)), "ab"[k % 2]) for k in range(60)] + [(1, None, "a"), (None, "x y z", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mixing.mixed_blocks(df, block_words=8, shard_slots=16).collect()
    assert sorted((r["shard"], r["slot"]) for r in got) == [divmod(k, 16) for k in range(len(got))]
    texts = defaultdict(set)
    for r in got:
        assert len(r["text"].split()) <= 8
        texts[r["source"], r["block"]].add(r["text"])
    assert all(len(x) == 1 for x in texts.values())
    whole = Counter(w for _, t, s in rows if s == "a" and t for w in t.split())
    blocks = {b for s, b in texts if s == "a"}
    assert blocks == set(range(len(blocks))) and Counter(w for b in blocks for w in next(iter(texts["a", b])).split()) == whole
    assert mixing.mixed_blocks(df.limit(0)).count() == 0


def test_running_sums(spark):
    from helixframe.llm.common import running_sum

    rows = [(["x", None, "y"][k % 3], k // 3, (k * 7) % 11) for k in range(90)]
    df = spark.createDataFrame(rows, "g string, k long, v long")
    for r in running_sum(df, ["g"], "k", "v", "before", fan=4).collect():
        assert r["before"] == sum(v for g, k, v in rows if g == r["g"] and k < r["k"])


def test_documents_of_the_mix_hold_the_words_taken(spark, docs):
    longer = spark.createDataFrame([(10 + k, " ".join(f"w{k}_{j}" for j in range(50)), "a" if k % 2 else "b", 0) for k in range(20)], docs.schema)
    both = docs.where("doc_id <> 6 OR doc_id IS NULL").unionByName(longer)
    out = mixing.mix_documents(both, block_words=8)
    assert out.columns == both.columns
    words, source = Counter(), {}
    for r in both.collect():
        source[r["doc_id"]] = (r["text"] or "").split()
    for r in out.collect():
        assert r["text"] and Counter(r["text"].split()) <= Counter(source[r["doc_id"]])
        words[r["doc_id"]] += len(r["text"].split())
    assert all(n <= 2 * len(source[i]) for i, n in words.items())
    total = sum(len(x) for x in source.values())
    assert abs(sum(words.values()) - 1.5 * total) < 0.1 * total


def test_edges(docs):
    sized = docs.select("doc_id", "source", mixing.size_of(F.col("text")).alias("size"))
    got = mixing.mix_amounts(sized, ["doc_id"]).collect()
    assert len(got) == docs.count() and all(r["taken"] <= 2 * r["size"] for r in got)
    assert mixing.mix_amounts(sized.limit(0), ["doc_id"]).count() == 0
    assert mixing.mix_documents(docs.limit(0)).count() == 0
    assert mixing.mix_documents(docs).count() > 0
