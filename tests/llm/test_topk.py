import random

import numpy as np
import pytest

from pyspark.sql import functions as F

from helixframe.llm import topk


def brute(queries, cands, k):
    out = []
    for q, v in queries:
        scores = sorted(((-int(np.dot(v, c)), i) for i, c in cands if i != q and len(c) == len(v)))[:k]
        out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(scores)]
    return sorted(out)


@pytest.mark.parametrize("slices", [1, 2, 3])
def test_against_brute_force(spark, monkeypatch, slices):
    monkeypatch.setattr(topk, "CHUNK", 50)
    monkeypatch.setattr(topk, "BLOCK", 4)
    rng = random.Random(slices)
    hot = [rng.randint(-50, 50) for _ in range(6)]
    rows = [(i, hot if i % 3 == 0 else [rng.randint(-50, 50) for _ in range(6)]) for i in range(300)]
    df = spark.createDataFrame(rows, "vec_id long, v array<long>")
    ask = df.where("vec_id % 20 = 0")
    got = sorted(tuple(r) for r in topk.exact_top_k(ask, df, 10, slices).select("query_id", "rank", "vec_id", "score").collect())
    assert got == brute([r for r in rows if r[0] % 20 == 0], rows, 10)


def test_nulls_few_candidates_and_repeats(spark):
    raw = [(0, [1.0, 2.0]), (0, [1.0, 2.0]), (1, [0.5, float("nan")]), (2, None), (3, [None, 1.0]), (None, [1.0, 1.0]), (4, [3.0, float("inf")]), (5, [0.001, -0.001]), (6, [2.0])]
    df = spark.createDataFrame(raw, "vec_id long, embedding array<float>")
    v = df.select("vec_id", topk.integer_vector(df["embedding"]).alias("v"))
    assert {r["vec_id"]: r["v"] for r in v.collect() if r["vec_id"] in (1, 2, 3, 4, 5)} == {1: None, 2: None, 3: None, 4: None, 5: [1, -2]}
    got = [tuple(r) for r in topk.exact_top_k(v.where("vec_id = 0"), v, 10).collect()]
    # Both rows of id 0 ask.
    assert got == [(0, 1, 5, 1024 - 2 * 2048)] * 2
    assert topk.exact_top_k(v.limit(0), v, 10).count() == 0
    assert topk.exact_top_k(v, v.limit(0), 10).count() == 0


def test_repeated_ids_are_rows_of_their_own(spark):
    raw = [(0, [1, 2]), (0, [1, 2]), (0, [3, 0]), (1, [1, 2]), (2, [5, 5]), (2, [5, 5])]
    df = spark.createDataFrame([(*r, k) for k, r in enumerate(raw)], "vec_id long, v array<long>, at long").withColumns({"key": F.lit("x"), "own": F.lit("y")})
    got = sorted(tuple(r) for r in topk.exact_top_k(df.where("vec_id = 0"), df, 4, key="at").collect())
    want = []
    for k, (q, v) in enumerate(raw[:3]):
        scores = sorted((-sum(a * b for a, b in zip(v, c)), i) for j, (i, c) in enumerate(raw) if j != k)[:4]
        want += [(q, r + 1, i, -s) for r, (s, i) in enumerate(scores)]
    assert got == sorted(want)


def test_large_components(spark):
    big = float(1 << 17)
    rows = [(k, [big * (k % 7 - 3), float(k), 0.5]) for k in range(60)] + [(100, [4e6, 0.0, 0.0]), (101, [-5e6, 1.0, 0.0]), (102, [float("inf"), 0.0, 0.0]), (103, [None, 1.0, 1.0]), (104, [])]
    df = spark.createDataFrame(rows, "vec_id long, e array<float>").select("vec_id", topk.integer_vector(F.col("e")).alias("v"))
    vectors = {r["vec_id"]: r["v"] for r in df.collect() if r["v"]}
    assert set(vectors) == {*range(60), 100, 101}
    got = topk.exact_top_k(df.where("vec_id % 10 = 0 AND vec_id < 100"), df, 5).collect()
    for q in range(0, 60, 10):
        scores = sorted((-sum(a * b for a, b in zip(vectors[q], v)), i) for i, v in vectors.items() if i != q)[:5]
        assert sorted((r["rank"], r["vec_id"], r["score"]) for r in got if r["query_id"] == q) == [(k + 1, i, -s) for k, (s, i) in enumerate(scores)]
    # The worst scores of a query below any bound are still exact, and beyond a long they raise.
    far = spark.createDataFrame([(1, [1 << 40, 1]), (2, [-(1 << 21), 4]), (3, [None, 4]), (4, [0, 7])], "vec_id long, v array<long>")
    assert [tuple(r) for r in topk.exact_top_k(far.where("vec_id = 1"), far, 3).orderBy("rank").collect()] == [(1, 1, 4, 7), (1, 2, 2, 4 - (1 << 61))]
    huge = spark.createDataFrame([(1, [1 << 62, 1]), (2, [3, 4]), (3, [None, 4])], "vec_id long, v array<long>")
    with pytest.raises(Exception, match="no long holds the score of"):
        topk.exact_top_k(huge, huge, 2).collect()
