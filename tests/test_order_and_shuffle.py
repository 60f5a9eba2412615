import os
import random
import statistics

import numpy as np
import pytest
from pyspark.sql import functions as F

from helixframe.operators import assembly, heritability, order_stats, shuffling
from helixframe.sources import staging


def test_medians_equal_the_plain_ones(spark):
    rng = random.Random(1)
    groups = {
        "huge": [rng.gauss(0, 1) for _ in range(5001)], "even": [3.0, 1.0, 2.0, 10.0], "ties": [1.0] * 50 + [2.0] * 50, "one": [7.5], "two": [-1.0, 4.0],
        "spread": [10.0 ** rng.randint(-300, 300) * rng.choice([-1, 1]) for _ in range(400)], "near": [1 + k * 2.0**-52 for k in range(301)], "far": [float("-inf"), 0.0, float("inf")], "zero": [-0.0, 0.0, -1e-308],
    }
    rows = [(g, v) for g, values in groups.items() for v in values] + [("null", None), (None, 3.0), ("huge", None)]
    df = spark.createDataFrame(rows, "g string, v double").repartition(5)
    got = {r["g"]: r["m"] for r in order_stats.medians(df, ["g"], "v", "m").collect()}
    want = {g: statistics.median(v) for g, v in groups.items()} | {"null": None, None: 3.0}
    assert set(got) == set(want) and all(got[g] == want[g] for g in want)
    assert got == {r["g"]: r["m"] for r in df.groupBy("g").agg(F.median("v").alias("m")).collect()}
    assert order_stats.medians(df.where("false"), ["g"], "v").count() == 0


def test_medians_of_several_keys_and_nan(spark):
    df = spark.createDataFrame([(1, "a", 1.0), (1, "a", float("nan")), (1, "a", 5.0), (1, None, 2.0), (2, "a", float("nan"))], "a int, b string, v double")
    got = {(r["a"], r["b"]): r["median"] for r in order_stats.medians(df, ["a", "b"], "v").collect()}
    assert got[1, "a"] == 5.0 and got[1, None] == 2.0 and np.isnan(got[2, "a"])


@pytest.mark.parametrize("n", [1, 2, 3, 97, 1000])
def test_a_permutation_of_any_size(spark, n):
    ids = spark.range(n)
    orders = [[r["p"] for r in ids.select("id", shuffling.permuted(F.col("id"), n, 5, e).alias("p")).orderBy("id").collect()] for e in range(3)]
    assert all(sorted(o) == list(range(n)) for o in orders)
    assert orders[0] == [r["p"] for r in ids.repartition(3).select("id", shuffling.permuted(F.col("id"), n, 5, 0).alias("p")).orderBy("id").collect()]
    if n == 1000:
        # Neighbours part, and epochs differ.
        assert sum(abs(a - b) == 1 for a, b in zip(orders[0], orders[0][1:])) < 20 and sum(a == b for a, b in zip(*orders[:2])) < 20


def test_epoch_batches(spark):
    rows, n = shuffling.numbered(spark.range(103).withColumnRenamed("id", "sample_id"), "sample_id", buckets=8)
    assert n == 103 and sorted(r["at"] for r in rows.collect()) == list(range(103))
    got = shuffling.epoch_batches(rows, n, 3, 10).collect()
    for e in range(3):
        own = [r for r in got if r["epoch"] == e]
        assert len({r["sample_id"] for r in own}) == 103 and len({(r["batch"], r["slot"]) for r in own}) == 103
        assert max(r["batch"] for r in own) == 10 and sum(r["batch"] == 10 for r in own) == 3


def test_reindex_keeps_places_and_raises(spark):
    source = spark.createDataFrame([(1, "a", 0), (2, "b", 1), (1, "c", 2)], "sample_id long, x string, k int")
    wanted = spark.createDataFrame([(0, 2), (1, 1), (2, 2)], "place int, sample_id long")
    assert [(r["place"], r["sample_id"], r["x"]) for r in assembly.reindex(source, wanted, order="k").orderBy("place").collect()] == [(0, 2, "b"), (1, 1, "c"), (2, 2, "b")]
    for missing in (9, None):
        with pytest.raises(Exception, match="no row for"):
            assembly.reindex(source, spark.createDataFrame([(0, missing)], "place int, sample_id long"), order="k").collect()


def test_surrogate_is_the_dense_one(spark):
    rng = np.random.default_rng(4)
    n, m, d = 50, 9, 2
    x, z, cov, y = rng.integers(0, 3, (n, m)), rng.normal(1, 2, (n, d)), rng.normal(size=(n, 2)), rng.normal(size=(n, d))
    dosage = spark.createDataFrame([(i, j, int(x[i, j])) for i in range(n) for j in range(m)], "sample_id long, variant_idx int, x int")
    table = lambda v: spark.createDataFrame([(i, *map(float, v[i])) for i in range(n)], "sample_id long, z0 double, z1 double")
    covariates = spark.createDataFrame([(i, *map(float, cov[i])) for i in range(n)], "sample_id long, c0 double, c1 double")
    s = heritability.explained_surrogate(dosage, table(z).join(covariates, "sample_id"), ["z0", "z1"], ["c0", "c1"])
    xs = (x - x.mean(0)) / x.std(0)
    v = np.eye(n) - cov @ np.linalg.inv(cov.T @ cov) @ cov.T
    h = (v @ xs) @ np.linalg.inv(xs.T @ v @ xs) @ (v @ xs).T
    cpz = v @ (z / (z.std(0, ddof=1) + 1e-8))
    weight, beta = 2 * (cpz - h @ cpz) + h @ h @ cpz, np.linalg.inv(cov.T @ cov) @ cov.T @ z
    ids = list(range(0, n, 3))
    yb = y[ids] - y[ids].mean(0)
    yb = yb / (yb.std(0, ddof=1) + 1e-8)
    want = -np.sum(weight[ids] * (yb - cov[ids] @ beta), 0)
    got = {r["dim"]: r["loss"] for r in heritability.surrogate_loss(s, table(y).where("sample_id % 3 = 0"), ["z0", "z1"]).collect()}
    assert [got[0], got[1]] == pytest.approx(list(want), abs=1e-7)


def test_what_is_staged_goes(spark):
    staging.staged(spark.range(1))
    top = spark.conf.get("spark.checkpoint.dir").removeprefix("file://")
    rng, before = np.random.default_rng(5), set(os.listdir(top))
    dosage = spark.createDataFrame([(i, j, int(rng.integers(0, 3))) for i in range(20) for j in range(4)], "sample_id long, variant_idx int, x int")
    design = spark.createDataFrame([(i, float(rng.normal()), float(rng.normal())) for i in range(20)], "sample_id long, z0 double, c0 double")
    for f in (heritability.mom, heritability.variance_explained):
        assert f(dosage, design, ["z0"], ["c0"]).count() == 1
    assert set(os.listdir(top)) <= before
