import math

import pytest

from helixframe.operators import assembly, logs


def ids(spark, *xs):
    return spark.createDataFrame([(x,) for x in xs], "sample_id long")


def test_shared_samples(spark):
    got = assembly.shared_samples([ids(spark, 1, 2, 2, 3), ids(spark, 2, 3, 4), ids(spark, 3, 2, 2)])
    assert sorted(r[0] for r in got.collect()) == [2, 3]


def test_complete_needs_only_what_is_required(spark):
    df = spark.createDataFrame([(1, 1.0, None), (2, float("nan"), 1.0), (3, None, 1.0)], "sample_id long, a double, b double")
    assert [r[0] for r in assembly.complete(df, ["a", "a"]).collect()] == [1]
    with pytest.raises(ValueError):
        assembly.select_covariates(df, ["a", "nope"])


def test_split_and_resume(spark):
    parts = assembly.split(ids(spark, *range(50)), 0.6, 0)
    train = parts.where("part = 'train'")
    assert train.count() == 30 and assembly.split(ids(spark, *range(50)).repartition(5), 0.6, 0).exceptAll(parts).count() == 0
    assert assembly.split(ids(spark, 1, 2), 0.1, 0).where("part = 'val'").count() == 2
    assert assembly.resume(train, ids(spark, *range(10))).count() <= 10


def test_last_duplicate_wins(spark):
    df = spark.createDataFrame([(1, 1, "a"), (1, 2, "b"), (2, 1, "c")], "k long, o long, v string")
    assert {(r["k"], r["v"]) for r in assembly.last_of_each(df, "k", "o").collect()} == {(1, "b"), (2, "c")}


def test_nearest_ties_go_down(spark):
    left = spark.createDataFrame([("r", e) for e in (0, 4, 5, 6, 100)], "run string, epoch long")
    right = spark.createDataFrame([("r", 2, 0.2), ("r", 8, 0.8), ("s", 5, 9.0)], "run string, epoch long, m double")
    got = {r["epoch"]: (r["nearest_epoch"], r["nearest_m"]) for r in assembly.nearest(left, right, "epoch", ["run"]).collect()}
    assert got == {0: (2, 0.2), 4: (2, 0.2), 5: (2, 0.2), 6: (8, 0.8), 100: (8, 0.8)}


def test_parse(spark):
    rows = [
        (0, "epoch 3 - mse_train: 1.2345 - mse_val: 1.3456 - h_train: 0.100, -0.020 - h_val: 0.050, 0.010"),
        (1, "epoch 3 - mse_train: 1.2 - mse_val: 1.3 - h_train: 0.9, -0.9 - h_val: 0.5, 0.1"),
        (2, "epoch 4 - mse_train: 1.2 - mse_val: 1.3 - h_train_even: 0.1 - h_train_odd: 0.2 - h_val_even: 0.3 - h_val_odd: -0.4"),
        (3, "epoch 5 - mse_train: 1.2 - mse_val: 1.3 - h_train: nan, 0.1 - h_val: 0.5, 0.1"), (4, "other"),
    ]
    got = {(r["epoch"], r["stream"], r["dim"]): r["value"] for r in logs.parse(spark.createDataFrame(rows, "at long, line string"), "at").collect()}
    assert got == {
        (3, "train", 0): 0.9, (3, "train", 1): -0.9, (3, "val", 0): 0.5, (3, "val", 1): 0.1,
        (4, "train_even", 0): 0.1, (4, "train_odd", 0): 0.2, (4, "val_even", 0): 0.3, (4, "val_odd", 0): -0.4,
    }
    with pytest.raises(ValueError):
        logs.pick_stream(spark.createDataFrame([(1, "train", 0, 0.1)], "epoch int, stream string, dim int, value double"))


def test_stats_peak_histogram_ranks(spark):
    v = spark.createDataFrame([(1, 0, 2.0), (1, 1, -4.0), (1, 2, float("nan")), (2, 0, 1.0), (2, 1, 1.0)], "epoch int, dim int, value double")
    got = {r["epoch"]: r for r in logs.epoch_stats(v, absolute=True).collect()}
    assert (got[1]["mean"], got[1]["sd"], got[1]["top"]) == (3.0, 1.0, 4.0)
    assert {r["epoch"]: r["dim"] for r in logs.peak(v, ["epoch"]).collect()} == {1: 0, 2: 0}
    h = logs.histogram(spark.createDataFrame([(x,) for x in (0.0, 1.0, 1.0, 10.0)], "x double"), "x", 5)
    assert [r["n"] for r in h.orderBy("bin").collect()] == [3, 0, 0, 0, 1]
    r = logs.rank_sum(spark.createDataFrame([(1.0, False), (2.0, True), (2.0, False), (3.0, True)], "v double, t boolean"), "v", "t").first()
    assert r["z"] == pytest.approx((2.5 + 4 - 5) / math.sqrt(4 * 5 / 12))
