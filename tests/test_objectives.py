import math
import random
from statistics import NormalDist

import numpy as np
import pytest
from pyspark.sql import functions as F

from helixframe.functions import scalars
from helixframe.operators import comparison, factored, heritability, ldsc, logs, objectives
from helixframe.sources.staging import staged
from helixframe.streaming import incremental


def test_weighted_loss_and_active(spark):
    values = spark.createDataFrame([(0, 0.5), (1, -2.0), (2, 4.0), (3, None)], "dim int, value double")
    weights = spark.createDataFrame([(0, 2.0), (1, 1.0), (2, 0.0), (3, 1.0)], "dim int, weight double")
    assert objectives.weighted_loss(values, weights).first()["loss"] == pytest.approx(1.0)
    assert {r["dim"] for r in objectives.active(values, weights).collect()} == {0, 1, 3}
    assert objectives.weighted_loss(values.limit(0), weights).first()["loss"] == 0


def test_spectrum_and_marginal_loss(spark):
    rows = spark.createDataFrame([(0.5,), (3.0,), (-1.0,), (2.0,)], "value double")
    assert objectives.spectrum_loss(rows, [1.0, 0.5, 0.25, 9.0, 9.0]).first()["loss"] == pytest.approx(-(3 + 1 + 0.125))
    assert objectives.spectrum_loss(rows, []).first()["loss"] == 0
    rng = np.random.default_rng(0)
    a = rng.normal(size=(6, 6))
    g, p = a @ a.T, np.eye(6) + 0.1
    values, _ = heritability.spectrum(g, p)
    assert values.sum() == pytest.approx(objectives.trace_of_ratio(g, p), rel=1e-9)
    got = objectives.total(spark.createDataFrame([(float(v),) for v in values], "value double")).first()
    assert got["total"] == pytest.approx(values.sum()) and got["top"] == pytest.approx(list(values[:5]))
    weights = spark.createDataFrame([(k, 1.0) for k in range(6)], "dim int, weight double")
    loss = objectives.marginal_loss(heritability.matrix_rows(spark, g=g, p=p), weights).first()["loss"]
    assert loss == pytest.approx(-sum(max(0, g[k, k] / p[k, k]) for k in range(6)))


def test_sample_mse(spark):
    df = spark.createDataFrame([(1, [1.0, 2.0], [0.0, 4.0]), (2, [], []), (3, [1.0], [1.0, 2.0])], "sample_id long, a array<double>, b array<double>")
    got = {r["sample_id"]: r["mse"] for r in objectives.sample_mse(df, F.col("a"), F.col("b")).collect()}
    assert got == {1: 2.5, 2: None, 3: None}


def test_summary_and_lines(spark):
    df = spark.createDataFrame([(1.0,), (3.0,), (float("nan"),), (None,)], "x double")
    r = objectives.summary(df, "x").first()
    assert (r["n"], r["mean"], r["sd_pop"]) == (2, 2.0, 1.0) and r["sd"] == pytest.approx(math.sqrt(2))
    line = objectives.gencov_line(spark.createDataFrame([(3, [0.00123], [-4.0])], "epoch int, gencov_train array<double>, gencov_val array<double>")).first()["line"]
    assert line == "epoch 3 - gencov_train: +1.2300e-03 - gencov_val: -4.0000e+00"
    wide = spark.createDataFrame([(2, 1.0, 2.0, [0.1], [0.2], [-0.3], [0.4])], "epoch int, mse_train double, mse_val double, train_even array<double>, train_odd array<double>, val_even array<double>, val_odd array<double>")
    parsed = {r["stream"]: r["value"] for r in logs.parse(objectives.split_lines(wide), "epoch").collect()}
    assert parsed == {"train_even": 0.1, "train_odd": 0.2, "val_even": -0.3, "val_odd": 0.4}


def test_two_runs_and_mask(spark):
    control = spark.createDataFrame([(e, d, 0.1 * d + 0.01 * e) for e in (1, 4, 8) for d in range(4)], "epoch int, dim int, value double")
    experiment = spark.createDataFrame([(e, d, [0.1, 0.9, 0.2][e - 5] + d) for e in (5, 6, 7) for d in range(4)], "epoch int, dim int, value double")
    got = comparison.two_runs(control, experiment).collect()
    # The peak is epoch 6; 4 and 8 are equally near.
    assert {(r["run"], r["epoch"]) for r in got} == {("control", 4), ("experiment", 6)} and len(got) == 8
    masked = comparison.two_runs(control, experiment, control, 0.2).collect()
    assert {r["dim"] for r in masked} == {2, 3}
    assert comparison.two_runs(control, experiment.limit(0)).count() == 0


def test_rank_sum_with_many_values(spark):
    rng = random.Random(2)
    rows = [(rng.gauss(0.3 * (k % 2), 1), k % 2 == 1) for k in range(3000)] + [(None, True), (0.5, None)]
    r = comparison.rank_sum_p(spark.createDataFrame(rows, "v double, t boolean"), "v", "t").first()
    full = sorted(rows[:3000])
    w, n = sum(i + 1 for i, (_, t) in enumerate(full) if t), 1500
    z = (w - n * 3001 / 2) / math.sqrt(n * n * 3001 / 12)
    assert r["z"] == pytest.approx(z) and r["p"] == pytest.approx(1 - NormalDist().cdf(z)) and (r["n1"], r["n2"]) == (n, n)
    assert comparison.rank_sum_p(spark.createDataFrame([], "v double, t boolean"), "v", "t").first()["p"] is None


@pytest.mark.parametrize("form", ["rank_sum", "rank_sum_p"])
def test_rank_sum_of_millions_of_rows(spark, form):
    """The product of the counts passes 2 ** 63."""
    n = 2_000_000
    df = spark.range(2 * n).selectExpr("cast(id % 4 as double) v", "id % 2 = 1 t")
    r = (logs.rank_sum if form == "rank_sum" else comparison.rank_sum_p)(df, "v", "t").first()
    # Four values in turn, the second and fourth treated: ranks of values differ by a quarter of all rows.
    w = n / 2 * (n / 2 * (1 + 3) + 2 * (n / 2 + 1) / 2)
    assert r["z"] == pytest.approx((w - n * (2 * n + 1) / 2) / math.sqrt(n * n * (2 * n + 1) / 12)) and (r["n1"], r["n2"]) == (n, n)


def test_same_splits(spark):
    one = spark.createDataFrame([(1, "train"), (2, "val")], "sample_id long, part string")
    assert comparison.same_splits([one, one]) and not comparison.same_splits([one, one.where("sample_id = 1")])


def test_liability(spark):
    for bad in (0.0, 1.0, -0.1, float("nan")):
        with pytest.raises(ValueError):
            scalars.liability_factor(bad, 0.5)
    row = spark.range(1).select(
        scalars.liability_h2(F.lit(0.4), None, None).alias("a"), scalars.liability_h2(F.lit(0.4), 0.01, 0.5).alias("b"),
        scalars.liability_gencov(F.lit(0.4), (0.01, 0.5), (0.01, 0.5)).alias("c"), scalars.liability_gencov(F.lit(0.4), (0.01, 0.5), (None, None)).alias("d"),
    ).first()
    f = scalars.liability_factor(0.01, 0.5)
    assert row["a"] == 0.4 and row["b"] == pytest.approx(0.4 * f) and row["c"] == pytest.approx(0.4 * f) and row["d"] == pytest.approx(0.4 * math.sqrt(f))
    with pytest.raises(ValueError):
        scalars.liability_h2(F.lit(0.4), 0.01, None)
    assert scalars.parse_chroms("1,2,") == [1, 2]


def cohort(spark, n, m, d, seed=0, c=2):
    rng = np.random.default_rng(seed)
    x, z, w = rng.integers(0, 3, (n, m)), rng.normal(size=(n, d)), rng.normal(size=(n, c))
    dosage = spark.createDataFrame([(i, j, int(x[i, j])) for i in range(n) for j in range(m)], "sample_id long, variant_idx int, x int")
    return x, z, w, dosage


def test_state_after_many_batches(spark):
    n, m, d, c = 40, 12, 3, 2
    x, z, w, dosage = cohort(spark, n, m, d, 1)
    xs_np = (x - x.mean(0)) / np.maximum(x.std(0), 1e-8)
    full = np.column_stack([np.ones(n), w])
    xs = staged(spark.createDataFrame([(i, j, float(xs_np[i, j])) for i in range(n) for j in range(m)], "sample_id long, variant_idx int, xs double"))
    cov = staged(spark.createDataFrame([(i, k, float(full[i, k])) for i in range(n) for k in range(c + 1)], "sample_id long, k int, c double"))
    traits = staged(spark.createDataFrame([(i, k, float(z[i, k])) for i in range(n) for k in range(d)], "sample_id long, dim int, z double"))
    state, sums = staged(incremental.rebuild(xs, traits)), staged(incremental.rebuild_covariates(cov, traits))
    rng = np.random.default_rng(5)
    for _ in range(30):
        ids = rng.choice(n, 8, replace=False)
        z[ids] = rng.normal(size=(8, d))
        batch = staged(spark.createDataFrame([(int(i), k, float(z[i, k])) for i in ids for k in range(d)], "sample_id long, dim int, z double"))
        sums = staged(incremental.update_covariates(cov, sums, traits, batch))
        state, traits = (staged(t) for t in incremental.update(xs, state, traits, batch))
    inverse = np.linalg.inv(full.T @ full)
    v = np.eye(n) - full @ inverse @ full.T
    kin = xs_np @ xs_np.T / m
    t1, t2 = np.trace(v @ kin), np.trace(v @ kin @ v @ kin)
    by = spark.createDataFrame([(j, float(xs_np[:, j] @ xs_np[:, j]), *map(float, xs_np[:, j] @ full)) for j in range(m)], "variant_idx int, s double, t_0 double, t_1 double, t_2 double")
    fixed = incremental.Fixed(by, inverse, n, m, t1, t2)
    qk, q, nc = np.diag(z.T @ v @ kin @ v @ z), np.diag(z.T @ v @ z), n - c - 1
    v0, v1 = qk * nc - q * t1, q * t2 - qk * t1
    got = [r["h2"] for r in incremental.h2_of_state(state, sums, traits, fixed).orderBy("dim").collect()]
    assert got == pytest.approx(list(v0 / (v0 + v1)), abs=1e-7)
    stats = incremental.sumstats_of_state(state, sums, traits, fixed).collect()
    for r in stats:
        j, k = r["variant_idx"], r["dim"]
        assert r["beta"] == pytest.approx(xs_np[:, j] @ v @ z[:, k] / (xs_np[:, j] @ v @ xs_np[:, j]), abs=1e-9)
    g, p = incremental.matrices_of_state(state, sums, traits, fixed)
    zvz = z.T @ v @ z
    solve = np.linalg.inv(np.array([[t2, t1], [t1, nc]]))
    assert np.allclose(g, solve[0, 0] * z.T @ v @ kin @ v @ z + solve[0, 1] * zvz, atol=1e-8)
    assert np.allclose(p, zvz / np.sqrt(np.outer(np.diag(zvz), np.diag(zvz))))
    none = incremental.Fixed(by.select("variant_idx", "s"), np.zeros((0, 0)), n, m, np.trace(kin), np.trace(kin @ kin))
    plain = [r["h2"] for r in incremental.h2_of_state(state, sums, traits, none).orderBy("dim").collect()]
    assert plain == pytest.approx([(z[:, k] @ kin @ z[:, k] - z[:, k] @ z[:, k]) / (np.trace(kin @ kin) - n) for k in range(d)], abs=1e-9)


def test_long_form_equals_wide_form(spark):
    _, z, _, dosage = cohort(spark, 30, 9, 3, 2)
    design = spark.createDataFrame([(i, *map(float, z[i])) for i in range(30)], "sample_id long, z0 double, z1 double, z2 double")
    want = {r["dim"]: r["h2"] for r in heritability.mom(dosage, design, ["z0", "z1", "z2"]).collect()}
    long = incremental.long_traits(design, ["z0", "z1", "z2"]).withColumns({"run": F.lit(0), "epoch": F.lit(7)})
    for probes in (None, 400):
        got = {r["dim"]: r["h2"] for r in heritability.mom_long(dosage, long, probes=probes).collect()}
        assert got == pytest.approx(want, abs=0.05 if probes else 1e-9)


def test_five_thousand_variants(spark):
    n, m = 24, 5000
    ids = spark.range(n).withColumnRenamed("id", "sample_id")
    dosage = ids.withColumn("variant_idx", F.explode(F.sequence(F.lit(0), F.lit(m - 1)))).withColumn("x", F.pmod(F.xxhash64("sample_id", "variant_idx"), F.lit(3)).cast("int"))
    design = ids.select("sample_id", (F.sin(F.col("sample_id") * 1.7)).alias("z0"), F.cos(F.col("sample_id") * 0.9).alias("c0"))
    got = heritability.mom(dosage, design, ["z0"], ["c0"], probes=10).first()["h2"]
    assert math.isfinite(got)


def test_several_annotations_agree_with_one(spark):
    rng = random.Random(3)
    rows = [("t", rng.gauss(0, 1.2), rng.gauss(0, 1.2), 5000.0, 4000.0, 1 + 3 * rng.random(), 1 + rng.random(), 50_000.0) for _ in range(300)]
    df = spark.createDataFrame(rows, "g string, z1 double, z2 double, n1 double, n2 double, ld double, w_ld double, m double")
    for fixed in ((1.0, 1.0, 0.0), (None, None, None)):
        one, many = ldsc.genetic_correlation(df, ["g"], fixed).first(), ldsc.correlation_annotations(df, ["g"], ["ld"], [50_000.0], fixed).first()
        for c in ("h1", "h2", "gencov"):
            assert many[c] == pytest.approx(one[c], rel=1e-6)


def test_latent_correlation_skips(spark):
    rng = random.Random(4)
    ext = spark.createDataFrame([(j, rng.gauss(0, 1.5), 3000.0, 1 + 3 * rng.random(), 1.5) for j in range(80)], "variant_idx int, z double, n double, ld double, w_ld double")
    stats = spark.createDataFrame([(j, d, [rng.gauss(0, 1.5), 0.01, 0.0][d]) for j in range(90) for d in range(3)], "variant_idx int, dim int, z double")
    weights = spark.createDataFrame([(0, 1.0), (1, 2.0), (2, 0.0)], "dim int, weight double")
    got = {r["dim"]: r for r in ldsc.latent_correlation(stats, ext, 2000, 80_000.0, weights, (1.0, 1.0, 0.0)).collect()}
    assert set(got) == {0, 1} and got[1]["skipped"] and got[1]["rg"] == 0 and got[1]["h1"] < 0
