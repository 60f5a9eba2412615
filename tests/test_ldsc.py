import numpy as np
import pytest
from pyspark.sql import functions as F

from helixframe.functions import scalars
from helixframe.operators import ldsc


def one(spark, expr):
    return spark.range(1).select(expr.alias("x")).first()["x"]


def test_weights(spark):
    lit = lambda x: F.lit(float(x))
    h = lambda x: one(spark, ldsc.hsq_weights(lit(1), lit(1), lit(9), lit(7), lit(x), lit(1)))
    assert h(0.5) == pytest.approx(0.5 / (1 + 0.5 * 9 / 7) ** 2)
    assert h(2) == h(1) and h(-1) == h(0)
    g = one(spark, ldsc.gencov_weights(*map(lit, (1, 1, 9, 9, 7, 0.5, 0.5, 0.5, 1, 1, 1))))
    assert g == pytest.approx(h(0.5))


def regress(y, ld, w_ld, n, m, null, fixed, weights):
    est, ic, nbar = m * (y.mean() - (null if fixed is None else fixed)) / (ld * n).mean(), null if fixed is None else fixed, n.mean()
    x = ld * n / nbar
    for _ in range(3):
        w = weights(est, ic)
        if fixed is None:
            a = np.stack([x, np.ones_like(x)])
            b = np.linalg.solve((a * w) @ a.T, (a * w) @ y)
            est, ic = m * b[0] / nbar, b[1]
        else:
            est = m * np.sum(w * x * (y - fixed)) / np.sum(w * x * x) / nbar
    return est, ic


def test_against_numpy(spark):
    rng = np.random.default_rng(1)
    n, size, m = rng.uniform(4e4, 6e4, 300), 300, 3000.0
    ld, w_ld, z1 = rng.uniform(0.5, 4, size), rng.uniform(0.8, 2.5, size), rng.normal(size=size) * 1.5
    z2 = -z1
    df = spark.createDataFrame([("t", *map(float, r), m) for r in zip(z1, z2, n, n, ld, w_ld)], "t string, z1 double, z2 double, n1 double, n2 double, ld double, w_ld double, m double")
    clip = lambda h: min(max(h, 0), 1)
    lo, wo = np.maximum(ld, 1), np.maximum(w_ld, 1)
    hw = lambda h, i: 1 / (2 * (i + clip(h) * n * lo / m) ** 2) / wo
    for fixed in (None, 1.0):
        want = regress(z1**2, ld, w_ld, n, m, 1.0, fixed, hw)
        got = ldsc.hsq(df.withColumns({"chisq": F.col("z1") * F.col("z1"), "n": F.col("n1")}), ["t"], fixed).first()
        np.testing.assert_allclose([got["tot"], got["intercept"]], want, rtol=1e-8)


def test_opposite_traits_correlate_negatively(spark):
    rng = np.random.default_rng(3)
    ld = rng.uniform(1, 100, 50)
    z = np.sqrt(1 + 1e5 * 0.3 * ld / 1e6)
    df = spark.createDataFrame([("t", float(a), float(-a), 1e5, 1e5, float(b), float(b), 1e6) for a, b in zip(z, ld)], "t string, z1 double, z2 double, n1 double, n2 double, ld double, w_ld double, m double")
    r = ldsc.genetic_correlation(df, ["t"], (1.0, 1.0, -1.0)).first()
    assert r["h1"] == pytest.approx(0.3, rel=1e-6) and r["rg"] == pytest.approx(-1, rel=1e-6)
    bad = ldsc.genetic_correlation(df.withColumn("z1", F.lit(0.1)), ["t"], (1.0, 1.0, 0.0)).first()
    assert bad["h1"] < 0 and bad["rg"] is None and bad["gencov"] is not None


def test_context_flips_and_drops(spark):
    snp = lambda k: f"rs{k}"
    alleles = {3: ("G", "A"), 5: ("g", "a"), 6: ("C", "T")}
    stats = spark.createDataFrame([(snp(k), *alleles.get(k, ("A", "G")), 12000.0, float(k)) for k in range(2, 10)], "snp string, a1 string, a2 string, n double, z double")
    ref = spark.createDataFrame([(snp(k), 1.5) for k in range(8)], "snp string, ld double")
    w = spark.createDataFrame([(snp(k), 1.1) for k in range(1, 10)], "snp string, w_ld double")
    bed = spark.createDataFrame([(k, snp(k), "A", "G") for k in range(10)], "variant_idx int, snp string, a1 string, a2 string")
    got = {r["snp"]: r["z"] for r in ldsc.context(stats, ref, w, bed).collect()}
    assert got == {"rs2": 2.0, "rs3": -3.0, "rs4": 4.0, "rs5": -5.0, "rs7": 7.0}


def test_small_functions(spark):
    assert scalars.parse_chroms("1-4,8") == [1, 2, 3, 4, 8] and scalars.parse_chroms("7") == [7] and len(scalars.parse_chroms(None)) == 22
    assert scalars.liability_factor(0.5, 0.5) == pytest.approx(np.pi / 2)
    loss = scalars.moment_loss(spark.createDataFrame([(1.0, -1.0), (-1.0, 1.0)], "a double, b double"), ["a", "b"]).first()["loss"]
    assert loss == pytest.approx(1.0)


def test_two_annotations_are_recovered(spark):
    rng = np.random.default_rng(2)
    ld, n, m = rng.uniform(1, 60, (400, 2)), 1e5, [5e6, 5e6]
    chisq = 1 + n * (ld @ (np.array([0.2, 0.7]) / m))
    df = spark.createDataFrame([("t", float(y), n, 1.0, float(a), float(b)) for y, (a, b) in zip(chisq, ld)], "t string, chisq double, n double, w_ld double, a double, b double")
    for fixed in (None, 1.0):
        r = ldsc.hsq_annotations(df, ["t"], ["a", "b"], m, fixed).first()
        np.testing.assert_allclose(r["cat"], [0.2, 0.7], rtol=1e-6)
        assert r["tot"] == pytest.approx(0.9) and r["intercept"] == pytest.approx(1)
