import numpy as np
import pytest
from pyspark.sql import functions as F

from helixframe.operators import blocks, factored, heritability, variants
from helixframe.sources import cohort


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(7)
    n, m, d, c = 60, 12, 3, 2
    x = rng.integers(0, 3, (n, m)).astype(float)
    x[rng.random((n, m)) < 0.05] = np.nan
    z, cov, y = rng.normal(size=(n, d)), rng.normal(size=(n, c)), rng.normal(size=n)
    dosage = spark.createDataFrame([(i, j, None if np.isnan(x[i, j]) else int(x[i, j])) for i in range(n) for j in range(m)], "sample_id long, variant_idx int, x int")
    names = [f"z{k}" for k in range(d)] + [f"c{k}" for k in range(c)] + ["y"]
    design = spark.createDataFrame([(i, *map(float, [*z[i], *cov[i], y[i]])) for i in range(n)], "sample_id long, " + ", ".join(f"{k} double" for k in names))
    xs = (x - np.nanmean(x, 0)) / np.nanstd(x, 0)
    return dosage.cache(), design.cache(), np.nan_to_num(xs), z, cov, y


Z, C = ["z0", "z1", "z2"], ["c0", "c1"]


def standard(v):
    return (v - v.mean(0)) / (v.std(0, ddof=1) + 1e-8)


def values(df, *cols):
    rows = sorted(df.collect(), key=lambda r: r["dim"])
    return [np.array([r[c] for r in rows]) for c in cols]


def test_mom_without_covariates(data):
    dosage, design, xs, z, *_ = data
    k, ys = xs @ xs.T / xs.shape[1], standard(z)
    n = len(k)
    want = np.einsum("id,ij,jd->d", ys, k - np.eye(n), ys) / (np.sum(k * k) - n)
    np.testing.assert_allclose(values(heritability.mom(dosage, design, Z), "h2")[0], want, atol=1e-10)
    kin = blocks.kinship(blocks.panel(dosage, xs.shape[1], tile=4, rows=16))
    np.testing.assert_allclose(values(heritability.mom_kinship(kin, design, Z), "h2")[0], want, atol=1e-10)


def projector(w):
    return np.eye(len(w)) - w @ np.linalg.inv(w.T @ w) @ w.T


def test_mom_with_covariates_has_no_intercept(data):
    dosage, design, xs, z, cov, _ = data
    v, ys = projector(cov), standard(z)
    kt = v @ (xs @ xs.T / xs.shape[1]) @ v
    a = np.array([[np.sum(kt * kt), np.trace(kt)], [np.trace(kt), len(v) - 2]])
    want = []
    for k in range(3):
        s = np.linalg.solve(a, [ys[:, k] @ kt @ ys[:, k], ys[:, k] @ v @ ys[:, k]])
        want.append(s[0] / (s[0] + s[1] + (1e-8 if s.sum() >= 0 else -1e-8)))
    np.testing.assert_allclose(values(heritability.mom(dosage, design, Z, C), "h2")[0], want, atol=1e-9)


def dense_gc(xs, z, w, y):
    v = projector(w)
    kt, nc = v @ (xs @ xs.T / xs.shape[1]) @ v, len(v) - w.shape[1]
    t1, t2 = np.trace(kt), np.sum(kt * kt)
    num = lambda a, b: a @ kt @ b * nc - a @ v @ b * t1
    return v, kt, num, t2 * nc - t1 * t1


def test_genetic_covariance_and_matrices(data):
    dosage, design, xs, z, cov, y = data
    w = np.hstack([np.ones((len(z), 1)), cov])
    ys, y2 = standard(z), standard(y)
    v, kt, num, det = dense_gc(xs, ys, w, y2)
    gamma, rho = values(heritability.genetic_covariance(dosage, design, Z, "y", C), "gamma", "rho")
    np.testing.assert_allclose(gamma, [num(ys[:, k], y2) / det for k in range(3)], atol=1e-9)
    want = [num(ys[:, k], y2) / np.sqrt(max(num(ys[:, k], ys[:, k]), 1e-8) * max(num(y2, y2), 1e-8)) for k in range(3)]
    np.testing.assert_allclose(rho, np.clip(want, -1, 1), atol=1e-9)
    g, p = heritability.genetic_matrices(dosage, design, Z, C)
    np.testing.assert_allclose(g, [[num(ys[:, i], ys[:, j]) / det for j in range(3)] for i in range(3)], atol=1e-8)
    lam, directions = heritability.spectrum(g, p, 1e-4)
    whole = p + 1e-4 * np.eye(3)
    np.testing.assert_allclose(lam.sum(), np.trace(np.linalg.solve(whole, g)), atol=1e-7)
    np.testing.assert_allclose(directions.T @ whole @ directions, np.eye(3), atol=1e-9)
    np.testing.assert_allclose(heritability.of_directions(g, p, directions, 1e-4), lam, atol=1e-8)
    first, _ = heritability.spectrum(g, p, 1e-4, first=2)
    np.testing.assert_allclose(first, heritability.spectrum(g[:2, :2], p[:2, :2], 1e-4)[0])


def test_association_is_regression(data):
    dosage, design, xs, z, cov, _ = data
    w = np.hstack([np.ones((len(z), 1)), cov])
    got = {(r["variant_idx"], r["dim"]): r for r in heritability.association(dosage, design, Z, C).collect()}
    zs = (z - z.mean(0)) / z.std(0, ddof=1)
    for j in (0, 5, 11):
        beta = np.linalg.lstsq(np.hstack([xs[:, [j]], w]), zs, rcond=None)[0][0]
        np.testing.assert_allclose([got[j, k]["beta"] for k in range(3)], beta, atol=1e-9)
        assert all(abs(got[j, k]["chisq"] - got[j, k]["z"] ** 2) < 1e-9 for k in range(3))


def test_variance_explained_over_many_blocks(data, small):
    dosage, design, xs, z, cov, _ = data
    v = projector(np.hstack([np.ones((len(z), 1)), cov]))
    py, px = v @ standard(z), v @ xs
    r = projector(px) @ py
    p = blocks.panel(dosage, xs.shape[1], tile=5, rows=9)
    np.testing.assert_allclose(values(heritability.variance_explained(p, design, Z, C), "r2")[0], py.var(0, ddof=1) - r.var(0, ddof=1), atol=1e-9)


def test_a_trait_that_genotypes_explain_and_dependent_variants(data):
    dosage, design, xs, *_ = data
    # z0 constant: nothing to explain.
    flat = values(heritability.variance_explained(dosage, design.withColumn("z0", F.lit(3.0)), Z, C), "r2")[0]
    assert abs(flat[0]) < 1e-9 < flat[1]
    with pytest.raises(ValueError):
        heritability.variance_explained(dosage.where("sample_id < 8"), design.where("sample_id < 8"), Z, C)


def test_variance_explained(data):
    dosage, design, xs, z, cov, _ = data
    v = projector(np.hstack([np.ones((len(z), 1)), cov]))
    py, px = v @ standard(z), v @ xs
    r = projector(px) @ py
    np.testing.assert_allclose(values(heritability.variance_explained(dosage, design, Z, C), "r2")[0], py.var(0, ddof=1) - r.var(0, ddof=1), atol=1e-9)


def test_hutchinson_is_near_the_exact_trace(data):
    dosage, _, xs, *_ = data
    k = xs @ xs.T / xs.shape[1]
    got = factored.hutchinson(blocks.panel(dosage, xs.shape[1]), probes=300).agg(F.avg("estimate").alias("e")).first()["e"]
    assert abs(got / np.sum(k * k) - 1) < 0.2


def test_scale_and_shift_do_not_matter(data):
    dosage, design, *_ = data
    moved = design.withColumn("z0", F.col("z0") * 5 - 3)
    np.testing.assert_allclose(values(heritability.mom(dosage, moved, Z), "h2")[0], values(heritability.mom(dosage, design, Z), "h2")[0], atol=1e-7)


def test_monomorphic_variant_counts_in_the_naive_trace(spark):
    x = spark.createDataFrame([(i, j, 1 if j == 0 else i % 3) for i in range(9) for j in range(2)], "sample_id long, variant_idx int, x int")
    assert variants.naive_trace(variants.variant_stats(x)).first()["tr_k"] == 9
    tiles = blocks.panel(x, 2).tiles.collect()
    assert np.frombuffer(tiles[0]["ss"]) == pytest.approx([0.0, 9.0])
    assert cohort.n_variants(spark, "/root/testdata/sf0.001") == 25


@pytest.fixture
def small(monkeypatch):
    """Sums in several parts and groups."""
    monkeypatch.setattr(blocks, "PART", 2)
    monkeypatch.setattr(blocks, "GROUP", 2)


def of_tiles(df, width, *keys):
    return {tuple(r[k] for k in keys): np.frombuffer(r["data"]).reshape(-1, width) for r in df.collect()}


def test_packed_codes_come_back():
    for n, m in ((1, 1), (2, 3), (5, 4), (3, 13), (31, 7)):
        codes = np.random.default_rng(n).integers(0, 4, (n, m)).astype(np.uint8)
        assert (blocks.unpack(blocks.pack(codes), n, m) == codes).all() and len(blocks.pack(codes)) == n * -(-m // 4)


def test_products_and_gram_over_blocks(data, small):
    dosage, design, xs, z, *_ = data
    p = blocks.panel(dosage, xs.shape[1], tile=5, rows=9)
    assert p.n_rows == 7 and p.n_tiles == 3
    got = of_tiles(blocks.product(p, blocks.sample_matrix(p, factored.vectors(design, Z), "v"), True), 3, "tile")
    np.testing.assert_allclose(np.vstack([got[t,] for t in range(3)]), xs.T @ z, atol=1e-10)
    tiles = blocks.gram(p)
    full = np.zeros((12, 12))
    for r in blocks.gram_rows(tiles, 12, 5).collect():
        full[r["j"], r["k"]] = full[r["k"], r["j"]] = r["g"]
    np.testing.assert_allclose(full, xs.T @ xs, atol=1e-10)
    # Back to samples: X (X'Z).
    back = of_tiles(blocks.product(p, blocks.product(p, blocks.sample_matrix(p, factored.vectors(design, Z), "v"), True), False), 3, "rows")
    where = {(r["rows"], r["at"]): r["sample_id"] for r in p.samples.collect()}
    for (rows,), m in back.items():
        for at, line in enumerate(m):
            np.testing.assert_allclose(line, (xs @ xs.T @ z)[where[rows, at]], atol=1e-9)


def test_block_stats_are_variant_stats(data):
    dosage, *_ = data
    p = blocks.panel(dosage, 12, tile=5, rows=9)
    got = {r["variant_idx"]: tuple(r) for r in blocks.block_stats(p.blocks.select("tile", "rows", "n", "packed"), 12, 5).collect()}
    assert got == {r["variant_idx"]: tuple(r) for r in variants.variant_stats(dosage).collect()}


def test_what_is_shuffled_does_not_depend_on_tasks(data):
    dosage, _, xs, *_ = data
    p = blocks.panel(dosage, xs.shape[1], tile=5, rows=9)
    for k in (1, 7):
        more = blocks.Panel(p.blocks.repartition(k), *(getattr(p, c) for c in ("tiles", "samples", "m", "n", "tile", "n_rows")))
        assert blocks.gram(more).count() == 6


def test_traces(data):
    dosage, design, xs, z, cov, y = data
    m, w = xs.shape[1], np.hstack([np.ones((len(z), 1)), cov])
    _, kt, _, _ = dense_gc(xs, standard(z), w, standard(y))
    x, residuals, p = heritability._prepare(dosage, design.withColumn("_one", F.lit(1.0)), Z, ["_one", *C], "add")
    for given, near in (({}, 1e-9), ({"probes": 300}, 0.2)):
        t1, t2 = factored.traces(x, residuals, p, **given)
        np.testing.assert_allclose(t1, np.trace(kt), atol=1e-9)
        assert abs(t2 / np.sum(kt * kt) - 1) < near
    given = {"trace2": float(np.sum(kt * kt))}
    for got, want in zip(heritability.genetic_matrices(dosage, design, Z, C, **given), heritability.genetic_matrices(dosage, design, Z, C), strict=True):
        np.testing.assert_allclose(got, want, atol=1e-9)
    exact, other = (values(heritability.genetic_covariance(dosage, design, Z, "y", C, **more), "gamma", "rho") for more in ({}, given))
    np.testing.assert_allclose(other, exact, atol=1e-9)


def test_mom_takes_more_variants_than_the_gram(spark):
    n, m = 12, 4200
    x = np.random.default_rng(3).integers(0, 3, (n, m))
    dosage = spark.range(n * m).selectExpr("id div 4200 AS sample_id", "int(id % 4200) AS variant_idx", "int(pmod(hash(id), 3)) AS x").cache()
    design = spark.createDataFrame([(i, float(x[i, 0] + i % 5)) for i in range(n)], "sample_id long, z0 double")
    dense = np.zeros((n, m))
    for r in dosage.collect():
        dense[r["sample_id"], r["variant_idx"]] = r["x"]
    sd = dense.std(0)
    xs = (dense - dense.mean(0)) / np.maximum(sd, 1e-8)
    k, ys = xs @ xs.T / m, standard(np.array([[r["z0"]] for r in sorted(design.collect())]))
    q = float(ys[:, 0] @ (k - np.eye(n)) @ ys[:, 0])
    # tr(K^2) is exact at this size too; or estimated, if the caller says so.
    assert values(heritability.mom(dosage, design, ["z0"]), "h2")[0][0] == pytest.approx(q / (np.sum(k * k) - n), rel=1e-9)
    got = values(heritability.mom(dosage, design, ["z0"], probes=30), "h2")[0][0]
    assert abs((q / got + n) / np.sum(k * k) - 1) < 0.2


def test_kinship_without_a_table_of_the_matrix(spark, monkeypatch):
    """Parts of the matrix are used up where they are made, whether sums of variants are cut or not."""
    rng = np.random.default_rng(5)
    xs, n = rng.integers(0, 3, (60, 12)), 60
    dosage = spark.createDataFrame([(i, j, int(xs[i, j])) for i in range(n) for j in range(12)], "sample_id long, variant_idx int, x int")
    # Some samples have no traits.
    design = spark.createDataFrame([(i, *map(float, rng.normal(size=2))) for i in range(0, n, 2)] + [(1, 0.5, -1.0), (3, 2.0, 0.1)], "sample_id long, a double, b double")
    x = (xs - xs.mean(0)) / xs.std(0)
    k = x @ x.T / 12
    for part in (64, 2):
        monkeypatch.setattr(blocks, "PART", part)
        p = blocks.panel(dosage, 12, tile=4, rows=16)
        table = blocks.kinship(p)
        want = values(heritability.mom_kinship(table, design, ["a", "b"]), "h2")[0]
        sizes, plain = [], heritability.staged
        monkeypatch.setattr(heritability, "staged", lambda df: sizes.append(df.count()) or plain(df))
        np.testing.assert_allclose(values(heritability.mom_pairs(p, design, ["a", "b"]), "h2")[0], want, atol=1e-10)
        monkeypatch.setattr(heritability, "staged", plain)
        assert max(sizes) <= n
        got = np.zeros((n, n))
        for r in table.collect():
            got[r["i"], r["j"]] = got[r["j"], r["i"]] = r["k"]
        np.testing.assert_allclose(got, k, atol=1e-12)
        assert table.count() == n * (n + 1) // 2


def test_kinship_is_sent_in_short_batches(spark, monkeypatch):
    """No Arrow batch holds the columns of a whole part of the matrix."""
    import pyarrow as pa

    xs = np.random.default_rng(6).integers(0, 3, (60, 4))
    dosage = spark.createDataFrame([(i, j, int(xs[i, j])) for i in range(60) for j in range(4)], "sample_id long, variant_idx int, x int")
    monkeypatch.setattr(blocks, "SENT", 100, raising=False)
    real = type(dosage).mapInArrow

    def longest(batches):
        for batch in batches:
            yield pa.RecordBatch.from_pydict({"n": [len(batch)]})

    def spied(self, f, schema, **kw):
        return real(self, lambda batches: longest(f(batches)), "n long") if [c.name for c in schema] == ["i", "j", "k"] else real(self, f, schema, **kw)

    monkeypatch.setattr(type(dosage), "mapInArrow", spied)
    sizes = [r["n"] for r in blocks.kinship(blocks.panel(dosage, 4, tile=4, rows=60)).collect()]
    assert sum(sizes) == 1830 and max(sizes) <= 100
