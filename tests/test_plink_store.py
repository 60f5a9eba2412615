import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from helixframe.operators import blocks, heritability
from helixframe.sources import plink


def tables(spark, n, m, missing, seed):
    rng = np.random.default_rng(seed)
    g = rng.integers(0, 3, (n, m))
    g[rng.random((n, m)) < missing] = -1
    dosage = spark.createDataFrame([(100 + i, j, None if g[i, j] < 0 else int(g[i, j])) for i in range(n) for j in range(m)], "sample_id long, variant_idx int, x int")
    samples = spark.createDataFrame([(i, 100 + i) for i in range(n)], "row_idx int, sample_id long")
    variants = spark.createDataFrame([(j, "7", f"rs{j}", 0.5, 10 * j, "A", "GT") for j in range(m)], "variant_idx int, chrom string, rsid string, cm double, bp long, a1 string, a2 string")
    return g, dosage, samples, variants


@pytest.mark.parametrize("n,m,missing", [(1, 4, 0), (2, 5, 0), (3, 9, 0.3), (5, 4, 0), (7, 11, 0.2), (13, 6, 0), (31, 23, 0.1)])
def test_round_trip_from_several_tasks(spark, tmp_path, n, m, missing):
    g, dosage, samples, variants = tables(spark, n, m, missing, n)
    for store in (f"{tmp_path}/plain", f"file://{tmp_path}/uri"):
        plink.write(dosage, samples, variants, store, parts=3, tile=4, rows=8)
        assert plink.is_store(store)
        got = np.full((n, m), -9)
        for r in spark.read.format("plink").option("chunk", 3).load(store).collect():
            got[r["sample_id"] - 100, r["variant_idx"]] = -1 if r["x"] is None else r["x"]
        assert (got == g).all()
    assert [tuple(r) for r in plink.read_bim(spark, f"{tmp_path}/plain").orderBy("variant_idx").collect()] == [(j, "7", f"rs{j}", 0.5, 10 * j, "A", "GT") for j in range(m)]
    assert [r["sample_id"] for r in plink.read_fam(spark, f"{tmp_path}/plain").orderBy("row_idx").collect()] == [100 + i for i in range(n)]
    if m > 9:
        assert len([f for f in os.listdir(f"{tmp_path}/plain") if f.endswith(".bed")]) > 1
    # The bytes are those of a trio in one file.
    plink.write_trio(f"{tmp_path}/one", g, list(range(100, 100 + n)))
    one, _ = plink.layout(f"{tmp_path}/one")
    many, _ = plink.layout(f"{tmp_path}/plain")
    assert (one.variants(0, m) == many.variants(0, m)).all()


def test_a_panel_straight_from_bytes(spark, tmp_path):
    n, m = 41, 23
    g, dosage, samples, variants = tables(spark, n, m, 0.1, 5)
    plink.write(dosage, samples, variants, f"{tmp_path}/g", parts=4, tile=4, rows=8)
    p = plink.read_panel(spark, f"{tmp_path}/g", tile=5, rows=16)
    assert (p.n, p.m, p.n_rows, p.n_tiles) == (n, m, 3, 5)
    design = samples.select("sample_id", F.sin(F.col("row_idx") * 1.3).alias("z0"), F.cos(F.col("row_idx") * 0.7).alias("c0"))
    for more in ({}, {"covariates": ["c0"]}):
        got, want = (heritability.mom(x, design, ["z0"], **more).first()["h2"] for x in (p, dosage))
        assert got == pytest.approx(want, rel=1e-10)
    assert {r["sample_id"] for r in p.samples.collect()} == set(range(100, 100 + n))
    with pytest.raises(Exception, match="multiple of 4"):
        plink.read_panel(spark, f"{tmp_path}/g", rows=6).blocks.count()
    assert blocks.gram(p).count() == 15


def test_a_failed_write_leaves_no_part(spark, tmp_path):
    _, dosage, samples, variants = tables(spark, 6, 9, 0, 1)
    plink.register(spark)
    rows = plink.variant_rows(dosage, samples, variants, tile=4, rows=8)
    bad = rows.withColumn("packed", F.when(F.col("variant_idx") == 8, F.raise_error(F.lit("lost")).cast("binary")).otherwise(F.col("packed")))
    with pytest.raises(Exception, match="lost"):
        bad.repartitionByRange(3, "variant_idx").write.format("plink").mode("append").save(f"{tmp_path}/g")
    assert not plink.is_store(f"{tmp_path}/g")
    left = [f for _, _, names in os.walk(tmp_path) for f in names]
    assert left == []
