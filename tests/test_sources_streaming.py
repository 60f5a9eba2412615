import gzip

import numpy as np
import pytest
from pyspark.sql import functions as F

from helixframe.sources import files, plink
from helixframe.streaming import incremental


@pytest.mark.parametrize("n,m,missing", [(1, 4, 0), (2, 4, 0), (3, 4, 0), (5, 4, 0), (7, 4, 0.2), (13, 4, 0), (31, 9, 0.1)])
def test_plink_round_trip(spark, tmp_path, n, m, missing):
    rng = np.random.default_rng(n)
    g = rng.integers(0, 3, (n, m))
    g[rng.random((n, m)) < missing] = -1
    prefix = f"{tmp_path}/geno.even"
    plink.write_trio(prefix, g, list(range(100, 100 + n)))
    plink.register(spark)
    got = np.full((n, m), -9)
    for r in spark.read.format("plink").option("chunk", 3).load(prefix).collect():
        got[r["sample_id"] - 100, r["variant_idx"]] = -1 if r["x"] is None else r["x"]
    assert (got == g).all()
    rows = sorted({0, n - 1}, reverse=True)
    part = spark.read.format("plink").option("from", 1).option("to", 3).option("rows", ",".join(map(str, rows))).load(prefix).collect()
    assert {(r["variant_idx"], r["sample_id"]) for r in part} == {(j, 100 + i) for j in (1, 2) for i in rows}
    assert [r["sample_id"] for r in plink.read_fam(spark, prefix).orderBy("row_idx").collect()] == list(range(100, 100 + n))
    assert plink.read_bim(spark, prefix).where("a1 = 'A' AND a2 = 'G' AND rsid = 'rs0'").count() == 1


def test_plink_errors(tmp_path):
    assert not plink.is_prefix(f"{tmp_path}/x")
    with pytest.raises(FileNotFoundError):
        plink.check(f"{tmp_path}/x")
    plink.write_trio(f"{tmp_path}/x", np.zeros((2, 2), int), [1, 2])
    with open(f"{tmp_path}/x.bed", "r+b") as f:
        f.write(b"\x00")
    with pytest.raises(ValueError):
        plink.check(f"{tmp_path}/x")


def test_ld_files(spark, tmp_path):
    for c in (1, 2):
        with gzip.open(f"{tmp_path}/ld{c}.l2.ldscore.gz", "wt") as f:
            f.write("CHR\tSNP\tBP\tbaseL2\tcodingL2\n" + "".join(f"{c}\trs{c}{k}\t{k}\t1.5\t0.5\n" for k in range(3)))
        with open(f"{tmp_path}/ld{c}.l2.M_5_50", "w") as f:
            f.write("5000 800\n")
    df, m = files.read_ldscores(spark, f"{tmp_path}/ld", [1, 2])
    assert df.count() == 6 and df.columns == ["SNP", "baseL2", "codingL2"] and m == [10000.0, 1600.0]
    with pytest.raises(ValueError):
        files.single_annotation(df)
    with gzip.open(f"{tmp_path}/s.tsv.gz", "wt") as f:
        f.write("SNP\tA1\tA2\tN\tZ\nrs1\tA\tG\t10\t\n")
    assert files.read_sumstats(spark, f"{tmp_path}/s.tsv.gz").first()["Z"] is None


def test_latent_dumps(spark, tmp_path):
    for name in ("Zm_train.00003", "Zm_val.00003", "Zm_train.00004"):
        (tmp_path / f"{name}.txt").write_text("0.5 1.5\n-1 2e-3\n")
    df = files.read_latents(spark, f"{tmp_path}/Zm_*.txt")
    assert {(r["epoch"], r["split"]) for r in df.collect()} == {(3, "train"), (3, "val")} and df.count() == 4
    files.write_latents(df, f"{tmp_path}/out")
    assert spark.read.parquet(f"{tmp_path}/out").where("epoch = 3 AND split = 'val'").count() == 2


@pytest.fixture
def genotypes(spark):
    rng = np.random.default_rng(2)
    return spark.createDataFrame([(i, j, float(rng.normal())) for i in range(20) for j in range(5)], "sample_id long, variant_idx int, xs double")


def traits(spark, seed, rows=range(20)):
    rng = np.random.default_rng(seed)
    return spark.createDataFrame([(i, d, float(rng.normal())) for i in rows for d in range(2)], "sample_id long, dim int, z double")


def near(a, b):
    a, b = ({(r["variant_idx"], r["dim"]): r["u"] for r in x.collect()} for x in (a, b))
    assert a.keys() == b.keys() and all(abs(a[k] - b[k]) < 1e-9 for k in a)


def test_updates_equal_a_rebuild(spark, genotypes):
    z = traits(spark, 0)
    u = incremental.rebuild(genotypes, z)
    for seed, rows in ((1, range(0, 8)), (2, range(5, 12)), (3, [3])):
        u, z = incremental.update(genotypes, u, z, traits(spark, seed, rows))
        near(u, incremental.rebuild(genotypes, z))
    with pytest.raises(Exception, match="twice"):
        twice = traits(spark, 4, [1])
        incremental.update(genotypes, u, z, twice.union(twice))[0].collect()


def test_stream_keeps_the_state(spark, genotypes, tmp_path):
    z = traits(spark, 0)
    incremental.rebuild(genotypes, z).write.parquet(f"{tmp_path}/state/v0/u")
    z.write.parquet(f"{tmp_path}/state/z/batch=-1")
    for k in (1, 2):
        traits(spark, k, range(k, k + 6)).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(z.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    query = incremental.maintain(stream, genotypes, f"{tmp_path}/state", f"{tmp_path}/cp")
    query.awaitTermination()
    last = incremental.latest(spark, f"{tmp_path}/state")
    near(spark.read.parquet(f"{tmp_path}/state/v2/u"), incremental.rebuild(genotypes, last))
    assert last.count() == 40 and last.agg(F.countDistinct("sample_id", "dim")).first()[0] == 40
    incremental.compact(spark, f"{tmp_path}/state", f"{tmp_path}/folded", 2)
    near(spark.read.parquet(f"{tmp_path}/folded/v0/u"), incremental.rebuild(genotypes, incremental.latest(spark, f"{tmp_path}/folded")))


def test_small_text_sources(spark, tmp_path):
    (tmp_path / "names.txt").write_text("PC1\n\n Age \n")
    (tmp_path / "w.txt").write_text("1.0\n0\n-2.5\n")
    assert files.read_lines(spark, f"{tmp_path}/names.txt") == ["PC1", "Age"]
    assert [(r["dim"], r["weight"]) for r in files.read_weights(spark, f"{tmp_path}/w.txt").collect()] == [(0, 1.0), (1, 0.0), (2, -2.5)]
    head = "rank\traw_h2\ttheoretical_h2\tempirical_h2\tempirical_h2_se\n"
    (tmp_path / "comparison.001.txt").write_text(head + "0\t0.1\t0.2\t0.3\t0.4\n")
    (tmp_path / "comparison.002.txt").write_text(head + "0\t0.5\t0.6\t0.7\t0.8\n1\t0\t0\t0\t0\n")
    got = files.read_comparison(spark, f"{tmp_path}/comparison.*.txt").orderBy("rank").collect()
    assert len(got) == 2 and tuple(got[0]) == (0, 0.5, 0.6, 0.7, 0.8)
    for e in (3, 12):
        (tmp_path / f"weights.{e:05d}.pt").write_bytes(b"x")
    assert files.latest_checkpoint(spark, str(tmp_path))[0] == 12
    parts = spark.createDataFrame([(1, "train"), (2, "val")], "sample_id long, part string")
    files.write_split_ids(parts, f"{tmp_path}/split")
    assert sorted(map(tuple, files.read_split_ids(spark, f"{tmp_path}/split").collect())) == [(1, "train"), (2, "val")]


def test_latents_without_a_pair_raise(spark, tmp_path):
    (tmp_path / "Zm_train.7.txt").write_text("1 2\n")
    with pytest.raises(ValueError):
        files.read_latents(spark, f"{tmp_path}/Zm_*.txt")
