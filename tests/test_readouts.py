import numpy as np
import pytest
from pyspark.sql import functions as F

from helixframe.operators import blocks, factored
from helixframe.sources.staging import staged
from helixframe.streaming import epoch_lag, incremental, readouts

N, M, D = 30, 9, 3


@pytest.fixture(scope="module")
def run(spark, tmp_path_factory):
    """A cohort, a start, and four micro-batches with late and repeated rows."""
    rng = np.random.default_rng(3)
    top = tmp_path_factory.mktemp("state")
    x = rng.integers(0, 3, (N, M))
    dosage = spark.createDataFrame([(i, j, int(x[i, j])) for i in range(N) for j in range(M)], "sample_id long, variant_idx int, x int")
    panel = blocks.panel(dosage, M, tile=4, rows=8)
    traits = spark.createDataFrame([(i, d, float(rng.normal())) for i in range(N) for d in range(D)], "sample_id long, dim int, z double")
    design = panel.samples.select("sample_id", F.lit(1.0).alias("_one"))
    p = factored.Projection(staged(design), ["_one"], [])
    tiles = staged(factored.residual_tiles(panel, p))
    fixed = incremental.Fixed(staged(factored.covariate_rows(panel, tiles, 1)), p.inverse, p.n, M, *factored.traces(panel, tiles, p))
    ones = panel.samples.select("sample_id", F.lit(0).alias("k"), F.lit(1.0).alias("c"))
    outside = spark.createDataFrame([(j, float(rng.normal()), 900.0, 1 + j / 4, 1.5) for j in range(M)], "variant_idx int, z double, n double, ld double, w_ld double")
    what = readouts.Readouts(first=2, ranks=(2.0, 1.0), external=readouts.External(outside, 500.0, (1.0, 1.0, 0.0)))
    folder = f"{top}/s"
    readouts.start(panel, ones, traits, fixed, folder, what)
    schema = "sample_id long, dim int, z double, at long"
    batches = [[(i, d, float(rng.normal()), 10 * b + i) for i in rng.choice(N, 6, replace=False).tolist() for d in range(D)] for b in range(1, 4)]
    batches[1] += [(*batches[0][0][:2], 99.0, 0), batches[1][0]]  # late, and twice in a batch
    batches.append(batches[2])  # delivered again
    for b in batches:
        spark.createDataFrame(b, schema).coalesce(1).write.mode("append").parquet(f"{top}/in")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{top}/in")
    readouts.maintain(stream, panel, ones, fixed, folder, f"{top}/cp", what).awaitTermination()
    return panel, ones, fixed, folder, what, batches, traits


def numbers(df, version=None):
    df = df if version is None else df.where(F.col("version") == version).drop("version")
    return sorted(tuple(round(v, 7) if isinstance(v, float) else v for v in r) for r in df.select(*sorted(df.columns)).collect())


def test_every_version_equals_a_rebuild_at_the_end(spark, run):
    panel, ones, fixed, folder, what, *_ = run
    scratch = readouts.rebuilt(spark, panel, ones, fixed, folder, what)
    assert set(scratch) == set(readouts.KINDS)
    for kind, df in scratch.items():
        assert numbers(readouts.read(spark, folder, kind), 4) == numbers(df), kind
        assert {r["version"] for r in readouts.read(spark, folder, kind).select("version").distinct().collect()} == set(range(5))
    assert readouts.read(spark, folder, "spectrum").where("version = 4").count() == 2
    with pytest.raises(ValueError):
        readouts.read(spark, folder, "p")


def test_late_and_repeated_rows_change_nothing(spark, run):
    *_, folder, _, batches, traits = run
    want = {(r["sample_id"], r["dim"]): r["z"] for r in traits.collect()}
    for row in sorted((r for b in batches for r in b), key=lambda r: r[3]):
        if row[3]:
            want[row[:2]] = row[2]
    assert {(r["sample_id"], r["dim"]): r["z"] for r in readouts.latest(spark, folder).collect()} == want
    # The batch that was delivered again made a version like the one before.
    for kind in readouts.KINDS:
        assert numbers(readouts.read(spark, folder, kind), 4) == numbers(readouts.read(spark, folder, kind), 3)


def test_a_batch_run_again_writes_the_same(spark, run):
    panel, ones, fixed, folder, what, batches, _ = run
    before = {k: numbers(readouts.read(spark, folder, k)) for k in readouts.KINDS}
    readouts.step(spark.createDataFrame(batches[1], "sample_id long, dim int, z double, at long"), int(next(b for b in range(4) if spark.read.parquet(f"{folder}/z").where(F.col("batch") == b).where(F.col("at") == batches[1][1][3]).count())), panel, ones, fixed, folder, what)
    assert {k: numbers(readouts.read(spark, folder, k)) for k in readouts.KINDS} == before


ROWS = [("a", 1, 0.1, False), ("a", 2, 0.2, False), ("b", 7, 7.0, False), ("a", 4, 0.4, False), ("a", 3, 0.3, False), ("a", 2, 9.9, False), ("b", 9, 9.0, False), ("a", 5, 5.0, True), ("b", 10, 10.0, True), ("c", 1, 1.0, False), (None, 1, 1.0, False)]


@pytest.mark.parametrize("cuts", [(11,), (1, 4, 6, 8, 11)])
def test_one_epoch_later(spark, tmp_path, monkeypatch, cuts):
    schema = "run string, epoch int, x double, closing boolean"
    want = {("a", 1, 0.1, 0.2), ("a", 2, 0.2, 0.3), ("a", 3, 0.3, 0.4), ("a", 4, 0.4, 5.0), ("b", 7, 7.0, 9.0), ("b", 9, 9.0, 10.0)}
    flat = lambda df: sorted((r["run"], r["epoch"], r["own"]["x"], r["next"]["x"]) for r in df.collect())
    assert flat(epoch_lag.lagged(spark.createDataFrame(ROWS, schema))) == sorted(want)
    provider = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", epoch_lag.PROVIDER)
    try:
        for k, (lo, hi) in enumerate(zip((0, *cuts), cuts)):
            spark.createDataFrame(ROWS[lo:hi], schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
            # One run of the stream each, from its checkpoint.
            stream = epoch_lag.lagged_stream(spark.readStream.schema(schema).parquet(f"{tmp_path}/in"))
            stream.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start().awaitTermination()
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", provider)
    got = flat(spark.read.parquet(f"{tmp_path}/out"))
    assert got == sorted(want)
