"""Readouts of the maintained state for every micro-batch: heritability, spectrum, objectives and correlations with a trait.

The state and what is read from it are tables by version in a folder that all nodes share. Version 0 is the start, batch b makes
version b + 1 from version b and its own rows, so a batch that is run again after a failure writes the same tables
again. Rows carry an order ``at``: of a sample's values for a dimension the greatest order counts, so late rows and rows that
are delivered twice change nothing.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import heritability, ldsc, objectives
from ..operators.blocks import Panel
from . import incremental


@dataclass(frozen=True)
class External:
    """An outside trait for genetic correlations: ``rows`` as ``ldsc.context`` gives, its number of SNPs, fixed intercepts."""

    rows: DataFrame
    m: float
    intercepts: tuple = (None, None, None)


@dataclass(frozen=True)
class Readouts:
    """What is read: always heritability and the spectrum; correlations where there is an outside trait.

    ``weights`` (``dim, weight``) make the marginal objective and say which dimensions are correlated; ``ranks`` weigh the spectrum.
    """

    ridge: float = 1e-4
    first: int | None = None
    ranks: tuple[float, ...] = (1.0,)
    weights: DataFrame | None = None
    external: External | None = None


KINDS = ("h2", "spectrum", "objective", "rg")


def of_state(state: DataFrame, w: DataFrame, traits: DataFrame, fixed: incremental.Fixed, what: Readouts) -> dict[str, DataFrame]:
    """``h2``: dim, h2. ``spectrum``: rank, value. ``objective``: spectrum, marginal, total. ``rg``: as ``ldsc.latent_correlation``."""
    spark = traits.sparkSession
    g, p = incremental.matrices_of_state(state, w, traits, fixed)
    values, _ = heritability.spectrum(g, p, what.ridge, what.first)
    rows = spark.createDataFrame([(k, float(v)) for k, v in enumerate(values)], "rank int, value double")
    # Positions in the matrices are the dimensions in order.
    dims = sorted(r["dim"] for r in traits.select("dim").distinct().collect())
    diagonal = spark.createDataFrame([(d, d, float(g[k, k]), float(p[k, k])) for k, d in enumerate(dims)], "i int, j int, g double, p double")
    weights = spark.createDataFrame([(d, 1.0) for d in dims], "dim int, weight double") if what.weights is None else what.weights
    objective = objectives.spectrum_loss(rows, list(what.ranks)).select(F.col("loss").alias("spectrum"))
    objective = objective.crossJoin(objectives.marginal_loss(diagonal, weights).select(F.col("loss").alias("marginal"))).crossJoin(rows.agg(F.sum("value").alias("total")))
    out = {"h2": incremental.h2_of_state(state, w, traits, fixed), "spectrum": rows, "objective": objective}
    if what.external is not None:
        stats = incremental.sumstats_of_state(state, w, traits, fixed)
        out["rg"] = ldsc.latent_correlation(stats, what.external.rows, fixed.n, what.external.m, what.weights, what.external.intercepts)
    return out


def _write(folder: str, version: int, state: DataFrame, w: DataFrame, traits: DataFrame, fixed: incremental.Fixed, what: Readouts) -> None:
    for kind, df in of_state(state, w, traits, fixed, what).items():
        df.write.mode("overwrite").parquet(f"{folder}/readouts/{kind}/version={version}")


def start(xs: DataFrame | Panel, covariates: DataFrame, traits: DataFrame, fixed: incremental.Fixed, folder: str, what: Readouts = Readouts()) -> None:
    """Write version 0 from ``sample_id, dim, z`` and its readouts; their order is below any other."""
    spark = traits.sparkSession
    traits.select("sample_id", "dim", "z", F.lit(-(1 << 62)).cast("long").alias("at")).write.parquet(f"{folder}/z/batch=-1")
    first = latest(spark, folder, 0)
    incremental.rebuild(xs, first).write.parquet(f"{folder}/u/version=0")
    incremental.rebuild_covariates(covariates, first).write.parquet(f"{folder}/w/version=0")
    _write(folder, 0, *_version(spark, folder, 0), fixed, what)


def latest(spark: SparkSession, folder: str, before: int | None = None) -> DataFrame:
    """``sample_id, dim, z, at`` as of the batches before the given one, or of all."""
    rows = spark.read.parquet(f"{folder}/z")
    if before is not None:
        rows = rows.where(F.col("batch") < before)
    return rows.groupBy("sample_id", "dim").agg(F.max_by("z", "at").alias("z"), F.max("at").alias("at"))


def _version(spark: SparkSession, folder: str, version: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    return spark.read.parquet(f"{folder}/u/version={version}"), spark.read.parquet(f"{folder}/w/version={version}"), latest(spark, folder, version)


def step(batch: DataFrame, batch_id: int, xs: DataFrame | Panel, covariates: DataFrame, fixed: incremental.Fixed, folder: str, what: Readouts) -> None:
    """Version ``batch_id + 1`` and its readouts from version ``batch_id`` and the batch's rows (``sample_id, dim, z, at``)."""
    spark = batch.sparkSession
    u, w, before = _version(spark, folder, batch_id)
    newest = batch.groupBy("sample_id", "dim").agg(F.max_by("z", "at").alias("z"), F.max("at").alias("at"))
    known = before.select("sample_id", "dim", F.col("at").alias("_at"))
    fresh = newest.join(known, ["sample_id", "dim"], "left").where(F.col("_at").isNull() | (F.col("at") > F.col("_at"))).drop("_at")
    # The rows that count are written first; all else reads them from there, so the batch's source is read once.
    fresh.write.mode("overwrite").parquet(f"{folder}/z/batch={batch_id}")
    rows, old = spark.read.schema(fresh.schema).parquet(f"{folder}/z/batch={batch_id}"), before.select("sample_id", "dim", "z")
    delta = incremental.changes(old, rows.select("sample_id", "dim", "z"))
    new = u.unionByName(incremental.rebuild(xs, delta)).groupBy("variant_idx", "dim").agg(F.sum("u").alias("u"))
    new.write.mode("overwrite").parquet(f"{folder}/u/version={batch_id + 1}")
    sums = w.unionByName(incremental.rebuild_covariates(covariates, delta)).groupBy("k", "dim").agg(F.sum("w").alias("w"))
    sums.write.mode("overwrite").parquet(f"{folder}/w/version={batch_id + 1}")
    _write(folder, batch_id + 1, *_version(spark, folder, batch_id + 1), fixed, what)


def maintain(stream: DataFrame, xs: DataFrame | Panel, covariates: DataFrame, fixed: incremental.Fixed, folder: str, checkpoint: str, what: Readouts = Readouts()):
    """Run ``step`` on every micro-batch of a stream; ``read`` gives what each version read."""
    run = lambda batch, batch_id: step(batch, batch_id, xs, covariates, fixed, folder, what)
    return stream.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def read(spark: SparkSession, folder: str, kind: str) -> DataFrame:
    """The readouts of one of ``KINDS`` with their ``version``."""
    if kind not in KINDS:
        raise ValueError(f"no readout {kind}: {', '.join(KINDS)}")
    return spark.read.option("basePath", f"{folder}/readouts/{kind}").parquet(f"{folder}/readouts/{kind}/version=*")


def rebuilt(spark: SparkSession, xs: DataFrame | Panel, covariates: DataFrame, fixed: incremental.Fixed, folder: str, what: Readouts = Readouts()) -> dict[str, DataFrame]:
    """The readouts of all rows so far from scratch, without the maintained sums."""
    traits = latest(spark, folder)
    return of_state(incremental.rebuild(xs, traits), incremental.rebuild_covariates(covariates, traits), traits, fixed, what)

