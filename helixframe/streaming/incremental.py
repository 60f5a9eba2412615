"""Maintaining X'Z under batched changes of the trait table."""

from __future__ import annotations

from dataclasses import dataclass, replace

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.blocks import Panel, column_gram, product, sample_matrix
from ..operators.factored import dot, value_rows


def long_traits(wide: DataFrame, columns: list[str]) -> DataFrame:
    """``sample_id, dim, z`` from one column per trait."""
    values = F.posexplode(F.array(*[F.col(c) for c in columns])).alias("dim", "z")
    return wide.select("sample_id", values)


def by_dim(traits: DataFrame, dims: list[int], keys: list[str]) -> DataFrame:
    """``keys, v``: values ``z`` of long rows as one array over ``dims``; 0 where there is none."""
    at = {d: k for k, d in enumerate(dims)}
    place = F.create_map(*[F.lit(x) for pair in at.items() for x in pair])[F.col("dim")]
    listed = traits.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct(place.alias("k"), "z"))).alias("v"))
    return listed.select(*keys, F.transform(F.sequence(F.lit(0), F.lit(len(dims) - 1)), lambda k: F.coalesce(F.try_element_at("v", k), F.lit(0.0))).alias("v"))


def rebuild(xs: DataFrame | Panel, traits: DataFrame) -> DataFrame:
    """``variant_idx, dim, u``: X'Z from scratch, traits in long form.

    Genotypes are a panel, of which only the sample groups that ``traits`` names are read, or standardised dosages in long form.
    """
    if not isinstance(xs, Panel):
        return xs.join(traits, "sample_id").groupBy("variant_idx", "dim").agg(F.sum(F.col("xs") * F.col("z")).alias("u"))
    # As many numbers as traits.
    dims = sorted(r["dim"] for r in traits.select("dim").distinct().collect())
    if not dims:
        return xs.blocks.sparkSession.createDataFrame([], "variant_idx int, dim int, u double")
    matrix = sample_matrix(xs, by_dim(traits, dims, ["sample_id"]), "v")
    named = xs.samples.join(traits.select("sample_id").distinct(), "sample_id", "left_semi").select("rows").distinct()
    some = replace(xs, blocks=xs.blocks.join(named, "rows", "left_semi"))
    return value_rows(product(some, matrix, True), xs.tile, dims)


def changes(traits: DataFrame, batch: DataFrame) -> DataFrame:
    """``sample_id, dim, z``: new less old value of each row of the batch; unknown rows count from 0.

    A batch may name a sample and dimension once; more raises when the result is read.
    """
    once = batch.groupBy("sample_id", "dim").agg(F.count("*").alias("_k"), F.first("z").alias("new"))
    checked = F.when(F.col("_k") == 1, F.col("new")).otherwise(F.raise_error(F.lit("a batch names one sample and dimension twice")).cast("double"))
    old = traits.select("sample_id", "dim", F.col("z").alias("old"))
    return once.select("sample_id", "dim", checked.alias("new")).join(old, ["sample_id", "dim"], "left").select("sample_id", "dim", (F.col("new") - F.coalesce("old", F.lit(0.0))).alias("z"))


def update(xs: DataFrame, state: DataFrame, traits: DataFrame, batch: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The state and traits after a batch: only changed samples' genotypes are read, the state is added up."""
    delta = rebuild(xs, changes(traits, batch))
    new_state = state.unionByName(delta).groupBy("variant_idx", "dim").agg(F.sum("u").alias("u"))
    kept = traits.join(batch.select("sample_id", "dim"), ["sample_id", "dim"], "left_anti")
    return new_state, kept.unionByName(batch.select("sample_id", "dim", "z"))


def rebuild_covariates(covariates: DataFrame, traits: DataFrame) -> DataFrame:
    """``k, dim, w``: W'Z from scratch; covariates in long form ``sample_id, k, c`` (k = 0 may be the intercept)."""
    return covariates.join(traits, "sample_id").groupBy("k", "dim").agg(F.sum(F.col("c") * F.col("z")).alias("w"))


def update_covariates(covariates: DataFrame, state: DataFrame, traits: DataFrame, batch: DataFrame) -> DataFrame:
    """W'Z after a batch, from the traits before it: only changed samples' covariates are read."""
    delta = rebuild_covariates(covariates, changes(traits, batch))
    return state.unionByName(delta).groupBy("k", "dim").agg(F.sum("w").alias("w"))


@dataclass(frozen=True)
class Fixed:
    """What does not change with the traits: ``by`` is ``variant_idx, s`` and X'W as ``t_0, t_1, ...`` of ``by_variant``."""

    by: DataFrame
    inverse: np.ndarray
    n: int
    m: int
    trace1: float
    trace2: float


def _projected(state: DataFrame, w: DataFrame, traits: DataFrame, fixed: Fixed) -> tuple[DataFrame, DataFrame]:
    """``variant_idx, d, dim, u`` with u = x'Vz, and ``dim, q`` with q = z'Vz, both from the state."""
    c = range(len(fixed.inverse))
    quad = F.lit(0.0)
    for i in c:
        quad = quad + F.col(f"t_{i}") * dot([f"t_{j}" for j in c], fixed.inverse[i])
    by = fixed.by.select("variant_idx", (F.col("s") - quad).alias("d"), *[f"t_{i}" for i in c])
    # As many rows as traits: W'Z of each, and with it the coefficients.
    wide = traits.groupBy("dim").agg(F.sum(F.col("z") * F.col("z")).alias("zz"))
    if len(fixed.inverse):
        per = w.groupBy("dim").agg(*[F.sum(F.when(F.col("k") == i, F.col("w"))).alias(f"w_{i}") for i in c])
        wide = wide.join(per, "dim")
    names = [f"w_{i}" for i in c]
    wide = wide.select("dim", "zz", *names, *[dot(names, fixed.inverse[i]).alias(f"b_{i}") for i in c])
    fit, own = F.lit(0.0), F.lit(0.0)
    for i in c:
        fit, own = fit + F.col(f"t_{i}") * F.col(f"b_{i}"), own + F.col(f"w_{i}") * F.col(f"b_{i}")
    u = state.join(by, "variant_idx").join(wide, "dim").select("variant_idx", "d", "dim", (F.col("u") - fit).alias("u"))
    return u, wide.select("dim", (F.col("zz") - own).alias("q"))


def h2_of_state(state: DataFrame, w: DataFrame, traits: DataFrame, fixed: Fixed) -> DataFrame:
    """``dim, h2`` by the method of moments from X'Z and W'Z, as ``heritability.mom`` gives from all genotypes."""
    u, q = _projected(state, w, traits, fixed)
    both = u.groupBy("dim").agg((F.sum(F.col("u") * F.col("u")) / fixed.m).alias("qk")).join(q, "dim")
    qk, q, t1, t2 = F.col("qk"), F.col("q"), float(fixed.trace1), float(fixed.trace2)
    if not len(fixed.inverse):
        return both.select("dim", ((qk - q) / (t2 - fixed.n)).alias("h2"))
    v0, v1 = qk * (fixed.n - len(fixed.inverse)) - q * t1, q * t2 - qk * t1
    whole = v0 + v1
    return both.select("dim", (v0 / (whole + F.when(whole >= 0, 1e-8).otherwise(-1e-8))).alias("h2"))


def sumstats_of_state(state: DataFrame, w: DataFrame, traits: DataFrame, fixed: Fixed) -> DataFrame:
    """``variant_idx, dim, beta, se, z, chisq`` from X'Z and W'Z, as ``heritability.association`` gives from all genotypes."""
    u, q = _projected(state, w, traits, fixed)
    s2 = F.greatest(F.col("q") / max(fixed.n - len(fixed.inverse) - 1, 1), F.lit(1e-12))
    rows = u.join(q, "dim").select("variant_idx", "dim", "u", F.greatest("d", F.lit(1e-12)).alias("d"), s2.alias("s2"))
    beta, se = F.col("u") / F.col("d"), F.sqrt(F.col("s2") / F.col("d"))
    return rows.select("variant_idx", "dim", beta.alias("beta"), se.alias("se"), (beta / se).alias("z"), (beta / se * beta / se).alias("chisq"))


def matrices_of_state(state: DataFrame, w: DataFrame, traits: DataFrame, fixed: Fixed) -> tuple[np.ndarray, np.ndarray]:
    """G and P over the dimensions in order, as ``heritability.genetic_matrices`` gives; dimensions squared numbers reach the driver."""
    u, _ = _projected(state, w, traits, fixed)
    # As many numbers as traits.
    dims = sorted(r["dim"] for r in traits.select("dim").distinct().collect())
    at = {d: k for k, d in enumerate(dims)}
    q = column_gram(by_dim(u.withColumnRenamed("u", "z"), dims, ["variant_idx"]), "v", len(dims)) / fixed.m
    p = column_gram(by_dim(traits, dims, ["sample_id"]), "v", len(dims))
    c = len(fixed.inverse)
    if c:
        wz = np.zeros((c, len(at)))
        for r in w.collect():
            wz[r["k"], at[r["dim"]]] = r["w"]
        p = p - wz.T @ fixed.inverse @ wz
    solve = np.linalg.inv(np.array([[fixed.trace2, fixed.trace1], [fixed.trace1, fixed.n - c]]))
    d = np.sqrt(np.maximum(np.diag(p), 1e-12))
    return solve[0, 0] * q + solve[0, 1] * p, p / np.outer(d, d)


def maintain(stream: DataFrame, xs: DataFrame, state_dir: str, checkpoint: str):
    """Run ``update`` on every micro-batch of ``sample_id, dim, z``; X'Z is written by version, traits as what changed.

    ``state_dir`` holds version 0 of X'Z (``v0/u``) and the first traits (``z/batch=-1``). Batch b writes ``v<b + 1>/u`` from
    version b and its own rows as ``z/batch=<b>``; of a trait's rows the last batch counts, so a repeated batch writes the
    same again. ``compact`` folds the rows together.
    """
    spark = stream.sparkSession

    def step(batch: DataFrame, batch_id: int) -> None:
        batch = batch.persist()
        try:
            before = latest(spark, state_dir, batch_id)
            delta = rebuild(xs, changes(before, batch))
            state = spark.read.parquet(f"{state_dir}/v{batch_id}/u")
            state.unionByName(delta).groupBy("variant_idx", "dim").agg(F.sum("u").alias("u")).write.mode("overwrite").parquet(f"{state_dir}/v{batch_id + 1}/u")
            batch.select("sample_id", "dim", "z").write.mode("overwrite").parquet(f"{state_dir}/z/batch={batch_id}")
        finally:
            batch.unpersist()

    return stream.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def latest(spark, state_dir: str, before: int | None = None) -> DataFrame:
    """``sample_id, dim, z`` as of the batches before the given one, or of all."""
    rows = spark.read.parquet(f"{state_dir}/z")
    if before is not None:
        rows = rows.where(F.col("batch") < before)
    return rows.groupBy("sample_id", "dim").agg(F.max_by("z", "batch").alias("z"))


def compact(spark, state_dir: str, to: str, version: int) -> None:
    """Write the state after ``version`` batches as a new version 0 under another folder."""
    spark.read.parquet(f"{state_dir}/v{version}/u").write.parquet(f"{to}/v0/u")
    latest(spark, state_dir, version).write.parquet(f"{to}/z/batch=-1")
