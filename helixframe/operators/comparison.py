"""Comparing two runs: values of each dimension at the peak epoch, masked, and the rank-sum test."""

from __future__ import annotations

from statistics import NormalDist

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import assembly, logs


def threshold_mask(values: DataFrame, against: DataFrame, least: float) -> DataFrame:
    """``values`` (``epoch, dim, value``) whose dimension reaches ``least`` in the nearest epoch of ``against``."""
    near = assembly.nearest(values.select("epoch", "dim", "value"), against.select("epoch", "dim", F.col("value").alias("mask")), "epoch", ["dim"])
    return near.where(F.col("nearest_mask") >= least).select("epoch", "dim", "value")


def peak_epoch(values: DataFrame) -> int | None:
    """The epoch of the largest mean over dimensions, the earliest of equals; NaN is left out."""
    top = logs.epoch_stats(values).where("mean IS NOT NULL").orderBy(F.desc("mean"), "epoch").select("epoch").first()
    return top["epoch"] if top else None


def two_runs(control: DataFrame, experiment: DataFrame, mask: DataFrame | None = None, least: float = 0.0) -> DataFrame:
    """``run, epoch, dim, value`` of both runs: the experiment at its peak epoch, the control at its epoch nearest to that.

    All tables have ``epoch, dim, value``. With ``mask`` only dimensions that reach ``least`` there, in the nearest epoch,
    stay. Of two equally near epochs the lower counts. Runs without values give no rows.
    """
    at = peak_epoch(experiment)
    spark = control.sparkSession
    if at is None:
        return spark.createDataFrame([], "run string, epoch int, dim int, value double")
    near = control.select("epoch").distinct().orderBy(F.abs(F.col("epoch") - at), "epoch").first()
    parts = []
    for name, df, epoch in (("control", control, near["epoch"] if near else None), ("experiment", experiment, at)):
        part = df.where(F.col("epoch") == F.lit(epoch)).where(~F.isnan("value"))
        parts.append((threshold_mask(part, mask, least) if mask is not None else part.select("epoch", "dim", "value")).withColumn("run", F.lit(name)))
    return parts[0].unionByName(parts[1]).select("run", "epoch", "dim", "value")


def rank_sum_p(df: DataFrame, value: str, treated: str) -> DataFrame:
    """``z, n1, n2, p`` of the one-sided rank-sum test; p is null where a side is empty."""
    row = logs.rank_sum(df, value, treated).first()
    p = None if row["z"] is None else 1 - NormalDist().cdf(row["z"])
    return df.sparkSession.createDataFrame([(row["z"], row["n1"], row["n2"], p)], "z double, n1 long, n2 long, p double")


def same_splits(runs: list[DataFrame], key: str = "sample_id") -> bool:
    """Whether all runs have the same ids in the same parts."""
    first = runs[0].select(key, "part")
    return all(first.exceptAll(r.select(key, "part")).isEmpty() and r.select(key, "part").exceptAll(first).isEmpty() for r in runs[1:])
