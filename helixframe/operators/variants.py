"""Per-variant statistics and standardised dosages."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Smallest standard deviation of a variant.
FLOOR = 1e-8


def variant_stats(dosage: DataFrame) -> DataFrame:
    """``variant_idx, n_obs, sum_x, sum_x2, mean, sd``: population sd over called dosages, at least FLOOR.

    Sums of small integers are exact, so the one-pass form loses nothing. A variant without calls has mean 0.
    """
    sums = dosage.groupBy("variant_idx").agg(
        F.count("x").alias("n_obs"), F.coalesce(F.sum("x"), F.lit(0)).alias("sum_x"), F.coalesce(F.sum(F.col("x") * F.col("x")), F.lit(0)).alias("sum_x2")
    )
    n = F.greatest("n_obs", F.lit(1))
    mean = F.col("sum_x") / n
    var = F.col("sum_x2") / n - mean * mean
    return sums.withColumns({"mean": mean, "sd": F.greatest(F.sqrt(F.greatest(var, F.lit(0.0))), F.lit(FLOOR))})


def standardized(dosage: DataFrame, stats: DataFrame | None = None) -> DataFrame:
    """``sample_id, variant_idx, xs``; a missing dosage is the variant's mean, so 0."""
    stats = variant_stats(dosage) if stats is None else stats
    joined = dosage.join(stats.select("variant_idx", "mean", "sd"), "variant_idx")
    return joined.select("sample_id", "variant_idx", F.coalesce((F.col("x") - F.col("mean")) / F.col("sd"), F.lit(0.0)).alias("xs"))


def naive_trace(stats: DataFrame) -> DataFrame:
    """``tr_k``: calls per variant. Counts a variant without variance as if it had one."""
    return stats.agg((F.sum("n_obs") / F.count("*")).alias("tr_k"))
