"""Training objectives and their log lines, as aggregates over tables of estimates."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def weighted_loss(values: DataFrame, weights: DataFrame, value: str = "value", key: str = "dim", by: tuple[str, ...] = ()) -> DataFrame:
    """``by, loss``: minus the weighted sum of the values; keys without a weight, and null values, count 0."""
    joined = values.join(weights.select(key, "weight"), key)
    return joined.groupBy(*by).agg((-F.coalesce(F.sum(F.col("weight") * F.col(value)), F.lit(0.0))).alias("loss"))


def active(values: DataFrame, weights: DataFrame, key: str = "dim") -> DataFrame:
    """Rows of the keys whose weight is not 0."""
    return values.join(weights.where("weight <> 0").select(key), key, "left_semi")


def sample_mse(df: DataFrame, given: Column, rebuilt: Column, key: str = "sample_id") -> DataFrame:
    """``key, mse``: mean squared difference of two arrays of equal length; of an empty or unequal pair null."""
    squares = F.zip_with(given, rebuilt, lambda a, b: (a - b) * (a - b))
    total = F.aggregate(squares, F.lit(0.0), lambda s, x: s + x)
    return df.select(key, F.when((F.size(given) > 0) & (F.size(given) == F.size(rebuilt)), total / F.size(given)).alias("mse"))


def composite_loss(terms: DataFrame, mse_weight: float = 1.0, h_weight: float = 1.0) -> DataFrame:
    """``loss``: the mean of mse and kld terms by ``mse_weight``, plus heritability by ``h_weight``, plus the other terms as they are.

    ``terms`` has one row per sample: ``mse, kld, pen``, and the same ``her, corr, moment`` on all (they belong to the batch).
    """
    elbo = F.avg(F.col("mse") + F.col("kld"))
    return terms.agg((mse_weight * elbo + h_weight * F.max("her") + F.max("corr") + F.max("moment") + F.avg("pen")).alias("loss"))


def spectrum_loss(spectrum: DataFrame, weights: list[float], by: tuple[str, ...] = ()) -> DataFrame:
    """``by, loss``: minus the weighted sum of the largest eigenvalues, those below 0 as 0; ``spectrum`` has ``value``.

    The k-th largest takes the k-th weight; what is longer, values or weights, is cut.
    """
    rank = F.row_number().over(Window.partitionBy(*(by or [F.lit(0)])).orderBy(F.desc("value")))
    table = F.array(*[F.lit(float(w)) for w in weights]) if weights else F.array().cast("array<double>")
    ranked = spectrum.withColumn("w", F.get(table, rank - 1))
    return ranked.groupBy(*by).agg((-F.coalesce(F.sum(F.col("w") * F.greatest("value", F.lit(0.0))), F.lit(0.0))).alias("loss"))


def marginal_loss(matrices: DataFrame, weights: DataFrame) -> DataFrame:
    """``loss``: minus the weighted sum of each trait's own component, ``g / p`` on the diagonal of ``i, j, g, p``, at least 0."""
    own = matrices.where("i = j").select(F.col("i").alias("dim"), F.greatest(F.col("g") / F.col("p"), F.lit(0.0)).alias("value"))
    return weighted_loss(own, weights)


def summary(values: DataFrame, column: str, by: tuple[str, ...] = ()) -> DataFrame:
    """``by, n, mean, sd, sd_pop`` of a column without nulls and NaN; both deviations, as both are in use."""
    v = F.when(~F.isnan(column), F.col(column))
    return values.groupBy(*by).agg(F.count(v).alias("n"), F.avg(v).alias("mean"), F.stddev_samp(v).alias("sd"), F.stddev_pop(v).alias("sd_pop"))


def total(spectrum: DataFrame, first: int = 5, by: tuple[str, ...] = ()) -> DataFrame:
    """``by, total, top``: the sum of all eigenvalues and the array of the largest."""
    return spectrum.groupBy(*by).agg(F.sum("value").alias("total"), F.slice(F.sort_array(F.collect_list("value"), asc=False), 1, first).alias("top"))


def _numbers(values: Column, form: str) -> Column:
    return F.array_join(F.transform(values, lambda x: F.format_string(form, x)), ", ")


def spectrum_line(df: DataFrame, label: str) -> DataFrame:
    """``epoch, line`` from ``epoch, total, top``."""
    return df.select("epoch", F.concat(F.format_string(f"epoch %d - spectrum_{label} total: %.4f top: ", "epoch", "total"), _numbers(F.col("top"), "%.4f")).alias("line"))


def gencov_line(df: DataFrame) -> DataFrame:
    """``epoch, line`` from ``epoch, gencov_train, gencov_val`` (arrays): signed, with exponents."""
    return df.select("epoch", F.concat(F.format_string("epoch %d - gencov_train: ", "epoch"), _numbers(F.col("gencov_train"), "%+.4e"), F.lit(" - gencov_val: "), _numbers(F.col("gencov_val"), "%+.4e")).alias("line"))


def intercept_line(df: DataFrame) -> DataFrame:
    """``epoch, line`` from ``epoch, mean, sd`` of LDSC intercepts."""
    return df.select("epoch", F.format_string("epoch %d - ldsc intercept: %.4f +- %.4f", "epoch", "mean", "sd").alias("line"))


def split_lines(wide: DataFrame) -> DataFrame:
    """``epoch, line``: the form with even and odd chromosomes; arrays ``train_even, train_odd, val_even, val_odd``."""
    parts = [F.format_string("epoch %d - mse_train: %.4f - mse_val: %.4f", "epoch", "mse_train", "mse_val")]
    for s in ("train_even", "train_odd", "val_even", "val_odd"):
        parts += [F.lit(f" - h_{s}: "), _numbers(F.col(s), "%.3f")]
    return wide.select("epoch", F.concat(*parts).alias("line"))


def write_spectrum(spectrum: DataFrame, path: str) -> None:
    """Eigenvalues as Parquet, by label and epoch."""
    spectrum.write.mode("overwrite").partitionBy("label", "epoch").parquet(path)


def trace_of_ratio(g: np.ndarray, p: np.ndarray, ridge: float = 1e-4) -> float:
    """tr((P + ridge I)^-1 G): the sum of the spectrum without its eigenvalues."""
    return float(np.trace(np.linalg.solve(p + ridge * np.eye(len(p)), g)))
