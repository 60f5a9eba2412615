"""LD Score regression by iteratively reweighted least squares, one group of rows per regression.

Every pass is one grouped aggregate over the SNP table; a group's solution is a row that the next pass joins. Many
regressions (traits, dimensions, epochs) run at once as groups.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.staging import staged


def hsq_weights(ld: Column, w_ld: Column, n: Column, m: Column, h2: Column, intercept: Column) -> Column:
    h2 = F.greatest(F.least(h2, F.lit(1.0)), F.lit(0.0))
    ld, w_ld = F.greatest(ld, F.lit(1.0)), F.greatest(w_ld, F.lit(1.0))
    both = intercept + h2 * n * ld / m
    return 1 / (2 * both * both) / w_ld


def gencov_weights(ld: Column, w_ld: Column, n1: Column, n2: Column, m: Column, h1: Column, h2: Column, rho: Column, i1: Column, i2: Column, i12: Column) -> Column:
    h1, h2 = (F.greatest(F.least(h, F.lit(1.0)), F.lit(0.0)) for h in (h1, h2))
    rho = F.greatest(F.least(rho, F.lit(1.0)), F.lit(-1.0))
    ld, w_ld = F.greatest(ld, F.lit(1.0)), F.greatest(w_ld, F.lit(1.0))
    cross = F.sqrt(n1 * n2) * rho * ld / m + i12
    return 1 / ((n1 * h1 * ld / m + i1) * (n2 * h2 * ld / m + i2) + cross * cross) / w_ld


def _fit(df: DataFrame, group: list[str], weight: Column, fixed: float | None) -> DataFrame:
    """Weighted least squares of ``y`` on ``x`` (ld * N / Nbar), with an intercept unless it is fixed."""
    w, x, y = weight, F.col("x"), F.col("y")
    s = df.groupBy(*group).agg(
        F.sum(w).alias("sw"), F.sum(w * x).alias("sx"), F.sum(w * x * x).alias("sxx"), F.sum(w * y).alias("sy"), F.sum(w * x * y).alias("sxy"),
        F.first("nbar").alias("nbar"), F.first("m").alias("m"),
    )
    if fixed is None:
        det = F.col("sw") * F.col("sxx") - F.col("sx") * F.col("sx")
        slope = F.when(det != 0, (F.col("sw") * F.col("sxy") - F.col("sx") * F.col("sy")) / F.when(det != 0, det))
        intercept = (F.col("sy") - slope * F.col("sx")) / F.col("sw")
    else:
        slope = (F.col("sxy") - fixed * F.col("sx")) / F.when(F.col("sxx") != 0, F.col("sxx"))
        intercept = F.lit(float(fixed))
    return s.select(*group, (F.col("m") * slope / F.col("nbar")).alias("tot"), intercept.alias("intercept"))


def _regress(df: DataFrame, group: list[str], null: float, fixed: float | None, weights) -> DataFrame:
    """Start from the moment estimate, reweight twice, solve once more."""
    start = df.groupBy(*group).agg(
        F.avg(F.col("n").cast("double")).alias("nbar"), (F.first("m") * (F.avg("y") - (null if fixed is None else fixed)) / F.avg(F.col("ld") * F.col("n"))).alias("tot"),
    ).withColumn("intercept", F.lit(float(null if fixed is None else fixed)))
    # Estimates are one row per group: written, their size is known, and a pass reads the rows without a shuffle.
    est = staged(start)
    for _ in range(3):
        rows = df.join(est.select(*group, "nbar", "tot", "intercept"), group).withColumn("x", F.col("ld") * F.col("n") / F.col("nbar"))
        fit = _fit(rows, group, weights(F.col("tot"), F.col("intercept")), fixed)
        est = staged(fit.join(est.select(*group, "nbar"), group))
    return est.drop("nbar")


def hsq(df: DataFrame, group: list[str], intercept: float | None = None) -> DataFrame:
    """``group, tot, intercept``: SNP heritability from ``chisq, ld, w_ld, n`` and the constant ``m`` per group.

    A null chisq drops its SNP. A group of one SNP has no slope and gets a null.
    """
    rows = staged(df.where(F.col("chisq").isNotNull()).select(*group, "ld", "w_ld", "n", "m", F.col("chisq").alias("y")))
    return _regress(rows, group, 1.0, intercept, lambda h, i: hsq_weights(F.col("ld"), F.col("w_ld"), F.col("n"), F.col("m"), h, i))


def gencov(df: DataFrame, group: list[str], h1: DataFrame, h2: DataFrame, intercept: float | None = None) -> DataFrame:
    """``group, tot, intercept``: genetic covariance from ``z1, z2, n1, n2, ld, w_ld, m`` and both heritabilities."""
    rows = df.withColumns({"y": F.col("z1") * F.col("z2"), "n": F.sqrt(F.col("n1") * F.col("n2"))})
    rows = rows.join(h1.select(*group, F.col("tot").alias("h1"), F.col("intercept").alias("i1")), group)
    rows = rows.join(h2.select(*group, F.col("tot").alias("h2"), F.col("intercept").alias("i2")), group)
    rows = staged(rows.select(*group, "ld", "w_ld", "n", "n1", "n2", "m", "y", "h1", "i1", "h2", "i2"))
    c = F.col
    return _regress(rows, group, 0.0, intercept, lambda r, i: gencov_weights(c("ld"), c("w_ld"), c("n1"), c("n2"), c("m"), c("h1"), c("h2"), r, c("i1"), c("i2"), i))


def genetic_correlation(df: DataFrame, group: list[str], intercepts: tuple = (None, None, None)) -> DataFrame:
    """``group, h1, h2, gencov, rg``: rg is null, and the group counted as skipped, where a heritability is not positive.

    The rows are written once; where both heritabilities have the same kind of intercept they are fitted in one run.
    """
    df = staged(df.select(*group, "z1", "z2", "n1", "n2", "ld", "w_ld", "m"))
    sides = [df.select(*group, "ld", "w_ld", "m", (F.col(f"z{k}") * F.col(f"z{k}")).alias("chisq"), F.col(f"n{k}").alias("n"), F.lit(k).alias("_side")) for k in (1, 2)]
    if intercepts[0] == intercepts[1]:
        both = hsq(sides[0].union(sides[1]), [*group, "_side"], intercepts[0])
        one, two = both.where("_side = 1").drop("_side"), both.where("_side = 2").drop("_side")
    else:
        one, two = hsq(sides[0], group, intercepts[0]), hsq(sides[1], group, intercepts[1])
    cov = gencov(df, group, one, two, intercepts[2])
    out = one.select(*group, F.col("tot").alias("h1")).join(two.select(*group, F.col("tot").alias("h2")), group).join(cov.select(*group, F.col("tot").alias("gencov")), group)
    fine = (F.col("h1") > 0) & (F.col("h2") > 0)
    return out.withColumn("rg", F.when(fine, F.col("gencov") / F.sqrt(F.when(fine, F.col("h1") * F.col("h2")))))


def latent_correlation(stats: DataFrame, external: DataFrame, n_samples: float, m: float, weights: DataFrame | None = None, intercepts: tuple = (None, None, None)) -> DataFrame:
    """``dim, h1, h2, gencov, rg, skipped`` of each latent trait against an external one.

    ``stats`` is ``variant_idx, dim, z`` of ``association`` over ``n_samples``; ``external`` is ``variant_idx, z, n, ld, w_ld`` of
    ``context``; they meet on the variant. With ``weights`` (``dim, weight``) only dimensions of a weight other than 0 are
    fitted. A dimension is skipped where a fit is singular (its covariance and correlation are then 0) or a
    heritability is not positive (its covariance stays, its correlation is 0).
    """
    if weights is not None:
        stats = stats.join(weights.where("weight <> 0").select("dim"), "dim", "left_semi")
    rows = stats.select("variant_idx", "dim", F.col("z").alias("z1")).join(external.select("variant_idx", F.col("z").alias("z2"), F.col("n").alias("n2"), "ld", "w_ld"), "variant_idx")
    rows = rows.withColumns({"n1": F.lit(float(n_samples)), "m": F.lit(float(m))})
    out = genetic_correlation(rows, ["dim"], intercepts)
    zero = F.lit(0.0)
    return out.select("dim", "h1", "h2", F.coalesce("gencov", zero).alias("gencov"), F.coalesce("rg", zero).alias("rg"), F.col("rg").isNull().alias("skipped"))


def context(sumstats: DataFrame, ref_ld: DataFrame, w_ld: DataFrame, bed: DataFrame) -> DataFrame:
    """Inner join of summary statistics, panel and weight LD scores and genotyped variants on the SNP name.

    ``sumstats``: snp, a1, a2, n, z. ``ref_ld``: snp, ld. ``w_ld``: snp, w_ld. ``bed``: variant_idx, snp, a1, a2. Alleles must
    agree as a set, whatever their case; z is turned where they are swapped. Palindromic SNPs stay; repeated names
    multiply.
    """
    b = bed.select("variant_idx", "snp", F.upper("a1").alias("b1"), F.upper("a2").alias("b2"))
    s = sumstats.select("snp", F.upper("a1").alias("s1"), F.upper("a2").alias("s2"), "n", "z")
    joined = s.join(ref_ld, "snp").join(w_ld, "snp").join(b, "snp")
    same = (F.col("b1") == F.col("s1")) & (F.col("b2") == F.col("s2"))
    swapped = (F.col("b1") == F.col("s2")) & (F.col("b2") == F.col("s1"))
    return joined.where(same | swapped).select("variant_idx", "snp", F.when(F.col("s1") != F.col("b1"), -F.col("z")).otherwise(F.col("z")).alias("z"), "n", "ld", "w_ld")


def _solve_each(sums: DataFrame, group: list[str], k: int) -> DataFrame:
    """Solve the k x k normal equations in the arrays ``_a`` (row by row) and ``_t`` of each row; null where singular."""
    import numpy as np
    import pandas as pd

    schema = sums.select(*group, "nbar").schema.add("_b", T.ArrayType(T.DoubleType()))

    def run(frames):
        for f in frames:
            out = []
            for a, t in zip(f["_a"], f["_t"]):
                try:
                    out.append(np.linalg.solve(np.asarray(a, float).reshape(k, k), np.asarray(t, float)))
                except np.linalg.LinAlgError:
                    out.append(None)
            yield pd.DataFrame({**{c: f[c] for c in (*group, "nbar")}, "_b": out})

    return sums.select(*group, "nbar", "_a", "_t").mapInPandas(run, schema)


def _annotated(rows: DataFrame, group: list[str], annotations: list[str], m: list[float], null: float, fixed: bool, weights) -> DataFrame:
    """``group, tot, cat array, intercept``: ``y`` on LD score columns with ``m`` SNPs behind each; rows have ``n`` and ``y`` too.

    ``weights`` takes the summed LD score, the total estimate and the intercept; as published, the estimate between
    passes uses only the first coefficient times all SNPs. One row of sums per group and pass is solved, where the
    group's sums are; a singular group gets nulls.
    """
    big, k = float(sum(m)), len(annotations) + (not fixed)
    ld = F.lit(0.0)
    for c in annotations:
        ld = ld + F.col(c)
    rows = staged(rows.withColumn("_ld", ld))
    start = rows.groupBy(*group).agg(F.avg(F.col("n").cast("double")).alias("nbar"), (big * (F.avg("y") - null) / F.avg(F.col("_ld") * F.col("n"))).alias("_est"))
    est = staged(start.withColumn("_ic", F.lit(float(null))))
    for _ in range(3):
        x = [F.col(c) * F.col("n") / F.col("nbar") for c in annotations] + [F.lit(1.0)] * (not fixed)
        y = F.col("y") - (F.lit(float(null)) if fixed else F.lit(0.0))
        w = weights(F.col("_ld"), F.col("_est"), F.col("_ic"))
        sums = rows.join(est.select(*group, "nbar", "_est", "_ic"), group).groupBy(*group, "nbar").agg(
            F.array(*[F.sum(w * p * q) for p in x for q in x]).alias("_a"), F.array(*[F.sum(w * p * y) for p in x]).alias("_t")
        )
        ic = F.lit(float(null)) if fixed else F.get("_b", F.lit(len(annotations)))
        est = staged(_solve_each(sums, group, k).select(*group, "nbar", (big * F.get("_b", F.lit(0)) / F.col("nbar")).alias("_est"), ic.alias("_ic"), "_b"))
    cat = F.array(*[F.get("_b", F.lit(j)) * F.lit(float(mj)) / F.col("nbar") for j, mj in enumerate(m)])
    return est.select(*group, F.aggregate(cat, F.lit(0.0), lambda s, v: s + v).alias("tot"), cat.alias("cat"), F.col("_ic").alias("intercept"))


def hsq_annotations(df: DataFrame, group: list[str], annotations: list[str], m: list[float], intercept: float | None = None) -> DataFrame:
    """``group, tot, cat array, intercept``: heritability split over annotations; ``df`` has ``chisq, w_ld, n`` and these."""
    rows = df.where(F.col("chisq").isNotNull()).select(*group, *annotations, "w_ld", "n", F.col("chisq").alias("y"))
    null = 1.0 if intercept is None else float(intercept)
    return _annotated(rows, group, annotations, m, null, intercept is not None, lambda ld, h, i: hsq_weights(ld, F.col("w_ld"), F.col("n"), F.lit(float(sum(m))), h, i))


def gencov_annotations(df: DataFrame, group: list[str], annotations: list[str], m: list[float], h1: DataFrame, h2: DataFrame, intercept: float | None = None) -> DataFrame:
    """``group, tot, cat array, intercept``: genetic covariance split over annotations; ``df`` has ``z1, z2, n1, n2, w_ld`` and these.

    ``h1`` and ``h2`` have ``group, tot, intercept`` of both heritabilities.
    """
    rows = df.withColumns({"y": F.col("z1") * F.col("z2"), "n": F.sqrt(F.col("n1") * F.col("n2"))})
    for k, h in ((1, h1), (2, h2)):
        rows = rows.join(h.select(*group, F.col("tot").alias(f"h{k}"), F.col("intercept").alias(f"i{k}")), group)
    c, big = F.col, F.lit(float(sum(m)))
    rows = rows.select(*group, *annotations, "w_ld", "n", "n1", "n2", "y", "h1", "i1", "h2", "i2")
    return _annotated(
        rows, group, annotations, m, 0.0 if intercept is None else float(intercept), intercept is not None,
        lambda ld, g, i: gencov_weights(ld, c("w_ld"), c("n1"), c("n2"), big, c("h1"), c("h2"), g, c("i1"), c("i2"), i),
    )


def correlation_annotations(df: DataFrame, group: list[str], annotations: list[str], m: list[float], intercepts: tuple = (None, None, None)) -> DataFrame:
    """``group, h1, h2, gencov, rg`` with several annotations; rg is null where a heritability is not positive."""
    df = staged(df.select(*group, *annotations, "z1", "z2", "n1", "n2", "w_ld"))
    one = hsq_annotations(df.withColumns({"chisq": F.col("z1") * F.col("z1"), "n": F.col("n1")}), group, annotations, m, intercepts[0])
    two = hsq_annotations(df.withColumns({"chisq": F.col("z2") * F.col("z2"), "n": F.col("n2")}), group, annotations, m, intercepts[1])
    cov = gencov_annotations(df, group, annotations, m, one, two, intercepts[2])
    out = one.select(*group, F.col("tot").alias("h1")).join(two.select(*group, F.col("tot").alias("h2")), group).join(cov.select(*group, F.col("tot").alias("gencov")), group)
    fine = (F.col("h1") > 0) & (F.col("h2") > 0)
    return out.withColumn("rg", F.when(fine, F.col("gencov") / F.sqrt(F.when(fine, F.col("h1") * F.col("h2")))))
