"""Heritability, genetic covariance, spectra and association statistics from factored cross products."""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.staging import scratch, staged
from .blocks import Panel, _fields, _streamed, kinship_squares, panel, product, sample_matrix, tile_gram
from .factored import BINARY, Projection, _total, residual_tiles, solve, standardize, traces, variant_rows, vectors

#: Traits that are columns of one product in ``mom_long``; more take more passes over the blocks.
TRAITS_AT_ONCE = 1024


def _n_variants(dosage: DataFrame) -> int:
    return dosage.agg((F.max("variant_idx") + 1).alias("m")).first()["m"] or 0


def as_panel(genotypes: DataFrame | Panel) -> Panel:
    """Genotypes as they are, or dosages in long form packed into blocks."""
    return genotypes if isinstance(genotypes, Panel) else panel(genotypes, _n_variants(genotypes))


def _prepare(genotypes: DataFrame | Panel, design: DataFrame, traits: list[str], w: list[str], eps: str) -> tuple[Panel, DataFrame, Projection]:
    """The panel, ``residual_tiles`` and the projection; what is read more than once is written once."""
    x = as_panel(genotypes)
    p = Projection(staged(standardize(design, traits, eps)), w, traits)
    return x, staged(residual_tiles(x, p)), p


def _u_gram(residuals: DataFrame, p: Projection, m: int) -> np.ndarray:
    """Z'VKVZ."""
    return tile_gram(residuals, len(p.z), "u") / m


def _long(spark, traits: list[str], values: dict[str, list[float]]) -> DataFrame:
    """One row per trait; as many rows as traits."""
    rows = [(k, *[float(v[k]) for v in values.values()]) for k in range(len(traits))]
    return spark.createDataFrame(rows, "dim int, " + ", ".join(f"{c} double" for c in values))


def ratio(v0: float, v1: float) -> float:
    total = v0 + v1
    return v0 / (total + (1e-8 if total >= 0 else -1e-8))


@scratch
def mom(genotypes: DataFrame | Panel, design: DataFrame, traits: list[str], covariates: list[str] = (), trace2: float | None = None, probes: int | None = None) -> DataFrame:
    """``dim, h2`` by the method of moments for each trait column of ``design`` (``sample_id``, traits, covariates).

    Genotypes are a panel or dosages in long form. Without covariates the raw variance component, (y'Ky - y'y) / (tr K^2 - n);
    with covariates, taken as they are and without an intercept, the share of the genetic component in the solution of the
    2 x 2 moment system. tr(K^2) is exact unless ``trace2`` or ``probes`` is given: see ``traces``.
    """
    x, residuals, p = _prepare(genotypes, design, traits, list(covariates), "add")
    t1, t2 = traces(x, residuals, p, trace2, probes)
    u, out = np.diag(_u_gram(residuals, p, x.m)), []
    for q_k, q in zip(u, np.diag(p.zvz)):
        out.append((q_k - q) / (t2 - p.n) if not p.w else ratio(q_k * p.nc - q * t1, t2 * q - t1 * q_k))
    return _long(x.blocks.sparkSession, traits, {"h2": out})


@scratch
def mom_long(genotypes: DataFrame | Panel, traits: DataFrame, by: tuple[str, ...] = ("run", "epoch", "dim"), trace2: float | None = None, probes: int | None = None) -> DataFrame:
    """``by, h2`` without covariates for traits in long form, ``sample_id, z`` and the columns of ``by``: any number at once.

    Each group is standardised over its own rows and should hold every sample of the cohort. Groups are the columns of
    products over the blocks, ``TRAITS_AT_ONCE`` a pass. Traces as in ``mom``.
    """
    x, traits = as_panel(genotypes), staged(traits.select("sample_id", *by, "z"))
    moments = traits.groupBy(*by).agg(F.avg("z").alias("mu"), F.stddev_samp("z").alias("sd"))
    # One row a group, as the result has.
    groups = sorted(moments.collect(), key=lambda r: tuple(map(str, r)))
    numbered = traits.sparkSession.createDataFrame([(*r, k) for k, r in enumerate(groups)], T.StructType([*moments.schema, T.StructField("g", T.IntegerType())]))
    z = staged(traits.join(numbered, list(by)).select("sample_id", "g", ((F.col("z") - F.col("mu")) / (F.coalesce("sd", F.lit(0.0)) + 1e-8)).alias("z")))
    p = Projection(x.samples.withColumn("_none", F.lit(0.0)), [], ["_none"])
    _, t2 = traces(x, residual_tiles(x, p), p, trace2, probes)
    found = []
    for lo in range(0, len(groups), TRAITS_AT_ONCE):
        width = min(TRAITS_AT_ONCE, len(groups) - lo)
        some = z.where((F.col("g") >= lo) & (F.col("g") < lo + width)).groupBy("sample_id").agg(F.map_from_entries(F.collect_list(F.struct(F.col("g") - lo, "z"))).alias("v"))
        some = some.select("sample_id", F.transform(F.sequence(F.lit(0), F.lit(width - 1)), lambda k: F.coalesce(F.try_element_at("v", k), F.lit(0.0))).alias("v"))
        found += np.diag(tile_gram(product(x, sample_matrix(x, some, "v"), True), width)).tolist()
    q = {r["g"]: r["q"] for r in z.groupBy("g").agg(F.sum(F.col("z") * F.col("z")).alias("q")).collect()}
    rows = [(*r[: len(by)], (found[k] / x.m - q[k]) / (t2 - p.n)) for k, r in enumerate(groups)]
    return traits.sparkSession.createDataFrame(rows, T.StructType([*[traits.schema[c] for c in by], T.StructField("h2", T.DoubleType())]))


def mom_kinship(kinship: DataFrame, design: DataFrame, traits: list[str]) -> DataFrame:
    """``dim, h2`` without covariates from a relationship matrix ``i, j, k`` (i <= j); both sides join the cohort."""
    design = standardize(design, traits)
    a = design.select(F.col("sample_id").alias("i"), *[F.col(z).alias(f"a_{z}") for z in traits])
    b = design.select(F.col("sample_id").alias("j"), *[F.col(z).alias(f"b_{z}") for z in traits])
    twice = F.when(F.col("i") == F.col("j"), 1.0).otherwise(2.0)
    both = kinship.join(a, "i").join(b, "j")
    row = both.agg(F.sum(twice * F.col("k") * F.col("k")).alias("t2"), *[F.sum(twice * F.col("k") * F.col(f"a_{z}") * F.col(f"b_{z}")).alias(z) for z in traits]).first()
    sums = design.agg(F.count("*").alias("n"), *[F.sum(F.col(z) * F.col(z)).alias(z) for z in traits]).first()
    return _long(kinship.sparkSession, traits, {"h2": [(row[z] - sums[z]) / (row["t2"] - sums["n"]) for z in traits]})


@scratch
def mom_pairs(x: Panel, design: DataFrame, traits: list[str]) -> DataFrame:
    """``dim, h2`` as ``mom_kinship`` gives from ``blocks.kinship(x)``, without a table of the matrix.

    Its squares are summed where its parts are made, and y'Ky is the square of X'y over m.
    """
    design = staged(standardize(design, traits))
    z = sample_matrix(x, design.select("sample_id", F.array(*[F.coalesce(z, F.lit(0.0)) for z in traits]).alias("v")), "v")
    u, t2 = np.diag(tile_gram(product(x, z, True), len(traits))) / x.m, kinship_squares(x, design)
    sums = design.agg(F.count("*").alias("n"), *[F.sum(F.col(z) * F.col(z)).alias(z) for z in traits]).first()
    return _long(x.blocks.sparkSession, traits, {"h2": [(u[k] - sums[z]) / (t2 - sums["n"]) for k, z in enumerate(traits)]})


@scratch
def genetic_covariance(genotypes: DataFrame | Panel, design: DataFrame, traits: list[str], target: str, covariates: list[str] = (), trace2: float | None = None, probes: int | None = None) -> DataFrame:
    """``dim, gamma, rho``: genetic covariance and score-overlap correlation of each trait with ``target``; W = [1 | C]. Traces as in ``mom``."""
    x, residuals, p = _prepare(genotypes, design.withColumn("_one", F.lit(1.0)), [*traits, target], ["_one", *covariates], "add")
    t1, t2 = traces(x, residuals, p, trace2, probes)
    q = _u_gram(residuals, p, x.m)
    det = t2 * p.nc - t1 * t1
    num, own = (q[:, -1] * p.nc - p.zvz[:, -1] * t1)[:-1], np.maximum(np.diag(q) * p.nc - np.diag(p.zvz) * t1, 1e-8)
    rho = [max(-1.0, min(1.0, v / math.sqrt(own[k] * own[-1]))) for k, v in enumerate(num)]
    return _long(x.blocks.sparkSession, traits, {"gamma": num / det, "rho": rho})


@scratch
def genetic_matrices(genotypes: DataFrame | Panel, design: DataFrame, traits: list[str], covariates: list[str] = (), trace2: float | None = None, probes: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """G (genetic covariance components) and the projected correlation matrix of the traits; W = [1 | C]. Traces as in ``mom``.

    Both are sums of outer products, one matrix of traits squared a task.
    """
    x, residuals, p = _prepare(genotypes, design.withColumn("_one", F.lit(1.0)), traits, ["_one", *covariates], "floor")
    t1, t2 = traces(x, residuals, p, trace2, probes)
    inverse = np.linalg.inv(np.array([[t2, t1], [t1, p.nc]]))
    d = np.sqrt(np.maximum(np.diag(p.zvz), 1e-12))
    return inverse[0, 0] * _u_gram(residuals, p, x.m) + inverse[0, 1] * p.zvz, p.zvz / np.outer(d, d)


def matrix_rows(spark, **matrices: np.ndarray) -> DataFrame:
    """``i, j`` and one column for each d x d matrix."""
    names = list(matrices)
    d = len(matrices[names[0]])
    rows = [(i, j, *[float(matrices[n][i, j]) for n in names]) for i in range(d) for j in range(d)]
    return spark.createDataFrame(rows, "i int, j int, " + ", ".join(f"{n} double" for n in names))


def spectrum(g: np.ndarray, p: np.ndarray, ridge: float = 1e-4, first: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Generalised eigenvalues of G against P + ridge I, descending, and directions V with V'(P + ridge I)V = I."""
    k = min(first or len(g), len(g))
    whole = p[:k, :k] + ridge * np.eye(k)
    low = np.linalg.inv(np.linalg.cholesky(whole))
    white = low @ g[:k, :k] @ low.T
    values, vectors = np.linalg.eigh(0.5 * (white + white.T))
    return values[::-1], low.T @ vectors[:, ::-1]


def of_directions(g: np.ndarray, p: np.ndarray, directions: np.ndarray, ridge: float = 1e-4) -> np.ndarray:
    """Rayleigh quotients of given directions on other samples' matrices."""
    k = len(directions)
    whole = p[:k, :k] + ridge * np.eye(k)
    return np.einsum("ik,ij,jk->k", directions, g[:k, :k], directions) / np.einsum("ik,ij,jk->k", directions, whole, directions)


@scratch
def variance_explained(genotypes: DataFrame | Panel, design: DataFrame, traits: list[str], covariates: list[str]) -> DataFrame:
    """``dim, r2``: variance of the traits given covariates less what is left given genotypes; W = [1 | C].

    The system over variants is solved by conjugate gradients (``solve``), so their number has no bound but the samples'.
    """
    x, residuals, p = _prepare(genotypes, design.withColumn("_one", F.lit(1.0)), traits, ["_one", *covariates], "add")
    if x.m >= p.n:
        raise ValueError("needs fewer variants than samples")
    fitted, d = solve(x, residuals, p).join(residuals.select("tile", "u"), "tile"), len(traits)

    def step(rows):
        for r in rows:
            yield (np.hstack([np.frombuffer(r[k]).reshape(-1, d) for k in ("data", "u")]).tobytes(),)

    sums = tile_gram(_streamed(fitted, _fields(("data", BINARY)), step), 2 * d)
    # Residuals have mean zero because W holds the intercept, so variances are sums over n - 1.
    return _long(x.blocks.sparkSession, traits, {"r2": np.diag(sums[:d, d:]) / (p.n - 1)})


def association(genotypes: DataFrame | Panel, design: DataFrame, traits: list[str], covariates: list[str] = ()) -> DataFrame:
    """``variant_idx, dim, beta, se, z, chisq`` of each variant and trait given W = [1 | C].

    beta = x'Vy / x'Vx; the residual variance is y'Vy / (n - c - 1), not reduced by the variant.
    """
    x, residuals, p = _prepare(genotypes, design.withColumn("_one", F.lit(1.0)), traits, ["_one", *covariates], "floor")
    s2 = F.array(*[F.lit(float(max(v / max(p.nc - 1, 1), 1e-12))) for v in np.diag(p.zvz)])
    rows = variant_rows(residuals, x.tile, len(traits)).select("variant_idx", F.greatest("d", F.lit(1e-12)).alias("d"), F.posexplode(F.arrays_zip(F.col("u").alias("u"), s2.alias("s2"))).alias("dim", "t"))
    beta, se = F.col("t.u") / F.col("d"), F.sqrt(F.col("t.s2") / F.col("d"))
    return rows.select("variant_idx", "dim", beta.alias("beta"), se.alias("se"), (beta / se).alias("z"), (beta / se * beta / se).alias("chisq"))


@dataclass(frozen=True)
class Surrogate:
    """``table``: ``sample_id, weight, fit`` (arrays over traits) of a first-order surrogate of the variance explained."""

    table: DataFrame
    width: int


def explained_surrogate(genotypes: DataFrame | Panel, design: DataFrame, traits: list[str], covariates: list[str]) -> Surrogate:
    """The surrogate around the traits of ``design``, W = C without an intercept.

    With V for C and H for the fit on VX, and z / (sd + 1e-8) not centred, the weights are 2 (Vz - HVz) + HHVz = 2 Vz - HVz: sums
    over genotypes solved by conjugate gradients, kept by sample. The fit is C (C'C)^-1 C'Z of traits as they are, not
    scaled: the two scales differ on purpose. What does not depend on traits (the panel) is shared if one is given.
    """
    x, d, c = as_panel(genotypes), len(traits), len(covariates)
    long = design.select(F.posexplode(F.array(*[F.col(z).cast("double") for z in traits])).alias("k", "z"))
    sd = {r["k"]: r["s"] or 0.0 for r in long.groupBy("k").agg(F.stddev_samp("z").alias("s")).collect()}
    scaled = staged(design.withColumns({f"_s{k}": F.col(z) / F.lit(sd[k] + 1e-8) for k, z in enumerate(traits)}))
    names = [f"_s{k}" for k in range(d)]
    p, raw = Projection(scaled, covariates, names), Projection(scaled, covariates, traits)
    residuals = staged(residual_tiles(x, p))
    b = staged(solve(x, residuals, p))

    def crossed(rows):
        for r in rows:
            yield ((np.frombuffer(r["a"]).reshape(-1, c).T @ np.frombuffer(r["data"]).reshape(-1, d)).tobytes(),)

    wxb = _total(_streamed(b.join(residuals.select("tile", "a"), "tile"), _fields(("data", BINARY)), crossed), c * d).reshape(c, d)
    correction = p.inverse @ wxb
    parts = product(x, b, False).join(sample_matrix(x, vectors(scaled, [*covariates, *names]), "v").withColumnRenamed("data", "v"), "rows")
    ids = x.samples.groupBy("rows").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "sample_id"))), lambda e: e["sample_id"]).alias("ids"))
    doubles, coef, raw_coef = T.ArrayType(T.DoubleType()), p.coef, raw.coef

    def kept(rows):
        for r in rows:
            v = np.frombuffer(r["v"]).reshape(-1, c + d)
            w, z = v[:, :c], v[:, c:]
            hvz = np.frombuffer(r["data"]).reshape(-1, d) - w @ correction
            weight, fit = 2 * (z - w @ coef) - hvz, w @ raw_coef
            for k, i in enumerate(r["ids"]):
                yield i, weight[k].tolist(), fit[k].tolist()

    return Surrogate(staged(_streamed(parts.join(ids, "rows"), _fields(("sample_id", T.LongType()), ("weight", doubles), ("fit", doubles)), kept)), d)


def surrogate_loss(surrogate: Surrogate, batch: DataFrame, traits: list[str]) -> DataFrame:
    """``dim, loss`` for new trait values of a batch of samples: - sum of weights times what the batch leaves of the fit.

    Values are centred and scaled over the batch; samples meet their weights in a join.
    """
    z = staged(standardize(batch.select("sample_id", *traits), traits, "add"))
    long = z.select("sample_id", F.posexplode(F.array(*[F.col(c) for c in traits])).alias("dim", "z")).join(surrogate.table, "sample_id")
    at = lambda c: F.get(c, F.col("dim"))
    return long.groupBy("dim").agg((-F.sum(at("weight") * (F.col("z") - at("fit")))).alias("loss"))
