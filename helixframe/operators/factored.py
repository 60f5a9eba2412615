"""Cross products of genotypes, traits and covariates, from which every estimator here is made.

The relationship matrix K = X X' / m is never built: estimators need X'Z, X'W and, for an exact trace, X'X, all as products over
packed blocks (``blocks.py``), and the small matrices of traits and covariates. Only matrices over traits and covariates reach
the driver.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.staging import staged, unstage
from .blocks import BINARY, INT, Panel, _fields, _streamed, column_gram, gram, product, sample_matrix, tile_gram


def standardize(df: DataFrame, columns: list[str], eps: str = "add") -> DataFrame:
    """Centre columns and divide by the sample sd: plus 1e-8 (``add``) or at least 1e-8 (``floor``).

    Two numbers a column reach the driver.
    """
    long = df.select(F.posexplode(F.array(*[F.col(c).cast("double") for c in columns])).alias("k", "x"))
    got = {r["k"]: r for r in long.groupBy("k").agg(F.avg("x").alias("m"), F.stddev_samp("x").alias("s")).collect()}
    sd = lambda k: (got[k]["s"] or 0.0) + 1e-8 if eps == "add" else max(got[k]["s"] or 0.0, 1e-8)
    return df.withColumns({c: (F.col(c) - F.lit(got[k]["m"])) / F.lit(sd(k)) for k, c in enumerate(columns) if k in got})


def dot(columns: list[str], weights: np.ndarray) -> Column:
    """Sum of columns times numbers."""
    out = F.lit(0.0)
    for c, w in zip(columns, weights):
        out = out + F.col(c) * F.lit(float(w))
    return out


@dataclass
class Projection:
    """V = I - W (W'W)^-1 W' for covariate columns ``w``, as sums: traits ``z`` may be any columns of ``design``."""

    design: DataFrame
    w: list[str]
    z: list[str]

    def __post_init__(self) -> None:
        sums = column_gram(self.design, F.array(F.lit(1.0), *[F.col(c) for c in (*self.w, *self.z)]), 1 + len(self.w) + len(self.z))
        self.n, sums, c = int(round(sums[0, 0])), sums[1:, 1:], len(self.w)
        self.wtw, self.wtz, self.ztz = sums[:c, :c], sums[:c, c:], sums[c:, c:]
        self.inverse = np.linalg.inv(self.wtw) if c else np.zeros((0, 0))
        self.coef = self.inverse @ self.wtz
        #: Z' V Z.
        self.zvz = self.ztz - self.wtz.T @ self.coef
        self.nc = self.n - c


def vectors(design: DataFrame, columns: list[str]) -> DataFrame:
    """``sample_id, v``: some columns as one array."""
    return design.select("sample_id", F.array(*[F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in columns]).alias("v"))


def residual_tiles(panel: Panel, p: Projection) -> DataFrame:
    """``tile, a, u, d`` (binary): X'W, X'VZ (variants by columns) and x'Vx of each variant."""
    columns, c = [*p.w, *p.z], len(p.w)
    schema = _fields(("tile", INT), ("a", BINARY), ("u", BINARY), ("d", BINARY))
    coef, inverse = p.coef, p.inverse
    if not columns:
        return panel.tiles.select("tile", F.lit(b"").alias("a"), F.lit(b"").alias("u"), F.col("ss").alias("d"))
    sums = product(panel, sample_matrix(panel, vectors(p.design, columns), "v"), True)

    def step(rows: Iterator[dict]) -> Iterator[tuple]:
        for r in rows:
            t = np.frombuffer(r["data"]).reshape(-1, len(columns))
            a = np.ascontiguousarray(t[:, :c])
            yield r["tile"], a.tobytes(), (t[:, c:] - a @ coef).tobytes(), (np.frombuffer(r["ss"]) - np.einsum("ji,ik,jk->j", a, inverse, a)).tobytes()

    return _streamed(sums.join(panel.tiles.select("tile", "ss"), "tile"), schema, step)


def variant_rows(tiles: DataFrame, tile: int, width: int) -> DataFrame:
    """``variant_idx, d, u`` (an array over traits) from ``residual_tiles``."""
    schema = _fields(("variant_idx", INT), ("d", T.DoubleType()), ("u", T.ArrayType(T.DoubleType())))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for r in (batch.slice(k, 1).to_pylist()[0] for batch in batches for k in range(len(batch))):
            d, flat = np.frombuffer(r["d"]), pa.array(np.frombuffer(r["u"]))
            u = pa.ListArray.from_arrays(pa.array(np.arange(len(d) + 1, dtype=np.int32) * width), flat)
            yield pa.RecordBatch.from_arrays([pa.array((r["tile"] * tile + np.arange(len(d))).astype(np.int32)), pa.array(d), u], names=schema.names)

    return tiles.select("tile", "u", "d").mapInArrow(run, schema)


def value_rows(tiles: DataFrame, tile: int, dims: list[int]) -> DataFrame:
    """``variant_idx, dim, u`` from matrices of variants by ``dims`` in ``tile, data``: a row a number."""
    schema, numbers = _fields(("variant_idx", INT), ("dim", INT), ("u", T.DoubleType())), np.array(dims, dtype=np.int32)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for r in (batch.slice(k, 1).to_pylist()[0] for batch in batches for k in range(len(batch))):
            u = np.frombuffer(r["data"])
            variant = r["tile"] * tile + np.arange(len(u) // len(numbers), dtype=np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(variant, len(numbers)), pa.int32()), pa.array(np.tile(numbers, len(variant))), pa.array(u)], names=schema.names)

    return tiles.select("tile", "data").mapInArrow(run, schema)


def covariate_rows(panel: Panel, residuals: DataFrame, c: int) -> DataFrame:
    """``variant_idx, s, t_0, t_1, ...``: x'x and X'W by variant, from ``residual_tiles``."""
    tile, schema = panel.tile, _fields(("variant_idx", INT), ("s", T.DoubleType()), *[(f"t_{k}", T.DoubleType()) for k in range(c)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for r in (batch.slice(k, 1).to_pylist()[0] for batch in batches for k in range(len(batch))):
            s = np.frombuffer(r["ss"])
            a = np.frombuffer(r["a"]).reshape(len(s), c)
            yield pa.RecordBatch.from_arrays([pa.array((r["tile"] * tile + np.arange(len(s))).astype(np.int32)), pa.array(s), *[pa.array(a[:, k]) for k in range(c)]], names=schema.names)

    return residuals.select("tile", "a").join(panel.tiles.select("tile", "ss"), "tile").mapInArrow(run, schema)


def _total(numbers: DataFrame, width: int) -> np.ndarray:
    """Column sums of binary vectors in ``data``: ``width`` numbers reach the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(width)
        for batch in batches:
            for x in batch.column(0).to_pylist():
                total += np.frombuffer(x)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(width, dtype=np.int32)), pa.array(total)], names=["k", "x"])

    out = np.zeros(width)
    for r in numbers.select("data").mapInArrow(run, "k int, x double").groupBy("k").agg(F.sum("x").alias("x")).collect():
        out[r["k"]] = r["x"]
    return out


def trace_of_projected(residuals: DataFrame, m: int) -> float:
    """tr(VKV): the mean of x'Vx over variants."""

    def step(rows: Iterator[dict]) -> Iterator[tuple]:
        for r in rows:
            yield (np.array([np.frombuffer(r["d"]).sum()]).tobytes(),)

    return float(_total(_streamed(residuals.select("d"), _fields(("data", BINARY)), step), 1)[0]) / m


def exact_trace2(panel: Panel, residuals: DataFrame, p: Projection) -> float:
    """tr((VKV)^2) = sum of (X'VX)_jk^2 / m^2, tile pair by tile pair; X'VX = X'X - X'W (W'W)^-1 W'X."""
    side = lambda name, out: residuals.select(F.col("tile").alias(name), F.col("a").alias(out))
    tiles = gram(panel).join(side("a", "left"), "a").join(side("b", "right"), "b")
    c, inverse = len(p.w), p.inverse

    def step(rows: Iterator[dict]) -> Iterator[tuple]:
        for r in rows:
            g = np.frombuffer(r["data"])
            if c:
                left, right = (np.frombuffer(r[k]).reshape(-1, c) for k in ("left", "right"))
                g = g.reshape(len(left), -1) - left @ inverse @ right.T
            yield (np.array([np.sum(g * g) * (1 if r["a"] == r["b"] else 2)]).tobytes(),)

    return float(_total(_streamed(tiles.select("a", "b", "data", "left", "right"), _fields(("data", BINARY)), step), 1)[0]) / panel.m**2


def signs(ids: DataFrame, probes: int, seed: int = 0) -> DataFrame:
    """``sample_id, v``: an array of signs, from md5 of sample, probe and seed, so they depend on neither partitions nor order."""
    sign = lambda k: F.when(F.substring(F.md5(F.concat_ws(":", "sample_id", k, F.lit(seed))), 1, 1) < "8", 1.0).otherwise(-1.0)
    return ids.select("sample_id", F.transform(F.sequence(F.lit(0), F.lit(probes - 1)), sign).alias("v"))


def hutchinson(panel: Panel, probes: int = 10, seed: int = 0, p: Projection | None = None) -> DataFrame:
    """``probe, estimate`` of tr((VKV)^2) = mean of |V X X' V g|^2 / m^2 over sign vectors g (V = I without ``p``).

    All probes are the columns of one matrix: one pass over the blocks for X'Vg and one for X times it.
    """
    c = len(p.w) if p else 0
    g = signs(p.design if p else panel.samples, probes, seed)
    if c:
        both = g.join(vectors(p.design, p.w).withColumnRenamed("v", "w"), "sample_id")
        coef = p.inverse @ column_gram(both, F.concat("w", "v"), c + probes)[:c, c:]
        g = _minus_fit(both, coef)
    found = product(panel, product(panel, sample_matrix(panel, g, "v"), True), False)
    if c:
        # The covariates beside it: W'R takes V's part out of |R|^2.
        found = found.join(sample_matrix(panel, vectors(p.design, p.w), "v").withColumnRenamed("data", "w"), "rows")

        def beside(rows: Iterator[dict]) -> Iterator[tuple]:
            for r in rows:
                w = np.frombuffer(r["w"]).reshape(-1, c)
                yield (np.hstack([w, np.frombuffer(r["data"]).reshape(len(w), -1)]).tobytes(),)

        found = _streamed(found.select("w", "data"), _fields(("data", BINARY)), beside)
    sums = tile_gram(found, c + probes)
    wr = sums[:c, c:]
    quad = np.einsum("ik,ij,jk->k", wr, p.inverse, wr) if c else 0.0
    estimates = (np.diag(sums)[c:] - quad) / panel.m**2
    return panel.blocks.sparkSession.createDataFrame([(k, float(x)) for k, x in enumerate(estimates)], "probe int, estimate double")


def _minus_fit(df: DataFrame, coef: np.ndarray) -> DataFrame:
    """``sample_id, v``: array ``v`` less array ``w`` times coefficients."""
    c, width = coef.shape
    schema = T.StructType([df.schema["sample_id"], T.StructField("v", T.ArrayType(T.DoubleType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            w, v = (batch.column(k).flatten().to_numpy(zero_copy_only=False).reshape(len(batch), -1) for k in (1, 2))
            out = pa.ListArray.from_arrays(pa.array(np.arange(len(batch) + 1, dtype=np.int32) * width), pa.array((v - w @ coef).ravel()))
            yield pa.RecordBatch.from_arrays([batch.column(0), out], names=schema.names)

    return df.select("sample_id", "w", "v").mapInArrow(run, schema)


def traces(panel: Panel, residuals: DataFrame, p: Projection, trace2: float | None = None, probes: int | None = None) -> tuple[float, float]:
    """tr(VKV) and tr((VKV)^2), both exact at every size; the second is ``trace2`` if given, or the mean over ``probes`` sign vectors.

    The exact one multiplies every pair of tiles: variants squared times samples. A caller who cannot pay for it says how many probes.
    """
    t1 = trace_of_projected(residuals, panel.m)
    if trace2 is not None:
        return t1, trace2
    return t1, exact_trace2(panel, residuals, p) if probes is None else hutchinson(panel, probes, p=p).agg(F.avg("estimate")).first()[0]


def solve(panel: Panel, residuals: DataFrame, p: Projection, tolerance: float = 1e-12, steps: int = 1000) -> DataFrame:
    """``tile, data``: B with (X'VX) B = X'VZ, all traits at once, by conjugate gradients; no matrix over variants is made.

    A step is X'(XP) over the blocks less X'W (W'W)^-1 (W'XP). Directions and residuals stay in Spark as tiles; sums of their
    products, a few numbers a trait, reach the driver. Ends when each residual's square is ``tolerance`` of its first; raises
    after ``steps`` steps, as it must where X'VX has no inverse.
    """
    d, c, inverse = len(p.z), len(p.w), p.inverse
    schema = _fields(("tile", INT), ("a", BINARY), ("b", BINARY), ("r", BINARY), ("p", BINARY))

    def begin(rows: Iterator[dict]) -> Iterator[tuple]:
        for r in rows:
            yield r["tile"], r["a"], np.zeros(len(r["u"]) // 8).tobytes(), r["u"], r["u"]

    state = staged(_streamed(residuals.select("tile", "a", "u"), schema, begin))

    def sums_of(df: DataFrame, names: tuple[str, ...]) -> np.ndarray:
        """For each pair of ``names`` the products' sums by trait."""

        def step(rows: Iterator[dict]) -> Iterator[tuple]:
            for r in rows:
                a = np.frombuffer(r["a"]).reshape(-1, c) if c else np.zeros((len(r["r"]) // (8 * d), 0))
                x = {k: np.frombuffer(r[k]).reshape(-1, d) for k in names}
                pairs = [np.sum(x[i] * x[j], 0) for i in names for j in names]
                yield (np.concatenate([*pairs, *[(a.T @ x[k]).ravel() for k in names]]).tobytes(),)

        k = len(names)
        got = _total(_streamed(df, _fields(("data", BINARY)), step), k * k * d + k * c * d)
        squares = {(i, j): got[(x * k + y) * d : (x * k + y + 1) * d] for x, i in enumerate(names) for y, j in enumerate(names)}
        return squares | {i: got[k * k * d + x * c * d : k * k * d + (x + 1) * c * d].reshape(c, d) for x, i in enumerate(names)}

    last = state
    s = sums_of(state, ("r", "p"))
    first = rr = s["r", "r"]
    ap_sum = s["p"]
    for _ in range(steps):
        if (rr <= tolerance * first).all():
            return state.select("tile", F.col("b").alias("data"))
        moved = product(panel, product(panel, state.select("tile", F.col("p").alias("data")), False), True).withColumnRenamed("data", "x")
        correction = inverse @ ap_sum if c else None

        def applied(rows: Iterator[dict], correction: np.ndarray | None = correction) -> Iterator[tuple]:
            for r in rows:
                x = np.frombuffer(r["x"])
                if correction is not None:
                    x = (x.reshape(-1, d) - np.frombuffer(r["a"]).reshape(-1, c) @ correction).ravel()
                yield r["tile"], r["a"], r["b"], r["r"], r["p"], x.tobytes()

        both = staged(_streamed(state.join(moved, "tile"), T.StructType([*schema, T.StructField("x", BINARY)]), applied))
        # What the step before wrote has been read.
        unstage(last)
        last = both
        s = sums_of(both, ("r", "p", "x"))
        live = (s["p", "x"] > 0) & (rr > tolerance * first)
        alpha = np.where(live, rr / np.where(live, s["p", "x"], 1.0), 0.0)
        new = np.maximum(rr - 2 * alpha * s["r", "x"] + alpha**2 * s["x", "x"], 0.0)
        beta = np.where(live, new / np.where(rr > 0, rr, 1.0), 0.0)

        def step(rows: Iterator[dict], alpha: np.ndarray = alpha, beta: np.ndarray = beta) -> Iterator[tuple]:
            for r in rows:
                b, res, way, x = (np.frombuffer(r[k]).reshape(-1, d) for k in ("b", "r", "p", "x"))
                res = res - alpha * x
                yield r["tile"], r["a"], (b + alpha * way).tobytes(), res.tobytes(), (res + beta * way).tobytes()

        state = _streamed(both, schema, step)
        ap_sum = (s["r"] - alpha * s["x"]) + beta * s["p"]
        rr = np.where(live, new, rr)
    raise ValueError(f"no solution after {steps} steps: variants are not independent given the covariates")
