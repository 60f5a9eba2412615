"""Epoch logs of heritability streams: writing lines, parsing them, and the statistics over them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

_NUMBERS = "([0-9.,\\s-]+)"
#: The two forms of an epoch line.
PLAIN = f"epoch ([0-9]+) - mse_train: [0-9.]+ - mse_val: [0-9.]+ - h_train: {_NUMBERS} - h_val: {_NUMBERS}"
SPLIT = f"epoch ([0-9]+) - mse_train: [0-9.]+ - mse_val: [0-9.]+ - h_train_even: {_NUMBERS} - h_train_odd: {_NUMBERS} - h_val_even: {_NUMBERS} - h_val_odd: {_NUMBERS}"
STREAMS = {"plain": ("train", "val"), "split": ("train_even", "train_odd", "val_even", "val_odd")}


def epoch_lines(wide: DataFrame) -> DataFrame:
    """``epoch, line`` from ``epoch, mse_train, mse_val, h_train, h_val`` (the last two arrays of doubles)."""
    numbers = lambda c: F.array_join(F.transform(c, lambda x: F.format_string("%.3f", x)), ", ")
    return wide.select("epoch", F.format_string("epoch %d - mse_train: %.4f - mse_val: %.4f - h_train: %s - h_val: %s", "epoch", "mse_train", "mse_val", numbers("h_train"), numbers("h_val")).alias("line"))


def parse(lines: DataFrame, order: str) -> DataFrame:
    """``epoch, stream, dim, value`` from ``line``; ``order`` tells which of an epoch's lines came last, which counts.

    Lines of neither form (with nan, inf or exponents in the numbers) are passed over.
    """
    def form(pattern: str, streams: tuple[str, ...]) -> DataFrame:
        hit = lines.where(F.col("line").rlike(pattern))
        got = F.array(*[F.struct(F.lit(s).alias("stream"), F.regexp_extract("line", pattern, k + 2).alias("text")) for k, s in enumerate(streams)])
        return hit.select(F.regexp_extract("line", pattern, 1).cast("int").alias("epoch"), F.col(order).alias("_o"), F.explode(got).alias("s")).select("epoch", "_o", "s.*")

    rows = form(SPLIT, STREAMS["split"]).union(form(PLAIN, STREAMS["plain"]))
    last = rows.groupBy("epoch", "stream").agg(F.max_by("text", "_o").alias("text"))
    values = F.posexplode(F.split(F.trim("text"), "\\s*,\\s*")).alias("dim", "value")
    return last.select("epoch", "stream", values).select("epoch", "stream", "dim", F.col("value").try_cast("double").alias("value")).where("value IS NOT NULL")


def pick_stream(parsed: DataFrame, split: str = "val", chrom: str = "odd") -> DataFrame:
    """One stream: ``split`` on plain logs, ``split_chrom`` on split ones; raises if it is absent."""
    if split not in ("train", "val") or chrom not in ("even", "odd"):
        raise ValueError("split is train or val, chrom is even or odd")
    names = {r["stream"] for r in parsed.select("stream").distinct().collect()}
    name = f"{split}_{chrom}" if f"{split}_{chrom}" in names else split
    if name not in names:
        raise ValueError(f"the log has no stream {name}")
    return parsed.where(F.col("stream") == name)


def epoch_stats(values: DataFrame, absolute: bool = False) -> DataFrame:
    """``epoch, mean, sd, top``: over dimensions, NaN left out, population sd; ``mask`` (boolean), if there, selects."""
    v = F.abs("value") if absolute else F.col("value")
    keep = ~F.isnan("value") & (F.col("mask") if "mask" in values.columns else F.lit(True))
    v = F.when(keep, v)
    return values.groupBy("epoch").agg(F.avg(v).alias("mean"), F.stddev_pop(v).alias("sd"), F.max(v).alias("top"))


def peak(values: DataFrame, by: list[str]) -> DataFrame:
    """Per group the dimension of the largest value, the lowest of equals."""
    w = Window.partitionBy(*by).orderBy(F.desc("value"), "dim")
    return values.where(~F.isnan("value")).withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def histogram(values: DataFrame, column: str, bins: int = 59) -> DataFrame:
    """``bin, lo, hi, n``: equal bins between least and largest value, the last one closed; empty bins have n = 0."""
    r = values.agg(F.min(column).alias("a"), F.max(column).alias("b")).first()
    spark = values.sparkSession
    if r["a"] is None:
        return spark.createDataFrame([], "bin int, lo double, hi double, n long")
    a, width = float(r["a"]), (float(r["b"]) - float(r["a"])) / bins
    at = F.lit(0) if width == 0 else F.least(F.floor((F.col(column) - a) / width), F.lit(bins - 1))
    counts = values.where(F.col(column).isNotNull()).groupBy(at.cast("int").alias("bin")).agg(F.count("*").alias("n"))
    all_bins = spark.range(bins).select(F.col("id").cast("int").alias("bin"))
    return all_bins.join(counts, "bin", "left").select("bin", (F.lit(a) + F.col("bin") * width).alias("lo"), (F.lit(a) + (F.col("bin") + 1) * width).alias("hi"), F.coalesce("n", F.lit(0)).alias("n"))


def rank_sum(df: DataFrame, value: str, treated: str, parts: int = 256) -> DataFrame:
    """``z, n1, n2`` of the rank-sum test that treated values are larger; average ranks, no correction for ties.

    Rows are counted per distinct value; values are dealt to ``parts`` ranges, which are summed one after the other, and each
    range is then summed by itself: no task sees all values. Nulls in the value or the side say nothing.
    """
    per = df.where(F.col(value).isNotNull() & F.col(treated).isNotNull()).groupBy(F.col(value).alias("v"))
    per = per.agg(F.count("*").alias("k"), F.sum(F.col(treated).cast("int")).alias("t"))
    edges = sorted(set(per.approxQuantile("v", [(i + 1) / parts for i in range(parts - 1)], 0.5 / parts))) if per.schema["v"].dataType.simpleString() in ("double", "float", "int", "bigint") else []
    at = F.size(F.filter(F.array(*map(F.lit, edges)), lambda e: F.col("v") > e)) if edges else F.lit(0)
    per = per.withColumn("_part", at)
    sums = per.groupBy("_part").agg(F.sum("k").alias("_n"))
    sums = sums.select("_part", F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    inside = F.coalesce(F.sum("k").over(Window.partitionBy("_part").orderBy("v").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ranked = per.withColumn("_inside", inside).join(sums, "_part").withColumn("r", F.col("_before") + F.col("_inside") + (F.col("k") + 1) / 2.0)
    s = ranked.agg(F.sum(F.col("t") * F.col("r")).alias("w"), F.sum("t").alias("n1"), (F.sum("k") - F.sum("t")).alias("n2"))
    # As doubles: the product of three counts passes 2 ** 63 at a few million rows.
    n1, n2 = F.col("n1").cast("double"), F.col("n2").cast("double")
    spread = F.sqrt(n1 * n2 * (n1 + n2 + 1) / 12.0)
    return s.select(((F.col("w") - n1 * (n1 + n2 + 1) / 2.0) / F.when(spread > 0, spread)).alias("z"), "n1", "n2")
