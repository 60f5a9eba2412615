"""Exact medians of any groups at once, by counts of ranges that close in on the middle values."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.staging import staged

#: Ranges that a pass cuts each open interval into.
RANGES = 1024
#: More passes than any doubles need: one by power of two, then ten bits each.
PASSES = 16


def _coarse(v):
    """A range by sign and power of two: in the order of the values; NaN last, as it is sorted."""
    power = F.floor(F.log2(F.abs(v))) + 1100
    return F.when(F.isnan(v), F.lit(1 << 20)).when(v == 0, F.lit(0)).when(F.abs(v) == float("inf"), F.signum(v) * (1 << 18)).otherwise(F.signum(v) * power).cast("long")


def _fine(v, lo, hi):
    return F.least(F.floor((v - lo) / (hi - lo) * RANGES), F.lit(RANGES - 1)).cast("long")


def medians(df: DataFrame, by: list[str], value: str, out: str = "median") -> DataFrame:
    """``by, median``: the middle value of each group, or the mean of the two middle ones; null for a group without values.

    Equal values are counted first, so ties are one row. A pass counts, for each group and wanted rank, ``RANGES`` ranges
    between the least and greatest value that can still hold it, and keeps the range that does; rows outside it drop out. No
    task sees a whole group: passes are aggregates, and of a group there are at most ``RANGES`` rows in a window.
    """
    keys = [f"_k{k}" for k in range(len(by))]
    # Null keys are a group as well.
    named = df.select(*[F.struct(F.col(c).alias("v")).alias(k) for c, k in zip(by, keys)], F.col(value).cast("double").alias("_v"))
    counted = staged(named.where("_v IS NOT NULL").groupBy(*keys, "_v").agg(F.count("*").alias("_n")))
    sizes = counted.groupBy(*keys).agg(F.sum("_n").alias("n"), F.min("_v").alias("lo"), F.max("_v").alias("hi"))
    ranks = F.explode(F.array_distinct(F.array(F.floor((F.col("n") - 1) / 2), F.floor(F.col("n") / 2)))).alias("rank")
    wanted = staged(sizes.select(*keys, ranks, F.lit(0).cast("long").alias("below"), "lo", "hi"))
    for k in range(PASSES):
        open_ = wanted.where("lo <> hi")
        if open_.isEmpty():
            break
        ends = [F.col("lo"), F.col("hi")]
        met = counted.join(open_, keys).where(F.col("_v").between(*ends))
        met = met.withColumn("range", _coarse(F.col("_v")) if k == 0 else _fine(F.col("_v"), *ends))
        ranges = met.groupBy(*keys, "rank", "below", "range").agg(F.sum("_n").alias("n"), F.min("_v").alias("lo"), F.max("_v").alias("hi"))
        before = F.coalesce(F.sum("n").over(Window.partitionBy(*keys, "rank").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) + F.col("below")
        found = ranges.withColumn("below", before).where((F.col("below") <= F.col("rank")) & (F.col("rank") < F.col("below") + F.col("n")))
        wanted = staged(found.select(*keys, "rank", "below", "lo", "hi").union(wanted.where("lo = hi")))
    middle = wanted.groupBy(*keys).agg(F.avg("lo").alias(out))
    everyone = named.select(*keys).distinct()
    return everyone.join(middle, keys, "left").select(*[F.col(f"{k}.v").alias(c) for k, c in zip(keys, by)], out)
