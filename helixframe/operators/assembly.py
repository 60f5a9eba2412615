"""Cohort assembly: which samples every source has, which values are missing, who trains."""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def shared_samples(sources: Iterable[DataFrame], key: str = "sample_id") -> DataFrame:
    """Ids that all sources hold, each once."""
    return reduce(DataFrame.intersect, [s.select(key) for s in sources])


def complete(df: DataFrame, required: list[str]) -> DataFrame:
    """Rows whose required columns (doubles) are neither null nor NaN; others columns may be missing."""
    names = list(dict.fromkeys(required))
    ok = F.lit(True)
    for c in names:
        ok = ok & F.col(c).isNotNull() & ~F.isnan(F.coalesce(F.col(c).cast("double"), F.lit(0.0)))
    return df.where(ok)


def select_covariates(df: DataFrame, names: list[str], key: str = "sample_id") -> DataFrame:
    """The named columns in that order; unknown names raise."""
    unknown = [n for n in names if n not in df.columns]
    if unknown:
        raise ValueError(f"unknown covariates: {', '.join(unknown)}")
    return df.select(key, *names)


def last_of_each(df: DataFrame, key: str, order: str) -> DataFrame:
    """One row per key: of repeated keys the last by ``order``."""
    rest = [c for c in df.columns if c != key]
    return df.groupBy(key).agg(F.max_by(F.struct(*rest), order).alias("_r")).select(key, "_r.*")


def reindex(source: DataFrame, wanted: DataFrame, key: str = "sample_id", order: str | None = None) -> DataFrame:
    """Rows of ``source`` in the places of ``wanted`` (``key`` and other columns, such as a position); a missing key raises when read.

    Of repeated keys in ``source`` the last by ``order`` counts. Each task checks the keys it joins, so no list of keys is
    gathered. ``wanted`` may repeat a key; its rows and columns all stay, those of ``source`` come after them.
    """
    rest = [c for c in source.columns if c != key]
    once = source.groupBy(key).agg((F.max_by(F.struct(*rest), order) if order else F.first(F.struct(*rest))).alias("_row"))
    found = wanted.join(once.withColumn("_there", F.lit(True)), key, "left")
    checked = F.when(F.col("_there"), F.col("_row")).otherwise(F.raise_error(F.concat(F.lit("no row for "), F.coalesce(F.col(key).cast("string"), F.lit("null")))).cast(once.schema["_row"].dataType))
    return found.withColumn("_row", checked).select(*wanted.columns, "_row.*")


def with_paths(ids: DataFrame, manifest: DataFrame, key: str = "sample_id") -> DataFrame:
    """Ids with their manifest's path (``key, path``); of repeated manifest rows the least path, ids without one are left out."""
    return ids.join(manifest.groupBy(key).agg(F.min("path").alias("path")), key)


def conditioned(latents: DataFrame, z: list[str], covariates: DataFrame, columns: list[str], key: str = "sample_id") -> DataFrame:
    """``key, z``: what a decoder is given, an array of latent components and then the sample's covariates in the order named."""
    return latents.join(select_covariates(covariates, columns, key), key).select(key, F.array(*[F.col(c).cast("double") for c in (*z, *columns)]).alias("z"))


def split(ids: DataFrame, fraction: float, seed: int, key: str = "sample_id") -> DataFrame:
    """Add ``part``: train for the first ``int(n * fraction)`` ids by md5 of id and seed, val for the rest.

    The cut is the hash at that rank: ids are counted by the first four digits of their hash (65,536 counts at most), and only
    the ids of the digits that hold the rank are sorted. Membership is then a comparison.
    """
    hashed = ids.withColumn("_h", F.md5(F.concat_ws(":", F.col(key).cast("string"), F.lit(str(seed)))))
    counts = hashed.groupBy(F.substring("_h", 1, 4).alias("_p")).agg(F.count("*").alias("k")).orderBy("_p").collect()
    take = int(sum(r["k"] for r in counts) * fraction)
    if take == 0:
        return hashed.drop("_h").withColumn("part", F.lit("val"))
    before = 0
    for r in counts:
        if before + r["k"] >= take:
            break
        before += r["k"]
    cut = hashed.where(F.col("_h").startswith(r["_p"])).select("_h").orderBy("_h").limit(take - before).agg(F.max("_h").alias("c")).first()["c"]
    return hashed.withColumn("part", F.when(F.col("_h") <= cut, "train").otherwise("val")).drop("_h")


def resume(split_ids: DataFrame, available: DataFrame, key: str = "sample_id") -> DataFrame:
    return split_ids.join(available.select(key), key, "left_semi")


def nearest(left: DataFrame, right: DataFrame, on: str, by: list[str]) -> DataFrame:
    """As-of join in both directions: the row of ``right`` whose ``on`` is nearest, of equally near ones the lower.

    Both sides are stacked and ordered within ``by``; the nearest before and after a row are the last and first non-null
    structs around it, so nothing is paired.
    """
    values = [c for c in right.columns if c not in (on, *by)]
    payload = F.struct(F.col(on).alias("at"), *values)
    keys = [F.col(c) for c in by]
    both = left.select(*keys, F.col(on), F.lit(1).alias("_side"), F.struct(*left.columns).alias("_row"), F.lit(None).cast(right.select(payload.alias("p")).schema["p"].dataType).alias("_r"))
    both = both.unionByName(right.select(*keys, F.col(on), F.lit(0).alias("_side"), F.lit(None).cast(both.schema["_row"].dataType).alias("_row"), payload.alias("_r")))
    w = Window.partitionBy(*by).orderBy(on, "_side")
    back = F.last("_r", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    ahead = F.first("_r", ignorenulls=True).over(w.rowsBetween(0, Window.unboundedFollowing))
    found = both.withColumns({"_b": back, "_a": ahead}).where("_side = 1")
    pick = F.when(F.col("_b").isNull(), F.col("_a")).when(F.col("_a").isNull(), F.col("_b")).when(
        (F.col(on) - F.col("_b.at")) <= (F.col("_a.at") - F.col(on)), F.col("_b")
    ).otherwise(F.col("_a"))
    out = found.withColumn("_p", pick)
    return out.select("_row.*", F.col("_p.at").alias(f"nearest_{on}"), *[F.col(f"_p.{c}").alias(f"nearest_{c}") for c in values])
