"""Cohort tables derived from the star schema: who is a sample, what is a variant, a trait, a covariate.

A customer with an embedding is a sample; a brand is a variant whose dosage is how often (0, 1, 2 or more) the customer
bought it; embedding components are latent traits.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Components of an embedding; each is a latent trait.
DIMS = 64


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``sample_id``: ids of customers that have an embedding."""
    customers = table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("long").alias("sample_id"))
    vectors = table(spark, sf_dir, "embeddings").select(F.col("vec_id").cast("long").alias("sample_id"))
    return customers.intersect(vectors)


def variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``variant_idx, brand, chrom`` of the brands that parts have."""
    number = F.regexp_extract("p_brand", "([0-9]+)$", 1).cast("int")
    found = table(spark, sf_dir, "part").select("p_brand", number.alias("chrom")).distinct()
    return found.select((F.col("chrom") - 1).alias("variant_idx"), F.col("p_brand").alias("brand"), "chrom")


def n_variants(spark: SparkSession, sf_dir: str) -> int:
    """A brand's number is its chromosome, its index one less: the panel is as long as the largest number."""
    return variants(spark, sf_dir).agg(F.max("chrom")).first()[0] or 0


def dosage(spark: SparkSession, sf_dir: str, missing: bool = False) -> DataFrame:
    """``sample_id, variant_idx, x``: dosages 0, 1, 2 of every sample at every variant.

    With ``missing``, x is null where ``(31 * sample + 17 * brand number) % 20 = 0``.
    """
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey")
    orders = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_custkey").cast("long").alias("sample_id"))
    parts = table(spark, sf_dir, "part").select("p_partkey", F.regexp_extract("p_brand", "([0-9]+)$", 1).cast("int").alias("chrom"))
    who = samples(spark, sf_dir)
    bought = (
        lines.join(orders.join(who, "sample_id", "left_semi"), F.col("l_orderkey") == F.col("o_orderkey"))
        .join(parts, F.col("l_partkey") == F.col("p_partkey"))
        .groupBy("sample_id", "chrom").agg(F.count("*").alias("k"))
    )
    # A dense panel: every sample has a value at each variant.
    panel = who.withColumn("variant_idx", F.explode(F.sequence(F.lit(0), F.lit(max(n_variants(spark, sf_dir) - 1, 0)))))
    x = F.least(F.coalesce("k", F.lit(0)), F.lit(2)).cast("int")
    if missing:
        x = F.when((31 * F.col("sample_id") + 17 * F.col("chrom")) % 20 != 0, x)
    return panel.withColumn("chrom", F.col("variant_idx") + 1).join(bought, ["sample_id", "chrom"], "left").select("sample_id", "variant_idx", x.alias("x"))


def latents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``sample_id, z0, z1, ...``: the components of each sample's embedding."""
    vectors = table(spark, sf_dir, "embeddings").select(F.col("vec_id").cast("long").alias("sample_id"), "embedding")
    return vectors.join(samples(spark, sf_dir), "sample_id", "left_semi").select(
        "sample_id", *[F.get("embedding", F.lit(k)).cast("double").alias(f"z{k}") for k in range(DIMS)]
    )


def covariates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``sample_id, c0, c1``: account balance (in ten thousands) and region."""
    customers = table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("long").alias("sample_id"), "c_nationkey", (F.col("c_acctbal").cast("double") / 10000).alias("c0"))
    nations = table(spark, sf_dir, "nation").select("n_nationkey", F.col("n_regionkey").cast("double").alias("c1"))
    return customers.join(F.broadcast(nations), F.col("c_nationkey") == F.col("n_nationkey")).join(samples(spark, sf_dir), "sample_id", "left_semi").select("sample_id", "c0", "c1")


def target(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``sample_id, y``: mean order price, in hundred thousands; null without orders."""
    price = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").cast("long").alias("sample_id")).agg((F.avg(F.col("o_totalprice").cast("double")) / 100000).alias("y"))
    return samples(spark, sf_dir).join(price, "sample_id", "left")
