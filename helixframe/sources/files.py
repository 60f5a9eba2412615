"""Text sources: summary statistics, LD scores, latent dumps, image manifests."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Columns of an LD score file that are no annotations.
RESERVED = ("CHR", "SNP", "BP", "CM", "MAF")


def read_sumstats(spark: SparkSession, path: str) -> DataFrame:
    """Tab-separated ``SNP, N, Z`` and, if there, ``A1, A2`` (plain or gzip); a missing column raises. Null Z stays."""
    df = spark.read.csv(path, sep="\t", header=True)
    absent = [c for c in ("SNP", "N", "Z") if c not in df.columns]
    if absent:
        raise ValueError(f"{path} lacks {', '.join(absent)}")
    alleles = [c for c in ("A1", "A2") if c in df.columns]
    return df.select("SNP", *alleles, F.col("N").cast("double").alias("N"), F.col("Z").cast("double").alias("Z"))


def read_ldscores(spark: SparkSession, prefix: str, chroms: list[int]) -> tuple[DataFrame, list[float]]:
    """LD scores of all chromosomes and, per annotation, the number of SNPs behind them."""
    df = None
    for c in chroms:
        one = spark.read.csv(f"{prefix}{c}.l2.ldscore.gz", sep="\t", header=True)
        df = one if df is None else df.unionByName(one)
    annotations = [c for c in df.columns if c not in RESERVED]
    counts = spark.read.text([f"{prefix}{c}.l2.M_5_50" for c in chroms]).where(F.trim("value") != "")
    parts = counts.select(F.posexplode(F.split(F.trim("value"), "\\s+")).alias("at", "m"))
    m = [r["m"] for r in parts.groupBy("at").agg(F.sum(F.col("m").cast("double")).alias("m")).orderBy("at").collect()]
    return df.select("SNP", *[F.col(c).cast("double").alias(c) for c in annotations]), m


def single_annotation(df: DataFrame) -> str:
    names = [c for c in df.columns if c not in RESERVED]
    if len(names) != 1:
        raise ValueError(f"weights need exactly one annotation, not {len(names)}")
    return names[0]


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """Headerless ``sample_id, path``."""
    return spark.read.csv(path, sep="\t", schema="sample_id long, path string")


def read_latents(spark: SparkSession, pattern: str) -> DataFrame:
    """``epoch, split, row, z array<double>`` of text dumps ``Zm_<split>.<epoch>.txt``, rows numbered from 0 in each.

    Epochs without both splits are left out; if none is left it raises.
    """
    name = F.col("_metadata.file_name")
    lines = spark.read.text(pattern).select(
        F.regexp_extract(name, "Zm_(train|val)\\.([0-9]+)\\.txt$", 1).alias("split"),
        F.regexp_extract(name, "Zm_(train|val)\\.([0-9]+)\\.txt$", 2).try_cast("int").alias("epoch"),
        F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at"), "value",
    ).where("split <> ''")
    both = lines.groupBy("epoch").agg(F.countDistinct("split").alias("k")).where("k = 2").select("epoch")
    if both.isEmpty():
        raise ValueError(f"{pattern} has no epoch with both splits")
    # Lines of one block of a file are read in order by one task; blocks are ordered by where they start.
    row = F.row_number().over(Window.partitionBy("epoch", "split").orderBy("block", "at")) - 1
    lines = lines.withColumn("row", row.cast("long"))
    z = F.transform(F.split(F.trim("value"), "\\s+"), lambda x: x.cast("double"))
    return lines.join(both, "epoch", "left_semi").select("epoch", "split", "row", z.alias("z"))


def write_latents(df: DataFrame, path: str) -> None:
    """Latents as Parquet by epoch and split."""
    df.write.mode("overwrite").partitionBy("epoch", "split").parquet(path)


def read_lines(spark: SparkSession, path: str) -> list[str]:
    """The lines of a small text file that are not blank, stripped; for lists of column names."""
    return [r["value"].strip() for r in spark.read.text(path, wholetext=False).collect() if r["value"].strip()]


def read_weights(spark: SparkSession, path: str) -> DataFrame:
    """``dim, weight`` from one number a line."""
    return spark.createDataFrame([(k, float(x)) for k, x in enumerate(read_lines(spark, path))], "dim int, weight double")


#: Columns of a comparison table.
COMPARISON = ("rank", "raw_h2", "theoretical_h2", "empirical_h2", "empirical_h2_se")


def read_comparison(spark: SparkSession, pattern: str) -> DataFrame:
    """The last of the tab-separated comparison tables in order of their names; a missing column raises."""
    files = spark.read.csv(pattern, sep="\t", header=True).select(F.col("_metadata.file_path").alias("f"))
    last = files.agg(F.max("f")).first()[0]
    if last is None:
        raise ValueError(f"{pattern} has no rows")
    df = spark.read.csv(last, sep="\t", header=True)
    absent = [c for c in COMPARISON if c not in df.columns]
    if absent:
        raise ValueError(f"{last} lacks {', '.join(absent)}")
    return df.select(F.col("rank").cast("int").alias("rank"), *[F.col(c).cast("double").alias(c) for c in COMPARISON[1:]])


def latest_checkpoint(spark: SparkSession, folder: str) -> tuple[int, str] | None:
    """Epoch and path of the newest ``weights.<epoch>.pt``; the files are listed, not read."""
    listing = spark.read.format("binaryFile").option("pathGlobFilter", "weights.*.pt").load(folder).select("path")
    epoch = F.regexp_extract("path", "weights\\.([0-9]+)\\.pt$", 1).try_cast("int")
    row = listing.select(epoch.alias("epoch"), "path").where("epoch IS NOT NULL").agg(F.max(F.struct("epoch", "path")).alias("m")).first()["m"]
    return (row["epoch"], row["path"]) if row else None


def write_split_ids(split: DataFrame, path: str) -> None:
    split.select("sample_id", "part").write.mode("overwrite").parquet(path)


def read_split_ids(spark: SparkSession, path: str) -> DataFrame:
    """``sample_id, part`` as written by ``write_split_ids``."""
    return spark.read.schema("sample_id long, part string").parquet(path)
