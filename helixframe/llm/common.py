"""Helpers shared by the training-data operators."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: ASCII white space, U+0020 and U+0009 to U+000D (Java's ``\\s`` is the same set).
WHITE = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(col: Column) -> Column:
    """Lower-case A-Z and nothing else. Pure ASCII takes the fast built-in."""
    return F.when(F.octet_length(col) == F.char_length(col), F.lower(col)).otherwise(F.translate(col, UPPER, LOWER))


def strip(col: Column) -> Column:
    """Without ASCII white space at both ends."""
    return F.btrim(col, F.lit(WHITE))


def words(text: Column) -> Column:
    """Array of the ``[^\\x20\\x09-\\x0D]+`` runs of a text; null gives an empty array."""
    inner = strip(F.coalesce(text, F.lit("")))
    return F.when(inner == "", F.array().cast("array<string>")).otherwise(F.split(inner, "\\s+"))


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def packed(df: DataFrame, **own: Column) -> DataFrame:
    """All columns of a table as one struct ``row`` beside an operator's own columns, so that no names clash."""
    return df.select(F.struct(*[F.col(quoted(c)) for c in df.columns]).alias("row"), *[e.alias(k) for k, e in own.items()])


def unpacked(df: DataFrame, without: tuple[str, ...] = (), **added: Column) -> DataFrame:
    """The columns of ``row`` as they were, but for those left out or replaced, and the added ones after them."""
    gone = {x.lower() for x in (*without, *added)}
    names = [n for n in df.schema["row"].dataType.names if n.lower() not in gone]
    # Two steps: beside an alias of the same name, a column in a lambda would be taken for that alias.
    both = df.select("row", F.struct(*[e.alias(k) for k, e in added.items()]).alias("added")) if added else df.select("row")
    return both.select(*[F.col("row").getField(n).alias(n) for n in names], *[F.col("added").getField(k).alias(k) for k in added])


def running_sum(df: DataFrame, by: list[str], order: str, value: str, out: str, fan: int = 1024) -> DataFrame:
    """Add ``out``: the sum of ``value`` over the rows of ``by`` that come before by ``order`` (a whole number, one row each).

    Rows are summed in runs of ``fan`` numbers, runs are summed in order, and then within each run: no task sees more than
    ``fan`` rows of a group, or one row for each of its runs. Columns of ``by`` may be null.
    """
    df = df.withColumn("_run", F.floor(F.col(order) / fan))
    earlier = Window.partitionBy(*by).orderBy("_run").rowsBetween(Window.unboundedPreceding, -1)
    runs = df.groupBy(*by, "_run").agg(F.sum(value).alias("_n"))
    runs = runs.select(*[F.col(c).alias(f"_by{k}") for k, c in enumerate(by)], F.col("_run").alias("_r"), F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"))
    inside = Window.partitionBy(*by, "_run").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    same = F.col("_run") == F.col("_r")
    for k, c in enumerate(by):
        same = same & F.col(c).eqNullSafe(F.col(f"_by{k}"))
    summed = df.withColumn("_inside", F.coalesce(F.sum(value).over(inside), F.lit(0))).join(runs, same)
    return summed.withColumn(out, (F.col("_before") + F.col("_inside")).cast("long")).select(*df.drop("_run").columns, out)


def scratch_dir(spark: SparkSession) -> str:
    """A new folder under ``spark.checkpoint.dir``, which every node can reach; a local one only where that is unset."""
    top = spark.conf.get("spark.checkpoint.dir", None)
    if not top:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all nodes share")
        top = tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("spark.checkpoint.dir", top)
    return f"{top.rstrip('/')}/{uuid.uuid4().hex}"


def staged(df: DataFrame) -> DataFrame:
    """Write a table to the shared folder and read it again: lineage ends there, and a lost executor costs nothing."""
    spark, path = df.sparkSession, scratch_dir(df.sparkSession)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._staged_at = path
    return out


def unstage(df: DataFrame) -> None:
    """Delete a staged table that nothing reads any more."""
    path = getattr(df, "_staged_at", None)
    if path:
        jvm = df.sparkSession._jvm
        at = jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(at, True)
