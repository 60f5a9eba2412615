"""Line-level deduplication across a corpus, with built-in functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, quoted, staged, strip, unpacked


def line_key(line: Column) -> Column:
    """A line without white space at its ends, A-Z lower-cased."""
    return ascii_lower(strip(line))


def repeated_lines(docs: DataFrame, min_chars: int = 20, min_docs: int = 3) -> DataFrame:
    """Positions of the lines to drop: one row ``doc_id, row_hash, dropped array<int>`` for each document that loses any.

    Lines are exploded with their positions; only 128 hash bits of a key travel. Distinct documents per key are
    counted with partial aggregation on both sides of a (key, document) shuffle, so a line in a third of all
    documents never meets in one task. The join back is a plain equi-join whose hot keys adaptive execution splits.
    """
    # The same (doc_id, text) row twice is one document here, so its positions are the same.
    lines = docs.select(
        "doc_id",
        F.xxhash64("text").alias("row_hash"),
        F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("pos", "line"),
    )
    keyed = lines.select("doc_id", "row_hash", "pos", line_key(F.col("line")).alias("key")).where(
        (F.char_length("key") >= min_chars) & F.col("doc_id").isNotNull()
    )
    hashed = keyed.select("doc_id", "row_hash", "pos", F.xxhash64("key").alias("h1"), F.xxhash64(F.lit(7), "key", F.lit(1)).alias("h2"))
    common = (
        hashed.groupBy("h1", "h2", "doc_id").agg(F.lit(1).alias("one"))
        .groupBy("h1", "h2").agg(F.count("*").alias("n_docs"), F.max("doc_id").alias("keeper"))
        .where(F.col("n_docs") >= min_docs).select("h1", "h2", "keeper")
    )
    # Written first, so that both sides of the join are plain shuffles, which adaptive execution can split.
    drops = hashed.join(staged(common), ["h1", "h2"]).where(F.col("doc_id") != F.col("keeper"))
    return drops.groupBy("doc_id", "row_hash").agg(F.collect_set("pos").alias("dropped"))


def dedup_lines(docs: DataFrame, min_chars: int = 20, min_docs: int = 3) -> DataFrame:
    """Drop lines that many documents share, except in the largest ``doc_id`` that holds them.

    ``docs`` needs ``doc_id, text``; all its columns stay, ``text`` is replaced by the kept lines joined by ``\\n``,
    and ``n_lines, n_dropped`` (long) are added (columns of these names are replaced). A key counts once per
    document however often it stands there, and a document that loses it loses every such line.

    Null or empty text: one empty line, kept (text comes out empty). A null ``doc_id`` counts for no key and loses
    nothing. Repeated rows of one ``doc_id`` count as one document. Empty table: empty result.
    """
    drops = repeated_lines(docs, min_chars, min_docs)
    # The text travels once, as its lines.
    rest = docs.select(*[F.col(quoted(c)) for c in docs.columns if c.lower() not in ("text", "n_lines", "n_dropped")])
    split = docs.select(
        F.struct(*[F.col(quoted(c)) for c in rest.columns]).alias("row"), F.col("doc_id").alias("doc"), F.xxhash64("text").alias("hash"),
        F.split(F.coalesce("text", F.lit("")), "\n").alias("lines"),
    )
    both = split.join(drops, (F.col("doc") == F.col("doc_id")) & (F.col("hash") == F.col("row_hash")), "left")
    # array_except hashes, so a long document costs time in proportion to its lines; lines comes from below the
    # join and is not split again for each element.
    kept = F.transform(F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), F.col("dropped")), lambda i: F.get("lines", i))
    out = unpacked(
        both,
        text=F.array_join(F.when(F.col("dropped").isNull(), F.col("lines")).otherwise(kept), "\n"),
        n_lines=F.size("lines").cast("long"),
        n_dropped=F.coalesce(F.size("dropped"), F.lit(0)).cast("long"),
    )
    names = [c for c in docs.columns if c.lower() not in ("n_lines", "n_dropped")]
    return out.select(*map(quoted, names), "n_lines", "n_dropped")
