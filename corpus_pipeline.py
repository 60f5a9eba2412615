"""A corpus pipeline: quality rules, line dedup, near-duplicate join, mixing to target weights, byte-level BPE.

Each stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame; ``run`` writes it as Parquet under the shared
checkpoint folder and reads it again as the next stage's documents. Counted as part of the ``llm`` subpackage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from helixframe.llm import bpe, jaccard_join, line_dedup, mixing, quality
from helixframe.llm.common import packed, quoted, staged, table, unstage


def drop_low_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality cascade keeps; columns as they were."""
    return quality.quality_rules(docs).where("kept").select(*map(quoted, docs.columns))


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines of 20 characters or more that three documents share stay in one of them; ``n_chars``, if there, follows the text."""
    out = line_dedup.dedup_lines(docs).select(*map(quoted, docs.columns))
    return out.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group under five-word Jaccard similarity of 0.8: the one with the least ``doc_id``.

    Rows of one id with different texts are judged separately. Of rows with the same id and text one stays, the least by
    its other columns; of those without words only full repeats go. Rows with a null ``doc_id`` all stay.
    """
    found = jaccard_join.near_duplicates(docs, words=5, num=80, den=100)
    # Ids and text hashes only. A text without a link is its own component.
    first = found.where("component_id = doc_id AND component_th = th")
    kept = staged(first.groupBy("doc_id", "th").agg(F.count("*").alias("k"), F.first("n_shingles").alias("n_shingles")))
    hashed = packed(docs, doc_id=F.col("doc_id"), text=F.col("text"), th=F.xxhash64("text"))

    def rows(which: str) -> DataFrame:
        return hashed.join(kept.where(which).select("doc_id", "th"), ["doc_id", "th"], "left_semi")

    out = docs.where("doc_id IS NULL")
    if kept.where("k > 1").isEmpty():
        return out.union(rows("true").select("row.*"))
    copies = rows("k > 1 AND n_shingles > 0").groupBy("doc_id", "text").agg(F.min("row").alias("row")).select("row.*")
    return out.union(rows("k = 1").select("row.*")).union(copies).union(rows("k > 1 AND n_shingles = 0").select("row.*").distinct())


def mix_to_weights(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix of sources: a row for each pass over a document, with the words taken then."""
    return mixing.mix_documents(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``doc_id, n_tokens, ids_sha256, decoded_sha256`` for each row of the mix."""
    import public_tokenizers

    shared = bpe.share(spark, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
    return bpe.round_trip(docs, shared)


STAGES = [
    ("quality_rules", drop_low_quality),
    ("line_dedup", drop_repeated_lines),
    ("jaccard_join", drop_near_duplicates),
    ("mixing", mix_to_weights),
    ("byte_bpe", encode),
]

#: The mix draws by Spark's own hashes, which SQL elsewhere does not have; tests hold it to a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        out = staged(stage(spark, docs, sf_dir))
        # Nothing reads a stage's input any more; the table that run() was given stays.
        unstage(docs)
        docs = out
    return docs
