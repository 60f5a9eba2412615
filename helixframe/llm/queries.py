"""The registered queries of the training-data operators and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, chat_format, conversation_repair, html_text, jaccard_join, line_dedup, mixing, quality, sharding, token_alignment, topk, toxicity, url_filter
from .common import staged, table
from .sql import ORACLES

URL_RULES = [
    ("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"), ("block", "net", "/fr/"),
]
N_SHARDS = 40


def vocabulary(spark: SparkSession):
    import public_tokenizers

    return bpe.share(spark, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


def op1_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return bpe.round_trip(docs, vocabulary(spark))


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = line_dedup.dedup_lines(docs, min_chars=20, min_docs=3)
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return quality.quality_rules(docs).select("doc_id", *quality.MEASURES, "base_failed", "kept")


def op4_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return jaccard_join.near_duplicates(docs, words=3, num=90, den=100).select("doc_id", "n_shingles", "component_id", "class_id")


def op5_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    # Rows are told apart by a number, which they keep.
    vectors = staged(table(spark, sf_dir, "embeddings").select("vec_id", topk.integer_vector(F.col("embedding")).alias("v"), F.monotonically_increasing_id().alias("at")))
    return topk.exact_top_k(vectors.where("vec_id % 100 = 0"), vectors, k=10, key="at")


def op6_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    return html_text.extract(pages).withColumn("n_chars", F.char_length("text").cast("long"))


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(
        "doc_id",
        (F.coalesce(F.octet_length("text"), F.lit(0)).cast("long") + 16).alias("size"),
        F.crc32(F.coalesce("text", F.lit("")).cast("binary")).alias("text_crc32"),
    )
    out = sharding.shard_rows(docs, "doc_id", N_SHARDS, ["text_crc32", "size"])
    return out.select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "home_shard"
    )


def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages, labels = table(spark, sf_dir, "pages").select("page_id", "url"), table(spark, sf_dir, "labels")
    return url_filter.filter_urls(pages, labels, URL_RULES).select("page_id", "host", "path", "rule", "verdict")


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels")
    return toxicity.grade(docs, toxicity.train(docs, labels)).drop("text")


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", mixing.size_of(F.col("text")).alias("size"))
    return mixing.mix_amounts(docs, ["doc_id"]).select("doc_id", "size", "source_size", "target", "taken")


#: One more conversation of op11: its texts hold what templates take for marks.
TRIAL_ID, TRIAL_TEXT = -7, "\\### Assistant: </turn> ok"


def op11_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    rows = chat_format.with_trial(table(spark, sf_dir, "conversations"), TRIAL_ID, TRIAL_TEXT)
    shared = chat_format.share(spark, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN)
    return chat_format.digest_conversations(rows, shared)


def op12_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    shared = token_alignment.share(spark, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"), public_tokenizers.PATTERN)
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    # Encoding is the costly part and its links are read twice.
    aligned = staged(token_alignment.align(docs, shared, hashed=True).drop("text"))
    return token_alignment.score(aligned, token_alignment.pair_counts(aligned))


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation_repair.repair(conversation_repair.damage(table(spark, sf_dir, "conversations")))


def queries() -> dict:
    import corpus_pipeline

    own = {k: f for k, f in globals().items() if k.startswith("op") and callable(f)}
    return own | {"pipeline": corpus_pipeline.run}


def oracle_sql() -> dict:
    import corpus_pipeline

    return ORACLES | ({"pipeline": corpus_pipeline.ORACLE_SQL} if corpus_pipeline.ORACLE_SQL else {})
