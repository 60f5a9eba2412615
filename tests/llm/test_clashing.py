"""Extra columns with the names that operators use themselves, and empty tables."""

import pytest
from pyspark.sql import functions as F

from helixframe.llm import html_text, jaccard_join, line_dedup, mixing, quality, sharding, topk, toxicity, url_filter

#: Beside these, names with a dot and in another case than an operator's own.
ODD = ("a.b", "IDS", "Bytes", "GRADE")
NAMES = (
    "row doc hash lines dropped row_hash h h1 h2 one n_docs keeper key place arc on lo hi slot0 inner rank before run t0 t1 w t joined measured at pairs "
    "sorted repeats host_ path_ by_host ref good pages s b bucket offset end start stop block n times a k1 k2 words pieces most pass first wanted drawn "
    "blocks cell shard_ slot_ node near far d diff size_ text_ chosen grown _d _h _dropped _lines _row _arc _from _to _sarc _rank _place _s _bucket _q_w _by_host"
).split()


@pytest.fixture
def wide(spark):
    rows = [(k, f"A line that many documents hold here.\nalpha beta number {k}, and more words to read", "ab"[k % 2], f"https://h{k % 3}.example.com/en/{k}.html") for k in range(12)]
    df = spark.createDataFrame([*rows, (None, None, None, None), (3, "", "a", "")], "doc_id long, text string, source string, url string")
    return df.select("*", *[F.concat(F.lit(f"{c}="), F.coalesce(F.col("doc_id").cast("string"), F.lit("-"))).alias(c) for c in NAMES])


def runs(spark, df):
    labels = spark.createDataFrame([(k, k % 2, (k + 1) % 2) for k in range(12)], "doc_id long, quality int, toxic int")
    sized = df.withColumn("size", mixing.size_of(F.col("text")))
    return {
        "line_dedup": (df, line_dedup.dedup_lines(df), {"text"}),
        "quality": (df, quality.quality_rules(df), set()),
        "sharding": (df, sharding.shard_rows(df, "doc_id", 3, ["text", "source"]), set()),
        "mix_amounts": (sized, mixing.mix_amounts(sized, ["doc_id", "text"], block_words=4), set()),
        "mix_documents": (df, mixing.mix_documents(df, block_words=4), {"text"}),
        "url_filter": (df, url_filter.filter_urls(df, labels, [("allow", "com", "/")]), set()),
        "html_text": (df.withColumn("html", F.col("text")), html_text.extract(df.withColumn("html", F.col("text"))), {"text", "html"}),
        "toxicity": (df, toxicity.grade(df, toxicity.train(df, labels)), set()),
    }


def test_other_columns_stay_as_they_were(spark, wide):
    for name, (given, out, changed) in runs(spark, wide).items():
        stays = [c for c in given.columns if c not in changed]
        assert len(out.columns) == len(set(out.columns)) and set(stays) <= set(out.columns), name
        want, got = ({tuple(r) for r in df.select(*[f"`{c}`" for c in stays]).collect()} for df in (given, out))
        assert got <= want and (name == "mix_documents" or got == want), name


def test_names_in_other_cases_and_replaced_columns(spark):
    df = spark.createDataFrame([(1, "one two", "a", 5, 6)], "doc_id long, text string, source string, N_LINES int, Shard int")
    assert line_dedup.dedup_lines(df).columns == ["doc_id", "text", "source", "Shard", "n_lines", "n_dropped"]
    assert sharding.shard_rows(df, "doc_id", 2, ["text"]).columns == ["doc_id", "text", "source", "N_LINES", "shard", "slot", "home_shard"]


def test_empty_tables(spark, wide):
    for name, (_, out, _) in runs(spark, wide.limit(0)).items():
        assert out.count() == 0, name
    assert jaccard_join.near_duplicates(wide.limit(0)).count() == 0
    vectors = spark.createDataFrame([], "vec_id long, v array<long>")
    assert topk.exact_top_k(vectors, vectors, 3).count() == 0


def test_the_join_passes_over_other_columns(wide):
    plain = wide.select("doc_id", "text")
    rows = [sorted((tuple(r) for r in jaccard_join.near_duplicates(df, 3, 90, 100).collect()), key=repr) for df in (wide, plain)]
    assert rows[0] == rows[1]


def test_dots_and_other_cases_in_names(spark):
    import public_tokenizers

    from helixframe.llm import bpe

    rows = [(k, f"alpha beta number {k}", f"<p>alpha, beta. number {k}</p>") for k in range(12)]
    df = spark.createDataFrame(rows, "doc_id long, text string, html string").select("*", *[F.lit(c).alias(c) for c in ODD])
    labels = spark.createDataFrame([(k, k % 2, (k + 1) % 2) for k in range(12)], "doc_id long, quality int, toxic int")
    shared = bpe.share(spark, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
    coded = bpe.encode(df, shared)
    cases = {"encode": (coded, {"ids"}), "decode": (bpe.decode(coded, shared), {"ids", "bytes"}), "html": (html_text.extract(df), {"text", "html"}), "grade": (toxicity.grade(df, toxicity.train(df, labels)), {"grade"})}
    for name, (out, own) in cases.items():
        assert len({c.lower() for c in out.columns}) == len(out.columns), name
        for row in out.collect():
            assert all(row[c] == c for c in ODD if c.lower() not in own), name
    assert all(bytes(r["bytes"]).decode() == r["text"] for r in cases["decode"][0].collect())
