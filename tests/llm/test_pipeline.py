import corpus_pipeline as P
from helixframe.llm.common import staged

from .test_jaccard_join import brute as groups
from .test_line_dedup import brute as lines
from .test_quality import brute as measures


def test_stages_against_brute_force(spark, tmp_path):
    good = "The report {k} describes how the team moved archive {k} to a new building over two quiet summer months and why that matters for readers {k} today."
    shared = "This notice is printed under every text here."
    texts = [good.format(k=k) + "\n" + shared for k in range(12)] + [good.format(k=3) + " Also.", "too short", None, "", "NO!! " * 40]
    rows = [(k, t, "en", f"s{k % 3}", len(t or "")) for k, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars int")
    df.write.parquet(f"{tmp_path}/documents.parquet")
    stage = dict(P.STAGES)
    one = staged(stage["quality_rules"](spark, df, ""))
    kept = sorted((r["doc_id"], r["text"]) for r in one.collect())
    assert one.columns == df.columns and [i for i, _ in kept] == list(range(13)) and not any(measures(t)[-1] for _, t in kept)
    two = staged(stage["line_dedup"](spark, one, ""))
    assert sorted((r["doc_id"], r["text"]) for r in two.collect()) == sorted((i, t) for i, _, _, t in lines(kept))
    three = staged(stage["jaccard_join"](spark, two, ""))
    want = {c for _, _, c in groups([(r["doc_id"], r["text"]) for r in two.collect()], 5, 80, 100)}
    assert sorted(r["doc_id"] for r in three.collect()) == sorted(want)
    four = staged(stage["mixing"](spark, three, ""))
    assert four.columns == df.columns and {r["doc_id"] for r in four.collect()} <= want
    total = sum(len(r["text"].split()) for r in three.collect())
    assert abs(sum(len(r["text"].split()) for r in four.collect()) - 1.5 * total) <= 32 * 3
    out = P.run(spark, str(tmp_path)).collect()
    assert len(out) == four.count() and all(r["n_tokens"] > 0 for r in out)


def test_near_duplicates_keeps_rows_without_an_id_and_every_text_of_an_id(spark):
    def text(k, end=""):
        return " ".join(f"w{k}x{j}" for j in range(60)) + end

    rows = [
        (1, text(1), "en", "a", 1), (2, text(1, " more"), "en", "b", 2),  # a near copy of row 1
        (2, text(2), "en", "b", 3), (2, text(3), "en", "c", 4),  # the same id, texts without a copy
        (4, text(4), "en", "b", 5), (4, text(4), "en", "a", 6), (4, text(4), "en", "a", 6),  # one text of one id
        (5, None, "en", "a", 7), (5, None, "en", "a", 7), (5, "", "en", "a", 0), (5, None, "en", "b", 8),
        (None, text(1), "en", "a", 9), (None, text(1), "en", "a", 9), (None, None, "en", "a", 10),
    ]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars int").repartition(3)
    want = [rows[k] for k in (0, 2, 3, 5, 7, 9, 10, 11, 12, 13)]
    got = P.drop_near_duplicates(spark, df, "")
    assert got.columns == df.columns and sorted(map(tuple, got.collect()), key=repr) == sorted(want, key=repr)


def test_stages_on_an_empty_table_and_with_extra_columns(spark):
    df = spark.createDataFrame([], "doc_id long, text string, source string")
    for name, stage in P.STAGES:
        out = stage(spark, df, "")
        assert out.count() == 0, name
    text = "The report describes how the team moved the archive to a new building over two quiet summer months and why that matters for readers today."
    rows = [(k, text + f" Number {k} of them.", "a", f"x{k}", f"y{k}", f"z{k}") for k in range(6)]
    wide = spark.createDataFrame(rows, "doc_id long, text string, source string, row string, th string, lines string")
    docs = wide
    for name, stage in P.STAGES[:-1]:
        docs = staged(stage(spark, docs, ""))
        assert docs.columns == wide.columns, name
    assert {(r["row"], r["th"], r["lines"]) for r in docs.collect()} <= {(r["row"], r["th"], r["lines"]) for r in wide.collect()}
