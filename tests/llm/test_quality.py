from collections import Counter

from helixframe.llm import quality


def brute(text):
    text = text or ""
    w = text.replace("\t", " ").replace("\n", " ").replace("\r", " ").replace("\x0b", " ").replace("\x0c", " ").split(" ")
    w = [x for x in w if x]
    windows = [tuple(w[i: i + 8]) for i in range(len(w) - 7)]
    counts = Counter(windows)
    covered = {i + k for i, x in enumerate(windows) if counts[x] > 1 for k in range(8)}
    lines = [x for x in text.split("\n") if x.strip(" \t\n\x0b\x0c\r")]
    joined = "".join(w)
    base = len(w) < 20 or 100 * len(covered) > 30 * len(w)
    return (len(w), len(joined), sum(c in "#*$%&|<>" for c in joined), len(lines) - len(set(lines)), len(covered), base)


def test_measures_against_brute_force(spark, docs):
    phrase = "one two three four five six seven eight nine"
    more = [(20, f"{phrase} x {phrase} y {phrase}"), (21, phrase), (22, " ".join("ab" * 4)), (23, "a b " * 20), (24, "x\n\ny\nx\n \nx\t"), (25, "# $ %% ok|ok")]
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()] + more
    got = quality.quality_rules(spark.createDataFrame(rows, "doc_id long, text string"), plan=[])
    seen = {(r["doc_id"], r["text"]): tuple(r[c] for c in (*quality.MEASURES, "base_failed")) for r in got.select("doc_id", *quality.MEASURES, "base_failed", "text").collect()} if "text" in got.columns else None
    assert seen
    for i, t in rows:
        assert seen[i, t] == brute(t), (i, t and t[:40])


def test_cascade_orders_by_rejections_per_cost_and_verdict_does_not_depend_on_it(spark):
    good = "The report describes how the team moved the archive to a new building over two quiet summer months, and why it matters today."
    rows = [(k, good + f" Number {k}.") for k in range(60)] + [(100 + k, "BUY NOW!! " * 30 + str(k) + " ok" * 5) for k in range(30)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    plan = quality.plan_cascade(df)
    assert [x["selectivity"] / x["cost"] for x in plan] == sorted((x["selectivity"] / x["cost"] for x in plan), reverse=True)
    one = {r["doc_id"]: r["kept"] for r in quality.quality_rules(df, plan=plan).collect()}
    two = {r["doc_id"]: r["kept"] for r in quality.quality_rules(df, plan=plan[::-1]).collect()}
    assert one == two
    assert all(one[k] for k in range(60)) and not any(one[100 + k] for k in range(30))


def test_empty_and_clashing(docs):
    assert quality.quality_rules(docs.limit(0)).count() == 0
    clash = docs.withColumnRenamed("size", "n_words").withColumnRenamed("source", "kept")
    assert quality.quality_rules(clash).count() == docs.count()
    assert "Python" not in quality.quality_rules(docs, plan=[])._jdf.queryExecution().toString()


def test_a_filter_on_the_verdict_does_not_write_the_measures_out_again(spark, docs):
    judged = quality.quality_rules(docs)
    plain, filtered = (d._jdf.queryExecution().optimizedPlan().toString() for d in (judged, judged.where("kept")))
    for call in ("xxhash64(", "split("):
        assert filtered.count(call) == plain.count(call) <= 4


def test_the_plan_comes_from_one_pass_over_the_sample(docs):
    plan = quality.plan_cascade(docs)
    assert plan == quality.plan_cascade(docs) and all(x["cost"] >= quality.COMPARISON and 0 <= x["selectivity"] <= 1 for x in plan)
    assert quality.plan_cascade(docs.limit(0)) and quality.plan_cascade(docs.limit(0))[0]["selectivity"] == 0
