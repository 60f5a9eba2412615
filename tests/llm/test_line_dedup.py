import re

from helixframe.llm import line_dedup


def key(line):
    line = line.strip(" \t\n\x0b\x0c\r")
    return re.sub("[A-Z]", lambda m: m[0].lower(), line)


def brute(rows, min_chars=20, min_docs=3):
    holders = {}
    for i, text in rows:
        for line in (text or "").split("\n"):
            if i is not None and len(key(line)) >= min_chars:
                holders.setdefault(key(line), set()).add(i)
    out = []
    for i, text in rows:
        lines = (text or "").split("\n")
        gone = [i is not None and len(holders.get(key(x), ())) >= min_docs and i != max(holders[key(x)]) for x in lines]
        out.append((i, len(lines), sum(gone), "\n".join(x for x, g in zip(lines, gone) if not g)))
    return sorted(out, key=repr)


def test_against_brute_force(docs):
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    got = line_dedup.dedup_lines(docs)
    assert got.columns == ["doc_id", "source", "size", "text", "n_lines", "n_dropped"] or set(got.columns) == {*docs.columns, "n_lines", "n_dropped"}
    assert sorted(((r["doc_id"], r["n_lines"], r["n_dropped"], r["text"]) for r in got.collect()), key=repr) == brute(rows)


def test_unicode_case_is_kept_apart(spark):
    a, b = "ÄRGER IST EINE LANGE ZEILE", "ärger ist eine lange zeile"
    rows = [(1, a), (2, a.replace("IST", "ist")), (3, b), (4, "\t" + a + " ")]
    got = line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted(((r["doc_id"], r["n_lines"], r["n_dropped"], r["text"]) for r in got.collect()), key=repr) == brute(rows)


def test_empty_and_clashing_columns(docs):
    assert line_dedup.dedup_lines(docs.limit(0)).count() == 0
    clash = docs.withColumnRenamed("size", "n_lines").withColumnRenamed("source", "key")
    assert line_dedup.dedup_lines(clash).count() == docs.count()


def test_plan_has_no_python(docs):
    plan = line_dedup.dedup_lines(docs)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
