"""Document quality rules as a short-circuit cascade, with built-in functions only."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import packed, quoted, strip, unpacked, words

#: Characters that count as symbols.
SYMBOLS = "[#*$%&|<>]"
WINDOW = 8


def with_measures(docs: DataFrame, text: str = "text") -> DataFrame:
    """Add ``n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words`` (long) to each row; null text counts 0.

    Everything is an array expression over one row: no shuffle. Repeated windows are found by hashing each run of
    eight words (by doubling: pairs, fours, eights) and sorting the hashes, only where a document has a repeat at all.
    """
    a = packed(docs, w=words(F.col(text)), t=F.coalesce(F.col(text), F.lit("")))
    a = a.select(
        "row",
        F.size("w").alias("n"),
        F.array_join("w", "").alias("joined"),
        F.transform("w", lambda w: F.xxhash64(w)).alias("h1"),
        F.filter(F.split("t", "\n"), lambda x: strip(x) != "").alias("lines"),
    )
    n = F.col("n")
    m = n - (WINDOW - 1)

    def doubled(col: str, have: int) -> Column:
        """Hash of each window of 2 * have words from the hashes of windows of have words."""
        left = n - 2 * have + 1
        return F.when(
            n >= WINDOW,
            F.zip_with(F.slice(col, F.lit(1), left), F.slice(col, F.lit(have + 1), left), lambda x, y: F.xxhash64(x, y)),
        )

    b = a.withColumn("h2", doubled("h1", 1))
    b = b.withColumn("h4", doubled("h2", 2)).withColumn("h8", doubled("h4", 4)).drop("h1", "h2", "h4")
    b = b.withColumn("repeats", F.size(F.array_distinct("h8")) < F.size("h8"))
    b = b.withColumn(
        "sorted",
        F.when(F.col("repeats"), F.array_sort(F.transform("h8", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))),
    ).drop("h8")
    b = b.withColumn(
        "pairs",
        F.when(
            F.col("repeats"),
            F.zip_with(
                F.slice("sorted", F.lit(1), m - 1), F.slice("sorted", F.lit(2), m - 1),
                lambda x, y: F.when(x["h"] == y["h"], F.array(x["i"], y["i"])),
            ),
        ),
    ).drop("sorted")
    b = b.withColumn("at", F.array_sort(F.array_distinct(F.flatten(F.array_compact("pairs"))))).drop("pairs")
    k = F.size("at")
    gaps = F.zip_with(
        F.slice("at", F.lit(1), k - 1), F.slice("at", F.lit(2), k - 1), lambda x, y: F.least(F.lit(WINDOW), y - x)
    )
    measures = F.struct(
        n.cast("long").alias("n_words"),
        F.char_length("joined").cast("long").alias("word_chars"),
        (F.char_length("joined") - F.char_length(F.regexp_replace("joined", SYMBOLS, ""))).cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.when(F.col("repeats"), F.aggregate(gaps, F.lit(WINDOW), lambda s, x: s + x)).otherwise(0).cast("long").alias("n_repeat_words"),
    )
    # A generator of one row: a filter on what is computed from the measures would else be pushed below them and
    # every measure written out again for each use, some hundred times over.
    once = b.select("row", F.explode(F.array(measures)).alias("measured"))
    return unpacked(once, **{m: F.col("measured").getField(m) for m in MEASURES})


MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def base_failed() -> Column:
    return (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))


@dataclass(frozen=True)
class Rule:
    """A named test; ``rejects`` builds a boolean over ``text`` and the measures, true for a document to reject.

    ``passes`` is how often it reads the whole text: what the measures know already costs nothing but the comparison.
    """

    name: str
    rejects: object
    passes: int = 0


def _count(pattern: str) -> Column:
    return F.regexp_count("text", F.lit(pattern))


def _lines() -> Column:
    return F.regexp_count(F.col("text"), F.lit("\n")) + 1


#: All thresholds are integers over counts, so that results do not depend on rounding.
RULES = (
    Rule("word_length", lambda: (F.col("word_chars") < 2 * F.col("n_words")) | (F.col("word_chars") > 20 * F.col("n_words"))),
    Rule("symbols", lambda: 5 * F.col("n_symbols") > F.col("n_words")),
    Rule("duplicate_lines", lambda: (F.col("n_dup_lines") >= 4) & (10 * F.col("n_dup_lines") > 3 * _lines()), 1),
    Rule("shouting", lambda: 3 * _count("[!?]{2,}") > F.col("n_words"), 1),
    Rule("capitals", lambda: 2 * _count("\\p{Lu}") > F.col("word_chars"), 1),
    Rule("digits", lambda: 2 * _count("\\p{Nd}") > F.col("word_chars"), 1),
    Rule("ellipsis", lambda: 10 * _count("(?m)(?:\\.\\.\\.|\u2026)[ \\t]*$") > 3 * _lines(), 2),
    Rule("bullets", lambda: 10 * _count("(?m)^[ \\t]*[-*\u2022]") > 9 * _lines(), 2),
)
#: What the comparison of a rule costs, in characters read.
COMPARISON = 20.0


def plan_cascade(docs: DataFrame, rules=RULES, sample_rows: int = 500, seed: int = 11) -> list[dict]:
    """Order rules by rejections per cost, each estimated on a sample of about ``sample_rows`` rows.

    A rule's cost is the mean number of characters it reads in a sampled document (a comparison counts as ``COMPARISON``
    of them); its selectivity is the share of the sample that it rejects. One job reads both, and rerunning it gives
    the same order. The order changes how much work the cascade does and which rule is named first, never
    which documents are kept.
    """
    texts = docs.select("text")
    drawn = texts.sample(fraction=min(1.0, 1.2 * sample_rows / max(texts.count(), 1)), seed=seed)
    chars = F.sum(F.coalesce(F.char_length("text"), F.lit(0)))
    rejected = [F.sum(F.coalesce(r.rejects(), F.lit(False)).cast("int")).alias(f"r{k}") for k, r in enumerate(rules)]
    seen = with_measures(drawn).agg(F.count("*").alias("n"), chars.alias("chars"), *rejected).first()
    n = max(seen["n"], 1)
    plan = [
        {"rule": rule, "cost": COMPARISON + rule.passes * (seen["chars"] or 0) / n, "selectivity": (seen[f"r{k}"] or 0) / n, "at": k}
        for k, rule in enumerate(rules)
    ]
    plan.sort(key=lambda x: (-x["selectivity"] / x["cost"], x["at"]))
    return plan


def quality_rules(docs: DataFrame, rules=RULES, plan: list[dict] | None = None) -> DataFrame:
    """Judge each row of ``docs`` (needs ``text``; all other columns stay).

    Adds the measures, ``base_failed``, ``kept`` and ``rejected_by`` (the first rule of the cascade that rejects,
    else null). The cascade is one CASE expression: a later rule is evaluated only for rows that every earlier rule
    passed. Null or empty text has no words and fails the base rule. Rows are judged one by one, so repeated rows
    get equal verdicts and an empty table gives an empty result.
    """
    clean = docs.select(*[F.col(quoted(c)) for c in docs.columns if c.lower() not in (*MEASURES, "base_failed", "kept", "rejected_by")])
    measured = with_measures(clean)
    if plan is None:
        plan = plan_cascade(clean, rules) if rules else []
    first = F.when(base_failed(), F.lit("base"))
    for step in plan:
        first = first.when(step["rule"].rejects(), F.lit(step["rule"].name))
    out = measured.withColumns({"base_failed": base_failed(), "rejected_by": first})
    return out.withColumn("kept", F.col("rejected_by").isNull())
