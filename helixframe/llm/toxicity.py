"""Toxicity grades by cumulative-link ordinal regression over sparse text features."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import packed, quoted, staged, unpacked, unstage

WORD = re.compile(r"[^\W\d_]+")
#: Lengths of the word beginnings that count as features beside whole words.
STEMS = (4, 5, 6, 7)
N_GRADES = 4
#: Entries of each worker's memo from words to features; a full memo is emptied.
MEMO = 300_000


def grams(word: str) -> list[str]:
    """The features that a word stands for: itself and its beginnings."""
    return [word, *("^" + word[:n] for n in STEMS if len(word) >= n)]


def features(text: str | None) -> tuple[list[str], int]:
    """All binary features of a whole text, and its number of words.

    A gram is a feature if it stands in the text, and another (``2`` in front) if it stands there twice or more and
    makes up at least a hundredth of the words.
    """
    words = WORD.findall((text or "").lower())
    counts: Counter = Counter()
    for word, k in Counter(words).items():
        for g in grams(word):
            counts[g] += k
    n = len(words)
    return [*counts, *("2" + g for g, k in counts.items() if k >= 2 and 100 * k >= n)], n


@dataclass(frozen=True)
class Model:
    """Weights shared by all thresholds; ``cuts[j]`` is the threshold between grades j and j + 1."""

    weights: dict[str, float]
    cuts: np.ndarray

    def above(self, score: float) -> np.ndarray:
        """P(grade > j) for each threshold."""
        return 1 / (1 + np.exp(np.clip(self.cuts - score, -40, 40)))


def fit_ordinal(
    rows: np.ndarray, cols: np.ndarray, grades: np.ndarray, n_cols: int, l2: float = 3e-4, steps: int = 400, n_grades: int = N_GRADES
) -> tuple[np.ndarray, np.ndarray]:
    """Proportional-odds fit by Adam: one weight vector, ordered cuts (a first cut and positive gaps)."""
    n, k = len(grades), n_grades - 1
    w = np.zeros(n_cols)
    share = np.array([(np.sum(grades > j) + 0.5) / (n + 1) for j in range(k)])
    cuts0 = np.maximum.accumulate(np.log((1 - share) / share) + np.arange(k) * 1e-3)
    p = np.concatenate([w, cuts0[:1], np.log(np.maximum(np.diff(cuts0), 1e-2))])
    m, v = np.zeros_like(p), np.zeros_like(p)
    weight = np.where(grades > 0, n / (2 * max(1, np.sum(grades > 0))), n / (2 * max(1, np.sum(grades == 0)))) ** 0.5
    for step in range(1, steps + 1):
        w, gaps = p[:n_cols], np.exp(p[n_cols + 1:])
        cuts = np.concatenate([p[n_cols:n_cols + 1], p[n_cols] + np.cumsum(gaps)])
        s = np.bincount(rows, w[cols], n)
        z = 1 / (1 + np.exp(-np.clip(cuts[None, :] - s[:, None], -40, 40)))
        edge = np.concatenate([np.zeros((n, 1)), z, np.ones((n, 1))], axis=1)
        at = np.arange(n)
        hi, lo = edge[at, grades + 1], edge[at, grades]
        prob = np.maximum(hi - lo, 1e-12)
        ds = weight * (hi + lo - 1)
        f_hi, f_lo = weight * hi * (1 - hi) / prob, weight * lo * (1 - lo) / prob
        dc = np.array([f_hi[grades == j].sum() - f_lo[grades == j + 1].sum() for j in range(k)])
        grad = np.concatenate([np.bincount(cols, ds[rows], n_cols) / n - l2 * w, [dc.sum() / n], [dc[j + 1:].sum() / n * gaps[j] for j in range(k - 1)]])
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad * grad
        p = p + 0.05 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    gaps = np.exp(p[n_cols + 1:])
    return p[:n_cols], np.concatenate([p[n_cols:n_cols + 1], p[n_cols] + np.cumsum(gaps)])


def held_out_grades(rows: np.ndarray, cols: np.ndarray, toxic: np.ndarray, n_cols: int, l2: float) -> np.ndarray:
    """Grade 0 for clean documents; 1 to 3 for toxic ones, by thirds of the score of a model that has not seen them.

    Documents are dealt to two folds in turn; each fold is scored by a two-grade fit on the other. Where a fold lacks toxic or
    clean documents, or there are few, all toxic documents are graded 2.
    """
    n = len(toxic)
    grades = np.where(toxic, 2, 0)
    fold = np.zeros(n, np.int64)
    fold[toxic] = np.arange(toxic.sum()) % 2
    fold[~toxic] = np.arange((~toxic).sum()) % 2
    if toxic.sum() < 6 or (~toxic).sum() < 2:
        return grades
    score = np.zeros(n)
    for f in (0, 1):
        there = fold != f
        number = np.cumsum(there) - 1
        use = there[rows]
        w, _ = fit_ordinal(number[rows[use]], cols[use], toxic[there].astype(int), n_cols, l2, n_grades=2)
        score[~there] = np.bincount(rows, w[cols], n)[~there]
    thirds = np.quantile(score[toxic], [1 / 3, 2 / 3])
    return np.where(toxic, 1 + np.searchsorted(thirds, score, side="left"), 0)


def train(docs: DataFrame, labels: DataFrame, sample_labels: int = 10_000, min_docs: int = 4, least_z: float = 3.0) -> Model:
    """Fit on at most ``sample_labels`` labelled documents, those of least id hash; their whole texts are read.

    Features are all those in at least ``min_docs`` sampled documents whose share of toxic documents differs from that of clean
    ones by ``least_z`` standard errors; no count bounds them but the sample. Labels are 0 or 1 (the largest counts where
    an id has several, nulls say nothing), so toxic documents are graded by a model that has not seen them: see
    ``held_out_grades``. Repeated rows of an id are one document, the least text counts. Without labels of both kinds
    every text gets one grade. The driver holds the chosen features of the sample.
    """
    picked = (
        labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull()).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
        .orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_labels)
    )
    # At most sample_labels rows of two numbers.
    texts = docs.select("doc_id", "text").join(F.broadcast(picked), "doc_id").groupBy("doc_id", "toxic").agg(F.min("text").alias("text"))
    schema = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("toxic", T.BooleanType()), T.StructField("features", T.ArrayType(T.StringType()))])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = pa.array([features(t.as_py())[0] for t in batch.column("text")], pa.list_(pa.string()))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("toxic"), found], names=schema.names)

    ids = (F.col("doc_id").cast("long").alias("doc_id"), (F.col("toxic") > 0).alias("toxic"))
    # Read three times below, so that whole texts are read once.
    sample = staged(texts.select(*ids, "text").mapInArrow(read, schema))
    known = sample.select("doc_id", "toxic").toArrow()
    order = np.argsort(known["doc_id"].to_numpy(), kind="stable")
    names, toxic = known["doc_id"].to_numpy()[order], known["toxic"].to_numpy()[order].astype(bool)
    bad, good = int(toxic.sum()), int((~toxic).sum())
    if not bad or not good:
        return Model({}, np.full(N_GRADES - 1, 40.0 if good or not bad else -40.0))
    a, b = F.col("a"), F.col("b")
    pooled = (a + b) / float(bad + good)
    z = F.abs(a / float(bad) - b / float(good)) / F.sqrt(pooled * (1 - pooled) * (1.0 / bad + 1.0 / good) + 1e-12)
    each = sample.select("doc_id", "toxic", F.explode("features").alias("f"))
    chosen = staged(
        each.groupBy("f").agg(F.sum(F.col("toxic").cast("int")).alias("a"), F.sum((~F.col("toxic")).cast("int")).alias("b"))
        .where((a + b >= min_docs) & (z >= least_z)).select("f")
    )
    index = sorted(chosen.toArrow()["f"].to_pylist())
    met = each.join(chosen, "f").select("doc_id", "f").toArrow()
    at = {f: k for k, f in enumerate(index)}
    rows = np.searchsorted(names, met["doc_id"].to_numpy())
    cols = np.array([at[f] for f in met["f"].to_pylist()], dtype=np.int64)
    line = np.lexsort((cols, rows))
    rows, cols = rows[line], cols[line]
    for used in (sample, chosen):
        unstage(used)
    # Few labels call for a stronger penalty: at least four labels' worth.
    l2 = max(3e-4, 4 / len(names))
    weights, cuts = fit_ordinal(rows, cols, held_out_grades(rows, cols, toxic, len(index), l2), len(index), l2)
    return Model({f: float(weights[k]) for f, k in at.items()}, cuts)


class Scorer:
    """Scores whole texts; remembers which of a word's grams have weights."""

    def __init__(self, model: Model):
        self.model = model
        self.known = frozenset(f[1:] if f[0] == "2" else f for f in model.weights)
        self.memo: dict[str, tuple[str, ...]] = {}

    def score(self, text: str | None) -> float:
        words = WORD.findall((text or "").lower())
        n, counts, memo = len(words), Counter(), self.memo
        for word, k in Counter(words).items():
            hit = memo.get(word)
            if hit is None:
                if len(memo) >= MEMO:
                    memo.clear()
                hit = memo[word] = tuple(g for g in grams(word) if g in self.known)
            for g in hit:
                counts[g] += k
        weights = self.model.weights
        total = 0.0
        for g in sorted(counts):
            total += weights.get(g, 0.0)
            if counts[g] >= 2 and 100 * counts[g] >= n:
                total += weights.get("2" + g, 0.0)
        return total


def grade(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """Add ``expected_severity double`` (0 to 3), ``grade int`` (the likeliest) and ``toxic boolean`` (P(grade > 0) >= 1/2).

    Null and empty texts score like a text without features. Rows are scored one by one on their whole text: no
    shuffle, one Arrow batch in memory. Other columns stay, clashing ones are replaced.
    """
    rows = packed(docs, text=F.col(quoted(text)))
    added = T.StructType().add("expected_severity", T.DoubleType()).add("grade", T.IntegerType()).add("toxic", T.BooleanType())
    schema = T.StructType([rows.schema["row"], *added])
    # Weights of the sample's features.
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(shared.value)
        for batch in batches:
            above = [scorer.model.above(scorer.score(t.as_py())) for t in batch.column(1)]
            severity = [round(float(a.sum()), 9) for a in above]
            likely = [int(np.argmax(-np.diff(np.concatenate([[1.0], a, [0.0]])))) for a in above]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(severity, pa.float64()), pa.array(likely, pa.int32()), pa.array([bool(a[0] >= 0.5) for a in above], pa.bool_())],
                names=schema.names,
            )

    return unpacked(rows.mapInArrow(run, schema), **{c: F.col(c) for c in added.names})
