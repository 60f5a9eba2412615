import random

import numpy as np

from helixframe.llm import toxicity


def corpus(n, seed):
    rng = random.Random(seed)
    plain = ["".join(rng.choice("abcdefg") for _ in range(5)) for _ in range(400)]
    docs, labels = [], []
    for i in range(n):
        w = [rng.choice(plain) for _ in range(rng.randint(20, 120))]
        toxic = i % 6 == 0
        if toxic:
            for _ in range(rng.choice([1, 3, 9])):
                w[rng.randrange(len(w))] = rng.choice(["vilexx", "nastyyy", "rottenn"])
        docs.append((i, " ".join(w)))
        labels.append((i, int(toxic)))
    return docs, labels


def test_held_out(spark):
    docs, labels = corpus(600, 1)
    d = spark.createDataFrame(docs, "doc_id long, text string")
    model = toxicity.train(d, spark.createDataFrame([x for x in labels if x[0] >= 200], "doc_id long, toxic int"))
    assert np.all(np.diff(model.cuts) > 0)
    got = {r["doc_id"]: r for r in toxicity.grade(d.where("doc_id < 200"), model).collect()}
    truth = dict(labels)
    right = sum(got[i]["toxic"] == bool(truth[i]) for i in got)
    assert right >= 195
    severe = [r["expected_severity"] for i, r in got.items() if truth[i]]
    mild = [r["expected_severity"] for i, r in got.items() if not truth[i]]
    assert min(np.mean(severe), 3) > 1 > np.mean(mild)


def test_gradient_of_the_fit():
    rows, cols = np.array([0, 1, 1, 2, 3, 4, 5, 5]), np.array([0, 0, 1, 1, 2, 2, 0, 1])
    grades = np.array([0, 1, 3, 0, 0, 2])
    w, cuts = toxicity.fit_ordinal(rows, cols, grades, 3, steps=800)
    s = np.bincount(rows, w[cols], 6)
    assert np.all(np.diff(cuts) > 0) and s[5] > s[3]


def test_edges(spark, docs):
    empty = spark.createDataFrame([], "doc_id long, toxic int")
    model = toxicity.train(docs, empty)
    got = toxicity.grade(docs.withColumnRenamed("size", "toxic"), model).collect()
    assert len(got) == docs.count() and not any(r["toxic"] for r in got)
    assert toxicity.grade(docs.limit(0), model).count() == 0
    labels = spark.createDataFrame([(1, 1), (2, 0), (2, 0), (4, 0), (5, None), (None, 1)], "doc_id long, toxic int")
    assert toxicity.grade(docs, toxicity.train(docs, labels, min_docs=1, least_z=0.0)).count() == docs.count()


def test_fit_against_a_plain_likelihood():
    """The fit is a minimum of the penalised proportional-odds likelihood, written out document by document."""
    import math

    rng = random.Random(3)
    n, m, l2 = 120, 4, 0.01
    lists = [[c for c in range(m) if rng.random() < 0.4] for _ in range(n)]
    grades = np.array([min(3, max(0, len(x) - 1 + rng.choice([-1, 0, 0, 1]))) for x in lists])
    rows, cols = np.array([i for i, x in enumerate(lists) for _ in x]), np.array([c for x in lists for c in x])
    w, cuts = toxicity.fit_ordinal(rows, cols, grades, m, l2=l2, steps=4000)
    positive = int((grades > 0).sum())
    weight = [math.sqrt(n / (2 * (positive if g > 0 else n - positive))) for g in grades]

    def loss(w, cuts):
        total = 0.0
        for x, g, k in zip(lists, grades, weight):
            below = [0.0, *(1 / (1 + math.exp(-(c - sum(w[j] for j in x)))) for c in cuts), 1.0]
            total -= k * math.log(below[g + 1] - below[g])
        return total / n + l2 / 2 * sum(v * v for v in w)

    best = loss(w, cuts)
    for j in range(m + 3):
        for step in (-0.02, 0.02):
            w2, c2 = list(w), list(cuts)
            if j < m:
                w2[j] += step
            else:
                c2[j - m] += step
            assert loss(w2, c2) >= best - 1e-6


def test_grades_come_from_the_other_fold():
    """A feature that only one toxic document has says nothing about that document's grade."""
    n = 40
    toxic = np.arange(n) % 2 == 0
    rows = np.repeat(np.arange(n), 2)
    # Feature 0 marks toxic documents; feature 1 + i is document i's own.
    cols = np.array([c for i in range(n) for c in ((0 if toxic[i] else n + 1), 1 + i)])
    grades = toxicity.held_out_grades(rows, cols, toxic, n + 2, 1e-3)
    assert set(grades[~toxic]) == {0} and len(set(grades[toxic])) == 1


def test_repeated_rows_of_a_labelled_id_are_one_document(spark):
    docs, labels = corpus(120, 5)
    d = spark.createDataFrame(docs, "doc_id long, text string")
    lab = spark.createDataFrame(labels, "doc_id long, toxic int")
    one, many = toxicity.train(d, lab), toxicity.train(d.union(d).union(d), lab)
    assert one.weights == many.weights and np.array_equal(one.cuts, many.cuts)
