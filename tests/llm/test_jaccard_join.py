import random

import pytest

from helixframe.llm import jaccard_join as J
from helixframe.llm.components import connected_components


def sets(rows, words):
    out = []
    for i, text in rows:
        w = (text or "").encode().lower().split()
        s = {tuple(w[k: k + words]) for k in range(len(w) - words + 1)} if len(w) >= words else ({tuple(w)} if w else set())
        out.append((i, s))
    return out


def brute(rows, words, num, den):
    """All pairs of rows with an id."""
    s = sets(rows, words)
    parent = list(range(len(s)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(s)):
        for b in range(a):
            if s[a][0] is None or s[b][0] is None or not s[a][1] or not s[b][1]:
                continue
            k = len(s[a][1] & s[b][1])
            if den * k >= num * (len(s[a][1]) + len(s[b][1]) - k):
                parent[find(a)] = find(b)
    least = {}
    for k, (i, _) in enumerate(s):
        if i is not None:
            least[find(k)] = min(i, least.get(find(k), i))
    return sorted(((i, len(x), least[find(k)] if i is not None else None) for k, (i, x) in enumerate(s)), key=repr)


def run(df, words, num, den):
    return sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in J.near_duplicates(df, words, num, den).collect()), key=repr)


@pytest.fixture
def family(spark):
    """A group of near copies around one text, some linked only through others, with a second family inside."""
    rng = random.Random(4)
    base = [str(rng.randint(0, 10**6)) for _ in range(100)]
    second = list(base)
    for k in (5, 30, 60):
        second[k] = "second"
    rows = []
    for i in range(160):
        w = list(base if i % 3 else second)
        for _ in range(rng.choice([0, 1, 2, 2, 3, 4])):
            w[rng.randrange(100)] = str(rng.randint(0, 10**6)) if rng.random() < 0.8 else rng.choice(base)
        rows.append((i, " ".join(w)))
    return rows


def test_fixture_cases(docs):
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    assert run(docs, 3, 90, 100) == brute(rows, 3, 90, 100)


@pytest.mark.parametrize("direct,rounds", [(32, 2), (4, 2), (2, 1), (2, 9)])
def test_long_lists_lose_no_link(spark, family, monkeypatch, direct, rounds):
    monkeypatch.setattr(J, "DIRECT", direct)
    monkeypatch.setattr(J, "ROUNDS", rounds)
    df = spark.createDataFrame(family, "doc_id long, text string").repartition(3)
    assert run(df, 3, 90, 100) == brute(family, 3, 90, 100)


def test_copies_edited_apart_make_few_list_rows(spark, monkeypatch):
    """Copies that lost lines of their text, some with words replaced, some copied again: most are neither near nor far."""
    rng = random.Random(8)
    lines = [[str(rng.randint(0, 10**6)) for _ in range(12)] for _ in range(12)]
    rows = [(0, " ".join(w for line in lines for w in line))]
    while len(rows) < 150:
        if len(rows) > 40 and rng.random() < 0.3:
            w = rng.choice(rows)[1].split()
            edits = rng.choice([0, 1, 2, 3])
        else:
            gone = set(rng.sample(range(12), rng.choice([1, 2, 3])))
            w = [x for k, line in enumerate(lines) if k not in gone for x in line]
            edits = rng.choice([0, 2, 4, 6])
        for _ in range(edits):
            w[rng.randrange(len(w))] = str(rng.randint(0, 10**6)) if rng.random() < 0.7 else "again"
        rows.append((len(rows), " ".join(w)))
    made, plain = {}, J.staged

    def counted(df):
        out = plain(df)
        for kind in ("more", "central"):
            if kind in out.columns:
                made[kind] = max(made.get(kind, 0), out.count())
        return out

    monkeypatch.setattr(J, "staged", counted)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert run(df, 5, 80, 100) == brute(rows, 5, 80, 100)
    # The lists that are paired in the end, and the largest table of lists on the way.
    assert max(made.values()) <= 4000, made


def test_members_of_a_family_are_not_paired_by_tokens(spark, monkeypatch):
    """Copies edited apart that all share most tokens: few pairs are left to verify one by one, in many small blocks too."""
    rng = random.Random(11)
    base = [str(rng.randint(0, 10**6)) for _ in range(120)]
    head = [str(rng.randint(0, 10**6)) for _ in range(30)]
    family = []
    while len(family) < 240:
        w = list(rng.choice(family)) if len(family) > 40 and rng.random() < 0.3 else (head if rng.random() < 0.5 else []) + base
        for _ in range(rng.choice([0, 1, 3, 6, 9])):
            w[rng.randrange(len(w))] = str(rng.randint(0, 10**6))
        family.append(w)
    rows = [(k, " ".join(w)) for k, w in enumerate(family)]
    pairs, plain = [0], J.staged

    def counted(df):
        out = plain(df)
        if out.columns == ["a", "b", "big"]:
            pairs.append(out.count())
        return out

    monkeypatch.setattr(J, "staged", counted)
    monkeypatch.setattr(J, "SETS", 16, raising=False)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert run(df, 5, 80, 100) == brute(rows, 5, 80, 100)
    # The last are those beyond comparisons with pivots.
    assert pairs[-1] <= len(rows), pairs


def test_sketch_counts_and_sends_few_rows(spark, monkeypatch):
    texts = ["often"] * 70_000 + ["again"] * 300 + [f"once{k}" for k in range(500)]
    df = spark.createDataFrame([(t,) for t in texts], "text string").repartition(3)
    want = [0] * 2**18
    for t in texts:
        for h in J.shingles(t, 3).tolist():
            want[h >> 46] += 1
    assert J.sketch(df, 3, 18).tolist() == want
    sent, plain = [], type(df).repartition
    monkeypatch.setattr(type(df), "repartition", lambda self, *by: sent.append(self) or plain(self, *by))
    J.sketch(df, 3, 18)
    # Blocks of each of three tasks, and a second and third byte of what is frequent.
    assert sent and sent[0].count() <= 3 * 4 + 9


def test_a_very_long_text_in_a_long_list(spark, monkeypatch):
    """Sizes times products of the threshold pass 2 ** 31 in the size test of a list's pivot."""
    monkeypatch.setattr(J, "DIRECT", 2)
    words = [f"w{k}" for k in range(130_000)]
    # In every text that holds it, the shared word is the rarest, so it is in all their prefixes.
    texts = ["shared " + " ".join(words)] + [" ".join(words[:65_000])] * 50 + [" ".join(words[65_000:])] * 50
    for i in range(40):
        own = f"a{i} b{i} c{i}"
        texts += [f"shared {own}"] + [own] * 50
    rows = list(enumerate(texts))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    first = {}
    for i, t in rows:
        first.setdefault(t, i)
    # Texts differ by more than a tenth of their words or not at all.
    assert run(df, 1, 90, 100) == sorted(((i, len(t.split()), first[t]) for i, t in rows), key=repr)


def test_shuffled_texts(spark, family, monkeypatch):
    monkeypatch.setattr(J, "BROADCAST_IDS", 0)
    rows = family[:60] + [(200, None), (201, ""), (202, "one"), (203, "one"), (204, "One\ttwo")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert run(df, 5, 80, 100) == brute(rows, 5, 80, 100)


def test_empty(spark):
    assert J.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_hashes_tell_shingles_apart():
    rng = random.Random(1)
    text = " ".join("".join(rng.choice("ab") for _ in range(rng.randint(1, 4))) for _ in range(5000))
    w = text.split()
    for k in (1, 2, 3, 5):
        assert len(J.shingles(text, k)) == len({tuple(w[i: i + k]) for i in range(len(w) - k + 1)})


def test_components_of_a_long_chain(spark):
    n = 300
    order = list(range(n))
    random.Random(2).shuffle(order)
    links = spark.createDataFrame([(order[k], order[k + 1]) for k in range(n - 1)] + [(1000, 1001)], "a long, b long")
    got = {r["node"]: r["label"] for r in connected_components(links).collect()}
    assert set(got.values()) == {0, 1000} and len(got) == n + 2
