import hashlib
import random
import re
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from helixframe.llm import conversation_repair as cr

WHITE = " \t\n\x0b\x0c\r"


def order(rows):
    none_first = lambda x: (x is not None, x)
    return sorted(rows, key=lambda r: (none_first(r[0]), r[1], r[2][:64]))


def damaged(rows):
    """(conv, turn, role, text) rows by conversation, spoilt and in order; conversations that lose all stay, empty."""
    out = defaultdict(list)
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        out[conv] += [] if kind == 0 else [(turn, "user" if kind == 4 else role, "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text)] * (2 if kind == 3 else 1)
    return {k: order(v) for k, v in out.items()}


def faults(rows):
    seen, out = set(), []
    for _, role, text in rows:
        body = text.strip(WHITE)
        out.append("blank" if not body else "duplicate" if (role, text) in seen else "" if body[-1] in ".!?" else "truncated")
        seen.add((role, text))
    return out


def cheapest(rows, marks):
    """All edit sequences that can still be cheapest, kept as (cost, audit, lines) by the role initials' state."""
    nexts = {"": {"s": "s", "u": "u"}, "s": {"u": "u"}, "u": {"a": "a"}, "a": {"u": "u"}}
    best = {"": (0, "", [])}

    def put(at, state, cost, audit, lines):
        if state not in at or (cost, audit) < at[state][:2]:
            at[state] = (cost, audit, lines)

    def inserted(at):
        out = dict(at)
        for _ in range(3):
            for state, (cost, audit, lines) in list(out.items()):
                for role in ("user", "assistant"):
                    if role[0] in nexts[state]:
                        put(out, role[0], cost + 5, audit + "I", [*lines, f"{role}:"])
        return out

    for (_, role, text), mark in zip(rows, marks):
        best, new = inserted(best), {}
        for state, (cost, audit, lines) in best.items():
            put(new, state, cost + 2, audit + "D", lines)
            if mark in ("", "truncated"):
                extra = 5 * (mark == "truncated")
                if role[:1] in nexts[state]:
                    put(new, role[0], cost + extra, audit + "K", [*lines, f"{role}:{text}"])
                for to in ("user", "assistant"):
                    if to[0] in nexts[state]:
                        put(new, to[0], cost + 1 + extra, audit + "R", [*lines, f"{to}:{text}"])
        best = new
    best = inserted(best)
    return min((best[s] for s in ("", "a") if s in best), key=lambda x: x[:2])


def plain(conversations):
    out = set()
    for conv, rows in conversations.items():
        marks, turns = faults(rows), {t for t, _, _ in rows if t is not None}
        cost, audit, lines = cheapest(rows, marks)
        illegal = sum((a[1][:1], b[1][:1]) not in (("s", "u"), ("u", "a"), ("a", "u")) for a, b in zip(rows, rows[1:]))
        gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
        out.add((conv, gaps, *[marks.count(x) for x in ("blank", "duplicate", "truncated")], illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest()))
    return out


def some_rows(seed, conversations, most):
    pick = random.Random(seed)
    texts = ["Yes.", "No!", "cut of", "  \t", "", "Why? ", "done.\n", None, "é。", "ok."]
    out = []
    for conv in range(conversations):
        for turn in range(pick.randint(1, most)):
            role = pick.choice(["user", "assistant", "user", "assistant", "system", "tool", None, ""])
            text = pick.choice(texts)
            out.append((conv, pick.choice([turn, turn, turn, turn + 3, None]), role, text if pick.random() < 0.4 or text is None else f"{turn} {text}"))
    return [*out, (None, 1, "user", "Nobody."), (None, 2, "assistant", "Nobody."), *[(conversations, k, "user", None) for k in range(3)]]


@pytest.mark.parametrize(("waiting", "block", "parts"), [(4096, 1024, 3), (2, 2, 5), (1, 3, 1)])
def test_same_as_brute_force(spark, monkeypatch, waiting, block, parts):
    monkeypatch.setattr(cr, "WAITING", waiting)
    monkeypatch.setattr(cr, "BLOCK", block)
    rows = some_rows(waiting, 60, 9)
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(parts).withColumn("code", F.lit("x"))
    assert set(map(tuple, cr.repair(cr.damage(df)).collect())) == plain(damaged(rows))


def test_one_long_conversation_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(cr, "WAITING", 50)
    monkeypatch.setattr(cr, "BLOCK", 16)
    pick = random.Random(1)
    rows = [(1, k, pick.choice(["user", "assistant"]), pick.choice(["a.", "b", "c!", f"{k}?"])) for k in range(700)] + [(2, k, "user" if k % 2 == 0 else "assistant", f"{k}.") for k in range(6)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(4)
    assert set(map(tuple, cr.repair(cr.damage(df)).collect())) == plain(damaged(rows))


def test_ranks_choose_the_least_string():
    pick = random.Random(3)
    for _ in range(200):
        codes = [pick.randrange(16) for _ in range(pick.randint(0, 7))]
        cost = cr.costs_to_go(codes, cr.FINISH)
        (letters, nodes, state), = cr.least_paths([(np.array(codes, dtype=np.int64), cost)], [(0, cr.START)])
        rows = [(0, "sua?"[c % 4], "x") for c in codes]
        want = cheapest(rows, [["", "blank", "duplicate", "truncated"][c // 4] for c in codes])
        assert (int(cost[0][0]), cr.written(letters) + cr.TAIL[state]) == want[:2]


def test_rows_without_loss_and_an_empty_table(spark):
    df = spark.createDataFrame([(1, 0, "user", "Hi."), (1, 1, "assistant", "Ho.")], "conv_id long, turn long, role string, text string")
    row = cr.repair(df).first()
    assert (row["cost"], row["audit"], row["repaired_sha256"]) == (0, "KK", hashlib.sha256(b"user:Hi.\nassistant:Ho.").hexdigest())
    assert cr.repair(df.where("false")).count() == 0
    lost = cr.repair(df.withColumn("lost", F.lit(True))).first()
    assert (lost["gaps"], lost["cost"], lost["audit"], lost["repaired_sha256"]) == (0, 0, "", hashlib.sha256(b"").hexdigest())
