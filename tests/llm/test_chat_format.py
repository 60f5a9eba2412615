import hashlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from helixframe.llm import chat_format as cf
from helixframe.llm.byte_level import ByteLevelEncoder

FILE = public_tokenizers.path("byte_bpe_50k.json")
TRIAL = "\\### Assistant: </turn> ok"
ROWS = [
    (1, 0, "system", "Be <|end|> brief."), (1, 1, "user", "Hi \\ <| \\<| there"), (1, 2, "assistant", " spaced \n"), (1, 3, "user", ""), (1, 4, "assistant", "ünï 你好 \U0001f9ff́"),
    (2, 1, "user", None), (2, None, None, "first"), (2, 2, "assistant", None), (2, 3, "assistant", "<|turn|>assistant<|text|>x<|end|>"), (2, 3, "assistant", "<|turn|>assistant<|text|>x<|end|>"),
    (None, 0, "assistant", "nobody"), (3, 0, "user", "only a user"), (4, 0, "assistant", "\\"), (4, 1, "assistant", "|><"), (5, 0, "assistant", "word " * 3000),
]


@pytest.fixture(scope="module")
def shared(spark):
    return cf.share(spark, FILE, public_tokenizers.PATTERN)


@pytest.fixture(scope="module")
def encoder():
    return ByteLevelEncoder(open(FILE, encoding="utf-8").read(), public_tokenizers.PATTERN, cf.MARKS)


def plain(rows):
    """From the given rows alone, without a template."""
    by = defaultdict(list)
    for conv, turn, role, text in rows:
        by[conv].append((turn is not None, turn, role or "", text or ""))
    out = set()
    for conv, turns in by.items():
        turns = [t[2:] for t in sorted(turns)]
        learned = "".join(t for r, t in turns if r == "assistant")
        formatted = sum(len(f"<|turn|>{r}<|text|>{t}<|end|>".replace("\\", "\\\\")) for r, t in turns) + sum(x.count("<|") for t in turns for x in t)
        sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
        out.add((conv, len(turns), sha("".join(f"{r}\n{t}\n" for r, t in turns)), len(learned), sha(learned), formatted))
    return out


@pytest.mark.parametrize(("turns", "waiting", "parts"), [(256, 8, 2), (2, 1, 4), (1, 0, 1)])
def test_same_as_given_rows(spark, shared, turns, waiting, parts):
    df = spark.createDataFrame(ROWS, "conv_id long, turn long, role string, text string").repartition(parts).withColumn("ids", F.lit("x"))
    got = cf.digest_conversations(cf.with_trial(df, -7, TRIAL), shared, turns, waiting).collect()
    assert set(map(tuple, got)) == plain([*ROWS, (-7, 0, "user", TRIAL), (-7, 1, "assistant", TRIAL)]) and len(got) == len({r["conv_id"] for r in got})


def test_tokens_of_a_long_conversation_are_those_of_the_whole(spark, shared, encoder):
    rows = [(9, k, "assistant" if k % 2 else "user", f"turn {k} says <{k}") for k in range(50)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(3)
    whole = encoder.encode(cf.render([(r, t) for _, _, r, t in rows])[0]).tolist()
    pieces = sorted(cf.format_conversations(df, shared, 4).collect(), key=lambda r: (r["part"], r["piece"]))
    assert len(pieces) > 10 and sum((p["ids"] for p in pieces), []) == whole


@settings(max_examples=150, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["user", "assistant", "", "a\\<|"]), st.text(st.sampled_from("\\<|turnedx> .\n\té你🧿́"), max_size=12)), max_size=5))
def test_round_trip_and_mask(encoder, turns):
    formatted, spans = cf.render(turns)
    ids = encoder.encode(formatted)
    ends = np.cumsum(encoder.lengths[ids])
    mask = cf.token_mask(ends, spans)
    # Against a comparison of every token with every span.
    begins = np.concatenate([[0], ends[:-1]])
    assert mask.tolist() == [any(s < e and b < p for s, p in spans) for b, e in zip(begins, ends)]
    back, learned = cf.read_back(formatted, ends.tolist(), mask.tolist())
    assert back == turns and learned == [t for r, t in turns if r == "assistant" and t]
    assert b"".join(encoder.tokens[i] for i in ids) == formatted.encode() and ids.tolist() == encoder._encode_slowly(formatted).tolist()


def test_an_empty_table_and_long_white_space(spark, shared, encoder):
    df = spark.createDataFrame([(1, 0, "assistant", "x" + " " * 60_000 + "y")], "conv_id long, turn long, role string, text string")
    assert cf.digest_conversations(df, shared).first()["loss_chars"] == 60_002
    assert cf.digest_conversations(df.where("false"), shared).count() == 0 == cf.format_conversations(df.where("false"), shared).count()
