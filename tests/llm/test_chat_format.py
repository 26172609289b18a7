import itertools
import random

import numpy as np
from pyspark.sql import functions as F

from palimpsest.llm import chat_format as C

SCHEMA = "conv_id long, turn long, role string, text string"


def weight(observed, roles, before=C.START):
    total = 0
    for o, r in zip(observed, roles, strict=True):
        total += C.STEPS[o][before][r]
        before = r
    return total


def test_viterbi_is_the_best_path():
    rng = random.Random(1)
    for _ in range(30):
        o = [rng.randrange(48) for _ in range(6)]
        best = max(weight(o, p) for p in itertools.product(range(3), repeat=6))
        assert abs(weight(o, C.viterbi(o)) - best) < 1e-9
        m = C.transfer(o)
        assert abs(m[C.START].max() - best) < 1e-9
        for last in range(3):
            assert abs(weight(o, C.viterbi(o, 1, last), 1) - m[1][last]) < 1e-9 and C.viterbi(o, 1, last)[-1] == last


def test_roles_without_markers(spark):
    rows = []
    for c in range(40):
        for t in range(6):
            role = ("user", "assistant")[t % 2]
            rows.append((c, t, role if (c + t) % 3 else None, "What is it?" if role == "user" else "It is a long answer. " * 25))
    df = spark.createDataFrame(rows, SCHEMA)
    got = {(r.conv_id, r.turn): r.roles for r in C.parse(C.transcripts_of(df)).collect()}
    assert all(got[c, t] == [("user", "assistant")[t % 2]] for c, t, _, _ in rows)


def test_rendering(spark):
    text = "System: Be brief.\nUser: Hello\nthere?\nAssistant: Hi.\nMore."
    r = C.parse(spark.createDataFrame([(1, 0, text)], "conv_id long, turn long, text string")).first()
    assert r.roles == ["system", "user", "assistant"] and r.n_lines == 5
    assert r.rendered == "<|system|>\nBe brief.\n<|end|>\n<|user|>\nHello\nthere?\n<|end|>\n<|assistant|>\nHi.\nMore.\n<|end|>\n"


def test_blocks_give_the_likeliest_path(spark, monkeypatch):
    rng = random.Random(6)
    rows = [(c, t, rng.choice([None, None, "user", "assistant"]), rng.choice(["a?", "b", "c " * 100])) for c in (1, 2) for t in range(300)]
    df = C.transcripts_of(spark.createDataFrame(rows, SCHEMA))
    texts = {(r.conv_id, r.turn): r.text for r in df.collect()}
    monkeypatch.setattr(C, "BLOCK", 7)
    got = {(r.conv_id, r.turn): r.roles for r in C.parse(df).collect()}
    for c in (1, 2):
        seen = [C.observe(texts[c, t], True)[0] for t in range(300)]
        roles = [C.ROLES.index(got[c, t][0]) for t in range(300)]
        assert weight(seen, roles) == weight(seen, C.viterbi(seen))


def test_odd_rows(spark):
    rows = [(1, None, None, None), (1, 0, "user", ""), (1, 0, "user", ""), (None, 3, "x", "y"), (None, None, None, None), (2, 5, "assistant", "z " * 100_000), (2, -4, "", "q?")]
    df = spark.createDataFrame(rows, SCHEMA).withColumn("block", F.lit("b")).withColumn("roles", F.lit("r")).withColumn("before", F.lit(1))
    assert C.parse(C.transcripts_of(df)).count() == len(rows)
    assert C.parse(C.transcripts_of(spark.createDataFrame([], SCHEMA))).count() == 0
    assert np.isfinite(C.STEPS).all()
