import random

import pytest
from pyspark.sql import functions as F

from palimpsest.llm import mixing as M

from .tools import ODD, WORD, documents, odd_columns


def fill(sizes, weights=(1, 2, 3), most=3):
    """Targets by sharing the excess again and again."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {n: weights[i % 3] for i, n in enumerate(names)}
    left, free, out = sum(sizes.values()), set(names), {}
    while free:
        total = sum(w[n] for n in free)
        over = [n for n in free if left * w[n] / total > most * sizes[n]]
        if not over:
            return out | {n: left * w[n] / total for n in free}
        for n in over:
            out[n] = most * sizes[n]
            free.discard(n)
        left = sum(sizes.values()) - sum(out.values())
    return out


@pytest.mark.parametrize("per_bucket", [5, 20_000])
def test_targets_and_takes(spark, monkeypatch, per_bucket):
    monkeypatch.setattr(M, "PER_BUCKET", per_bucket)
    rng = random.Random(9)
    source = {i: rng.choice(["a", "a", "a", "a", "b", "c", "é", None, "Z"]) for i in range(300)}
    texts = {i: "w " * rng.choice([0, 1, 5, 40, 300 if source[i] == "a" else 3]) for i in source}
    d = documents(spark, texts, source=lambda i: source[i])
    rows = M.schedule(d).collect()
    sizes = {}
    for i, t in texts.items():
        sizes[source[i]] = sizes.get(source[i], 0) + len(WORD.findall(t))
    want = fill(sizes)
    taken = {}
    for r in rows:
        s = source[r.doc_id]
        assert r.size == len(WORD.findall(texts[r.doc_id])) and r.source_size == sizes[s] and abs(r.target - want[s]) < 1e-6
        assert 0 <= r.taken <= 3 * r.size and (r.taken > 0) == (r.position is not None)
        taken[s] = taken.get(s, 0) + r.taken
    assert all(abs(taken[s] - want[s]) <= 1 for s in want)
    assert all(r.position is None or 0 <= r.position < 1 for r in rows)
    assert sorted(map(tuple, M.schedule(d.repartition(7)).collect()), key=str) == sorted(map(tuple, rows), key=str)


def test_moment_inverts_the_integral(spark):
    df = spark.range(101).select((F.col("id") / 100).alias("q"))
    for a in (-1.0, -0.5, 0.0, 0.5, 1.0):
        for r in df.select("q", M.moment(F.col("q"), F.lit(a)).alias("t")).collect():
            assert abs(r.t + a * (r.t * r.t - r.t) - r.q) < 1e-9 and 0 <= r.t <= 1


def test_the_mix_has_what_the_plan_takes(spark):
    texts = {i: "\n" + "".join(f"{i}w{j}" + (" ", "\n", " \t ")[j % 3] for j in range(10 + i % 7)) for i in range(60)}
    d = odd_columns(documents(spark, texts, source=lambda i: "abc"[i % 20 // 9]))
    plan = {r.doc_id: r.taken for r in M.schedule(d).collect()}
    out = M.mixed(d)
    assert out.columns == d.columns
    got = {}
    for r in out.collect():
        assert texts[r.doc_id].startswith(r.text) and r.n_chars == len(r.text)
        got[r.doc_id] = got.get(r.doc_id, 0) + len(r.text.split())
    assert got == {i: n for i, n in plan.items() if n}


def test_odd_rows(spark):
    d = odd_columns(documents(spark, ODD, source=lambda i: None if i == 4 else "s"))
    assert M.schedule(d).count() == len(ODD)
    assert M.schedule(documents(spark, {})).count() == 0 and M.mixed(documents(spark, {})).count() == 0
    empty = documents(spark, {1: None, 2: ""})
    assert [(r.size, r.taken, r.target) for r in M.schedule(empty).collect()] == [(0, 0, 0.0)] * 2
