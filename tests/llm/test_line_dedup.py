import collections
import hashlib
import random

import numpy as np

from palimpsest.llm import line_dedup as L
from palimpsest.llm.common import has_bits, seen_bits

from .tools import LOWER, ODD, WHITE, documents, odd_columns


def brute(texts, chars=40, docs=5):
    key = lambda x: x.strip(WHITE).translate(LOWER)
    having = collections.defaultdict(set)
    for i, t in texts.items():
        for x in (t or "").split("\n"):
            if len(key(x)) >= chars:
                having[key(x)].add(i)
    last = {k: max(v) for k, v in having.items() if len(v) >= docs}
    return {i: [x for x in (t or "").split("\n") if last.get(key(x), i) == i] for i, t in texts.items()}


def corpus(seed):
    rng = random.Random(seed)
    lines = ["x" * 39, "y" * 40, "é" * 39, "ß" * 40, "Z" * 50, "z" * 50, " \t" + "w" * 45 + "\r", "漢" * 13, "漢" * 40, "short", "", "   "] + [f"line {i} of a longer kind that some documents share" for i in range(30)]
    return {i: "\n".join(rng.choices(lines, k=rng.randint(0, 12)) + [f"own line {i} " + "v" * 40] * rng.randint(0, 2)) for i in range(120)}


def test_brute_force(spark):
    texts = corpus(1)
    want = brute(texts)
    for r in L.drop_repeated_lines(documents(spark, texts)).collect():
        assert (r.n_lines, r.n_dropped, r.kept_text) == (len(texts[r.doc_id].split("\n")), len(texts[r.doc_id].split("\n")) - len(want[r.doc_id]), "\n".join(want[r.doc_id]))


def test_full_filters_lose_nothing(spark, monkeypatch):
    monkeypatch.setattr(L, "log2_bits_for", lambda *a, **k: 8)
    texts = corpus(2)
    want = brute(texts)
    assert {r.doc_id: r.kept_text for r in L.drop_repeated_lines(documents(spark, texts)).collect()} == {i: "\n".join(x) for i, x in want.items()}


def test_filters_of_parts_lose_nothing(spark):
    """With room for 2**10 bits only, hashes are dealt to many filters."""
    texts = corpus(3) | {1000 + i: "one line that hundreds of documents hold, all in one batch" for i in range(300)}
    want = brute(texts)
    got = L.drop_repeated_lines(documents(spark, texts), high=10).collect()
    assert {r.doc_id: r.kept_text for r in got} == {i: "\n".join(x) for i, x in want.items()} and len(got) == len(texts)


def test_bits_seen_twice(spark):
    once, twice = list(range(1000)), list(range(5000, 5400))
    df = spark.createDataFrame([(x,) for x in once + twice + twice], "h long").repartition(5)
    filled = seen_bits(df, 18, twice=True)
    assert has_bits(filled, np.array(twice, np.uint64)).all()
    assert has_bits(filled, np.array(once, np.uint64)).mean() < 0.05
    assert has_bits(seen_bits(df, 18), np.array(once + twice, np.uint64)).all()


def test_odd_rows(spark):
    rows = L.drop_repeated_lines(odd_columns(documents(spark, ODD))).collect()
    assert len(rows) == len(ODD)
    assert all((r.n_lines, r.n_dropped, r.kept_text) == (1, 0, "") for r in rows if r.doc_id in (1, 2))
    line = "a line that is long enough to be a key of its own"
    shared = [(i, line) for i in (1, 2, 3, 4, 5, 5, None)]
    got = sorted((str(r.doc_id), r.n_dropped) for r in L.drop_repeated_lines(documents(spark, shared)).collect())
    assert got == [("1", 1), ("2", 1), ("3", 1), ("4", 1), ("5", 0), ("5", 0), ("None", 1)]
    assert L.drop_repeated_lines(documents(spark, {})).count() == 0
    empty = hashlib.sha256(b"").hexdigest()
    assert L.drop_repeated_lines(documents(spark, {1: None})).selectExpr("sha2(kept_text, 256) as s").first().s == empty
