import random

import numpy as np
import pytest

from palimpsest.llm import common
from palimpsest.llm import near_dedup as N
from palimpsest.llm.common import components

from .tools import ODD, documents, near_components, odd_columns, shingles


def texts(seed, n, groups):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choices("abcdefgh", k=rng.randint(1, 5)))
    out = {}
    for i in range(n):
        out[i] = " ".join(word() for _ in range(rng.randint(0, 60)))
    for g in range(groups):
        base = [word() for _ in range(rng.randint(5, 80))]
        for _ in range(rng.randint(2, 12)):
            w = list(base)
            for _ in range(rng.randint(0, 3)):
                w[rng.randrange(len(w))] = word()
            out[len(out)] = " ".join(w).upper() if rng.random() < 0.3 else "  ".join(w)
    ids = list(out)
    rng.shuffle(ids)
    return {i: t for i, t in zip(ids, out.values(), strict=True)}


@pytest.mark.parametrize("k", [4, 5])
def test_brute_force(spark, k):
    t = texts(3, 150, 40)
    got = {r.doc_id: r for r in N.near_duplicates(documents(spark, t), k=k).collect()}
    want = near_components(t, k)
    assert {i: r.component_id for i, r in got.items()} == want
    assert {i: r.n_shingles for i, r in got.items()} == {i: len(shingles(x, k)) for i, x in t.items()}
    assert all(r.kept == (i == want[i]) for i, r in got.items())


def test_chains_within_a_bucket(spark):
    """Texts whose neighbours are near and whose ends are not: links that no single pivot finds."""
    w = [f"w{i}" for i in range(400)]
    t = {i: " ".join(w[i * 4 : i * 4 + 200]) for i in range(40)}
    assert set(near_components(t, 5).values()) == {0}
    assert {r.component_id for r in N.near_duplicates(documents(spark, t)).collect()} == {0}


def test_links_are_written_once(spark, monkeypatch):
    """Links, those of the pivots and those of the blocks, are written as the edges of their components and nowhere else."""
    written = []
    for m in (N, common):
        monkeypatch.setattr(m, "cut", lambda df, name="t", f=m.cut: written.append((name, df.columns)) or f(df, name))
    w = [f"w{i}" for i in range(400)]
    t = {i: " ".join(w[i * 4 : i * 4 + 200]) for i in range(40)}
    assert {r.component_id for r in N.near_duplicates(documents(spark, t)).collect()} == {0}
    assert [name for name, columns in written if name == "links" or columns == ["u", "v"] and name == "edges"] == ["edges", "edges"]


def test_similar_texts_that_are_not_linked(spark, monkeypatch):
    """Many texts of about 0.7, in buckets of several blocks, some of them linked in pairs."""
    monkeypatch.setattr(N, "BLOCK", 8)
    rng = random.Random(1)
    common = [f"c{i}" for i in range(170)]
    t = {}
    for i in range(60):
        own = [f"o{i}x{j}" for j in range(30)]
        t[2 * i] = " ".join(common + own)
        if i % 3 == 0:
            t[2 * i + 1] = " ".join(common + own[:-1] + ["z"])
    rng.shuffle(common)
    want = near_components(t, 5)
    assert len(set(want.values())) == 60 and len(want) == 80
    assert {r.doc_id: r.component_id for r in N.near_duplicates(documents(spark, t)).collect()} == want


def test_sketches_are_filled_and_estimate():
    rng = np.random.default_rng(5)
    sets = [rng.integers(1, 1 << 63, n).astype(np.uint64) for n in (1, 2, 50, 2000)]
    half = np.concatenate((sets[3][:1000], rng.integers(1, 1 << 63, 1000).astype(np.uint64)))
    s = N.sketches([*sets, half, np.zeros(0, np.uint64)], 160)
    assert (s[:5] != N.EMPTY).all() and (s[5] == N.EMPTY).all()
    assert abs((s[3] == s[4]).mean() - 1 / 3) < 0.15


def test_odd_rows(spark):
    rows = {}
    for r in N.near_duplicates(odd_columns(documents(spark, ODD))).collect():
        rows.setdefault(r.doc_id, []).append((r.n_shingles, r.component_id, r.kept))
    assert all(rows[i] == [(0, i, True)] for i in (1, 2, 3))
    assert rows[4] == [(1, 4, True)] and rows[5] == [(6, 5, True)]
    assert rows[6] == [(1, 6, True)] * 2 and rows[7] == [(1, 6, False)]
    assert sorted(rows[None], key=str) == [(0, None, True), (1, None, True)]
    assert N.near_duplicates(documents(spark, {})).count() == 0


def test_one_of_each_stays(spark):
    d = odd_columns(documents(spark, ODD))
    kept = N.keep_one(d)
    assert kept.columns == d.columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == ["1", "2", "3", "4", "5", "6", "8", "None", "None"]


def test_rows_of_one_id_and_without_one(spark):
    """Each text is judged on its own: an id with a copy and another text loses only the copy."""
    base = " ".join(f"w{i}" for i in range(40))
    near, other = base + " end", " ".join(f"v{i}" for i in range(40))
    rows = [(3, base), (7, near), (7, other), (7, other), (None, base.upper()), (None, other + " x"), (None, "alone here"), (None, "alone here")]
    got = N.keep_one(documents(spark, rows)).collect()
    assert sorted((str(r.doc_id), r.text) for r in got) == sorted([("3", base), ("7", other), ("None", "alone here")])
    all_rows = N.near_duplicates(documents(spark, rows)).collect()
    assert sorted(((str(r.doc_id), r.component_id) for r in all_rows), key=str) == sorted([("3", 3), ("7", 3), ("7", 7), ("7", 7), ("None", 3), ("None", 7), ("None", None), ("None", None)], key=str)


def test_large_components_meet_only_others(spark, monkeypatch):
    """Two large groups of one pivot and single texts between them: blocks of one group never meet, and no link is lost."""
    monkeypatch.setattr(N, "BLOCK", 5)
    rows = [(1, n, 100 + n % 2 if n < 40 else n) for n in range(60)]
    dealt = N._dealt(spark.createDataFrame(rows, "b long, node long, root long")).collect()
    owner = {n: r if n < 40 else -1 for _, n, r in rows}
    assert {r.node for r in dealt} == set(range(60))
    groups = {}
    for r in dealt:
        groups.setdefault((r.p, r.q), []).append(r)
    met = {(a.node, b.node) for g in groups.values() for a in g if a.side == 0 for b in g if b.side == 1 or a.p == a.q}
    met |= {(b, a) for a, b in met}
    assert all(((a, b) in met) == (owner[a] != owner[b] or owner[a] == -1) for a in range(60) for b in range(60) if a != b)


def test_components(spark):
    rng = random.Random(2)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(260)] + [(500, i) for i in range(501, 540)] + [(i, i + 1) for i in range(1000, 1050)]
    up = {}

    def find(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for a, b in edges:
        x, y = sorted((find(a), find(b)))
        up[y] = x
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: find(x) for a, b in edges for x in (a, b) if a != b}
