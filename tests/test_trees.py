"""Diff and merge against a direct recursive reading of their rules, on small random trees and on written-out cases."""

import random

import pytest
from pyspark.sql import Row

from palimpsest.operators import diff as D
from palimpsest.operators import merge as M
from palimpsest.operators import tree as T

# A tree is a dict: name -> ("file", content, mode, mtime) or ("dir", {children}).


def random_tree(rng, depth=3):
    out = {}
    for name in rng.sample("abc", rng.randint(0, 3)):
        if depth > 1 and rng.random() < 0.45:
            out[name] = ("dir", random_tree(rng, depth - 1))
        else:
            out[name] = ("file", rng.choice("xy"), rng.choice((420, 493)), rng.randint(0, 1))
    return out


def changed(rng, tree, depth=3):
    out = {}
    for name, e in tree.items():
        x = rng.random()
        if x < 0.12:
            continue
        if x < 0.2:
            out[name] = ("dir", random_tree(rng, depth - 1)) if e[0] == "file" and depth > 1 else ("file", rng.choice("xyz"), 420, 0)
        elif e[0] == "dir":
            out[name] = ("dir", changed(rng, e[1], depth - 1))
        else:
            out[name] = ("file", rng.choice("xyz") if x < 0.5 else e[1], rng.choice((420, 493)) if x > 0.9 else e[2], rng.randint(0, 1))
    if rng.random() < 0.3:
        out[rng.choice("abcd")] = ("file", rng.choice("xyz"), 420, 0)
    return out


def prune(tree):
    """Without empty directories, which files alone cannot show."""
    out = {}
    for k, e in tree.items():
        if e[0] == "file":
            out[k] = e
        elif sub := prune(e[1]):
            out[k] = ("dir", sub)
    return out


def files(tree, at=""):
    for k, e in tree.items():
        if e[0] == "dir":
            yield from files(e[1], f"{at}{k}/")
        else:
            yield Row(path=f"{at}{k}", content=e[1], mode=e[2], mtime_ns=e[3])


def ident(e):
    """What a tree id holds."""
    return e if e[0] == "file" else ("dir", tuple(sorted((k, ident(x)) for k, x in e[1].items())))


def same(a, b):
    if a is None or b is None:
        return a is b
    if a[0] != b[0]:
        return False
    return a[1:3] == b[1:3] if a[0] == "file" else ident(a) == ident(b)


def diff(a, b, at=""):
    out = set()
    for k in a.keys() | b.keys():
        x, y, path = a.get(k), b.get(k), f"{at}{k}"
        if x and y and x[0] == y[0] == "dir":
            out |= diff(x[1], y[1], f"{path}/") if ident(x) != ident(y) else set()
        elif not same(x, y):
            out.add((path, "added" if x is None else "removed" if y is None else "modified"))
    return out


def merge(b, o, t, resolve, at="", found=None):
    """Merged children of directories, and what is reported."""
    found = {"taken": set(), "conflict": set()} if found is None else found
    ib, io, it = (None if x is None else ident(("dir", x)) for x in (b, o, t))
    if io == it or ib == it:
        return o, found
    if ib == io:
        found["taken"] |= {p for p, _ in diff(o, t, at)}
        return t, found
    out = {}
    for k in o.keys() | t.keys() | (b or {}).keys():
        x, y, z, path = (b or {}).get(k), o.get(k), t.get(k), f"{at}{k}"
        if same(y, z) or same(z, x):
            pick = y
        elif same(y, x):
            found["taken"].add(path)
            pick = z
        elif y and z and y[0] == z[0] == "dir":
            pick = ("dir", merge(x[1] if x and x[0] == "dir" else None, y[1], z[1], resolve, f"{path}/", found)[0])
        elif y is None or z is None:
            if y is None:
                found["taken"].add(path)
            pick = y or z
        else:
            found["conflict"].add(path)
            pick = z if resolve == "theirs" else y
        if pick:
            out[k] = pick
    return out, found


def flat(tree, at=""):
    for k, e in tree.items():
        yield (f"{at}{k}", e[0])
        if e[0] == "dir":
            yield from flat(e[1], f"{at}{k}/")


def entries(spark, forest):
    """Entries of many trees in one table: tree i is below the directory t<i>, so that one job tests them all."""
    rows = [Row(path=f"t{i}/{r.path}", content=r.content, mode=r.mode, mtime_ns=r.mtime_ns) for i, t in enumerate(forest) for r in files(t)]
    df = spark.createDataFrame(rows, "path string, content string, mode int, mtime_ns long")
    return T.build(T.file_entries(df)).localCheckpoint()


@pytest.fixture(scope="module")
def cases(spark):
    rng = random.Random(7)
    base, ours, theirs = [], [], []
    while len(base) < 300:
        b = prune(random_tree(rng))
        o, t = prune(changed(rng, b)), prune(changed(rng, b))
        if b and o and t:
            base.append(b), ours.append(o), theirs.append(t)
    return base, ours, theirs, [entries(spark, x) for x in (base, ours, theirs)]


def test_diff(cases):
    base, ours, _, (b, o, _) = cases
    want = {(f"t{i}/{p}", c) for i in range(len(base)) for p, c in diff(base[i], ours[i])}
    assert {tuple(r) for r in D.diff(b, o).collect()} == want
    assert {tuple(r) for r in D.pruned(b, o).collect()} == want


@pytest.mark.parametrize("resolve", ["ours", "theirs"])
def test_merge(cases, resolve):
    base, ours, theirs, (b, o, t) = cases
    got = {(r.path, r.kind) for r in M.merge(b, o, t, resolve).collect()}
    forest = [{f"t{i}": ("dir", t) for i, t in enumerate(x)} for x in (base, ours, theirs)]
    want, found = merge(*forest, resolve)
    assert got == set(flat(want))
    assert {tuple(r) for r in M.outcome(b, o, t).collect()} == {(p, kind) for kind, ps in found.items() for p in ps}


def named(spark, mtime=0, **content):
    df = spark.createDataFrame([Row(path=p.replace("__", "/").replace("_", "."), content=c, mode=420, mtime_ns=mtime) for p, c in content.items()], "path string, content string, mode int, mtime_ns long")
    return T.build(T.file_entries(df))


def test_directories_taken_whole_or_not(spark):
    """Theirs rewrites one of two modules and drops a script; ours edits the other module, or the readme only."""
    base = named(spark, lib__io_py="io", lib__net_py="net", run_sh="run", readme="r")
    theirs = named(spark, 5, lib__io_py="IO", lib__net_py="net", lib__gpu_py="gpu", readme="r")
    ours = named(spark, 3, lib__io_py="io", lib__net_py="NET", run_sh="run", readme="r")
    assert {tuple(r) for r in M.outcome(base, ours, theirs).collect()} == {(p, "taken") for p in ("lib/io.py", "lib/gpu.py", "run.sh")}
    assert {r.path for r in M.merge(base, ours, theirs).collect() if r.kind == "file"} == {"lib/io.py", "lib/net.py", "lib/gpu.py", "readme"}
    ours = named(spark, lib__io_py="io", lib__net_py="net", run_sh="run", readme="R")
    assert {tuple(r) for r in M.outcome(base, ours, theirs).collect()} == {(p, "taken") for p in ("lib", "run.sh")}


def test_change_beats_deletion(spark):
    base = named(spark, dir__a="a", dir__b="b", c="c")
    ours, theirs = named(spark, c="c"), named(spark, dir__a="A", dir__b="b", c="c")
    assert {r.path for r in M.merge(base, ours, theirs).collect()} == {"dir", "dir/a", "dir/b", "c"}
    assert {tuple(r) for r in M.outcome(base, ours, theirs).collect()} == {("dir", "taken")}


def test_keep_both(spark):
    base, ours, theirs = (named(spark, a_txt=x, other="1") for x in ("a", "o", "t"))
    out = {r.path for r in M.merge(base, ours, theirs, "both", "feature").collect() if r.kind == "file"}
    assert out == {"a.txt", "a.feature.txt", "other"}
    ours = named(spark, **{"a_txt": "o", "other": "1", "a_feature_txt": "here already"})
    assert "a.feature-2.txt" in {r.path for r in M.merge(base, ours, theirs, "both", "feature").collect()}


def test_keep_both_with_many_names_taken(spark):
    base, ours, theirs = (named(spark, n_md=x) for x in ("b", "o", "t"))
    taken = {"n_side_md": "1"} | {f"n_side-{i}_md": "1" for i in range(2, 112)}
    ours = named(spark, n_md="o", **taken)
    assert "n.side-112.md" in {r.path for r in M.merge(base, ours, theirs, "both", "side").collect()}


def test_update_conflicts(spark):
    base = named(spark, a_txt="a", dir__b_txt="b", dir__c_txt="c")
    here = named(spark, a_txt="a", dir__b_txt="b", dir__c_txt="C", local_txt="l")
    there = named(spark, a_txt="a", dir__b_txt="B", dir__c_txt="c")
    assert D.update_conflicts(base, here, there).count() == 0
    assert [r.path for r in D.update_conflicts(base, named(spark, a_txt="1", dir__b_txt="b", dir__c_txt="c"), named(spark, a_txt="2", dir__b_txt="b", dir__c_txt="c")).collect()] == ["a.txt"]
    assert [r.path for r in D.update_conflicts(base, named(spark, a_txt="a"), there).collect()] == ["dir/b.txt"]
