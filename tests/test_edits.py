"""Edits of a tree: results of requests, moves, whiteouts, mounts."""

from palimpsest.operators import diff, edits, reach

TREE = [("", "dir"), ("a", "dir"), ("a/f", "file"), ("a/l", "symlink"), ("b", "dir"), ("b/c", "dir"), ("e", "dir")]


def tree(spark, rows=TREE):
    return spark.createDataFrame(rows, "path string, kind string")


def test_results(spark):
    cases = [
        ("create", "a/new", None, False, "ok"),
        ("create", "a/f", None, False, "exists"),
        ("mkdir", "x/new", None, False, "missing"),
        ("mkdir", "a/f/new", None, False, "not_dir"),
        ("mkdir", "a/..", None, False, "invalid"),
        ("create", "a/" + "n" * 255, None, False, "ok"),
        ("create", "a/" + "n" * 256, None, False, "too_long"),
        ("symlink", "a/s", "", False, "invalid"),
        ("symlink", "a/s", "t" * 4095, False, "ok"),
        ("symlink", "a/s", "t" * 4096, False, "invalid"),
        ("unlink", "a/l", None, False, "ok"),
        ("unlink", "a", None, False, "is_dir"),
        ("unlink", "zz", None, False, "missing"),
        ("rmdir", "b", None, False, "not_empty"),
        ("rmdir", "b/c", None, False, "ok"),
        ("rmdir", "a/f", None, False, "not_dir"),
        ("truncate", "a/l", None, False, "invalid"),
        ("truncate", "a", None, False, "is_dir"),
        ("readlink", "a/l", None, False, "ok"),
        ("readlink", "a/f", None, False, "invalid"),
        ("rename", "a/f", "e/g", False, "ok"),
        ("rename", "a/f", "a/f", True, "ok"),
        ("rename", "a/f", "a/l", False, "ok"),
        ("rename", "a/f", "a/l", True, "exists"),
        ("rename", "a/f", "e", False, "is_dir"),
        ("rename", "b", "a/f", False, "not_dir"),
        ("rename", "b", "e", False, "ok"),
        ("rename", "b", "a", False, "not_empty"),
        ("rename", "b", "b/c/d", False, "invalid"),
        ("rename", "no", "a/..", False, "invalid"),
        ("rename", "no", "a/x", False, "missing"),
    ]
    asked = spark.createDataFrame([(i, *c[:4]) for i, c in enumerate(cases)], "request int, op string, path string, to string, no_replace boolean")
    got = {r["request"]: r["result"] for r in edits.judge(tree(spark), asked).collect()}
    assert [(i, got[i]) for i in range(len(cases))] == [(i, c[4]) for i, c in enumerate(cases)]


def test_a_move_takes_all_below_and_replaces_the_target(spark):
    moves = spark.createDataFrame([("b", "e"), ("a/f", "a/l")], "path string, to string")
    got = {(r["path"], r["kind"]) for r in edits.rename(tree(spark), moves).collect()}
    assert got == {("", "dir"), ("a", "dir"), ("a/l", "file"), ("e", "dir"), ("e/c", "dir")}


def test_whiteouts_are_topmost(spark):
    now = tree(spark, [r for r in TREE if r[0] not in ("b", "b/c", "a/f")])
    assert {r["path"] for r in edits.whiteouts(tree(spark), now).collect()} == {"b", "a/f"}


def test_touched(spark):
    paths = spark.createDataFrame([("a/f",), ("b/c",)], "path string")
    assert {r["path"] for r in edits.touched(paths).collect()} == {"", "a", "a/f", "b", "b/c"}


def test_empty_status(spark):
    none = tree(spark).where("false")
    pending = spark.createDataFrame([], "time_ns long")
    assert edits.status(none, none, pending).collect() == [(0, 0, None)]


def test_behind(spark):
    mounts = spark.createDataFrame([(1, "m", "x"), (2, "m", "y"), (3, None, "x"), (4, "gone", "x")], "mount int, branch string, seen string")
    heads = spark.createDataFrame([("m", "x")], "branch string, head string")
    assert dict(edits.behind(mounts, heads).collect()) == {1: False, 2: True, 3: False, 4: True}


def test_message_and_schedule(spark):
    paths = spark.createDataFrame([(f"p{i}",) for i in range(6)], "path string")
    assert diff.message(paths).collect()[0][0] == "p0, p1, p2, p3, p4, ..."
    assert diff.message(paths.where("path < 'p5'")).collect()[0][0] == "p0, p1, p2, p3, p4"
    assert diff.message(paths.where("false")).collect()[0][0] == ""
    runs = spark.createDataFrame([("a", 0), ("b", 50), ("c", None)], "repository string, finished long")
    assert dict(reach.gc_due(runs, 86_440).collect()) == {"a": True, "b": False, "c": True}
