import random

import pytest
from pyspark.sql import functions as F

from palimpsest.functions import scalars as S
from test_refs import names_by_rule

from palimpsest.operators import cache, history, overlay, reach, tree


def one(spark, c):
    return spark.range(1).select(c.alias("x")).first().x


def test_times(spark):
    assert one(spark, S.rfc3339(F.lit(1758888000 * 10**9))) == "2025-09-26T12:00:00Z"
    assert one(spark, S.rfc3339(F.lit(-1))) == "1969-12-31T23:59:59Z"
    assert one(spark, S.parse_rfc3339(F.lit("2000-02-29T00:00:00Z"))) == 951782400 * 10**9
    for bad in ("2000-13-01T00:00:00Z", "2000-01-01 00:00:00Z", "2000-01-01T00:00:00", "2000-01-01T00:00:00Zx"):
        assert one(spark, S.parse_rfc3339(F.lit(bad))) is None


def test_names(spark):
    want = dict(names_by_rule(random.Random(11)))
    df = spark.createDataFrame([(x,) for x in want], "n string").select("n", S.valid_branch(F.col("n")).alias("ok"))
    assert {r.n: r.ok for r in df.collect()} == want


def test_refspecs(spark):
    """All targets by all paths: the kind is that of the target, and the path decides whether the whole is one."""
    targets = {"trunk": ("branch", "trunk"), "snap/r7": ("snapshot", "r7"), "0a1b2c3d4e": ("commit", "0a1b2c3d4e"), "f" * 64: ("commit", "f" * 64), "f" * 65: None, "0A1B2C3D": None, "snap/..": None, "-t": None, "": None, "0a1b2c3": ("branch", "0a1b2c3")}
    paths = {"": (True, None), ":": (True, None), ":src": (True, "src"), ":src/m.py//": (True, "src/m.py"), ":/src": (False, None), ":p:q": (True, "p:q")}
    rows = [(t + p, t, p) for t in targets for p in paths]
    df = spark.createDataFrame(rows, "s string, t string, p string").select("t", "p", S.parse_refspec(F.col("s")).alias("r"))
    for r in df.collect():
        ok, path = paths[r.p]
        assert (tuple(r.r) if r.r else None) == ((*targets[r.t], path) if targets[r.t] and ok else None), (r.t, r.p)


def test_paths_and_copies(spark):
    assert one(spark, S.ancestors(F.lit("a/b"))) == ["", "a", "a/b"]
    assert one(spark, S.parent(F.lit("a"))) == "" and one(spark, S.parent(F.lit("a/b/c"))) == "a/b"
    assert one(spark, S.both_name(F.lit("a.txt"), F.lit("f"), F.lit(1))) == "a.f.txt"
    assert one(spark, S.both_name(F.lit(".rc"), F.lit("f"), F.lit(3))) == ".rc.f-3"
    assert one(spark, S.tombstone_name(F.lit("v1.2.17"))) == "v1.2" and one(spark, S.tombstone_secs(F.lit("v1.2.17"))) == 17
    assert one(spark, S.tombstone_name(F.lit("v1"))) is None


def test_blocks(spark):
    block = 65536
    assert one(spark, S.blocks_of(F.lit(0), F.lit(1))) == 1
    assert one(spark, S.blocks_of(F.lit(block - 1), F.lit(block + 1))) == 3
    assert one(spark, S.blocks_of(F.lit(0), F.lit(64 * block))) == -1
    assert one(spark, S.blocks_of(F.lit(5), F.lit(5))) == 0
    assert one(spark, S.present_bytes(F.lit(3).cast("long"), F.lit(block + 10).cast("long"))) == block + 10
    assert one(spark, S.present_bytes(F.lit(1).cast("long"), F.lit(block + 10).cast("long"))) == block


def test_blocks_at_the_end_of_the_bitmap(spark):
    block = 65536
    for first, last in [(0, 61), (0, 62), (62, 62), (62, 63), (63, 63), (63, 70), (5, 200), (64, 64), (70, 130)]:
        r = spark.createDataFrame([(first * block + 7, last * block + 9)], "start long, stop long")
        got = r.select(S.blocks_of(F.col("start"), F.col("stop"))).first()[0]
        assert got % (1 << 64) == sum(1 << k for k in range(first, min(last, 63) + 1)), (first, last)
    # Of 200 blocks the bitmap knows 64, all of them whole; the short last one is not among them.
    long = F.lit(200 * block + 10).cast("long")
    assert one(spark, S.present_bytes(F.lit(-1).cast("long"), long)) == 64 * block
    assert one(spark, S.present_bytes(F.lit(-1).cast("long"), F.lit(63 * block + 10).cast("long"))) == 63 * block + 10


def test_eviction_keeps_the_newest(spark):
    rows = [("c", 2, 1000, 1), ("c", 3, 1000, 2), ("c", 1, 1000, 3), ("c", 4, 1000, 4)]
    df = spark.createDataFrame(rows, "cache string, id long, size long, last_access long")
    assert [r.id for r in cache.evict(df, 3000).collect()] == [2]
    assert sorted(r.id for r in cache.evict(df, 10).collect()) == [1, 2, 3]


def test_log_by_path(spark):
    s = spark.createDataFrame([("m", 0, "1"), ("m", 1, "2"), ("m", 2, "2"), ("m", 3, None), ("n", 0, None)], "branch string, seq long, content_id string").withColumn("mode", F.when(F.col("content_id").isNotNull(), 1))
    assert sorted((r.branch, r.seq) for r in history.log_path(s).collect()) == [("m", 0), ("m", 1), ("m", 3)]


def test_retention_keeps_the_head(spark):
    e = spark.createDataFrame([("m", 0, "a", 0, "auto"), ("m", 1, "b", 0, "manual"), ("m", 2, "c", 0, "auto")], "branch string, seq long, commit string, time_ns long, kind string")
    now = 100 * history.DAY_NS
    assert sorted(r.commit for r in history.retain(e, now).collect()) == ["b", "c"]
    assert sorted(r.commit for r in history.retain(e, now, manual_days=1).collect()) == ["c"]


def test_closure_of_a_diamond(spark):
    g = spark.createDataFrame([(1, 2), (1, 3), (2, 4), (3, 4), (4, 5), (9, 8)], "src long, dst long")
    assert sorted(r.id for r in reach.mark(spark.createDataFrame([(1,)], "id long"), g).collect()) == [1, 2, 3, 4, 5]


def test_closure_of_a_chain_and_of_a_cycle(spark):
    g = spark.createDataFrame([(i, i + 1) for i in range(14)] + [(14, 3)], "src long, dst long")
    assert sorted(r.id for r in reach.mark(spark.createDataFrame([(0,)], "id long"), g).collect()) == list(range(15))


def test_flatten_of_a_tree_that_contains_itself(spark):
    t = "tree_id string, name string, kind string, ref_id string"
    deep = spark.createDataFrame([(f"t{i}", "d", "dir", f"t{i + 1}") for i in range(8)] + [("t8", "f", "file", "c")], t)
    assert max(r.path.count("/") for r in tree.flatten(deep, "t0").collect()) == 8
    with pytest.raises(ValueError, match="contains itself"):
        tree.flatten(spark.createDataFrame([("a", "x", "dir", "b"), ("b", "y", "dir", "a")], t), "a")


def test_zeros_after_a_truncation(spark):
    f = spark.createDataFrame([(1, 100, 40)], "file long, size long, base_visible long")
    x = spark.createDataFrame([(1, 30, 50), (1, 60, 200)], "file long, start long, stop long")
    got = [(r.start, r.stop, r.source) for r in overlay.sources(x, f).orderBy("start").collect()]
    assert got == [(0, 30, "base"), (30, 40, "overlay"), (40, 50, "overlay"), (50, 60, "zero"), (60, 100, "overlay")]
