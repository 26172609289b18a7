import datetime as dt

import pytest
from pyspark.sql import functions as F

from palimpsest.sources.files import export_dir, import_dir
from palimpsest.streaming.sessions import commits, publish_once, sessions, stream_commits


def test_a_gap_of_exactly_quiet_splits(spark):
    w = spark.createDataFrame([(1, 0, 1), (1, 4, 2), (1, 9, 3)], "mount long, at long, id long")
    assert [(r.first, r.last) for r in sessions(w, 5).orderBy("session").collect()] == [(0, 4), (9, 9)]
    w = spark.createDataFrame([(1, i, i) for i in range(0, 10)], "mount long, at long, id long")
    assert [(r.first, r.writes) for r in commits(w, 5, 4).orderBy("session").collect()] == [(0, 4), (4, 4), (8, 2)]


def test_stream_commits(spark, tmp_path):
    start = dt.datetime(2024, 1, 1)
    rows = [(1, start + dt.timedelta(seconds=s)) for s in (0, 2, 4, 20, 21)] + [(2, start + dt.timedelta(seconds=600))]
    spark.createDataFrame(rows, "mount long, ts timestamp").repartition(1).write.parquet(str(tmp_path / "in"))
    out = stream_commits(spark.readStream.schema("mount long, ts timestamp").parquet(str(tmp_path / "in")))
    q = out.writeStream.outputMode("append").format("memory").queryName("commits").option("checkpointLocation", str(tmp_path / "c")).start()
    try:
        q.processAllAvailable()
    finally:
        q.stop()
    got = {(r.mount, r.writes) for r in spark.sql("select * from commits").collect()}
    assert (1, 3) in got


def test_publish_once(spark, tmp_path):
    b = spark.range(3)
    assert publish_once(b, 7, str(tmp_path)) and not publish_once(b, 7, str(tmp_path))
    assert spark.read.parquet(str(tmp_path)).count() == 3


def test_export_and_import(spark, tmp_path):
    f = spark.createDataFrame([("a/b.txt", bytearray(b"one")), ("c", bytearray(b""))], "path string, data binary")
    to = str(tmp_path / "out")
    assert {(r.path, r.bytes) for r in export_dir(f, to).collect()} == {("a/b.txt", 3), ("c", 0)}
    back = import_dir(spark, f"file://{to}").select("path", F.decode("content", "UTF-8").alias("t"))
    assert {tuple(r) for r in back.collect()} == {("a/b.txt", "one"), ("c", "")}


def test_export_stays_below_its_folder(spark, tmp_path):
    for n, path in enumerate(("../out", "/etc/x", "a/../../b", "a//b", "./a")):
        with pytest.raises(ValueError, match="not a path"):
            export_dir(spark.createDataFrame([(path, bytearray(b"x"))], "path string, data binary"), str(tmp_path / f"to{n}"))
    f = spark.createDataFrame([("k/run", bytearray(b"1"), 0o755, 5 * 10**9)], "path string, data binary, mode int, mtime_ns long")
    export_dir(f, str(tmp_path / "ok")).collect()
    got = (tmp_path / "ok" / "k" / "run").stat()
    assert (got.st_mode & 0o777, got.st_mtime_ns) == (0o755, 5 * 10**9)
