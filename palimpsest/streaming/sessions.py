"""Commits triggered by writes, and readahead: the stateful loops, in batch and on streams."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.chunking import _fold

QUIET_S, DIRTY_S = 5, 60
MIB = 1 << 20


def sessions(writes: DataFrame, quiet_us: int) -> DataFrame:
    """(mount, session, first, last, writes) of writes(mount, at, id), at in microseconds: a gap of exactly quiet_us begins a
    new session, as the trigger fires at it."""
    w = Window.partitionBy("mount").orderBy("at", "id")
    new = F.coalesce((F.col("at") - F.lag("at").over(w) >= quiet_us).cast("int"), F.lit(1))
    s = writes.withColumn("new", new).withColumn("session", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0)) - 1)
    return s.groupBy("mount", "session").agg(F.min("at").alias("first"), F.max("at").alias("last"), F.count("*").alias("writes"))


def commits(writes: DataFrame, quiet_us: int, dirty_us: int) -> DataFrame:
    """As sessions, but a session also ends once it has been dirty for dirty_us."""

    def step(state: tuple[int, int, int], row: tuple) -> tuple[int, tuple[int, int, int]]:
        n, first, last = state
        at = row[1]
        if n < 0 or at - last >= quiet_us or at - first >= dirty_us:
            n, first = n + 1, at
        return n, (n, first, at)

    s = _fold(writes, "mount", ["at", "id"], ["mount", "at", "id"], "session", lambda: (-1, 0, 0), step)
    return s.groupBy("mount", "session").agg(F.min("at").alias("first"), F.max("at").alias("last"), F.count("*").alias("writes"))


def readahead(reads: DataFrame, least: int = 2 * MIB, most: int = 128 * MIB, slack: int = MIB) -> DataFrame:
    """reads(handle, seq, offset, len) with window: bytes read ahead, 0 while a handle's reads are not sequential.

    A read within `slack` of where the last one ended adds to a count, any other resets it; from the second on the
    window is `least`, and doubles with each further one up to `most`.
    """

    def step(state: tuple[int, int, int], row: tuple) -> tuple[int, tuple[int, int, int]]:
        count, window, expected = state
        _, _, offset, length = row
        count = count + 1 if expected >= 0 and abs(offset - expected) <= slack else 0
        window = 0 if count < 2 else min(most, window * 2 if window else least)
        return window, (count, window, offset + length)

    return _fold(reads, "handle", ["seq"], ["handle", "seq", "offset", "len"], "window", lambda: (0, 0, -1), step)


def stream_commits(writes: DataFrame, quiet_s: int = QUIET_S, dirty_s: int = DIRTY_S) -> DataFrame:
    """A stream of (mount, first, last, writes) from a stream of writes(mount, ts): one row when a mount has been quiet, or
    dirty for long enough, in event time. Late writes are taken within a minute."""

    def update(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        first, last, n = state.get if state.exists else (None, None, 0)
        out = []
        at = [] if state.hasTimedOut else sorted(int(t.value // 1000) for b in batches for t in b["ts"])
        for t in at:
            if n and (t - last >= quiet_s * 1_000_000 or t - first >= dirty_s * 1_000_000):
                out.append((key[0], first, last, n))
                first, n = None, 0
            first = t if first is None else first
            last, n = t, n + 1
        if state.hasTimedOut and n:
            out.append((key[0], first, last, n))
            state.remove()
        elif n:
            state.update((first, last, n))
            due = min(last + quiet_s * 1_000_000, first + dirty_s * 1_000_000) // 1000
            state.setTimeoutTimestamp(max(due, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame(out, columns=["mount", "first", "last", "writes"]).astype({"mount": "int64", "first": "int64", "last": "int64", "writes": "int64"})

    w = writes.withWatermark("ts", "1 minute")
    return w.groupBy("mount").applyInPandasWithState(update, "mount long, first long, last long, writes long", "first long, last long, writes long", "append", GroupStateTimeout.EventTimeTimeout)


def follow(spark: SparkSession, root: str, *names: str) -> DataFrame:
    """A stream of (name, head, number) of the branches of a repository, from each state that is written to it: a row
    whenever a branch's head is another than in the state before, so a head that comes back is told again. One head and
    number is kept for each name; states that arrive after a later one of the name are passed over."""
    states = spark.readStream.format("text").option("wholetext", "true").option("pathGlobFilter", "*.json").load(f"{root}/state")
    number = F.regexp_extract(F.input_file_name(), r"(\d+)\.json$", 1).cast("long")
    branches = F.from_json("value", "branches map<string, struct<head: string>>")["branches"]
    out = states.select(number.alias("number"), F.explode(F.map_entries(branches)).alias("b")).select(F.col("b.key").alias("name"), F.col("b.value.head").alias("head"), "number")
    out = out.where(F.col("name").isin(*names)) if names else out

    def update(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        head, last = state.get if state.exists else (None, -1)
        told = []
        for number, now in sorted((int(n), h) for b in batches for n, h in zip(b["number"], b["head"], strict=True)):
            if number > last:
                if now != head:
                    told.append((key[0], now, number))
                head, last = now, number
        state.update((head, last))
        yield pd.DataFrame(told, columns=["name", "head", "number"]).astype({"number": "int64"})

    return out.groupBy("name").applyInPandasWithState(update, "name string, head string, number long", "head string, number long", "append", GroupStateTimeout.NoTimeout)


def publish_once(batch: DataFrame, batch_id: int, folder: str) -> bool:
    """Writes a micro-batch under its id; a batch that was published before is left alone. For foreachBatch."""
    path = f"{folder}/batch={batch_id}"
    conf = batch.sparkSession.sparkContext._jsc.hadoopConfiguration()
    done = batch.sparkSession.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    if done.getFileSystem(conf).exists(done):
        return False
    batch.write.mode("overwrite").parquet(path)
    return True
