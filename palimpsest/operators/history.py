"""Logs of commits: order, paths, segments, retention, tombstones, commit prefixes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalars as S

SEGMENT = 1000
DAY_NS = 86_400_000_000_000


def numbered(entries: DataFrame, *order: str) -> DataFrame:
    """entries(branch, ...) with seq from 0, oldest first."""
    return entries.withColumn("seq", F.row_number().over(Window.partitionBy("branch").orderBy(*order)) - 1)


def log(entries: DataFrame) -> DataFrame:
    """Newest first."""
    return entries.orderBy("branch", F.col("seq").desc())


def log_path(states: DataFrame) -> DataFrame:
    """The entries that changed a path, from states(branch, seq, content_id, mode): null content where it is absent.

    An entry is kept if the next older one has other content or mode; the oldest if the path is there.
    """
    w = Window.partitionBy("branch").orderBy(F.col("seq").desc())
    now, older = F.struct("content_id", "mode"), F.lead(F.struct("content_id", "mode")).over(w)
    oldest = F.lead("seq").over(w).isNull()
    s = states.withColumn("older", older).withColumn("oldest", oldest)
    there = F.col("content_id").isNotNull()
    differs = ~now.eqNullSafe(F.col("older")) & (there | F.col("older.content_id").isNotNull())
    return s.where(F.when(F.col("oldest"), there).otherwise(differs)).drop("older", "oldest")


def segments(entries: DataFrame, size: int = SEGMENT) -> DataFrame:
    """The log of each branch in segments of `size` entries; head is the last entry's commit."""
    e = entries.withColumn("segment", F.floor(F.col("seq") / size))
    return e.groupBy("branch", "segment").agg(F.count("*").alias("entries"), F.min("time_ns").alias("first_ns"), F.max("time_ns").alias("last_ns"), F.max_by("commit", "seq").alias("head"))


def append(entries: DataFrame, new: DataFrame) -> DataFrame:
    """entries and new(branch, time_ns, commit, kind, message) after them, in the order of their times."""
    last = entries.groupBy("branch").agg(F.max("seq").alias("last"))
    n = new.join(last, "branch", "left").withColumn("seq", F.coalesce("last", F.lit(-1)) + F.row_number().over(Window.partitionBy("branch").orderBy("time_ns", "commit"))).drop("last")
    return entries.unionByName(n.select(entries.columns))


def kept(kind: Column, time_ns: Column, commit: Column, head: Column, now_ns: int, auto_days: int = 14, manual_days: int = 0) -> Column:
    """Auto entries go when they are older than auto_days, others only if manual_days is set; the head's always stay."""
    auto = time_ns >= now_ns - auto_days * DAY_NS
    manual = time_ns >= now_ns - manual_days * DAY_NS if manual_days else F.lit(True)
    return (commit == head) | F.when(kind == "auto", auto).otherwise(manual)


def retain(entries: DataFrame, now_ns: int, auto_days: int = 14, manual_days: int = 0) -> DataFrame:
    """The entries that retention keeps, with their branch's head."""
    heads = entries.groupBy("branch").agg(F.max_by("commit", "seq").alias("head"))
    e = entries.join(heads, "branch")
    return e.where(kept(F.col("kind"), F.col("time_ns"), F.col("commit"), F.col("head"), now_ns, auto_days, manual_days))


def tombstones(keys: DataFrame) -> DataFrame:
    """keys(key, ...) with name and secs, without keys of another form."""
    return keys.withColumn("name", S.tombstone_name(F.col("key"))).withColumn("secs", S.tombstone_secs(F.col("key"))).where("name is not null")


def list_deleted(stones: DataFrame, now_secs: int, ttl_secs: int) -> DataFrame:
    """Those that can still be restored, newest first."""
    return stones.where(F.col("secs") >= now_secs - ttl_secs).orderBy(F.col("secs").desc(), "name")


def expired(stones: DataFrame, now_secs: int, ttl_secs: int) -> DataFrame:
    return stones.where(now_secs - F.col("secs") > ttl_secs)


def newest_tombstone(stones: DataFrame) -> DataFrame:
    return stones.groupBy("name").agg(F.max("secs").alias("secs"))


def free_seconds(stones: DataFrame) -> DataFrame:
    """stones(name, secs, ...) with at: the first free second at or after secs, in the order of secs.

    With i the rank within a name, at = i + the largest (secs - i) so far.
    """
    w = Window.partitionBy("name").orderBy("secs", "id")
    r = stones.withColumn("i", F.row_number().over(w))
    return r.withColumn("at", F.col("i") + F.max(F.col("secs") - F.col("i")).over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("i")


def resolve_prefixes(commits: DataFrame, prefixes: DataFrame) -> DataFrame:
    """(prefix, status, commit): found for one commit that starts with the prefix, else unknown or ambiguous.

    Commits are cut to each length that a prefix has, and joined by equality; what no prefix names is dropped before it is
    counted.
    """
    lengths = [r[0] for r in prefixes.select(F.length("prefix")).distinct().orderBy(F.length("prefix")).collect()]
    heads = commits.select("commit", F.explode(F.array(*[F.substring("commit", 1, n) for n in lengths])).alias("prefix")) if lengths else commits.select("commit", F.lit("").alias("prefix"))
    counted = heads.join(prefixes.select("prefix").distinct(), "prefix", "left_semi").groupBy("prefix").agg(F.countDistinct("commit").alias("n"), F.min("commit").alias("one"))
    n = F.coalesce("n", F.lit(0))
    status = F.when(n == 0, "unknown").when(n == 1, "found").otherwise("ambiguous")
    return prefixes.join(counted, "prefix", "left").select("prefix", status.alias("status"), F.when(n == 1, F.col("one")).alias("commit"))
