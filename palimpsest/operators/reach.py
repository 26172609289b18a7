"""Reachability over the object graph: edges, closure, roots, garbage, integrity."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..session import shared_dir


def edges(commits: DataFrame, entries: DataFrame) -> DataFrame:
    """(src, dst, kind) from commits(version, commit, root) and entries(version, path, kind, content_id): commit to
    tree, tree to each child."""
    e = entries.where("path <> ''").select("version", "path", F.col("content_id").alias("dst"), F.col("kind"))
    dirs = entries.where("kind = 'dir'").select("version", F.col("path").alias("up"), F.col("content_id").alias("src"))
    down = e.withColumn("up", S.parent(F.col("path"))).join(dirs, ["version", "up"]).select("src", "dst", F.when(F.col("kind") == "dir", "tree").otherwise("content").alias("kind"))
    return commits.select(F.col("commit").alias("src"), F.col("root").alias("dst"), F.lit("root").alias("kind")).unionByName(down).distinct()


def mark(roots: DataFrame, graph: DataFrame) -> DataFrame:
    """ids reachable from roots(id), level by level, until a level has nothing new; each id is visited once, so a graph with
    cycles ends too, and leaves are listed but not expanded.

    A level is written to the checkpoint folder, so plans stay short and a lost executor costs no earlier level.
    """
    spark = roots.sparkSession
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(shared_dir(spark))
    links = graph.select("src", "dst")
    live = frontier = roots.select("id").distinct().checkpoint()
    while True:
        frontier = frontier.join(links, frontier["id"] == links["src"]).select(F.col("dst").alias("id")).distinct().join(live, "id", "left_anti").checkpoint()
        if frontier.isEmpty():
            return live
        live = live.unionByName(frontier)


def gc_roots(log: DataFrame, refs: DataFrame, snapshots: DataFrame, stones: DataFrame, mounts: DataFrame, now_secs: int, ttl_secs: int, mount_ttl_secs: int) -> DataFrame:
    """(id, why): kept log entries, heads and merge bases, snapshots, live tombstones, mounts seen lately."""
    live = stones.where(now_secs - F.col("secs") <= ttl_secs)
    parts = [
        log.select(F.col("commit").alias("id"), F.lit("log").alias("why")),
        refs.select(F.col("head").alias("id"), F.lit("head").alias("why")),
        refs.select(F.explode(F.map_values("merge_bases")).alias("id"), F.lit("merge_base").alias("why")),
        snapshots.select(F.col("commit").alias("id"), F.lit("snapshot").alias("why")),
        live.select(F.col("head").alias("id"), F.lit("tombstone").alias("why")),
        mounts.where(now_secs - F.col("last_seen") < mount_ttl_secs).select(F.col("base_commit").alias("id"), F.lit("mount").alias("why")),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.where("id is not null").distinct()


def dead_now(stored: DataFrame, live: DataFrame) -> DataFrame:
    return stored.join(live.select("id"), "id", "left_anti")


def orphan_packs(packs: DataFrame, index: DataFrame) -> DataFrame:
    return packs.join(index.select("pack").distinct(), "pack", "left_anti")


def confirmed(old_dead: DataFrame, live: DataFrame) -> DataFrame:
    """Dead by an older list and still unreachable."""
    return old_dead.select("id").distinct().join(live.select("id"), "id", "left_anti")


def old_lists(lists: DataFrame, now_secs: int, grace_secs: int) -> DataFrame:
    """The dead lists(run_secs, ...) that a sweep may act on."""
    return lists.where(F.col("run_secs") <= now_secs - grace_secs)


def pack_sweep(index: DataFrame) -> DataFrame:
    """(pack, is_data, total, kept, action) from index(pack, is_data, len, live): delete without live bytes, repack if
    less than half are live, else keep."""
    g = index.groupBy("pack", "is_data").agg(F.sum("len").alias("total"), F.coalesce(F.sum(F.when(F.col("live"), F.col("len"))), F.lit(0)).alias("kept"))
    action = F.when(F.col("kept") == 0, "delete").when(F.col("kept") * 2 < F.col("total"), "repack").otherwise("keep")
    return g.withColumn("action", action)


def revive(new_refs: DataFrame, added: DataFrame, dead: DataFrame) -> DataFrame:
    """ids that new objects refer to, that are not new themselves and that a dead list names: to be written again."""
    return new_refs.select("id").distinct().join(added.select("id"), "id", "left_anti").join(dead.select("id"), "id", "left_semi")


def new_objects(objects: DataFrame, index: DataFrame, dead: DataFrame) -> DataFrame:
    """One row for each of objects(id, ...) that is not stored yet; stored but dead counts as not stored."""
    usable = index.select("id").join(dead.select("id"), "id", "left_anti")
    return objects.dropDuplicates(["id"]).join(usable, "id", "left_anti")


def fsck(reachable: DataFrame, stored: DataFrame) -> DataFrame:
    """(id, problem): missing for reachable ids that are not stored, mismatch where the payload hashes to another id.
    stored(id, actual) has the id computed anew."""
    found = reachable.select("id").distinct().join(stored, "id", "left")
    problem = F.when(F.col("actual").isNull(), "missing").when(F.col("actual") != F.col("id"), "mismatch")
    return found.withColumn("problem", problem).where("problem is not null").select("id", "problem")


def invalid_entries(entries: DataFrame, inline_max: int = S.INLINE_MAX) -> DataFrame:
    """(path, rule) for each rule of the format that an entry(path, kind, mode, size, target, file_id) breaks."""
    name = S.name(F.col("path"))
    rules = {
        "name": ~S.valid_entry_name(name),
        "mode": (F.col("mode") < 0) | (F.col("mode") > 0o7777),
        "size": F.col("size") < 0,
        "dir_size": (F.col("kind") == "dir") & (F.col("size") != 0),
        "kind": ~F.col("kind").isin("file", "dir", "symlink"),
        "symlink_mode": (F.col("kind") == "symlink") & (F.col("mode") != 0o777),
        "symlink_target": (F.col("kind") == "symlink") & (F.octet_length(F.coalesce("target", F.lit(""))) != F.col("size")),
        "file_id": (F.col("file_id") < (1 << 32)) | F.col("file_id").isNull(),
    }
    broken = F.filter(F.array(*[F.when(F.coalesce(c, F.lit(True)), F.lit(k)) for k, c in rules.items()]), lambda x: x.isNotNull())
    return entries.select("path", F.explode(broken).alias("rule"))


def gc_due(runs: DataFrame, now: int, every: int = 86_400) -> DataFrame:
    """runs(repository, finished) with due: whether the last run ended more than `every` seconds ago, or there was none."""
    last = runs.groupBy("repository").agg(F.max("finished").alias("last"))
    return last.select("repository", F.coalesce(now - F.col("last") > every, F.lit(True)).alias("due"))
