"""Directory trees as tables: entries from files, Merkle tree ids, listing and lookup."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..session import cut

BUCKET = 3
COLUMNS = ("path", "kind", "mode", "mtime_ns", "size", "content_id", "file_id")


def encoded() -> Column:
    """An entry as its directory hashes it."""
    return F.concat_ws("|", S.name(F.col("path")), "kind", F.col("mode").cast("string"), F.col("mtime_ns").cast("string"), "content_id")


def file_entries(files: DataFrame) -> DataFrame:
    """Entries of files(path, content, mode, mtime_ns)."""
    return files.select(
        "path", F.lit("file").alias("kind"), F.col("mode").cast("int").alias("mode"), F.col("mtime_ns").cast("long").alias("mtime_ns"),
        F.octet_length("content").cast("long").alias("size"), S.object_id("chunk", F.col("content")).alias("content_id"), S.file_id(F.col("path")).alias("file_id"),
    )


def tree_ids(children: DataFrame) -> DataFrame:
    """(path, content_id) of the directories of children: a hash of their sorted entries.

    Entries are dealt by the first BUCKET hex digits of their names' MD5; buckets are hashed, then their hashes in order.
    A directory of any size is so hashed by many tasks, and at most 16**BUCKET hashes meet in one.
    """
    bucket = F.substring(F.md5(S.name(F.col("path")).cast("binary")), 1, BUCKET)
    part = F.sha2(F.array_join(F.array_sort(F.collect_list(encoded())), "\n"), 256)
    parts = children.groupBy(S.parent(F.col("path")).alias("up"), bucket.alias("bucket")).agg(part.alias("part"))
    whole = F.array_join(F.array_sort(F.collect_list(F.concat("bucket", F.lit(" "), "part"))), "\n")
    return parts.groupBy(F.col("up").alias("path")).agg(S.object_id("tree", whole).alias("content_id"))


def build(entries: DataFrame, dir_mode: int = 0o755) -> DataFrame:
    """entries and the directories above them, whose content_id is the tree id.

    One step for each level, from the deepest up; a level's rows are only what is below its directories. Entries are
    computed (and files hashed) once, and each level is written once.
    """
    rows = cut(entries.select(*COLUMNS, S.depth(F.col("path")).alias("level")), "entries")
    levels = rows.agg(F.max("level")).first()[0] or 0
    built = [rows.drop("level")]
    above = None
    for level in range(levels, 0, -1):
        at = rows.where(F.col("level") == level).drop("level")
        at = at if above is None else at.unionByName(above)
        above = tree_ids(at).select(
            "path", F.lit("dir").alias("kind"), F.lit(dir_mode).alias("mode"), F.lit(0).cast("long").alias("mtime_ns"), F.lit(0).cast("long").alias("size"), "content_id", S.file_id(F.col("path")).alias("file_id"),
        )
        above = cut(above, "level") if level > 1 else above
        built.append(above)
    return reduce(DataFrame.unionByName, built)


def keep_ids(entries: DataFrame, before: DataFrame) -> DataFrame:
    """entries with the file_id that the same path had before, if it was of the same kind."""
    old = before.select("path", "kind", F.col("file_id").alias("old_id"))
    return entries.join(old, ["path", "kind"], "left").withColumn("file_id", F.coalesce("old_id", "file_id")).select(*entries.columns)


def entry_at(entries: DataFrame, path: str) -> DataFrame:
    """The entry at a path; empty segments are ignored, and the empty path is the root."""
    return entries.where(F.col("path") == "/".join(p for p in path.split("/") if p))


def ls(entries: DataFrame, path: str = "") -> DataFrame:
    """The children of a directory, or the entry itself if it is none, by name."""
    at = "/".join(p for p in path.split("/") if p)
    inside = (S.parent(F.col("path")) == at) & (F.col("path") != "")
    itself = (F.col("path") == at) & (F.col("kind") != "dir")
    return entries.where(inside | itself).withColumn("name", S.name(F.col("path"))).orderBy("name")


def flatten(trees: DataFrame, root: str) -> DataFrame:
    """(path, kind, ref_id) of all entries below the tree `root`, level by level, from trees(tree_id, name, kind, ref_id).

    Levels go on until one has no directory. A tree that contains itself has no end: there can't be more levels than
    trees, so one more is an error.
    """
    most = trees.select("tree_id").distinct().count()
    level = trees.where(F.col("tree_id") == root).select(F.col("name").alias("path"), "kind", "ref_id")
    out = [level]
    for _ in range(most + 1):
        dirs = level.where("kind = 'dir'").select(F.col("path").alias("above"), F.col("ref_id").alias("tree_id"))
        level = cut(dirs.join(trees, "tree_id").select(F.concat_ws("/", "above", "name").alias("path"), "kind", "ref_id"), "level")
        if level.isEmpty():
            return reduce(DataFrame.unionByName, out)
        out.append(level)
    raise ValueError(f"tree {root} contains itself")


def same(a: str, b: str) -> Column:
    """Equal content, kind and mode; two absent entries are the same. a and b are structs."""
    x, y = F.col(a), F.col(b)
    both = (x["kind"] == y["kind"]) & (x["content_id"] == y["content_id"]) & (x["mode"] == y["mode"])
    return F.when(x.isNull() & y.isNull(), True).when(x.isNull() | y.isNull(), False).otherwise(both)


def is_dir(a: str) -> Column:
    return F.coalesce(F.col(a)["kind"] == "dir", F.lit(False))


def sides(**versions: DataFrame) -> DataFrame:
    """One row for each path, with a struct of each version's entry, or null: one shuffle for any number of versions."""
    fields = ("kind", "mode", "mtime_ns", "size", "content_id", "file_id")
    tagged = [df.select("path", F.lit(k).alias("side"), F.struct(*fields).alias("e")) for k, df in versions.items()]
    return reduce(DataFrame.unionByName, tagged).groupBy("path").agg(*[F.max(F.when(F.col("side") == k, F.col("e"))).alias(k) for k in versions])
