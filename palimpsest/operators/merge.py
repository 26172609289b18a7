"""Three-way merge of trees, without recursion, and the choice of a merge base."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalars as S
from .diff import diff
from .tree import is_dir, same, sides

COLUMNS = ("path", "kind", "mode", "mtime_ns", "size", "content_id", "file_id")


def decisions(base: DataFrame, ours: DataFrame, theirs: DataFrame) -> DataFrame:
    """(path, decision, o, t): what is decided at each path if nothing above it is."""
    j = sides(b=base, o=ours, t=theirs)
    root = F.col("path") == ""
    both = is_dir("o") & is_dir("t")

    def tree(x: str, y: str):  # noqa: ANN202
        return F.coalesce(F.col(x)["content_id"] == F.col(y)["content_id"], F.lit(False))

    decision = (
        F.when(~root & (same("o", "t") | same("t", "b")), "ours")
        .when(~root & same("o", "b"), "take")
        .when(both & (tree("o", "t") | is_dir("b") & tree("b", "t")), "keep_dir_ours")
        .when(both & is_dir("b") & tree("b", "o"), "dir_theirs")
        .when(both, "recurse")
        .when(F.col("o").isNull(), "theirs_back")
        .when(F.col("t").isNull(), "ours")
        .otherwise("conflict")
    )
    return j.select("path", decision.alias("decision"), "o", "t")


def decided(base: DataFrame, ours: DataFrame, theirs: DataFrame) -> DataFrame:
    """decisions with (at, how): the shallowest path at or above that decides, and its decision; null if none does."""
    d = decisions(base, ours, theirs)
    up = d.select("path", F.explode(S.ancestors(F.col("path"))).alias("at"))
    firm = d.where("decision <> 'recurse'").select(F.col("path").alias("at"), F.col("decision").alias("how"))
    first = up.join(firm, "at").groupBy("path").agg(F.min_by(F.struct("at", "how"), S.depth(F.col("at"))).alias("x"))
    return d.join(first, "path", "left").select("path", "o", "t", F.col("x.at").alias("at"), F.col("x.how").alias("how"))


def merge(base: DataFrame, ours: DataFrame, theirs: DataFrame, resolve: str = "refuse", source: str = "theirs") -> DataFrame:
    """Entries of the merged tree, without the root. resolve: refuse and ours keep ours at a conflict, theirs takes
    theirs, both keeps ours and adds theirs under another name. Directory ids are those of the sides; tree.build gives
    new ones."""
    d = decided(base, ours, theirs).where("path <> ''")
    keep_o = F.col("how").isNull() | F.col("how").isin("ours", "keep_dir_ours") | (F.col("how") == "dir_theirs") & (F.col("at") == F.col("path"))
    keep_t = F.col("how").isin("take", "theirs_back") | (F.col("how") == "dir_theirs") & (F.col("at") != F.col("path"))
    clash = F.col("how") == "conflict"
    keep_o, keep_t = (keep_o, keep_t | clash) if resolve == "theirs" else (keep_o | clash, keep_t)
    mine = d.where(F.col("o").isNotNull() & F.coalesce(keep_o, F.lit(True))).select("path", "o.*")
    other = d.where(F.col("t").isNotNull() & F.coalesce(keep_t, F.lit(False))).select("path", "t.*")
    out = mine.unionByName(other).select(*COLUMNS)
    if resolve != "both":
        return out
    extra = d.where(clash & F.col("t").isNotNull()).select("path", "at", "t.*")
    named = extra.select("at").distinct().join(names_for_both(extra.select("at").distinct(), out, source), "at")
    moved = extra.join(named, "at").withColumn("path", F.concat("new", F.expr("substring(path, length(at) + 1)")))
    return out.unionByName(moved.withColumn("file_id", S.file_id(F.col("path"))).select(*COLUMNS))


def names_for_both(paths: DataFrame, merged: DataFrame, source: str) -> DataFrame:
    """(at, new): the first free path beside each of paths(at) for the other side's copy: of n + 1 names, n that are taken
    leave one, so as many are tried as the folder has names that begin like the copy's."""
    folder, file = S.parent(F.col("at")), S.name(F.col("at"))
    full = lambda n: F.concat(F.when(folder == "", "").otherwise(F.concat(folder, F.lit("/"))), S.both_name(file, F.lit(source), n))
    stem = F.concat(F.when(F.col("at").contains("/"), F.concat(folder, F.lit("/"))).otherwise(""), F.regexp_extract(file, r"(?s)^(.[^.]*)", 1))
    like = merged.select(F.col("path").alias("there"), S.parent(F.col("path")).alias("folder"))
    tries = paths.withColumn("folder", folder).withColumn("stem", stem)
    taken = tries.join(like, "folder").where(F.col("there").startswith(F.col("stem"))).groupBy("at").agg(F.count("*").alias("names"))
    tries = tries.join(taken, "at", "left").withColumn("n", F.explode(F.sequence(F.lit(1), F.coalesce("names", F.lit(0)).cast("int") + 1))).withColumn("new", full(F.col("n")))
    free = tries.join(merged.select(F.col("path").alias("new")), "new", "left_anti")
    return free.groupBy("at").agg(F.min_by("new", "n").alias("new"))


def outcome(base: DataFrame, ours: DataFrame, theirs: DataFrame) -> DataFrame:
    """(path, outcome): conflict, or taken from theirs."""
    d = decided(base, ours, theirs).where("path <> ''")
    own = d.where(F.col("at") == F.col("path"))
    conflicts = own.where("how = 'conflict'").select("path", F.lit("conflict").alias("outcome"))
    taken = own.where(F.col("how").isin("take", "theirs_back")).select("path")
    under = d.where((F.col("how") == "dir_theirs") & (F.col("at") != F.col("path"))).select("path")
    deep = diff(ours, theirs).select("path").join(under, "path", "left_semi")
    return conflicts.unionByName(taken.unionByName(deep).select("path", F.lit("taken").alias("outcome")))


def merge_base(candidates: DataFrame) -> DataFrame:
    """(dst, src, commit, time): the latest of candidates(dst, src, prio, commit, time); the first in order wins a tie.

    Candidates in order: the merge base that dst keeps for src, that src keeps for dst, the fork of src from dst, of dst
    from src, and for siblings the earlier fork point.
    """
    w = Window.partitionBy("dst", "src").orderBy(F.col("time").desc(), "prio", "commit")
    return candidates.withColumn("n", F.row_number().over(w)).where("n = 1").select("dst", "src", "commit", "time")
