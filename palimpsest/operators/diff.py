"""What changed between two versions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..session import cut
from .tree import is_dir, same, sides


def diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """(path, change): added, removed or modified.

    A row is reported if its parent is a directory in both versions, so an added or removed directory is one row; if
    the two sides are not both directories; and if content or mode differ, so a new time alone is none.
    """
    j = sides(a=old, b=new)
    open_dirs = j.where(is_dir("a") & is_dir("b")).select(F.col("path").alias("up"))
    changed = j.where((F.col("path") != "") & ~(is_dir("a") & is_dir("b")) & ~same("a", "b"))
    changed = changed.withColumn("up", S.parent(F.col("path"))).join(open_dirs, "up", "left_semi")
    change = F.when(F.col("a").isNull(), "added").when(F.col("b").isNull(), "removed").otherwise("modified")
    return changed.select("path", change.alias("change"))


def pruned(old: DataFrame, new: DataFrame) -> DataFrame:
    """As diff, by descending only where tree ids differ: what is compared follows the change, not the tree."""
    cols = ("kind", "mode", "mtime_ns", "size", "content_id", "file_id")
    o = old.withColumn("up", S.parent(F.col("path"))).where("path <> ''")
    n = new.withColumn("up", S.parent(F.col("path"))).where("path <> ''")
    roots = old.where("path = ''").select("content_id").exceptAll(new.where("path = ''").select("content_id"))
    if roots.isEmpty():
        return diff(old.limit(0), new.limit(0))
    level = old.sparkSession.range(1).select(F.lit("").alias("up"))
    out = None
    while True:
        a = o.join(level, "up", "left_semi").select("path", F.struct(*cols).alias("a"))
        b = n.join(level, "up", "left_semi").select("path", F.struct(*cols).alias("b"))
        j = cut(a.join(b, "path", "full_outer"), "level")
        change = F.when(F.col("a").isNull(), "added").when(F.col("b").isNull(), "removed").otherwise("modified")
        found = j.where(~(is_dir("a") & is_dir("b")) & ~same("a", "b")).select("path", change.alias("change"))
        out = found if out is None else out.unionByName(found)
        level = j.where(is_dir("a") & is_dir("b") & (F.col("a.content_id") != F.col("b.content_id"))).select(F.col("path").alias("up"))
        if level.isEmpty():
            return out


def stat(changes: DataFrame) -> DataFrame:
    return changes.groupBy("change").agg(F.count("*").alias("n"))


def changed_entries(old: DataFrame, new: DataFrame) -> DataFrame:
    """Paths whose full entries differ (times and ids too), without those that are directories on both sides."""
    j = sides(a=old, b=new)
    return j.where(~F.col("a").eqNullSafe(F.col("b")) & ~(is_dir("a") & is_dir("b")) & (F.col("path") != "")).select("path")


def update_conflicts(base: DataFrame, here: DataFrame, there: DataFrame) -> DataFrame:
    """Paths that a branch changed and that are changed or deleted here too: an update with any of them does nothing.

    A change clashes with a local one at the same path, and with a deletion here of the path or of a directory above.
    """
    theirs = changed_entries(base, there)
    local = changed_entries(base, here)
    gone = base.join(here, "path", "left_anti").select("path")
    at = theirs.withColumn("at", F.explode(S.ancestors(F.col("path"))))
    hit = at.join(local.select(F.col("path").alias("at"), F.lit(False).alias("deep")).unionByName(gone.select(F.col("path").alias("at"), F.lit(True).alias("deep"))), "at")
    return hit.where("deep or at = path").select("path").distinct()


def message(conflicts: DataFrame, most: int = 5) -> DataFrame:
    """One row, shown: the first paths of conflicts(path), and three dots if there are more than `most`."""
    few = conflicts.select("path").orderBy("path").limit(most + 1).agg(F.sort_array(F.collect_list("path")).alias("p"))
    return few.select(F.concat(F.array_join(F.slice("p", 1, most), ", "), F.when(F.size("p") > most, ", ...").otherwise("")).alias("shown"))
