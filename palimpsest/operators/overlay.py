"""Uncommitted changes over a base: listings, extents, reads and restores."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalars as S


def apply(base: DataFrame, whiteouts: DataFrame, overlay: DataFrame) -> DataFrame:
    """Entries of base without the paths of whiteouts and all below them, overridden by the overlay's."""
    hidden = whiteouts.select(F.col("path").alias("at"))
    gone = base.select("path", F.explode(S.ancestors(F.col("path"))).alias("at")).join(hidden, "at", "left_semi").select("path").distinct()
    left = base.join(gone.unionByName(overlay.select("path")).distinct(), "path", "left_anti")
    return left.unionByName(overlay.select(left.columns))


def listing(base: DataFrame, whiteouts: DataFrame, overlay: DataFrame) -> DataFrame:
    """The visible children of directories, from base(dir, name, ...), whiteouts(dir, name) and overlay(dir, name, ...)."""
    left = base.join(whiteouts.select("dir", "name").unionByName(overlay.select("dir", "name")).distinct(), ["dir", "name"], "left_anti")
    return left.unionByName(overlay.select(left.columns))


def union_extents(extents: DataFrame) -> DataFrame:
    """(file, start, stop): the union of extents(file, start, stop); those that touch are one, empty ones go."""
    w = Window.partitionBy("file").orderBy("start", "stop")
    reach = F.max("stop").over(w.rowsBetween(Window.unboundedPreceding, -1))
    e = extents.where("start < stop").withColumn("new", F.when(reach.isNull() | (F.col("start") > reach), 1).otherwise(0))
    e = e.withColumn("island", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return e.groupBy("file", "island").agg(F.min("start").alias("start"), F.max("stop").alias("stop")).select("file", "start", "stop")


def regions(extents: DataFrame, files: DataFrame) -> DataFrame:
    """Changed ranges of files(file, size, base_size, base_visible): extents clipped to the size, and what the base no longer
    shows."""
    clipped = extents.join(files, "file").select("file", "start", F.least("stop", "size").alias("stop"))
    tail = files.where("base_visible < size or size <> base_size").select("file", F.least("base_visible", "size").alias("start"), F.col("size").alias("stop"))
    return union_extents(clipped.unionByName(tail))


def read(pieces: DataFrame, requests: DataFrame, bucket: int = 1 << 20) -> DataFrame:
    """(file, request, idx, skip, take): the part of each piece that a request covers.

    pieces(file, idx, start, len) and requests(file, request, offset, len) meet by the buckets of `bucket` bytes that
    both touch, an equi-join; a pair is taken in the first bucket that both share.
    """
    p = pieces.withColumn("b", F.explode(F.sequence(F.floor(F.col("start") / bucket), F.floor((F.col("start") + F.greatest(F.col("len"), F.lit(1)) - 1) / bucket))))
    q = requests.where("len > 0").select("file", "request", F.col("offset").alias("from"), (F.col("offset") + F.col("len")).alias("to"))
    q = q.withColumn("b", F.explode(F.sequence(F.floor(F.col("from") / bucket), F.floor((F.col("to") - 1) / bucket))))
    j = p.join(q, ["file", "b"]).where((F.col("start") < F.col("to")) & (F.col("start") + F.col("len") > F.col("from")))
    j = j.where(F.col("b") == F.floor(F.greatest("start", "from") / bucket))
    skip = F.greatest(F.col("from") - F.col("start"), F.lit(0))
    return j.select("file", "request", "idx", skip.alias("skip"), (F.least(F.col("to") - F.col("start"), F.col("len")) - skip).alias("take"))


def sources(extents: DataFrame, files: DataFrame) -> DataFrame:
    """(file, start, stop, source) that tile each file: overlay bytes over base bytes below base_visible over zeros."""
    over = union_extents(extents.join(files.select("file", "size"), "file").select("file", "start", F.least("stop", "size").alias("stop")))
    marks = over.select("file", F.explode(F.array("start", "stop")).alias("at"))
    marks = marks.unionByName(files.select("file", F.explode(F.array(F.lit(0).cast("long"), "size", F.least("base_visible", "size"))).alias("at"))).distinct()
    cuts = marks.withColumn("stop", F.lead("at").over(Window.partitionBy("file").orderBy("at"))).where("stop is not null")
    w = Window.partitionBy("file").orderBy("at", "kind").rowsBetween(Window.unboundedPreceding, 0)
    both = cuts.select("file", "at", "stop", F.lit(1).alias("kind"), F.lit(None).cast("long").alias("end")).unionByName(over.select("file", F.col("start").alias("at"), F.lit(None).cast("long").alias("stop"), F.lit(0).alias("kind"), F.col("stop").alias("end")))
    seen = both.withColumn("reach", F.last("end", ignorenulls=True).over(w)).where("kind = 1").join(files.select("file", "base_visible"), "file")
    source = F.when(F.col("at") < F.coalesce("reach", F.lit(0)), "overlay").when(F.col("at") < F.col("base_visible"), "base").otherwise("zero")
    return seen.select("file", F.col("at").alias("start"), "stop", source.alias("source"))


def restore(entries: DataFrame, source: DataFrame, path: str) -> DataFrame:
    """entries with one path, and all below it, as they are in source."""
    inside = (F.col("path") == path) | F.col("path").startswith(path + "/")
    return entries.where(~inside).unionByName(source.where(inside).select(entries.columns))
