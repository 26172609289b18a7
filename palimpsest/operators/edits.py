"""Edits of a tree by path: what a request may do, the entries after it, and the state of a mount."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scalars as S

NAME_MAX, TARGET_MAX = 255, 4095


def _first(*checks: Column) -> Column:
    """The first check that says something, else ok."""
    return F.coalesce(*checks, F.lit("ok"))


def judge(entries: DataFrame, requests: DataFrame) -> DataFrame:
    """requests(request, op, path, to, no_replace) with result: ok, or why the request fails.

    Each request, named by a unique number, is judged on its own against entries(path, kind, ...) as they stand. `to` is the
    target of a symlink, or where rename moves path to. Paths asked for are looked up all at once: one scan of entries,
    reduced to the asked paths before it is aggregated.
    """
    roles = {"at": F.col("path"), "up": S.parent(F.col("path")), "onto": F.col("to"), "over": S.parent(F.col("to"))}
    asked = requests.select("request", F.explode(F.array(*(F.struct(F.lit(r).alias("role"), c.alias("path")) for r, c in roles.items()))).alias("x")).select("request", "x.*")
    asked = asked.where("path is not null")
    own = entries.select("path", "kind", F.lit(0).alias("full"))
    below = entries.where("path <> ''").select(S.parent(F.col("path")).alias("path"), F.lit(None).cast("string").alias("kind"), F.lit(1).alias("full"))
    facts = own.unionByName(below).join(asked.select("path").distinct(), "path", "left_semi").groupBy("path").agg(F.max("kind").alias("kind"), F.max("full").alias("full"))
    found = [F.max(F.when(F.col("role") == r, F.col("kind"))).alias(r) for r in roles]
    full = [F.max(F.when(F.col("role") == r, F.col("full"))).alias(f"{r}_full") for r in ("at", "onto")]
    seen = asked.join(facts, "path", "left").groupBy("request").agg(*found, *full)

    at, onto = F.col("at"), F.col("onto")

    def naming(path: str) -> Column:
        n = S.name(F.col(path))
        return F.when(F.octet_length(n) > NAME_MAX, "too_long").when(~S.valid_entry_name(n), "invalid")

    def place(kind: str) -> Column:
        return F.when(F.col(kind).isNull(), "missing").when(F.col(kind) != "dir", "not_dir")

    target = F.when((F.col("op") == "symlink") & (F.col("to").isNull() | (F.col("to") == "") | (F.octet_length("to") > TARGET_MAX) | F.col("to").contains("\u0000")), "invalid")
    gone = F.when(at.isNull(), "missing")
    add = _first(target, naming("path"), place("up"), F.when(at.isNotNull(), "exists"))
    unlink = _first(gone, F.when(at == "dir", "is_dir"))
    rmdir = _first(gone, F.when(at != "dir", "not_dir"), F.when(F.col("at_full") == 1, "not_empty"))
    truncate = _first(gone, F.when(at == "dir", "is_dir"), F.when(at == "symlink", "invalid"))
    readlink = _first(gone, F.when(at != "symlink", "invalid"))
    moved = _first(
        naming("to"),
        gone,
        place("over"),
        F.when(F.col("to") == F.col("path"), "ok"),
        F.when(F.col("to").startswith(F.concat("path", F.lit("/"))), "invalid"),
        F.when(onto.isNotNull() & F.col("no_replace"), "exists"),
        F.when((at == "dir") & (onto != "dir"), "not_dir"),
        F.when((at != "dir") & (onto == "dir"), "is_dir"),
        F.when((onto == "dir") & (F.col("onto_full") == 1), "not_empty"),
    )
    op = F.col("op")
    result = F.when(op.isin("create", "mkdir", "symlink"), add).when(op == "unlink", unlink).when(op == "rmdir", rmdir).when(op == "truncate", truncate)
    return requests.join(seen, "request").select(*requests.columns, result.when(op == "readlink", readlink).when(op == "rename", moved).alias("result"))


def rename(entries: DataFrame, moves: DataFrame) -> DataFrame:
    """entries after moves(path, to) that may all be made, none above or below another: what is moved takes along all below
    it, and takes the place of what stood there."""
    at = entries.select("path", F.explode(S.ancestors(F.col("path"))).alias("from"))
    hit = at.join(moves.select(F.col("path").alias("from"), "to"), "from")
    hit = hit.select("path", F.concat("to", F.expr("substring(path, length(`from`) + 1)")).alias("to"))
    left = entries.join(hit.select("path").unionByName(moves.select(F.col("to").alias("path"))).distinct(), "path", "left_anti")
    placed = entries.join(hit, "path").withColumn("path", F.col("to")).select(entries.columns)
    return left.select(entries.columns).unionByName(placed)


def touched(paths: DataFrame) -> DataFrame:
    """The paths that count as changed: those of paths(path), and all directories above them."""
    return paths.distinct().select(F.explode(S.ancestors(F.col("path"))).alias("path")).distinct()


def whiteouts(base: DataFrame, now: DataFrame) -> DataFrame:
    """The topmost paths of base that are gone now: what they held goes with them."""
    gone = base.join(now, "path", "left_anti").select("path", S.parent(F.col("path")).alias("up"))
    return gone.join(now.select(F.col("path").alias("up")), "up", "left_semi").select("path")


def status(overlay: DataFrame, hidden: DataFrame, pending: DataFrame) -> DataFrame:
    """One row: dirty_files (changed entries but directories, and whiteouts), unpushed commits, the time of the oldest."""
    none = F.lit(None).cast("long").alias("time_ns")
    dirty = overlay.where("kind <> 'dir'").select(F.lit(1).alias("dirty"), none).unionAll(hidden.select(F.lit(1), none))
    both = dirty.unionAll(pending.select(F.lit(0), F.col("time_ns").cast("long")))
    return both.agg(F.count_if(F.col("dirty") == 1).alias("dirty_files"), F.count_if(F.col("dirty") == 0).alias("unpushed"), F.min("time_ns").alias("oldest_unpushed_ns"))


def behind(mounts: DataFrame, heads: DataFrame) -> DataFrame:
    """mounts(mount, branch, seen) with behind: whether the branch has another head in heads(branch, head) than was seen, or
    none any more. A mount of no branch is never behind."""
    j = mounts.join(heads, "branch", "left")
    return j.select("mount", (F.col("branch").isNotNull() & F.col("seen").isNotNull() & ~F.col("head").eqNullSafe(F.col("seen"))).alias("behind"))
