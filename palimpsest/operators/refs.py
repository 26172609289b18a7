"""Branches, snapshots and tombstones: the store on the driver, and its commands as a table."""

from __future__ import annotations

import re
from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_BRANCH = re.compile(r"^(?![.-])(?!.*\.\.)(?![0-9A-Fa-f]{8,}\Z)[A-Za-z0-9._-]{1,100}\Z")


class RefError(ValueError):
    """A name that is taken, unknown or not allowed, or a lost race."""


@dataclass(frozen=True)
class Ref:
    id: str
    head: str
    log: tuple[str, ...] = ()
    merge_bases: dict[str, str] = field(default_factory=dict)
    forked_from: tuple[str, str, int] | None = None
    version: int = 0


class Refs:
    """Mutable names over immutable commits. Each change names the version it was made from, and fails if that is old."""

    def __init__(self) -> None:
        self.branches: dict[str, Ref] = {}
        self.snapshots: dict[str, str] = {}
        self.tombstones: list[tuple[str, bool, int, Ref | str]] = []

    def _free(self, name: str) -> None:
        if not _BRANCH.match(name):
            raise RefError(f"invalid name: {name}")
        if name in self.branches:
            raise RefError(f"{name} exists")

    def branch(self, name: str) -> Ref:
        if name not in self.branches:
            raise RefError(f"unknown branch: {name}")
        return self.branches[name]

    def swap(self, name: str, seen: Ref, new: Ref) -> Ref:
        if self.branches.get(name) is not seen:
            raise RefError(f"{name} has changed")
        self.branches[name] = replace(new, version=seen.version + 1)
        return self.branches[name]

    def create(self, name: str, commit: str) -> Ref:
        self._free(name)
        self.branches[name] = Ref(id=name, head=commit, log=(commit,))
        return self.branches[name]

    def commit(self, name: str, commit: str) -> Ref:
        seen = self.branch(name)
        return self.swap(name, seen, replace(seen, head=commit, log=(*seen.log, commit)))

    def fork(self, source: str, name: str, now: int) -> Ref:
        """From a branch with its log and merge bases, else from a snapshot or a commit with a log of one entry."""
        self._free(name)
        if source in self.branches:
            src = self.branches[source]
            new = Ref(f"{name}@{now}", src.head, src.log, dict(src.merge_bases), (src.id, src.head, now))
        else:
            commit = self.resolve(source)
            new = Ref(f"{name}@{now}", commit, (commit,), {}, None)
        self.branches[name] = new
        return new

    def snapshot(self, name: str, source: str) -> str:
        if not _BRANCH.match(name) or name in self.snapshots:
            raise RefError(f"snapshot {name} exists or is invalid")
        self.snapshots[name] = self.resolve(source)
        return self.snapshots[name]

    def resolve(self, spec: str) -> str:
        """The commit of a branch, of snap/<name>, or of a unique prefix of eight or more hex digits."""
        if spec.startswith("snap/"):
            if spec[5:] not in self.snapshots:
                raise RefError(f"unknown snapshot: {spec[5:]}")
            return self.snapshots[spec[5:]]
        if spec in self.branches:
            return self.branches[spec].head
        if re.fullmatch("[0-9a-f]{8,64}", spec):
            found = {c for r in self.branches.values() for c in r.log if c.startswith(spec)} | {c for c in self.snapshots.values() if c.startswith(spec)}
            if len(found) == 1:
                return found.pop()
            raise RefError(f"{'ambiguous' if found else 'unknown'} commit: {spec}")
        raise RefError(f"unknown ref: {spec}")

    def _bury(self, name: str, is_snapshot: bool, now: int, was: Ref | str) -> int:
        """At the first free second from now on."""
        while any(n == name and s == is_snapshot and t == now for n, s, t, _ in self.tombstones):
            now += 1
        self.tombstones.append((name, is_snapshot, now, was))
        return now

    def delete_branch(self, name: str, now: int) -> int:
        at = self._bury(name, False, now, self.branch(name))
        del self.branches[name]
        return at

    def delete_snapshot(self, name: str, now: int) -> int:
        if name not in self.snapshots:
            raise RefError(f"unknown snapshot: {name}")
        return self._bury(name, True, now, self.snapshots.pop(name))

    def undelete(self, name: str, now: int, ttl: int, is_snapshot: bool = False) -> None:
        found = [t for t in self.tombstones if t[0] == name and t[1] == is_snapshot]
        if not found or now - max(t[2] for t in found) > ttl:
            raise RefError(f"nothing to restore: {name}")
        if name in (self.snapshots if is_snapshot else self.branches):
            raise RefError(f"{name} exists")
        newest = max(found, key=lambda t: t[2])
        self.tombstones.remove(newest)
        (self.snapshots if is_snapshot else self.branches)[name] = newest[3]  # type: ignore[assignment]

    def rename(self, old: str, new: str) -> Ref:
        """The id stays, so merge bases and fork points still hold."""
        ref = self.branch(old)
        self._free(new)
        self.branches[new] = ref
        del self.branches[old]
        return ref

    def reset(self, name: str, to: str) -> Ref:
        """Appends the target commit to the log; the old head stays in it."""
        return self.commit(name, self.resolve(to))

    def merge_candidates(self, dst: str, src: str) -> list[tuple[int, str]]:
        """(prio, commit) of the possible merge bases, in order."""
        d, s = self.branch(dst), self.branch(src)
        out = [(1, d.merge_bases.get(s.id)), (2, s.merge_bases.get(d.id))]
        if s.forked_from and s.forked_from[0] == d.id:
            out.append((3, s.forked_from[1]))
        if d.forked_from and d.forked_from[0] == s.id:
            out.append((4, d.forked_from[1]))
        if d.forked_from and s.forked_from and d.forked_from[0] == s.forked_from[0]:
            out.append((5, min(d.forked_from, s.forked_from, key=lambda f: f[2])[1]))
        return [(p, c) for p, c in out if c]

    def merged(self, dst: str, src: str, commit: str) -> Ref:
        d, s = self.branch(dst), self.branch(src)
        return self.swap(dst, d, replace(d, head=commit, log=(*d.log, commit), merge_bases={**d.merge_bases, s.id: s.head}))

    def publish(self, name: str, seen: Ref, commit: str, host: str, now: int, tries: int = 100) -> str:
        """Commits on top of `seen`; if the branch has moved on, forks to <name>.<host>, then with -2, -3, ..."""
        if self.branches.get(name) is seen:
            self.commit(name, commit)
            return name
        clean = re.sub("[^a-z0-9-]", "-", host.lower())
        for n in range(1, tries + 1):
            other = f"{name}.{clean}" + (f"-{n}" if n > 1 else "")
            if other not in self.branches:
                self.branches[other] = Ref(other, commit, (*seen.log, commit), dict(seen.merge_bases), (seen.id, seen.head, now))
                return other
        raise RefError(f"no free name for {name}")


def replay(commands: DataFrame) -> DataFrame:
    """(name, head, entries, deleted) after commands(seq, name, op, commit): the state that a command log leaves.

    create and commit set the head, reset sets it again, snapshot does not move it, delete ends the name until the next
    create. Only what follows a name's last deletion counts; all of it is two aggregates, in no order.
    """
    last = commands.groupBy("name").agg(F.max(F.when(F.col("op") == "delete", F.col("seq"))).alias("gone"), F.max("seq").alias("last"))
    live = commands.join(last, "name").where(F.coalesce(F.col("seq") > F.col("gone"), F.lit(True)))
    moves = live.where(F.col("op").isin("create", "commit", "reset"))
    state = moves.groupBy("name").agg(F.max_by("commit", "seq").alias("head"), F.count("*").alias("entries"))
    ended = last.where("gone is not null").select("name", F.lit(True).alias("deleted"))
    out = last.select("name").join(state, "name", "left").join(ended, "name", "left")
    return out.select("name", "head", F.coalesce("entries", F.lit(0)).cast("long").alias("entries"), (F.col("head").isNull() & F.coalesce("deleted", F.lit(False))).alias("deleted"))
