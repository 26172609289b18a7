"""A repository in a shared folder: every data command as a method over DataFrames.

Trees, chunk lists and chunks are Parquet tables; names are one small JSON state. A state has a number, and the next is
written by creating its file, which fails if another writer was first: a compare-and-swap on file systems whose create
is exclusive (HDFS, local and mounted ones; not on plain object stores). Chunks and chunk lists are in packs, folders of
Parquet files that a state names: what is written shows only with the state that names it, and a sweep deletes files only
a grace after a state has ceased to name them.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from dataclasses import asdict, dataclass, field

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import chunking, diff, history, merge, overlay, reach, tree
from ..operators.refs import Ref, RefError, Refs

FORMAT_VERSION = 2
TREE = "path string, kind string, mode int, mtime_ns long, size long, content_id string, file_id long"
LIST = "content_id string, idx int, offset long, len long, chunk_id string"
CHUNK = "chunk_id string, data binary"


@dataclass
class State:
    """All that is mutable: names, logs, and the rows of commits."""

    number: int = 0
    refs: Refs = field(default_factory=Refs)
    commits: dict[str, dict] = field(default_factory=dict)
    dead: dict[str, int] = field(default_factory=dict)
    mounts: dict[str, list] = field(default_factory=dict)
    packs: dict[str, list[str]] = field(default_factory=lambda: {"chunks": [], "lists": []})
    trash: dict[str, int] = field(default_factory=dict)

    def dump(self) -> str:
        r = self.refs
        return json.dumps({"branches": {k: asdict(v) for k, v in r.branches.items()}, "snapshots": r.snapshots, "tombstones": [[n, s, t, asdict(x) if isinstance(x, Ref) else x] for n, s, t, x in r.tombstones], "commits": self.commits, "dead": self.dead, "mounts": self.mounts, "packs": self.packs, "trash": self.trash})

    @classmethod
    def load(cls, number: int, text: str) -> State:
        def ref(x: dict) -> Ref:
            return Ref(**x | {"log": tuple(x["log"]), "forked_from": tuple(x["forked_from"]) if x["forked_from"] else None})

        x, out = json.loads(text), cls(number)
        out.refs.branches = {k: ref(v) for k, v in x["branches"].items()}
        out.refs.snapshots = x["snapshots"]
        out.refs.tombstones = [(n, s, t, ref(v) if isinstance(v, dict) else v) for n, s, t, v in x["tombstones"]]
        out.commits, out.dead, out.mounts = x["commits"], x["dead"], x["mounts"]
        out.packs, out.trash = x["packs"], x["trash"]
        return out


class Repository:
    """Commands on the repository in `root`. Times are seconds and always given."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self.config = json.loads(self._read("config.json"))
        if self.config["format_version"] > FORMAT_VERSION:
            raise ValueError("this repository is of a newer format")

    # ------------------------------------------------------------ storage

    @classmethod
    def init(cls, spark: SparkSession, root: str, chunker: tuple[int, int, int] = chunking.SIZES, inline_max: int = S.INLINE_MAX) -> Repository:
        new = cls.__new__(cls)
        new.spark, new.root = spark, root.rstrip("/")
        config = {"format_version": FORMAT_VERSION, "repo_id": hashlib.sha256(root.encode()).hexdigest()[:32], "chunker": list(chunker), "inline_max": inline_max}
        if not new._create("config.json", json.dumps(config)):
            raise RefError(f"{root} has a repository")
        new._create("state/0000000000.json", State().dump())
        return cls(spark, root)

    def _path(self, name: str):  # noqa: ANN202
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
        return path, path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def _read(self, name: str) -> str:
        path, fs = self._path(name)
        jvm = self.spark.sparkContext._jvm
        stream = fs.open(path)
        try:
            return jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def _create(self, name: str, text: str) -> bool:
        """False if the file is there already."""
        path, fs = self._path(name)
        try:
            out = fs.create(path, False)
        except Py4JJavaError as e:
            if "FileAlreadyExists" in str(e.java_exception):
                return False
            raise
        out.write(bytearray(text.encode()))
        out.close()
        return True

    def _has(self, name: str) -> bool:
        path, fs = self._path(name)
        return fs.exists(path)

    def state(self) -> State:
        path, fs = self._path("state")
        last = max(s.getPath().getName() for s in fs.listStatus(path) if s.getPath().getName().endswith(".json"))
        return State.load(int(last.split(".")[0]), self._read(f"state/{last}"))

    def _swap(self, state: State) -> None:
        if not self._create(f"state/{state.number + 1:010d}.json", state.dump()):
            raise RefError("another writer was first")
        state.number += 1

    @classmethod
    def probe(cls, spark: SparkSession, root: str) -> dict | None:
        """The configuration of the repository in root, of any format; None if there is none."""
        at = cls.__new__(cls)
        at.spark, at.root = spark, root.rstrip("/")
        return json.loads(at._read("config.json")) if at._has("config.json") else None

    def _table(self, name: str, schema: str, state: State | None = None) -> DataFrame:
        """All rows of the packs of `name` that a state names, with the pack of each."""
        packs = (state or self.state()).packs[name]
        if not packs:
            return self.spark.createDataFrame([], schema + ", pack string")
        df = self.spark.read.schema(schema).parquet(*[f"{self.root}/{p}" for p in packs])
        return df.select("*", F.regexp_extract("_metadata.file_path", f"/({name}/[0-9a-f]{{32}})/", 1).alias("pack"))

    def _pack(self, name: str, rows: DataFrame, state: State) -> None:
        """Writes rows as a new pack of the state to come."""
        pack = f"{name}/{uuid.uuid4().hex}"
        rows.write.parquet(f"{self.root}/{pack}")
        state.packs[name].append(pack)

    def _delete(self, name: str) -> None:
        path, fs = self._path(name)
        fs.delete(path, True)

    def tree(self, tree_id: str) -> DataFrame:
        return self.trees([tree_id])

    def trees(self, tree_ids: list[str]) -> DataFrame:
        """Entries of several trees, as one scan."""
        if not tree_ids:
            return self.spark.createDataFrame([], TREE)
        return self.spark.read.schema(TREE).parquet(*[f"{self.root}/trees/{t}" for t in tree_ids])

    def _store_tree(self, entries: DataFrame) -> str:
        """Writes entries (with their root) under the root's id, unless they are there."""
        name = f"new/{uuid.uuid4().hex}"
        entries.select(*[c.split()[0] for c in TREE.split(", ")]).write.mode("overwrite").parquet(f"{self.root}/{name}")
        row = self.spark.read.schema(TREE).parquet(f"{self.root}/{name}").where("path = ''").select("content_id").first()
        tree_id = row[0] if row else hashlib.sha256(b"empty").hexdigest()
        path, fs = self._path(f"trees/{tree_id}")
        fs.mkdirs(path.getParent())
        source, _ = self._path(name)
        if fs.exists(path):
            fs.delete(source, True)
        else:
            fs.rename(source, path)
        return tree_id

    def _store_files(self, files: DataFrame, state: State) -> DataFrame:
        """Chunks files(path, data, mode, mtime_ns), stores what is new in packs of the state to come, and gives their
        entries."""
        made = chunking.chunk(files, *self.config["chunker"])
        content = F.sha2(F.concat(F.lit(S.REPO_KEY + chr(S.OBJECT_TYPES["chunk"])).cast("binary"), F.col("data")), 256)
        named = files.select("path", F.coalesce("data", F.lit(b"")).alias("data"), "mode", "mtime_ns").withColumn("content_id", content)
        lists = made.drop("data").join(named.select("path", "content_id"), "path").select("content_id", "idx", "offset", "len", "chunk_id").dropDuplicates(["content_id", "idx"])
        chunks = made.select("chunk_id", "data").dropDuplicates(["chunk_id"])
        new_chunks = chunks.join(self._table("chunks", CHUNK, state).select("chunk_id"), "chunk_id", "left_anti")
        new_lists = lists.join(self._table("lists", LIST, state).select("content_id").distinct(), "content_id", "left_anti")
        self._pack("chunks", new_chunks, state)
        self._pack("lists", new_lists, state)
        return named.select("path", F.lit("file").alias("kind"), F.col("mode").cast("int").alias("mode"), F.col("mtime_ns").cast("long").alias("mtime_ns"), F.octet_length("data").cast("long").alias("size"), "content_id", S.file_id(F.col("path")).alias("file_id"))

    def _commit(self, state: State, branch: str, tree_id: str, now: int, kind: str, message: str, author: str = "") -> str:
        if kind not in S.COMMIT_KINDS:
            raise ValueError(f"no such kind of commit: {kind}")
        row = {"root": tree_id, "time_ns": now * 1_000_000_000, "author": author, "kind": kind, "message": message}
        commit = hashlib.sha256(json.dumps([row, branch, state.number]).encode()).hexdigest()
        state.commits[commit] = row
        if branch in state.refs.branches:
            state.refs.commit(branch, commit)
        else:
            state.refs.create(branch, commit)
        return commit

    # ------------------------------------------------------------ reading

    def resolve(self, spec: str) -> tuple[str, str]:
        """(commit, path) of a branch, snap/<name> or commit prefix, with an optional :path."""
        name, _, path = spec.partition(":")
        if path.startswith("/"):
            raise RefError(f"not a path: {path}")
        state = self.state()
        commit = state.refs.resolve(name)
        return commit, "/".join(p for p in path.split("/") if p)

    def entries(self, spec: str) -> DataFrame:
        commit, path = self.resolve(spec)
        e = self.tree(self.state().commits[commit]["root"])
        return e.where((F.col("path") == path) | F.col("path").startswith(path + "/")) if path else e

    def ls(self, spec: str) -> DataFrame:
        commit, path = self.resolve(spec)
        return tree.ls(self.tree(self.state().commits[commit]["root"]), path)

    def cat(self, spec: str) -> DataFrame:
        """(path, data) of all files at or below the path, put together from their chunks, each of which must hash to its
        id."""
        files = self.entries(spec).where("kind = 'file'").select("path", "content_id")
        pieces = files.join(self._table("lists", LIST), "content_id").join(self._table("chunks", CHUNK).dropDuplicates(["chunk_id"]), "chunk_id")
        sound = F.when(F.sha2("data", 256) == F.col("chunk_id"), F.col("data")).otherwise(F.raise_error(F.concat(F.lit("damaged chunk "), "chunk_id")).cast("binary"))
        return files.select("path").join(chunking.reassemble(pieces.select("path", "idx", sound.alias("data"))), "path", "left").select("path", F.coalesce("data", F.lit(b"")).alias("data"))

    def read(self, spec: str, offset: int, length: int) -> bytes:
        """Bytes [offset, offset + length) of one file, from the chunks that hold them; short at the end, empty past it."""
        commit, path = self.resolve(spec)
        file = tree.entry_at(self.tree(self.state().commits[commit]["root"]), path).where("kind = 'file'").select("content_id")
        pieces = file.join(self._table("lists", LIST), "content_id").select(F.col("content_id").alias("file"), "idx", F.col("offset").alias("start"), F.col("len").cast("long").alias("len"), "chunk_id")
        wanted = file.select(F.col("content_id").alias("file"), F.lit(0).alias("request"), F.lit(offset).cast("long").alias("offset"), F.lit(length).cast("long").alias("len"))
        parts = overlay.read(pieces, wanted, self.config["chunker"][2]).join(pieces.select("file", "idx", "chunk_id"), ["file", "idx"]).join(self._table("chunks", CHUNK).dropDuplicates(["chunk_id"]), "chunk_id")
        rows = parts.select("idx", F.substring("data", F.col("skip").cast("int") + 1, F.col("take").cast("int")).alias("part")).orderBy("idx").collect()
        return b"".join(bytes(r.part) for r in rows)

    def deleted(self, now: int, ttl: int = 7 * 86_400) -> list[tuple[str, bool, int]]:
        """(name, is a snapshot, seconds) of what can still be restored, newest first."""
        return sorted(((n, s, t) for n, s, t, _ in self.state().refs.tombstones if t >= now - ttl), key=lambda x: (-x[2], x[0]))

    def log(self, branch: str, path: str | None = None) -> DataFrame:
        """(seq, commit, time_ns, kind, message), newest first; with a path, the entries that changed it."""
        state = self.state()
        rows = [(branch, i, c, state.commits[c]["time_ns"], state.commits[c]["kind"], state.commits[c]["message"], state.commits[c]["root"]) for i, c in enumerate(state.refs.branch(branch).log)]
        df = self.spark.createDataFrame(rows, "branch string, seq long, commit string, time_ns long, kind string, message string, root string")
        if path is not None:
            roots = sorted({r[-1] for r in rows})
            at = None
            for r in roots:
                e = tree.entry_at(self.tree(r), path).select(F.lit(r).alias("root"), F.concat("kind", "content_id").alias("content_id"), "mode")
                at = e if at is None else at.unionByName(e)
            df = history.log_path(df.join(at, "root", "left"))
        return df.orderBy(F.col("seq").desc()).select("seq", "commit", "time_ns", "kind", "message")

    def diff(self, a: str, b: str) -> DataFrame:
        """Changes between two versions; with one path in either or both, those at or below it."""
        paths = {self.resolve(x)[1] for x in (a, b)} - {""}
        if len(paths) > 1:
            raise RefError(f"two paths: {sorted(paths)}")
        out = diff.diff(self.entries(a.partition(":")[0]), self.entries(b.partition(":")[0]))
        return out.where((F.col("path") == (at := paths.pop())) | F.col("path").startswith(at + "/")) if paths else out

    def snapshots(self) -> dict[str, str]:
        """Commits by snapshot name."""
        return dict(sorted(self.state().refs.snapshots.items()))

    def branches(self) -> list[str]:
        return sorted(self.state().refs.branches)

    # ------------------------------------------------------------ writing

    def import_files(self, files: DataFrame, branch: str, now: int, message: str = "", kind: str = "import") -> str:
        """Commits files(path, data, mode, mtime_ns) to a branch, which is made if need be; known paths keep their ids."""
        state = self.state()
        entries = tree.build(self._store_files(files, state))
        if branch in state.refs.branches:
            entries = tree.keep_ids(entries, self.tree(state.commits[state.refs.branches[branch].head]["root"]))
        commit = self._commit(state, branch, self._store_tree(entries), now, kind, message)
        self._swap(state)
        return commit

    def commit_overlay(self, branch: str, whiteouts: DataFrame, files: DataFrame, now: int, message: str = "", kind: str = "auto") -> str:
        """Commits uncommitted changes: paths that are gone, and files(path, data, mode, mtime_ns) that are new."""
        state = self.state()
        base = self.tree(state.commits[state.refs.branch(branch).head]["root"])
        new = self._store_files(files, state)
        visible = overlay.apply(base.where("kind <> 'dir'"), whiteouts, new)
        commit = self._commit(state, branch, self._store_tree(tree.keep_ids(tree.build(visible), base)), now, kind, message)
        self._swap(state)
        return commit

    def restore(self, branch: str, path: str, source: str, now: int) -> str:
        state = self.state()
        base = self.tree(state.commits[state.refs.branch(branch).head]["root"])
        files = overlay.restore(base, self.entries(source), path).where("kind <> 'dir'")
        commit = self._commit(state, branch, self._store_tree(tree.build(files)), now, "restore", f"restore {path} from {source}")
        self._swap(state)
        return commit

    def merge(self, dst: str, src: str, now: int, resolve: str = "refuse", dry_run: bool = False) -> dict:
        """outcome (up_to_date, merged or conflicts) with the paths taken and in conflict."""
        state = self.state()
        d, s = state.refs.branch(dst), state.refs.branch(src)
        found = [(c, p) for p, c in state.refs.merge_candidates(dst, src)]
        if not found:
            raise RefError(f"no merge base of {dst} and {src}")
        base = max(found, key=lambda x: (state.commits[x[0]]["time_ns"], -x[1]))[0]
        if d.head == s.head or base == s.head:
            return {"outcome": "up_to_date", "taken": [], "conflicts": []}
        b, o, t = (self.tree(state.commits[c]["root"]) for c in (base, d.head, s.head))
        rows = merge.outcome(b, o, t).orderBy("path").collect()
        out = {"taken": [r.path for r in rows if r.outcome == "taken"], "conflicts": [r.path for r in rows if r.outcome == "conflict"]}
        if out["conflicts"] and resolve == "refuse":
            return {"outcome": "conflicts", **out}
        files = merge.merge(b, o, t, resolve, src).where("kind <> 'dir'")
        tree_id = self._store_tree(tree.build(files))
        if tree_id == state.commits[d.head]["root"]:
            return {"outcome": "up_to_date", **out}
        if not dry_run:
            row = {"root": tree_id, "time_ns": now * 1_000_000_000, "author": "", "kind": "merge", "message": f"merge {src}"}
            commit = hashlib.sha256(json.dumps([row, dst, state.number]).encode()).hexdigest()
            state.commits[commit] = row
            state.refs.merged(dst, src, commit)
            self._swap(state)
        return {"outcome": "merged", **out}

    def update(self, branch_head: str, local: DataFrame, there: str) -> dict:
        """Whether local entries, made over the commit branch_head, can move to the branch `there`: all or nothing."""
        state = self.state()
        head = state.refs.resolve(there)
        if head == branch_head:
            return {"outcome": "up_to_date", "changed": 0, "conflicts": []}
        base, new = (self.tree(state.commits[c]["root"]) for c in (branch_head, head))
        clash = [r.path for r in diff.update_conflicts(base, local, new).orderBy("path").collect()]
        changed = diff.changed_entries(base, new).count()
        return {"outcome": "conflicts" if clash else "updated", "changed": 0 if clash else changed, "conflicts": clash}

    def change(self, command: str, *args: object, **kwargs: object) -> object:
        """fork, snapshot, rename, reset, delete_branch, delete_snapshot or undelete, as in Refs."""
        if command not in ("fork", "snapshot", "rename", "reset", "delete_branch", "delete_snapshot", "undelete"):
            raise RefError(f"no such command: {command}")
        state = self.state()
        out = getattr(state.refs, command)(*args, **kwargs)
        self._swap(state)
        return out

    def mount(self, name: str, branch: str | None, now: int) -> None:
        """Records that a working copy `name` stands on a branch's head, which keeps that commit from collection; None
        removes the record."""
        state = self.state()
        if branch is None:
            state.mounts.pop(name, None)
        else:
            state.mounts[name] = [state.refs.branch(branch).head, now]
        self._swap(state)

    # ------------------------------------------------------------ upkeep

    def _roots(self, state: State, now: int, ttl: int, mount_ttl: int) -> set[str]:
        refs = state.refs
        out = {c for r in refs.branches.values() for c in (*r.log, r.head, *r.merge_bases.values())} | set(refs.snapshots.values())
        for _, _, at, was in refs.tombstones:
            if now - at <= ttl:
                out |= {was} if isinstance(was, str) else {*was.log, was.head, *was.merge_bases.values()}
        out |= {commit for commit, seen in state.mounts.values() if now - seen < mount_ttl}
        return out & state.commits.keys()

    def _contents(self, state: State, commits: set[str]) -> DataFrame:
        """Content ids of the files of these commits."""
        files = self.trees(sorted({state.commits[c]["root"] for c in commits})).where("kind = 'file'")
        return files.select("content_id", "size").distinct()

    def gc(self, now: int, grace: int = 86_400, ttl: int = 7 * 86_400, auto_days: int = 14, manual_days: int = 0, mount_ttl: int = 30 * 86_400, dry_run: bool = False) -> dict:
        """Retention, then mark, then sweep of what an older run found dead too. The first run only marks.

        Packs without live chunks are dropped, and of those with less than half alive the live ones are written anew; lists
        and trees that no kept commit needs go too. All this shows with the next state: if another writer was first, the
        run fails and has changed nothing. Files are deleted by a run that finds them unnamed for `grace` seconds.
        """
        state = self.state()
        day = history.DAY_NS
        dropped = 0
        for name, r in list(state.refs.branches.items()):
            keep = tuple(c for c in r.log if c == r.head or (state.commits[c]["time_ns"] >= now * 10**9 - auto_days * day if state.commits[c]["kind"] == "auto" else not manual_days or state.commits[c]["time_ns"] >= now * 10**9 - manual_days * day))
            dropped += len(r.log) - len(keep)
            state.refs.branches[name] = Ref(**asdict(r) | {"log": keep, "forked_from": r.forked_from})
        state.refs.tombstones = [t for t in state.refs.tombstones if now - t[2] <= ttl]
        roots = self._roots(state, now, ttl, mount_ttl)
        contents = self._contents(state, roots).select("content_id").distinct()
        lists, chunks = self._table("lists", LIST, state), self._table("chunks", CHUNK, state)
        live = lists.join(contents, "content_id", "left_semi").select(F.col("chunk_id").alias("id")).distinct()
        dead = reach.dead_now(chunks.select(F.col("chunk_id").alias("id")).distinct(), live)
        due = [name for name, at in state.dead.items() if at <= now - grace]
        sweep = dead.limit(0)
        if due:
            old = self.spark.read.schema("id string").parquet(*[f"{self.root}/{name}" for name in due])
            sweep = reach.confirmed(old, live).join(dead, "id", "left_semi")
        index = chunks.join(sweep.withColumn("gone", F.lit(True)), F.col("chunk_id") == F.col("id"), "left")
        index = index.select("pack", F.lit(True).alias("is_data"), F.octet_length("data").cast("long").alias("len"), F.col("gone").isNull().alias("live"))
        packs = {r.pack: r for r in reach.pack_sweep(index).where("action <> 'keep'").collect()}
        acted = chunks.where(F.col("pack").isin(*packs)) if packs else chunks.limit(0)
        report = {
            "dropped_entries": dropped, "newly_dead": dead.count(), "deleted": acted.join(sweep, F.col("chunk_id") == F.col("id"), "left_semi").select("chunk_id").distinct().count(),
            "packs_deleted": sum(r.action == "delete" for r in packs.values()), "packs_repacked": sum(r.action == "repack" for r in packs.values()),
            "bytes_freed": sum(r.total - r.kept for r in packs.values()), "commits_dropped": len(state.commits.keys() - roots),
        }
        if dry_run:
            return report
        name = f"dead/{uuid.uuid4().hex}"
        dead.write.parquet(f"{self.root}/{name}")
        if any(r.action == "repack" for r in packs.values()):
            self._pack("chunks", acted.join(sweep, F.col("chunk_id") == F.col("id"), "left_anti").select("chunk_id", "data").dropDuplicates(["chunk_id"]), state)
        unnamed = [*packs, *state.dead]
        if due and state.packs["lists"]:
            unnamed += state.packs["lists"]
            state.packs["lists"] = []
            self._pack("lists", lists.drop("pack").join(contents, "content_id", "left_semi"), state)
        needed = {state.commits[c]["root"] for c in roots}
        unnamed += [f"trees/{x['root']}" for c, x in state.commits.items() if c not in roots and x["root"] not in needed]
        state.packs["chunks"] = [p for p in state.packs["chunks"] if p not in packs]
        expired = [p for p, at in state.trash.items() if at <= now - grace and p.split("/")[-1] not in needed]
        state.trash = {p: at for p, at in state.trash.items() if p not in expired and p.split("/")[-1] not in needed} | dict.fromkeys(unnamed, now)
        state.dead = {name: now}
        state.commits = {c: x for c, x in state.commits.items() if c in roots}
        self._swap(state)
        for p in expired:
            self._delete(p)
        return report

    def fsck(self) -> DataFrame:
        """(id, problem) of all that a commit needs: trees and chunk lists that are missing, directories whose entries hash to
        another id, chunks that are missing or hash to another id."""
        state = self.state()
        roots = sorted({x["root"] for x in state.commits.values()})
        there = [r for r in roots if self._has(f"trees/{r}")]
        out = self.spark.createDataFrame([(r, "missing tree") for r in roots if r not in there], "id string, problem string")
        for r in there:
            e = self.tree(r)
            made = tree.tree_ids(e.where("path <> ''")).select("path", F.col("content_id").alias("made"))
            wrong = e.where("kind = 'dir'").join(made, "path", "left").where("made is null or made <> content_id")
            out = out.unionByName(wrong.select(F.col("content_id").alias("id"), F.lit("tree mismatch").alias("problem")))
        contents = self._contents(state, {c for c, x in state.commits.items() if x["root"] in there})
        lists = self._table("lists", LIST, state)
        lost = contents.where("size > 0").join(lists, "content_id", "left_anti").select(F.col("content_id").alias("id"), F.lit("missing list").alias("problem"))
        live = lists.join(contents, "content_id", "left_semi").select(F.col("chunk_id").alias("id")).distinct()
        stored = self._table("chunks", CHUNK, state).select(F.col("chunk_id").alias("id"), F.sha2("data", 256).alias("actual")).distinct()
        return out.unionByName(lost).unionByName(reach.fsck(live, stored))
