import pytest

from palimpsest.operators.refs import RefError
from palimpsest.plans.repository import CHUNK, Repository


@pytest.fixture
def repo(spark, tmp_path):
    return Repository.init(spark, f"file://{tmp_path}/repo", chunker=(64, 256, 1024))


def files(spark, mtime=0, **content):
    rows = [(p.replace("__", "/").replace("_", "."), bytearray(c.encode()), 420, mtime) for p, c in content.items()]
    return spark.createDataFrame(rows, "path string, data binary, mode int, mtime_ns long")


def contents(repo, spec):
    return {r.path: bytes(r.data).decode() for r in repo.cat(spec).collect()}


def test_a_session(spark, repo):
    plan, long = {"notes_md": "n1", "src__main_c": "m1", "src__util_c": "u1", "blank": ""}, "0123456789" * 400
    assert Repository.probe(spark, repo.root)["format_version"] == 2 and Repository.probe(spark, repo.root + "x") is None
    assert repo.gc(50)["newly_dead"] == 0 and repo.fsck().count() == 0
    repo.import_files(files(spark, **plan, data__log=long), "trunk", 100, "start")
    with pytest.raises(RefError):
        Repository.init(spark, repo.root)
    repo.change("fork", "trunk", "topic", 110)
    repo.import_files(files(spark, 2, **plan | {"src__main_c": "m2"}, docs__a_md="a"), "topic", 120)
    repo.import_files(files(spark, 1, **plan | {"notes_md": "n2"}, data__log=long), "trunk", 130)
    assert {tuple(r) for r in repo.diff("trunk", "topic").collect()} == {("notes.md", "modified"), ("src/main.c", "modified"), ("data", "removed"), ("docs", "added")}
    assert {tuple(r) for r in repo.diff("trunk:src", "topic:src").collect()} == {("src/main.c", "modified")}
    assert repo.diff("trunk:docs", "topic").count() == 1
    with pytest.raises(RefError):
        repo.diff("trunk:src", "topic:docs")
    assert repo.merge("trunk", "topic", 140, dry_run=True)["outcome"] == "merged" and len(repo.state().refs.branch("trunk").log) == 2
    done = repo.merge("trunk", "topic", 140)
    assert done["outcome"] == "merged" and done["conflicts"] == [] and {"src/main.c", "docs"} <= set(done["taken"])
    merged = {"notes.md": "n2", "src/main.c": "m2", "src/util.c": "u1", "blank": "", "docs/a.md": "a", "data/log": long}  # its time has changed, which beats its deletion
    assert contents(repo, "trunk") == merged
    assert repo.merge("trunk", "topic", 150)["outcome"] == "up_to_date"
    assert [(r.kind, r.message) for r in repo.log("trunk").collect()] == [("merge", "merge topic"), ("import", ""), ("import", "start")]
    assert [r.seq for r in repo.log("trunk", "notes.md").collect()] == [1, 0]
    assert [r.name for r in repo.ls("trunk:src").collect()] == ["main.c", "util.c"]
    repo.change("snapshot", "r1", "trunk")
    assert list(repo.snapshots()) == ["r1"]
    head = repo.commit_overlay("trunk", spark.createDataFrame([("src",)], "path string"), files(spark, 3, todo="t"), 160)
    assert contents(repo, "trunk") == {k: v for k, v in merged.items() if not k.startswith("src/")} | {"todo": "t"}
    repo.restore("trunk", "src", "snap/r1", 170)
    assert contents(repo, "trunk:src") == {"src/main.c": "m2", "src/util.c": "u1"} and repo.log("trunk").first().kind == "restore"
    assert repo.update(head, repo.entries(head[:12]), "trunk")["outcome"] == "updated"
    assert repo.fsck().count() == 0


def test_fsck_tells_what_is_lost(spark, repo):
    repo.import_files(files(spark, d__a="x" * 3000, d__b="y"), "main", 0)
    state = repo.state()
    state.packs["lists"] = []
    repo._swap(state)
    assert {r.problem for r in repo.fsck().collect()} == {"missing list"}
    root = state.commits[state.refs.branch("main").head]["root"]
    repo._delete(f"trees/{root}")
    assert [tuple(r) for r in repo.fsck().collect()] == [(root, "missing tree")]


def test_conflicts(spark, repo):
    repo.import_files(files(spark, a_txt="a", o="1"), "main", 100)
    repo.change("fork", "main", "feature", 110)
    repo.import_files(files(spark, 1, a_txt="x", o="1"), "main", 120)
    repo.import_files(files(spark, 2, a_txt="y", o="1"), "feature", 130)
    assert repo.merge("main", "feature", 140)["outcome"] == "conflicts"
    assert len(repo.state().refs.branch("main").log) == 2
    assert repo.merge("main", "feature", 150, resolve="both")["outcome"] == "merged"
    assert contents(repo, "main") == {"a.txt": "x", "a.feature.txt": "y", "o": "1"}


def test_mark_then_sweep(spark, repo):
    day = 86_400
    repo.import_files(files(spark, a="old " * 400), "main", 0, kind="auto")
    repo.import_files(files(spark, a="new " * 400), "main", 10)
    chunks = lambda: repo._table("chunks", CHUNK).count()
    before = chunks()
    first = repo.gc(100 * day, dry_run=True)
    assert first["dropped_entries"] == 1 and first["deleted"] == 0 and first["newly_dead"] > 0
    assert repo.gc(100 * day)["deleted"] == 0 and chunks() == before
    second = repo.gc(102 * day)
    assert second["deleted"] == first["newly_dead"] and chunks() == before - first["newly_dead"]
    assert second["packs_deleted"] == 1 and second["bytes_freed"] > 0
    gone = [p for p in repo.state().trash if p.startswith("chunks/")]
    assert gone and all(repo._has(p) for p in gone), "files stay for a grace"
    assert repo.gc(104 * day)["deleted"] == 0 and repo.fsck().count() == 0 and not any(repo._has(p) for p in gone)
    assert contents(repo, "main") == {"a": "new " * 400}


def test_a_sweep_that_loses_the_race_changes_nothing(spark, repo, monkeypatch):
    repo.import_files(files(spark, a="old " * 400), "main", 0, kind="auto")
    repo.import_files(files(spark, a="new " * 400, b="more"), "main", 10)
    repo.gc(10**7)
    stale = repo.state()
    repo.change("snapshot", "keep", "main")
    with monkeypatch.context() as m, pytest.raises(RefError):
        m.setattr(repo, "state", lambda: stale)
        repo.gc(2 * 10**7)
    assert contents(repo, "main") == {"a": "new " * 400, "b": "more"} and repo.fsck().count() == 0
    assert all(repo._has(p) for packs in repo.state().packs.values() for p in packs)


def test_half_dead_packs_are_written_anew(spark, repo):
    parts = {f"f{i}": f"{i} " * 500 for i in range(6)}
    repo.import_files(files(spark, **parts), "main", 0, kind="auto")
    repo.import_files(files(spark, f0=parts["f0"]), "main", 10)
    repo.gc(10**7)
    report = repo.gc(2 * 10**7)
    assert report["packs_repacked"] == 1 and report["deleted"] > 0
    assert contents(repo, "main") == {"f0": parts["f0"]} and repo.fsck().count() == 0
    again = repo.import_files(files(spark, **parts), "main", 2 * 10**7 + 1)
    assert contents(repo, again[:12]) == parts


def test_reads_mounts_and_tombstones(spark, repo):
    day = 86_400
    text = "".join(f"{i:05d}" for i in range(1000))
    first = repo.import_files(files(spark, a__b=text), "main", 0, kind="auto")
    for at, n in ((0, 10), (63, 2000), (4990, 100), (5000, 5), (9000, 1)):
        assert repo.read("main:a/b", at, n) == text.encode()[at : at + n]
    repo.mount("desk", "main", 100 * day)
    repo.import_files(files(spark, a__b="new"), "main", 1)
    assert repo.gc(101 * day, dry_run=True)["newly_dead"] == 0
    assert repo.gc(140 * day, dry_run=True)["newly_dead"] > 0
    repo.mount("desk", None, 0)
    assert repo.gc(101 * day, dry_run=True)["newly_dead"] > 0 and first in repo.state().commits
    repo.change("fork", "main", "old", 5)
    repo.change("delete_branch", "old", 100)
    assert repo.deleted(200) == [("old", False, 100)] and repo.deleted(100 + 8 * day) == []
    repo.change("undelete", "old", 300, 7 * day)
    assert repo.branches() == ["main", "old"]


def test_fork_is_one_row(spark, repo):
    repo.import_files(files(spark, a="a"), "main", 0)
    n = repo.state().number
    repo.change("fork", "main", "other", 1)
    assert repo.state().number == n + 1 and repo.branches() == ["main", "other"]
    stale = repo.state()
    repo.change("snapshot", "v1", "main")
    with pytest.raises(RefError):
        repo._swap(stale)


def test_follow(spark, repo, tmp_path):
    from palimpsest.streaming.sessions import follow

    first = repo.import_files(files(spark, a="a"), "main", 0)
    q = follow(spark, repo.root, "main").writeStream.format("memory").queryName("heads").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).start()
    try:
        q.processAllAvailable()
        repo.change("snapshot", "v1", "main")
        second = repo.import_files(files(spark, a="b"), "main", 1)
        q.processAllAvailable()
    finally:
        q.stop()
    q = follow(spark, repo.root, "main").writeStream.format("memory").queryName("all_heads").outputMode("append").option("checkpointLocation", str(tmp_path / "d")).start()
    try:
        repo.change("reset", "main", first[:12])
        q.processAllAvailable()
    finally:
        q.stop()
    assert [r["head"] for r in spark.sql("select * from heads order by number").collect()] == [first, second]
    assert [r["head"] for r in spark.sql("select * from all_heads order by number").collect()] == [first, second, first]
