"""All queries of the engine by name, and the DuckDB SQL that gives the same rows."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from functools import partial

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .functions import scalars as S
from .operators import cache, chunking, diff, edits, history, merge, overlay, reach, refs, tree
from .plans import versions as V
from .plans.repository import Repository
from .plans.versions import hashed, table
from .session import cut, shared_dir
from .streaming import sessions

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}
ENTRY = ("path", "kind", "mode", "mtime_ns", "size", "content_id")


def query(name: str, oracle: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[name] = f
        if oracle:
            ORACLES[name] = oracle
        return f

    return add


def _md5(c: str) -> Column:
    return F.md5(F.col(c).cast("string").cast("binary"))


# ---------------------------------------------------------------- objects, trees, lookups


@query("q01_content_ids", f"SELECT doc_id, {hashed('chunk', 'text')} AS content_id, substr({hashed('chunk', 'text')}, 1, 12) AS short_id FROM documents")
def content_ids(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "documents").select("doc_id", S.object_id("chunk", F.col("text")).alias("content_id"))
    return d.withColumn("short_id", S.short_id(F.col("content_id")))


@query("q02_content_class", "SELECT doc_id, strlen(text) AS size, CASE WHEN strlen(text) <= 4096 THEN 'inline' WHEN strlen(text) <= 16384 THEN 'chunk' ELSE 'chunk_list' END AS class FROM documents")
def content_classes(spark: SparkSession, sf: str) -> DataFrame:
    size = F.octet_length("text").cast("long")
    return table(spark, sf, "documents").select("doc_id", size.alias("size"), S.content_class(size, F.ceil(size / 16384)).alias("class"))


@query(
    "q03_dedup_objects",
    f"""WITH o AS (SELECT doc_id, {hashed("chunk", "text")} AS id, strlen(text) AS size FROM documents),
    stored AS (SELECT DISTINCT id FROM o WHERE doc_id % 3 = 0), dead AS (SELECT DISTINCT id FROM o WHERE doc_id % 6 = 0)
    SELECT id, max(size)::BIGINT AS size FROM o WHERE id NOT IN (SELECT id FROM stored WHERE id NOT IN (SELECT id FROM dead)) GROUP BY id""",
)
def dedup_objects(spark: SparkSession, sf: str) -> DataFrame:
    o = table(spark, sf, "documents").select("doc_id", S.object_id("chunk", F.col("text")).alias("id"), F.octet_length("text").cast("long").alias("size"))
    return reach.new_objects(o.select("id", "size"), o.where("doc_id % 3 = 0").select("id").distinct(), o.where("doc_id % 6 = 0").select("id").distinct())


@query("q03_uploaded", f"""WITH o AS (SELECT {hashed("chunk", "text")} AS id, strlen(text) AS size FROM documents), d AS (SELECT id, max(size) AS size FROM o GROUP BY id)
    SELECT (SELECT count(*) FROM o) AS files, (SELECT sum(size)::BIGINT FROM o) AS file_bytes, count(*) AS objects, sum(size)::BIGINT AS bytes FROM d""")
def uploaded(spark: SparkSession, sf: str) -> DataFrame:
    o = table(spark, sf, "documents").select(S.object_id("chunk", F.col("text")).alias("id"), F.octet_length("text").cast("long").alias("size"))
    g = o.groupBy("id").agg(F.count("*").alias("n"), F.max("size").alias("size"))
    return g.agg(F.sum("n").alias("files"), F.sum(F.col("n") * F.col("size")).alias("file_bytes"), F.count("*").alias("objects"), F.sum("size").alias("bytes"))


for _v in ("base", "ours", "theirs"):
    QUERIES[f"q04_tree_{_v}"] = lambda spark, sf, v=_v: V.entries(spark, sf, v).select(*ENTRY)
    ORACLES[f"q04_tree_{_v}"] = f"{V.with_entries(_v)} SELECT {', '.join(ENTRY)} FROM {_v}"


@query("q05_ls", f"""{V.with_entries("base")} SELECT string_split(path, '/')[-1] AS name, kind, mode, size FROM base WHERE path LIKE 'en/src1/%' OR regexp_matches(path, '^en/src1$') AND kind <> 'dir'""")
def ls(spark: SparkSession, sf: str) -> DataFrame:
    return tree.ls(V.entries(spark, sf, "base"), "en/src1").select("name", "kind", "mode", "size")


@query("q05_entry_at", f"{V.with_entries('base')} SELECT path, kind, content_id FROM base WHERE path = 'en/src1'")
def entry_at(spark: SparkSession, sf: str) -> DataFrame:
    return tree.entry_at(V.entries(spark, sf, "base"), "/en//src1/").select("path", "kind", "content_id")


@query("q05_flatten", f"{V.with_entries('base')} SELECT path, kind, content_id AS ref_id FROM base WHERE path <> ''")
def flatten(spark: SparkSession, sf: str) -> DataFrame:
    e = V.entries(spark, sf, "base")
    up = e.where("kind = 'dir'").select(F.col("path").alias("up"), F.col("content_id").alias("tree_id"))
    trees = e.where("path <> ''").withColumn("up", S.parent(F.col("path"))).join(up, "up").select("tree_id", S.name(F.col("path")).alias("name"), "kind", F.col("content_id").alias("ref_id")).distinct()
    return tree.flatten(trees, e.where("path = ''").select("content_id").first()[0])


@query("q05_file_ids", f"{V.with_entries('base', 'theirs')} SELECT t.path, b.path IS NOT NULL AS kept FROM theirs t LEFT JOIN base b ON b.path = t.path AND b.kind = t.kind")
def file_ids(spark: SparkSession, sf: str) -> DataFrame:
    before = V.entries(spark, sf, "base").withColumn("file_id", F.lit(1 << 40).cast("long"))
    return tree.keep_ids(V.entries(spark, sf, "theirs"), before).select("path", (F.col("file_id") == 1 << 40).alias("kept"))


# ---------------------------------------------------------------- diff and merge


def _sides(spark: SparkSession, sf: str, *names: str) -> list[DataFrame]:
    return [V.entries(spark, sf, n) for n in names]


@query("q06_diff", f"{V.with_entries('base', 'theirs')} {V.diff_sql('base', 'theirs')}")
def diff_versions(spark: SparkSession, sf: str) -> DataFrame:
    return diff.diff(*_sides(spark, sf, "base", "theirs"))


@query("q07_diff_stat", f"{V.with_entries('base', 'theirs')} SELECT change, count(*) AS n FROM ({V.diff_sql('base', 'theirs')}) GROUP BY change")
def diff_stat(spark: SparkSession, sf: str) -> DataFrame:
    return diff.stat(diff_versions(spark, sf))


@query("q08_diff_pruned", f"{V.with_entries('base', 'ours')} {V.diff_sql('base', 'ours')}")
def diff_pruned(spark: SparkSession, sf: str) -> DataFrame:
    return diff.pruned(*_sides(spark, sf, "base", "ours"))


_KEEP_O = "(how IS NULL OR how IN ('ours', 'keep_dir_ours') OR how = 'dir_theirs' AND spot = path)"
_KEEP_T = "(how IN ('take', 'theirs_back') OR how = 'dir_theirs' AND spot <> path)"


def _merged_sql(resolve: str) -> str:
    o = _KEEP_O if resolve == "theirs" else f"({_KEEP_O} OR how = 'conflict')"
    t = f"({_KEEP_T} OR how = 'conflict')" if resolve == "theirs" else _KEEP_T
    out = f"""SELECT o.path, o.kind, o.mode, o.content_id FROM ruled r JOIN ours o ON o.path = r.path WHERE r.path <> '' AND {o.replace("path", "r.path")}
        UNION ALL SELECT t.path, t.kind, t.mode, t.content_id FROM ruled r JOIN theirs t ON t.path = r.path WHERE r.path <> '' AND {t.replace("path", "r.path")}"""
    if resolve == "both":
        renamed = "CASE WHEN regexp_matches(r.spot, '[^/]\\.[^./]*$') THEN regexp_replace(r.spot, '\\.([^./]*)$', '.theirs.\\1') ELSE r.spot || '.theirs' END"
        out += f" UNION ALL SELECT {renamed} || substr(t.path, length(r.spot) + 1), t.kind, t.mode, t.content_id FROM ruled r JOIN theirs t ON t.path = r.path WHERE r.how = 'conflict'"
    return f"{V.with_entries('base', 'ours', 'theirs')}, {V.merge_sql()} {out}"


def _merged(resolve: str, spark: SparkSession, sf: str) -> DataFrame:
    return merge.merge(*_sides(spark, sf, "base", "ours", "theirs"), resolve=resolve).select("path", "kind", "mode", "content_id")


for _r, _n in (("refuse", "q09_merge_entries"), ("ours", "q10_merge_ours"), ("theirs", "q10_merge_theirs"), ("both", "q10_merge_both")):
    QUERIES[_n] = partial(_merged, _r)
    ORACLES[_n] = _merged_sql(_r)


@query(
    "q09_merge_outcome",
    f"""{V.with_entries("base", "ours", "theirs")}, {V.merge_sql()}, changed AS ({V.diff_sql("ours", "theirs")})
    SELECT path, CASE WHEN how = 'conflict' THEN 'conflict' ELSE 'taken' END AS outcome FROM ruled WHERE path <> '' AND spot = path AND how IN ('conflict', 'take', 'theirs_back')
    UNION ALL SELECT path, 'taken' FROM changed WHERE path IN (SELECT path FROM ruled WHERE how = 'dir_theirs' AND spot <> path)""",
)
def merge_outcome(spark: SparkSession, sf: str) -> DataFrame:
    return merge.outcome(*_sides(spark, sf, "base", "ours", "theirs"))


@query(
    "q10_merged_tree",
    None,
)
def merged_tree(spark: SparkSession, sf: str) -> DataFrame:
    """The merged tree with new directory ids; its root is what a merge commit names."""
    files = merge.merge(*_sides(spark, sf, "base", "ours", "theirs"), resolve="ours").where("kind <> 'dir'")
    return tree.build(files).where("kind = 'dir'").select("path", "content_id")


@query(
    "q11_merge_base",
    """WITH c AS (SELECT (o_custkey % 7)::VARCHAR AS dst, (o_orderkey % 5)::VARCHAR AS src, (1 + o_orderkey % 3)::INTEGER AS prio, sha256(o_orderkey::VARCHAR) AS "commit", epoch_us(o_orderdate) AS "time" FROM orders)
    SELECT dst, src, "commit", "time" FROM c QUALIFY row_number() OVER (PARTITION BY dst, src ORDER BY "time" DESC, prio, "commit") = 1""",
)
def merge_base(spark: SparkSession, sf: str) -> DataFrame:
    o = table(spark, sf, "orders")
    return merge.merge_base(o.select((F.col("o_custkey") % 7).cast("string").alias("dst"), (F.col("o_orderkey") % 5).cast("string").alias("src"), (1 + F.col("o_orderkey") % 3).cast("int").alias("prio"), F.sha2(F.col("o_orderkey").cast("string"), 256).alias("commit"), _micros("o_orderdate").alias("time")))


# ---------------------------------------------------------------- history and refs


def _micros(c: str) -> Column:
    return F.unix_micros(F.col(c).cast("timestamp"))


def _log(spark: SparkSession, sf: str) -> DataFrame:
    o = table(spark, sf, "orders")
    kind = F.when(F.col("o_orderpriority").startswith("1"), "manual").when(F.col("o_orderpriority").startswith("2"), "merge").otherwise("auto")
    e = o.select((F.col("o_custkey") % 10).alias("branch"), (_micros("o_orderdate") * 1000).alias("time_ns"), F.sha2(F.col("o_orderkey").cast("string"), 256).alias("commit"), kind.alias("kind"), "o_orderkey", "o_orderpriority", "o_orderstatus")
    return history.numbered(e, "time_ns", "o_orderkey")


_LOG = """l AS (SELECT o_custkey % 10 AS branch, epoch_us(o_orderdate) * 1000 AS time_ns, sha256(o_orderkey::VARCHAR) AS "commit",
    CASE WHEN o_orderpriority LIKE '1%' THEN 'manual' WHEN o_orderpriority LIKE '2%' THEN 'merge' ELSE 'auto' END AS kind, o_orderkey, o_orderpriority, o_orderstatus,
    row_number() OVER (PARTITION BY o_custkey % 10 ORDER BY o_orderdate, o_orderkey) - 1 AS seq FROM orders)"""


@query("q12_log", f'WITH {_LOG} SELECT branch, seq, time_ns, "commit", kind FROM l')
def log(spark: SparkSession, sf: str) -> DataFrame:
    return history.log(_log(spark, sf)).select("branch", F.col("seq").cast("long").alias("seq"), "time_ns", "commit", "kind")


@query(
    "q12_log_path",
    f"""WITH {_LOG}, s AS (SELECT branch, seq, CASE WHEN o_orderstatus <> 'F' THEN substr(o_orderpriority, 1, 1) END AS content_id, (o_orderkey % 2)::INTEGER AS mode FROM l),
    w AS (SELECT *, CASE WHEN content_id IS NULL THEN '-' ELSE content_id || mode END AS now, lead(CASE WHEN content_id IS NULL THEN '-' ELSE content_id || mode END) OVER (PARTITION BY branch ORDER BY seq DESC) AS older FROM s)
    SELECT branch, seq, content_id FROM w WHERE CASE WHEN older IS NULL THEN now <> '-' ELSE now <> older END""",
)
def log_path(spark: SparkSession, sf: str) -> DataFrame:
    there = F.col("o_orderstatus") != "F"
    s = _log(spark, sf).select("branch", "seq", F.when(there, F.substring("o_orderpriority", 1, 1)).alias("content_id"), F.when(there, (F.col("o_orderkey") % 2).cast("int")).alias("mode"))
    return history.log_path(s).select("branch", F.col("seq").cast("long").alias("seq"), "content_id")


@query("q13_log_segments", f'WITH {_LOG} SELECT branch, seq // 1000 AS segment, count(*) AS entries, min(time_ns) AS first_ns, max(time_ns) AS last_ns, arg_max("commit", seq) AS head FROM l GROUP BY 1, 2')
def log_segments(spark: SparkSession, sf: str) -> DataFrame:
    return history.segments(_log(spark, sf))


@query("q13_log_append", f"""WITH {_LOG}, n AS (SELECT branch, max(seq) AS last FROM l GROUP BY 1) SELECT branch, seq, "commit" FROM l UNION ALL SELECT branch, last + 1, sha256('new' || branch::VARCHAR) FROM n UNION ALL SELECT 99, 0, sha256('new99')""")
def log_append(spark: SparkSession, sf: str) -> DataFrame:
    e = _log(spark, sf).select("branch", F.col("seq").cast("long").alias("seq"), "time_ns", "commit", "kind")
    b = e.select("branch").distinct().unionByName(spark.range(1).select(F.lit(99).cast("long").alias("branch")))
    new = b.select("branch", F.lit(1 << 62).cast("long").alias("time_ns"), F.sha2(F.concat(F.lit("new"), F.col("branch").cast("string")), 256).alias("commit"), F.lit("manual").alias("kind"))
    return history.append(e, new).select("branch", "seq", "commit")


def _stones(spark: SparkSession, sf: str) -> DataFrame:
    secs = F.floor(_micros("o_orderdate") / 1_000_000)
    keys = table(spark, sf, "orders").select(F.concat(F.lit("b."), (F.col("o_custkey") % 50).cast("string"), F.lit("."), secs.cast("string")).alias("key"), F.col("o_orderkey").alias("id"))
    return history.tombstones(keys)


_STONES = "t AS (SELECT 'b.' || (o_custkey % 50) AS name, epoch_us(o_orderdate) // 1000000 AS secs, o_orderkey AS id FROM orders)"
_NOW, _TTL = 996_000_000, 30_000_000


@query("q14_list_deleted", f"WITH {_STONES} SELECT name, secs, id FROM t WHERE secs >= {_NOW - _TTL}")
def list_deleted(spark: SparkSession, sf: str) -> DataFrame:
    return history.list_deleted(_stones(spark, sf), _NOW, _TTL).select("name", "secs", "id")


@query("q14_newest_tombstone", f"WITH {_STONES} SELECT name, max(secs) AS secs FROM t GROUP BY name")
def newest_tombstone(spark: SparkSession, sf: str) -> DataFrame:
    return history.newest_tombstone(_stones(spark, sf))


@query("q14_expired", f"WITH {_STONES} SELECT name, secs, id FROM t WHERE {_NOW} - secs > {_TTL}")
def expired(spark: SparkSession, sf: str) -> DataFrame:
    return history.expired(_stones(spark, sf), _NOW, _TTL).select("name", "secs", "id")


@query(
    "q14_free_seconds",
    f"""WITH RECURSIVE {_STONES}, r AS (SELECT *, row_number() OVER (PARTITION BY name ORDER BY secs, id) AS i FROM t),
    w AS (SELECT name, id, secs, i, secs AS "at" FROM r WHERE i = 1 UNION ALL SELECT r.name, r.id, r.secs, r.i, greatest(r.secs, w."at" + 1) FROM w JOIN r ON r.name = w.name AND r.i = w.i + 1)
    SELECT name, id, "at" FROM w""",
)
def free_seconds(spark: SparkSession, sf: str) -> DataFrame:
    return history.free_seconds(_stones(spark, sf)).select("name", "id", "at")


_NOW_NS = 996_000_000_000_000_000


@query(
    "q15_retention",
    f"""WITH {_LOG}, h AS (SELECT branch, arg_max("commit", seq) AS head FROM l GROUP BY 1)
    SELECT branch, seq, kind FROM l JOIN h USING (branch) WHERE "commit" = head OR CASE WHEN kind = 'auto' THEN time_ns >= {_NOW_NS} - 300 * 86400000000000 ELSE time_ns >= {_NOW_NS} - 900 * 86400000000000 END""",
)
def retention(spark: SparkSession, sf: str) -> DataFrame:
    return history.retain(_log(spark, sf), _NOW_NS, auto_days=300, manual_days=900).select("branch", F.col("seq").cast("long").alias("seq"), "kind")


# ---------------------------------------------------------------- reachability, garbage, integrity


def _versions(spark: SparkSession, sf: str) -> DataFrame:
    parts = [V.entries(spark, sf, v).withColumn("version", F.lit(v)) for v in ("base", "ours", "theirs")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def _commits(e: DataFrame) -> DataFrame:
    return e.where("path = ''").select("version", S.object_id("commit", F.concat("version", F.col("content_id"))).alias("commit"), F.col("content_id").alias("root"))


def _roots(e: DataFrame) -> DataFrame:
    return _commits(e).where("version <> 'theirs'").select(F.col("commit").alias("id"))


_GRAPH = f"""{V.with_entries("base", "ours", "theirs")},
    e AS (SELECT 'base' AS version, * FROM base UNION ALL SELECT 'ours', * FROM ours UNION ALL SELECT 'theirs', * FROM theirs),
    c AS (SELECT version, {hashed("commit", "version || content_id")} AS id, content_id AS root FROM e WHERE path = ''),
    edges AS (SELECT id AS src, root AS dst, 'root' AS kind FROM c UNION SELECT d.content_id, x.content_id, CASE WHEN x.kind = 'dir' THEN 'tree' ELSE 'content' END
      FROM e x JOIN e d ON d.version = x.version AND d.kind = 'dir' AND x.path <> '' AND d.path = regexp_replace(x.path, '(^|/)[^/]*$', '')),
    live AS (SELECT id FROM c WHERE version IN ('base', 'ours') UNION SELECT dst FROM live JOIN edges ON src = id)"""


@query("q16_edges", f"{_GRAPH} SELECT src, dst, kind FROM edges")
def edges(spark: SparkSession, sf: str) -> DataFrame:
    e = _versions(spark, sf)
    return reach.edges(_commits(e), e)


@query("q16_mark", f"{_GRAPH} SELECT id FROM live")
def mark(spark: SparkSession, sf: str) -> DataFrame:
    return _live(spark, sf)[1]


@query(
    "q16_gc_roots",
    f"""WITH {_LOG}, {_STONES}, h AS (SELECT branch, arg_max("commit", seq) AS head FROM l GROUP BY 1)
    SELECT "commit" AS id, 'log' AS why FROM l WHERE kind <> 'auto' UNION SELECT head, 'head' FROM h UNION SELECT sha256('mb' || branch::VARCHAR), 'merge_base' FROM h
    UNION SELECT "commit", 'snapshot' FROM l WHERE o_orderkey % 100 = 1 UNION SELECT sha256(id::VARCHAR), 'tombstone' FROM t WHERE {_NOW} - secs <= {_TTL}
    UNION SELECT "commit", 'mount' FROM l WHERE o_orderkey % 100 = 2 AND {_NOW} - time_ns // 1000000000 < {_TTL}""",
)
def gc_roots(spark: SparkSession, sf: str) -> DataFrame:
    e = _log(spark, sf)
    heads = e.groupBy("branch").agg(F.max_by("commit", "seq").alias("head")).withColumn("merge_bases", F.create_map(F.lit("other"), F.sha2(F.concat(F.lit("mb"), F.col("branch").cast("string")), 256)))
    stones = _stones(spark, sf).withColumn("head", F.sha2(F.col("id").cast("string"), 256))
    mounts = e.where("o_orderkey % 100 = 2").select(F.col("commit").alias("base_commit"), F.floor(F.col("time_ns") / 1_000_000_000).alias("last_seen"))
    return reach.gc_roots(e.where("kind <> 'auto'"), heads, e.where("o_orderkey % 100 = 1"), stones, mounts, _NOW, _TTL, _TTL)


def _live(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    e = _versions(spark, sf)
    g = cut(reach.edges(_commits(e), e), "edges")
    stored = g.select(F.col("dst").alias("id")).union(g.select("src")).distinct()
    return stored, reach.mark(_roots(e), g)


_STORED = f"{_GRAPH}, stored AS (SELECT src AS id FROM edges UNION SELECT dst FROM edges)"


@query("q17_dead", f"{_STORED} SELECT id FROM stored EXCEPT SELECT id FROM live")
def dead(spark: SparkSession, sf: str) -> DataFrame:
    return reach.dead_now(*_live(spark, sf))


@query("q17_confirmed", f"{_STORED} SELECT id FROM stored WHERE id < '8' EXCEPT SELECT id FROM live")
def confirmed(spark: SparkSession, sf: str) -> DataFrame:
    stored, live = _live(spark, sf)
    return reach.confirmed(stored.where("id < '8'"), live)


@query("q17_revive", f"{_STORED} SELECT DISTINCT content_id AS id FROM theirs WHERE content_id IN (SELECT id FROM stored WHERE id < '8' AND id NOT IN (SELECT id FROM live)) AND content_id NOT IN (SELECT content_id FROM base)")
def revive(spark: SparkSession, sf: str) -> DataFrame:
    e = V.entries(spark, sf, "theirs").select(F.col("content_id").alias("id"))
    return reach.revive(e, V.entries(spark, sf, "base").select(F.col("content_id").alias("id")), confirmed(spark, sf))


@query("q17_orphan_packs", "SELECT s_suppkey AS pack FROM supplier WHERE s_suppkey NOT IN (SELECT l_suppkey FROM lineitem WHERE l_returnflag = 'R' AND l_linenumber = 7 AND l_quantity >= 50)")
def orphan_packs(spark: SparkSession, sf: str) -> DataFrame:
    index = table(spark, sf, "lineitem").where("l_returnflag = 'R' and l_linenumber = 7 and l_quantity >= 50").select(F.col("l_suppkey").alias("pack"))
    return reach.orphan_packs(table(spark, sf, "supplier").select(F.col("s_suppkey").alias("pack")), index)


@query(
    "q18_pack_sweep",
    """WITH g AS (SELECT l_suppkey AS pack, l_returnflag <> 'N' AS is_data, sum(l_quantity::BIGINT)::BIGINT AS total, coalesce(sum(CASE WHEN l_linestatus = 'O' AND l_shipdate >= TIMESTAMP '1998-01-01' THEN l_quantity::BIGINT END), 0)::BIGINT AS kept FROM lineitem GROUP BY 1, 2)
    SELECT *, CASE WHEN kept = 0 THEN 'delete' WHEN kept * 2 < total THEN 'repack' ELSE 'keep' END AS action FROM g""",
)
def pack_sweep(spark: SparkSession, sf: str) -> DataFrame:
    i = table(spark, sf, "lineitem").select(F.col("l_suppkey").alias("pack"), (F.col("l_returnflag") != "N").alias("is_data"), F.col("l_quantity").cast("long").alias("len"), ((F.col("l_linestatus") == "O") & (F.col("l_shipdate") >= F.lit("1998-01-01"))).alias("live"))
    return reach.pack_sweep(i)


@query(
    "q18_gc_report",
    f"""{_STORED}, g AS (SELECT s.id, s.id IN (SELECT id FROM live) AS ok, substr(s.id, 1, 2) AS pack FROM stored s),
    p AS (SELECT pack, count(*) AS n, count(*) FILTER (WHERE ok) AS k FROM g GROUP BY 1)
    SELECT sum(n)::BIGINT AS objects, sum(k)::BIGINT AS live, sum(n - k)::BIGINT AS newly_dead, count(*) FILTER (WHERE k = 0) AS packs_deleted, count(*) FILTER (WHERE k > 0 AND k * 2 < n) AS packs_repacked FROM p""",
)
def gc_report(spark: SparkSession, sf: str) -> DataFrame:
    stored, live = _live(spark, sf)
    index = stored.join(live.withColumn("live", F.lit(True)), "id", "left").select(F.substring("id", 1, 2).alias("pack"), F.lit(True).alias("is_data"), F.lit(1).cast("long").alias("len"), F.coalesce("live", F.lit(False)).alias("live"))
    p = reach.pack_sweep(index)
    return p.agg(F.sum("total").alias("objects"), F.sum("kept").alias("live"), F.sum(F.col("total") - F.col("kept")).alias("newly_dead"), F.count_if(F.col("action") == "delete").alias("packs_deleted"), F.count_if(F.col("action") == "repack").alias("packs_repacked"))


@query(
    "q19_fsck",
    f"""WITH w AS (SELECT {hashed("chunk", "text")} AS id, min(doc_id) AS d, min(text) AS t FROM documents GROUP BY 1)
    SELECT id, CASE WHEN d % 41 = 3 THEN 'missing' ELSE 'mismatch' END AS problem FROM w WHERE d % 41 = 3 OR d % 37 = 5""",
)
def fsck(spark: SparkSession, sf: str) -> DataFrame:
    w = table(spark, sf, "documents").groupBy(S.object_id("chunk", F.col("text")).alias("id")).agg(F.min("doc_id").alias("d"), F.min("text").alias("t"))
    stored = w.where("d % 41 <> 3").select("id", S.object_id("chunk", F.when(F.col("d") % 37 == 5, F.concat("t", F.lit("?"))).otherwise(F.col("t"))).alias("actual"))
    return reach.fsck(w.select("id"), stored)


@query(
    "q20_validity",
    f"""{V.with_entries("base")}, x AS (SELECT path, CASE WHEN size % 29 = 1 AND kind = 'file' THEN 'device' ELSE kind END AS kind, CASE WHEN size % 31 = 2 THEN 8192 ELSE mode END AS mode, CASE WHEN size % 37 = 3 THEN -1 ELSE size END AS size FROM base WHERE path <> '')
    SELECT path, 'kind' AS rule FROM x WHERE kind NOT IN ('file', 'dir', 'symlink') UNION ALL SELECT path, 'mode' FROM x WHERE mode > 4095 UNION ALL SELECT path, 'size' FROM x WHERE size < 0""",
)
def validity(spark: SparkSession, sf: str) -> DataFrame:
    e = V.entries(spark, sf, "base").where("path <> ''")
    bad = e.select("path", F.when((F.col("size") % 29 == 1) & (F.col("kind") == "file"), "device").otherwise(F.col("kind")).alias("kind"), F.when(F.col("size") % 31 == 2, 8192).otherwise(F.col("mode")).alias("mode"), F.when(F.col("size") % 37 == 3, -1).otherwise(F.col("size")).alias("size"), F.lit(None).cast("string").alias("target"), "file_id")
    return reach.invalid_entries(bad)


# ---------------------------------------------------------------- names


_HEX = "'^[0-9a-fA-F]{8,}$'"


@query(
    "q21_names",
    f"""WITH n AS (SELECT page_id, CASE page_id % 5 WHEN 0 THEN regexp_extract(url, '://([^/]*)', 1) WHEN 1 THEN substr(sha256(url), 1, 8) WHEN 2 THEN substr(sha256(url), 1, 7) WHEN 3 THEN '.' || page_id ELSE 'a..' || page_id END AS name FROM pages)
    SELECT page_id, name, regexp_full_match(name, '[A-Za-z0-9._-]{{1,100}}') AND NOT regexp_matches(name, '^[.-]') AND NOT contains(name, '..') AND NOT regexp_matches(name, {_HEX}) AS valid FROM n""",
)
def names(spark: SparkSession, sf: str) -> DataFrame:
    m, h = F.col("page_id") % 5, F.sha2("url", 256)
    name = F.when(m == 0, F.regexp_extract("url", "://([^/]*)", 1)).when(m == 1, F.substring(h, 1, 8)).when(m == 2, F.substring(h, 1, 7)).when(m == 3, F.concat(F.lit("."), "page_id")).otherwise(F.concat(F.lit("a.."), "page_id"))
    return table(spark, sf, "pages").select("page_id", name.alias("name")).withColumn("valid", S.valid_branch(F.col("name")))


@query(
    "q21_refspecs",
    """WITH s AS (SELECT page_id, CASE page_id % 4 WHEN 0 THEN 'snap/v' || page_id || ':' || regexp_extract(url, '://[^/]*/(.*)$', 1) WHEN 1 THEN substr(sha256(url), 1, 12) || ':a/b/' WHEN 2 THEN 'main:/abs' ELSE 'branch-' || page_id || ':' END AS spec FROM pages)
    SELECT page_id, CASE page_id % 4 WHEN 0 THEN 'snapshot' WHEN 1 THEN 'commit' WHEN 3 THEN 'branch' END AS kind,
      CASE page_id % 4 WHEN 0 THEN 'v' || page_id WHEN 1 THEN split_part(spec, ':', 1) WHEN 3 THEN 'branch-' || page_id END AS target,
      CASE page_id % 4 WHEN 0 THEN nullif(regexp_replace(substr(spec, strpos(spec, ':') + 1), '/+$', ''), '') WHEN 1 THEN 'a/b' END AS path FROM s""",
)
def refspecs(spark: SparkSession, sf: str) -> DataFrame:
    m = F.col("page_id") % 4
    spec = F.when(m == 0, F.concat(F.lit("snap/v"), "page_id", F.lit(":"), F.regexp_extract("url", "://[^/]*/(.*)$", 1))).when(m == 1, F.concat(F.substring(F.sha2("url", 256), 1, 12), F.lit(":a/b/"))).when(m == 2, "main:/abs").otherwise(F.concat(F.lit("branch-"), "page_id", F.lit(":")))
    p = table(spark, sf, "pages").select("page_id", S.parse_refspec(spec).alias("r"))
    return p.select("page_id", "r.kind", "r.target", "r.path")


@query(
    "q22_resolve_prefix",
    """WITH c AS (SELECT DISTINCT sha256(o_orderkey::VARCHAR) AS id FROM orders), p AS (SELECT DISTINCT substr(md5(o_orderkey::VARCHAR), 1, 1 + (o_orderkey % 4)::INTEGER) AS prefix FROM orders),
    m AS (SELECT prefix, count(id) AS n, min(id) AS one FROM p LEFT JOIN c ON starts_with(id, prefix) GROUP BY prefix)
    SELECT prefix, CASE WHEN n = 0 THEN 'unknown' WHEN n = 1 THEN 'found' ELSE 'ambiguous' END AS status, CASE WHEN n = 1 THEN one END AS "commit" FROM m""",
)
def resolve_prefix(spark: SparkSession, sf: str) -> DataFrame:
    o = table(spark, sf, "orders")
    prefixes = o.select(F.expr("substring(md5(cast(cast(o_orderkey as string) as binary)), 1, cast(1 + o_orderkey % 4 as int))").alias("prefix")).distinct()
    return history.resolve_prefixes(o.select(F.sha2(F.col("o_orderkey").cast("string"), 256).alias("commit")).distinct(), prefixes)


# ---------------------------------------------------------------- chunks, pages, packs, extents


@query("q23_chunk_roundtrip", "SELECT doc_id::VARCHAR AS path, strlen(text)::BIGINT AS size, sha256(text) AS sha, true AS bounded FROM documents WHERE text <> ''")
def chunk_roundtrip(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "documents").select(F.col("doc_id").cast("string").alias("path"), F.encode("text", "UTF-8").alias("data"))
    c = chunking.chunk(d, 64, 256, 1024)
    short = F.max(F.when(F.col("len") < 64, F.col("idx")))
    bounded = (F.max("len") <= 1024) & (F.coalesce(short, F.max("idx")) == F.max("idx"))
    return chunking.reassemble(c, bounded.alias("bounded")).select("path", F.octet_length("data").cast("long").alias("size"), F.sha2("data", 256).alias("sha"), "bounded")


@query("q24_rechunk_equiv", "SELECT doc_id::VARCHAR AS path, true AS equal, greatest(strlen(text), strlen(text) // 2 + 5)::BIGINT AS size FROM documents WHERE text <> ''")
def rechunk_equiv(spark: SparkSession, sf: str) -> DataFrame:
    size = F.octet_length("text")
    d = table(spark, sf, "documents").where("text <> ''").select(F.col("doc_id").cast("string").alias("path"), F.encode("text", "UTF-8").alias("base"), F.floor(size / 2).cast("long").alias("at"), F.encode(F.lit("PATCH"), "UTF-8").alias("patch"))
    return chunking.rechunk(d, 64, 256, 1024).select("path", "equal", "size")


@query(
    "q25_paginate",
    """WITH p AS (SELECT conv_id AS path, turn AS idx, strlen(text)::BIGINT AS len, (row_number() OVER w - 1) // 3 AS page, coalesce(sum(strlen(text)) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS "offset" FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn))
    SELECT path, idx, len, page, "offset", min("offset") OVER (PARTITION BY path, page) AS page_start, (sum(len) OVER (PARTITION BY path, page))::BIGINT AS page_len FROM p""",
)
def paginate(spark: SparkSession, sf: str) -> DataFrame:
    c = table(spark, sf, "conversations").select(F.col("conv_id").alias("path"), F.col("turn").alias("idx"), F.octet_length("text").cast("long").alias("len"))
    return chunking.paginate(c, 3)


@query(
    "q26_pack_binning",
    """WITH RECURSIVE o AS (SELECT lang AS lane, doc_id AS seq, strlen(text)::BIGINT AS len, row_number() OVER (PARTITION BY lang ORDER BY doc_id) AS i FROM documents),
    w AS (SELECT lane, seq, i, 0::BIGINT AS pack, CASE WHEN len >= 65536 THEN 1 ELSE 0 END::BIGINT AS next, CASE WHEN len >= 65536 THEN 0 ELSE len END::BIGINT AS held FROM o WHERE i = 1
      UNION ALL SELECT o.lane, o.seq, o.i, w.next, CASE WHEN w.held + o.len >= 65536 THEN w.next + 1 ELSE w.next END, CASE WHEN w.held + o.len >= 65536 THEN 0 ELSE w.held + o.len END FROM w JOIN o ON o.lane = w.lane AND o.i = w.i + 1)
    SELECT lane, seq, pack FROM w""",
)
def pack_binning(spark: SparkSession, sf: str) -> DataFrame:
    o = table(spark, sf, "documents").select(F.col("lang").alias("lane"), F.col("doc_id").alias("seq"), F.octet_length("text").cast("long").alias("len"))
    return chunking.fill_packs(o, 65536).select("lane", "seq", "pack")


def _places(spark: SparkSession, sf: str) -> DataFrame:
    """A pack index: each line item's quantity in bytes, one after the other, with a hole wherever a key leaves 0 by 7."""
    li = table(spark, sf, "lineitem").select(F.col("l_suppkey").alias("pack"), F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("n"), F.col("l_partkey").alias("p"), F.col("l_quantity").cast("long").alias("len"))
    g = li.groupBy("pack", "k", "n", "p").agg(F.max("len").alias("len"))
    w = Window.partitionBy("pack").orderBy("k", "n", "p")
    hole = F.sum(F.when(F.col("k") % 7 == 0, 5).otherwise(0)).over(w.rowsBetween(Window.unboundedPreceding, 0))
    return g.withColumn("offset", F.coalesce(F.sum("len").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) + hole).select("pack", "offset", "len")


_PLACES = """g AS (SELECT l_suppkey AS pack, l_orderkey AS k, l_linenumber AS n, l_partkey AS p, max(l_quantity::BIGINT) AS len FROM lineitem GROUP BY 1, 2, 3, 4),
    pl AS (SELECT pack, len, (coalesce(sum(len) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + sum(CASE WHEN k % 7 = 0 THEN 5 ELSE 0 END) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))::BIGINT AS "offset" FROM g WINDOW w AS (PARTITION BY pack ORDER BY k, n, p))"""


@query(
    "q27_coalesce_runs",
    f"""WITH {_PLACES}, f AS (SELECT *, CASE WHEN lag("offset" + len) OVER (PARTITION BY pack ORDER BY "offset", len) = "offset" THEN 0 ELSE 1 END AS new FROM pl),
    r AS (SELECT *, sum(new) OVER (PARTITION BY pack ORDER BY "offset", len ROWS UNBOUNDED PRECEDING) - 1 AS run FROM f)
    SELECT pack, run::BIGINT AS run, min("offset") AS start, max("offset" + len) AS stop, count(*) AS chunks FROM r GROUP BY 1, 2""",
)
def coalesce_runs(spark: SparkSession, sf: str) -> DataFrame:
    return chunking.runs(_places(spark, sf)).groupBy("pack", "run").agg(F.min("offset").alias("start"), F.max(F.col("offset") + F.col("len")).alias("stop"), F.count("*").alias("chunks"))


@query(
    "q27_coalesce_runs_capped",
    f"""WITH RECURSIVE {_PLACES}, o AS (SELECT *, row_number() OVER (PARTITION BY pack ORDER BY "offset", len) AS i FROM pl),
    w AS (SELECT pack, i, "offset", len, 0::BIGINT AS run, "offset" AS first FROM o WHERE i = 1 UNION ALL
      SELECT o.pack, o.i, o."offset", o.len, CASE WHEN o."offset" <> w."offset" + w.len OR o."offset" + o.len - w.first > 100 THEN w.run + 1 ELSE w.run END,
        CASE WHEN o."offset" <> w."offset" + w.len OR o."offset" + o.len - w.first > 100 THEN o."offset" ELSE w.first END FROM w JOIN o ON o.pack = w.pack AND o.i = w.i + 1)
    SELECT pack, run, min("offset") AS start, max("offset" + len) AS stop, count(*) AS chunks FROM w GROUP BY 1, 2""",
)
def coalesce_runs_capped(spark: SparkSession, sf: str) -> DataFrame:
    return chunking.runs(_places(spark, sf), 100).groupBy("pack", "run").agg(F.min("offset").alias("start"), F.max(F.col("offset") + F.col("len")).alias("stop"), F.count("*").alias("chunks"))


def _extents(spark: SparkSession, sf: str) -> DataFrame:
    start = F.col("l_partkey") * 40
    return table(spark, sf, "lineitem").select(F.col("l_suppkey").alias("file"), start.alias("start"), (start + F.col("l_quantity").cast("long")).alias("stop"))


_EXTENTS = "x AS (SELECT l_suppkey AS file, l_partkey * 40 AS start, l_partkey * 40 + l_quantity::BIGINT AS stop FROM lineitem)"


def _union_sql(source: str, out: str) -> str:
    return f"""{out}_n AS (SELECT *, CASE WHEN start <= max(stop) OVER (PARTITION BY file ORDER BY start, stop ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS new FROM {source} WHERE start < stop),
    {out}_i AS (SELECT *, sum(new) OVER (PARTITION BY file ORDER BY start, stop ROWS UNBOUNDED PRECEDING) AS island FROM {out}_n),
    {out} AS (SELECT file, min(start) AS start, max(stop) AS stop FROM {out}_i GROUP BY file, island)"""


@query("q28_extent_union", f"WITH {_EXTENTS}, {_union_sql('x', 'u')} SELECT file, start, stop FROM u")
def extent_union(spark: SparkSession, sf: str) -> DataFrame:
    return overlay.union_extents(_extents(spark, sf))


@query(
    "q28_regions",
    f"""WITH {_EXTENTS}, f AS (SELECT s_suppkey AS file, 40000 + s_suppkey * 7 AS size, 40000 + (s_suppkey % 3) * 700 AS base_size, 40000 + (s_suppkey % 5) * 100 AS base_visible FROM supplier),
    y AS (SELECT x.file, start, least(stop, size) AS stop FROM x JOIN f USING (file) UNION ALL SELECT file, least(base_visible, size), size FROM f WHERE base_visible < size OR size <> base_size), {_union_sql("y", "u")} SELECT file, start, stop FROM u""",
)
def regions(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("s_suppkey")
    f = table(spark, sf, "supplier").select(k.alias("file"), (40000 + k * 7).alias("size"), (40000 + k % 3 * 700).alias("base_size"), (40000 + k % 5 * 100).alias("base_visible"))
    return overlay.regions(_extents(spark, sf), f)


# ---------------------------------------------------------------- overlays, cache, streams


@query(
    "q29_overlay_listing",
    """SELECT lang || '/' || source AS dir, doc_id || '.txt' AS name, CASE WHEN doc_id % 5 = 0 THEN 'overlay' ELSE 'base' END AS side FROM documents WHERE (doc_id % 11 <> 0 AND doc_id % 4 <> 1) OR doc_id % 5 = 0""",
)
def overlay_listing(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "documents").select("doc_id", F.concat_ws("/", "lang", "source").alias("dir"), F.concat(F.col("doc_id").cast("string"), F.lit(".txt")).alias("name"))
    side = lambda s: d.withColumn("side", F.lit(s))
    return overlay.listing(side("base").where("doc_id % 11 <> 0").drop("doc_id"), d.where("doc_id % 4 = 1"), side("overlay").where("doc_id % 5 = 0").drop("doc_id"))


@query(
    "q29_overlay_apply",
    f"""{V.with_entries("base")} SELECT path, kind FROM base WHERE path <> 'en/src1' AND NOT starts_with(path, 'en/src1/') AND path <> 'de/src2' UNION ALL SELECT 'en/src1', 'file' UNION ALL SELECT 'de/src2', 'dir'""",
)
def overlay_apply(spark: SparkSession, sf: str) -> DataFrame:
    e = V.entries(spark, sf, "base").select("path", "kind")
    new = spark.range(1).select(F.explode(F.array(F.struct(F.lit("en/src1").alias("path"), F.lit("file").alias("kind")), F.struct(F.lit("de/src2").alias("path"), F.lit("dir").alias("kind")))).alias("x")).select("x.*")
    return overlay.apply(e, spark.range(1).select(F.lit("en/src1").alias("path")), new)


@query("q29_restore", f"{V.with_entries('ours', 'base')} SELECT path, content_id FROM ours WHERE NOT starts_with(path, 'en/src2/') AND path <> 'en/src2' UNION ALL SELECT path, content_id FROM base WHERE starts_with(path, 'en/src2/') OR path = 'en/src2'")
def restore(spark: SparkSession, sf: str) -> DataFrame:
    return overlay.restore(*_sides(spark, sf, "ours", "base"), "en/src2").select("path", "content_id")


@query(
    "q30_overlay_read",
    """WITH p AS (SELECT conv_id AS file, turn AS idx, strlen(text)::BIGINT AS len, coalesce(sum(strlen(text)) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start FROM conversations),
    q AS (SELECT DISTINCT conv_id AS file, r AS request, r * 150 + conv_id % 100 AS a, r * 150 + conv_id % 100 + 400 AS z FROM conversations, (SELECT unnest([0, 1, 2, 3]) AS r))
    SELECT file, request, idx, greatest(a - start, 0) AS skip, least(z - start, len) - greatest(a - start, 0) AS take FROM p JOIN q USING (file) WHERE start < z AND start + len > a""",
)
def overlay_read(spark: SparkSession, sf: str) -> DataFrame:
    c = table(spark, sf, "conversations").select(F.col("conv_id").alias("file"), F.col("turn").alias("idx"), F.octet_length("text").cast("long").alias("len"))
    before = F.sum("len").over(Window.partitionBy("file").orderBy("idx").rowsBetween(Window.unboundedPreceding, -1))
    r = c.select("file").distinct().withColumn("request", F.explode(F.array(*map(F.lit, range(4)))))
    q = r.select("file", "request", (F.col("request") * 150 + F.col("file") % 100).alias("offset"), F.lit(400).alias("len"))
    return overlay.read(c.withColumn("start", F.coalesce(before, F.lit(0))), q, 512)


@query(
    "q30_read_sources",
    f"""WITH {_EXTENTS}, f AS (SELECT s_suppkey AS file, 40000 + s_suppkey * 7 AS size, 30000 + (s_suppkey % 5) * 1000 AS base_visible FROM supplier),
    y AS (SELECT x.file, start, least(stop, size) AS stop FROM x JOIN f USING (file)), {_union_sql("y", "u")},
    m AS (SELECT file, start AS "at" FROM u UNION SELECT file, stop FROM u UNION SELECT file, 0 FROM f UNION SELECT file, size FROM f UNION SELECT file, least(base_visible, size) FROM f),
    c AS (SELECT file, "at" AS start, lead("at") OVER (PARTITION BY file ORDER BY "at") AS stop FROM m)
    SELECT c.file, c.start, c.stop, CASE WHEN EXISTS (SELECT 1 FROM u WHERE u.file = c.file AND u.start <= c.start AND u.stop > c.start) THEN 'overlay' WHEN c.start < f.base_visible THEN 'base' ELSE 'zero' END AS source
    FROM c JOIN f ON f.file = c.file WHERE c.stop IS NOT NULL""",
)
def read_sources(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("s_suppkey")
    f = table(spark, sf, "supplier").select(k.alias("file"), (40000 + k * 7).alias("size"), (30000 + k % 5 * 1000).alias("base_visible"))
    return overlay.sources(_extents(spark, sf), f)


@query(
    "q31_update_conflicts",
    f"""{V.with_entries("base", "ours", "theirs")},
    there AS (SELECT coalesce(b.path, t.path) AS path FROM base b FULL JOIN theirs t ON b.path = t.path WHERE NOT coalesce(b.kind = 'dir' AND t.kind = 'dir', false) AND (b.path IS NULL OR t.path IS NULL OR b.kind <> t.kind OR b.mode <> t.mode OR b.mtime_ns <> t.mtime_ns OR b.content_id <> t.content_id)),
    here AS (SELECT coalesce(b.path, t.path) AS path FROM base b FULL JOIN ours t ON b.path = t.path WHERE NOT coalesce(b.kind = 'dir' AND t.kind = 'dir', false) AND (b.path IS NULL OR t.path IS NULL OR b.mode <> t.mode OR b.mtime_ns <> t.mtime_ns OR b.content_id <> t.content_id)),
    gone AS (SELECT path FROM base WHERE path NOT IN (SELECT path FROM ours))
    SELECT path FROM there WHERE path IN (SELECT path FROM here) OR EXISTS (SELECT 1 FROM gone g WHERE there.path = g.path OR starts_with(there.path, g.path || '/'))""",
)
def update_conflicts(spark: SparkSession, sf: str) -> DataFrame:
    return diff.update_conflicts(*_sides(spark, sf, "base", "ours", "theirs"))


def _accesses(spark: SparkSession, sf: str) -> DataFrame:
    chunk = F.floor("value").cast("long")
    return table(spark, sf, "events").select((F.col("user_id") % 20).alias("cache"), chunk.alias("id"), (chunk % 50 * 64 + 100).alias("size"), _micros("ts").alias("at"))


_CACHE = "c AS (SELECT user_id % 20 AS cache, floor(value)::BIGINT AS id, max(floor(value)::BIGINT % 50 * 64 + 100) AS size, max(epoch_us(ts)) AS last_access FROM events GROUP BY 1, 2)"


@query(
    "q32_lru_evict",
    f"""WITH {_CACHE}, w AS (SELECT *, sum(size) OVER (PARTITION BY cache) - coalesce(sum(size) OVER (PARTITION BY cache ORDER BY last_access, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS left_over, row_number() OVER (PARTITION BY cache ORDER BY last_access DESC, id DESC) AS newest FROM c)
    SELECT cache, id, size, last_access FROM w WHERE left_over > 30000 AND newest > 1""",
)
def lru_evict(spark: SparkSession, sf: str) -> DataFrame:
    return cache.evict(cache.latest(_accesses(spark, sf)), 30000)


@query("q32_cache_stats", f"WITH {_CACHE} SELECT cache, sum(size)::BIGINT AS bytes, count(*) AS objects FROM c GROUP BY 1")
def cache_stats(spark: SparkSession, sf: str) -> DataFrame:
    return cache.stats(cache.latest(_accesses(spark, sf)))


@query(
    "q33_block_bitmap",
    """WITH r AS (SELECT l_partkey AS id, (l_quantity::BIGINT * 30000 + l_linenumber * 65536) AS start, (l_quantity::BIGINT * 30000 + l_linenumber * 65536 + l_partkey * 7) AS stop, 2000000 + l_partkey * 11 AS len FROM lineitem),
    b AS (SELECT id, len, range AS k FROM r, range(0, 64) WHERE start < least(stop, len) AND range BETWEEN start // 65536 AND (least(stop, len) - 1) // 65536),
    d AS (SELECT DISTINCT id, len, k FROM b)
    SELECT r.id, coalesce((SELECT sum(CASE WHEN k = 63 THEN -9223372036854775808 ELSE (1::BIGINT << k) END)::BIGINT FROM d WHERE d.id = r.id), 0)::BIGINT AS blocks,
      coalesce((SELECT sum(least(65536, len - k * 65536)) FROM d WHERE d.id = r.id), 0)::BIGINT AS present FROM (SELECT DISTINCT id FROM r) r""",
)
def block_bitmap(spark: SparkSession, sf: str) -> DataFrame:
    start = F.col("l_quantity").cast("long") * 30000 + F.col("l_linenumber").cast("long") * 65536
    r = table(spark, sf, "lineitem").select(F.col("l_partkey").alias("id"), start.alias("start"), (start + F.col("l_partkey") * 7).alias("stop"), (2000000 + F.col("l_partkey") * 11).alias("len"))
    return cache.coverage(r)


def _writes(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").select(F.col("user_id").alias("mount"), _micros("ts").alias("at"), F.col("event_id").alias("id"))


_HOUR = 3_600_000_000


@query(
    "q34_sessions",
    f"""WITH w AS (SELECT user_id AS mount, epoch_us(ts) AS "at", event_id AS id FROM events), n AS (SELECT *, CASE WHEN "at" - lag("at") OVER (PARTITION BY mount ORDER BY "at", id) < {6 * _HOUR} THEN 0 ELSE 1 END AS new FROM w),
    s AS (SELECT *, sum(new) OVER (PARTITION BY mount ORDER BY "at", id ROWS UNBOUNDED PRECEDING) - 1 AS session FROM n)
    SELECT mount, session::BIGINT AS session, min("at") AS first, max("at") AS last, count(*) AS writes FROM s GROUP BY 1, 2""",
)
def write_sessions(spark: SparkSession, sf: str) -> DataFrame:
    return sessions.sessions(_writes(spark, sf), 6 * _HOUR)


@query(
    "q34_commit_sessions",
    f"""WITH RECURSIVE w AS (SELECT user_id AS mount, epoch_us(ts) AS "at", row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM events),
    s AS (SELECT mount, "at", i, 0::BIGINT AS session, "at" AS first FROM w WHERE i = 1 UNION ALL
      SELECT w.mount, w."at", w.i, CASE WHEN w."at" - s."at" >= {6 * _HOUR} OR w."at" - s.first >= {24 * _HOUR} THEN s.session + 1 ELSE s.session END, CASE WHEN w."at" - s."at" >= {6 * _HOUR} OR w."at" - s.first >= {24 * _HOUR} THEN w."at" ELSE s.first END FROM s JOIN w ON w.mount = s.mount AND w.i = s.i + 1)
    SELECT mount, session, min("at") AS first, max("at") AS last, count(*) AS writes FROM s GROUP BY 1, 2""",
)
def commit_sessions(spark: SparkSession, sf: str) -> DataFrame:
    return sessions.commits(_writes(spark, sf), 6 * _HOUR, 24 * _HOUR)


@query(
    "q35_readahead",
    """WITH RECURSIVE r AS (SELECT user_id % 50 AS handle, event_id AS seq, CASE WHEN event_type = 'error' THEN 0 ELSE event_id % 8 * 300000 END AS "offset", (value * 1000)::BIGINT AS len, row_number() OVER (PARTITION BY user_id % 50 ORDER BY event_id) AS i FROM events),
    w AS (SELECT handle, seq, i, 0::BIGINT AS n, 0::BIGINT AS win, "offset" + len AS expected FROM r WHERE i = 1 UNION ALL
      SELECT r.handle, r.seq, r.i, CASE WHEN abs(r."offset" - w.expected) <= 1048576 THEN w.n + 1 ELSE 0 END,
        CASE WHEN abs(r."offset" - w.expected) <= 1048576 AND w.n + 1 >= 2 THEN (CASE WHEN w.win = 0 THEN 2097152 ELSE least(134217728, w.win * 2) END) ELSE 0 END, r."offset" + r.len FROM w JOIN r ON r.handle = w.handle AND r.i = w.i + 1)
    SELECT handle, seq, win AS "window" FROM w""",
)
def readahead(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events")
    r = e.select((F.col("user_id") % 50).alias("handle"), F.col("event_id").alias("seq"), F.when(F.col("event_type") == "error", 0).otherwise(F.col("event_id") % 8 * 300000).cast("long").alias("offset"), F.round(F.col("value") * 1000).cast("long").alias("len"))
    return sessions.readahead(r).select("handle", "seq", "window")


# ---------------------------------------------------------------- scalars, export, commands


@query(
    "q36_scalars",
    """WITH e AS (SELECT event_id, epoch_us(ts) * 1000 AS ns, user_id, (event_id * event_id * 977) % 1000000000000 AS n, (event_id % 4096)::INTEGER AS mode, event_type FROM events)
    SELECT event_id, strftime(make_timestamp(ns // 1000000000 * 1000000), '%Y-%m-%dT%H:%M:%SZ') AS stamp, ns // 1000000000 * 1000000000 AS back,
      CASE event_id % 3 WHEN 0 THEN 'd' WHEN 1 THEN 'l' ELSE '-' END || list_aggregate(list_transform(range(0, 9), lambda i: CASE WHEN (mode >> (8 - i)::INTEGER) & 1 = 1 THEN ['r', 'w', 'x'][i % 3 + 1] ELSE '-' END), 'string_agg', '') AS mode,
      'main.' || regexp_replace(lower(event_type || '_Host.' || user_id), '[^a-z0-9-]', '-', 'g') || CASE WHEN event_id % 3 > 1 THEN '-' || event_id % 3 ELSE '' END AS fork,
      CASE WHEN n < 1024 THEN n || ' B' WHEN n < 1048576 THEN (floor(n * 10 / 1024 + 0.5)::BIGINT // 10) || '.' || (floor(n * 10 / 1024 + 0.5)::BIGINT % 10) || ' KiB' WHEN n < 1073741824 THEN (floor(n * 10 / 1048576 + 0.5)::BIGINT // 10) || '.' || (floor(n * 10 / 1048576 + 0.5)::BIGINT % 10) || ' MiB'
        ELSE (floor(n * 10 / 1073741824 + 0.5)::BIGINT // 10) || '.' || (floor(n * 10 / 1073741824 + 0.5)::BIGINT % 10) || ' GiB' END AS size,
      CASE WHEN event_id < 60 THEN event_id || 's' WHEN event_id < 3600 THEN event_id // 60 || 'm' WHEN event_id < 86400 THEN event_id // 3600 || 'h' ELSE event_id // 86400 || 'd' END AS age,
      CASE event_id % 3 WHEN 0 THEN 'a.b.theirs.txt' WHEN 1 THEN '.hidden.theirs' ELSE 'plain.theirs-2' END AS copy,
      CASE event_id % 4 WHEN 0 THEN event_id WHEN 1 THEN event_id * 1024 WHEN 2 THEN event_id * 1048576 END AS parsed FROM e""",
)
def scalars(spark: SparkSession, sf: str) -> DataFrame:
    i = F.col("event_id")
    m = i % 3
    e = table(spark, sf, "events").select("event_id", "user_id", "event_type", (_micros("ts") * 1000).alias("ns"), (i * i * 977 % 1_000_000_000_000).alias("n"), (i % 4096).cast("int").alias("mode"))
    text = F.concat(i.cast("string"), F.element_at(F.array(*map(F.lit, ("", "K", "M", "x"))), (i % 4 + 1).cast("int")))
    return e.select(
        "event_id", S.rfc3339(F.col("ns")).alias("stamp"), S.parse_rfc3339(S.rfc3339(F.col("ns"))).alias("back"),
        S.mode_string(F.when(m == 0, "dir").when(m == 1, "symlink").otherwise("file"), F.col("mode")).alias("mode"),
        S.auto_fork(F.lit("main"), F.concat("event_type", F.lit("_Host."), F.col("user_id").cast("string")), m).alias("fork"),
        S.human_bytes(F.col("n")).alias("size"), S.duration(i).alias("age"),
        S.both_name(F.when(m == 0, "a.b.txt").when(m == 1, ".hidden").otherwise("plain"), F.lit("theirs"), m).alias("copy"), S.parse_size(text).alias("parsed"),
    )


@query("q36_listing", f"""{V.with_entries("base")} SELECT path, CASE WHEN kind = 'dir' THEN 'drwxr-xr-x' WHEN mode = 493 THEN '-rwxr-xr-x' ELSE '-rw-r--r--' END || ' ' || lpad(size::VARCHAR, 10, ' ') || ' ' || string_split(path, '/')[-1] || CASE WHEN kind = 'dir' THEN '/' ELSE '' END AS line FROM base WHERE path <> ''""")
def listing(spark: SparkSession, sf: str) -> DataFrame:
    e = V.entries(spark, sf, "base").where("path <> ''")
    return e.select("path", S.listing_line(F.col("kind"), F.col("mode"), F.col("size"), S.name(F.col("path")), F.lit(None).cast("string")).alias("line"))


@query("q37_cat", f"SELECT path, strlen(content)::BIGINT AS bytes, md5(content) AS md5 FROM ({V.FILES_SQL['ours']}) WHERE content <> ''")
def cat(spark: SparkSession, sf: str) -> DataFrame:
    """Files put together again from a chunk store that holds each chunk once."""
    f = V.files(spark, sf, "ours").select("path", F.encode("content", "UTF-8").alias("data"))
    pieces = chunking.chunk(f, 256, 1024, 4096)
    store = pieces.select("chunk_id", "data").dropDuplicates(["chunk_id"])
    out = chunking.reassemble(pieces.drop("data").join(store, "chunk_id"))
    return out.select("path", F.octet_length("data").cast("long").alias("bytes"), F.md5("data").alias("md5"))


def _commands(spark: SparkSession, sf: str) -> DataFrame:
    op = F.element_at(F.array(*map(F.lit, ("create", "commit", "commit", "snapshot", "reset", "delete", "commit"))), (F.col("o_orderkey") % 7 + 1).cast("int"))
    return table(spark, sf, "orders").select(F.col("o_orderkey").alias("seq"), F.concat(F.lit("b"), (F.col("o_custkey") % 400).cast("string")).alias("name"), op.alias("op"), F.sha2(F.col("o_orderkey").cast("string"), 256).alias("commit"))


@query(
    "q38_ref_replay",
    """WITH c AS (SELECT o_orderkey AS seq, 'b' || (o_custkey % 400) AS name, ['create', 'commit', 'commit', 'snapshot', 'reset', 'delete', 'commit'][(o_orderkey % 7 + 1)::INTEGER] AS op, sha256(o_orderkey::VARCHAR) AS "commit" FROM orders),
    g AS (SELECT name, max(seq) FILTER (WHERE op = 'delete') AS gone FROM c GROUP BY 1)
    SELECT g.name, arg_max(c."commit", c.seq) FILTER (WHERE c.op IN ('create', 'commit', 'reset')) AS head, count(*) FILTER (WHERE c.op IN ('create', 'commit', 'reset')) AS entries,
      count(*) FILTER (WHERE c.op IN ('create', 'commit', 'reset')) = 0 AND max(g.gone) IS NOT NULL AS deleted
    FROM g LEFT JOIN c ON c.name = g.name AND (g.gone IS NULL OR c.seq > g.gone) GROUP BY 1""",
)
def ref_replay(spark: SparkSession, sf: str) -> DataFrame:
    return refs.replay(_commands(spark, sf))


@query("q39_repository_merge", _merged_sql("ours").replace("SELECT o.path, o.kind, o.mode, o.content_id", "SELECT o.path, o.mode, o.content_id").replace("SELECT t.path, t.kind, t.mode, t.content_id", "SELECT t.path, t.mode, t.content_id").replace("WHERE r.path <> ''", "WHERE kind = 'file' AND r.path <> ''"))
def repository_merge(spark: SparkSession, sf: str) -> DataFrame:
    """Import, fork, two imports and a merge in a new repository; the files that the branch then has."""
    repo = Repository.init(spark, f"{shared_dir(spark)}/{spark.sparkContext.applicationId}/repo-{uuid.uuid4().hex[:12]}", chunker=(1024, 4096, 16384))
    data = lambda v: V.files(spark, sf, v).withColumn("data", F.encode("content", "UTF-8"))
    repo.import_files(data("base"), "main", 100)
    repo.change("fork", "main", "feature", 110)
    repo.import_files(data("ours"), "main", 120)
    repo.import_files(data("theirs"), "feature", 130)
    repo.merge("main", "feature", 140, resolve="ours")
    return repo.entries("main").where("kind = 'file'").select("path", "mode", "content_id")


# ---------------------------------------------------------------- edits, mounts, schedules

_AT = "lang || '/' || source || '/' || doc_id"
#: Requests of all kinds on paths that exist and that don't, the same expressions for both engines.
_REQUESTS = [
    "doc_id AS request",
    "CASE doc_id % 9 WHEN 0 THEN 'create' WHEN 1 THEN 'mkdir' WHEN 2 THEN 'symlink' WHEN 3 THEN 'unlink' WHEN 4 THEN 'rmdir' WHEN 5 THEN 'truncate' WHEN 6 THEN 'readlink' ELSE 'rename' END AS op",
    f"""CASE WHEN doc_id % 37 = 0 THEN lang || '/..' WHEN doc_id % 41 = 0 THEN lang || '/' || repeat('x', 300) WHEN doc_id % 29 = 0 THEN {_AT} || '.txt/below'
      WHEN doc_id % 5 = 1 THEN lang || '/' || source WHEN doc_id % 5 = 2 THEN lang || '/none/' || doc_id WHEN doc_id % 5 = 3 THEN {_AT} || '.new' ELSE {_AT} || '.txt' END AS path""",
    f"""CASE WHEN doc_id % 31 = 0 THEN '' WHEN doc_id % 4 = 0 THEN lang || '/' || source || '/' || (doc_id + 1) || '.txt' WHEN doc_id % 4 = 1 THEN lang || '/' || source
      WHEN doc_id % 4 = 2 THEN lang || '/moved' || doc_id ELSE lang || '/' || source || '/sub' || doc_id END AS "to" """,
    "doc_id % 3 = 0 AS no_replace",
]
_LINKED = f"SELECT path, kind FROM base UNION ALL SELECT {_AT} || '.txt', 'symlink' FROM documents WHERE doc_id % 33 = 0"


def _requests(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").selectExpr(*(x.replace('"', "`") for x in _REQUESTS))


def _linked(spark: SparkSession, sf: str) -> DataFrame:
    links = table(spark, sf, "documents").where("doc_id % 33 = 0").selectExpr(f"{_AT} || '.txt' AS path", "'symlink' AS kind")
    return V.entries(spark, sf, "base").select("path", "kind").unionByName(links)


_UP = "regexp_replace({0}, '(^|/)[^/]*$', '')"
_BAD = "CASE WHEN strlen(string_split({0}, '/')[-1]) > 255 THEN 'too_long' WHEN string_split({0}, '/')[-1] IN ('', '.', '..') THEN 'invalid' END"
_NO_DIR = "CASE WHEN {0} IS NULL THEN 'missing' WHEN {0} <> 'dir' THEN 'not_dir' END"


@query(
    "q40_edit_requests",
    f"""{V.with_entries("base")}, e AS ({_LINKED}), r AS (SELECT {", ".join(_REQUESTS)} FROM documents), held AS (SELECT DISTINCT {_UP.format("path")} AS path FROM e WHERE path <> ''),
    k AS (SELECT r.*, a.kind AS self, u.kind AS up, o.kind AS onto, v.kind AS over, r.path IN (SELECT path FROM held) AS self_full, r."to" IN (SELECT path FROM held) AS onto_full
      FROM r LEFT JOIN e a ON a.path = r.path LEFT JOIN e u ON u.path = {_UP.format("r.path")} LEFT JOIN e o ON o.path = r."to" LEFT JOIN e v ON v.path = {_UP.format('r."to"')})
    SELECT request, op, path, "to", no_replace, coalesce(CASE
      WHEN op IN ('create', 'mkdir', 'symlink') THEN coalesce(CASE WHEN op = 'symlink' AND "to" = '' THEN 'invalid' END, {_BAD.format("path")}, {_NO_DIR.format("up")}, CASE WHEN self IS NOT NULL THEN 'exists' END)
      WHEN op = 'rename' AND {_BAD.format('"to"')} IS NOT NULL THEN {_BAD.format('"to"')}
      WHEN self IS NULL THEN 'missing'
      WHEN op = 'unlink' AND self = 'dir' THEN 'is_dir'
      WHEN op = 'rmdir' AND self <> 'dir' THEN 'not_dir' WHEN op = 'rmdir' AND self_full THEN 'not_empty'
      WHEN op = 'truncate' AND self = 'dir' THEN 'is_dir' WHEN op = 'truncate' AND self = 'symlink' THEN 'invalid'
      WHEN op = 'readlink' AND self <> 'symlink' THEN 'invalid'
      WHEN op = 'rename' THEN coalesce({_NO_DIR.format("over")}, CASE WHEN "to" = path THEN 'ok' WHEN starts_with("to", path || '/') THEN 'invalid' WHEN onto IS NOT NULL AND no_replace THEN 'exists'
        WHEN self = 'dir' AND onto <> 'dir' THEN 'not_dir' WHEN self <> 'dir' AND onto = 'dir' THEN 'is_dir' WHEN onto = 'dir' AND onto_full THEN 'not_empty' END) END, 'ok') AS result FROM k""",
)
def edit_requests(spark: SparkSession, sf: str) -> DataFrame:
    return edits.judge(_linked(spark, sf), _requests(spark, sf))


@query(
    "q40_edit_rename",
    f"""{V.with_entries("base")} SELECT CASE WHEN path = 'en/src1' OR starts_with(path, 'en/src1/') THEN 'en/moved' || substr(path, 8) WHEN path = 'de/src2' OR starts_with(path, 'de/src2/') THEN 'fr/src2b' || substr(path, 8) ELSE path END AS path, kind, content_id FROM base""",
)
def edit_rename(spark: SparkSession, sf: str) -> DataFrame:
    moves = spark.createDataFrame([("en/src1", "en/moved"), ("de/src2", "fr/src2b")], "path string, to string")
    return edits.rename(V.entries(spark, sf, "base").select("path", "kind", "content_id"), moves)


@query("q40_edit_touched", """SELECT DISTINCT unnest(['', lang, lang || '/' || source, lang || '/' || source || '/' || doc_id || '.txt']) AS path FROM documents WHERE doc_id % 7 = 2""")
def edit_touched(spark: SparkSession, sf: str) -> DataFrame:
    return edits.touched(table(spark, sf, "documents").where("doc_id % 7 = 2").selectExpr(f"{_AT} || '.txt' AS path"))


@query(
    "q41_status",
    f"""{V.with_entries("base", "ours")}, changed AS (SELECT o.path FROM ours o LEFT JOIN base b ON b.path = o.path WHERE o.kind <> 'dir' AND (b.path IS NULL OR b.kind <> o.kind OR b.mode <> o.mode OR b.mtime_ns <> o.mtime_ns OR b.content_id <> o.content_id)),
    hidden AS (SELECT path FROM base WHERE path NOT IN (SELECT path FROM ours) AND {_UP.format("path")} IN (SELECT path FROM ours))
    SELECT (SELECT count(*) FROM changed) + (SELECT count(*) FROM hidden) AS dirty_files, (SELECT count(*) FROM orders WHERE o_orderkey % 50 = 0) AS unpushed, (SELECT min(o_orderkey)::BIGINT * 1000 FROM orders WHERE o_orderkey % 50 = 0) AS oldest_unpushed_ns""",
)
def mount_status(spark: SparkSession, sf: str) -> DataFrame:
    base, ours = _sides(spark, sf, "base", "ours")
    changed = ours.join(diff.changed_entries(base, ours), "path", "left_semi")
    pending = table(spark, sf, "orders").where("o_orderkey % 50 = 0").select((F.col("o_orderkey").cast("long") * 1000).alias("time_ns"))
    return edits.status(changed, edits.whiteouts(base, ours), pending)


@query(
    "q41_behind",
    """SELECT s_suppkey AS mount, CASE WHEN s_suppkey % 6 = 0 THEN false WHEN s_nationkey % 5 = 4 THEN true ELSE s_suppkey % 3 <> s_nationkey % 3 END AS behind FROM supplier""",
)
def mounts_behind(spark: SparkSession, sf: str) -> DataFrame:
    mounts = table(spark, sf, "supplier").selectExpr("s_suppkey AS mount", "CASE WHEN s_suppkey % 6 <> 0 THEN s_nationkey END AS branch", "s_suppkey % 3 AS seen")
    return edits.behind(mounts, table(spark, sf, "nation").where("n_nationkey % 5 <> 4").selectExpr("n_nationkey AS branch", "n_nationkey % 3 AS head"))


@query(
    "q33_block_covered",
    """WITH r AS (SELECT l_partkey AS id, (l_quantity::BIGINT * 30000 + l_linenumber * 65536) AS start, (l_quantity::BIGINT * 30000 + l_linenumber * 65536 + l_partkey * 7) AS stop, 2000000 + l_partkey * 11 AS len FROM lineitem),
    d AS (SELECT DISTINCT id, range AS k FROM r, range(0, 64) WHERE start < least(stop, len) AND range BETWEEN start // 65536 AND (least(stop, len) - 1) // 65536),
    a AS (SELECT l_orderkey * 10 + l_linenumber AS ask, l_partkey AS id, l_quantity::BIGINT * 30000 + l_linenumber * 65536 AS start, l_quantity::BIGINT * 30000 + l_linenumber * 65536 + (l_orderkey % 3) * 40000 AS stop FROM lineitem WHERE l_orderkey % 4 = 1),
    n AS (SELECT ask, id, start, range AS k FROM a, range(0, 64) WHERE start < stop AND range BETWEEN start // 65536 AND (least(stop, 2000000 + id * 11) - 1) // 65536)
    SELECT ask, id, (ask, id, start) NOT IN (SELECT (ask, id, start) FROM n WHERE (id, k) NOT IN (SELECT (id, k) FROM d)) AS hit FROM a""",
)
def block_covered(spark: SparkSession, sf: str) -> DataFrame:
    start = F.col("l_quantity").cast("long") * 30000 + F.col("l_linenumber").cast("long") * 65536
    asks = table(spark, sf, "lineitem").where("l_orderkey % 4 = 1").select(
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("ask"), F.col("l_partkey").alias("id"), start.alias("start"), (start + F.col("l_orderkey") % 3 * 40000).alias("stop"), (2000000 + F.col("l_partkey") * 11).alias("len")
    )
    return cache.covered(asks, block_bitmap(spark, sf))


@query("q31_conflict_message", f"""WITH c AS (SELECT * FROM ({ORACLES["q31_update_conflicts"]}) ORDER BY path LIMIT 6)
    SELECT (SELECT string_agg(path, ', ' ORDER BY path) FROM (SELECT path FROM c ORDER BY path LIMIT 5)) || CASE WHEN (SELECT count(*) FROM c) > 5 THEN ', ...' ELSE '' END AS shown""")
def conflict_message(spark: SparkSession, sf: str) -> DataFrame:
    return diff.message(update_conflicts(spark, sf))


@query("q36_synthetic_ids", """WITH h AS (SELECT doc_id, sha256((doc_id % 7) || '/' || doc_id || '.txt')[1:16] AS h FROM documents) SELECT doc_id, ('0x' || translate(h[1], '01234567', '89abcdef') || h[2:])::UBIGINT::VARCHAR AS ino FROM h""")
def synthetic_ids(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", S.synthetic_id(F.col("doc_id") % 7, F.concat(F.col("doc_id").cast("string"), F.lit(".txt"))).alias("ino"))


@query("q18_gc_due", "SELECT o_custkey AS repository, 800000000 - max(epoch(o_orderdate))::BIGINT > 86400 AS due FROM orders GROUP BY 1")
def gc_due(spark: SparkSession, sf: str) -> DataFrame:
    runs = table(spark, sf, "orders").select(F.col("o_custkey").alias("repository"), F.unix_timestamp(F.col("o_orderdate").cast("timestamp")).alias("finished"))
    return reach.gc_due(runs, 800_000_000)
