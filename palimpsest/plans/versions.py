"""Three versions of the document workspace, as tables and as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalars import OBJECT_TYPES, REPO_KEY
from ..operators import tree
from ..session import cut
from ..sources.files import workspace


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def files(spark: SparkSession, sf_dir: str, version: str) -> DataFrame:
    """files(path, content, mode, mtime_ns) of base, ours or theirs: edits, additions, deletions, modes, a directory that
    one side drops and one that the other side turns into a file."""
    d = workspace(table(spark, sf_dir, "documents"))
    i = F.col("doc_id")
    where, content, mode, mtime = i % 11 != 0, F.col("content"), F.col("mode"), F.col("mtime_ns")
    if version == "ours":
        where = ((i % 11 != 0) & (i % 7 != 3) | (i % 22 == 0)) & ~((F.col("lang") == "de") & (F.col("source") == "src3"))
        content = F.when(i % 5 == 1, F.concat("content", F.lit("!o"))).otherwise(content)
    if version == "theirs":
        where = ((i % 13 != 5) | (i % 11 == 0)) & ~((F.col("lang") == "es") & (F.col("source") == "src5"))
        content = F.when((i % 5 == 1) & (i % 2 == 0) | (i % 5 == 2), F.concat("content", F.lit("!t"))).otherwise(content)
        mode = F.when(i % 19 == 4, 0o755).otherwise(mode)
        mtime = mtime + F.when(i % 23 == 7, 1).otherwise(0)
    out = d.where(where).select("path", content.alias("content"), mode.alias("mode"), mtime.alias("mtime_ns"))
    if version == "theirs":
        flat = d.sparkSession.range(1).select(F.lit("es/src5").alias("path"), F.lit("flat").alias("content"), F.lit(0o644).alias("mode"), F.lit(7).cast("long").alias("mtime_ns"))
        out = out.unionByName(flat)
    return out


def entries(spark: SparkSession, sf_dir: str, version: str) -> DataFrame:
    """Entries of a version, with directories and the root, as a written table: what a commit stores."""
    return cut(tree.build(tree.file_entries(files(spark, sf_dir, version))), "entries")


def hashed(kind: str, sql: str) -> str:
    return f"sha256('{REPO_KEY}' || chr({OBJECT_TYPES[kind]}) || {sql})"


_FILE = "lang || '/' || source || '/' || doc_id || '.txt'"
_MODE = "CASE WHEN doc_id % 17 = 0 THEN 493 ELSE 420 END"
FILES_SQL = {
    "base": f"SELECT {_FILE} AS path, text AS content, {_MODE} AS mode, doc_id * 1000 AS mtime_ns FROM documents WHERE doc_id % 11 <> 0",
    "ours": f"""SELECT {_FILE} AS path, CASE WHEN doc_id % 5 = 1 THEN text || '!o' ELSE text END AS content, {_MODE} AS mode, doc_id * 1000 AS mtime_ns
        FROM documents WHERE (doc_id % 11 <> 0 AND doc_id % 7 <> 3 OR doc_id % 22 = 0) AND NOT (lang = 'de' AND source = 'src3')""",
    "theirs": f"""SELECT {_FILE} AS path, CASE WHEN doc_id % 5 = 1 AND doc_id % 2 = 0 OR doc_id % 5 = 2 THEN text || '!t' ELSE text END AS content,
          CASE WHEN doc_id % 19 = 4 THEN 493 ELSE {_MODE} END AS mode, doc_id * 1000 + CASE WHEN doc_id % 23 = 7 THEN 1 ELSE 0 END AS mtime_ns
        FROM documents WHERE (doc_id % 13 <> 5 OR doc_id % 11 = 0) AND NOT (lang = 'es' AND source = 'src5')
        UNION ALL SELECT 'es/src5', 'flat', 420, 7""",
}


def entries_sql(version: str, name: str) -> str:
    """CTEs that end in `name`(path, kind, mode, mtime_ns, size, content_id): directories level by level from below."""
    depth = "CASE WHEN path = '' THEN 0 ELSE len(string_split(path, '/')) END"
    enc = "string_split(path, '/')[-1] || '|' || kind || '|' || mode || '|' || mtime_ns || '|' || content_id"
    up = "regexp_replace(path, '(^|/)[^/]*$', '')"

    def dirs(source: str) -> str:
        parts = f"""SELECT {up} AS up, substr(md5(string_split(path, '/')[-1]), 1, {tree.BUCKET}) AS bucket, sha256(string_agg({enc}, chr(10) ORDER BY {enc})) AS part FROM {source} GROUP BY 1, 2"""
        return f"""SELECT up AS path, 'dir' AS kind, 493 AS mode, 0::BIGINT AS mtime_ns, 0::BIGINT AS size,
            {hashed("tree", "string_agg(bucket || ' ' || part, chr(10) ORDER BY bucket)")} AS content_id FROM ({parts}) GROUP BY up"""

    n = name
    return f"""{n}_f AS (SELECT path, 'file' AS kind, mode, mtime_ns::BIGINT AS mtime_ns, strlen(content)::BIGINT AS size, {hashed("chunk", "content")} AS content_id FROM ({FILES_SQL[version]})),
    {n}_3 AS (SELECT * FROM {n}_f WHERE {depth} = 3),
    {n}_2 AS (SELECT * FROM {n}_f WHERE {depth} = 2 UNION ALL {dirs(f"{n}_3")}),
    {n}_1 AS (SELECT * FROM {n}_f WHERE {depth} = 1 UNION ALL {dirs(f"{n}_2")}),
    {n} AS (SELECT * FROM {n}_3 UNION ALL SELECT * FROM {n}_2 UNION ALL SELECT * FROM {n}_1 UNION ALL {dirs(f"{n}_1")})"""


def with_entries(*versions: str) -> str:
    return "WITH RECURSIVE " + ",\n".join(entries_sql(v, v) for v in versions)


#: Rules as SQL predicates on joined sides.
def same_sql(a: str, b: str) -> str:
    return f"(({a}.path IS NULL AND {b}.path IS NULL) OR ({a}.path IS NOT NULL AND {b}.path IS NOT NULL AND {a}.kind = {b}.kind AND {a}.content_id = {b}.content_id AND {a}.mode = {b}.mode))"


def diff_sql(a: str, b: str) -> str:
    """A top-down walk: children of directories on both sides, by full outer join of their levels."""
    up = "regexp_replace(coalesce(x.path, y.path), '(^|/)[^/]*$', '')"
    return f"""SELECT coalesce(x.path, y.path) AS path, CASE WHEN x.path IS NULL THEN 'added' WHEN y.path IS NULL THEN 'removed' ELSE 'modified' END AS change
    FROM {a} x FULL JOIN {b} y ON x.path = y.path
    WHERE coalesce(x.path, y.path) <> '' AND NOT coalesce(x.kind = 'dir' AND y.kind = 'dir', false) AND NOT {same_sql("x", "y")}
      AND {up} IN (SELECT path FROM {a} WHERE kind = 'dir') AND {up} IN (SELECT path FROM {b} WHERE kind = 'dir')"""


def merge_sql() -> str:
    """CTEs (after base, ours, theirs) that end in ruled(path, how, spot, in_o, in_t): a walk from the root down. A path is
    visited only if everything above it recursed; what is decided there holds for all below."""
    o_dir, t_dir, b_dir = (f"coalesce({x}.kind = 'dir', false)" for x in "otb")
    paths = "SELECT path FROM base UNION SELECT path FROM ours UNION SELECT path FROM theirs"
    local = f"""local AS (SELECT p.path, CASE
      WHEN p.path <> '' AND ({same_sql("o", "t")} OR {same_sql("t", "b")}) THEN 'ours'
      WHEN p.path <> '' AND {same_sql("o", "b")} THEN 'take'
      WHEN {o_dir} AND {t_dir} AND (o.content_id = t.content_id OR {b_dir} AND b.content_id = t.content_id) THEN 'keep_dir_ours'
      WHEN {o_dir} AND {t_dir} AND {b_dir} AND b.content_id = o.content_id THEN 'dir_theirs'
      WHEN {o_dir} AND {t_dir} THEN 'recurse'
      WHEN o.path IS NULL THEN 'theirs_back' WHEN t.path IS NULL THEN 'ours' ELSE 'conflict' END AS decision,
      o.path IS NOT NULL AS in_o, t.path IS NOT NULL AS in_t
      FROM ({paths}) p LEFT JOIN base b ON b.path = p.path LEFT JOIN ours o ON o.path = p.path LEFT JOIN theirs t ON t.path = p.path)"""
    up = "regexp_replace(l.path, '(^|/)[^/]*$', '')"
    walk = f"""ruled AS (SELECT path, CASE WHEN decision <> 'recurse' THEN decision END AS how, CASE WHEN decision <> 'recurse' THEN path END AS spot, in_o, in_t FROM local WHERE path = ''
      UNION ALL
      SELECT l.path, CASE WHEN r.how IS NOT NULL THEN r.how WHEN l.decision <> 'recurse' THEN l.decision END,
        CASE WHEN r.how IS NOT NULL THEN r.spot WHEN l.decision <> 'recurse' THEN l.path END, l.in_o, l.in_t
      FROM ruled r JOIN local l ON l.path <> '' AND {up} = r.path)"""
    return f"{local}, {walk}"
