"""Folders and tables as file versions, and back."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def import_dir(spark: SparkSession, path: str) -> DataFrame:
    """files(path, content, mode, mtime_ns) of all regular files below a folder that Spark's readers reach.

    Spark's scan passes over empty files; they are found by listing, as the scan's own files are.
    """
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "content", "modificationTime")
    jvm = spark.sparkContext._jvm
    top = jvm.org.apache.hadoop.fs.Path(path)
    fs = top.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    found, empty = fs.listFiles(top, True), []
    while found.hasNext():
        f = found.next()
        if f.getLen() == 0:
            empty.append((f.getPath().toString(), bytearray(), f.getModificationTime()))
    if empty:
        none = spark.createDataFrame(empty, "path string, content binary, ms long")
        raw = raw.unionByName(none.select("path", "content", F.timestamp_millis("ms").alias("modificationTime")))
    root = "/".join(p for p in path.split("://")[-1].split("/") if p)
    inside = F.regexp_replace(F.col("path"), r"^[a-z0-9]+:/*", "")
    return raw.select(F.substr(inside, F.lit(len(root) + 2)).alias("path"), "content", F.lit(0o644).alias("mode"), (F.unix_micros("modificationTime") * 1000).alias("mtime_ns"))


def workspace(documents: DataFrame) -> DataFrame:
    """documents as a workspace: lang/source/doc_id.txt with the text as content."""
    path = F.concat_ws("/", "lang", "source", F.concat(F.col("doc_id").cast("string"), F.lit(".txt")))
    mode = F.when(F.col("doc_id") % 17 == 0, 0o755).otherwise(0o644)
    return documents.select("doc_id", "lang", "source", path.alias("path"), F.col("text").alias("content"), mode.alias("mode"), (F.col("doc_id") * 1000).alias("mtime_ns"))


def export_dir(files: DataFrame, folder: str) -> DataFrame:
    """Writes files(path, data, and mode and mtime_ns if there) below a local or mounted folder that all executors share,
    and gives (path, bytes) of what was written.

    A folder that holds anything is refused, as is a path that is absolute or has an empty, `.` or `..` segment: nothing is
    written outside the folder. Each task writes its own rows, a file under another name first.
    """
    import os

    from ..functions import scalars as S

    spark = files.sparkSession
    top = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder if "://" in folder else f"file://{folder}")
    fs = top.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if fs.exists(top) and len(fs.listStatus(top)):
        raise ValueError(f"{folder} is not empty")
    bad = files.where(~F.forall(F.split("path", "/"), S.valid_entry_name)).select("path").first()
    if bad:
        raise ValueError(f"not a path below a folder: {bad.path!r}")
    base = folder.removeprefix("file://")
    extra = [c for c in ("mode", "mtime_ns") if c in files.columns]

    def run(batches: Iterable) -> Iterator:
        import pyarrow as pa

        for b in batches:
            sizes = []
            for row in b.to_pylist():
                to = os.path.join(base, row["path"])
                os.makedirs(os.path.dirname(to), exist_ok=True)
                with open(f"{to}.part", "wb") as f:
                    f.write(row["data"] or b"")
                if row.get("mode") is not None:
                    os.chmod(f"{to}.part", row["mode"])
                if row.get("mtime_ns") is not None:
                    os.utime(f"{to}.part", ns=(row["mtime_ns"], row["mtime_ns"]))
                os.replace(f"{to}.part", to)
                sizes.append(len(row["data"] or b""))
            yield pa.record_batch([b.column(0), pa.array(sizes, pa.int64())], names=["path", "bytes"])

    return files.select("path", "data", *extra).mapInArrow(run, "path string, bytes long")
