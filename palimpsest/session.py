"""Sessions, and sending this package to the executors."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_SENT: set[str] = set()


def session(cores: str = "*", partitions: int = 8, checkpoints: str | None = None) -> SparkSession:
    """A local session with the settings that tests and the benchmark use."""
    builder = SparkSession.builder.config("spark.checkpoint.dir", checkpoints) if checkpoints else SparkSession.builder
    return (
        builder.master(f"local[{cores}]")
        .config("spark.sql.shuffle.partitions", partitions)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; only a local session may go without the setting."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if found:
        return found
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return "/tmp/checkpoints"


def cut(df: DataFrame, name: str = "t") -> DataFrame:
    """Writes df to the shared folder and reads it again: lineage ends there, and a lost executor loses nothing."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex[:12]}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def ship(spark: SparkSession) -> None:
    """Makes the package importable in the executors' Python, once per application."""
    app = spark.sparkContext.applicationId
    if app in _SENT:
        return
    top = Path(__file__).resolve().parent
    path = Path(tempfile.mkdtemp()) / f"{top.name}.zip"
    with zipfile.ZipFile(path, "w") as z:
        for p in sorted(top.rglob("*.py")):
            z.write(p, p.relative_to(top.parent))
    spark.sparkContext.addPyFile(str(path))
    _SENT.add(app)
