"""Session settings the jobs rely on, and the shared folder for intermediate tables."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


_shipped: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Send this package to the Python workers, once per application.

    Needed where it is not installed on the executors. Spark itself copies the archive from the
    driver to them; nothing else is read from the driver's folder.
    """
    sc = spark.sparkContext
    if sc.applicationId in _shipped:
        return
    folder = Path(__file__).parent
    archive = Path(tempfile.mkdtemp(prefix="run-")) / "buildlark.zip"
    with zipfile.ZipFile(archive, "w") as z:
        for source in sorted(folder.rglob("*.py")):
            z.write(source, source.relative_to(folder.parent))
    sc.addPyFile(str(archive))
    _shipped.add(sc.applicationId)


def build_session(app: str = "buildlark", master: str | None = None, **conf) -> SparkSession:
    """A session with the settings every job here assumes (UTC, AQE with skew handling)."""
    b = (
        SparkSession.builder.appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
    )
    if master:
        b = b.master(master)
    for key, value in conf.items():
        b = b.config(key, value)
    spark = b.getOrCreate()
    ship_package(spark)
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors see, as named by ``spark.checkpoint.dir``.

    A private folder is made only on a local master where the setting is missing (tests);
    on a cluster a missing setting is an error, because a machine-local path would be lost
    with its executor.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    current = spark.sparkContext.getCheckpointDir()
    if current:
        return current.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder shared by all executors")
    made = tempfile.mkdtemp(prefix="run-", dir="/tmp")
    spark.sparkContext.setCheckpointDir(made)
    return made


def new_table_path(spark: SparkSession, label: str) -> str:
    """A fresh path below the shared folder; never reused, so a retry cannot mix two runs."""
    return f"{shared_dir(spark)}/buildlark-{label}-{uuid.uuid4().hex}"


def settle(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts lineage, survives lost executors."""
    path = new_table_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
