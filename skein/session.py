"""Session settings and the shared work folder."""

from __future__ import annotations

import atexit
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def get_session(app: str = "skein", cpus: int | str = "*", **conf: str) -> SparkSession:
    """A local session with the settings that the operators are tested under."""
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir.

    Where it is unset, a local session (one process) gets a temporary folder;
    on a cluster that folder would be another one on every machine, so it
    raises.
    """
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="skein-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def scratch_dir(spark: SparkSession) -> str:
    """A new folder in the shared one, which `release` removes."""
    path = f"{shared_dir(spark)}/skein/{uuid.uuid4().hex}"
    _written.append((spark, path))
    return path


def materialize(df: DataFrame, *, partition_by: list[str] | None = None) -> DataFrame:
    """Write df once to the shared folder and read it back.

    Cuts the lineage with files that outlive any executor, and fixes
    whatever depends on the partitioning (spark_partition_id, sampling).
    """
    spark = df.sparkSession
    path = scratch_dir(spark)
    writer = df.write.option("compression", "zstd")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: Folders for intermediate tables that release has not yet removed.
_written: list[tuple[SparkSession, str]] = []


@atexit.register
def release() -> None:
    """Remove all intermediate tables written so far; whoever keeps a session for long calls it when results are stored."""
    while _written:
        _drop(*_written.pop())


def _drop(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)
    except Exception:  # the session has ended already
        pass


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def row_total(df: DataFrame) -> int:
    """Number of rows; a single number reaches the driver."""
    return df.count()
