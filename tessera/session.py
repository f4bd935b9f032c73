"""Session construction for local runs; on a cluster the submitted session is used as it is."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(cpus: str | int = "*", memory: str = "8g", partitions: int = 8) -> SparkSession:
    """A local session with the settings that the tests and the bench share."""
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("tessera")
        .config("spark.driver.memory", os.environ.get("TESSERA_DRIVER_MEMORY", memory))
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


_scratch: dict[str, str] = {}


def scratch_path(spark: SparkSession, tag: str) -> str:
    """A new path in the folder that driver and executors share: spark.checkpoint.dir, or in local mode without that
    setting a temporary folder."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        base = _scratch.setdefault(spark.sparkContext.applicationId, "file://" + tempfile.mkdtemp(prefix="tessera-"))
    path = f"{base.rstrip('/')}/{tag}-{uuid.uuid4().hex}"
    if path.startswith(("/", "file:")):
        atexit.register(shutil.rmtree, path.removeprefix("file://"), ignore_errors=True)
    return path


#: Files of the shuffles behind a write go when it has ended.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def write(df: DataFrame, path: str, *partition_by: str) -> None:
    """Writes df, and the files of the shuffles behind it go."""
    spark = df.sparkSession
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.partitionBy(*partition_by).parquet(path)
    finally:
        spark.conf.unset(_CLEANUP) if before is None else spark.conf.set(_CLEANUP, before)


def stored(df: DataFrame, tag: str) -> tuple[DataFrame, str]:
    """df written to a scratch path and read back, and that path. Plans over it begin at the files, while those over
    persisted frames hold the plan of each again wherever it is read."""
    spark = df.sparkSession
    path = scratch_path(spark, tag)
    write(df, path)
    return spark.read.schema(df.schema).parquet(path), path


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a folder by the file system that it is on."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
