"""Shared plumbing: durable intermediates, lineage cuts and the word rule of the contracts."""

from __future__ import annotations

import atexit
import contextlib
import shutil
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

#: A word is a maximal run of anything but ASCII blanks (space, tab, line feed, vertical tab, form feed, carriage return).
WORD = r"[^\x20\x09-\x0D]+"

_local_dirs: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir of the session.

    Only a session that has no such setting (tests in one process) gets a folder of its own."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        key = spark.sparkContext.applicationId
        if key not in _local_dirs:
            if not spark.sparkContext.master.startswith("local["):
                raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
            _local_dirs[key] = "file://" + tempfile.mkdtemp(prefix="tessera-")
        path = _local_dirs[key]
    return path.rstrip("/")


_written: set[str] = set()


def new_path(spark: SparkSession, tag: str) -> str:
    """A path in the shared folder that nothing has used; what is left there goes when the driver ends."""
    path = f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"
    _written.add(path)
    return path


@atexit.register
def _clean() -> None:
    spark = SparkSession.getActiveSession()
    for path in list(_written):
        with contextlib.suppress(Exception):
            if spark is not None and spark.sparkContext._jsc is not None:
                remove(spark, path)
            elif path.startswith(("/", "file:")):
                shutil.rmtree(path.removeprefix("file://"), ignore_errors=True)


#: Arrow batches of texts stay small: several copies of one are alive at a time, outside the heap and in Python.
WHILE_WRITING = {
    "spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true",
    "spark.sql.execution.arrow.maxBytesPerBatch": "8m",
    "spark.sql.execution.arrow.maxRecordsPerBatch": "4000",
}


@contextlib.contextmanager
def settings(spark: SparkSession, values: dict[str, str]):
    """Settings of the session that hold inside the block; a setting that Spark refuses is left as it is."""
    before = {k: spark.conf.get(k, None) for k in values}
    for k, v in values.items():
        with contextlib.suppress(Exception):
            spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            with contextlib.suppress(Exception):
                spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def durable(df: DataFrame, tag: str, *partition_by: str) -> DataFrame:
    """Writes df to the shared folder and reads it back: cuts the lineage, survives lost executors.

    The shuffle files behind it are of no more use, so Spark may drop them as soon as the write ends."""
    spark = df.sparkSession
    path = new_path(spark, tag)
    with settings(spark, WHILE_WRITING):
        df.write.option("compression", "zstd").partitionBy(*partition_by).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._durable_path = path
    return out


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a folder by the file system that it is on."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
    _written.discard(path)


def discard(*frames: DataFrame) -> None:
    """Deletes what durable() wrote for frames that nothing will read again."""
    for df in frames:
        remove(df.sparkSession, df._durable_path)


def fresh(name: str, taken: list[str]) -> str:
    """name, with underscores behind it until no column has it."""
    low = {c.lower() for c in taken}
    while name.lower() in low:
        name += "_"
    return name


def n_words(text: Column) -> Column:
    """Number of words of a text as a long; null counts as empty."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
