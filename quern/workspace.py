"""Written tables that cut lineage, in the folder all executors share."""

from __future__ import annotations

import threading
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
LOCAL_FALLBACK = "/tmp/checkpoints/quern"
_LOCK = threading.Lock()
_WRITING: dict[int, int] = {}
_BEFORE: dict[int, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir of the session. Only a local master may go without it: there one machine is the cluster."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if spark.sparkContext.master.startswith("local[") or spark.sparkContext.master == "local":
        return LOCAL_FALLBACK
    raise ValueError("spark.checkpoint.dir must name a folder that all executors share")


def fresh_path(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"


@contextmanager
def _own_shuffles_removed(spark: SparkSession) -> Iterator[None]:
    """Queries that end meanwhile remove their own shuffle files. Threads of one session share the setting: the first turns it on, the last back."""
    with _LOCK:
        if not _WRITING.get(id(spark)):
            _BEFORE[id(spark)] = spark.conf.get(CLEANUP, "false")
            spark.conf.set(CLEANUP, "true")
        _WRITING[id(spark)] = _WRITING.get(id(spark), 0) + 1
    try:
        yield
    finally:
        with _LOCK:
            _WRITING[id(spark)] -= 1
            if not _WRITING[id(spark)]:
                spark.conf.set(CLEANUP, _BEFORE[id(spark)])


def materialize(df: DataFrame, label: str, path: str | None = None) -> DataFrame:
    """Write df as Parquet under the shared folder, or to ``path``, and read it again: computed once, and safe when executors are lost.

    Shuffle files of the write are removed when it is done: nothing reads them again. discard() removes the table itself.
    """
    spark = df.sparkSession
    path = path or fresh_path(spark, label)
    with _own_shuffles_removed(spark):
        df.write.parquet(path)
    table = spark.read.schema(df.schema).parquet(path)
    table.written_at = path
    return table


def discard(*tables: DataFrame) -> None:
    """Delete tables of materialize() that no one reads any more: what was computed from them must itself be written."""
    for table in tables:
        spark = table.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(table.written_at)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
