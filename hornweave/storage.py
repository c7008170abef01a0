"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

#: Attribute of a DataFrame of written(): its folder.
_PATH = "_written_to"
#: Setting under which Spark deletes the shuffle files of a query as soon as it has ended.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Tables written inside each open temporary().
_OPEN: list[list[DataFrame]] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``; one is set here only where that is unset and all runs in one process, as in tests."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not (spark.sparkContext.master or "").startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = "/tmp/checkpoints/hornweave"
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def application_dir(spark: SparkSession) -> str:
    """Where this application's tables go."""
    return f"{shared_dir(spark)}/hornweave-{spark.sparkContext.applicationId}"


@contextmanager
def _shuffles_deleted(spark: SparkSession) -> Iterator[None]:
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.unset(_CLEANUP) if before is None else spark.conf.set(_CLEANUP, before)


def written(df: DataFrame, name: str, partition_by: tuple[str, ...] = ()) -> DataFrame:
    """Cuts the lineage: writes ``df`` as Parquet into the shared folder and reads it back. Shuffle files of the way there are deleted."""
    spark = df.sparkSession
    path = f"{application_dir(spark)}/{re.sub(r'[^a-z0-9_]', '_', name)}-{uuid.uuid4().hex}"
    writer = df.write.mode("error")
    with _shuffles_deleted(spark):
        (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)
    found = spark.read.schema(df.schema).parquet(path)
    setattr(found, _PATH, path)
    if _OPEN:
        _OPEN[-1].append(found)
    return found


def put_file(spark: SparkSession, name: str, data: bytes) -> str:
    """Writes a small file into the shared folder; its path."""
    path = f"{application_dir(spark)}/{name}"
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    out = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(at)
    try:
        out.write(bytearray(data))
    finally:
        out.close()
    return path


def _delete(spark: SparkSession, path: str) -> None:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def discard(*tables: DataFrame) -> None:
    """Deletes tables of written() that nothing will read any more; what was derived from them must have been written itself."""
    for table in tables:
        path = getattr(table, _PATH, None)
        if path:
            _delete(table.sparkSession, path)


@contextmanager
def temporary() -> Iterator[None]:
    """Tables written inside are deleted at its end; what is read later must not be derived from them."""
    _OPEN.append([])
    try:
        yield
    finally:
        discard(*_OPEN.pop())


def clean(spark: SparkSession) -> None:
    """Deletes all tables this application has written; results that read them must have been saved before."""
    _delete(spark, application_dir(spark))
