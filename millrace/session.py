"""Session helpers shared by the queries, the bench and the tests."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_written: list[list[str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share (``spark.checkpoint.dir``).

    Only a local session without that setting, as in tests, gets a folder of its own: executors of a cluster would each
    write to a disk that the others don't see."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="millrace-"))
        found = spark.sparkContext.getCheckpointDir()
    return found.rstrip("/")


def stored_at(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """``stored``, with the table's path, for a caller that will ``remove`` it."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back.

    This cuts the lineage and, unlike a local checkpoint, survives a lost executor.
    """
    out, path = stored_at(df, name)
    if _written:
        _written[-1].append(path)
    return out


def remove(spark: SparkSession, *paths: str) -> None:
    """Delete tables that nothing reads any more."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    for path in paths:
        where = hadoop.Path(path)
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def listed(spark: SparkSession, path: str) -> list[str]:
    """The names in a folder, none where it doesn't exist."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return sorted(s.getPath().getName() for s in fs.listStatus(where)) if fs.exists(where) else []


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """What ``stored`` writes inside is deleted at the end; write what is to last by ``stored_at``."""
    _written.append([])
    try:
        yield
    finally:
        remove(spark, *_written.pop())


def qualified(spark: SparkSession, path: str) -> str:
    """``path`` with the scheme of the file system that Spark takes it to be on."""
    if "://" in path or path.startswith("file:"):
        return path
    mark = f"mark-{uuid.uuid4().hex}"
    spark.range(1).coalesce(1).write.parquet(f"{path}/{mark}")
    return spark.read.parquet(f"{path}/{mark}").inputFiles()[0].split(f"/{mark}/")[0]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
