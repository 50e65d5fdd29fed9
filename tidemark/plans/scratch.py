"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_own: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; a local master gets a folder of its own if that is unset, a cluster has to set it."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    master = spark.sparkContext.master
    if master != "local" and not master.startswith("local["):
        raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
    app = spark.sparkContext.applicationId
    if app not in _own:
        _own[app] = "file://" + tempfile.mkdtemp(prefix="tidemark-")
    return _own[app]


def remove(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


@contextmanager
def splits_of(spark: SparkSession, most: int) -> Iterator[None]:
    """A task of a scan reads ``most`` bytes of files at most for the length of a block, or what the session asks for if that is less."""
    key = "spark.sql.files.maxPartitionBytes"
    before = spark.conf.get(key, None)
    spark.conf.set(key, str(min(most, spark._jsparkSession.sessionState().conf().filesMaxPartitionBytes())))
    try:
        yield
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


class Scratch:
    """Tables below one folder of their own, by default in the shared one."""

    def __init__(self, spark: SparkSession, folder: str | None = None):
        self.spark, self.folder = spark, folder or f"{shared_dir(spark)}/scratch/{uuid.uuid4().hex}"

    def keep(self, df: DataFrame) -> DataFrame:
        """``df``, written once and read back."""
        path = f"{self.folder}/{uuid.uuid4().hex}"
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def clear(self) -> None:
        remove(self.spark, self.folder)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[Scratch]:
    """Tables that are gone after the block."""
    own = Scratch(spark)
    try:
        yield own
    finally:
        own.clear()
