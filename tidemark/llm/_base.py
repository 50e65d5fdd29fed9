"""Shared folders, materialisation and small column helpers of the corpus operators."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager, nullcontext

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_own: dict[str, str] = {}

#: Rows of narrow keys (about 16 bytes of data each) that are broadcast at most; more are joined by a shuffle.
BROADCAST_KEYS = 1_000_000


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    A local master (tests) gets a folder of its own if it is unset; a cluster must set it.
    """
    set_by_cluster = spark.conf.get("spark.checkpoint.dir", None)
    if set_by_cluster:
        return set_by_cluster.rstrip("/")
    master = spark.sparkContext.master
    if master != "local" and not master.startswith("local["):
        raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
    app = spark.sparkContext.applicationId
    if app not in _own:
        _own[app] = "file://" + tempfile.mkdtemp(prefix="tidemark-")
        spark.sparkContext.setCheckpointDir(_own[app])
    return _own[app]


def _app_dir(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/tidemark/{spark.sparkContext.applicationId}"


def new_path(spark: SparkSession, name: str) -> str:
    return f"{_app_dir(spark)}/{uuid.uuid4().hex}/{name}"


def remove(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def clear(spark: SparkSession) -> None:
    """Remove every table and store that this application wrote; results that still read one must be saved before."""
    remove(spark, _app_dir(spark))


@contextmanager
def _conf(spark: SparkSession, key: str, value: str) -> Iterator[None]:
    """A session setting for the length of a block."""
    before = spark.conf.get(key, None)
    spark.conf.set(key, value)
    try:
        yield
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


def write(df: DataFrame, path: str, batch_bytes: str | None = None) -> None:
    """Write ``df`` as Parquet; its shuffle files go as soon as it is written, as nothing reads them again.

    ``batch_bytes`` bounds a batch of rows for a Python worker, where the default of 10,000 rows is too much at once.
    """
    spark = df.sparkSession
    with _conf(spark, "spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true"):
        with _conf(spark, "spark.sql.execution.arrow.maxBytesPerBatch", batch_bytes) if batch_bytes else nullcontext():
            df.write.option("compression", "zstd").parquet(path)


def materialise(df: DataFrame, name: str, batch_bytes: str | None = None) -> DataFrame:
    """Write ``df`` once to the shared folder and return a DataFrame that reads it: the lineage ends there and lost executors cost nothing."""
    path = new_path(df.sparkSession, name)
    write(df, path, batch_bytes)
    return df.sparkSession.read.schema(df.schema).parquet(path)


class Scratch:
    """Tables of one operator that nothing reads once its result is written."""

    def __init__(self, spark: SparkSession, batch_bytes: str | None = None):
        self.spark, self.batch_bytes, self.paths = spark, batch_bytes, []

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        path = new_path(self.spark, name)
        write(df, path, self.batch_bytes)
        self.paths.append(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def clear(self) -> None:
        while self.paths:
            remove(self.spark, self.paths.pop())


def sized(keys: DataFrame, most: int = BROADCAST_KEYS) -> DataFrame:
    """``keys`` (a written table of narrow rows) marked for a broadcast if it has ``most`` rows at most, else for a sort-merge join."""
    return F.broadcast(keys) if keys.count() <= most else keys.hint("merge")


def text_hash(name: str = "text") -> Column:
    """Tells the texts of one id apart; null counts as empty."""
    return F.xxhash64(text_or_empty(name))


def without_rows(docs: DataFrame, gone: DataFrame) -> DataFrame:
    """``docs`` without the rows whose doc_id and :func:`text_hash` are in ``gone`` (doc_id, text_hash; a written table); ids compare null-safe.

    The texts are not shuffled as long as ``gone`` can be broadcast.
    """
    rows = docs.select(F.struct("*").alias("row"), F.col("doc_id").alias("_id"), text_hash().alias("_hash"))
    gone = sized(gone.select(F.col("doc_id").alias("_gone_id"), F.col("text_hash").alias("_gone_hash")))
    left = rows.join(gone, F.col("_id").eqNullSafe(F.col("_gone_id")) & (F.col("_hash") == F.col("_gone_hash")), "left_anti")
    return unpacked(left, docs.columns)


def unpacked(rows: DataFrame, columns: list[str]) -> DataFrame:
    """The columns of the struct ``row``."""
    return rows.select(*[F.col(f"row.`{c}`").alias(c) for c in columns])


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def in_fold(doc_id: Column, mod: int, remainder: int) -> Column:
    """Whether crc32 of the id's decimal text leaves ``remainder``; false for a null id."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % F.lit(mod) == F.lit(remainder), F.lit(False))
