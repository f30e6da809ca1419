"""Shared-folder staging, hashing and row-shape helpers on the Spark side."""

from __future__ import annotations

import contextlib
import uuid
import weakref

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.files import shared_folder

def folder(spark: SparkSession) -> str:
    """The folder that driver and executors share."""
    return shared_folder(spark)


class Stage:
    """Tables written to the shared folder to cut lineage.

    A lost executor costs a reread, not a recomputation.  ``drop`` frees a table
    early; the rest goes when the session ends.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{folder(spark)}/lodegraph-{name}-{uuid.uuid4().hex[:12]}"
        self.count = 0
        weakref.finalize(spark, _remove, spark, self.root).atexit = True

    def write(self, frame: DataFrame, *sort: str, rows: int = 0) -> DataFrame:
        """Write as Parquet (zstd), so many rows a file if given, and read again."""
        self.count += 1
        path = f"{self.root}/{self.count}"
        with shuffles_freed(self.spark):
            frame.write.option("compression", "zstd").option("maxRecordsPerFile", rows).parquet(path)
        back = self.spark.read.schema(frame.schema).parquet(path)
        back._lodegraph_path = path
        return back

    def drop(self, frame: DataFrame) -> None:
        path = getattr(frame, "_lodegraph_path", None)
        if path:
            _remove(self.spark, path)


@contextlib.contextmanager
def shuffles_freed(spark: SparkSession):
    """Shuffles of what is written within go with the end of the write, else when
    the driver happens to collect its garbage."""
    before = spark.conf.get(_FREED, None)
    spark.conf.set(_FREED, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(_FREED)
        else:
            spark.conf.set(_FREED, before)


_FREED = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def _remove(spark: SparkSession, path: str) -> None:
    with contextlib.suppress(Exception):
        jvm = spark._jvm
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def remainder(column: str, modulus: int) -> Column:
    """crc32 of the id as text, modulo; a null id counts as the text ''."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")) % modulus


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


#: What a batch between the JVM and Python holds at most; texts are large, and
#: both sides hold a batch or two a core.  A session's own settings stand.
BATCH = {"spark.sql.execution.arrow.maxRecordsPerBatch": "2000", "spark.sql.execution.arrow.maxBytesPerBatch": str(8 << 20)}


def small_batches(spark: SparkSession) -> None:
    given = spark.sparkContext.getConf()
    for key, value in BATCH.items():
        if not given.contains(key):
            spark.conf.set(key, value)


def pick(frame: DataFrame, **names: str) -> DataFrame:
    """Only the named columns under our own names, so others can't clash."""
    small_batches(frame.sparkSession)
    return frame.select(*[F.col(f"`{old}`").alias(new) for new, old in names.items()])


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def ship(spark: SparkSession, value):
    """A broadcast variable; callers bound the size of what they ship."""
    return spark.sparkContext.broadcast(value)
