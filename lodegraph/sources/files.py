"""Small files and folders through Hadoop's file systems, so that any store works."""

from __future__ import annotations

import tempfile

from pyspark.sql import SparkSession

from ..errors import StorageError


class Files:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        jvm = spark._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark._jsc.hadoopConfiguration())

    def at(self, name: str) -> str:
        return f"{self.root}/{name}"

    def exists(self, name: str) -> bool:
        return self._fs.exists(self._path(self.at(name)))

    def read(self, name: str) -> str:
        stream = self._fs.open(self._path(self.at(name)))
        try:
            return bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()

    def write(self, name: str, text: str) -> None:
        """A new file, whole or not at all: under another name first, then renamed.

        A name is written once; what is there already is never replaced."""
        target, part = self._path(self.at(name)), self._path(self.at(f"{name}.part"))
        if self._fs.exists(target):
            raise OSError(f"{name} exists already")
        stream = self._fs.create(part, True)
        try:
            stream.write(bytearray(text.encode()))
        finally:
            stream.close()
        if not self._fs.rename(part, target):
            raise OSError(f"cannot rename {part.toString()}")

    def size(self) -> int:
        """Bytes of the file, or of all files below the folder or pattern."""
        found = self._fs.globStatus(self._path(self.root)) or []
        return sum(self._fs.getContentSummary(s.getPath()).getLength() for s in found)

    def names(self, folder: str) -> list[str]:
        where = self._path(self.at(folder))
        return sorted(s.getPath().getName() for s in self._fs.listStatus(where)) if self._fs.exists(where) else []

    def delete(self, name: str) -> None:
        self._fs.delete(self._path(self.at(name)), True)


def shared_folder(spark: SparkSession) -> str:
    """A folder that driver and executors share: the session's checkpoint folder,
    or, where both are one machine, its temporary folder."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise StorageError("on a cluster spark.checkpoint.dir must name a folder that all executors share")
    return f"file://{tempfile.gettempdir()}"
