"""Stores with transactions: a store is a folder of versions, and a commit makes one more visible in one step."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


class Conflict(RuntimeError):
    """Another transaction committed first."""


class Versions:
    """Versions v1, v2, ... below path, parquet each; the last one is the store. What is written and not committed lies in folders
    of other names that no reader sees. Folders are renamed, which file systems do in one step; object stores without that need
    a table format of their own."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self._jvm, self._conf = spark._jvm, spark._jsc.hadoopConfiguration()
        self._fs = self._path(self.path).getFileSystem(self._conf)

    def _path(self, path: str):
        return self._jvm.org.apache.hadoop.fs.Path(path)

    def last(self) -> int:
        """The number of the last version, 0 before the first."""
        root = self._path(self.path)
        names = [s.getPath().getName() for s in self._fs.listStatus(root)] if self._fs.exists(root) else []
        return max((int(n[1:]) for n in names if n[:1] == "v" and n[1:].isdigit()), default=0)

    def read(self, version: int | None = None) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/v{self.last() if version is None else version}")

    def begin(self) -> Transaction:
        return Transaction(self, self.last())


class Transaction:
    """Sees the version that it began with, and what it wrote itself."""

    def __init__(self, store: Versions, base: int):
        self.store, self.base, self.folder = store, base, None

    def read(self) -> DataFrame:
        return self.store.spark.read.parquet(self.folder) if self.folder else self.store.read(self.base)

    def write(self, df: DataFrame) -> None:
        folder = f"{self.store.path}/open-{uuid.uuid4().hex}"
        df.write.parquet(folder)
        self.abort()
        self.folder = folder

    def commit(self) -> int:
        """The new version's number; Conflict if another one took it. Nothing written is nothing to commit."""
        if not self.folder:
            return self.base
        jvm, target = self.store._jvm, self.store._path(f"{self.store.path}/v{self.base + 1}")
        if self.store._fs.exists(target):
            raise Conflict(f"version {self.base + 1} is there already")
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(self.store._fs.getUri(), self.store._conf)
        none = self.store.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0)
        try:
            context.rename(self.store._path(self.folder), target, none)
        except Exception as e:
            raise Conflict(str(e)) from e
        self.folder = None
        return self.base + 1

    def abort(self) -> None:
        """What was written goes."""
        if self.folder:
            self.store._fs.delete(self.store._path(self.folder), True)
            self.folder = None


def salvaged(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """What can still be read of a store whose files are damaged in part: rows of broken files are left out."""
    return spark.read.schema(schema).option("ignoreCorruptFiles", "true").parquet(path)
