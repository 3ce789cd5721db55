"""Parquet tables in versions: a write goes to a new folder and is named current afterwards; the version before it stays until the next write, so its readers go on."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


class Store:
    """Named tables under a folder that all executors share."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark._jsc.hadoopConfiguration())

    def _marker(self, name: str):  # noqa: ANN202
        return self._path(f"{self.root}/{name}/_current")

    def _current(self, name: str) -> str | None:
        if not self._fs.exists(self._marker(name)):
            return None
        stream = self._fs.open(self._marker(name))
        try:
            return bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()

    def exists(self, *names: str) -> bool:
        return all(self._current(n) is not None for n in names)

    def read(self, name: str) -> DataFrame:
        version = self._current(name)
        if version is None:
            raise FileNotFoundError(f"no table {name} under {self.root}")
        return self.spark.read.parquet(f"{self.root}/{name}/{version}")

    def write(self, name: str, df: DataFrame, partition_by: tuple[str, ...] = ()) -> DataFrame:
        """Replace the table; df may read the version it replaces, and so may others until the table is written again."""
        before, version = self._current(name), uuid.uuid4().hex
        df.write.partitionBy(*partition_by).parquet(f"{self.root}/{name}/{version}")
        # a new marker is written beside the old one and renamed over it, so no reader finds it empty
        fresh = self._path(f"{self.root}/{name}/_{version}")
        out = self._fs.create(fresh, True)
        try:
            out.write(bytearray(version.encode()))
        finally:
            out.close()
        jvm = self.spark._jvm
        rename = jvm.org.apache.hadoop.fs.Options.Rename
        how = self.spark.sparkContext._gateway.new_array(rename, 1)
        how[0] = rename.OVERWRITE
        jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._fs.getUri(), self.spark._jsc.hadoopConfiguration()).rename(fresh, self._marker(name), how)
        for old in self._fs.listStatus(self._path(f"{self.root}/{name}")):
            if old.isDirectory() and old.getPath().getName() not in (before, version):
                self._fs.delete(old.getPath(), True)
        return self.read(name)

    def append(self, name: str, df: DataFrame) -> DataFrame:
        """Add rows to the table, or begin it."""
        version = self._current(name)
        if version is None:
            return self.write(name, df)
        df.write.mode("append").parquet(f"{self.root}/{name}/{version}")
        return self.read(name)

    def drop(self, name: str) -> None:
        self._fs.delete(self._path(f"{self.root}/{name}"), True)
