"""Small marks in a folder, each there as a whole or not at all: what has been finished, and which files a table is made of."""

from __future__ import annotations

import json
import uuid

from pyspark.errors import PySparkException
from pyspark.sql import SparkSession


class Ledger:
    """JSON marks by name, through Hadoop's file layer, so that they may lie wherever tables do.

    A mark is written beside its place and renamed to it, which fails where a mark of that name is: of two that put one, one wins. The
    store's rename must be atomic, as those of HDFS, mounted disks and the stores that Structured Streaming's own checkpoints may lie in are.
    """

    def __init__(self, spark: SparkSession, folder: str):
        self.jvm, self.gateway = spark.sparkContext._jvm, spark.sparkContext._gateway
        self.folder = folder.rstrip("/")
        root = self._path(self.folder)
        conf = spark.sparkContext._jsc.hadoopConfiguration()
        self.fs = root.getFileSystem(conf)
        self.files = self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(self.fs.getUri(), conf)

    def _path(self, path: str):
        return self.jvm.org.apache.hadoop.fs.Path(path)

    def names(self) -> list[str]:
        """Names of the marks, in order."""
        if not self.fs.exists(self._path(self.folder)):
            return []
        return sorted(s.getPath().getName() for s in self.fs.listStatus(self._path(self.folder)) if not s.getPath().getName().startswith((".", "_")))

    def get(self, name: str) -> dict:
        stream = self.fs.open(self._path(f"{self.folder}/{name}"))
        try:
            return json.loads(self.jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def put(self, name: str, value: dict) -> bool:
        """Write a mark; False if one of this name is there, which then stays."""
        beside, place = self._path(f"{self.folder}/.{name}-{uuid.uuid4().hex}"), self._path(f"{self.folder}/{name}")
        stream = self.fs.create(beside)
        try:
            stream.write(bytearray(json.dumps(value).encode()))
        finally:
            stream.close()
        options = self.gateway.new_array(getattr(self.jvm.org.apache.hadoop.fs, "Options$Rename"), 0)
        try:
            self.files.rename(beside, place, options)
        except Exception as failed:
            self.fs.delete(beside, False)
            if not self.fs.exists(place):
                raise
            if not isinstance(failed, PySparkException) and "FileAlreadyExists" not in str(failed):
                raise
            return False
        return True


def delete(spark: SparkSession, path: str) -> None:
    """Remove a folder or file, if it is there."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
