"""Files of a root folder through Spark's own file systems, so that a store may lie anywhere that Spark reaches."""

from __future__ import annotations

import os

from py4j.protocol import Py4JJavaError
from pyspark.sql import SparkSession

from ..errors import EngineError


class Files:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        jvm = spark._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._io = jvm.org.apache.hadoop.io.IOUtils
        self._fs = self._path(self.root).getFileSystem(spark._jsc.hadoopConfiguration())
        self._jvm = jvm

    def at(self, key: str) -> str:
        return f"{self.root}/{key}"

    def path(self, key: str):
        return self._path(self.at(key))

    def write_new(self, key: str, data: bytes) -> bool:
        """Creates a file whole; False if it is there already.  Existing files are never changed: of two writers one succeeds, where the
        file system has a rename without overwriting that is atomic (as HDFS has) or hard links (local ones).  Object stores that copy
        on a rename have neither, so a root there needs a single writer."""
        if self._fs.exists(self.path(key)):
            return False
        self._fs.mkdirs(self.path(key).getParent())
        hidden = self._path(f"{self.path(key).getParent()}/.{self._jvm.java.util.UUID.randomUUID()}")
        out = self._fs.create(hidden, False)
        out.write(data)
        out.hsync()
        out.close()
        try:
            return self._named(hidden, self.path(key))
        finally:
            self._fs.delete(hidden, False)

    def _named(self, hidden, path) -> bool:
        """Gives a finished file its name, unless another has it."""
        if self._fs.getUri().getScheme() == "file":
            try:
                os.link(hidden.toUri().getPath(), path.toUri().getPath())
            except FileExistsError:
                return False
            return True
        options = self.spark.sparkContext._gateway.new_array(self._jvm.org.apache.hadoop.fs.Options.Rename, 0)
        try:
            self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._fs.getUri()).rename(hidden, path, options)
        except Py4JJavaError as e:
            if "FileAlreadyExistsException" in e.java_exception.getClass().getName():
                return False
            raise
        return True

    def read(self, key: str, start: int = 0, length: int | None = None) -> bytes:
        status = self.size(key)
        if status is None:
            raise EngineError("PUBLISHED_OBJECT_MISSING", key)
        stream = self._fs.open(self.path(key))
        try:
            stream.seek(start)
            n = status - start if length is None else min(length, status - start)
            return bytes(self._jvm.org.apache.commons.io.IOUtils.toByteArray(stream, n)) if n > 0 else b""
        finally:
            stream.close()

    def footer(self, key: str) -> bytes:
        """The footer of a Parquet file: schema, metadata, and rows, places and statistics of all row groups.  Empty if there is none."""
        size = self.size(key) or 0
        end = self.read(key, size - 8) if size >= 12 else b""
        length = int.from_bytes(end[:4], "little")
        return self.read(key, size - 8 - length, length) if end[4:] == b"PAR1" and length <= size - 12 else b""

    def size(self, key: str) -> int | None:
        path = self.path(key)
        return self._fs.getFileStatus(path).getLen() if self._fs.exists(path) else None

    def names(self, folder: str) -> list[str]:
        path = self.path(folder)
        if not self._fs.exists(path):
            return []
        return sorted(n for s in self._fs.listStatus(path) if not (n := s.getPath().getName()).startswith((".", "_")))

    def move(self, source: str, key: str) -> None:
        """source: a full path within the same file system."""
        self._fs.mkdirs(self.path(key).getParent())
        if self._fs.exists(self.path(key)) or not self._fs.rename(self._path(source), self.path(key)):
            raise EngineError("PUBLISHED_OBJECT_CORRUPT", f"{key} can't be stored")

    def delete(self, key: str, folder: bool = False) -> None:
        self._fs.delete(self.path(key), folder)
