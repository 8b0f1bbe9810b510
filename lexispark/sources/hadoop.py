"""Hadoop file system calls of the driver: any path that Spark can read and write."""

from __future__ import annotations

import uuid

from pyspark.sql import SparkSession


class ConflictError(RuntimeError):
    """Another writer has made this commit."""


class Files:
    """File system calls through the session's Hadoop configuration."""

    def __init__(self, spark: SparkSession):
        self.jvm, self.conf, self.gateway = spark._jvm, spark._jsc.hadoopConfiguration(), spark.sparkContext._gateway
        self.Path = self.jvm.org.apache.hadoop.fs.Path

    def fs(self, path: str):
        return self.Path(path).getFileSystem(self.conf)

    def until_exit(self, path: str) -> None:
        """Make a folder that goes, with all it holds, when the driver's JVM ends."""
        fs = self.fs(path)
        fs.mkdirs(self.Path(path))
        fs.deleteOnExit(self.Path(path))

    def qualified(self, path: str) -> str:
        """The path with its file system's scheme."""
        return self.fs(path).makeQualified(self.Path(path)).toString()

    def exists(self, path: str) -> bool:
        return self.fs(path).exists(self.Path(path))

    def names(self, path: str) -> list[str]:
        return sorted(s.getPath().getName() for s in self.fs(path).listStatus(self.Path(path))) if self.exists(path) else []

    def read(self, path: str) -> str:
        stream = self.fs(path).open(self.Path(path))
        try:
            return self.jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def put_new(self, path: str, text: str) -> None:
        """Write a file whole or not at all; ConflictError if it exists."""
        fs, to = self.fs(path), self.Path(path)
        tmp = self.Path(f"{path}.{uuid.uuid4().hex}.tmp")
        out = fs.create(tmp, True)
        out.write(bytearray(text.encode()))
        out.close()
        try:
            context = self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(to.toUri() if to.toUri().getScheme() else fs.getUri(), self.conf)
            kind = getattr(self.jvm.org.apache.hadoop.fs, "Options$Rename")
            array = self.gateway.new_array(kind, 1)
            array[0] = kind.NONE
            context.rename(tmp, to, array)
        except Exception as error:
            fs.delete(tmp, False)
            if fs.exists(to):
                raise ConflictError(f"{path} exists: another writer was first") from error
            raise

    def replace(self, fresh: str, path: str) -> None:
        """Put a folder in the place of another; the old one stands aside until the new one is there."""
        fs, old = self.fs(path), f"{path}.{uuid.uuid4().hex}.old"
        fs.mkdirs(self.Path(path).getParent())
        moved = fs.exists(self.Path(path)) and fs.rename(self.Path(path), self.Path(old))
        if not fs.rename(self.Path(fresh), self.Path(path)):
            if moved:
                fs.rename(self.Path(old), self.Path(path))
            raise OSError(f"{fresh} can't be put at {path}")
        if moved:
            fs.delete(self.Path(old), True)

    def delete(self, path: str) -> None:
        self.fs(path).delete(self.Path(path), True)

    def is_dir(self, path: str) -> bool:
        fs = self.fs(path)
        return fs.exists(self.Path(path)) and fs.getFileStatus(self.Path(path)).isDirectory()

    def entries(self, path: str) -> list[tuple[str, str, bool, int, int]]:
        """(name, path, is a folder, size, time in milliseconds) of what a folder holds; links are left out."""
        found = []
        for s in self.fs(path).listStatus(self.Path(path)):
            if not s.isSymlink():
                found.append((s.getPath().getName(), s.getPath().toString(), s.isDirectory(), s.getLen(), s.getModificationTime()))
        return found

    def bytes_of(self, path: str) -> bytes:
        stream = self.fs(path).open(self.Path(path))
        try:
            return bytes(self.jvm.org.apache.commons.io.IOUtils.toByteArray(stream))
        finally:
            stream.close()
