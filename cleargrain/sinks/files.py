"""Folders and small files on any file system that Spark reaches, through Hadoop's API."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import SparkSession


@dataclass(frozen=True)
class Entry:
    name: str
    folder: bool
    bytes: int
    changed: int


class Files:
    def __init__(self, spark: SparkSession):
        self._jvm, self._conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()

    def _at(self, path: str):
        p = self._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self._conf), p

    def exists(self, path: str) -> bool:
        fs, p = self._at(path)
        return fs.exists(p)

    def make(self, path: str) -> None:
        fs, p = self._at(path)
        if not fs.mkdirs(p):
            raise OSError("a folder can't be made")

    def remove(self, path: str) -> bool:
        fs, p = self._at(path)
        return fs.delete(p, True)

    def move(self, old: str, new: str) -> None:
        fs, p = self._at(old)
        if not fs.rename(p, self._jvm.org.apache.hadoop.fs.Path(new)):
            raise OSError("a file or folder can't be renamed")

    def entries(self, path: str) -> list[Entry]:
        """What lies in a folder, by name; names that begin with a dot or an underscore are the file system's own."""
        fs, p = self._at(path)
        if not fs.exists(p):
            return []
        found = [Entry(s.getPath().getName(), s.isDirectory(), s.getLen(), s.getModificationTime()) for s in fs.listStatus(p)]
        return sorted((e for e in found if e.name[0] not in "._"), key=lambda e: e.name)

    def text(self, path: str) -> str:
        fs, p = self._at(path)
        stream = fs.open(p)
        try:
            return self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def write_text(self, path: str, text: str) -> None:
        """A whole small file that appears at once; fails where there is one."""
        fs, p = self._at(path)
        own = self._jvm.org.apache.hadoop.fs.Path(p.getParent(), f".{p.getName()}.new")
        stream = fs.create(own, True)
        stream.write(bytearray(text.encode()))
        stream.hsync()
        stream.close()
        if fs.exists(p) or not fs.rename(own, p):
            fs.delete(own, False)
            raise FileExistsError("there is such a file")
