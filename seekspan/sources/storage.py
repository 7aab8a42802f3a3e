"""Files of any file system that Spark can reach: listing, small text files, an atomic rename."""

from __future__ import annotations

from pyspark.sql import SparkSession


class Storage:
    """A folder on whatever file system its path names."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self._jvm = spark._jvm
        self._conf = spark._jsc.hadoopConfiguration()
        self._fs = self._path("").getFileSystem(self._conf)

    def _path(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}" if name else self.root)

    def exists(self, name: str = "") -> bool:
        return self._fs.exists(self._path(name))

    def names(self, name: str = "") -> list[str]:
        """Entries of a folder, none if it does not exist."""
        return sorted(s.getPath().getName() for s in self._fs.listStatus(self._path(name))) if self.exists(name) else []

    def bytes(self, name: str = "") -> int:
        return self._fs.getContentSummary(self._path(name)).getLength()

    def read(self, name: str) -> str:
        stream = self._fs.open(self._path(name))
        try:
            return self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def create(self, name: str, text: str, temporary: str) -> bool:
        """Write a file that must not exist yet: it appears whole or not at all. False if somebody else was first."""
        first = self._path(temporary)
        self._fs.mkdirs(self._path(name).getParent())
        stream = self._fs.create(first, True)
        try:
            stream.write(bytearray(text.encode("utf-8")))
        finally:
            stream.close()
        context = self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._path("").toUri(), self._conf)
        rename = self._jvm.org.apache.hadoop.fs.Options.Rename
        how = self.spark.sparkContext._gateway.new_array(rename, 1)
        how[0] = rename.NONE
        try:
            context.rename(self._fs.makeQualified(first), self._fs.makeQualified(self._path(name)), how)
            return True
        except Exception:
            self._fs.delete(first, False)
            if self.exists(name):
                return False
            raise

    def delete(self, name: str) -> None:
        self._fs.delete(self._path(name), True)
