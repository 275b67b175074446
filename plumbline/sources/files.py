"""Small files in a folder that driver and executors share, on any file system Hadoop knows."""

from __future__ import annotations

import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import SparkSession


class Folder:
    """Whole small files below a path: there with all of their text, or not at all."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self._jvm = spark.sparkContext._jvm
        conf = spark.sparkContext._jsc.hadoopConfiguration()
        self._fs = self.at("").getFileSystem(conf)
        self._files = self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._fs.makeQualified(self.at("")).toUri(), conf)

    def __truediv__(self, name: str) -> str:
        return f"{self.path}/{name}"

    def at(self, name: str):
        """The Hadoop path of a file, or of the folder itself."""
        return self._jvm.org.apache.hadoop.fs.Path(self / name if name else self.path)

    def names(self, folder: str = "") -> list[str]:
        """Files and folders directly below, in order; hidden ones are left out."""
        found = [s.getPath().getName() for s in self._fs.listStatus(self.at(folder))] if self._fs.exists(self.at(folder)) else []
        return sorted(n for n in found if not n.startswith((".", "_")))

    def exists(self, name: str) -> bool:
        return self._fs.exists(self.at(name))

    def size(self, name: str = "") -> int:
        """Bytes of a file, or of all files below a folder."""
        return self._fs.getContentSummary(self.at(name)).getLength()

    def read(self, name: str) -> str:
        stream = self._fs.open(self.at(name))
        try:
            return bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()

    def publish(self, name: str, text: str, replace: bool = False) -> bool:
        """Makes a file with its whole text by a rename; False where there is one already, unless it may be replaced."""
        draft = self.at(f"_drafts/{uuid.uuid4().hex}")
        out = self._fs.create(draft, False)
        out.write(bytearray(text.encode()))
        out.close()
        self._fs.mkdirs(self.at(name).getParent())
        kinds = getattr(self._jvm.org.apache.hadoop.fs, "Options$Rename")
        how = self.spark.sparkContext._gateway.new_array(kinds, 1)
        how[0] = kinds.OVERWRITE if replace else kinds.NONE
        try:
            self._files.rename(draft, self.at(name), how)
        except Py4JJavaError:
            self._fs.delete(draft, False)
            if not replace and self.exists(name):
                return False
            raise
        return True

    def delete(self, name: str) -> None:
        """A file, or a folder with all that is in it."""
        self._fs.delete(self.at(name), True)
