"""Small files of a run (state, selections, reports, locks) wherever Spark can write: on any Hadoop file system.

Tables are written by Spark beside them. A file appears whole or not at all: it is written under another name and renamed.
"""

from __future__ import annotations

import hashlib
import uuid

from pyspark.sql import SparkSession


class Place:
    """A path on the file system that its scheme names, or else on Spark's default one; as much of pathlib.Path as runs need."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.text = spark, str(path).rstrip("/")
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path(self.text)
        conf = spark.sparkContext._jsc.hadoopConfiguration()
        self._fs = self._path.getFileSystem(conf)
        self._conf, self._jvm = conf, jvm

    def __truediv__(self, name: str) -> Place:
        return Place(self.spark, f"{self.text}/{name}")

    def __str__(self) -> str:
        return self.text

    @property
    def name(self) -> str:
        return self.text.rpartition("/")[2]

    def exists(self) -> bool:
        return self._fs.exists(self._path)

    def mkdir(self, parents: bool = True, exist_ok: bool = True) -> None:
        if not exist_ok and self.exists():
            raise FileExistsError(f"already there: {self}")
        if not parents and not self._fs.exists(self._path.getParent()):
            raise FileNotFoundError(f"no folder for {self}")
        self._fs.mkdirs(self._path)

    def unlink(self) -> None:
        self._fs.delete(self._path, False)

    def free(self) -> int:
        """Bytes left on the file system."""
        return self._fs.getStatus(self._path).getRemaining()

    def remove(self) -> None:
        """With all that is below it."""
        self._fs.delete(self._path, True)

    def move(self, to: Place) -> None:
        """To a name that nothing has yet."""
        if to.exists():
            raise FileExistsError(f"already there: {to}")
        if not self._fs.rename(self._path, to._path):
            raise OSError(f"{self} can't be moved to {to}")

    def size(self) -> int:
        """Bytes of the file, or of all files below the folder."""
        return self._fs.getContentSummary(self._path).getLength()

    def read_bytes(self) -> bytes:
        if not self.exists():
            raise FileNotFoundError(str(self))
        stream = self._plain().open(self._path)
        try:
            return bytes(self._jvm.org.apache.commons.io.IOUtils.toByteArray(stream))
        finally:
            stream.close()

    def read_text(self) -> str:
        return self.read_bytes().decode()

    def write_text(self, text: str) -> None:
        """In place of what is there, in one step."""
        beside = self._path.suffix(f".{uuid.uuid4().hex}.tmp")
        self._write(beside, text, False)
        kinds = self._jvm.java.lang.Class.forName("org.apache.hadoop.fs.Options$Rename")
        over = next(k for k in kinds.getEnumConstants() if k.toString() == "OVERWRITE")
        how = self._jvm.java.lang.reflect.Array.newInstance(kinds, 1)
        self._jvm.java.lang.reflect.Array.set(how, 0, over)
        self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._fs.getUri(), self._conf).rename(self._qualified(beside), self._qualified(self._path), how)

    def create_text(self, text: str) -> None:
        """A new file; FileExistsError if another is there, which the file system decides."""
        try:
            self._write(self._path, text, False)
        except Exception as e:
            if self.exists():
                raise FileExistsError(f"already there: {self}") from e
            raise

    def digest(self, kind: str = "sha256") -> str:
        return hashlib.new(kind, self.read_bytes()).hexdigest()

    def _qualified(self, path: object) -> object:
        return self._fs.makeQualified(path)

    def _plain(self) -> object:
        """The file system without checksum files of its own beside files, if it is a local one."""
        return self._fs.getRawFileSystem() if "LocalFileSystem" in self._fs.getClass().getName() else self._fs

    def _write(self, path: object, text: str, over: bool) -> None:
        self._fs.mkdirs(path.getParent())
        out = self._plain().create(path, over)
        try:
            out.write(bytearray(text.encode()))
        finally:
            out.close()
