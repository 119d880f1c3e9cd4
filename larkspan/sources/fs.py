"""Small files of a database folder: in a local or shared folder, or in a store of Spark's Hadoop client that renames in one step.

``create`` is the commit point: it makes a file with all its content, or fails because the name is taken. A folder with hard
links does that by linking, a Hadoop store by a rename that does not overwrite (HDFS and stores with its semantics).
"""

from __future__ import annotations

import os
import shutil
import tempfile
import uuid
from typing import Protocol

from pyspark.sql import SparkSession


#: Schemes whose rename fails where the target exists, in one step.
ATOMIC = ("file", "hdfs", "viewfs", "abfs", "abfss")


class Files(Protocol):
    def url(self, rel: str) -> str: ...
    def exists(self, rel: str) -> bool: ...
    def names(self, rel: str) -> list[str]: ...
    def read(self, rel: str) -> bytes: ...
    def create(self, rel: str, data: bytes) -> bool: ...
    def replace(self, rel: str, data: bytes) -> None: ...
    def move(self, rel: str, to: str) -> None: ...
    def delete(self, rel: str) -> None: ...
    def delete_tree(self, rel: str) -> None: ...


class LocalFiles:
    def __init__(self, root: str):
        self.root = os.path.abspath(root)

    def _path(self, rel: str) -> str:
        return os.path.join(self.root, rel)

    def url(self, rel: str) -> str:
        return "file://" + self._path(rel)

    def exists(self, rel: str) -> bool:
        return os.path.exists(self._path(rel))

    def names(self, rel: str) -> list[str]:
        return sorted(os.listdir(self._path(rel))) if os.path.isdir(self._path(rel)) else []

    def read(self, rel: str) -> bytes:
        with open(self._path(rel), "rb") as f:
            return f.read()

    def _temp(self, rel: str, data: bytes) -> str:
        folder = os.path.dirname(self._path(rel))
        os.makedirs(folder, exist_ok=True)
        temp = os.path.join(folder, f"_{uuid.uuid4().hex}.tmp")
        with open(temp, "wb") as f:
            f.write(data)
            f.flush()
            os.fsync(f.fileno())
        return temp

    def create(self, rel: str, data: bytes) -> bool:
        temp = self._temp(rel, data)
        try:
            os.link(temp, self._path(rel))
        except FileExistsError:
            return False
        finally:
            os.unlink(temp)
        return True

    def replace(self, rel: str, data: bytes) -> None:
        os.replace(self._temp(rel, data), self._path(rel))

    def move(self, rel: str, to: str) -> None:
        os.rename(self._path(rel), self._path(to))

    def delete(self, rel: str) -> None:
        os.unlink(self._path(rel))

    def delete_tree(self, rel: str) -> None:
        shutil.rmtree(self._path(rel))


class HadoopFiles:
    def __init__(self, spark: SparkSession, root: str):
        scheme = root.partition(":")[0].lower()
        if scheme not in ATOMIC:
            raise ValueError(f"{scheme}: a rename there may overwrite, so that two commits could take one version; use one of {', '.join(ATOMIC)}")
        self.root, self._jvm, self._gateway = root.rstrip("/"), spark._jvm, spark.sparkContext._gateway
        self._conf = spark._jsc.hadoopConfiguration()
        self._fs = self._path("").getFileSystem(self._conf)

    def _path(self, rel: str):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{rel}" if rel else self.root)

    def url(self, rel: str) -> str:
        return f"{self.root}/{rel}"

    def exists(self, rel: str) -> bool:
        return self._fs.exists(self._path(rel))

    def names(self, rel: str) -> list[str]:
        return sorted(s.getPath().getName() for s in self._fs.listStatus(self._path(rel))) if self.exists(rel) else []

    def read(self, rel: str) -> bytes:
        stream = self._fs.open(self._path(rel))
        try:
            return bytes(self._jvm.org.apache.commons.io.IOUtils.toByteArray(stream))
        finally:
            stream.close()

    def _temp(self, rel: str, data: bytes) -> str:
        temp = f"{os.path.dirname(rel)}/_{uuid.uuid4().hex}.tmp".lstrip("/")
        out = self._fs.create(self._path(temp), True)
        out.write(bytearray(data))
        out.close()
        return temp

    def create(self, rel: str, data: bytes) -> bool:
        if self.exists(rel):
            return False
        temp = self._temp(rel, data)
        if self._fs.rename(self._path(temp), self._path(rel)):
            return True
        self._fs.delete(self._path(temp), False)
        return False

    def replace(self, rel: str, data: bytes) -> None:
        """The old file or the new one is there at any time: the rename overwrites."""
        fs = self._jvm.org.apache.hadoop.fs
        temp = self._temp(rel, data)
        options = self._gateway.new_array(fs.Options.Rename, 1)
        options[0] = fs.Options.Rename.OVERWRITE
        fs.FileContext.getFileContext(self._path("").toUri(), self._conf).rename(self._path(temp), self._path(rel), options)

    def move(self, rel: str, to: str) -> None:
        self._fs.rename(self._path(rel), self._path(to))

    def delete(self, rel: str) -> None:
        self._fs.delete(self._path(rel), False)

    def delete_tree(self, rel: str) -> None:
        self._fs.delete(self._path(rel), True)


def new_folder(spark: SparkSession) -> str:
    """A folder of its own under ``spark.checkpoint.dir``; where that is unset, and the master local, a temporary one. Both go with the application."""
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        named = f"file://{tempfile.gettempdir()}"
    folder = f"{named.rstrip('/')}/larkspan-{uuid.uuid4().hex}"
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    fs.mkdirs(path)  # only what exists can be marked
    fs.deleteOnExit(path)
    return folder


def files_of(spark: SparkSession | None, root: str) -> Files:
    """Local paths and ``file:`` by the operating system, all else by Hadoop."""
    if "://" not in root and not root.startswith("file:"):
        return LocalFiles(root)
    if root.startswith("file:"):
        return LocalFiles("/" + root.removeprefix("file:").lstrip("/"))
    if spark is None:
        raise ValueError(f"{root} needs a session")
    return HadoopFiles(spark, root)
