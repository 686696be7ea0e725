"""Small files on any file system that Spark reaches: metadata of tables and the registry."""

from __future__ import annotations

import json
import os
import uuid

from pyspark.sql import SparkSession


class FileSystem:
    """Hadoop's file system behind a few calls."""

    def __init__(self, spark: SparkSession) -> None:
        self._jvm, self._conf = spark._jvm, spark._jsc.hadoopConfiguration()

    def _at(self, path: str):
        p = self._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self._conf), p

    def exists(self, path: str) -> bool:
        fs, p = self._at(path)
        return fs.exists(p)

    def list(self, path: str) -> list[tuple[str, int]]:
        """Names and sizes of the files in a folder; empty if there is none."""
        fs, p = self._at(path)
        if not fs.exists(p):
            return []
        return sorted((s.getPath().getName(), s.getLen()) for s in fs.listStatus(p))

    def read(self, path: str) -> str:
        fs, p = self._at(path)
        stream = fs.open(p)
        try:
            return bytes(self._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode()
        finally:
            stream.close()

    def write(self, path: str, text: str, overwrite: bool = False) -> bool:
        """Write a file whole, in one step that readers see. False if the name is taken and `overwrite` isn't set: of several writers, one succeeds.

        The text goes to a name of its own first. On a local disk a link to it is made under the name, elsewhere it is renamed by a call that
        doesn't replace files; both are one step in which the file system itself refuses a name that is taken. Object stores whose
        renames are copies don't, and need a single writer.
        """
        fs, p = self._at(path)
        if fs.getScheme() == "file":
            return _write_local(p.toUri().getPath(), text.encode(), overwrite)
        fs.mkdirs(p.getParent())
        aside = self._jvm.org.apache.hadoop.fs.Path(p.getParent(), f".{p.getName()}.{uuid.uuid4().hex}")
        stream = fs.create(aside, True)
        try:
            stream.write(text.encode())
        finally:
            stream.close()
        return self._put(aside, p, overwrite)

    def _put(self, aside, p, overwrite: bool) -> bool:
        """Rename a file to its place."""
        rename = self._jvm.java.lang.Class.forName("org.apache.hadoop.fs.Options$Rename").getEnumConstants()
        chosen = [x for x in rename if x.name() == ("OVERWRITE" if overwrite else "NONE")]
        options = self._jvm.java.lang.reflect.Array.newInstance(chosen[0].getClass(), 1)
        options[0] = chosen[0]
        try:
            self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(p.toUri(), self._conf).rename(aside, p, options)
        except Exception as e:  # noqa: BLE001  py4j wraps it
            p.getFileSystem(self._conf).delete(aside, False)
            if "FileAlreadyExists" in str(e):
                return False
            raise
        return True

    def delete(self, path: str) -> None:
        fs, p = self._at(path)
        fs.delete(p, True)

    def copy(self, source: str, target: str) -> None:
        a, p = self._at(source)
        b, q = self._at(target)
        self._jvm.org.apache.hadoop.fs.FileUtil.copy(a, p, b, q, False, True, self._conf)

    def rename(self, source: str, target: str) -> bool:
        fs, p = self._at(source)
        return fs.rename(p, self._jvm.org.apache.hadoop.fs.Path(target))

    def read_json(self, path: str):
        return json.loads(self.read(path))


def _write_local(path: str, data: bytes, overwrite: bool) -> bool:
    folder, name = os.path.split(path)
    os.makedirs(folder, exist_ok=True)
    aside = os.path.join(folder, f".{name}.{uuid.uuid4().hex}")
    with open(aside, "wb") as f:
        f.write(data)
        f.flush()
        os.fsync(f.fileno())
    try:
        if overwrite:
            os.replace(aside, path)
        else:
            os.link(aside, path)
    except FileExistsError:
        return False
    finally:
        if os.path.exists(aside):
            os.unlink(aside)
    return True
