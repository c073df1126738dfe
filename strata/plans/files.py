"""Small files in any place that Spark reaches: read, replaced as a whole, or created only if nobody has."""

from __future__ import annotations

import os
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import SparkSession

#: Stores whose files appear when they are closed, and whose create without overwriting is exclusive; others rename.
ON_CLOSE = ("s3a", "abfs", "abfss", "gs", "wasb", "wasbs")


class ConflictError(RuntimeError):
    """Another writer has created the same file."""


class SharedFiles:
    def __init__(self, spark: SparkSession):
        self.spark = spark

    def fs(self, path: str):
        hadoop = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return hadoop.getFileSystem(self.spark._jsc.hadoopConfiguration()), hadoop

    def _local(self, path: str) -> Path | None:
        fs, p = self.fs(path)
        return Path(p.toUri().getPath()) if fs.getScheme() == "file" else None

    def exists(self, path: str) -> bool:
        fs, p = self.fs(path)
        return fs.exists(p)

    def read_text(self, path: str) -> str:
        fs, p = self.fs(path)
        stream = fs.open(p)
        try:
            return bytes(self.spark._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode()
        finally:
            stream.close()

    def _write(self, path: str, text: str, overwrite: bool) -> None:
        fs, p = self.fs(path)
        out = fs.create(p, overwrite)
        out.write(bytearray(text.encode()))
        out.close()

    def _rename(self, source: str, target: str, overwrite: bool) -> None:
        """One step of the file system: the target is there as a whole or not at all."""
        jvm = self.spark._jvm
        how = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE if overwrite else jvm.org.apache.hadoop.fs.Options.Rename.NONE
        options = self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
        options[0] = how
        _, a = self.fs(source)
        _, b = self.fs(target)
        jvm.org.apache.hadoop.fs.FileContext.getFileContext(a.toUri(), self.spark._jsc.hadoopConfiguration()).rename(a, b, options)

    def create(self, path: str, text: str) -> None:
        """Raises ConflictError if the file is there, also if another writer makes it at the same time."""
        local = self._local(path)
        if local is not None:
            local.parent.mkdir(parents=True, exist_ok=True)
            temporary = _written(local.parent, text)
            try:
                os.link(temporary, local)  # fails if the name is taken, in one step
            except FileExistsError:
                raise ConflictError(path) from None
            finally:
                os.unlink(temporary)
            return
        if self.exists(path):
            raise ConflictError(path)
        fs, _ = self.fs(path)
        temporary = path if fs.getScheme() in ON_CLOSE else f"{path}.{uuid.uuid4().hex}"
        try:
            self._write(temporary, text, False)
            if temporary != path:
                self._rename(temporary, path, False)
        except Exception as e:
            if temporary != path:
                fs.delete(self.fs(temporary)[1], False)
            if "AlreadyExists" in str(e):
                raise ConflictError(path) from e
            raise

    def replace(self, path: str, text: str) -> None:
        local = self._local(path)
        if local is not None:
            local.parent.mkdir(parents=True, exist_ok=True)
            os.replace(_written(local.parent, text), local)
            return
        fs, _ = self.fs(path)
        if fs.getScheme() in ON_CLOSE:
            self._write(path, text, True)
            return
        temporary = f"{path}.{uuid.uuid4().hex}"
        self._write(temporary, text, False)
        self._rename(temporary, path, True)


def _written(folder: Path, text: str) -> str:
    handle, name = tempfile.mkstemp(dir=folder, prefix=".")
    with os.fdopen(handle, "w") as out:
        out.write(text)
        out.flush()
        os.fsync(out.fileno())
    return name
