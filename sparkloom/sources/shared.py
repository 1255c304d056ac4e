"""Folders and small files that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession


def scratch_folder(spark: SparkSession, name: str) -> str:
    """A new path under ``spark.checkpoint.dir``; where that is unset, on one machine (tests), under a temporary folder."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base is None:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        base = tempfile.mkdtemp(prefix="sparkloom-")
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4()}"


class Files:
    """Small files and folders in any store that Spark reads, from the driver."""

    def __init__(self, spark: SparkSession):
        self._jvm, self._conf = spark._jvm, spark._jsc.hadoopConfiguration()

    def _at(self, path: str):
        p = self._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self._conf), p

    def names(self, folder: str) -> list[str]:
        fs, p = self._at(folder)
        return sorted(s.getPath().getName() for s in fs.listStatus(p)) if fs.exists(p) else []

    def exists(self, path: str) -> bool:
        fs, p = self._at(path)
        return fs.exists(p)

    def read(self, path: str) -> str:
        fs, p = self._at(path)
        stream = fs.open(p)
        try:
            return self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def write(self, path: str, text: str) -> None:
        """Written under another name first, so readers see all of it or nothing."""
        fs, p = self._at(path)
        _, draft = self._at(f"{path}.{uuid.uuid4()}.draft")
        stream = fs.create(draft, True)
        stream.write(bytearray(text, "utf-8"))
        stream.close()
        fs.delete(p, False)
        fs.rename(draft, p)

    def delete(self, path: str) -> None:
        fs, p = self._at(path)
        fs.delete(p, True)
