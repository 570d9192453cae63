"""Small files through Hadoop's file systems, so that a collection may lie wherever Spark can read."""

from __future__ import annotations

import atexit
import json
import shutil
import tempfile
import uuid

from pyspark.sql import SparkSession


class Files:
    def __init__(self, spark: SparkSession, root: str):
        self.jvm, self.root = spark.sparkContext._jvm, root.rstrip("/")
        self.fs = self._path("").getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _path(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}" if name else self.root)

    def exists(self, name: str = "") -> bool:
        return self.fs.exists(self._path(name))

    def read_json(self, name: str):
        stream = self.fs.open(self._path(name))
        try:
            return json.loads(bytes(stream.readAllBytes()).decode())
        finally:
            stream.close()

    def write_new(self, name: str, text: str) -> bool:
        """Makes the file as a whole, written beside its place and then renamed; False if there is one already.

        Renaming refuses an existing file in HDFS. Where a file system doesn't, two
        writers that both found no file may both succeed, and the last one counts."""
        if self.exists(name):
            return False
        beside = f"{name}.{uuid.uuid4().hex[:8]}.tmp"
        stream = self.fs.create(self._path(beside), True)
        stream.write(bytearray(text.encode()))
        stream.close()
        if self.fs.rename(self._path(beside), self._path(name)):
            return True
        self.fs.delete(self._path(beside), False)
        return False

    def delete(self, name: str = "") -> bool:
        return self.fs.delete(self._path(name), True)

    def make(self, name: str = "") -> None:
        self.fs.mkdirs(self._path(name))

    def names(self, name: str = "") -> list[str]:
        return sorted(s.getPath().getName() for s in self.fs.listStatus(self._path(name))) if self.exists(name) else []


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, from spark.checkpoint.dir; only a local master without it gets a temporary one."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="starling-")
        atexit.register(shutil.rmtree, base[7:], True)
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")
