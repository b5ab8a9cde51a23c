"""The folder that all executors share, for intermediate and stored tables."""

from __future__ import annotations

import tempfile
import threading
import time
import uuid

from pyspark.sql import DataFrame, SparkSession


def folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir, or one of our own where it is unset, in local mode."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        at = "file://" + tempfile.mkdtemp(prefix="marlstone-")
        spark.conf.set("spark.checkpoint.dir", at)
    return at


def stored(df: DataFrame, what: str) -> DataFrame:
    """df written to the shared folder and read back, so that its lineage ends there.

    What an application stored is deleted when it ends.
    """
    spark = df.sparkSession
    own = f"{folder(spark)}/marlstone/{spark.sparkContext.applicationId}"
    place = spark._jvm.org.apache.hadoop.fs.Path(own)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(place)
    path = f"{own}/{what}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


_one_at_a_time = threading.Lock()


class Files:
    """Small driver-side files on any Hadoop file system."""

    def __init__(self, spark: SparkSession, root: str):
        self.jvm, self.root = spark._jvm, root.rstrip("/")
        self.fs = self._path("").getFileSystem(spark._jsc.hadoopConfiguration())

    def _path(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}" if name else self.root)

    def read(self, name: str) -> str | None:
        path = self._path(name)
        if not self.fs.exists(path):
            return None
        stream = self.fs.open(path)
        try:
            return bytes(stream.readAllBytes()).decode("utf-8")
        finally:
            stream.close()

    def create(self, name: str, text: str) -> bool:
        """Write a file that mustn't exist yet; False if another writer was first.

        Creation without overwriting is what file systems and object stores do
        atomically, so the file is written in place; `read` tells whether it is whole.
        """
        path = self._path(name)
        with _one_at_a_time:  # local file systems look first and create then
            if self.fs.exists(path):
                return False
            try:
                stream = self.fs.create(path, False)
            except Exception:
                if self.fs.exists(path):
                    return False
                raise
        try:
            stream.write(bytearray(text.encode("utf-8")))
        finally:
            stream.close()
        return True

    def age(self, name: str) -> float:
        """Seconds since a file was changed."""
        return time.time() - self.fs.getFileStatus(self._path(name)).getModificationTime() / 1000

    def latest(self, prefix: str) -> int:
        """The highest n of the files prefix-n, -1 if there is none."""
        if not self.fs.exists(self._path("")):
            return -1
        found = [s.getPath().getName() for s in self.fs.listStatus(self._path(""))]
        return max((int(f[len(prefix) + 1 :]) for f in found if f.startswith(prefix + "-") and f[len(prefix) + 1 :].isdigit()), default=-1)

    def names(self, folder: str) -> list[str]:
        """What is in a folder; nothing, if there is none."""
        path = self._path(folder)
        return [s.getPath().getName() for s in self.fs.listStatus(path)] if self.fs.exists(path) else []

    def delete(self, name: str) -> None:
        self.fs.delete(self._path(name), True)

    def copy(self, name: str, to: str) -> None:
        conf = self.fs.getConf()
        target = self.jvm.org.apache.hadoop.fs.Path(to)
        self.jvm.org.apache.hadoop.fs.FileUtil.copy(self.fs, self._path(name), target.getFileSystem(conf), target, False, conf)
