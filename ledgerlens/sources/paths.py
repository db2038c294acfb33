"""Where tables that a job needs again are written: the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_path(spark: SparkSession, label: str) -> str:
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        found = "file://" + tempfile.mkdtemp(prefix="ledgerlens-")
        spark.conf.set("spark.checkpoint.dir", found)
    return f"{found.rstrip('/')}/{label}-{uuid.uuid4().hex}"


def written(df: DataFrame, label: str) -> DataFrame:
    return written_at(df, shared_path(df.sparkSession, label))


def written_at(df: DataFrame, path: str) -> DataFrame:
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


class Files:
    """Small files through Hadoop's file systems, so any store that Spark reads."""

    def __init__(self, spark: SparkSession):
        self.path = spark._jvm.org.apache.hadoop.fs.Path
        self.conf = spark._jsparkSession.sessionState().newHadoopConf()

    def _at(self, path: str):
        at = self.path(path)
        return at.getFileSystem(self.conf), at

    def names(self, folder: str) -> list[str]:
        fs, at = self._at(folder)
        return sorted(s.getPath().getName() for s in fs.listStatus(at)) if fs.exists(at) else []

    def read(self, path: str) -> str:
        fs, at = self._at(path)
        stream = fs.open(at)
        try:
            return bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()

    def delete(self, path: str) -> None:
        """A file, or a folder with all that is in it."""
        fs, at = self._at(path)
        fs.delete(at, True)

    def write(self, path: str, text: str) -> None:
        """In place of what is there."""
        fs, at = self._at(path)
        stream = fs.create(at, True)
        stream.write(bytearray(text.encode()))
        stream.close()

    def write_new(self, path: str, text: str) -> bool:
        """Writes beside the path and renames; False if the path is there already."""
        fs, at = self._at(path)
        if fs.exists(at):
            return False
        beside = self.path(f"{path}.{uuid.uuid4().hex}.tmp")
        stream = fs.create(beside)
        stream.write(bytearray(text.encode()))
        stream.close()
        if fs.rename(beside, at):
            return True
        fs.delete(beside, False)
        return False
