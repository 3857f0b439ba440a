"""Tables written into the shared folder and read again."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

SETTING = "spark.checkpoint.dir"


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir.

    Where it is unset, a local master gets a temporary one, kept in the
    session; on a cluster that is an error, as executors would each write to a
    disk of their own.
    """
    found = spark.conf.get(SETTING, None) or spark.sparkContext.getConf().get(SETTING)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError(f"{SETTING} must name a folder that driver and executors share")
        found = "file://" + tempfile.mkdtemp(prefix="spark-")
        spark.conf.set(SETTING, found)
    return found.rstrip("/")


def settle(df: DataFrame, label: str, rows_a_file: int = 0) -> DataFrame:
    """Write a table into the shared folder and read it again.

    It cuts lineage: a lost executor costs a read of this table, not the
    stages before it, and a value drawn once stays the same. Rows with large
    cells go into files of ``rows_a_file`` at most: Spark reads 4,096 rows of a file at once.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tilework/{uuid.uuid4().hex}/{label}"
    df.write.option("maxRecordsPerFile", rows_a_file).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._settled_at = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete settled tables that nothing will read again."""
    for df in tables:
        path = getattr(df, "_settled_at", None)
        if path:
            jvm = df.sparkSession._jvm
            at = jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(at, True)


class Folder:
    """Small files of a folder of any file system that Spark reads."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.jvm = spark, spark._jvm
        self.root = path.rstrip("/")
        self.fs = self._path("").getFileSystem(spark._jsc.hadoopConfiguration())

    def _path(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}" if name else self.root)

    def names(self, folder: str) -> list[str]:
        at = self._path(folder)
        return [s.getPath().getName() for s in self.fs.listStatus(at)] if self.fs.exists(at) else []

    def read(self, name: str) -> str:
        return "".join(r[0] for r in self.spark.read.text(f"{self.root}/{name}", wholetext=True).collect())  # one small file

    def write(self, name: str, data: str | bytes) -> None:
        """Written aside and renamed, so that a file is there whole or not at all."""
        aside = self._path(f"{name}.writing")
        out = self.fs.create(aside, True)
        out.write(bytearray(data, "utf-8") if isinstance(data, str) else bytearray(data))
        out.close()
        self.fs.delete(self._path(name), False)
        if not self.fs.rename(aside, self._path(name)):
            raise OSError(f"{self.root}/{name} could not be written")

    def delete(self, name: str) -> None:
        self.fs.delete(self._path(name), True)
