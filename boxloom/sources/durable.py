"""Cutting lineage in the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir; a temporary one only where that is unset, as in tests."""
    folder = spark.conf.get("spark.checkpoint.dir", "")
    if not folder:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="spark-ckpt-")
        spark.sparkContext.setCheckpointDir(folder)
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def durable(df: DataFrame) -> DataFrame:
    """``df`` checkpointed to the shared folder, so that later reads do not repeat the work behind it."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


#: Bytes of a table from which the driver is made to let go of what was shuffled for it.
LARGE = 16 << 20


class Scratch:
    """Tables of a step of work in the shared folder, as compressed Parquet, deleted at the end of a ``with``."""

    def __init__(self, spark: SparkSession):
        self.spark, self.path, self.tables = spark, f"{shared_folder(spark).rstrip('/')}/scratch/{uuid.uuid4().hex}", 0

    def __enter__(self) -> Scratch:
        return self

    def __exit__(self, *_) -> None:
        store, folder = self._opened(self.path)
        store.delete(folder, True)

    def _opened(self, path: str):
        folder = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return folder.getFileSystem(self.spark._jsc.hadoopConfiguration()), folder

    def held(self, df: DataFrame) -> DataFrame:
        """``df`` written and read again, to be used within the ``with`` alone."""
        self.tables += 1
        path = f"{self.path}/{self.tables}"
        df.write.option("compression", "zstd").parquet(path)
        store, folder = self._opened(path)
        if store.getContentSummary(folder).getLength() >= LARGE:
            # What was shuffled for it lies on the executors' disks until the driver's garbage is collected.
            self.spark._jvm.System.gc()
        return self.spark.read.schema(df.schema).parquet(path)


def written(df: DataFrame) -> DataFrame:
    """``df`` written as Parquet to the shared folder and read again."""
    spark = df.sparkSession
    path = f"{shared_folder(spark).rstrip('/')}/tables/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.parquet(path)
