"""Attempts at batches, and the tables whose rows count only once their attempt is on record.

An attempt writes what it has under an id of its own and is recorded last, by one file with a row for each of its batches,
one as a rule. Rows of an attempt that broke off are never read, however much of them is there.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

RECORD = "attempt string, settings string, batch int, finished timestamp"


def _table(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The Parquet table at ``path``, none of its rows if it is not there; files that can't be read are passed over."""
    try:
        return spark.read.schema(schema).option("ignoreCorruptFiles", "true").parquet(path)
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


class Attempts:
    """Tables below ``path`` of the runs that have the same ``settings``."""

    def __init__(self, spark: SparkSession, path: str, settings: str):
        self.spark, self.path, self.settings = spark, path.rstrip("/"), settings

    def _records(self) -> DataFrame:
        return _table(self.spark, f"{self.path}/attempts", RECORD).where(F.col("settings") == self.settings).select("attempt", "batch")

    def recorded(self) -> DataFrame:
        """(attempt, batch) of the attempts on record. Of a batch that has several, each counts for what it wrote."""
        return self._records().distinct()

    def add(self, table: str, rows: DataFrame, attempt: str) -> None:
        """Write ``rows`` for ``attempt``."""
        rows.withColumn("attempt", F.lit(attempt)).write.mode("append").parquet(f"{self.path}/{table}")

    def record(self, attempt: str, *batches: int) -> None:
        """From here on, what ``attempt`` wrote for ``batches`` counts."""
        each = F.explode(F.split(F.lit(",".join(map(str, batches))), ",").cast("array<int>"))
        rows = self.spark.range(1).select(F.lit(attempt).alias("attempt"), F.lit(self.settings).alias("settings"), each.alias("batch"), F.current_timestamp().alias("finished"))
        rows.coalesce(1).write.mode("append").parquet(f"{self.path}/attempts")

    def rows(self, table: str, schema: str) -> DataFrame:
        """What recorded attempts have written to ``table``."""
        held = _table(self.spark, f"{self.path}/{table}", f"{schema}, attempt string")
        return held.join(self._records().select("attempt"), "attempt", "left_semi").drop("attempt")
