"""Readers of label datasets, and the ledger that a run resumes from."""

from __future__ import annotations

from typing import Any

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from boxloom.sources.label_source import LabelFiles

LEDGER_SCHEMA = "stem string, settings string, batch int, finished timestamp"


def label_files(spark: SparkSession, folder: str) -> DataFrame:
    """(stem, content, batch) of the .txt files of ``folder`` and of its folders of batches."""
    spark.dataSource.register(LabelFiles)
    return spark.read.format("label_files").load(folder)


def label_lines(spark: SparkSession, folder: str) -> DataFrame:
    """(stem, line_no, line) of the .txt files of ``folder``; line_no from 1, within one file."""
    return lines_of(label_files(spark, folder).select("stem", "content")).drop("content")


def lines_of(files: DataFrame) -> DataFrame:
    """``files`` (content and others) with line_no from 1 and line: a row for every line; an empty file has one, blank."""
    split = F.split(F.regexp_replace("content", r"\r?\n$", ""), r"\r?\n")
    return files.select("*", F.posexplode(split).alias("_pos", "line")).withColumn("line_no", F.col("_pos") + 1).select(*files.columns, "line_no", "line")


def labelled_stems(lines: DataFrame) -> DataFrame:
    """Stems of label files with a line that is not blank."""
    return lines.where(F.trim("line") != "").select("stem").distinct()


def image_names(spark: SparkSession, folder: str) -> DataFrame:
    """(name) of the files of ``folder``; contents are not read."""
    return spark.read.format("binaryFile").load(folder).select(F.col("_metadata.file_name").alias("name"))


def class_names(names: list | dict | None) -> dict[str, int]:
    """Ids by name of a dataset description's ``names``: a list, or a mapping from ids."""
    if isinstance(names, dict):
        return {name: int(i) for i, name in names.items()}
    return {name: i for i, name in enumerate(names or [])}


def updated_description(description: dict[str, Any], ids: dict[str, int]) -> dict[str, Any] | None:
    """``description`` with names in the order of their ids and their number; None for an empty map."""
    if not ids:
        return None
    names = sorted(ids, key=ids.__getitem__)
    return {**description, "names": names, "nc": len(names)}


def ledger(spark: SparkSession, path: str, settings: str) -> DataFrame:
    """Finished images of runs with the same ``settings``; none if there is no ledger yet.

    Batches are done when their images are: nothing else is recorded of them. Files that can't be read count as
    not there, so that their images are done again.
    """
    try:
        return spark.read.schema(LEDGER_SCHEMA).option("ignoreCorruptFiles", "true").parquet(path).where(F.col("settings") == settings)
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], LEDGER_SCHEMA)


def record(done: DataFrame, path: str, settings: str) -> None:
    """Append the finished images (stem, batch) to the ledger; files of a failed write are never read."""
    done.select("stem", F.lit(settings).alias("settings"), F.col("batch").cast("int").alias("batch"), F.current_timestamp().alias("finished")).write.mode("append").parquet(path)
