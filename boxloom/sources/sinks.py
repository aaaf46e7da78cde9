"""Writers of results, all through Spark's own commit protocol."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from boxloom.operators import rounds as ops
from boxloom.sources.label_source import LabelFiles


def write_best(rounds: DataFrame, detections: DataFrame, path: str) -> None:
    """One JSON line for each image: its best round, score and that round's detections, none as null."""
    best = ops.best_rounds(rounds)
    box = F.struct("label", F.array("x1", "y1", "x2", "y2").alias("bbox_2d"))
    listed = detections.groupBy(F.col("image_id").alias("d_image"), F.col("round").alias("d_round")).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("tile_idx", "pos", box.alias("d")))), lambda r: r.d).alias("detections")
    )
    out = best.join(listed, (F.col("image_id") == F.col("d_image")) & (F.col("round") == F.col("d_round")), "left").select("image_id", "round", "score", "detections")
    out.write.mode("overwrite").option("ignoreNullFields", "false").json(path)


def write_history(rounds: DataFrame, path: str) -> None:
    """One JSON line for each image with its rounds in order; raw replies are left out."""
    ops.history(rounds, [c for c in rounds.columns if c not in ("image_id", "reply")]).write.mode("overwrite").json(path)


def write_label_files(files: DataFrame, path: str, batched: bool, archives: int | None = None) -> None:
    """A file <stem>.txt for each row (stem, content, and batch if ``batched``, whose folder it goes to); other files stay.

    An image without boxes has an empty file. Stems must not repeat within a folder. With ``archives`` a folder's files are
    packed into so many archives, by their stems, of which each is one task's; a folder keeps to the number it began with.
    """
    spark = files.sparkSession
    spark.dataSource.register(LabelFiles)
    columns = ["stem", "content"] + ["batch"] * batched
    if archives is not None:
        keys = ["batch"] * batched + ["archive"]
        files = files.withColumn("archive", F.pmod(F.crc32(F.col("stem").cast("binary")), F.lit(archives)).cast("int"))
        files = files.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), *keys).sortWithinPartitions(*keys)
        columns.append("archive")
    files.select(*columns).write.format("label_files").mode("append").save(path)


def write_review(records: DataFrame, path: str) -> None:
    """Records of low confidence as JSON lines."""
    records.write.mode("overwrite").json(path)


def write_summary(summary: DataFrame, path: str) -> None:
    summary.write.mode("overwrite").json(path)
