"""Operators on the rounds of a detection loop and on logs of image states."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from boxloom.functions import text as t


def best_rounds(rounds: DataFrame) -> DataFrame:
    """The row of each image with the highest score, the earliest of equals; scores under 0 never win.

    One aggregation, with partial results before the shuffle.
    """
    key = F.struct("score", (-F.col("round")).alias("neg_round"))
    rest = [c for c in rounds.columns if c not in ("image_id", "score", "round")]
    return (
        rounds.where("score >= 0")
        .groupBy("image_id")
        .agg(F.max_by(F.struct("round", "score", *rest), key).alias("best"))
        .select("image_id", *[F.col(f"best.{c}") for c in ["round", "score", *rest]])
    )


def until_good(rounds: DataFrame, threshold: int) -> DataFrame:
    """Rounds up to and including each image's first with a score of ``threshold`` or more."""
    before = Window.partitionBy("image_id").orderBy("round").rowsBetween(Window.unboundedPreceding, -1)
    return rounds.withColumn("_done", F.max(F.col("score") >= threshold).over(before)).where("not coalesce(_done, false)").drop("_done")


def carried(rounds: DataFrame, columns: list[str]) -> DataFrame:
    """``rounds`` with prev_<column> of the round before."""
    w = Window.partitionBy("image_id").orderBy("round")
    return rounds.select("*", *[F.lag(c).over(w).alias(f"prev_{c}") for c in columns])


def history(rounds: DataFrame, fields: list[str]) -> DataFrame:
    """(image_id, n_rounds, history): the fields of an image's rounds in order, as a JSON array."""
    return rounds.groupBy("image_id").agg(
        F.count("*").alias("n_rounds"),
        F.to_json(F.array_sort(F.collect_list(F.struct("round", *[f for f in fields if f != "round"])))).alias("history"),
    )


def last_states(log: DataFrame, key: str, order: str, state: str) -> DataFrame:
    """(key, state, n_events): the state of each key's last event."""
    return log.groupBy(key).agg(F.max_by(state, order).alias("state"), F.count("*").alias("n_events"))


def late_dropped(arrivals: DataFrame, key: str, order: str, frame: str) -> DataFrame:
    """Arrivals whose frame is above every frame of their key that arrived before."""
    w = Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return arrivals.withColumn("_last", F.coalesce(F.max(frame).over(w), F.lit(-1))).where(F.col(frame) > F.col("_last")).drop("_last")


def progress(done: Column, total: Column) -> Column:
    """Percent that a batch has reached, 90 at its end; the rest is for its output."""
    return F.coalesce(F.try_divide(done, total) * 90, F.lit(0.0)).cast("int")


def applied_actions(detections: DataFrame, actions: DataFrame) -> DataFrame:
    """``detections`` (image_id, det_idx from 1, label, x1..y2) after each image's ``actions`` (image_id, text of lines).

    Of several lines on one box the last of each kind counts, and a removal beats all. Added boxes are numbered on
    after the image's last, in the order of their lines, also where it had none. Lines of no known form, numbers
    without a box and corners that are no numbers change nothing; corners are whole numbers, half to even.
    """
    lines = actions.select("image_id", F.posexplode(F.split("actions", "\n")).alias("pos", "line"))
    read = lines.select("image_id", "pos", *[c.alias(n) for n, c in t.action(F.col("line")).items()])
    read = read.where("verb is not null and not exists(corners, x -> x is null) or verb is not null and corners is null")
    asked = read.where("verb <> 'ADD'").groupBy(F.col("image_id").alias("a_image"), F.col("box").alias("a_box")).agg(
        F.bool_or(F.col("verb") == "REMOVE").alias("gone"),
        F.max_by("label", F.when(F.col("verb") == "RELABEL", F.col("pos"))).alias("new_label"),
        F.max_by("corners", F.when(F.col("verb") == "MODIFY", F.col("pos"))).alias("new_corners"),
    )
    names = ("x1", "y1", "x2", "y2")
    held = detections.select("image_id", "det_idx", "label", *names).join(asked, (F.col("image_id") == F.col("a_image")) & (F.col("det_idx") == F.col("a_box")), "left")
    left = held.where(~F.coalesce("gone", F.lit(False))).select(
        "image_id", "det_idx", F.coalesce("new_label", "label").alias("label"), *[F.coalesce(F.bround(F.get("new_corners", k)).cast("int"), F.col(c)).alias(c) for k, c in enumerate(names)]
    )
    last = detections.groupBy(F.col("image_id").alias("l_image")).agg(F.max("det_idx").alias("last"))
    added = read.where("verb = 'ADD'").join(last, F.col("image_id") == F.col("l_image"), "left")
    number = F.row_number().over(Window.partitionBy("image_id").orderBy("pos")) + F.coalesce("last", F.lit(0))
    return left.union(added.select("image_id", number.alias("det_idx"), "label", *[F.bround(F.get("corners", k)).cast("int").alias(c) for k, c in enumerate(names)]))
