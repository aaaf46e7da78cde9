"""Operators of the dataset relabelling flow."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from boxloom.functions import geometry as g
from boxloom.operators.ordering import numbered


def image_for_label(labels: DataFrame, images: DataFrame, extensions: list[str]) -> DataFrame:
    """(stem, image): the image of every label stem, by the order of ``extensions``, an exact name first.

    ``labels`` is (stem), ``images`` is (name). Names compare without case. Stems without an image are left out.
    """
    rank = F.array(*[F.lit(e) for e in extensions])
    wanted = labels.select("stem", F.posexplode(rank).alias("rank", "ext")).withColumn("exact", F.concat("stem", "ext"))
    held = images.select(F.col("name").alias("image"), F.lower("name").alias("low"))
    choice = F.struct("rank", (F.col("image") != F.col("exact")).alias("other"), F.col("image").alias("image"))
    return (
        wanted.join(held, F.lower("exact") == F.col("low"))
        .groupBy("stem")
        .agg(F.min(choice).alias("best"))
        .select("stem", F.col("best.image").alias("image"))
    )


def unmatched_labels(labels: DataFrame, images: DataFrame, extensions: list[str]) -> DataFrame:
    """(stem) of the labels without an image, whatever the case of its name."""
    held = images.select(F.lower("name").alias("_low"))
    wanted = labels.select("stem", F.explode(F.array(*[F.lit(e) for e in extensions])).alias("ext"))
    found = wanted.join(held, F.lower(F.concat("stem", "ext")) == F.col("_low"), "left_semi").select("stem")
    return labels.select("stem").distinct().join(found, "stem", "left_anti")


def parsed_lines(lines: DataFrame, line: str) -> DataFrame:
    """``lines`` with malformed (boolean) and cls, xc, yc, bw, bh (double) of a YOLO label line.

    A line that is not five numbers is malformed; so is a blank one.
    """
    # The parts are one column and the numbers five, each worked out once.
    text = F.coalesce(F.col(line), F.lit(""))
    parts = F.split(F.when(text.rlike(r"[^\S ]|  |^ | $"), F.trim(F.regexp_replace(text, r"\s+", " "))).otherwise(text), " ")
    names = ("cls", "xc", "yc", "bw", "bh")
    read = lines.withColumn("_p", parts).select(*lines.columns, F.size("_p").alias("_n"), *[F.get("_p", i).try_cast("double").alias(f"_{n}") for i, n in enumerate(names)])
    bad = (F.col("_n") != 5) | F.greatest(*[F.col(f"_{n}").isNull() for n in names])
    read = read.withColumn("malformed", bad)
    return read.select(*lines.columns, "malformed", *[F.when(~F.col("malformed"), F.col(f"_{n}")).alias(n) for n in names])


def pixel_boxes(boxes: DataFrame) -> DataFrame:
    """``boxes`` (xc, yc, bw, bh and image size w, h) with x1..y2 in pixels and valid (boolean)."""
    x1, x2 = g.yolo_to_pixels(F.col("xc"), F.col("bw"), F.col("w"))
    y1, y2 = g.yolo_to_pixels(F.col("yc"), F.col("bh"), F.col("h"))
    return boxes.select("*", x1.alias("x1"), y1.alias("y1"), x2.alias("x2"), y2.alias("y2")).withColumn("valid", F.expr("x2 > x1 and y2 > y1"))


def class_reply(reply: Column) -> dict[str, Column]:
    """status, class_name and confidence of a classifier's JSON reply (a VARIANT); null is a failed call."""
    name = F.when(F.schema_of_variant(F.try_variant_get(reply, "$.class", "variant")) == "STRING", F.lower(F.trim(F.try_variant_get(reply, "$.class", "string"))))
    is_object = F.coalesce(F.startswith(F.schema_of_variant(reply), F.lit("OBJECT")), F.lit(False))
    good = is_object & F.coalesce(name != "", F.lit(False))
    confidence = F.coalesce(F.try_variant_get(reply, "$.confidence", "double").cast("int"), F.lit(0))
    return {
        "status": F.when(reply.isNull(), "failed").when(good, "classified").otherwise("bad"),
        "class_name": F.when(good, name),
        "confidence": F.when(good, confidence),
    }


def region_reply(reply: Column, value: Column, classes: list[str]) -> dict[str, Column]:
    """class_name, confidence (0-100), reasoning and class_id of a drawn region's ``reply`` and its VARIANT ``value``.

    A failed call, a null or empty reply, has the class error; a reply that is no object has an empty class. Both have
    confidence 0. ``class_id`` is the place in ``classes``, null for any other class, none included.
    """
    failed = F.coalesce(reply, F.lit("")) == ""
    text = lambda field: F.coalesce(F.trim(F.try_variant_get(value, f"$.{field}", "string")), F.lit(""))
    name = F.when(failed, "error").otherwise(F.lower(text("class")))
    at = F.array_position(F.array(*[F.lit(c) for c in classes]), name)
    return {
        "class_name": name,
        "confidence": F.when(failed, 0.0).otherwise(F.coalesce(F.try_variant_get(value, "$.confidence", "double"), F.lit(0.0))),
        "reasoning": F.when(failed, "the call failed").otherwise(text("reasoning")),
        "class_id": F.when(at > 0, (at - 1).cast("int")),
    }


def first_seen_ids(seen: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """(name, id, first_ord): ids in the order of first sight, after the ids of ``known`` (name, id).

    Names are a dictionary, far fewer than their sightings: these are aggregated before any ordering.
    """
    first = seen.groupBy("name").agg(F.min("ord").alias("first_ord"))
    base = F.lit(0)
    if known is not None:
        first = first.join(known.select("name"), "name", "left_anti")
        first = first.crossJoin(F.broadcast(known.agg((F.coalesce(F.max("id"), F.lit(-1)) + 1).alias("base"))))
        base = F.col("base")
    return numbered(first, "first_ord", ["name"], "_no").select("name", (F.col("_no") - 1 + base).cast("long").alias("id"), "first_ord")


def merged_map(old: DataFrame, new: DataFrame) -> DataFrame:
    """(name, id): all of ``old`` and what ``new`` has besides."""
    a, b = old.select("name", F.col("id").alias("old_id")), new.select("name", F.col("id").alias("new_id"))
    return a.join(b, "name", "full_outer").select("name", F.coalesce("old_id", "new_id").alias("id"))


def label_lines(boxes: DataFrame, key: str, order: str, *kept: str) -> DataFrame:
    """(key, n_lines, content, kept): an image's relabelled lines in order, each ended by a newline; all its boxes share ``kept``."""
    line = F.when(F.col("class_id").isNotNull(), F.concat_ws(" ", *[F.col(c).cast("string") for c in ("class_id", "xc", "yc", "bw", "bh")]))
    rows = F.array_sort(F.collect_list(F.when(line.isNotNull(), F.struct(F.col(order).alias("o"), line.alias("line")))))
    return boxes.groupBy(key, *kept).agg(rows.alias("rows")).select(
        key, F.size("rows").alias("n_lines"), F.array_join(F.transform("rows", lambda r: F.concat(r.line, F.lit("\n"))), "").alias("content"), *kept
    )


def run_counters(statuses: DataFrame) -> DataFrame:
    """One row of counts by box status."""
    kinds = ("malformed_line", "empty_crop", "model_call_failed", "bad_response", "classified")
    return statuses.agg(
        F.count("*").alias("boxes_seen"),
        *[F.count_if(F.col("status") == k).alias(f"boxes_{k}") for k in kinds],
        F.count_if((F.col("status") == "classified") & F.col("low_confidence")).alias("boxes_low_confidence"),
    )


def still_to_do(work: DataFrame, done: DataFrame, outputs: DataFrame, key: str, in_place: bool) -> DataFrame:
    """``work`` that neither the ledger ``done`` nor files in ``outputs`` show as done; outputs say nothing if they are the inputs."""
    left = not_done(work, done, key)
    return left if in_place else not_done(left, outputs, key)


def with_presence(listed: DataFrame, held: DataFrame, key: str) -> DataFrame:
    """``listed`` with found (boolean): whether its key is in ``held``. Rows that repeat stay."""
    there = held.select(F.col(key).alias("_held")).distinct()
    return listed.join(there, F.col(key) == F.col("_held"), "left").select(*listed.columns, F.col("_held").isNotNull().alias("found"))


def not_done(work: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """``work`` whose key is not in ``done``."""
    return work.join(done.select(key).distinct(), key, "left_anti")
