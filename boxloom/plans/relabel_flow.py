"""The relabelling flow from labelled images to new label files, in batches that are done once.

A classifier takes requests (stem, line_no, crop, prompt) and returns them with ``reply``, JSON; a null reply is a
failed call. Every batch, or step of several, is an attempt: its files replace whatever is there, and its finished images, classes and
records for review count once the attempt is on record, so that a run that is killed goes on where it stopped.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from collections import Counter
from collections.abc import Callable

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from boxloom.config import Settings
from boxloom.operators import ordering
from boxloom.operators import relabel as ops
from boxloom.plans.detect import Model
from boxloom.plans.progress import Progress
from boxloom.sources.attempts import Attempts
from boxloom.sources.durable import Scratch, durable
from boxloom.sources.labels import lines_of
from boxloom.sources.sinks import write_label_files

IMAGES, CLASSES, REVIEW = "stem string, batch int", "name string, id long", "stem string, records string"
KINDS = ("malformed_line", "empty_crop", "model_call_failed", "bad_response", "classified")
#: What changes the work of a run: runs that differ in these do not go on from one another.
MARKS = ("shuffle", "seed", "start_index", "end_index", "num_samples", "batch_size", "conf_threshold", "inplace_saving")


#: Files of an archive, about, and archives of a run that is one batch, which may have any number of images.
ARCHIVED, ARCHIVES = 10_000, 64


def archives_of(batch_size: int) -> int:
    """Archives of a batch's folder: the same for all runs that go on from one another."""
    return -(-batch_size // ARCHIVED) if batch_size > 0 else ARCHIVES


def settings_key(settings: Settings) -> str:
    """A digest of the settings that runs must share to go on from one another."""
    return hashlib.sha256(json.dumps({m: getattr(settings, m) for m in MARKS}, sort_keys=True).encode()).hexdigest()[:16]


def placed(images: DataFrame, settings: Settings, hold: Callable[[DataFrame], DataFrame] = durable) -> DataFrame:
    """``images`` (stem, content and others) that have a line that is not blank, with row_no from 1 and batch.

    They are in order of their stems, or in a reproducible random one; then the slice is taken, then its head.
    """
    work = images.where(F.col("content").rlike(r"\S")).withColumn("_key", ordering.shuffled_key(F.col("stem"), settings.seed) if settings.shuffle else F.lit(0))
    some = ordering.sliced(work, "_key", ["stem"], settings.start_index or 0, settings.end_index, settings.num_samples)
    return ordering.numbered(some, "_key", ["stem"], hold=hold).withColumn("batch", ordering.batch_of(F.col("row_no"), settings.batch_size)).drop("_key")


def classified(boxes: DataFrame, ask: Model, known: DataFrame, threshold: int, hold: Callable[[DataFrame], DataFrame] = durable) -> DataFrame:
    """(row_no, batch, stem, line_no, xc, yc, bw, bh, status, class_name, confidence, low_confidence) of the ``boxes`` of one step, parsed and in pixels.

    ``hold`` writes out the replies, as they must not be asked for again, and the result. Every box that is whole is asked about once, with the names of the ``known`` classes in the order of their ids.
    """
    names = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("id", "name"))), lambda c: c["name"]), ", ")
    told = known.agg(F.concat(F.lit("Known classes: "), F.when(F.count("*") > 0, names).otherwise("*")).alias("prompt"))
    whole = boxes.where("not malformed and valid")
    requests = whole.select("stem", "line_no", F.struct("x1", "y1", "x2", "y2").alias("crop")).crossJoin(F.broadcast(told))
    reply = ops.class_reply(F.try_parse_json("reply"))
    said = hold(ask(requests).select(F.col("stem").alias("a_stem"), F.col("line_no").alias("a_line"), *[c.alias(n) for n, c in reply.items()]))
    kind = F.when(F.col("malformed"), KINDS[0]).when(~F.col("valid"), KINDS[1]).when(F.col("status") == "bad", KINDS[3]).when(F.col("status") == "classified", KINDS[4]).otherwise(KINDS[2])
    low = F.coalesce((F.col("status") == "classified") & (F.col("confidence") <= threshold), F.lit(False))
    joined = boxes.join(said, (F.col("stem") == F.col("a_stem")) & (F.col("line_no") == F.col("a_line")), "left")
    kept = ("row_no", "batch", "stem", "line_no", "xc", "yc", "bw", "bh")
    return hold(joined.select(*kept, kind.alias("status"), "class_name", "confidence", low.alias("low_confidence")))


def review_records(boxes: DataFrame) -> DataFrame:
    """(stem, records): the boxes of low confidence of each image that has any, as JSON in order of their lines."""
    record = F.struct(F.col("class_name").alias("class"), "confidence", F.array("xc", "yc", "bw", "bh").alias("bbox"))
    rows = F.array_sort(F.collect_list(F.struct("line_no", record.alias("r"))))
    return boxes.where("low_confidence").groupBy("stem").agg(F.to_json(F.transform(rows, lambda r: r["r"])).alias("records"))


def relabel(
    images: DataFrame, ask: Model, labels: str, state: str, settings: Settings, known: DataFrame | None = None,
    progress: Callable[[dict], None] | None = None, stop: Callable[[], bool] | None = None, together: int | None = 1, packed: bool = False,
) -> DataFrame:
    """Relabel ``images`` (stem, w, h in pixels, content of the label file); counters of this run come back as one row.

    New files go to the folder ``labels``, below a folder for each batch unless saved in place or in one batch, and if
    ``packed`` into archives there, which millions of images need; ``state`` is the folder of the run's tables. Images whose
    size is null can't be read: they are counted, not written and not recorded, and so tried again by a later run.
    ``known`` (name, id) are the classes to begin with. Stems must not repeat.

    A step does ``together`` batches, or all that are left if that is None, as one attempt: the model is told the classes
    known before the step, and ids are in order of first sight all the same. Steps of more batches are for models that
    don't need the classes of the batch before, as work grows with the images then, not with the batches. Between steps
    ``progress`` is told, with the step's last batch, and where ``stop`` says so the run ends. What a step works with is
    written out once and deleted when the step is done.
    """
    if packed and settings.inplace_saving:
        raise ValueError("files that are saved in place can't be packed")
    spark = images.sparkSession
    attempts = Attempts(spark, state, settings_key(settings))
    counts: Counter = Counter()
    with Scratch(spark) as scratch:
        with Scratch(spark) as ranges:
            counted = Observation()
            work = placed(images, settings, ranges.held).observe(counted, F.count(F.lit(1)).alias("n"))
            done = attempts.rows("images", IMAGES) if settings.auto_resume else spark.createDataFrame([], IMAGES)
            left = scratch.held(ops.not_done(work, done, "stem"))
        watch = Progress(counted.get.get("n", 0), progress)
        readable = F.expr("w is not null and h is not null")
        totals = {r.batch: (r.n, r.readable) for r in left.groupBy("batch").agg(F.count("*").alias("n"), F.count_if(readable).alias("readable")).collect()}
        watch.done = watch.total - sum(n for n, _ in totals.values())
        todo = sorted(totals)
        size = len(todo) if together is None else together
        for at in range(0, len(todo), max(1, size)):
            if stop is not None and stop():
                break
            batches = todo[at : at + size]
            images_in, readable_in = (sum(totals[b][k] for b in batches) for k in (0, 1))
            if not readable_in:
                watch.tell(0, batch=batches[-1], boxes=0, failed=images_in)
                continue
            seen = left.where(F.col("batch").between(batches[0], batches[-1])).where(readable)
            with Scratch(spark) as own:
                written, found = _step(seen, [b for b in batches if totals[b][1]], ask, labels, attempts, settings, known, packed, watch, own.held)
            counts.update(found)
            watch.tell(written.get["units"], batch=batches[-1], boxes=written.get["boxes"] or 0, failed=images_in - written.get["units"])
    names = ("boxes_seen", *(f"boxes_{k}" for k in KINDS), "boxes_low_confidence")
    return spark.range(1).select(*[F.lit(counts[n]).cast("long").alias(n) for n in names])


def _step(
    seen: DataFrame, batches: list[int], ask: Model, labels: str, attempts: Attempts, settings: Settings, known: DataFrame | None,
    packed: bool, watch: Progress, hold: Callable[[DataFrame], DataFrame],
) -> tuple[Observation, dict]:
    """One attempt at ``batches``, whose images that can be read are ``seen``: what was written, and the counts of its boxes."""
    attempt = uuid.uuid4().hex
    parsed = ops.parsed_lines(lines_of(seen.select("row_no", "batch", "stem", "w", "h", "content")).drop("content"), "line")
    before = attempts.rows("classes", CLASSES)
    if known is not None:
        before = ops.merged_map(known.select("name", F.col("id").cast("long").alias("id")), before)
    before = durable(before.groupBy("name").agg(F.min("id").alias("id")))
    boxes = classified(hold(ops.pixel_boxes(parsed).drop("line", "cls", "w", "h")), ask, before, settings.conf_threshold, hold)
    sighted = boxes.where("status = 'classified'").select(F.col("class_name").alias("name"), F.struct("row_no", "line_no").alias("ord"))
    new = durable(ops.first_seen_ids(sighted, before).select("name", "id"))
    ids = before.select("name", "id").union(new).select(F.col("name").alias("c_name"), F.col("id").alias("class_id"))
    numbered = boxes.join(ids, F.col("class_name") == F.col("c_name"), "left").withColumn("class_id", F.when(F.col("status") == "classified", F.col("class_id")))
    files = ops.label_lines(numbered, "stem", "line_no", "batch").select("stem", "content", "batch")
    boxes_in = F.sum(F.size(F.split("content", "\n")) - 1)
    batched = not settings.inplace_saving and settings.batch_size > 0
    if packed:
        files, written = watch.watched(files, boxes=boxes_in)
        write_label_files(files, labels, batched, archives_of(settings.batch_size))
    else:
        # Files are small and many: they are dealt by their number, most of a batch to one task.
        files = files.repartitionByRange(int(files.sparkSession.conf.get("spark.sql.shuffle.partitions")), "batch", "stem")
        files, written = watch.watched(files, boxes=boxes_in)
        write_label_files(files, labels, batched)
    attempts.add("classes", new, attempt)
    attempts.add("review", review_records(boxes), attempt)
    attempts.add("images", seen.select("stem", "batch"), attempt)
    attempts.record(attempt, *batches)
    return written, ops.run_counters(boxes).first().asDict()
