"""The detection loop over all images at once, with the model behind two tables-to-tables functions.

A detector takes requests (image_id, round, tile_idx, prompt) and returns them with ``reply``; a judge takes
(image_id, round, prompt), a verifier takes boxes (image_id, round, tile_idx, pos, label, crop, prompt). A null reply
is a failed call: a detector's finds nothing in that round, a judge's scores 0 and a verifier's keeps its box.
Replies that are no JSON are repaired where they can be. Replies are written out before they are used, so that a task that is run again
does not ask the model again. ``replay`` makes either from recorded replies.
"""

from __future__ import annotations

import contextlib
import json
import threading
import uuid
from collections import OrderedDict
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from boxloom.functions import geometry as g
from boxloom.functions import text as t
from boxloom.functions.repair import repaired
from boxloom.operators import boxes as box_ops
from boxloom.plans.progress import Progress
from boxloom.sources.durable import durable

Model = Callable[[DataFrame], DataFrame]


def replay(recorded: DataFrame, keys: list[str]) -> Model:
    """A model that answers from ``recorded`` (keys, reply); what was not recorded gets no reply."""
    return lambda requests: requests.join(recorded.select(*keys, "reply"), keys, "left")


def with_retries(call: Callable[[str], str], tries: int = 3, base_delay: float = 1.5, sleep: Callable[[float], None] | None = None) -> Callable[[str], str]:
    """``call`` tried up to ``tries`` times, with a longer wait after every failure; then it fails."""
    import time

    def run(prompt: str) -> str:
        for attempt in range(1, tries + 1):
            try:
                return call(prompt)
            except Exception as failure:
                if attempt == tries:
                    raise RuntimeError(f"the model failed {tries} times") from failure
                (sleep or time.sleep)(base_delay * attempt)
        raise ValueError("tries must be positive")

    return run


#: Clients of this Python worker by what they were made for, the least recently used first.
_CLIENTS: OrderedDict[str, Callable[[str], str]] = OrderedDict()
#: Clients that a worker keeps at most.
MOST_CLIENTS = 8


def client_for(make_client: Callable[..., Callable[[str], str]], config: dict | None) -> Callable[[str], str]:
    """This worker's client for ``config``, made when it is first asked for; a new one each time without a config.

    Workers outlive their tasks, so the tasks of one share a client. A client is told apart by what makes it and by its
    configuration, which must be JSON.
    """
    if config is None:
        return make_client()
    key = json.dumps([getattr(make_client, "__module__", ""), getattr(make_client, "__qualname__", repr(make_client)), config], sort_keys=True)
    if key not in _CLIENTS:
        _CLIENTS[key] = make_client(**config)
        while len(_CLIENTS) > MOST_CLIENTS:
            _CLIENTS.popitem(last=False)
    _CLIENTS.move_to_end(key)
    return _CLIENTS[key]


def live(make_client: Callable[..., Callable[[str], str]], workers: int = 16, config: dict | None = None) -> Model:
    """A model that asks a client for every request; ``workers`` bounds what runs at once.

    The client is made once for each task, or with a ``config``, by ``make_client(**config)``, once for each worker.
    A request that fails to the last has a null reply and says why in ``error``; the others go on.
    """

    def model(requests: DataFrame) -> DataFrame:
        def ask(batches):
            call = with_retries(client_for(make_client, config))

            def answer(prompt: str) -> tuple[str | None, str | None]:
                try:
                    return call(prompt), None
                except RuntimeError as failure:
                    return None, f"{failure}: {failure.__cause__}"

            for b in batches:
                said = [answer(p) for p in b["prompt"]]
                yield b.assign(reply=[r for r, _ in said], error=[e for _, e in said])

        schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in requests.schema) + ", reply string, error string"
        return requests.repartition(workers).mapInPandas(ask, schema)

    return model


class Run:
    """A handle on a loop that runs in another thread: ``cancel`` ends it, and the rounds that are done stay.

    Each round's jobs carry the run's tag, so that a round under way is interrupted as well. It is a tag of the context:
    a session's tags are known only to the thread that adds them.
    """

    def __init__(self, spark: SparkSession):
        self.context, self.tag, self.cancelled = spark.sparkContext, f"run-{uuid.uuid4().hex}", threading.Event()

    def cancel(self) -> None:
        self.cancelled.set()
        self.context.cancelJobsWithTag(self.tag)

    @contextlib.contextmanager
    def round(self):
        """Tags the jobs of this thread; errors of a round that was cancelled are swallowed."""
        self.context.addJobTag(self.tag)
        try:
            yield
        except Exception:
            if not self.cancelled.is_set():
                raise
        finally:
            self.context.removeJobTag(self.tag)


def detect_round(images: DataFrame, replies: DataFrame, categories: list[str], tiled: bool, tile: int, overlap: float) -> DataFrame:
    """(image_id, round, tile_idx, pos, label, x1..y2) of one round's replies; tiles are merged by suppression."""
    read = repaired(t.with_detection_json(replies.where("reply is not null"), "reply"), "json", "value")
    read = read.select("image_id", "round", "tile_idx", F.posexplode(t.wrapped_list(F.col("value"), F.col("json"), box_ops.ENTRY)).alias("pos", "item"))
    valid = box_ops.validated(read, "item", categories).where("drop_reason is null").drop("drop_reason")
    if not tiled:
        return valid
    at = box_ops.tiles(images, tile, overlap).join(images.select("image_id", "w", "h"), "image_id")
    moved = valid.join(at, ["image_id", "tile_idx"])
    x1, x2 = g.ordered(*[g.tile_to_original(F.col(c), F.col("tile_x"), F.col("tile_w"), F.col("w")) for c in ("x1", "x2")])
    y1, y2 = g.ordered(*[g.tile_to_original(F.col(c), F.col("tile_y"), F.col("tile_h"), F.col("h")) for c in ("y1", "y2")])
    moved = moved.select("image_id", "round", "tile_idx", "pos", "label", x1.alias("x1"), y1.alias("y1"), x2.alias("x2"), y2.alias("y2"))
    return box_ops.suppress(moved, ["image_id", "round", "label"], ["tile_idx", "pos"], 0.5).drop("rank")


#: A crop is padded by so much of its box, and one under so many pixels is not asked about.
CROP_PAD, CROP_LEAST = 0.2, 10


def verified(images: DataFrame, found: DataFrame, verifier: Model) -> DataFrame:
    """``found`` without the boxes that ``verifier`` denies on a second look at their crops."""
    boxes = found.join(images.select("image_id", "w", "h"), "image_id")
    x1, x2 = g.crop_by_box(F.col("x1"), F.col("x2"), F.col("w"), CROP_PAD)
    y1, y2 = g.crop_by_box(F.col("y1"), F.col("y2"), F.col("h"), CROP_PAD)
    prompt = F.concat(F.lit("Is a '"), "label", F.lit("' in this crop? Answer <present>YES</present> or <present>NO</present>."))
    crops = boxes.select(*found.columns, F.struct(x1.alias("x1"), y1.alias("y1"), x2.alias("x2"), y2.alias("y2")).alias("crop"), prompt.alias("prompt"))
    large = F.expr(f"crop.x2 - crop.x1 >= {CROP_LEAST} and crop.y2 - crop.y1 >= {CROP_LEAST}")
    asked = durable(verifier(crops.where(large)))
    return asked.where(t.said_present(F.col("reply"))).select(*found.columns).union(crops.where(~large).select(*found.columns))


def detect(
    images: DataFrame, detector: Model, judge: Model, categories: list[str], max_rounds: int = 3, threshold: int = 8, tiled: bool = True, tile: int = 512, overlap: float = 0.2,
    verifier: Model | None = None, progress: Callable[[dict], None] | None = None, run: Run | None = None,
) -> tuple[DataFrame, DataFrame]:
    """Rounds (image_id, round, score, feedback, actions, n) and their detections for ``images`` (image_id, w, h).

    Every round asks for all images that have not reached ``threshold`` yet, with the feedback of the round
    before; the loop ends when none is left. After each, ``progress`` is told which round it was, how many images are
    done for good, rate and time left, and gets the round's own rows; ``run`` ends the loop, and a round that was under
    way then is left out.
    """
    spark = images.sparkSession
    watch = Progress(images.count() if progress is not None else 0, progress)
    run = run or Run(spark)
    active = images.select("image_id", F.lit("").alias("feedback"), F.lit("").alias("actions"))
    all_rounds = all_found = None
    for k in range(1, max_rounds + 1):
        if run.cancelled.is_set():
            break
        with run.round():
            if active.isEmpty():
                break
            slots = box_ops.tiles(images, tile, overlap).select("image_id", "tile_idx", "tile_x", "tile_y", "tile_w", "tile_h").join(images.select("image_id", "w", "h"), "image_id") if tiled else images.select("image_id", F.lit(0).alias("tile_idx"), F.lit(0).alias("tile_x"), F.lit(0).alias("tile_y"), F.col("w").alias("tile_w"), F.col("h").alias("tile_h"), "w", "h")
            told = t.feedback_for_tile(F.col("feedback"), *[F.col(c) for c in ("tile_x", "tile_y", "tile_w", "tile_h", "w", "h")])
            prompt = F.concat(F.lit("Find: " + ", ".join(categories)), F.when(told != "", F.concat(F.lit("\nFeedback:\n"), told)).otherwise(""), F.when(~F.upper(F.trim("actions")).isin("", "NONE"), F.concat(F.lit("\nRequired actions:\n"), "actions")).otherwise(""))
            asked = slots.join(active, "image_id").select("image_id", F.lit(k).alias("round"), "tile_idx", prompt.alias("prompt"))
            found = durable(detect_round(images, durable(detector(asked)), categories, tiled, tile, overlap))
            if verifier is not None:
                found = durable(verified(images, found, verifier))
            listed = found.groupBy("image_id").agg(F.count("*").alias("n"), F.to_json(F.array_sort(F.collect_list(F.struct("tile_idx", "pos", "label", "x1", "y1", "x2", "y2")))).alias("boxes"))
            shown = active.select("image_id").join(listed, "image_id", "left").select("image_id", F.lit(k).alias("round"), F.coalesce("n", F.lit(0)).alias("n"), F.concat(F.lit("Judge: "), F.coalesce("boxes", F.lit("[]"))).alias("prompt"))
            reply = t.without_thoughts(F.coalesce("reply", F.lit("")))
            done = durable(judge(shown).select("image_id", "round", t.judge_score(reply).alias("score"), t.judge_feedback(reply).alias("feedback"), t.judge_actions(reply).alias("actions"), "n"))
            over = done.agg(F.count_if((F.col("score") >= threshold) | F.lit(k == max_rounds))).first()[0] if progress is not None else 0
            if run.cancelled.is_set():
                break
            all_rounds = done if all_rounds is None else all_rounds.union(done)
            all_found = found if all_found is None else all_found.union(found)
            active = done.where(F.col("score") < threshold).select("image_id", "feedback", "actions")
            if progress is not None:
                watch.tell(over, round=k, rounds=done, detections=found)
    if all_rounds is None:
        all_rounds = spark.createDataFrame([], "image_id long, round int, score int, feedback string, actions string, n long")
        all_found = spark.createDataFrame([], "image_id long, round int, tile_idx int, pos int, label string, x1 int, y1 int, x2 int, y2 int")
    return all_rounds, all_found
