"""Progress, cancelling and clients of the detection loop."""

from __future__ import annotations

import json
import threading
import time

import pytest
from pyspark.sql import functions as F

from boxloom.plans import detect as loop
from boxloom.plans import models

BOX = json.dumps([{"label": "a", "bbox_2d": [100, 100, 300, 300]}])


def images(spark, n=3):
    return spark.createDataFrame([(k, 400, 400) for k in range(n)], "image_id long, w int, h int")


def detector(requests):
    return requests.withColumn("reply", F.lit(BOX))


def judge(requests):
    score = F.when(F.col("image_id") == 0, 9).otherwise(F.col("round"))
    return requests.withColumn("reply", F.concat(F.lit("<score>"), score.cast("string"), F.lit("</score><feedback>f</feedback>")))


def rounds(df):
    return sorted((r.image_id, r["round"]) for r in df.collect())


def test_progress_is_told_after_every_round_and_may_fail(spark):
    told = []

    def progress(row):
        told.append((row["round"], row["done"], row["total"], rounds(row["rounds"]), row["detections"].count()))
        raise RuntimeError("no matter")

    done, _ = loop.detect(images(spark), detector, judge, ["a"], max_rounds=2, tiled=False, progress=progress)
    assert rounds(done) == [(0, 1), (1, 1), (1, 2), (2, 1), (2, 2)]
    assert told == [(1, 1, 3, [(0, 1), (1, 1), (2, 1)], 3), (2, 3, 3, [(1, 2), (2, 2)], 2)]


def test_a_run_cancelled_between_rounds_keeps_those_that_are_done(spark):
    run = loop.Run(spark)
    done, found = loop.detect(images(spark), detector, judge, ["a"], max_rounds=3, tiled=False, progress=lambda row: run.cancel(), run=run)
    assert rounds(done) == [(0, 1), (1, 1), (2, 1)] and found.count() == 3
    none, _ = loop.detect(images(spark), detector, judge, ["a"], run=run)
    assert none.count() == 0 and len(spark.sparkContext.getJobTags()) == 0


def test_a_round_under_way_is_interrupted(spark):
    run, began = loop.Run(spark), threading.Event()

    def slow(requests):
        if requests.first()["round"] == 1:
            return detector(requests)

        def wait(batches):
            for b in batches:
                time.sleep(120)
                yield b.assign(reply=BOX)

        began.set()
        return requests.mapInPandas(wait, "image_id long, round int, tile_idx int, prompt string, reply string")

    threading.Thread(target=lambda: (began.wait(100), time.sleep(3), run.cancel())).start()
    start = time.monotonic()
    done, found = loop.detect(images(spark), slow, judge, ["a"], max_rounds=3, tiled=False, run=run)
    assert rounds(done) == [(0, 1), (1, 1), (2, 1)] and found.count() == 3 and time.monotonic() - start < 110


def test_other_failures_are_not_swallowed(spark):
    def broken(requests):
        raise OSError("no model")

    with pytest.raises(OSError):
        loop.detect(images(spark), broken, judge, ["a"], tiled=False)


def make(url, made=[]):  # noqa: B006
    made.append(url)
    return lambda prompt: f"{url} {len(made)} {prompt}"


def test_a_worker_keeps_a_client_for_each_configuration(spark):
    loop._CLIENTS.clear()
    a = loop.client_for(make, {"url": "a"})
    assert loop.client_for(make, {"url": "a"}) is a and loop.client_for(make, {"url": "b"}) is not a
    assert loop.client_for(lambda: a, None) is a and len(loop._CLIENTS) == 2
    for k in range(20):
        loop.client_for(make, {"url": str(k)})
    assert len(loop._CLIENTS) == loop.MOST_CLIENTS and loop.client_for(make, {"url": "a"}) is not a
    loop._CLIENTS.clear()
    asked = spark.createDataFrame([(k, "p") for k in range(8)], "image_id long, prompt string")
    said = {r.reply for r in loop.live(make, workers=4, config={"url": "u"})(asked).collect()}
    assert said and all(s.startswith("u ") and s.endswith(" p") for s in said)


def test_models_by_name(spark):
    said = spark.createDataFrame([(1, "r")], "image_id long, reply string")
    asked = spark.createDataFrame([(1, "p"), (2, "p")], "image_id long, prompt string")
    assert sorted(map(tuple, models.model("replay", said, ["image_id"])(asked).collect())) == [(1, "p", "r"), (2, "p", None)]
    models.register("same", lambda word: lambda requests: requests.withColumn("reply", F.lit(word)))
    assert "same" in models.known() and {r.reply for r in models.model("same", word="w")(asked).collect()} == {"w"}
    with pytest.raises(ValueError):
        models.register("same", models.detect.live)
    with pytest.raises(ValueError):
        models.model("other")
