from __future__ import annotations

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from boxloom.functions import pixels as px
from boxloom.operators import relabel, rounds
from boxloom.plans import detect as loop
from boxloom.streaming import folds, tracking


def test_rounds(spark):
    rows = [(1, 1, 3, "a"), (1, 2, 9, "b"), (1, 3, 9, "c"), (2, 1, 0, "d"), (2, 2, 0, "e"), (3, 1, 8, "f"), (3, 2, 10, "g")]
    df = spark.createDataFrame(rows, "image_id int, round int, score int, feedback string")
    assert sorted((r.image_id, r["round"]) for r in rounds.best_rounds(df).collect()) == [(1, 2), (2, 1), (3, 2)]
    assert sorted((r.image_id, r["round"]) for r in rounds.until_good(df, 8).collect()) == [(1, 1), (1, 2), (2, 1), (2, 2), (3, 1)]
    h = {r.image_id: json.loads(r.history) for r in rounds.history(df, ["round", "score", "feedback"]).collect()}
    assert h[2] == [{"round": 1, "score": 0, "feedback": "d"}, {"round": 2, "score": 0, "feedback": "e"}]


def test_late_results_are_dropped(spark):
    df = spark.createDataFrame([("s", k, f) for k, f in enumerate([3, 1, 5, 5, 4, 8])], "s string, k int, f int")
    assert sorted(r.f for r in rounds.late_dropped(df, "s", "k", "f").collect()) == [3, 5, 8]


def test_images_of_labels_by_extension_and_case(spark):
    labels = spark.createDataFrame([("a",), ("b",), ("c",), ("D",)], "stem string")
    images = spark.createDataFrame([("a.png",), ("a.JPG",), ("b.jpg",), ("B.JPG",), ("d.jpeg",)], "name string")
    got = sorted(tuple(r) for r in relabel.image_for_label(labels, images, [".jpg", ".jpeg", ".png"]).collect())
    assert got == [("D", "d.jpeg"), ("a", "a.JPG"), ("b", "b.jpg")]


def test_label_lines(spark):
    df = spark.createDataFrame([(k, s) for k, s in enumerate(["0 .5 .5 .2 .2", "", "1 2 3 4", "a 1 1 1 1", "  3\t.1 .1  .9 .9 ", None, "1 2 3 4 5 6"])], "k int, s string")
    got = [(r.k, r.malformed, r.cls) for r in relabel.parsed_lines(df, "s").orderBy("k").collect()]
    assert got == [(0, False, 0.0), (1, True, None), (2, True, None), (3, True, None), (4, False, 3.0), (5, True, None), (6, True, None)]


def test_class_ids_continue_after_the_highest(spark):
    seen = spark.createDataFrame([("x", 9), ("y", 2), ("x", 1), ("k", 0)], "name string, ord int")
    known = spark.createDataFrame([("k", 7)], "name string, id int")
    assert sorted((r.name, r.id) for r in relabel.first_seen_ids(seen, known).collect()) == [("x", 8), ("y", 9)]
    assert sorted((r.name, r.id) for r in relabel.first_seen_ids(seen).collect()) == [("k", 0), ("x", 1), ("y", 2)]


def test_files_without_boxes_are_empty(spark):
    df = spark.createDataFrame([("a", 1, 3, 0.5, 0.5, 0.1, 0.1), ("a", 2, None, 0.5, 0.5, 0.1, 0.1), ("b", 1, None, 0.5, 0.5, 0.1, 0.1)], "stem string, o int, class_id int, xc double, yc double, bw double, bh double")
    got = {r.stem: (r.n_lines, r.content) for r in relabel.label_lines(df, "stem", "o").collect()}
    assert got == {"a": (1, "3 0.5 0.5 0.1 0.1\n"), "b": (0, "")}


def frame(session, k, *boxes):
    return {"session": session, "frame_id": k, "boxes": json.dumps([list(b) for b in boxes])}


def run(step, rows, state=None):
    state, out = state or tracking.start(), []
    for r in rows:
        state, more = step(state, r)
        out.append([(o["track_id"], o["label"]) for o in more])
    return out, state


def test_a_track_follows_its_box_and_comes_back():
    a = lambda d, s=0.9: (100 + d, 100 + d, 200 + d, 200 + d, "a", s)
    out, state = run(tracking.byte_track, [frame(1, 0, a(0)), frame(1, 1, a(3)), frame(1, 2), frame(1, 3, a(6)), frame(1, 4, a(9, 0.2)), frame(1, 5, a(12, 0.05))])
    assert out == [[(1, "a")], [(1, "a")], [], [(1, "a")], [(1, "a")], []]
    assert state["lost"][0]["since"] == 1


def test_new_strong_boxes_start_tracks_by_their_own_index():
    a, b, c = (0, 0, 50, 50, "a"), (300, 300, 380, 380, "b"), (600, 600, 700, 700, "c")
    out, _ = run(tracking.byte_track, [frame(1, 0, b), frame(1, 1, a, b, c)])
    assert out[1] == [(1, "b"), (2, "a"), (3, "c")]


def test_lost_tracks_expire():
    out, state = run(tracking.byte_track, [frame(1, 0, (0, 0, 50, 50, "a"))] + [frame(1, k) for k in range(1, 40)])
    assert state["lost"] == [] and state["tracked"] == []


def test_merging_takes_the_best_free_track():
    a, moved, far = (0, 0, 100, 100, "a"), (5, 5, 100, 100, "a"), (500, 500, 510, 510, "f")
    out, state = run(tracking.merge_track, [frame(1, 0, a, far), frame(1, 1, moved, moved), frame(1, 2, (0, 0, 3, 3, "tiny")), frame(1, 3, far)])
    assert out == [[(1, "a"), (2, "f")], [(1, "a"), (3, "a")], [(4, "tiny")], [(2, "f")]]
    assert tracking.tracker("None (Pass-through)") is tracking.pass_through and tracking.tracker("ByteTrack") is tracking.byte_track


def test_pairs_are_greedy_with_stable_ties():
    pairs, rows, cols = tracking.pair_up(np.array([[0.9, 0.8, 0.0], [0.9, 0.1, 0.7]]), 0.2)
    assert pairs == [(0, 0), (1, 2)] and rows == [] and cols == [1]
    assert tracking.pair_up(np.zeros((0, 2)), 0.2) == ([], [], [0, 1])


def test_gate_asks_when_fresh_or_stale():
    step, state, asked = tracking.make_gate(1.0, 0.25), tracking.gate_start(), []
    for k in range(12):
        state, out = step(state, {"session": 1, "frame_id": k, "ts": k * 0.1})
        asked.append((out[0]["submitted"], out[0]["applied"]))
    assert [k for k, a in enumerate(asked) if a[0]] == [0, 3, 6, 9] and [k for k, a in enumerate(asked) if a[1]] == [3, 6, 9]
    state, out = step(state, {"session": 1, "frame_id": 13, "ts": 1.2, "reset": True})
    assert out[0]["submitted"] and state["applied"] == -1


def test_stream_equals_batch(spark, tmp_path):
    rows = [(s, k, json.dumps([[10 * s + k, 10, 60 + k, 70, "a", 0.3 + (k % 7) / 10], [200, 200 + k, 260, 270, "b"]])) for s in range(3) for k in range(12)]
    schema = "session long, frame_id long, boxes string"
    batch = folds.fold_batch(spark.createDataFrame(rows, schema), "session", ["frame_id"], tracking.start, tracking.byte_track, tracking.TRACK_SCHEMA).collect()
    for part, cut in enumerate(((0, 5), (5, 6), (6, 12))):
        spark.createDataFrame([r for r in rows if cut[0] <= r[1] < cut[1]] + ([(0, 2, "[]")] if part else []), schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    out = folds.fold_stream(stream, "session", ["frame_id"], tracking.start, tracking.byte_track, tracking.TRACK_SCHEMA)
    q = out.writeStream.format("memory").queryName("tracked").outputMode("append").option("checkpointLocation", f"{tmp_path}/ckpt").trigger(availableNow=True).start()
    q.awaitTermination(120)
    key = lambda r: (r.session, r.frame_id, r.track_id, r.label, round(r.ymin, 6), round(r.xmax, 6), r.hits)
    assert sorted(map(key, spark.table("tracked").collect())) == sorted(map(key, batch))


def test_loop_stops_by_image_and_uses_feedback(spark):
    images = spark.createDataFrame([(1, 1000, 600), (2, 400, 400)], "image_id long, w int, h int")
    box = lambda *b: json.dumps([{"label": "a", "bbox_2d": list(b)}])
    asked = []

    def detector(requests):
        asked.append([(r.image_id, r.tile_idx, r.prompt) for r in requests.collect()])
        return requests.withColumn("reply", F.when(F.col("tile_idx") < 2, F.lit(box(100, 100, 300, 300))))

    def judge(requests):
        return requests.withColumn("reply", F.concat(F.lit("<score>"), F.when(F.col("image_id") == 2, 9).otherwise(F.col("round") + 2).cast("string"), F.lit("</score><feedback>miss (10,10)\nall</feedback><actions>NONE</actions>")))

    done, found = loop.detect(images, detector, judge, ["a"], max_rounds=3, threshold=8)
    assert sorted((r.image_id, r["round"], r.score) for r in done.collect()) == [(1, 1, 3), (1, 2, 4), (1, 3, 5), (2, 1, 9)]
    assert {i for i, *_ in asked[1]} == {1} and len(asked) == 3
    first = next(p for i, t, p in asked[1] if t == 0)
    assert first.endswith("Feedback:\nmiss (20,20)\nall") or "miss (" in first
    boxes = [(r.x1, r.y1, r.x2, r.y2) for r in found.where("image_id = 2").collect()]
    assert boxes == [(100, 100, 300, 300)]
    assert len(found.where("image_id = 1 and round = 1").collect()) == 2
    none, _ = loop.detect(images.where("false"), detector, judge, ["a"])
    assert none.count() == 0


def test_retries_wait_longer_each_time():
    waits, calls = [], []

    def flaky(prompt):
        calls.append(prompt)
        if len(calls) < 3:
            raise OSError("down")
        return "ok"

    assert loop.with_retries(flaky, sleep=waits.append)("p") == "ok" and waits == [1.5, 3.0]
    with pytest.raises(RuntimeError):
        loop.with_retries(lambda p: 1 / 0, sleep=waits.append)("p")


def test_live_model_asks_for_every_row(spark):
    req = spark.createDataFrame([(1, "a"), (2, "b")], "image_id long, prompt string")
    got = loop.live(lambda: lambda p: p.upper(), workers=2)(req).collect()
    assert sorted((r.image_id, r.reply) for r in got) == [(1, "A"), (2, "B")]


def test_pixels():
    rng = np.random.default_rng(0)
    img = rng.integers(0, 256, (40, 60, 3), dtype=np.uint8)
    flat = np.full((40, 60, 3), 90, np.uint8)
    assert px.blur_score(flat) == 0 < px.blur_score(img) and px.edge_ratio(flat) == 0 and px.texture(flat) == 0
    assert px.changed_ratio(img, img) == 0 and px.changed_ratio(img, None) == 1 and px.changed_ratio(flat, flat + np.uint8(100)) == 1
    tinted = np.stack([np.full((9, 9), v) for v in (50, 100, 150)], -1).astype(np.uint8)
    assert np.ptp(px.white_balance(tinted).reshape(-1, 3).mean(0)) <= 1
    assert px.stretch(np.array([[[10, 20, 30]], [[110, 20, 130]]], np.uint8)).tolist() == [[[0, 20, 0]], [[255, 20, 255]]]
    box = px.letterbox(np.full((10, 20, 3), 200, np.uint8), 40, 40)
    assert box.shape == (40, 40, 3) and (box[:10] == 0).all() and (box[10:30] == 200).all()
    assert (px.resize(flat, 17, 5) == 90).all() and (px.bilateral(flat[..., 0]) == 90).all() and (px.unsharp(flat[..., 0]) == 90).all()
    assert px.equalise(rng.integers(100, 120, (64, 64), dtype=np.uint8)).std() > 6


def test_regions_are_connected_parts():
    mask = np.zeros((12, 14), bool)
    mask[1:3, 1:4] = mask[3, 4] = mask[8:11, 9:12] = True
    assert px.regions(mask).tolist() == [[1, 1, 5, 4], [9, 8, 12, 11]]
    layer = np.zeros((5, 5, 4), np.uint8)
    back = np.full((5, 5, 3), 10, np.uint8)
    layer[1, 1, 3] = 200
    assert px.stroke_mask(layer, None, back).sum() == 1
    comp = back.copy()
    comp[2, 2] = 60
    assert px.stroke_mask(np.zeros((5, 5, 4), np.uint8), comp, back).sum() == 1


def test_a_call_that_fails_to_the_last_ends_no_job(spark, monkeypatch):
    monkeypatch.setattr("time.sleep", lambda s: None)

    def client():
        def call(p):
            if "1" in p:
                raise OSError("gone")
            return "<present>no</present>"

        return call

    req = spark.createDataFrame([(1, "box 1"), (2, "box 2")], "id int, prompt string")
    monkeypatch.setattr(loop, "with_retries", lambda call, make=loop.with_retries: make(call, sleep=lambda s: None))
    got = {r.id: (r.reply, r.error) for r in loop.live(client, workers=1)(req).collect()}
    assert got[2] == ("<present>no</present>", None) and got[1][0] is None and "gone" in got[1][1]


def test_second_look_drops_what_is_denied(spark):
    images = spark.createDataFrame([(1, 1000, 1000)], "image_id long, w int, h int")
    found = spark.createDataFrame([(1, 1, 0, k, "A", 10 * k, 10, x2, 900) for k, x2 in enumerate((500, 600, 700, 31))], "image_id long, round int, tile_idx int, pos int, label string, x1 int, y1 int, x2 int, y2 int")
    said = spark.createDataFrame([(0, "<present>NO</present>"), (1, "yes"), (3, "<present>NO</present>")], "pos int, reply string")
    assert sorted(r.pos for r in loop.verified(images, found, loop.replay(said, ["pos"])).collect()) == [1, 2, 3]


def test_null_stems_have_null_names(spark):
    from boxloom.operators import ordering

    df = spark.createDataFrame([(1, None), (2, None), (3, "a"), (4, "a"), (5, "a_1")], "k int, s string")
    got = {r.k: r.uniq_stem for r in ordering.unique_stems(df, "s", ["k"]).collect()}
    assert got == {1: None, 2: None, 3: "a", 4: "a_1", 5: "a_1_1"}
