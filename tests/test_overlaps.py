"""Overlap pairs by grid cells, and whole overlap matrices."""

from __future__ import annotations

import random
import time

import numpy as np
from pyspark.sql import functions as F

from boxloom.operators import boxes


def brute(rows, threshold):
    out = set()
    for k, a, *p in rows:
        for j, b, *q in rows:
            if k is None or k != j or a is None or b is None or a >= b or None in p or None in q:
                continue
            w, h = min(p[2], q[2]) - max(p[0], q[0]), min(p[3], q[3]) - max(p[1], q[1])
            if w > 0 and h > 0:
                iou = w * h / ((p[2] - p[0]) * (p[3] - p[1]) + (q[2] - q[0]) * (q[3] - q[1]) - w * h)
                if iou > threshold:
                    out.add((k, a, b, round(iou, 9)))
    return out


def run(spark, rows, threshold):
    df = spark.createDataFrame(rows, "g string, id long, x1 double, y1 double, x2 double, y2 double")
    got = boxes.overlapping_pairs(df, ["g"], "id", threshold).collect()
    assert len(got) == len({(r.g, r.a, r.b) for r in got})
    return {(r.g, r.a, r.b, round(r.iou, 9)) for r in got}


def test_pairs_against_all_pairs(spark):
    rng = random.Random(1)
    rows = []
    for g, n, span, size in (("few", 20, 100, 60), ("many", 900, 1000, 50), ("mixed", 400, 300, 5), ("one", 1, 5, 5), ("stacked", 120, 1, 40)):
        for _ in range(n):
            x, y, s = rng.uniform(-span, span), rng.uniform(-span, span), size * rng.choice([0.3, 1, 1, 1, 8])
            rows.append((g, len(rows), x, y, x + s * rng.uniform(0.5, 1), y + s * rng.uniform(0.5, 1)))
    want = brute(rows, 0.1)
    assert run(spark, rows, 0.1) == want and len(want) > 500
    assert run(spark, rows, 0.0) == brute(rows, 0.0)


def test_odd_boxes(spark):
    rows = [("g", 1, 0.0, 0.0, 10.0, 10.0), ("g", 2, 0.0, 0.0, 10.0, 10.0), ("g", 3, 10.0, 0.0, 20.0, 10.0), ("g", 4, 5.0, 5.0, 5.0, 5.0), ("g", 5, 9.0, 9.0, 1.0, 1.0)]
    rows += [("g", 6, None, 0.0, 10.0, 10.0), (None, 7, 0.0, 0.0, 10.0, 10.0), (None, 8, 0.0, 0.0, 10.0, 10.0), ("g", None, 0.0, 0.0, 10.0, 10.0), ("p", 9, 3.0, 3.0, 3.0, 3.0), ("p", 10, 3.0, 3.0, 3.0, 3.0)]
    assert run(spark, rows, 0.0) == {("g", 1, 2, 1.0)}
    assert run(spark, rows[:0] or [("g", 1, None, None, None, None)], 0.0) == set()


def test_a_crowded_group_is_no_all_pairs_join(spark):
    n = 200_000
    df = spark.range(n).select(
        F.lit("one").alias("g"), "id", (F.pmod(F.xxhash64("id"), F.lit(40_000))).cast("double").alias("x1"), (F.pmod(F.xxhash64(F.lit(3), "id"), F.lit(40_000))).cast("double").alias("y1")
    ).withColumns({"x2": F.expr("x1 + 60"), "y2": F.expr("y1 + 60")})
    began = time.perf_counter()
    got = sorted((r.a, r.b) for r in boxes.overlapping_pairs(df, ["g"], "id", 0.5).select("a", "b").collect())
    assert time.perf_counter() - began < 90
    at = np.array(df.select("x1", "y1").toPandas())
    order = np.argsort(at[:, 0], kind="stable")
    x, y = at[order].T
    want, step = [], 1
    while (near := np.flatnonzero(x[step:] - x[:-step] < 60)).size:
        shared = (60 - (x[near + step] - x[near])) * np.clip(60 - np.abs(y[near + step] - y[near]), 0, None)
        hit = near[shared / (7200 - shared) > 0.5]
        want += [(min(i, j), max(i, j)) for i, j in zip(order[hit], order[hit + step])]
        step += 1
    assert got == sorted(want) and len(want) > 1000


def test_a_matrix_is_whole(spark):
    tracks = spark.createDataFrame([(1, 1, 0, 0, 10, 10), (1, 2, 20, 20, 30, 30), (2, 1, 0, 0, 1, 1)], "frame int, track int, x1 int, y1 int, x2 int, y2 int")
    found = spark.createDataFrame([(1, 7, 5, 0, 15, 10), (1, 8, 20, 20, 30, 30), (1, 9, 50, 50, 50, 50), (3, 1, 0, 0, 1, 1)], "frame int, det int, x1 int, y1 int, x2 int, y2 int")
    got = {(r.frame, r.track, r.det): round(r.iou, 6) for r in boxes.overlap_matrix(tracks, found, ["frame"], "track", "det").collect()}
    assert got == {(1, 1, 7): round(1 / 3, 6), (1, 1, 8): 0.0, (1, 1, 9): 0.0, (1, 2, 7): 0.0, (1, 2, 8): 1.0, (1, 2, 9): 0.0}
