"""The live session: stream against batch over restarts, and what its timers do."""

from __future__ import annotations

import json
import time

import pytest

from boxloom.plans import tracking_queries
from boxloom.streaming import live
from tests.oracle import SF_DIR

GATE = {"refresh": 1.0, "latency": 0.35}


def ticks(sessions=4, frames=40):
    """Ticks whose algorithm changes, most of them without boxes, some with a reset."""
    names = ["ByteTrack", "CSRT (TrackerCSRT)", "None (Pass-through)"]
    out = []
    for s in range(sessions):
        for k in range(frames):
            boxes = json.dumps([[10 * s + k, 10, 60 + k, 70, "a", 0.3 + (k % 7) / 10], [200, 200 + k, 260, 270, "b"]][: 1 + k % 2]) if k % 3 == 0 else None
            out.append((s, k, k * 0.1 + s, names[(k // 13 + s) % 3], boxes, k == 30 and s == 1))
    return out


def key(r):
    return tuple(round(v, 6) if isinstance(v, float) else v for v in r)


def folder(spark, path, rows, part):
    spark.createDataFrame(rows, live.TICKS).coalesce(1).write.mode("append").parquet(f"{path}/in")
    return spark.readStream.schema(live.TICKS).parquet(f"{path}/in")


def test_a_restarted_stream_equals_the_batch(spark, tmp_path):
    rows = ticks()
    want = sorted(map(key, live.session_batch(spark.createDataFrame(rows, live.TICKS), **GATE).collect()), key=str)
    got = None
    for part, (low, high) in enumerate(((0, 7), (7, 8), (8, 29), (29, 40))):
        stream = folder(spark, tmp_path, [r for r in rows if low <= r[1] < high], part)
        got = live.run_to_table(live.session_stream(stream, **GATE), str(tmp_path), 180)
    assert sorted(map(key, got.collect()), key=str) == want
    assert {r.kind for r in got.collect()} == {"gate", "track"} and got.where("kind = 'track'").count() > 100
    folder(spark, tmp_path, [(0, 39, 9.0, "ByteTrack", "[]", False), (9, 0, 0.0, None, None, None)], 9)
    got = live.run_to_table(live.session_stream(spark.readStream.schema(live.TICKS).parquet(f"{tmp_path}/in"), **GATE), str(tmp_path), 180)
    assert [tuple(r)[:3] for r in got.where("kind = 'late'").collect()] == [(0, 39, "late")]
    assert got.where("session = 9").count() == 1


def test_timers_give_up_detections_and_forget_sessions(spark, tmp_path):
    stream = folder(spark, tmp_path, [(1, 0, 0.0, "ByteTrack", '[[0, 0, 50, 50, "a", 0.9]]', False)], 0)
    held = live.session_stream(stream, give_up=2.0, expire=40.0, refresh=1000.0, latency=1000.0)
    query = held.writeStream.format("memory").queryName("live").option("checkpointLocation", f"{tmp_path}/ckpt").trigger(processingTime="1 second").start()

    def seen(kind, n=1):
        end = time.monotonic() + 90
        while time.monotonic() < end:
            rows = [tuple(r)[:5] for r in spark.table("live").where(f"kind = '{kind}'").collect()]
            if len(rows) >= n:
                return rows
            assert query.exception() is None
            time.sleep(0.5)
        raise AssertionError(f"no {kind}")

    try:
        assert seen("gate") == [(1, 0, "gate", True, False)]
        assert seen("given_up") == [(1, None, "given_up", None, None)]
        folder(spark, tmp_path, [(1, 1, 0.1, "ByteTrack", None, False)], 1)
        assert seen("gate", 2)[1] == (1, 1, "gate", True, False)
        assert seen("expired") == [(1, None, "expired", None, None)]
        folder(spark, tmp_path, [(1, 0, 0.0, "ByteTrack", '[[0, 0, 50, 50, "a", 0.9]]', False)], 2)
        assert seen("gate", 3)[2] == (1, 0, "gate", True, False)
        tracks = [r.track_id for r in spark.table("live").where("kind = 'track' and frame_id = 0").collect()]
        assert tracks == [1, 1]
    finally:
        query.stop()


def test_null_sessions_are_one_in_batch(spark):
    rows = [(None, k, k * 0.1, "ByteTrack", '[[0, 0, 50, 50, "a", 0.9]]', False) for k in range(3)]
    got = live.session_batch(spark.createDataFrame(rows, live.TICKS), **GATE).where("kind = 'track'").collect()
    assert sorted((r.frame_id, r.track_id, r.hits) for r in got) == [(0, 1, 1), (1, 1, 2), (2, 1, 3)]


def test_a_stream_that_takes_too_long_is_stopped(spark, tmp_path):
    stream = folder(spark, tmp_path, ticks(1, 2), 0)
    with pytest.raises(TimeoutError):
        live.run_to_table(live.session_stream(stream, **GATE), str(tmp_path), 0.001)


def test_the_registered_stream_equals_its_batch(spark):
    want = sorted(map(key, tracking_queries.live_ticks(spark, SF_DIR).collect()), key=str)
    got = tracking_queries.live_stream(spark, SF_DIR)
    assert sorted(map(key, got.collect()), key=str) == want
    assert got.where("kind = 'gate'").count() == spark.read.parquet(f"{SF_DIR}/events.parquet").count()
    assert got.where("kind = 'gate' and submitted").count() > 10 and got.where("kind = 'gate' and applied").count() > 10
