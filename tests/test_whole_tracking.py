"""Whole queries with state against plain versions that share no code with them."""

from __future__ import annotations

import json
from itertools import groupby

import pytest

from boxloom.plans import tracking_queries as q
from boxloom.streaming import tracking
from tests.oracle import SF_DIR


class Axis:
    """A position and its speed; a box's four numbers never mix in the filter, so that each has its own."""

    def __init__(self, at, var_at, var_speed):
        self.p, self.v, self.pp, self.pv, self.vv = at, 0.0, var_at, 0.0, var_speed

    def ahead(self, var_at, var_speed):
        self.p += self.v
        self.pp, self.pv, self.vv = self.pp + 2 * self.pv + self.vv + var_at, self.pv + self.vv, self.vv + var_speed

    def seen(self, z, var):
        s, y = self.pp + var, z - self.p
        self.p, self.v = self.p + self.pp / s * y, self.v + self.pv / s * y
        self.pp, self.pv, self.vv = self.pp - self.pp**2 / s, self.pv - self.pp * self.pv / s, self.vv - self.pv**2 / s


def four(b):
    h, w = max(1.0, b[2] - b[0]), max(1.0, b[3] - b[1])
    return [b[1] + w / 2, b[0] + h / 2, w / h, h]


def noise(m):
    """Variances of the four numbers and of their speeds."""
    return [((x / 10) ** 2, (x / 16) ** 2) if k != 2 else (1e-4, 1e-10) for k, x in enumerate(m)]


class Track:
    def __init__(self, ident, b, label, score):
        m = four(b)
        self.axes = [Axis(x, *n) for x, n in zip(m, noise(m))]
        self.id, self.label, self.score, self.hits, self.missed = ident, label, score, 1, 0

    def ahead(self):
        for a, n in zip(self.axes, noise([a.p for a in self.axes])):
            a.ahead(*n)
        self.missed += 1

    def take(self, b, label, score):
        m = four(b)
        for a, z, n in zip(self.axes, m, noise(m)):
            a.seen(z, n[0])
        self.label, self.score, self.hits, self.missed = label, score, self.hits + 1, 0

    def box(self):
        x, y, r, h = [a.p for a in self.axes]
        return [y - h / 2, x - r * h / 2, y + h / 2, x + r * h / 2]


def overlap(a, b):
    common = max(0, min(a[2], b[2]) - max(a[0], b[0])) * max(0, min(a[3], b[3]) - max(a[1], b[1]))
    both = (a[2] - a[0]) * (a[3] - a[1]) + (b[2] - b[0]) * (b[3] - b[1]) - common
    return common / both if both > 0 else 0.0


def matched(tracks, found, least):
    """Takes the best pair again and again; gives the tracks and detections left over."""
    tracks, found = list(tracks), list(found)
    while tracks and found:
        best = max(((overlap(t.box(), d[0]), -i, -j) for i, t in enumerate(tracks) for j, d in enumerate(found)))
        if best[0] < least:
            break
        yield tracks.pop(-best[1]), found.pop(-best[2])
    yield tracks, found


def associate(tracks, found, least):
    *pairs, left = matched(tracks, found, least)
    for t, d in pairs:
        t.take(*d)
    return [t for t, _ in pairs], *left


class Byte:
    def __init__(self):
        self.live, self.lost, self.n = [], [], 0

    def frame(self, boxes):
        for t in self.live + self.lost:
            t.ahead()
        found = [(b[:4], b[4] if len(b) > 4 else "", b[5] if len(b) > 5 else 0.9) for b in boxes]
        _, left, free = associate(self.live, [d for d in found if d[2] >= 0.4], 1.0 - 0.8)
        _, gone, _ = associate(left, [d for d in found if 0.1 <= d[2] < 0.4], 0.5)
        self.live = [t for t in self.live if t not in gone]
        back, still, new = associate(self.lost + gone, free, 1.0 - 0.8)
        self.live += back
        self.lost = [t for t in still if t.missed <= 30]
        for d in new:
            self.n += 1
            self.live.append(Track(self.n, *d))
        return self.shown()

    def between(self):
        for t in self.live:
            t.ahead()
        return self.shown()

    def shown(self):
        return [(t.id, t.label, round(t.score, 6), t.hits, *[round(v, 4) for v in t.box()]) for t in self.live]


class Single:
    def __init__(self):
        self.held, self.n = {}, 0

    def frame(self, boxes):
        out, used = [], set()
        for b in boxes:
            at, label = b[:4], b[4]
            free = [(overlap(at, h[0]), -i) for i, h in self.held.items() if i not in used]
            value, ident = max(free, default=(0.0, 0))
            if value >= 0.35:
                ident = -ident
                self.held[ident] = (at, self.held[ident][1] + 1)
                hits = self.held[ident][1]
            else:
                self.n += 1
                ident, hits = self.n, 1
                if (at[2] - at[0]) * (at[3] - at[1]) >= 16:
                    self.held[ident] = (at, 1)
            used.add(ident)
            out.append((ident, label, b[5] if len(b) > 5 else 0.9, hits, *at))
        return [(i, label, round(s, 6), h, *[round(float(v), 4) for v in at]) for i, label, s, h, *at in out]


def sessions(spark):
    rows = sorted(q.frames(spark, SF_DIR).collect(), key=lambda r: (r.session, r.frame_id))
    return {s: list(g) for s, g in groupby(rows, key=lambda r: r.session)}


def rows_of(df):
    return sorted((r.session, r.frame_id, r.track_id, r.label, round(r.score, 6), r.hits, *[round(r[c], 4) for c in ("ymin", "xmin", "ymax", "xmax")]) for r in df.collect())


def close(got, want):
    assert [g[:6] for g in got] == [w[:6] for w in want] and got
    for g, w in zip(got, want):
        assert g[6:] == pytest.approx(w[6:], abs=2e-3)


@pytest.mark.parametrize("name, make", [("bytetrack", Byte), ("sot_merge", Single)])
def test_trackers_equal_plain_ones(spark, name, make):
    want = []
    for s, frames in sessions(spark).items():
        plain = make()
        for f in frames:
            want += [(s, f.frame_id, *o) for o in plain.frame(json.loads(f.boxes))]
    close(rows_of(q.QUERIES[name](spark, SF_DIR)), sorted(want))


def test_ticks_equal_plain_ones(spark):
    want = []
    for s, frames in sessions(spark).items():
        byte, single, last, before = Byte(), Single(), [], None
        for f in frames:
            kind = f.frame_id // 500 % 3
            if kind != before:
                single.held, before = {}, kind
            boxes = json.loads(f.boxes) if (s + f.frame_id) % 3 == 0 else None
            if boxes is None:
                last = byte.between() if kind == 0 else last
            elif kind == 2:
                last = [(k, b[4], round(b[5] if len(b) > 5 else 0.9, 6), 1, *[float(v) for v in b[:4]]) for k, b in enumerate(boxes, 1)]
            else:
                last = (byte, single)[kind].frame(boxes)
            want += [(s, f.frame_id, *o) for o in last]
    close(rows_of(q.tracker_ticks(spark, SF_DIR)), sorted(want))


def test_gate_equals_a_plain_one(spark):
    want = []
    for s, frames in sessions(spark).items():
        asked_at = returns_at = frame = None
        newest, fresh = -1, False
        for f in frames:
            now, applied, asks = f.micros / 1e6, False, False
            if f.frame_id % 97 == 0:
                asked_at = returns_at = frame = None
                newest, fresh = -1, False
            if returns_at is not None and returns_at <= now:
                applied = frame > newest
                newest, fresh, returns_at = max(newest, frame), fresh or applied, None
            if returns_at is None:
                asks = fresh or asked_at is None or now >= asked_at + 1800.0
                fresh = False
                if asks:
                    asked_at, returns_at, frame = now, now + 600.0, f.frame_id
            want.append((s, f.frame_id, asks, applied))
    got = sorted((r.session, r.frame_id, r.submitted, r.applied) for r in q.session_gate(spark, SF_DIR).collect())
    assert got == sorted(want) and any(w[3] for w in want)


def test_tracks_glide_between_detections():
    at = lambda d: {"session": 1, "frame_id": d, "algorithm": "ByteTrack", "boxes": json.dumps([[100 + 4 * d, 50, 160 + 4 * d, 120, "a"]])}
    state = tracking.tick_start()
    for k in range(6):
        state, out = tracking.tick(state, at(k))
    first = out[0]["ymin"]
    state, out = tracking.tick(state, at(6) | {"boxes": None})
    assert out[0]["track_id"] == 1 and out[0]["ymin"] > first + 1
    state, out = tracking.tick(state, at(7) | {"boxes": None, "algorithm": "KCF (TrackerKCF)"})
    assert [o["track_id"] for o in out] == [1] and state["byte"]["tracked"] and not state["single"]["tracked"]
