"""Multi-object tracking as folds over frames of detections.

A frame is a row with ``boxes``: a list of [ymin, xmin, ymax, xmax, label, score] in pixels, as JSON. Tracks hold
numbers and arrays; a state that was kept as JSON has lists in their place.
"""

from __future__ import annotations

import functools
import json

import numpy as np

HIGH, LOW, MATCH, LOW_MATCH, MAX_LOST = 0.4, 0.1, 0.8, 0.5, 30
REINIT, MIN_AREA = 0.35, 16
DEFAULT_SCORE = 0.9
TRACK_SCHEMA = "session long, frame_id long, track_id int, label string, score double, ymin double, xmin double, ymax double, xmax double, hits int"

_DIAGONAL = np.arange(8)


def measure(box: list) -> np.ndarray:
    """Centre, aspect and height of a box; sides under a pixel count as one."""
    w, h = max(1.0, box[3] - box[1]), max(1.0, box[2] - box[0])
    return np.array([box[1] + w / 2, box[0] + h / 2, w / h, h])


#: What of centre, aspect and height the variances scale with, and what of them is fixed.
_SCALED, _PLACE, _SPEED = np.array([1.0, 1.0, 0.0, 1.0]), np.array([0.0, 0.0, 1e-2, 0.0]), np.array([0.0, 0.0, 1e-5, 0.0])
_FIXED = np.concatenate([_PLACE, _SPEED])


def spread(at: np.ndarray, still: float, moving: float) -> np.ndarray:
    """Variances of place and speed along the last axis of ``at``; those of the centre scale with its coordinates."""
    return np.square(np.concatenate([at, at], axis=-1) * _scales(still, moving) + _FIXED)


@functools.lru_cache(maxsize=16)
def _scales(still: float, moving: float) -> np.ndarray:
    return np.concatenate([still * _SCALED, moving * _SCALED])


def new_track(box: list, label: str, score: float, ident: int) -> dict:
    at = measure(box)
    return {"id": ident, "mean": np.concatenate([at, np.zeros(4)]), "cov": np.diag(spread(at, 0.1, 0.0625)), "label": label, "score": score, "hits": 1, "since": 0}


def predict(tracks: list[dict]) -> None:
    """Move all ``tracks`` on by their speed, at once."""
    if not tracks:
        return
    mean, cov = np.array([t["mean"] for t in tracks]), np.array([t["cov"] for t in tracks])
    noise = spread(mean[:, :4], 0.1, 0.0625)
    # What a product with the motion's matrix and its transpose comes to: speeds are added to places.
    mean[:, :4] += mean[:, 4:]
    cov[:, :4] += cov[:, 4:]
    cov[:, :, :4] += cov[:, :, 4:]
    cov[:, _DIAGONAL, _DIAGONAL] += noise
    for t, m, c in zip(tracks, mean, cov):
        t["mean"], t["cov"] = m, c
        t["since"] += 1


def correct(tracks: list[dict], found: list[tuple[list, str, float]]) -> None:
    """Take each track to the detection beside it, all at once."""
    if not tracks:
        return
    mean, cov = np.array([t["mean"] for t in tracks]), np.array([t["cov"] for t in tracks])
    seen = np.array([measure(box) for box, _, _ in found])
    inner = cov[:, :4, :4].copy()
    inner[:, range(4), range(4)] += spread(seen, 0.1, 0.0)[:, :4]
    gain = cov[:, :, :4] @ np.linalg.inv(inner)
    mean = mean + (gain @ (seen - mean[:, :4])[:, :, None])[:, :, 0]
    cov = cov - gain @ inner @ gain.transpose(0, 2, 1)
    for t, m, c, (_, label, score) in zip(tracks, mean, cov, found):
        t |= {"mean": m, "cov": c, "label": label, "score": score, "hits": t["hits"] + 1, "since": 0}


def rect(track: dict) -> list[float]:
    cx, cy, aspect, h = map(float, track["mean"][:4])
    return [cy - h / 2, cx - aspect * h / 2, cy + h / 2, cx + aspect * h / 2]


#: Up to so many pairs of boxes, numbers by themselves take less time than arrays.
FEW = 16


def overlaps(a: list, b: list) -> np.ndarray:
    """Intersection over union of every box of ``a`` with every one of ``b``."""
    if not a or not b:
        return np.zeros((len(a), len(b)))
    if len(a) * len(b) <= FEW:
        return np.array([[_overlap(v, w) for w in b] for v in a])
    x, y = np.array([v[:4] for v in a], float)[:, None], np.array([v[:4] for v in b], float)[None]
    inter = np.clip(np.minimum(x[..., 2:], y[..., 2:]) - np.maximum(x[..., :2], y[..., :2]), 0, None).prod(-1)
    union = (x[..., 2:] - x[..., :2]).prod(-1) + (y[..., 2:] - y[..., :2]).prod(-1) - inter
    return np.where(union > 0, inter / np.where(union > 0, union, 1), 0.0)


def _overlap(a: list, b: list) -> float:
    """One entry of ``overlaps``, in the same steps."""
    inter = max(min(a[2], b[2]) - max(a[0], b[0]), 0.0) * max(min(a[3], b[3]) - max(a[1], b[1]), 0.0)
    union = (a[2] - a[0]) * (a[3] - a[1]) + (b[2] - b[0]) * (b[3] - b[1]) - inter
    return inter / union if union > 0 else 0.0


def pair_up(score: np.ndarray, least: float) -> tuple[list[tuple[int, int]], list[int], list[int]]:
    """Greedy one-to-one pairs of highest score first, ties by row and column; and what is left of both."""
    if not score.size:
        return [], list(range(score.shape[0])), list(range(score.shape[1]))
    if score.size <= FEW:
        best = sorted((-v, i, j) for i, row in enumerate(score.tolist()) for j, v in enumerate(row) if v >= least)
    else:
        r, c = np.nonzero(score >= least)
        best = sorted(zip((-score[r, c]).tolist(), r.tolist(), c.tolist()))
    rows, cols, pairs = set(range(score.shape[0])), set(range(score.shape[1])), []
    for _, i, j in best:
        if i in rows and j in cols:
            pairs.append((i, j))
            rows.discard(i)
            cols.discard(j)
    return pairs, sorted(rows), sorted(cols)


def _detections(row: dict) -> list[tuple[list, str, float]]:
    out = []
    for b in json.loads(row["boxes"] or "[]"):
        if len(b) >= 4:
            out.append(([float(x) for x in b[:4]], str(b[4]) if len(b) > 4 else "", float(b[5]) if len(b) > 5 else DEFAULT_SCORE))
    return out


def start() -> dict:
    return {"tracked": [], "lost": [], "last_id": 0}


def byte_track(state: dict, row: dict) -> tuple[dict, list[dict]]:
    """One frame: strong detections first, then weak ones for tracks left over, then lost tracks; the rest are new.

    Strong detections that start a track are those that no track took, by their own index.
    """
    tracked, lost, last = state["tracked"], state["lost"], state["last_id"]
    predict(tracked + lost)
    found = _detections(row)
    strong = [d for d in found if d[2] >= HIGH]
    weak = [d for d in found if LOW <= d[2] < HIGH]
    met, left, free = pair_up(overlaps([rect(t) for t in tracked], [d[0] for d in strong]), 1.0 - MATCH)
    again, missed, _ = pair_up(overlaps([rect(tracked[t]) for t in left], [d[0] for d in weak]), LOW_MATCH)
    gone = {left[t] for t in missed}
    lost = lost + [tracked[t] for t in sorted(gone)]
    back, still, new = pair_up(overlaps([rect(t) for t in lost], [strong[d][0] for d in free]), 1.0 - MATCH)
    # No track is in two pairs, and none is read between them: all are corrected together.
    pairs = [(tracked[t], strong[d]) for t, d in met] + [(tracked[left[t]], weak[d]) for t, d in again] + [(lost[t], strong[free[d]]) for t, d in back]
    correct([t for t, _ in pairs], [d for _, d in pairs])
    tracked = [t for k, t in enumerate(tracked) if k not in gone] + [lost[t] for t, _ in back]
    lost = [lost[t] for t in still if lost[t]["since"] <= MAX_LOST]
    for d in new:
        last += 1
        tracked.append(new_track(*strong[free[d]], last))
    out = [_output(row, t["id"], t["label"], t["score"], rect(t), t["hits"]) for t in tracked]
    return {"tracked": tracked, "lost": lost, "last_id": last}, out


def merge_track(state: dict, row: dict) -> tuple[dict, list[dict]]:
    """One frame of single-object tracks that stay where they are: each detection takes the best free one of REINIT or more, else starts one.

    Tracks without a detection live on but are not put out; boxes under MIN_AREA start no track.
    """
    tracks, last, out, taken = state["tracked"], state["last_id"], [], set()
    for box, label, score in _detections(row):
        best, at = 0.0, None
        for k, t in enumerate(tracks):
            value = 0.0 if k in taken else float(overlaps([box], [t["box"]])[0, 0])
            if value > best:
                best, at = value, k
        if at is not None and best >= REINIT:
            tracks[at] |= {"box": box, "label": label, "hits": tracks[at]["hits"] + 1}
            taken.add(at)
            ident, hits = tracks[at]["id"], tracks[at]["hits"]
        else:
            last += 1
            ident, hits = last, 1
            if (box[2] - box[0]) * (box[3] - box[1]) >= MIN_AREA:
                taken.add(len(tracks))
                tracks.append({"id": last, "box": box, "label": label, "hits": 1})
        out.append(_output(row, ident, label, score, box, hits))
    return {"tracked": tracks, "lost": [], "last_id": last}, out


def pass_through(state: dict, row: dict) -> tuple[dict, list[dict]]:
    """Detections as they are, numbered within their frame."""
    return state, [_output(row, k, label, score, box, 1) for k, (box, label, score) in enumerate(_detections(row), 1)]


def _output(row: dict, ident: int, label: str, score: float, box: list, hits: int) -> dict:
    return {"session": row["session"], "frame_id": row["frame_id"], "track_id": ident, "label": label, "score": score, "ymin": box[0], "xmin": box[1], "ymax": box[2], "xmax": box[3], "hits": hits}


#: Trackers by a part of their name. Correlation trackers on pixels keep their boxes between detections here.
ALGORITHMS = {"none": pass_through, "pass": pass_through, "bytetrack": byte_track, "siam": merge_track, "mosse": merge_track, "kcf": merge_track, "csrt": merge_track, "vit": merge_track}


@functools.lru_cache(maxsize=64)
def tracker(name: str):
    """The fold for an algorithm's display name; single-object merging if it is not known."""
    low = name.lower()
    return next((step for part, step in ALGORITHMS.items() if part in low), merge_track)


def glide(state: dict, row: dict) -> tuple[dict, list[dict]]:
    """One frame without detections: tracks that are followed move on by their speed; lost ones wait."""
    predict(state["tracked"])
    return state, [_output(row, t["id"], t["label"], t["score"], rect(t), t["hits"]) for t in state["tracked"]]


def tick_start() -> dict:
    return {"algorithm": None, "byte": start(), "single": start(), "last": []}


def tick(state: dict, row: dict) -> tuple[dict, list[dict]]:
    """One tick of a session under the algorithm that ``row`` names; null boxes are a tick between detections.

    Between detections Kalman tracks glide and all others are shown as they were last. A change of algorithm
    ends single-object tracks, whose numbers are not given again, and leaves the Kalman ones.
    """
    if row["algorithm"] != state["algorithm"]:
        state |= {"algorithm": row["algorithm"], "single": state["single"] | {"tracked": []}}
    step = tracker(row["algorithm"] or "")
    own = "byte" if step is byte_track else "single"
    if row["boxes"] is not None:
        state[own], out = step(state[own], row)
    elif step is byte_track:
        state[own], out = glide(state[own], row)
    else:
        out = [o | {"session": row["session"], "frame_id": row["frame_id"]} for o in state["last"]]
    state["last"] = out
    return state, out


GATE_SCHEMA = "session long, frame_id long, submitted boolean, applied boolean"


def gate_start() -> dict:
    return {"last_detect": None, "busy_until": None, "fresh": False, "applied": -1, "pending": None}


def make_gate(refresh: float = 1.0, latency: float = 0.4, motion_gate: bool = True):
    """Fold that decides on which ticks (frame_id, ts in seconds) a detection is asked for.

    One detection runs at a time and takes ``latency``. A tick asks if a result is fresh, motion does not gate,
    or the last request is older than max(0.5, refresh). A result older than one applied before is dropped.
    A row with reset true starts the session anew.
    """

    def step(state: dict, row: dict) -> tuple[dict, list[dict]]:
        if row.get("reset"):
            state = gate_start()
        now, applied = float(row["ts"]), False
        if state["busy_until"] is not None and now >= state["busy_until"]:
            if state["pending"] > state["applied"]:
                state |= {"applied": state["pending"], "fresh": True}
                applied = True
            state["busy_until"] = None
        ask = False
        if state["busy_until"] is None:
            stale = state["last_detect"] is None or now - state["last_detect"] >= max(0.5, refresh)
            ask = bool(state["fresh"] or not motion_gate or stale)
            state["fresh"] = False
            if ask:
                state |= {"last_detect": now, "busy_until": now + latency, "pending": int(row["frame_id"])}
        return state, [{"session": row["session"], "frame_id": row["frame_id"], "submitted": ask, "applied": applied}]

    return step
