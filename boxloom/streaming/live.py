"""The live session as one operator: which ticks ask for a detection, and the tracks that every tick shows.

``session_batch`` folds recorded ticks; ``session_stream`` does the same on a stream, with a typed state for each session,
a timer that gives up a detection that never came back, and one that forgets a session that has gone quiet.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from operator import itemgetter
from typing import Any

import numpy as np
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from boxloom.streaming import tracking
from boxloom.streaming.folds import fold_batch

TICKS = "session long, frame_id long, ts double, algorithm string, boxes string, reset boolean"
#: ``kind`` is gate, one row for each tick; track, one for each box that it shows; late, a tick that is behind its session;
#: given_up, a detection that took too long; expired, a session without ticks. The last two have no frame.
SCHEMA = (
    "session long, frame_id long, kind string, submitted boolean, applied boolean, "
    "track_id int, label string, score double, ymin double, xmin double, ymax double, xmax double, hits int"
)
FIELDS = [part.split()[0] for part in SCHEMA.split(", ")]
#: Rows of one session as the stream's processor puts them out, a column at a time and up to PIECE at once.
PACKED = ", ".join(part if part.startswith("session ") else "{} array<{}>".format(*part.split()) for part in SCHEMA.split(", "))
PIECE = 4096

SESSION = (
    "last_frame long, algorithm string, byte_id int, single_id int, last_detect double, busy_until double, fresh boolean, applied long, pending long, "
    "asked_at long, seen_at long"
)
TRACK = "id int, label string, score double, hits int, since int, mean array<double>, cov array<double>, box array<double>"
SHOWN = "track_id int, label string, score double, ymin double, xmin double, ymax double, xmax double, hits int"
SESSION_FIELDS, SHOWN_FIELDS = ([part.split()[0] for part in held.split(", ")] for held in (SESSION, SHOWN))
#: Lists of tracks that a session holds: the two of the Kalman tracker, and that of the others.
LISTS = (("byte", "tracked"), ("byte", "lost"), ("single", "tracked"))


def live_start() -> dict:
    return {"gate": tracking.gate_start(), "tick": tracking.tick_start()}


def make_live(refresh: float = 1.0, latency: float = 0.4, motion_gate: bool = True) -> Callable[[dict, dict], tuple[dict, list[dict]]]:
    """The fold of one tick: the gate's decision, then the tracks. A tick with reset true begins the session anew."""
    gate = tracking.make_gate(refresh, latency, motion_gate)

    def step(state: dict, row: dict) -> tuple[dict, list[dict]]:
        if row.get("reset"):
            state = live_start()
        state["gate"], said = gate(state["gate"], row)
        state["tick"], tracks = tracking.tick(state["tick"], row)
        return state, [{"kind": "gate", **said[0]}, *({"kind": "track", **t} for t in tracks)]

    return step


_OUT = Row(*FIELDS)


def _packed(session: int, rows: list[dict]) -> Row:
    # Tuples, which are taken for arrays as they are; lists would be copied value by value.
    return _OUT(session, *[tuple([row.get(f) for row in rows]) for f in FIELDS[1:]])


def session_batch(ticks: DataFrame, **gate: Any) -> DataFrame:
    """Rows of SCHEMA for recorded ``ticks`` (of TICKS), in order of their frames; null sessions are one session."""
    step = make_live(**gate)

    def whole(state: dict, row: dict) -> tuple[dict, list[dict]]:
        state, out = step(state, row)
        return state, [{f: o.get(f) for f in FIELDS} for o in out]

    return fold_batch(ticks, "session", ["frame_id"], live_start, whole, SCHEMA)


class Session(StatefulProcessor):
    """State and timers of one session; times of timers are milliseconds of processing time.

    Every call of a handle is a round trip to the store, and there are as many sessions as users, so nothing is read
    or cleared that a session cannot have.
    """

    def __init__(self, give_up: float, expire: float, gate: dict):
        self.give_up, self.expire, self.gate = int(give_up * 1000), int(expire * 1000), gate

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.step = handle, make_live(**self.gate)
        self.session = handle.getValueState("session", SESSION)
        self.tracks = {name: handle.getListState("_".join(name), TRACK) for name in LISTS}
        self.shown = handle.getListState("shown", SHOWN)

    def _load(self) -> tuple[dict, dict]:
        """The fold's state, and what this class keeps beside it: also, for a session that is known, which lists hold rows."""
        state, own = live_start(), {"last_frame": None, "asked_at": None, "seen_at": None}
        if not self.session.exists():
            return state, own | {"known": False, "filled": set()}
        held = dict(zip(SESSION_FIELDS, self.session.get()))
        own = {k: held[k] for k in own}
        state["gate"] = {k: held[k] for k in state["gate"]}
        state["tick"]["algorithm"] = held["algorithm"]
        state["tick"]["byte"]["last_id"], state["tick"]["single"]["last_id"] = held["byte_id"], held["single_id"]
        for kind, which in LISTS:
            state["tick"][kind][which] = [_track(row) for row in self.tracks[kind, which].get()]
        state["tick"]["last"] = [dict(zip(SHOWN_FIELDS, row)) for row in self.shown.get()]
        filled = {name for name in LISTS if state["tick"][name[0]][name[1]]} | ({"shown"} if state["tick"]["last"] else set())
        return state, own | {"known": True, "filled": filled}

    def _save(self, state: dict, own: dict) -> None:
        tick, gate = state["tick"], state["gate"]
        held = {**own, **gate, "algorithm": tick["algorithm"], "byte_id": tick["byte"]["last_id"], "single_id": tick["single"]["last_id"]}
        self.session.update(tuple(held[f] for f in SESSION_FIELDS))
        for kind, which in LISTS:
            _put(self.tracks[kind, which], [_plain(t) for t in tick[kind][which]], (kind, which) in own["filled"])
        _put(self.shown, [tuple(o[f] for f in SHOWN_FIELDS) for o in tick["last"]], "shown" in own["filled"])

    def _forget(self) -> None:
        self.session.clear()
        self.shown.clear()
        for held in self.tracks.values():
            held.clear()

    def _set_timer(self, own: dict, gate: dict, now: int) -> None:
        """One timer, for what is due first."""
        if own["known"]:
            for at in list(self.handle.listTimers()):
                self.handle.deleteTimer(at)
        due = [own["seen_at"] + self.expire]
        if gate["busy_until"] is not None and own["asked_at"] is not None:
            due.append(own["asked_at"] + self.give_up)
        self.handle.registerTimer(max(now + 1, min(due)))

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        state, own = self._load()
        now, out = int(timerValues.getCurrentProcessingTimeInMs()), []
        for row in sorted((tick.asDict() for tick in rows), key=itemgetter("frame_id")):
            row["session"] = key[0]
            if own["last_frame"] is not None and row["frame_id"] <= own["last_frame"] and not row["reset"]:
                out.append({"frame_id": row["frame_id"], "kind": "late"})
                continue
            own["last_frame"] = row["frame_id"]
            state, made = self.step(state, row)
            out += made
            if made[0]["submitted"]:
                own["asked_at"] = now
            if len(out) >= PIECE:
                yield _packed(key[0], out)
                out = []
        own["seen_at"] = now
        self._save(state, own)
        self._set_timer(own, state["gate"], now)
        if out:
            yield _packed(key[0], out)

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[Row]:
        if not self.session.exists():
            return
        state, own = self._load()
        now = int(timerValues.getCurrentProcessingTimeInMs())
        if now - own["seen_at"] >= self.expire:
            self._forget()
            yield _packed(key[0], [{"kind": "expired"}])
            return
        if state["gate"]["busy_until"] is not None and now - own["asked_at"] >= self.give_up:
            # The next tick may ask again at once; a result that still comes is older than that and is dropped.
            state["gate"] |= {"busy_until": None, "pending": None, "fresh": True}
            own["asked_at"] = None
            self._save(state, own)
            yield _packed(key[0], [{"kind": "given_up"}])
        self._set_timer(own, state["gate"], now)

    def close(self) -> None:
        pass


def _track(row: tuple) -> dict:
    ident, label, score, hits, since, mean, cov, box = row
    track = {"id": ident, "label": label, "hits": hits}
    if mean:
        return track | {"score": score, "since": since, "mean": np.array(mean), "cov": np.array(cov).reshape(8, 8)}
    return track | {"box": list(box)}


def _plain(track: dict) -> tuple:
    numbers = [np.asarray(track.get(part, ()), float).ravel().tolist() for part in ("mean", "cov", "box")]
    return (track["id"], track["label"], track.get("score"), track["hits"], track.get("since"), *numbers)


def _put(held, rows: list[tuple], filled: bool) -> None:
    if rows:
        held.put(rows)
    elif filled:
        held.clear()


#: The store that states of several variables and timers need.
PROVIDER = "spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def session_stream(ticks: DataFrame, give_up: float = 30.0, expire: float = 3600.0, **gate: Any) -> DataFrame:
    """As ``session_batch`` on a stream of ticks, which must come in order of a session's frames from batch to batch.

    A tick behind its session is a row of kind late and changes nothing. A detection that is not back after
    ``give_up`` seconds of processing time no longer keeps others from being asked for; a session without a tick for
    ``expire`` seconds is forgotten, and a later tick of it begins anew. Sessions must not be null.
    """
    spark: SparkSession = ticks.sparkSession
    spark.conf.set(*PROVIDER)
    # By rows, not in pandas: a session's few ticks would make two data frames of their own.
    made = ticks.groupBy("session").transformWithState(
        statefulProcessor=Session(give_up, expire, gate), outputStructType=PACKED, outputMode="Append", timeMode="ProcessingTime"
    )
    return made.select("session", F.inline(F.arrays_zip(*FIELDS[1:])))


def run_to_table(stream: DataFrame, path: str, timeout: float | None = None) -> DataFrame:
    """Everything that is there for ``stream`` now, through to the Parquet table at ``path``, from where a run before it stopped.

    It is taken in one batch: with timers of processing time, a run that ends by itself after several has no last one.
    """
    query = stream.writeStream.format("parquet").option("path", f"{path}/out").option("checkpointLocation", f"{path}/checkpoint").trigger(once=True).start()
    began = time.monotonic()
    try:
        if not query.awaitTermination(timeout) and timeout is not None:
            raise TimeoutError(f"the stream took more than {time.monotonic() - began:.0f} seconds")
    finally:
        query.stop()
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{path}/out")
