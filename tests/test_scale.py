"""Work and memory that grow no faster than the input."""

from __future__ import annotations

import time
import tracemalloc
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from boxloom.config import layered
from boxloom.functions import imagefile
from boxloom.functions import pixels as px
from boxloom.functions import text as t
from boxloom.operators import images as ops
from boxloom.plans import relabel_flow, relabel_queries, round_queries, tracking_queries
from boxloom.streaming import live, tracking
from tests import test_relabel_flow as flows
from tests.oracle import connect, same


def noise(seed, *shape):
    return np.random.default_rng(seed).integers(0, 256, shape).astype(np.uint8)


def seconds(work):
    begun = time.process_time()
    work()
    return time.process_time() - begun


def peak(work):
    tracemalloc.start()
    try:
        work()
        return tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()


def tabled_means(img, strength, patch=7, search=21):
    """Non-local means by a summed-area table for every shift and weights for every pixel."""
    h, w, channels = img.shape
    near, far = patch // 2, search // 2
    full = px._reflected(img.astype(float), near + far)
    own = full[far : far + h + 2 * near, far : far + w + 2 * near]
    total, weights = np.zeros((h, w, channels)), np.zeros((h, w))
    for dy in range(search):
        for dx in range(search):
            other = full[dy : dy + h + 2 * near, dx : dx + w + 2 * near]
            table = np.zeros((own.shape[0] + 1, own.shape[1] + 1))
            table[1:, 1:] = ((own - other) ** 2).sum(-1).cumsum(0).cumsum(1)
            around = table[patch:, patch:] - table[:-patch, patch:] - table[patch:, :-patch] + table[:-patch, :-patch]
            weight = np.exp(-np.maximum(around, 0) / (patch * patch * channels * strength**2))
            total += weight[..., None] * other[near : near + h, near : near + w]
            weights += weight
    return np.clip(np.round(total / weights[..., None]), 0, 255).astype(np.uint8)


@pytest.mark.parametrize("shape", [(150, 32, 1), (32, 150, 2), (1, 90, 3), (70, 3, 1), (1, 1, 1)])
def test_non_local_means_cost_little_where_patches_differ(shape):
    y, x = np.mgrid[: shape[0], : shape[1]]
    smooth = np.clip((x // 16 * 40 + y // 16 * 20)[..., None] + np.random.default_rng(1).normal(0, 4, shape), 0, 255).astype(np.uint8)
    for img in (noise(2, *shape), smooth):
        assert np.array_equal(px.non_local_means(img, 3.0), tabled_means(img, 3.0))
    if shape[0] * shape[1] > 1000:
        img = noise(2, *shape)
        assert seconds(lambda: px.non_local_means(img, 3.0)) < 0.4 * seconds(lambda: tabled_means(img, 3.0))


@pytest.mark.parametrize("shape", [(66, 35, 1), (35, 70, 2), (71, 33, 3), (9, 40, 4), (2, 3, 1), (1, 2, 2)])
def test_patches_are_told_apart_by_the_cores_they_share(shape):
    img = noise(4, *shape)
    some = img.copy()  # a few alike among many that differ, at the edge of a part and within
    some[-4:], some[: shape[0] // 3, -1:] = 90, 7
    twice = np.tile(img[: -(-shape[0] // 4)], (4, 1, 1))[: shape[0]]
    for each in (img, some, twice, img // 64 + 100):
        for strength in (3.0, 12.0):
            assert np.array_equal(px.non_local_means(each, strength), tabled_means(each, strength))
    if shape[0] * shape[1] > 1000 and shape[2] < 3:
        least = lambda means: min(seconds(lambda: means(img, 3.0)) for _ in range(3))
        assert least(px.non_local_means) < 0.06 * least(tabled_means)


def test_scan_lines_of_one_filter_are_read_at_once():
    img = noise(5, 60, 7, 3)
    for kinds in ([k // 7 % 5 for k in range(60)], [k % 5 for k in range(60)], *([k] * 60 for k in range(5))):
        status, got, _ = imagefile.decode(imagefile.encode_png(img, kinds))
        assert status == "ok" and np.array_equal(got, img)


def test_resampling_a_long_picture_takes_no_square_of_its_length():
    img = noise(3, 6000, 4, 3)
    assert peak(lambda: px.lanczos(img, 6, 9000)) < 60 << 20
    flat = np.full((40, 3, 3), 9, np.uint8)
    assert (px.lanczos(flat, 7, 11) == 9).all() and (px.lanczos(flat, 3, 90) == 9).all()
    assert px.channel_means(img) == img.reshape(-1, 3).mean(axis=0).tolist()


def test_box_sums_against_windows():
    a = noise(4, 3, 17, 13).astype(np.int64)
    for size in (1, 2, 3, 5, 7, 11, 13):
        want = np.lib.stride_tricks.sliding_window_view(a, (size, size), axis=(1, 2)).sum((-1, -2))
        assert np.array_equal(px.box_sums(a, size), want) and np.array_equal(px.box_sums(a[1], size), want[1])


def test_bilateral_smoothing_holds_no_windows():
    img = noise(5, 400, 100, 3)
    assert peak(lambda: px.bilateral(img)) < 8 * img.size * 12
    plane = img[:40, :30, 0]
    near = px.windows(plane.astype(float), 9)
    y, x = np.mgrid[-4:5, -4:5]
    weight = np.exp(-(x**2 + y**2) / (2 * 75**2)) * np.exp(-((near - plane[..., None, None]) ** 2) / (2 * 75**2)) * (x**2 + y**2 <= 16)
    assert np.array_equal(px.bilateral(plane), np.round((near * weight).sum((-1, -2)) / weight.sum((-1, -2))).astype(np.uint8))
    assert all(np.array_equal(px.bilateral(img[:9, :50])[..., c], px.bilateral(img[:9, :50, c])) for c in range(3))


def test_runs_join_in_time_about_their_number():
    mask = noise(6, 1000, 1000) < 115
    runs = px.runs_of(mask)
    # A loop over the runs takes some 2 microseconds for each, of a machine that adds a million numbers in 30 ms.
    unit = min(seconds(lambda: sum(range(1_000_000))) for _ in range(3))
    assert len(runs[0]) > 200_000 and seconds(lambda: px.joined_runs(*runs)) < 12 * unit
    grey = px.grey(noise(7, 40, 30, 3))
    g = px.windows(grey, 5).mean((-1, -2))
    dark = g < px.windows(g, 11).mean((-1, -2)) - 2
    grown = np.lib.stride_tricks.sliding_window_view(np.pad(dark, 1), (3, 3)).max((-1, -2))
    closed = np.lib.stride_tricks.sliding_window_view(np.pad(grown, 1, constant_values=True), (3, 3)).min((-1, -2))
    assert np.array_equal(px.som_mask(noise(7, 40, 30, 3)), closed)


def test_a_long_edge_is_followed_in_one_go():
    # One weak line that winds through the picture from a strong end: a step at a time takes as many steps as it is long.
    img = np.zeros((400, 400, 3), np.uint8)
    for k in range(0, 400, 12):
        img[k : k + 6] = 22
        side = slice(0, 6) if k % 24 else slice(394, 400)
        img[k : k + 12, side] = 22
    img[:6, :6] = 200
    assert seconds(lambda: px.edge_ratio(img)) < 1.5
    p = np.pad(px.grey(img), 1, mode="edge")
    gx = p[:-2, 2:] + 2 * p[1:-1, 2:] + p[2:, 2:] - p[:-2, :-2] - 2 * p[1:-1, :-2] - p[2:, :-2]
    gy = p[2:, :-2] + 2 * p[2:, 1:-1] + p[2:, 2:] - p[:-2, :-2] - 2 * p[:-2, 1:-1] - p[:-2, 2:]
    weak, strong = np.abs(gx) + np.abs(gy) > 50, np.abs(gx) + np.abs(gy) > 150
    left = list(zip(*np.nonzero(strong)))
    seen = set(left)
    while left:
        y, x = left.pop()
        for q in [(y + a, x + b) for a in (-1, 0, 1) for b in (-1, 0, 1)]:
            if q not in seen and 0 <= q[0] < 400 and 0 <= q[1] < 400 and weak[q]:
                seen.add(q)
                left.append(q)
    assert px.edge_ratio(img) == len(seen) / weak.size > 2 * strong.mean()
    small = noise(8, 9, 12, 3)
    near = px.windows(px.grey(small), 5)
    assert px.texture(small) == pytest.approx(near.std((-1, -2)).std(), abs=1e-9)


def test_ids_beyond_a_double_and_below_zero_keep_their_families(spark, tmp_path):
    ids = [*range(-20, 40), *range((1 << 53) - 9, (1 << 53) + 40), *range(10**18 + 3, 10**18 + 60)]
    spark.createDataFrame([(i,) for i in ids], "doc_id long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, i % 2) for i in ids[::7]], "doc_id long, quality long").write.parquet(f"{tmp_path}/labels.parquet")
    con = connect(str(tmp_path / "none"))
    for table in ("documents", "labels"):
        con.execute(f"create view {table} as select * from read_parquet('{tmp_path}/{table}.parquet/*.parquet')")
    same(spark, con, round_queries.unique_stems, round_queries.STEMS_SQL, str(tmp_path))
    same(spark, con, relabel_queries.batch_antijoin, relabel_queries.BATCH_SQL, str(tmp_path))


@pytest.mark.parametrize("together", [2, None])
def test_batches_of_one_step_are_what_they_are_one_by_one(spark, tmp_path, together):
    images, replies, df, ask = flows.made(spark, 40)
    settings, asked, steps = layered({"batch_size": 5}), [], []
    known = spark.createDataFrame(flows.KNOWN, "name string, id int")

    def counting(requests):
        asked.append(requests.select("prompt").distinct().collect())
        return ask(requests)

    row = relabel_flow.relabel(df, counting, f"{tmp_path}/labels", f"{tmp_path}/state", settings, known, steps.append, together=together).first()
    ids, out, review, counts = flows.plain(images, replies, 5)
    got_ids, got_review, done = flows.state_of(spark, tmp_path, settings)
    assert flows.files(tmp_path / "labels") == out and got_ids | dict(flows.KNOWN) == ids and got_review == review
    assert done == sorted(Path(f).stem for f in out) and row.boxes_seen == counts["seen"]
    batches = -(-sum(1 for i in images if i[3].strip()) // 5)
    assert len(asked) == len(steps) == (1 if together is None else -(-batches // 2)) and all(len(told) <= 1 for told in asked)
    recorded = relabel_flow.Attempts(spark, f"{tmp_path}/state", relabel_flow.settings_key(settings)).recorded().collect()
    assert sorted(r.batch for r in recorded) == list(range(batches)) and len({r.attempt for r in recorded}) == len(steps)
    assert steps[-1]["batch"] == batches - 1 and steps[-1]["done"] == len(out)


def test_drawn_regions_of_many_small_images_go_by_batches(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    try:
        rows = [(k, x, y, 99) for k in (None, *range(30), 10**18 + 1, 10**18 + 2) for x, y in ((1, 1), (2, 2), (4, 2), (-2_000_000_000, 2_000_000_000), (2_000_000_000, -2_000_000_000))]
        rows += [(5, 2 * k, y, 99) for k in range(10) for y in range(0, 20, 2)]
        df = ops.drawn_regions(spark.createDataFrame(rows, "image_id long, x int, y int, alpha int"))
        got = {}
        for r in df.orderBy("image_id", "region").collect():
            got.setdefault(r.image_id, []).append((r.x1, r.y1, r.x2))
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    plain = [(2_000_000_000, -2_000_000_000, 2_000_000_001), (1, 1, 3), (4, 2, 5), (-2_000_000_000, 2_000_000_000, -1_999_999_999)]
    assert len(got) == 33 and all(got[k] == plain for k in got if k != 5) and len(got[5]) > 90
    assert "FlatMapGroupsInPandas" not in df._jdf.queryExecution().toString()


def test_short_replies_are_not_walked_bracket_by_bracket(spark):
    texts = ["[]", "a [1,[2,[3,[4]]]] b]", "[[[[[5]]]]] x", "no", "]", "see [1, [2]", "[1] [2]", "[" * 300 + "]" * 300, "[[]" * 199, "[" + "[1]," * 148 + "]]", "[" + "[1]," * 5000 + "]] z", "", "[a]]", " \t[1]\x0b "]
    rows = [(k, s) for k, s in enumerate([*texts, "<think>[9]</think> <answer>\n[7] </answer> [8]", "<think>[9]", "<answer>[3]", None])]
    df = t.with_detection_json(spark.createDataFrame(rows, "k int, reply string"), "reply")
    got = {r.k: r.json for r in df.collect()}
    walked = {r.k: r.json for r in df.select("k", t.detection_json(F.col("reply")).alias("json")).collect()}
    assert got == walked and got[1] == "[1,[2,[3,[4]]]]" and got[2] == "[[[[[5]]]]]" and got[14] == "[7]" and got[13] == "[1]"
    # The pattern alone finds the array of a detector's usual reply.
    usual = spark.createDataFrame([('x [{"bbox_2d":[1,2,3,4]},{"bbox_2d":[[5],6]}] y',)], "s string").select(F.regexp_extract("s", t.BALANCED, 0)).first()[0]
    assert usual == '[{"bbox_2d":[1,2,3,4]},{"bbox_2d":[[5],6]}]'


def test_replayed_rounds_read_grouped_lines(spark, monkeypatch):
    plans, replay = [], tracking_queries.loop.replay

    def seen(recorded, keys):
        plans.append(recorded._jdf.queryExecution().optimizedPlan().toString())
        return replay(recorded, keys)

    monkeypatch.setattr(tracking_queries.loop, "replay", seen)
    tracking_queries.detect_replay(spark, "/root/testdata/sf0.001")
    assert len(plans) == 3 and not any("l_orderkey" in p for p in plans)


def test_few_boxes_are_paired_without_arrays(monkeypatch):
    rng = np.random.default_rng(11)
    cases = [[(rng.integers(-5, 20, (rng.integers(0, 5), 4)) * rng.choice([1.0, 0.37])).tolist() for _ in range(2)] for _ in range(500)]
    few = [(tracking.overlaps(a, b), tracking.pair_up(tracking.overlaps(a, b), 0.2)) for a, b in cases]
    one = [[[10.0, 10.0, 30.0, 40.0]], [[12.0, 11.0, 33.0, 39.0]]]
    work = lambda: [tracking.pair_up(tracking.overlaps(*one), 0.2) for _ in range(2000)]
    short = seconds(work)
    monkeypatch.setattr(tracking, "FEW", 0)
    assert all(np.array_equal(x, tracking.overlaps(a, b)) and p == tracking.pair_up(x, 0.2) for (x, p), (a, b) in zip(few, cases))
    assert short < 0.5 * seconds(work)


def test_a_tick_of_a_live_session_pairs_as_the_trackers_do(monkeypatch):
    # The stream's ticks go through the same step: a session of few boxes never builds a matrix.
    arrays, zeros = [], np.nonzero
    monkeypatch.setattr(tracking.np, "nonzero", lambda a: arrays.append(a) or zeros(a))
    state = tracking.tick_start()
    for k in range(20):
        state, _ = tracking.tick(state, {"session": 1, "frame_id": k, "algorithm": "ByteTrack", "boxes": f'[[{10 + k},10,{60 + k},50,"a",0.9],[200,200,260,270,"b",0.3]]'})
    assert not arrays


class Store:
    """A handle whose states are kept here, and every call of which is counted."""

    def __init__(self):
        self.rows, self.timers, self.calls = {}, set(), 0

    def getValueState(self, name, schema):
        return Held(self, name)

    getListState = getValueState

    def listTimers(self):
        self.calls += 1
        return sorted(self.timers)

    def registerTimer(self, at):
        self.calls += 1
        self.timers.add(at)

    def deleteTimer(self, at):
        self.calls += 1
        self.timers.discard(at)

    def getCurrentProcessingTimeInMs(self):
        return 1000


class Held:
    def __init__(self, store, name):
        self.store, self.name = store, name

    def exists(self):
        self.store.calls += 1
        return self.name in self.store.rows

    def get(self):
        self.store.calls += 1
        return self.store.rows.get(self.name, ())

    def put(self, rows):
        self.store.calls += 1
        self.store.rows[self.name] = rows

    update = put

    def clear(self):
        self.store.calls += 1
        self.store.rows.pop(self.name, None)


def processed(store, ticks):
    """What a session puts out for ``ticks``: its pieces, and their rows."""
    session = live.Session(30.0, 3600.0, {})
    session.init(store)
    names = [part.split()[0] for part in live.TICKS.split(", ")]
    pieces = list(session.handleInputRows((7,), (Row(*names)(*t) for t in ticks), store))
    return pieces, [dict(zip(live.FIELDS, (p.session, *r))) for p in pieces for r in zip(*p[1:])]


def test_a_session_costs_few_calls_of_its_store_and_one_row():
    # Sessions are as many as users: what each costs beside its ticks is what grows.
    store = Store()
    ticks = [(7, k, k * 0.1, "ByteTrack", f'[[{10 + k},10,{60 + k},50,"a",0.9]]' if k % 3 == 0 else None, False) for k in range(60)]
    pieces, got = processed(store, ticks[::-1])
    assert len(pieces) == 1 and store.calls <= 5 and set(store.rows) == {"session", "byte_tracked", "shown"} and len(store.timers) == 1
    state, want = live.live_start(), []
    for t in ticks:
        state, made = live.make_live()(state, dict(zip(("session", "frame_id", "ts", "algorithm", "boxes", "reset"), t)))
        want += [{f: m.get(f) for f in live.FIELDS} for m in made]
    assert got == want
    # What a list held is gone once the session has none; one timer stays.
    _, got = processed(store, [(7, 60, 6.0, "ByteTrack", "[]", True), (7, 59, 5.9, "ByteTrack", "[]", False)])
    assert [(g["frame_id"], g["kind"]) for g in got] == [(59, "late"), (60, "gate")]
    assert set(store.rows) == {"session"} and len(store.timers) == 1


def test_a_long_session_goes_out_in_pieces(monkeypatch):
    ticks = [(7, k, k * 0.1, "None", "[[0,0,9,9]]", False) for k in range(50)]
    (whole,), want = processed(Store(), ticks)
    monkeypatch.setattr(live, "PIECE", 8)
    pieces, got = processed(Store(), ticks)
    assert got == want and len(want) == 100 and len(pieces) == 13 and max(len(p.kind) for p in pieces) == 8
