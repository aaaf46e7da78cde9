"""The label file source, attempts on record and the relabelling flow over them."""

from __future__ import annotations

import json
import random
from collections import Counter
from pathlib import Path

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from boxloom.config import layered
from boxloom.plans import progress, relabel_flow, relabel_queries
from boxloom.plans.detect import replay
from boxloom.sources import attempts, durable, label_source, labels, sinks


def files(folder):
    return {str(p.relative_to(folder)): p.read_bytes() for p in sorted(Path(folder).rglob("*")) if p.is_file() and p.name[0] not in "._"}


def test_a_folder_round_trips(spark, tmp_path):
    rows = [(f"img {k}", f"0 .5 .5 .1 .{k % 9}\n" * (k % 4), k % 3 if k % 3 else None) for k in range(60)] + [("é.x", "no newline", None), ("empty", None, 12345)]
    df = spark.createDataFrame(rows, "stem string, content string, batch int")
    sinks.write_label_files(df, str(tmp_path / "a"), True)
    want = {(f"batch_{b:04d}/" if b is not None else "") + f"{s}.txt": (c or "").encode() for s, c, b in rows}
    assert files(tmp_path / "a") == want and want["batch_12345/empty.txt"] == b"" == want["img 0.txt"]
    back = labels.label_files(spark, (tmp_path / "a").as_uri())
    assert sorted(map(tuple, back.collect()), key=str) == sorted(((s, c or "", b) for s, c, b in rows), key=str)
    sinks.write_label_files(back, str(tmp_path / "b"), True)
    assert files(tmp_path / "b") == want
    assert not (tmp_path / "a" / label_source.STAGING).exists() and (tmp_path / "a" / "_SUCCESS").read_text().startswith("62 files")


def test_files_of_one_name_are_replaced_and_others_stay(spark, tmp_path):
    def put(rows, mode="append"):
        spark.createDataFrame(rows, "stem string, content string").write.format("label_files").mode(mode).save(str(tmp_path))

    (tmp_path / "notes.csv").write_text("kept")
    put([("a", "1"), ("b", "2")])
    put([("b", "3"), ("c", "4")])
    assert files(tmp_path) == {"a.txt": b"1", "b.txt": b"3", "c.txt": b"4", "notes.csv": b"kept"}
    put([("z", "9")], "overwrite")
    assert files(tmp_path) == {"z.txt": b"9", "notes.csv": b"kept"}


def test_a_task_that_runs_twice_or_fails_leaves_no_duplicate(tmp_path):
    def batch(*rows):
        stems, contents = zip(*rows)
        return pa.RecordBatch.from_arrays([pa.array(stems), pa.array(contents, pa.string())], ["stem", "content"])

    def broken():
        yield batch(("a", "half"), ("n", "new"))
        raise OSError("lost")

    writer = label_source.Writer(str(tmp_path), ["stem", "content"], False)
    first = writer.write(iter([batch(("a", "1"), ("b", "")), batch(("c", "3"))]))
    with pytest.raises(OSError):
        writer.write(broken())
    again = writer.write(iter([batch(("a", "1"), ("b", "")), batch(("c", "3"))]))
    assert first == again and (first.files, first.bytes) == (3, 2)
    writer.commit([again])
    assert files(tmp_path) == {"a.txt": b"1", "b.txt": b"", "c.txt": b"3"} and not (tmp_path / label_source.STAGING).exists()
    lost = label_source.Writer(str(tmp_path), ["stem", "content"], False)
    with pytest.raises(OSError):
        lost.write(broken())
    lost.abort([None])
    assert files(tmp_path) == {"a.txt": b"1", "b.txt": b"", "c.txt": b"3"} and not (tmp_path / label_source.STAGING).exists()
    for rows in ([("x", "1"), ("x", "2")], [("../x", "1")], [("", "1")], [(None, "1")], [("..", "1")]):
        with pytest.raises(ValueError):
            writer.write(iter([batch(*rows)]))


def test_many_files_are_read_in_several_tasks(spark, tmp_path):
    for k in range(130):
        (tmp_path / f"s{k}.TXT").write_text(f"line {k}\r\nnext")
    (tmp_path / "batch_0007").mkdir()
    (tmp_path / "other").mkdir()
    (tmp_path / "other" / "x.txt").write_text("not read")
    spark.dataSource.register(label_source.LabelFiles)
    df = spark.read.format("label_files").option("files_per_task", 40).load(str(tmp_path))
    assert df.rdd.getNumPartitions() == 5 and df.count() == 130
    assert {(r.line_no, r.line) for r in labels.lines_of(df).where("stem = 's7'").collect()} == {(1, "line 7"), (2, "next")}
    (tmp_path / "none").mkdir()
    assert labels.label_files(spark, str(tmp_path / "none")).collect() == []


def test_rows_count_once_their_attempt_is_on_record(spark, tmp_path):
    held = attempts.Attempts(spark, str(tmp_path / "s"), "k")
    rows = lambda *names: spark.createDataFrame([(n,) for n in names], "name string")
    assert held.rows("t", "name string").collect() == [] and held.recorded().collect() == []
    held.add("t", rows("a", "b"), "one")
    assert held.rows("t", "name string").collect() == []
    held.record("one", 0)
    held.add("t", rows("lost"), "two")
    other = attempts.Attempts(spark, str(tmp_path / "s"), "other")
    other.add("t", rows("c"), "three")
    other.record("three", 0)
    assert sorted(r.name for r in held.rows("t", "name string").collect()) == ["a", "b"]
    assert [tuple(r) for r in held.recorded().collect()] == [("one", 0)]


def made(spark, n=22):
    """Images, recorded replies, and what the flow must make of them."""
    rng = random.Random(n)
    images, replies = [], []
    for k in range(n):
        lines = [rng.choice(["0 0.5 0.5 0.25 0.5", "1 0.1 0.2 0.1 0.1", "bad line", "", "0 0.5 0.5 0 0"]) for _ in range(rng.randrange(0, 5))]
        images.append((f"i{k:03d}", None if k % 13 == 5 else 640, None if k % 13 == 5 else 480, "\n".join(lines)))
        for at, _ in enumerate(lines, 1):
            said = rng.choice([None, "[1]", '{"class": " "}', f'{{"class": " K{rng.randrange(6)} ", "confidence": {rng.randrange(1, 6)}}}', '{"class":"known","confidence":"x"}'])
            replies.append((f"i{k:03d}", at, said))
    df = spark.createDataFrame(images, "stem string, w int, h int, content string")
    return images, replies, df, replay(spark.createDataFrame(replies, "stem string, line_no int, reply string"), ["stem", "line_no"])


def plain(images, replies, size, threshold=2):
    """The flow without Spark: files, classes, review and counts."""
    said = {(s, k): r for s, k, r in replies}
    ids, out, review, counts = {"known": 0}, {}, {}, Counter()
    work = [i for i in sorted(images) if i[3].strip()]
    for at, (stem, w, h, content) in enumerate(work):
        if w is None:
            continue
        lines, low = [], []
        for k, line in enumerate(content.removesuffix("\n").split("\n"), 1):
            counts["seen"] += 1
            try:
                _, x, y, bw, bh = map(float, line.split())
            except ValueError:
                counts["malformed"] += 1
                continue
            if bw == 0:
                counts["empty"] += 1
                continue
            reply = said[stem, k]
            if reply is None:
                counts["failed"] += 1
                continue
            value = json.loads(reply)
            name = value.get("class", "").strip().lower() if isinstance(value, dict) else ""
            if not name:
                counts["bad"] += 1
                continue
            counts["classified"] += 1
            confidence = value["confidence"] if isinstance(value["confidence"], int) else 0
            lines.append(f"{ids.setdefault(name, len(ids))} {x} {y} {bw} {bh}\n")
            if confidence <= threshold:
                low.append({"class": name, "confidence": confidence, "bbox": [x, y, bw, bh]})
        out[f"batch_{at // size:04d}/{stem}.txt"] = "".join(lines).encode()
        if low:
            review[stem] = low
    counts["low"] = sum(map(len, review.values()))
    return ids, out, review, counts


KNOWN = [("known", 0)]


def state_of(spark, folder, settings):
    held = attempts.Attempts(spark, f"{folder}/state", relabel_flow.settings_key(settings))
    ids = {r.name: r.id for r in held.rows("classes", relabel_flow.CLASSES).collect()}
    review = {r.stem: json.loads(r.records) for r in held.rows("review", relabel_flow.REVIEW).collect()}
    return ids, review, sorted(r.stem for r in held.rows("images", relabel_flow.IMAGES).collect())


def test_the_whole_flow_against_a_plain_version(spark, tmp_path):
    images, replies, df, ask = made(spark)
    settings, steps = layered({"batch_size": 10}), []
    known = spark.createDataFrame(KNOWN, "name string, id int")

    def told(row):
        steps.append(row)
        raise RuntimeError("no matter")

    row = relabel_flow.relabel(df, ask, f"{tmp_path}/labels", f"{tmp_path}/state", settings, known, told).first()
    ids, out, review, counts = plain(images, replies, 10)
    assert files(tmp_path / "labels") == out
    got_ids, got_review, done = state_of(spark, tmp_path, settings)
    assert got_ids | dict(KNOWN) == ids and got_review == review and done == sorted(Path(f).stem for f in out)
    assert (row.boxes_seen, row.boxes_malformed_line, row.boxes_empty_crop, row.boxes_model_call_failed, row.boxes_bad_response, row.boxes_classified, row.boxes_low_confidence) == tuple(
        counts[k] for k in ("seen", "malformed", "empty", "failed", "bad", "classified", "low")
    )
    assert [s["batch"] for s in steps] == list(range(len(steps))) and steps[-1]["done"] == len(out) and steps[-1]["total"] == sum(1 for i in images if i[3].strip())
    assert sum(s["failed"] for s in steps) == steps[-1]["total"] - len(out) and sum(s["boxes"] for s in steps) == counts["classified"]


@pytest.mark.parametrize("breaks", ["model", "record"])
def test_a_killed_run_goes_on_where_it_stopped(spark, tmp_path, monkeypatch, breaks):
    images, replies, df, ask = made(spark)
    settings, asked = layered({"batch_size": 10}), []
    known = spark.createDataFrame(KNOWN, "name string, id int")
    record = attempts.Attempts.record

    def counting(requests):
        asked.append(sorted({r.stem for r in requests.select("stem").collect()}))
        if breaks == "model" and len(asked) == 2:
            raise RuntimeError("killed")
        return ask(requests)

    def recorded(self, attempt, batch):
        if breaks == "record" and len(asked) == 2:
            raise RuntimeError("killed")
        record(self, attempt, batch)

    monkeypatch.setattr(attempts.Attempts, "record", recorded)
    with pytest.raises(RuntimeError, match="killed"):
        relabel_flow.relabel(df, counting, f"{tmp_path}/labels", f"{tmp_path}/state", settings, known)
    ids, out, review, _ = plain(images, replies, 10)
    first = sorted(Path(f).stem for f in out if f.startswith("batch_0000/"))
    assert state_of(spark, tmp_path, settings)[2] == first
    relabel_flow.relabel(df, counting, f"{tmp_path}/labels", f"{tmp_path}/state", settings, known)
    # Images that can't be read are tried again, and nothing of them is asked.
    again = [a for a in asked[2:] if a]
    assert not {s for a in again for s in a} & set(first) and again[0] == asked[1]
    got_ids, got_review, done = state_of(spark, tmp_path, settings)
    assert files(tmp_path / "labels") == out and got_ids | dict(KNOWN) == ids and got_review == review
    assert done == sorted(Path(f).stem for f in out)
    n = len(asked)
    row = relabel_flow.relabel(df, counting, f"{tmp_path}/labels", f"{tmp_path}/state", settings, known).first()
    assert row.boxes_seen == 0 and not any(asked[n:])


def test_a_run_ends_between_batches_when_told(spark, tmp_path):
    images, replies, df, ask = made(spark)
    steps = []
    relabel_flow.relabel(df, ask, f"{tmp_path}/labels", f"{tmp_path}/state", layered({"batch_size": 10}), spark.createDataFrame(KNOWN, "name string, id int"), steps.append, lambda: len(steps) == 1)
    assert len(steps) == 1 and {f.split("/")[0] for f in files(tmp_path / "labels")} == {"batch_0000"}


def test_rates_and_times_left():
    now = [0.0]
    told = []
    watch = progress.Progress(10, told.append, lambda: now[0])
    assert watch.tell(0)["eta"] is None
    now[0] = 4.0
    assert watch.tell(2, batch=1) == {"done": 2, "total": 10, "rate": 0.5, "eta": 16.0, "batch": 1} == told[-1]
    assert len(told) == 2


def test_progress_log_of_one_moment_has_no_rate(spark):
    df = spark.createDataFrame([(1, k, t) for k, t in enumerate([0, 0, 2, 8])], "run int, k int, t long").withColumn("t", F.timestamp_seconds("t"))
    got = [(r.k, r.done, r.total, r.rate, r.eta) for r in progress.progress_log(df, "run", "t", ["k"]).orderBy("k").collect()]
    assert got == [(0, 1, 4, 0.0, None), (1, 2, 4, 0.0, None), (2, 3, 4, 1.5, 1 / 1.5), (3, 4, 4, 0.5, 0.0)]


def packed_files(folder):
    """Contents by name of the loose files and of the members of archives."""
    out = {}
    for p in sorted(Path(folder).rglob("*.tar.gz")):
        for name, data in label_source.members(label_source.fs.LocalFileSystem(), str(p)):
            assert (key := str(p.parent.relative_to(folder) / name)) not in out
            out[key] = data
    return {k: v for k, v in files(folder).items() if not k.endswith(".tar.gz")} | out


@pytest.mark.parametrize("size", [10, 0])
def test_packed_files_are_those_of_a_loose_run_in_few_files(spark, tmp_path, size):
    images, replies, df, ask = made(spark, 60)
    settings = layered({"batch_size": size})
    known = spark.createDataFrame(KNOWN, "name string, id int")
    steps = []
    run = lambda **more: relabel_flow.relabel(df, ask, f"{tmp_path}/labels", f"{tmp_path}/state", settings, known, packed=True, **more)
    run(progress=steps.append, stop=lambda: bool(steps))
    run(together=None)
    _, out, review, _ = plain(images, replies, size or 10**9)
    out = out if size else {Path(k).name: v for k, v in out.items()}
    assert packed_files(tmp_path / "labels") == out and state_of(spark, tmp_path, settings)[1:] == (review, sorted(Path(f).stem for f in out))
    archives = list((tmp_path / "labels").rglob("*.tar.gz"))
    assert not list((tmp_path / "labels").rglob("*.txt")) and len(archives) <= (-(-60 // size) if size else relabel_flow.ARCHIVES)
    batch = lambda name: int(name.split("/")[0][6:]) if "/" in name else None
    back = {(r.stem, r.batch): r.content.encode() for r in labels.label_files(spark, f"{tmp_path}/labels").collect()}
    assert back == {(Path(k).stem, batch(k)): v for k, v in out.items()}
    # Done again without its record, a run replaces what is there.
    relabel_flow.relabel(df, ask, f"{tmp_path}/labels", f"{tmp_path}/again", settings, known, packed=True)
    assert packed_files(tmp_path / "labels") == out


def test_archives_take_over_other_files_and_break_off_whole(tmp_path):
    def rows(*some):
        stems, contents, archives = zip(*some)
        return pa.RecordBatch.from_arrays([pa.array(stems), pa.array(contents, pa.string()), pa.array([3] * len(some), pa.int32()), pa.array(archives, pa.int32())], ["stem", "content", "batch", "archive"])

    writer = label_source.Writer(str(tmp_path), ["stem", "content", "batch", "archive"], False)
    long = "é" * 90 + " x\n'"
    first = writer.write(iter([rows(("a", "1", 0), (long, None, 0)), rows(("b", "2" * 600, 0), ("c", "3", 4))]))
    assert (first.files, first.bytes) == (4, 602) == (writer.write(iter([rows(("a", "1", 0), (long, "", 0), ("b", "2" * 600, 0), ("c", "3", 4))])).files, 602)
    writer.write(iter([rows(("b", "new", 0), ("d", "4", 0))]))

    def broken():
        yield rows(("a", "half", 0), ("c", "half", 4))
        raise OSError("lost")

    with pytest.raises(OSError):
        writer.write(broken())
    writer.commit([first])
    want = {"batch_0003/a.txt": b"1", f"batch_0003/{long}.txt": b"", "batch_0003/b.txt": b"new", "batch_0003/c.txt": b"3", "batch_0003/d.txt": b"4"}
    assert packed_files(tmp_path) == want and not (tmp_path / label_source.STAGING).exists()
    for bad in ([("a", "1", 0), ("a", "2", 0)], [("a", "1", 0), ("b", "1", 1), ("c", "1", 0)], [("../x", "1", 0)]):
        with pytest.raises(ValueError):
            writer.write(iter([rows(*bad)]))
    loose = label_source.Writer(str(tmp_path), ["stem", "content", "batch"], False)
    with pytest.raises(ValueError, match="packed"):
        loose.write(iter([rows(("z", "1", 0))]))
    (tmp_path / "batch_0003" / label_source.PACKED).unlink()
    (tmp_path / "batch_0003" / "z.txt").write_text("loose")
    with pytest.raises(ValueError, match="loose"):
        writer.write(iter([rows(("a", "1", 0))]))
    writer.abort([])
    label_source.Writer(str(tmp_path), ["stem", "content"], True)
    assert packed_files(tmp_path) == {}


def test_a_run_leaves_no_working_tables_and_no_file_for_each_image(spark, tmp_path, monkeypatch):
    n = 300
    rows = [(k, 10 + k, 20 + k, line) for k in range(n) for line in (1, 2)]
    df = spark.createDataFrame(rows, "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int")
    df.coalesce(1).write.parquet(f"{tmp_path}/lineitem.parquet")
    monkeypatch.setattr(relabel_queries, "shared_folder", lambda spark: f"{tmp_path}/shared")
    monkeypatch.setattr(durable, "shared_folder", lambda spark: f"{tmp_path}/shared")
    monkeypatch.setattr(relabel_queries, "RUN_BATCH", 100)
    got = relabel_queries.relabel_run(spark, str(tmp_path)).collect()
    assert len({r.stem for r in got}) == len(got) == n - len(range(0, n, 23)) and sorted({r.batch for r in got}) == [0, 1, 2]
    assert len([p for p in (tmp_path / "shared" / "relabel").rglob("*") if p.is_file() and "labels" in p.parts]) < 12
    assert not list((tmp_path / "shared" / "scratch").rglob("*.parquet"))
