from __future__ import annotations

import json

import pytest

from boxloom import config
from boxloom.sources import labels, sinks, templates


def test_layers_and_checks():
    s = config.layered({"max_rounds": 3, "categories": " a ,, b"}, {"max_rounds": 5})
    assert s.max_rounds == 5 and s.category_list() == ["a", "b"] and s.score_threshold == 8
    for bad in ({"nope": 1}, {"prep_tile_overlap": 0.6}, {"start_index": -1}, {"start_index": 5, "end_index": 5}, {"task": "x"}, {"task": "auto_label"}, {"gpu_memory_utilization": 0}, {"conf_threshold": 9}):
        with pytest.raises(ValueError):
            config.layered(bad)
    with pytest.raises(ValueError):
        config.layered([1])
    assert config.layered({"prep_send_pixel_bounds": True}).pixel_bounds(False) == {"min_pixels": 200704, "max_pixels": 4194304}
    assert config.layered({"prep_send_pixel_bounds": True}).pixel_bounds(True) == {}


def test_options():
    assert config.key_values(["a=1", "b = 1.5", "c=TRUE", "d=x=y", "e="]) == {"a": 1, "b": 1.5, "c": True, "d": "x=y", "e": ""}
    assert config.key_values(None) == {}
    for bad in ("none", "=1"):
        with pytest.raises(ValueError):
            config.key_values([bad])


def test_label_folders(spark, tmp_path):
    (tmp_path / "l").mkdir()
    for name, text in (("a.txt", "0 .1 .2 .3 .4\n\n1 2 3\n"), ("b.TXT", "\n \n"), ("c.txt", "0 1 1 1 1"), ("d.csv", "x")):
        (tmp_path / "l" / name).write_text(text)
    lines = labels.label_lines(spark, str(tmp_path / "l"))
    got = sorted((r.stem, r.line_no, r.line) for r in lines.collect())
    assert got == [("a", 1, "0 .1 .2 .3 .4"), ("a", 2, ""), ("a", 3, "1 2 3"), ("b", 1, ""), ("b", 2, " "), ("c", 1, "0 1 1 1 1")]
    assert sorted(r.stem for r in labels.labelled_stems(lines).collect()) == ["a", "c"]
    assert sorted(r.name for r in labels.image_names(spark, str(tmp_path / "l")).collect()) == ["a.txt", "b.TXT", "c.txt", "d.csv"]


def test_descriptions():
    assert labels.class_names(["x", "y"]) == {"x": 0, "y": 1} and labels.class_names({"3": "z"}) == {"z": 3} and labels.class_names(None) == {}
    assert labels.updated_description({"path": "p", "nc": 9}, {"b": 5, "a": 7}) == {"path": "p", "names": ["b", "a"], "nc": 2}
    assert labels.updated_description({}, {}) is None


def test_ledger_knows_its_settings(spark, tmp_path):
    path = str(tmp_path / "ledger")
    assert labels.ledger(spark, path, "s1").count() == 0
    labels.record(spark.createDataFrame([("a", 0), ("b", 0)], "stem string, batch int"), path, "s1")
    labels.record(spark.createDataFrame([("c", 1)], "stem string, batch int"), path, "s1")
    labels.record(spark.createDataFrame([("d", 1)], "stem string, batch int"), path, "s2")
    assert sorted(r.stem for r in labels.ledger(spark, path, "s1").collect()) == ["a", "b", "c"]


def test_results_are_written(spark, tmp_path):
    rounds = spark.createDataFrame([(1, 1, 3, "f"), (1, 2, 9, "g"), (2, 1, 0, "h")], "image_id long, round int, score int, feedback string")
    found = spark.createDataFrame([(1, 2, 0, 1, "b", 1, 2, 3, 4), (1, 2, 0, 0, "a", 5, 6, 7, 8), (1, 1, 0, 0, "a", 0, 0, 1, 1)], "image_id long, round int, tile_idx int, pos int, label string, x1 int, y1 int, x2 int, y2 int")
    read = lambda name: sorted((json.loads(line) for p in (tmp_path / name).glob("part-*.json") for line in p.read_text().splitlines()), key=lambda r: r["image_id"])
    sinks.write_best(rounds, found, str(tmp_path / "best"))
    assert read("best") == [
        {"image_id": 1, "round": 2, "score": 9, "detections": [{"label": "a", "bbox_2d": [5, 6, 7, 8]}, {"label": "b", "bbox_2d": [1, 2, 3, 4]}]},
        {"image_id": 2, "round": 1, "score": 0, "detections": None},
    ]
    sinks.write_history(rounds, str(tmp_path / "history"))
    assert json.loads(read("history")[0]["history"])[1]["feedback"] == "g"
    files = spark.createDataFrame([("a", 0, "1 2\n3 4\n"), ("b", 1, "")], "stem string, batch int, content string")
    sinks.write_label_files(files, str(tmp_path / "labels"), True)
    assert (tmp_path / "labels/batch_0000/a.txt").read_text() == "1 2\n3 4\n" and (tmp_path / "labels/batch_0001/b.txt").read_text() == ""


def test_damaged_ledger_files_are_done_again(spark, tmp_path):
    path = tmp_path / "ledger"
    labels.record(spark.createDataFrame([("a", 0)], "stem string, batch int"), str(path), "s")
    (path / "part-bad.parquet").write_bytes(b"no parquet")
    assert [r.stem for r in labels.ledger(spark, str(path), "s").collect()] == ["a"]


def test_settings_files_and_templates(tmp_path):
    pytest.importorskip("yaml")
    path = tmp_path / "s.yaml"
    path.write_text("max_rounds: 4\nimages: [a, b]\nserving_extra: {x: 1}\n")
    s = config.layered(config.from_file(str(path)), {"max_rounds": 6})
    assert (s.max_rounds, s.images, s.serving_extra) == (6, ("a", "b"), {"x": 1})
    path.write_text("")
    assert config.from_file(str(path)) == {}
    path.write_text("- a\n")
    with pytest.raises(ValueError):
        config.from_file(str(path))
    (tmp_path / "t.txt").write_text("  Find {what}\n")
    (tmp_path / "bad.txt").write_bytes(b"\xff\xfe\xff")
    assert [templates.template(tmp_path, name, "else") for name in ("t.txt", "none.txt", "bad.txt")] == ["Find {what}", "else", "else"]
