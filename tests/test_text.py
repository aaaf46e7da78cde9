from __future__ import annotations

import hashlib
import json
import re

import pytest
from pyspark.sql import functions as F

from boxloom.functions import colours
from boxloom.functions import repair as repairs
from boxloom.functions import text as t
from boxloom.functions.repair import repair, repaired
from boxloom.operators import rounds
from boxloom.operators.boxes import ENTRY, validated
from boxloom.plans import shapes, text_queries
from tests.oracle import SF_DIR


def one(spark, fn, *values):
    df = spark.createDataFrame([(v,) for v in values], "x string")
    return [r[0] for r in df.select(fn(F.col("x"))).collect()]


def plain_array(text):
    start = text.find("[")
    depth = 0
    for i in range(start, len(text)) if start >= 0 else ():
        depth += {"[": 1, "]": -1}.get(text[i], 0)
        if depth == 0:
            return text[start : i + 1]
    return text


def test_balanced_arrays(spark):
    cases = ["", "none", "[1]", "a [1,[2]] b [3]", "[[", "x ] [1] y", "[ \n ]", "é[é]é", "[1]]", '["]"]', "a" * 3000 + "[" * 50 + "]" * 50 + "z"]
    assert one(spark, t.balanced_array, *cases) == [plain_array(c) for c in cases]


def test_thoughts_fences_and_answers(spark):
    assert one(spark, t.without_thoughts, "<think>a\nb</think> x ", "<think>open", "a<think>1</think>b<think>2</think>", None) == ["x", "<think>open", "ab", None]
    assert one(spark, t.without_fences, "```json\n[1]\n```", "``` ```\nx\n``` ```", "a ```x``` b", "```\n```py\n1\n```\n```") == ["[1]", "x", "a ```x``` b", "1"]
    assert one(spark, t.answer_of, "a <answer> 1 </answer> <answer>2</answer>", "none", "<answer>open") == ["1", "none", "<answer>open"]
    assert one(spark, t.detection_json, "<think>[9]</think>see <answer>```json\n[{\"a\":[1]}]\n```</answer>") == ['[{"a":[1]}]']


def test_judge_replies(spark):
    cases = ["<score> 7 </score><feedback> f </feedback><actions>NONE</actions>", "<score>99</score>", "no tags ", "<score>x</score>", "<score>-3</score>", "<score>99999999999</score>"]
    assert one(spark, t.judge_score, *cases)[:5] == [7, 10, 0, 0, 0]
    assert one(spark, t.judge_feedback, *cases)[:3] == ["f", "<score>99</score>", "no tags"]
    assert one(spark, t.judge_actions, *cases)[:2] == ["NONE", ""]


def test_verification_keeps_on_failure(spark):
    assert one(spark, t.said_present, None, "<present>YES</present>", "<present>no</present> YES", "oh yes", "nothing", "") == [True, True, False, True, False, False]


def plain_feedback(text, x, y, w, h, iw, ih):
    out = []
    for line in (text or "").split("\n"):
        points = re.findall(r"\((\d+)\s*,\s*(\d+)\)", line)
        inside = lambda a, b: x <= int(a) * iw / 1000 <= x + w and y <= int(b) * ih / 1000 <= y + h
        if points and not any(inside(*p) for p in points):
            continue

        def move(m):
            a, b = m[1], m[2]
            if not inside(a, b) or m[0] not in (f"({a},{b})", f"({a}, {b})"):
                return m[0]
            return f"({round((int(a) * iw / 1000 - x) * 1000 / w)},{round((int(b) * ih / 1000 - y) * 1000 / h)})"

        out.append(re.sub(r"\((\d+)\s*,\s*(\d+)\)", move, line))
    return "\n".join(out)


def test_feedback_for_a_tile(spark):
    cases = [None, "", "plain", "at (300,200) and (5, 5)", "far (900, 900)\nplain\n(250, 130) x", "(300 ,200) odd spacing", "(300,  200)", "(200,125)(712,765)"]
    args = (200, 100, 512, 512, 1000, 800)
    got = one(spark, lambda x: t.feedback_for_tile(x, *[F.lit(a) for a in args]), *cases)
    assert got == [plain_feedback(c, *args) for c in cases]


def test_options(spark):
    cases = ["a=1", "a = -2 ", "b=1.5", "b=.5", "b=1e3", "c=TRUE", "d=x=y", "e=", "=1", "none", "f=1_000", "g=nan", "h=1."]
    kinds = ["int", "int", "float", "float", "float", "bool", "str", "str", "error", "error", "int", "float", "float"]
    df = spark.createDataFrame([(c,) for c in cases], "x string").select(t.coerced(F.col("x")).alias("c")).select("c.*").collect()
    assert [r.kind for r in df] == kinds
    assert [(r.key, r.value) for r in df[:2]] == [("a", "1"), ("a", "-2")] and df[6].value == "x=y" and df[9].key is None


def test_names_colours_and_escapes(spark):
    assert one(spark, t.categories_of, " a, ,b ,,", "") == [["a", "b"], []]
    assert one(spark, t.extensions_of, "JPG .png  jpeg") == [[".jpg", ".png", ".jpeg"]]
    assert one(spark, lambda x: t.colour_of(x, (1, 2, 3)), "#0a0B0c", "none", "RED", "odd") == [[10, 11, 12, 255], [0, 0, 0, 0], [255, 0, 0, 255], [1, 2, 3, 255]]
    assert one(spark, t.escaped, "<a href=\"x\">'&'</a>") == ["&lt;a href=&quot;x&quot;&gt;&#x27;&amp;&#x27;&lt;/a&gt;"]
    assert one(spark, lambda x: t.tail_of(x, 3, ".."), "abcdef", "abc") == ["..def", "abc"]


def plain_validate(item, categories):
    if not isinstance(item, dict):
        return "not an object"
    if item.get("label") not in categories:
        return "unknown label"
    b = item.get("bbox_2d")
    if not isinstance(b, list) or len(b) != 4:
        return "malformed box"
    try:
        b = [float(v) for v in b]
    except (TypeError, ValueError):
        return "not numeric"
    lo_x, hi_x = sorted((b[0], b[2]))
    lo_y, hi_y = sorted((b[1], b[3]))
    box = [max(0, min(1000, v)) for v in (lo_x, lo_y, hi_x, hi_y)]
    return "degenerate" if box[2] - box[0] < 1 or box[3] - box[1] < 1 else [int(v) for v in box]


def test_validation_in_order(spark):
    items = [
        {"label": "a", "bbox_2d": [1, 2, 30, 40]}, {"label": "a", "bbox_2d": [30.9, "40.5", -5, 2000]}, {"label": "b", "bbox_2d": [1]}, {"bbox_2d": [1, 2, 3, 4]}, {"label": 5, "bbox_2d": [1, 2, 3, 4]},
        {"label": "a", "bbox_2d": [1, 2, 3]}, {"label": "a", "bbox_2d": "x"}, {"label": "a", "bbox_2d": [1, None, 3, 4]}, {"label": "a", "bbox_2d": ["x", 1, 2, 3]}, {"label": "a", "bbox_2d": [1, 1, 1.9, 9]},
        "text", 7, None, [1], {"label": "a", "bbox_2d": [999.5, 0, 1500, 10]}, {"label": ["a"], "bbox_2d": [1, 2, 3, 4]}, {},
    ]
    df = spark.createDataFrame([(k, json.dumps(i)) for k, i in enumerate(items)], "k int, j string").select("k", F.parse_json("j").alias("item"))
    got = {r.k: r.drop_reason or [r.x1, r.y1, r.x2, r.y2] for r in validated(df, "item", ["a"]).collect()}
    want = {k: plain_validate(i if not isinstance(i, dict) or not isinstance(i.get("label"), list) else {**i, "label": None}, ["a"]) for k, i in enumerate(items)}
    assert got == want


@pytest.mark.parametrize(
    ("text", "value"),
    [
        ('{"a": 1,}', {"a": 1}), ("{'a': 'it\\'s'}", {"a": "it's"}), ("[1, 2", [1, 2]), ('{"a": [1, {"b": "x', {"a": [1, {"b": "x"}]}), ("```json\n[1,]\n```", [1]),
        ("{a: True, b: None}", {"a": True, "b": None}), ('{"a": 1 // note\n}', {"a": 1}), ('["a,]"]', ["a,]"]), ("[-1.5e3]", [-1500.0]),
    ],
)
def test_repairs(text, value):
    assert json.loads(repair(text)) == value


def test_repair_gives_up_and_leaves_valid_json(spark):
    assert repair("]") is None and repair(None) is None
    df = spark.createDataFrame([(1, '{"a":1}'), (2, "{'a':2}"), (3, "}{"), (4, None)], "i int, j string")
    assert sorted((r.i, r.j) for r in repaired(df, "j").collect()) == [(1, '{"a":1}'), (2, '{"a":2}'), (3, None), (4, None)]


def test_judge_prompt_lists_every_box_of_an_image(spark):
    rows = shapes.boxes(spark, SF_DIR).collect()
    listed = {}
    for r in sorted(rows, key=lambda r: (r.image_id, r.det_idx)):
        listed.setdefault(r.image_id, []).append({"box_index": f"Box #{r.det_idx}", "label": r.label, "bbox_2d": [r.x1, r.y1, r.x2, r.y2]})
    assert max(map(len, listed.values())) > 20
    want = {k: hashlib.md5(json.dumps(v, separators=(",", ":")).encode()).hexdigest() for k, v in listed.items()}
    assert {r.image_id: r.digest for r in text_queries.judge_prompt(spark, SF_DIR).collect()} == want


def test_fences_of_any_depth_and_lists_under_any_key(spark):
    deep = "```\n" * 5 + "x" + "\n```" * 5
    assert one(spark, t.without_fences, deep, "```a```b", "``` x", None) == ["x", "```a```b", "``` x", None]
    cases = ['{"note":1,"z":[1,2],"a":[3]}', '{"data":{},"items":[4]}', '[5]', '{"a":1}', "7", '{"b":"[]","c":[6]}']
    df = spark.createDataFrame([(c,) for c in cases], "x string")
    got = [r[0] for r in df.select(F.to_json(t.wrapped_list(F.try_parse_json("x"), F.col("x")))).collect()]
    assert got == ["[1,2]", "[4]", "[5]", None, None, "[6]"]


def test_templates_take_columns_and_name_what_is_missing(spark):
    df = spark.createDataFrame([("x", None)], "a string, b string")
    a, b = df.a, df.b
    got = df.select(t.filled("{{ a }}-{{b}} {a}", a=a, b=b).alias("double"), t.filled("{a}{b}", a=a, b=b).alias("single"), t.filled("none", a=a).alias("plain")).first()
    assert tuple(got) == ("x- {a}", "x", "none")
    with pytest.raises(ValueError, match="c"):
        t.filled("{{ c }}", a=a)


def test_forms_of_colours(spark):
    cases = {"#1aF": [17, 170, 255, 9], "#1aFc": [17, 170, 255, 9], "#10203040": [16, 32, 48, 9], "rgb(1, 2,255)": [1, 2, 255, 9], "none": [0, 0, 0, 0], "": [0, 0, 0, 0], None: [0, 0, 0, 0], "Red": [255, 0, 0, 9], "#12": [7, 8, 9, 9], "transparent": [7, 8, 9, 9]}
    df = spark.createDataFrame([(c,) for c in cases], "c string")
    assert {r.c: r.rgba for r in df.select("c", t.colour_of(F.col("c"), (7, 8, 9), 9).alias("rgba")).collect()} == cases


def test_colour_names_and_hues(spark):
    import colorsys

    hues = [(h, s, v) for h in (0, 30, 60, 119, 200, 300, 359, 360, 400) for s in (0, 50, 100) for v in (0, 25, 50, 80, 100)]
    rows = [(f"HSL({h}, {s}%, {v}%)", [int(x * 255 + 0.5) for x in colorsys.hls_to_rgb(h / 360, v / 100, s / 100)]) for h, s, v in hues]
    rows += [("RebeccaPurple", [102, 51, 153]), (" tan ", [210, 180, 140]), ("lime", [0, 255, 0]), ("green", [0, 128, 0]), ("hsl(1,2,3)", [7, 8, 9]), ("nocolour", [7, 8, 9])]
    got = spark.createDataFrame(rows, "c string, rgb array<int>").select("c", "rgb", t.colour_of(F.col("c"), (7, 8, 9), 5).alias("rgba")).collect()
    assert [(r.c, r.rgba) for r in got if r.rgba != [*r.rgb, 5]] == []
    assert len(colours.NAMES) == 148


def test_actions_are_read_and_applied(spark):
    lines = ["REMOVE #1", " remove #2 ", "RELABEL #3 -> a -> b", "MODIFY #4 bbox -> [1,2, 3.5 ,4]", "ADD red box at [1,2,3,4]", "NONE", "", "REMOVE 1", "ADD at [1,2,3,4]", "MODIFY #4 bbox -> [1,2,3]", None]
    got = [tuple(r) for r in spark.createDataFrame([(k, x) for k, x in enumerate(lines)], "k int, l string").select("k", *[c.alias(n) for n, c in t.action(F.col("l")).items()]).orderBy("k").collect()]
    none = (None,) * 4
    assert [g[1:] for g in got] == [
        ("REMOVE", 1, None, None), ("REMOVE", 2, None, None), ("RELABEL", 3, "a -> b", None), ("MODIFY", 4, None, [1.0, 2.0, 3.5, 4.0]), ("ADD", None, "red box", [1.0, 2.0, 3.0, 4.0]), *[none] * 6,
    ]
    found = spark.createDataFrame([(1, 1, "a", 0, 0, 9, 9), (1, 2, "b", 0, 0, 8, 8), (2, 1, "c", 1, 1, 2, 2)], "image_id long, det_idx int, label string, x1 int, y1 int, x2 int, y2 int")
    asked = spark.createDataFrame([(1, "REMOVE #1\nRELABEL #1 -> z\nMODIFY #2 bbox -> [1,2,3,4]\nMODIFY #2 bbox -> [5,6,7.5,8.5]\nADD n at [0,0,1,1]"), (3, "ADD only at [4,4,5,5]\nADD two at [6,6,7,7]"), (2, None)], "image_id long, actions string")
    out = sorted(map(tuple, rounds.applied_actions(found, asked).collect()))
    assert out == [(1, 2, "b", 5, 6, 8, 8), (1, 3, "n", 0, 0, 1, 1), (2, 1, "c", 1, 1, 2, 2), (3, 1, "only", 4, 4, 5, 5), (3, 2, "two", 6, 6, 7, 7)]


def test_short_arrays_are_mended_without_python(spark, monkeypatch):
    texts = ['[1,]', '[{"a":[1,2,],},\n]', '["x,]",["\\\\\\",]"],]', '[[[[1,],],],] ', "[]"]
    left = ['[1,] x', '["[",],]]', '{"a":1,}', "['a',]", '[1,,]', '["a,]', "[" * 6 + "1," + "]" * 6, "[" + "1, " * 300 + "]"]

    def used(text):
        if text in texts:
            raise AssertionError(f"{text} went to Python")
        return plain(text)

    plain = repairs.repair
    monkeypatch.setattr(repairs, "repair", used)
    df = spark.createDataFrame(list(enumerate([*texts, *left, None])), "i int, j string")
    got = {r.i: (r.j, r.v) for r in repaired(df, "j", "v").select("i", "j", F.to_json("v").alias("v")).collect()}
    for i, text in enumerate(texts):
        assert json.loads(got[i][0]) == json.loads(got[i][1]) == json.loads(plain(text) if text != "[]" else text)
    for i, text in enumerate(left, len(texts)):
        want = plain(text)
        assert got[i][0] == want and (got[i][1] is None if want is None else json.loads(got[i][1]) == json.loads(want))
    assert got[len(texts) + len(left)] == (None, None)


def test_entries_are_read_alike_from_variants_and_at_once(spark):
    entries = [{}, {"label": "A"}, {"label": "A", "bbox_2d": [1, "2", 30.5, 4e1]}, {"label": None}, {"label": 5, "bbox_2d": []}, "A", None, 7, [], {"label": "A", "bbox_2d": [1, None, 3, 4]},
               {"bbox_2d": [9, 9, 1, 1], "label": "A", "more": {"label": "zz"}}, {"label": "A", "bbox_2d": "1,2,3,4"}, {"label": "zz", "bbox_2d": [1, 2, 3, 4]}, {"label": "A", "bbox_2d": [1, 2, 3, 4, 5]}, {"label": "A", "bbox_2d": [1, 2, [3], True]}]
    df = spark.createDataFrame([(json.dumps(entries),), (json.dumps({"objects": entries}),), (json.dumps({"z": entries}),)], "j string").withColumn("v", F.try_parse_json("j"))
    for kind in ("variant", ENTRY):
        items = df.select(F.posexplode(t.wrapped_list(F.col("v"), F.col("j"), kind)).alias("pos", "item"))
        got = validated(items, "item", ["A"]).collect()
        assert len(got) == 3 * len(entries)
        said = {r.pos: (r.drop_reason, r.label, r.x1, r.y1, r.x2, r.y2) for r in got}
        assert len({tuple(r) for r in got}) == len(entries)
        names, boxes = "unknown label", "malformed box"
        assert [said[k][0] for k in range(len(entries))] == [names, boxes, None, names, names, *["not an object"] * 4, "not numeric", None, boxes, names, boxes, said[14][0]]
        assert said[2] == (None, "A", 1, 2, 30, 40) and said[10] == (None, "A", 1, 1, 9, 9) and said[4][1] is None and said[12][1] == "zz"


@pytest.mark.parametrize("reply", [None, "", " ", "\x0b[1]\f", "[1] ", "<think>x</think> [1]", "```\n[1]\n```", " <answer> [1] </answer>", "a [1] b", "[1", "]["])
def test_json_text_in_steps_is_that_of_one_expression(spark, reply):
    df = spark.createDataFrame([(reply,)], "reply string")
    assert t.with_detection_json(df, "reply").select("json").collect() == df.select(t.detection_json(F.col("reply")).alias("json")).collect()
