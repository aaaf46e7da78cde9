"""Parsing of model replies and building of prompts, as column expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from boxloom.functions import colours

#: Keys under which a reply may wrap its list of detections, in order of preference. Fixed values.
WRAPPERS = ("detections", "objects", "results", "items", "data")


def present(x: Column) -> Column:
    """``x``, with an empty string as null."""
    return F.nullif(x, F.lit(""))


#: What is trimmed.
WHITE = " \t\n\x0b\f\r"


def strip(x: Column) -> Column:
    """``x`` without white space at its ends."""
    return F.btrim(x, F.lit(WHITE))


def without_thoughts(reply: Column) -> Column:
    """``reply`` without closed think blocks; an unclosed one stays."""
    return strip(F.when(F.contains(reply, F.lit("<think>")), F.regexp_replace(reply, r"(?s)<think>.*?</think>", "")).otherwise(reply))


def without_fences(reply: Column) -> Column:
    """``reply`` without code fences around the whole of it, however deep they are nested.

    Every step takes two fence marks, so that half of their number is steps enough; the rest of the steps are idle.
    """
    bare = lambda x: strip(F.regexp_replace(x, r"(?s)^```[a-zA-Z]*\r?\n?(.*?)```\s*$", "$1"))
    marks = F.floor((F.size(F.split(reply, "```")) - 1) / 2).cast("int")
    step = lambda s, _: F.when(s.done, s).otherwise(F.struct(bare(s.text).alias("text"), (bare(s.text) == s.text).alias("done")))
    start = F.struct(strip(reply).alias("text"), F.lit(False).alias("done"))
    walked = F.aggregate(F.array_repeat(F.lit(0), marks), start, step, lambda s: s.text)
    return F.when(F.contains(reply, F.lit("```")), walked).otherwise(strip(reply))


def answer_of(reply: Column) -> Column:
    """The first answer block, trimmed; the whole reply if there is none."""
    return F.when(F.contains(reply, F.lit("<answer>")) & reply.rlike(r"(?s)<answer>.*?</answer>"), strip(F.regexp_extract(reply, r"(?s)<answer>(.*?)</answer>", 1))).otherwise(reply)


def balanced_array(text: Column) -> Column:
    """The first ``[...]`` whose brackets balance, strings not told apart; else the text unchanged.

    Only brackets are walked, not characters: the text is cut after each of them.
    """
    at = F.instr(text, "[")
    tail = F.substring(text, at, F.length(text))
    walked = _walk(tail)
    return F.when((at > 0) & walked.done, F.substring(tail, F.lit(1), walked.length)).otherwise(text)


#: A tail up to this length is matched whole before it is walked: by brackets up to four deep, none of which is tried twice.
SHORT = 600
_FLAT = r"[^\[\]]*+"
BALANCED = rf"\[{_FLAT}\]"
for _ in range(3):
    BALANCED = rf"\[{_FLAT}(?:{BALANCED}{_FLAT})*+\]"


def _walk(tail: Column) -> Column:
    """struct(depth, length, done) after the brackets of ``tail``; length up to where they first balance."""
    return F.aggregate(
        F.regexp_extract_all(tail, F.lit(r"[^\[\]]*[\[\]]"), F.lit(0)),
        F.struct(F.lit(0).alias("depth"), F.lit(0).alias("length"), F.lit(False).alias("done")),
        lambda s, p: F.when(s.done, s).otherwise(_step(s, p)),
    )


def _step(state: Column, part: Column) -> Column:
    depth = state.depth + F.when(F.endswith(part, F.lit("[")), 1).otherwise(-1)
    return F.struct(depth.alias("depth"), (state.length + F.length(part)).alias("length"), (depth == 0).alias("done"))


def detection_json(reply: Column) -> Column:
    """What is left of ``reply`` to be read as a JSON array of detections."""
    return balanced_array(without_fences(answer_of(without_thoughts(reply))))


def with_detection_json(df: DataFrame, reply: str, name: str = "json") -> DataFrame:
    """``df`` with ``name``: what is left of the reply in column ``reply`` to be read as JSON.

    The same as ``detection_json``, one column for each step: each step uses the one before several times,
    and as one expression it would be worked out anew for each use.
    """
    # Texts are passed on as they are where there is nothing to take off, as trimming and cutting look at every character.
    bare, body, open_ = F.col("_bare"), F.col("_body"), F.col("_open")
    clean = ~F.contains(F.col(reply), F.lit("<think>"))
    for c in WHITE:
        clean &= ~F.startswith(F.col(reply), F.lit(c)) & ~F.endswith(F.col(reply), F.lit(c))
    steps = (
        ("_bare", F.when(clean, F.col(reply)).otherwise(without_thoughts(F.col(reply)))),
        ("_body", answer_of(bare)),
        ("_open", F.when(F.contains(body, F.lit("```")), without_fences(body)).otherwise(body)),
        ("_at", F.instr("_open", "[")),
        ("_tail", F.when(F.col("_at") == 1, open_).otherwise(F.substring("_open", F.col("_at"), F.length("_open")))),
        ("_short", F.when(F.length("_tail") <= SHORT, F.regexp_extract("_tail", "^" + BALANCED, 0)).otherwise("")),
        ("_walk", F.when(F.col("_short") == "", _walk(F.col("_tail")))),
    )
    out = df
    for step, value in steps:
        out = out.withColumn(step, value)
    whole = (F.col("_at") > 0) & F.col("_walk.done")
    return out.withColumn(name, F.when(F.col("_short") != "", F.col("_short")).when(whole, F.substring("_tail", F.lit(1), F.col("_walk.length"))).otherwise(F.col("_open"))).drop(*[s for s, _ in steps])


def wrapped_list(value: Column, text: Column | None = None, kind: str = "variant") -> Column:
    """The list in a VARIANT reply: itself, or that under the first known key; null if there is none.

    Its entries are of ``kind``, null where they are none. With its JSON ``text``, where the order of its keys is kept, the first list under any key comes last.
    """
    own = F.try_variant_get(value, "$", f"array<{kind}>")
    found = [own, *[F.try_variant_get(value, f"$.{k}", f"array<{kind}>") for k in WRAPPERS]]
    if text is not None:
        fields = F.map_values(F.from_json(text, "map<string,variant>"))
        lists = F.filter(fields, lambda v: F.startswith(F.schema_of_variant(v), F.lit("ARRAY")))
        found.append(F.when(F.startswith(F.schema_of_variant(value), F.lit("OBJECT")), F.try_variant_get(F.get(lists, 0), "$", f"array<{kind}>")))
    return F.coalesce(*found)


def judge_score(reply: Column) -> Column:
    """The score of a judge's reply within 0-10; 0 if there is none."""
    digits = present(F.regexp_extract(reply, r"(?s)<score>\s*(\d+)\s*</score>", 1))
    return F.least(F.lit(10), F.greatest(F.lit(0), F.coalesce(digits.try_cast("int"), F.lit(0))))


def judge_feedback(reply: Column) -> Column:
    """The feedback block, trimmed; else the whole reply, trimmed."""
    return F.when(reply.rlike(r"(?s)<feedback>.*?</feedback>"), strip(F.regexp_extract(reply, r"(?s)<feedback>(.*?)</feedback>", 1))).otherwise(strip(reply))


#: Forms of an action: to drop, rename or move box N of the round before, or to add one.
_BOX = r"\[\s*([0-9.]+)\s*,\s*([0-9.]+)\s*,\s*([0-9.]+)\s*,\s*([0-9.]+)\s*\]"
ACTIONS = {
    "REMOVE": r"(?i)^\s*REMOVE\s+#(\d+)\s*$",
    "RELABEL": r"(?i)^\s*RELABEL\s+#(\d+)\s*->\s*(\S.*?)\s*$",
    "MODIFY": r"(?i)^\s*MODIFY\s+#(\d+)\s+bbox\s*->\s*" + _BOX + r"\s*$",
    "ADD": r"(?i)^\s*ADD\s+(\S.*?)\s+at\s*" + _BOX + r"\s*$",
}


def action(line: Column) -> dict[str, Column]:
    """verb, box (from 1), label and corners (array of four doubles) of one line of a judge's actions; all null for any other line."""
    is_ = {verb: line.rlike(form) for verb, form in ACTIONS.items()}
    part = lambda verb, k: F.regexp_extract(line, ACTIONS[verb], k)
    corners = lambda verb: F.array(*[part(verb, k).try_cast("double") for k in range(2, 6)])
    verb = None
    for name, fits in is_.items():
        verb = F.when(fits, name) if verb is None else verb.when(fits, name)
    return {
        "verb": verb,
        "box": F.when(is_["REMOVE"], part("REMOVE", 1)).when(is_["RELABEL"], part("RELABEL", 1)).when(is_["MODIFY"], part("MODIFY", 1)).try_cast("int"),
        "label": F.when(is_["RELABEL"], part("RELABEL", 2)).when(is_["ADD"], part("ADD", 1)),
        "corners": F.when(is_["MODIFY"], corners("MODIFY")).when(is_["ADD"], corners("ADD")),
    }


def judge_actions(reply: Column) -> Column:
    """The actions block, trimmed; empty if there is none."""
    return strip(F.regexp_extract(reply, r"(?s)<actions>(.*?)</actions>", 1))


def said_present(reply: Column) -> Column:
    """Whether a verification reply keeps its box; a missing reply, as after a failed call, does."""
    word = F.upper(F.regexp_extract(reply, r"(?is)<present>\s*(yes|no)\s*</present>", 1))
    return F.when(reply.isNull(), True).when(word != "", word == "YES").otherwise(F.contains(F.upper(reply), F.lit("YES")))


def filled(template: str, **values: Column) -> Column:
    """``template`` with every ``{{ name }}``, or else every ``{name}``, replaced by the column of that name.

    A name without a column is an error; a null value is empty.
    """
    form = r"\{\{\s*(\w+)\s*\}\}"
    parts = re.split(form if re.search(form, template) else r"\{(\w+)\}", template)
    if missing := sorted(set(parts[1::2]) - values.keys()):
        raise ValueError(f"the template names what is not given: {', '.join(missing)}")
    return F.concat(*[F.coalesce(values[p], F.lit("")) if k % 2 else F.lit(p) for k, p in enumerate(parts)])


def candidates_block(regions: Column) -> Column:
    """Candidate regions, an array of (id, x1, y1, x2, y2), as lines of a prompt; none give an empty string."""
    corners = lambda r: F.concat_ws(", ", *[r[c].cast("string") for c in ("x1", "y1", "x2", "y2")])
    lines = F.transform(regions, lambda r: F.concat(F.lit("- Candidate #"), r.id.cast("string"), F.lit(": bbox_2d ["), corners(r), F.lit("]")))
    return F.when(F.size(regions) > 0, F.concat(F.lit("\nCandidate regions on the 0-1000 scale:\n"), F.array_join(lines, "\n"))).otherwise("")


def region_prompt(classes: Column, definitions: Column) -> Column:
    """What a classifier of drawn regions is told: its classes, what they mean unless that is blank, and the form of its reply."""
    meant = F.when(strip(F.coalesce(definitions, F.lit(""))) != "", F.concat(F.lit("\nDefinitions:\n"), definitions)).otherwise("")
    return F.concat(F.lit("Classes: "), F.array_join(classes, ", "), meant, F.lit('\nName the one class of this region, or none: {"class":"<name>","confidence":<0-100>,"reasoning":"<short>"}'))


def endpoint(port: Column, external: Column, url: Column, key: Column, model: Column) -> dict[str, Column]:
    """base_url, api_key and model_name of a request: an outside service's, else the local server's."""
    # Fixed values.
    local = {"base_url": F.concat(F.lit("http://127.0.0.1:"), port.cast("string"), F.lit("/v1")), "api_key": F.lit("no-key"), "model_name": F.lit("local-model")}
    return {name: F.when(external, given).otherwise(local[name]) for name, given in zip(local, (url, key, model))}


def feedback_for_tile(feedback: Column, x: Column, y: Column, w: Column, h: Column, image_w: Column, image_h: Column) -> Column:
    """Feedback for one tile: lines without coordinates, and those with a point in the tile.

    Points are (x, y) on the 0-1000 scale of the image; those in the tile are put on its own scale, each
    once. Empty or null feedback gives an empty string.
    """
    form = r"\(\d+\s*,\s*\d+\)"

    def placed(point: Column) -> tuple[Column, Column, Column]:
        px = F.regexp_extract(point, r"\((\d+)\s*,\s*(\d+)\)", 1).cast("long") * image_w / 1000
        py = F.regexp_extract(point, r"\((\d+)\s*,\s*(\d+)\)", 2).cast("long") * image_h / 1000
        return px, py, (px >= x) & (px <= x + w) & (py >= y) & (py <= y + h)

    def moved(point: Column) -> Column:
        px, py, inside = placed(point)
        tx, ty = F.bround((px - x) * 1000 / w).cast("long"), F.bround((py - y) * 1000 / h).cast("long")
        tight = ~point.rlike(r"^\(\d+\s+,|,\s\s|,[^ \d]")
        return F.when(inside & tight, F.concat(F.lit("("), tx.cast("string"), F.lit(","), ty.cast("string"), F.lit(")"))).otherwise(point)

    def line_of(line: Column) -> Column:
        points = F.regexp_extract_all(line, F.lit(form), F.lit(0))
        rest = F.split(line, form)
        joined = F.array_join(F.zip_with(rest, F.transform(points, moved), lambda a, b: F.concat(a, F.coalesce(b, F.lit("")))), "")
        return F.when(F.size(points) == 0, line).when(F.exists(points, lambda p: placed(p)[2]), joined)

    return F.array_join(F.filter(F.transform(F.split(F.coalesce(feedback, F.lit("")), "\n"), line_of), lambda v: v.isNotNull()), "\n")


def coerced(token: Column) -> Column:
    """struct(key, kind, value) of a ``key=value`` token; kind is bool, int, float, str or error."""
    at = F.instr(token, "=")
    key = strip(F.substring(token, F.lit(1), at - 1))
    value = strip(F.substring(token, at + 1, F.length(token)))
    kind = (
        F.when((at == 0) | (key == ""), "error")
        .when(F.lower(value).isin("true", "false"), "bool")
        .when(value.rlike(r"^[+-]?\d+(_\d+)*$"), "int")
        .when(value.rlike(r"^[+-]?(\d+(_\d+)*\.?|\d*\.\d+|\d+\.\d*)([eE][+-]?\d+)?$|(?i)^[+-]?(inf|infinity|nan)$"), "float")
        .otherwise("str")
    )
    return F.struct(F.when(at > 0, key).alias("key"), kind.alias("kind"), F.when(at > 0, value).alias("value"))


def model_source(model: Column) -> Column:
    """struct(pattern, repo): a local model path as it is, else a glob within a repository."""
    m = strip(F.coalesce(model, F.lit("")))
    local = m.rlike(r"^[./~]|\\|(?i)\.(gguf|bin|safetensors)$")
    split = F.instr(m, ":")
    return (
        F.when(local, F.struct(m.alias("pattern"), F.lit(None).cast("string").alias("repo")))
        .when(split > 0, F.struct(F.concat(F.lit("*"), F.substring(m, split + 1, F.length(m)), F.lit("*.gguf")).alias("pattern"), F.substring(m, F.lit(1), split - 1).alias("repo")))
        .otherwise(F.struct(F.lit("*.gguf").alias("pattern"), m.alias("repo")))
    )


def escaped(text: Column) -> Column:
    """``text`` made safe for HTML, quotes included."""
    for plain, safe in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        text = F.replace(text, F.lit(plain), F.lit(safe))
    return text


#: How much of a log is shown.
LOG_TAIL = 8 * 1024


def tail_of(text: Column, n: int = LOG_TAIL, mark: str = "...") -> Column:
    """The last ``n`` characters of ``text`` behind ``mark``; a shorter text as it is."""
    return F.when(F.length(text) > n, F.concat(F.lit(mark), F.right(text, F.lit(n)))).otherwise(text)


def categories_of(text: Column) -> Column:
    """Comma-separated names, trimmed, blanks left out."""
    return F.filter(F.transform(F.split(text, ","), strip), lambda c: c != "")


def extensions_of(text: Column) -> Column:
    """Space-separated file extensions, lower-cased, each with its dot."""
    names = F.filter(F.split(F.lower(text), r"\s+"), lambda e: e != "")
    return F.transform(names, lambda e: F.when(F.startswith(e, F.lit(".")), e).otherwise(F.concat(F.lit("."), e)))


def colour_of(text: Column, fallback: tuple[int, int, int], alpha: int = 255) -> Column:
    """array(r, g, b, a) of a hex colour of 3, 4, 6 or 8 digits, ``rgb(r, g, b)``, ``hsl(h, s%, l%)`` or a name of the web, with ``alpha``.

    'none', empty and null are clear; others fall back. A colour's own alpha does not count.
    """
    low = F.lower(strip(text))
    # A name's code is looked up once: as a column, every use of it would look it up anew.
    return F.get(F.transform(F.array(F.coalesce(colours.code_of(low), low)), lambda t: _rgba(t, fallback, alpha)), 0)


def _rgba(t: Column, fallback: tuple[int, int, int], alpha: int) -> Column:
    """``colour_of`` a text in lower case that is no name."""
    wide = F.when(t.rlike("^#[0-9a-f]{3,4}$"), F.regexp_replace(t, "([0-9a-f])", "$1$1")).otherwise(t)
    part = lambda i: F.conv(F.substring(wide, i, 2), 16, 10).cast("int")
    form = r"^rgb\(\s*(\d{1,3})\s*,\s*(\d{1,3})\s*,\s*(\d{1,3})\s*\)$"
    out = F.when(F.coalesce(t, F.lit("")).isin("", "none"), F.array(*[F.lit(0)] * 4))
    out = out.when(wide.rlike("^#([0-9a-f]{6}|[0-9a-f]{8})$"), F.array(part(2), part(4), part(6), F.lit(alpha)))
    out = out.when(t.rlike(form), F.array(*[F.regexp_extract(t, form, i).try_cast("int") for i in (1, 2, 3)], F.lit(alpha)))
    out = out.when(t.startswith("hsl("), F.coalesce(F.array_append(colours.hsl(t), F.lit(alpha)), F.array(*[F.lit(v) for v in fallback], F.lit(alpha))))
    return out.otherwise(F.array(*[F.lit(v) for v in fallback], F.lit(alpha)))


def data_uri(data: Column, kind: str = "image/jpeg") -> Column:
    """Bytes as a data URI; base64 without the line breaks that Spark puts in."""
    return F.concat(F.lit(f"data:{kind};base64,"), F.replace(F.base64(data), F.lit("\r\n"), F.lit("")))
