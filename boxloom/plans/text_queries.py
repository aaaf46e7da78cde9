"""Queries on model replies, prompts and option strings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from boxloom.functions import text as t
from boxloom.functions.repair import repaired
from boxloom.operators import boxes as box_ops
from boxloom.operators import rounds as round_ops
from boxloom.plans import shapes
from boxloom.sources.tables import read_table, spread


def judge_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = F.col("reply")
    return shapes.judge_replies(spark, sf_dir).select(
        "o_orderkey", t.judge_score(t.without_thoughts(r)).alias("score"), t.judge_feedback(t.without_thoughts(r)).alias("feedback"), t.judge_actions(t.without_thoughts(r)).alias("actions")
    )


JUDGE_SQL = f"""
with {shapes.WITH},
c as (select o_orderkey, trim(regexp_replace(reply, '(?s)<think>.*?</think>', '', 'g')) as r from replies)
select o_orderkey, least(10, coalesce(try_cast(nullif(regexp_extract(r, '(?s)<score>\\s*(\\d+)\\s*</score>', 1), '') as int), 0)) as score,
  trim(regexp_extract(r, '(?s)<feedback>(.*?)</feedback>', 1)) as feedback, trim(regexp_extract(r, '(?s)<actions>(.*?)</actions>', 1)) as actions from c
"""


def action_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of the judge's actions as verb, box and rest (an addition: the grammar is only prompted for)."""
    line = F.col("line")
    lines = judge_parse(spark, sf_dir).select("o_orderkey", F.posexplode(F.split("actions", "\n")).alias("pos", "line")).where("line <> '' and line <> 'NONE'")
    return lines.select(
        "o_orderkey", "pos", F.regexp_extract(line, r"^(REMOVE|RELABEL|MODIFY|ADD)\b", 1).alias("verb"),
        t.present(F.regexp_extract(line, r"#(\d+)", 1)).cast("int").alias("box"), t.present(F.regexp_extract(line, r"-> (.*)$", 1)).alias("becomes"),
    )


ACTIONS_SQL = f"""
with {shapes.WITH},
a as (select o_orderkey, regexp_extract(reply, '(?s)<actions>(.*?)</actions>', 1) as s from replies),
l as (select o_orderkey, unnest(string_split(s, chr(10))) as line, generate_subscripts(string_split(s, chr(10)), 1) - 1 as pos from a)
select o_orderkey, cast(pos as int) as pos, regexp_extract(line, '^(REMOVE|RELABEL|MODIFY|ADD)\\b', 1) as verb, cast(nullif(regexp_extract(line, '#(\\d+)', 1), '') as int) as box, nullif(regexp_extract(line, '-> (.*)$', 1), '') as becomes
from l where line <> '' and line <> 'NONE'
"""


def applied_actions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boxes of images after a judge's actions: all kinds, repeated, in any case, and lines that are none."""
    boxes = shapes.boxes(spark, sf_dir).select("image_id", "det_idx", "label", *[F.col(c).cast("int").alias(c) for c in ("x1", "y1", "x2", "y2")])
    text = F.expr(
        """case image_id % 3 when 0 then 'NONE' else concat('REMOVE #', image_id % 7, '\nRELABEL #2 -> first\n relabel  #2 ->  Last one \nMODIFY #3 bbox -> [1, 2.5,', 30 + image_id % 50, '.5 ,40]\nModify #4 bbox -> [1,2,3]
ADD new thing at [5,6,', 7 + image_id % 9, ',8]\nREMOVE #99999\nMODIFY #2 bbox->[9,9,19,19]\nadd X at [1.5,2.5,3,4]\nnothing\nADD bad at [1,2,3,4.5.6]') end"""
    )
    return round_ops.applied_actions(boxes, boxes.select("image_id").distinct().withColumn("actions", text))


APPLIED_SQL = f"""
with {shapes.WITH},
i as (select image_id, max(det_idx) as last from boxes group by 1 having image_id % 3 <> 0),
k as (select image_id, det_idx, label, x1, y1, x2, y2 from boxes where image_id % 3 = 0 or det_idx <> image_id % 7),
c as (select image_id, det_idx, case when image_id % 3 <> 0 and det_idx = 2 then 'Last one' else label end as label,
  case when image_id % 3 = 0 then null when det_idx = 2 then [9, 9, 19, 19] when det_idx = 3 then [1, 2, cast(round_even(30 + image_id % 50 + 0.5, 0) as int), 40] end as n, x1, y1, x2, y2 from k)
select image_id, cast(det_idx as int) as det_idx, label, cast(coalesce(n[1], x1) as int) as x1, cast(coalesce(n[2], y1) as int) as y1, cast(coalesce(n[3], x2) as int) as x2, cast(coalesce(n[4], y2) as int) as y2 from c
union all select image_id, cast(last + 1 as int), 'new thing', 5, 6, cast(7 + image_id % 9 as int), 8 from i
union all select image_id, cast(last + 2 as int), 'X', 2, 2, 3, 4 from i
"""


def feedback_translate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Feedback of an order kept and moved for the tile at (200, 100) of 512 x 512 in an image of 1000 x 800."""
    o = read_table(spark, sf_dir, "orders").selectExpr(
        "o_orderkey", "concat('no place\nnear (', cast(o_custkey % 1000 as string), ', ', cast(o_orderkey % 1000 as string), ') and (', cast(o_orderkey % 700 as string), ',', cast(o_custkey % 900 as string), ')') as feedback"
    )
    tile = [F.lit(v) for v in (200, 100, 512, 512, 1000, 800)]
    return o.select("o_orderkey", t.feedback_for_tile(F.col("feedback"), *tile).alias("feedback"))


FEEDBACK_SQL = """
with o as (select o_orderkey, o_custkey % 1000 as ax, o_orderkey % 1000 as ay, o_orderkey % 700 as bx, o_custkey % 900 as b_y from orders),
p as (select *, ax * 1000 / 1000 as pax, ay * 800 / 1000 as pay, bx * 1000 / 1000 as pbx, b_y * 800 / 1000 as pby from o),
k as (select *, pax >= 200 and pax <= 712 and pay >= 100 and pay <= 612 as ia, pbx >= 200 and pbx <= 712 and pby >= 100 and pby <= 612 as ib from p)
select o_orderkey, 'no place' || case when ia or ib then chr(10) || 'near ' ||
  case when ia then '(' || cast(cast(round_even((pax - 200) * 1000 / 512, 0) as bigint) as varchar) || ',' || cast(cast(round_even((pay - 100) * 1000 / 512, 0) as bigint) as varchar) || ')' else '(' || ax || ', ' || ay || ')' end || ' and ' ||
  case when ib then '(' || cast(cast(round_even((pbx - 200) * 1000 / 512, 0) as bigint) as varchar) || ',' || cast(cast(round_even((pby - 100) * 1000 / 512, 0) as bigint) as varchar) || ')' else '(' || bx || ',' || b_y || ')' end
  else '' end as feedback from k
"""


def _wrapped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversation turns as detector replies: thoughts, an answer, a fence and an array around the text."""
    c = read_table(spark, sf_dir, "conversations")
    return c.select(
        "conv_id", "turn",
        F.concat(F.lit("<think>x</think>"), F.when(F.col("turn") % 4 == 0, F.concat(F.lit("<answer>```\n```md\n```\n```a\n```json\n"), "text", F.lit("\n```\n```\n```\n```\n```</answer>")))
            .when(F.col("turn") % 2 == 0, F.concat(F.lit("<answer>```json\n"), "text", F.lit("\n```</answer>"))).otherwise(F.col("text"))).alias("reply"),
        F.concat(F.lit("see ["), F.length("text").cast("string"), F.lit(", [1]] or "), F.when(F.col("turn") % 3 == 0, "[").otherwise("]"), "text").alias("listed"),
    )


def strip_think_answer(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = F.col("reply")
    return _wrapped(spark, sf_dir).select("conv_id", "turn", t.without_fences(t.answer_of(t.without_thoughts(r))).alias("body"))


def _bare_sql(x: str, times: int) -> str:
    """``x`` without white space at its ends and, so many times, without a fence around it."""
    x = f"regexp_replace({x}, '^\\s+|\\s+$', '', 'g')"
    return x if not times else _bare_sql(f"regexp_replace({_bare_sql(x, times - 1)}, '(?s)^```[a-zA-Z]*\\r?\\n?(.*?)```\\s*$', '\\1')", 0)


STRIP_SQL = rf"""
with w as (select conv_id, turn, '<think>x</think>' || case
    when turn % 4 = 0 then '<answer>```' || chr(10) || '```md' || chr(10) || '```' || chr(10) || '```a' || chr(10) || '```json' || chr(10) || text || repeat(chr(10) || '```', 5) || '</answer>'
    when turn % 2 = 0 then '<answer>```json' || chr(10) || text || chr(10) || '```</answer>' else text end as reply from conversations),
a as (select conv_id, turn, regexp_replace(regexp_replace(reply, '(?s)<think>.*?</think>', '', 'g'), '^\s+|\s+$', '', 'g') as r from w),
b as (select conv_id, turn, case when regexp_matches(r, '(?s)<answer>.*?</answer>') then regexp_replace(regexp_extract(r, '(?s)<answer>(.*?)</answer>', 1), '^\s+|\s+$', '', 'g') else r end as r from a)
select conv_id, turn, {_bare_sql("r", 7)} as body from b
"""


def balanced_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = t.with_detection_json(_wrapped(spark, sf_dir), "listed", "array")
    return found.select("conv_id", "turn", F.md5(F.col("array").cast("binary")).alias("digest"), F.length("array").alias("n"))


BALANCED_SQL = """
with l as (select conv_id, turn, 'see [' || length(text) || ', [1]] or ' || case when turn % 3 = 0 then '[' else ']' end || text as s from conversations),
b as (select conv_id, turn, s, strpos(s, '[') as at, unnest(list_transform(range(1, 60), lambda i: {'i': i, 'up': length(regexp_replace(substr(s, strpos(s, '['), i), '[^\\[]', '', 'g')), 'down': length(regexp_replace(substr(s, strpos(s, '['), i), '[^\\]]', '', 'g'))})) as p from l),
e as (select conv_id, turn, min(p.i) as n from b where p.up = p.down and p.up > 0 group by conv_id, turn)
select l.conv_id, l.turn, md5(substr(s, strpos(s, '['), n)) as digest, cast(length(substr(s, strpos(s, '['), n)) as int) as n from l left join e on l.conv_id = e.conv_id and l.turn = e.turn
"""


def _detector_replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A detector's JSON by line item, with entries that must be dropped."""
    return spread(shapes.plain_boxes(spark, sf_dir).select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "label", "x1", "y1", "x2", "y2")).select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey",
        F.expr(
            """concat('[{"label":"', label, '","bbox_2d":[', x1, ',', y1, ',"', x2, '",', y2 * 2, ']},{"label":"zz","bbox_2d":[1,2,3,4]},"text",{"label":"A","bbox_2d":[', x1,
            ',null,3,4]},{"label":"R","bbox_2d":[5,7,5,900]},{"label":"A","bbox_2d":[9,8,1.9]},{"label":"A","bbox_2d":[', x2, '.7,90.2,', x1, '.2,10.9]}', case when l_partkey % 5 = 0 then ',]' else ']' end)"""
        ).alias("reply"),
    )


def validate_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every entry of the replies, with what it was dropped for or its label and box."""
    read = repaired(t.with_detection_json(_detector_replies(spark, sf_dir), "reply"), "json", "value")
    parsed = read.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.posexplode(t.wrapped_list(F.col("value"), F.col("json"), box_ops.ENTRY)).alias("pos", "item"))
    return box_ops.validated(parsed, "item", shapes.CATEGORIES)


VALIDATE_SQL = f"""
with {shapes.WITH},
r as (select l_orderkey, l_linenumber, l_partkey, l_suppkey, '[{{"label":"' || label || '","bbox_2d":[' || x1 || ',' || y1 || ',"' || x2 || '",' || y2 * 2 || ']}},{{"label":"zz","bbox_2d":[1,2,3,4]}},"text",{{"label":"A","bbox_2d":[' || x1
  || ',null,3,4]}},{{"label":"R","bbox_2d":[5,7,5,900]}},{{"label":"A","bbox_2d":[9,8,1.9]}},{{"label":"A","bbox_2d":[' || x2 || '.7,90.2,' || x1 || '.2,10.9]}}' || case when l_partkey % 5 = 0 then ',]' else ']' end as reply from boxes),
l as (select * exclude (reply), json_extract(cast(regexp_replace(reply, ',\\]$', ']') as json), '$[*]') as entries from r),
e as (select * exclude (entries), unnest(entries) as e, generate_subscripts(entries, 1) - 1 as pos from l),
f as (select *, case when json_type(e, '$.label') = 'VARCHAR' then json_extract_string(e, '$.label') end as label,
  case when json_type(e, '$.bbox_2d') = 'ARRAY' then list_transform(json_extract_string(e, '$.bbox_2d[*]'), lambda x: try_cast(x as double)) end as n from e),
g as (select *, greatest(0, least(1000, least(n[1], n[3]))) as a, greatest(0, least(1000, least(n[2], n[4]))) as b, greatest(0, least(1000, greatest(n[1], n[3]))) as c, greatest(0, least(1000, greatest(n[2], n[4]))) as d from f),
w as (select *, case when json_type(e) <> 'OBJECT' then 'not an object' when label is null or label not in ('A', 'R') then 'unknown label' when n is null or len(n) <> 4 then 'malformed box'
  when len(list_filter(n, lambda x: x is null)) > 0 then 'not numeric' when c - a < 1 or d - b < 1 then 'degenerate' end as drop_reason from g)
select l_orderkey, l_linenumber, l_partkey, l_suppkey, cast(pos as int) as pos, drop_reason, label,
  case when drop_reason is null then cast(trunc(a) as int) end as x1, case when drop_reason is null then cast(trunc(b) as int) end as y1,
  case when drop_reason is null then cast(trunc(c) as int) end as x2, case when drop_reason is null then cast(trunc(d) as int) end as y2 from w
"""


def json_unwrap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lists under the keys that replies wrap them in, known or not, as many entries as the line number; some are beside another list."""
    li = read_table(spark, sf_dir, "lineitem")
    keys = F.array(*[F.lit(k) for k in (*t.WRAPPERS, "other", "zz")])
    key = F.get(keys, (F.col("l_partkey") % 7).cast("int"))
    before = F.when(F.col("l_suppkey") % 3 == 0, '{"note":[],"').when(F.col("l_suppkey") % 3 == 1, '{"note":"[]","').otherwise('{"note":{"a":[0]},"')
    reply = F.concat(before, key, F.lit('":['), F.array_join(F.array_repeat(F.lit("{}"), F.col("l_linenumber")), ","), F.lit('],"a":[1,2,3,4,5,6,7,8,9]}'))
    found = t.wrapped_list(F.try_parse_json("reply"), F.col("reply"))
    return li.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", reply.alias("reply")).select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.size(found).alias("n"))


UNWRAP_SQL = """
with r as (select l_orderkey, l_linenumber, l_partkey, l_suppkey, case l_suppkey % 3 when 0 then '{"note":[],"' when 1 then '{"note":"[]","' else '{"note":{"a":[0]},"' end
  || (['detections', 'objects', 'results', 'items', 'data', 'other', 'zz'])[l_partkey % 7 + 1] || '":[' || array_to_string(list_transform(range(l_linenumber), lambda i: '{}'), ',') || '],"a":[1,2,3,4,5,6,7,8,9]}' as reply from lineitem),
k as (select *, list_filter(['detections', 'objects', 'results', 'items', 'data'], lambda k: json_type(reply, '$.' || k) = 'ARRAY') as known, list_filter(json_keys(reply), lambda k: json_type(reply, '$.' || k) = 'ARRAY') as listed from r)
select l_orderkey, l_linenumber, l_partkey, l_suppkey, cast(json_array_length(reply, '$.' || coalesce(known[1], listed[1])) as int) as n from k
"""


def verify_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boxes that a recorded verification keeps; a failed call keeps its box."""
    e = read_table(spark, sf_dir, "events")
    reply = F.expr("case event_id % 5 when 0 then '<present>YES</present>' when 1 then '<present> no </present> yes' when 2 then 'yes, it is' when 3 then 'absent' end")
    return e.select("event_id", t.said_present(reply).alias("kept"))


VERIFY_SQL = r"""
with r as (select event_id, case event_id % 5 when 0 then '<present>YES</present>' when 1 then '<present> no </present> yes' when 2 then 'yes, it is' when 3 then 'absent' end as reply from events)
select event_id, case when reply is null then true when regexp_matches(reply, '(?i)<present>\s*(yes|no)\s*</present>') then lower(regexp_extract(reply, '(?i)<present>\s*(yes|no)\s*</present>', 1)) = 'yes' else contains(lower(reply), 'yes') end as kept from r
"""


def detector_prompt(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prompts with categories, feedback and, unless there are none, required actions; by digest."""
    r = judge_parse(spark, sf_dir)
    actions = F.when((F.upper(F.trim("actions")) != "NONE") & (F.trim("actions") != ""), F.concat(F.lit("\nRequired actions:\n"), F.trim("actions"))).otherwise("")
    block = F.when(F.col("feedback") != "", F.concat(F.lit("\nCorrections:"), actions, F.lit("\nFeedback:\n"), "feedback")).otherwise("")
    prompt = F.concat(F.lit("Find: "), F.array_join(F.array(*[F.lit(c) for c in shapes.CATEGORIES]), ", "), block)
    return r.select("o_orderkey", F.md5(prompt.cast("binary")).alias("digest"))


PROMPT_SQL = f"""
with p as ({JUDGE_SQL})
select o_orderkey, md5('Find: A, R' || case when feedback <> '' then chr(10) || 'Corrections:' || case when actions <> '' and upper(actions) <> 'NONE' then chr(10) || 'Required actions:' || chr(10) || actions else '' end || chr(10) || 'Feedback:' || chr(10) || feedback else '' end) as digest from p
"""


#: A detector's prompt of one's own.
TEMPLATE = "Find {{ categories_list }}.{{category_definitions}}{{ feedback_block }}"


def template_prompt(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prompts by a template, with all boxes of an order as candidate regions and its judge's feedback; by digest."""
    box = F.struct(F.struct("l_linenumber", "l_partkey", "l_suppkey").alias("o"), *[F.expr(e).alias(c) for c, e in (("x1", "l_partkey % 900"), ("y1", "l_suppkey % 900"), ("x2", "l_partkey % 900 + 90"), ("y2", "l_suppkey % 900 + 90"))])
    boxes = read_table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(box)).alias("b"))
    regions = F.transform("b", lambda r, i: F.struct((i + 1).alias("id"), r.x1.alias("x1"), r.y1.alias("y1"), r.x2.alias("x2"), r.y2.alias("y2")))
    told = judge_parse(spark, sf_dir).join(boxes, F.col("o_orderkey") == F.col("l_orderkey"), "left").withColumn("regions", regions)
    prompt = t.filled(TEMPLATE, categories_list=F.lit(", ".join(shapes.CATEGORIES)), category_definitions=t.candidates_block(F.col("regions")), feedback_block=F.concat(F.lit("\nFeedback: "), "feedback"))
    return told.select("o_orderkey", F.md5(prompt.cast("binary")).alias("digest"))


TEMPLATE_SQL = f"""
with p as ({JUDGE_SQL}),
b as (select *, row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey) as i, l_partkey % 900 as x, l_suppkey % 900 as y from lineitem),
c as (select l_orderkey, chr(10) || 'Candidate regions on the 0-1000 scale:' || chr(10) || string_agg('- Candidate #' || i || ': bbox_2d [' || x || ', ' || y || ', ' || x + 90 || ', ' || y + 90 || ']', chr(10) order by i) as s from b group by 1)
select o_orderkey, md5('Find A, R.' || coalesce(s, '') || chr(10) || 'Feedback: ' || feedback) as digest from p left join c on o_orderkey = l_orderkey
"""


def region_prompt(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the classifier of each user's regions is told; some users have no definitions."""
    seen = read_table(spark, sf_dir, "events").groupBy("user_id").agg(F.sort_array(F.collect_set("event_type")).alias("classes"))
    definitions = F.expr("case user_id % 3 when 0 then ' ' when 1 then concat('click: of ', user_id) end")
    return seen.select("user_id", t.region_prompt(F.col("classes"), definitions).alias("prompt"))


REGION_PROMPT_SQL = """
select user_id, 'Classes: ' || string_agg(distinct event_type, ', ' order by event_type) || case when user_id % 3 = 1 then chr(10) || 'Definitions:' || chr(10) || 'click: of ' || user_id else '' end
  || chr(10) || 'Name the one class of this region, or none: {"class":"<name>","confidence":<0-100>,"reasoning":"<short>"}' as prompt from events group by user_id
"""


def endpoints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where requests go: to an outside service for every third part, else to a local server."""
    url, key, model = [F.concat(F.lit(s), F.col("p_partkey").cast("string")) for s in ("https://api.example.com/", "k", "m")]
    e = t.endpoint((8000 + F.col("p_partkey") % 10), F.col("p_partkey") % 3 == 0, url, key, model)
    return read_table(spark, sf_dir, "part").select("p_partkey", *[v.alias(k) for k, v in e.items()])


ENDPOINT_SQL = """
select p_partkey, case when p_partkey % 3 = 0 then 'https://api.example.com/' || p_partkey else 'http://127.0.0.1:' || 8000 + p_partkey % 10 || '/v1' end as base_url,
  case when p_partkey % 3 = 0 then 'k' || p_partkey else 'no-key' end as api_key, case when p_partkey % 3 = 0 then 'm' || p_partkey else 'local-model' end as model_name from part
"""


def judge_prompt(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All detections of an image as the judge sees them: numbered, in JSON; by digest."""
    entry = F.struct(F.concat(F.lit("Box #"), F.col("i").cast("string")).alias("box_index"), F.col("label"), F.array("x1", "y1", "x2", "y2").alias("bbox_2d"))
    listed = shapes.boxes(spark, sf_dir).withColumn("i", F.col("det_idx")).groupBy("image_id").agg(F.array_sort(F.collect_list(F.struct("i", entry.alias("e")))).alias("rows"))
    return listed.select("image_id", F.md5(F.to_json(F.transform("rows", lambda r: r.e)).cast("binary")).alias("digest"))


JUDGE_PROMPT_SQL = f"""
with {shapes.WITH}
select image_id, md5('[' || string_agg('{{"box_index":"Box #' || det_idx || '","label":"' || label || '","bbox_2d":[' || x1 || ',' || y1 || ',' || x2 || ',' || y2 || ']}}', ',' order by det_idx) || ']') as digest from boxes group by image_id
"""


def classify_prompt(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each user's classifier is told: classes known so far in the order of sight, '*' without any."""
    seen = read_table(spark, sf_dir, "events").groupBy("user_id", "event_type").agg(F.min("event_id").alias("first"))
    return seen.groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct("first", "event_type"))).alias("c")).select(
        "user_id", F.concat(F.lit("Known classes: "), F.coalesce(t.present(F.array_join(F.transform("c", lambda x: x.event_type), ", ")), F.lit("*"))).alias("prompt")
    )


CLASSIFY_PROMPT_SQL = """
select user_id, 'Known classes: ' || string_agg(event_type, ', ' order by first) as prompt from (select user_id, event_type, min(event_id) as first from events group by 1, 2) group by 1
"""


def data_uri(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "documents").select("doc_id", F.md5(t.data_uri(F.encode("text", "utf-8")).cast("binary")).alias("digest"))


URI_SQL = "select doc_id, md5('data:image/jpeg;base64,' || base64(encode(text))) as digest from documents"


def serving_extra(spark: SparkSession, sf_dir: str) -> DataFrame:
    """key=value options of events, told apart by kind."""
    e = read_table(spark, sf_dir, "events")
    token = F.expr("case event_id % 7 when 0 then concat(' n = ', user_id) when 1 then concat('f=', user_id, '.5') when 2 then 'b=TRUE' when 3 then concat('s=', event_type) when 4 then event_type when 5 then '=1' else 'e=1e3' end")
    return e.select("event_id", t.coerced(token).alias("c")).select("event_id", "c.key", "c.kind", "c.value")


EXTRA_SQL = r"""
with t as (select event_id, case event_id % 7 when 0 then ' n = ' || user_id when 1 then 'f=' || user_id || '.5' when 2 then 'b=TRUE' when 3 then 's=' || event_type when 4 then event_type when 5 then '=1' else 'e=1e3' end as token from events),
k as (select event_id, case when contains(token, '=') then trim(regexp_extract(token, '^([^=]*)=', 1)) end as key, case when contains(token, '=') then trim(regexp_extract(token, '^[^=]*=(.*)$', 1)) end as value from t)
select event_id, key, case when coalesce(key, '') = '' then 'error' when lower(value) in ('true', 'false') then 'bool' when regexp_full_match(value, '[+-]?[0-9]+') then 'int' when try_cast(value as double) is not null then 'float' else 'str' end as kind, value from k
"""


def category_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read_table(spark, sf_dir, "events")
    return e.select("event_id", F.array_join(t.categories_of(F.concat(F.lit(" a ,, "), "event_type", F.lit(", ,"), F.col("user_id").cast("string"))), "|").alias("names"),
                    F.array_join(t.extensions_of(F.concat(F.lit("JPG .png "), "event_type")), "|").alias("extensions"))


CATEGORY_SQL = r"""
with t as (select event_id, ' a ,, ' || event_type || ', ,' || user_id as names, 'JPG .png ' || event_type as extensions from events)
select event_id, array_to_string(list_filter(list_transform(string_split(names, ','), lambda x: trim(x)), lambda x: x <> ''), '|') as names,
  array_to_string(list_transform(list_filter(string_split_regex(extensions, '[,\s]+'), lambda x: x <> ''), lambda x: case when starts_with(x, '.') then lower(x) else '.' || lower(x) end), '|') as extensions from t
"""


def model_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = read_table(spark, sf_dir, "part")
    name = F.expr("case p_partkey % 4 when 0 then concat('/models/', p_partkey) when 1 then concat('org/m', p_partkey, ':Q4') when 2 then concat('m', p_partkey, '.GGUF') else concat('org/m', p_partkey) end")
    return p.select("p_partkey", t.model_source(name).alias("s")).select("p_partkey", "s.pattern", "s.repo")


MODEL_SQL = """
select p_partkey, case p_partkey % 4 when 0 then '/models/' || p_partkey when 1 then '*Q4*.gguf' when 2 then 'm' || p_partkey || '.GGUF' else '*.gguf' end as pattern, case p_partkey % 4 when 1 then 'org/m' || p_partkey when 3 then 'org/m' || p_partkey end as repo from part
"""


def status_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns as table cells: cut to 120 characters and escaped; and the tail of a log of them."""
    c = read_table(spark, sf_dir, "conversations")
    return c.select("conv_id", "turn", t.escaped(F.substring("text", 1, 120)).alias("cell"), F.md5(t.tail_of(F.repeat(F.concat("text", F.lit("\n")), F.lit(40))).cast("binary")).alias("tail"))


STATUS_SQL = """
select conv_id, turn, replace(replace(replace(replace(replace(substring(text, 1, 120), '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), '''', '&#x27;') as cell,
  md5(case when length(l) > 8192 then '...' || right(l, 8192) else l end) as tail from (select *, repeat(text || chr(10), 40) as l from conversations)
"""


def colours(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = read_table(spark, sf_dir, "part")
    name = F.expr("case p_partkey % 3 when 0 then concat('#', lpad(hex(p_partkey * 37 % 16777216), 6, '0')) when 1 then 'Cyan' else 'none' end")
    return p.select("p_partkey", F.array_join(t.colour_of(name, (255, 0, 0)), ",").alias("rgba"))


COLOUR_SQL = """
select p_partkey, case p_partkey % 3 when 0 then (p_partkey * 37 % 16777216) // 65536 || ',' || (p_partkey * 37 % 65536) // 256 || ',' || p_partkey * 37 % 256 || ',255' when 1 then '0,255,255,255' else '0,0,0,0' end as rgba from part
"""

QUERIES = {
    "judge_parse": judge_parse, "action_parse": action_parse, "applied_actions": applied_actions, "feedback_translate": feedback_translate, "strip_think_answer": strip_think_answer,
    "balanced_array": balanced_array, "validate_json": validate_json, "json_unwrap": json_unwrap, "verify_filter": verify_filter,
    "detector_prompt": detector_prompt, "judge_prompt": judge_prompt, "classify_prompt": classify_prompt, "data_uri": data_uri,
    "serving_extra": serving_extra, "category_lists": category_lists, "model_sources": model_sources, "status_text": status_text, "colours": colours,
    "template_prompt": template_prompt, "region_prompt": region_prompt, "endpoints": endpoints,
}

ORACLES = {
    "judge_parse": JUDGE_SQL, "action_parse": ACTIONS_SQL, "applied_actions": APPLIED_SQL, "feedback_translate": FEEDBACK_SQL, "strip_think_answer": STRIP_SQL,
    "balanced_array": BALANCED_SQL, "validate_json": VALIDATE_SQL, "json_unwrap": UNWRAP_SQL, "verify_filter": VERIFY_SQL,
    "detector_prompt": PROMPT_SQL, "judge_prompt": JUDGE_PROMPT_SQL, "classify_prompt": CLASSIFY_PROMPT_SQL, "data_uri": URI_SQL,
    "serving_extra": EXTRA_SQL, "category_lists": CATEGORY_SQL, "model_sources": MODEL_SQL, "status_text": STATUS_SQL, "colours": COLOUR_SQL,
    "template_prompt": TEMPLATE_SQL, "region_prompt": REGION_PROMPT_SQL, "endpoints": ENDPOINT_SQL,
}
