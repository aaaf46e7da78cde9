"""Queries with state: trackers, the live session's gate, the replayed detection loop, and JSON repair."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from boxloom.config import layered
from boxloom.functions.imagefile import encode_png
from boxloom.functions.repair import repaired
from boxloom.operators import boxes as box_ops
from boxloom.operators import images as pix
from boxloom.operators import rounds as round_ops
from boxloom.plans import detect as loop
from boxloom.plans import shapes
from boxloom.sources.durable import durable, shared_folder
from boxloom.sources.tables import read_table
from boxloom.streaming import folds, live, tracking


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(session, frame_id, micros, boxes): a moving box by user, a second one on every third event."""
    return framed(read_table(spark, sf_dir, "events"))


def framed(events: DataFrame) -> DataFrame:
    """Frames of ``events``, a table or a stream."""
    return events.select(
        F.col("user_id").alias("session"), F.col("event_id").alias("frame_id"), F.unix_micros(F.col("ts").cast("timestamp")).alias("micros"),
        F.expr("""concat('[[', 100 + event_id % 50, ',', 60 + event_id % 40, ',', 220 + event_id % 50, ',', 190 + event_id % 40, ',"', event_type, '",', 0.3 + (event_id % 7) / 10, ']',
          case when event_id % 3 = 0 then concat(',[300,', 400 + user_id % 90, ',380,', 500 + user_id % 90, ',"far"]') else '' end, ']')""").alias("boxes"),
    )


def bytetrack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return folds.fold_batch(frames(spark, sf_dir), "session", ["frame_id"], tracking.start, tracking.byte_track, tracking.TRACK_SCHEMA)


def sot_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    return folds.fold_batch(frames(spark, sf_dir), "session", ["frame_id"], tracking.start, tracking.tracker("CSRT (TrackerCSRT)"), tracking.TRACK_SCHEMA)


def tracker_ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tracks on every tick of sessions that change their algorithm; every third tick has detections."""
    name = F.expr("element_at(array('ByteTrack', 'CSRT (TrackerCSRT)', 'None (Pass-through)'), cast(1 + frame_id div 500 % 3 as int))")
    ticks = frames(spark, sf_dir).select("session", "frame_id", name.alias("algorithm"), F.when((F.col("session") + F.col("frame_id")) % 3 == 0, F.col("boxes")).alias("boxes"))
    return folds.fold_batch(ticks, "session", ["frame_id"], tracking.tick_start, tracking.tick, tracking.TRACK_SCHEMA)


def pass_through(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Detections that no tracker changes, as rows."""
    box = F.from_json("boxes", "array<array<string>>")
    rows = frames(spark, sf_dir).select("session", "frame_id", F.posexplode(box).alias("pos", "b"))
    return rows.select("session", "frame_id", (F.col("pos") + 1).alias("track_id"), F.get("b", 4).alias("label"), *[F.get("b", i).cast("double").alias(n) for i, n in enumerate(("ymin", "xmin", "ymax", "xmax"))])


PASS_SQL = """
select user_id as session, event_id as frame_id, 1 as track_id, event_type as label, (100 + event_id % 50)::double as ymin, (60 + event_id % 40)::double as xmin, (220 + event_id % 50)::double as ymax, (190 + event_id % 40)::double as xmax from events
union all select user_id, event_id, 2, 'far', 300, 400 + user_id % 90, 380, 500 + user_id % 90 from events where event_id % 3 = 0
"""


def iou_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Overlap of consecutive frames' first boxes in a session, as the association sees it."""
    from boxloom.functions import geometry as g

    b = pass_through(spark, sf_dir).where("track_id = 1").select("session", "frame_id", F.col("xmin").alias("x1"), F.col("ymin").alias("y1"), F.col("xmax").alias("x2"), F.col("ymax").alias("y2"))
    w = Window.partitionBy("session").orderBy("frame_id")
    both = b.select("*", *[F.lag(c).over(w).alias(f"p_{c}") for c in ("x1", "y1", "x2", "y2")]).where("p_x1 is not null")
    return both.select("session", "frame_id", g.iou(g.corners(), g.corners("p_")).alias("iou"))


IOU_SQL = """
with b as (select user_id as session, event_id as frame_id, 60 + event_id % 40 as x1, 100 + event_id % 50 as y1, 190 + event_id % 40 as x2, 220 + event_id % 50 as y2 from events),
p as (select *, lag(x1) over w as px1, lag(y1) over w as py1, lag(x2) over w as px2, lag(y2) over w as py2 from b window w as (partition by session order by frame_id)),
i as (select *, greatest(0, least(x2, px2) - greatest(x1, px1)) * greatest(0, least(y2, py2) - greatest(y1, py1)) as n from p where px1 is not null)
select session, frame_id, n / ((x2 - x1) * (y2 - y1) + (px2 - px1) * (py2 - py1) - n) as iou from i
"""


def frame_overlaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole matrix of every frame: what its session showed in the frame before, against what it shows now."""
    b = pass_through(spark, sf_dir).select("session", "frame_id", "track_id", F.col("xmin").alias("x1"), F.col("ymin").alias("y1"), F.col("xmax").alias("x2"), F.col("ymax").alias("y2"))
    shown = frames(spark, sf_dir).select("session", "frame_id", F.lead("frame_id").over(Window.partitionBy("session").orderBy("frame_id")).alias("next"))
    before = b.join(shown, ["session", "frame_id"]).where("next is not null").drop("frame_id").withColumnRenamed("next", "frame_id")
    return box_ops.overlap_matrix(before.withColumnRenamed("track_id", "track"), b.withColumnRenamed("track_id", "detection"), ["session", "frame_id"], "track", "detection")


OVERLAPS_SQL = f"""
with b as ({PASS_SQL}),
n as (select user_id as session, event_id as frame_id, lead(event_id) over (partition by user_id order by event_id) as next from events),
p as (select b.session, n.next as frame_id, track_id as track, xmin, ymin, xmax, ymax from b join n on b.session = n.session and b.frame_id = n.frame_id),
m as (select p.session, p.frame_id, track, b.track_id as detection, greatest(0, least(p.xmax, b.xmax) - greatest(p.xmin, b.xmin)) * greatest(0, least(p.ymax, b.ymax) - greatest(p.ymin, b.ymin)) as s,
  (p.xmax - p.xmin) * (p.ymax - p.ymin) + (b.xmax - b.xmin) * (b.ymax - b.ymin) as sides from p join b on p.session = b.session and p.frame_id = b.frame_id)
select session, frame_id, track, detection, s / (sides - s) as iou from m
"""


def session_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ticks of a session on which a detection is asked for or applied."""
    ticks = frames(spark, sf_dir).select("session", "frame_id", (F.col("micros") / 1e6).alias("ts"), (F.col("frame_id") % 97 == 0).alias("reset"))
    return folds.fold_batch(ticks, "session", ["frame_id"], tracking.gate_start, tracking.make_gate(refresh=1800.0, latency=600.0), tracking.GATE_SCHEMA)


#: Times of the gate for ticks that are minutes apart.
LIVE_GATE = {"refresh": 1800.0, "latency": 600.0}


def _live_ticks(events: DataFrame) -> DataFrame:
    """Events as ticks of sessions that change their algorithm and begin anew now and then; every third has detections."""
    name = F.expr("element_at(array('ByteTrack', 'CSRT (TrackerCSRT)', 'None (Pass-through)'), cast(1 + frame_id div 500 % 3 as int))")
    rows = framed(events)
    boxes = F.when((F.col("session") + F.col("frame_id")) % 3 == 0, F.col("boxes"))
    return rows.select("session", "frame_id", (F.col("micros") / 1e6).alias("ts"), name.alias("algorithm"), boxes.alias("boxes"), (F.col("frame_id") % 97 == 0).alias("reset"))


def live_ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What live sessions ask for and show on every tick, from the recorded ticks."""
    return live.session_batch(_live_ticks(read_table(spark, sf_dir, "events")), **LIVE_GATE)


def live_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As ``live_ticks``, by a stream over the events' file, with its state kept by Spark."""
    # A pattern, since a stream takes a single file by one only; it fits a folder of files as well.
    events = spark.readStream.schema(read_table(spark, sf_dir, "events").schema).parquet(f"{sf_dir.rstrip('/')}/events.parque[t]")
    return live.run_to_table(live.session_stream(_live_ticks(events), **LIVE_GATE), f"{shared_folder(spark).rstrip('/')}/streams/{uuid.uuid4().hex}")


def detect_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole loop over recorded replies: an order is an image, its lines are the rounds' full-image replies.

    Some replies have a comma too many, some calls failed, and boxes are verified on a second look.
    """
    li = read_table(spark, sf_dir, "lineitem")
    images = read_table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("image_id"), F.lit(1000).alias("w"), F.lit(800).alias("h"))
    entry = F.expr("""concat('{"label":"', l_returnflag, '","bbox_2d":[', (l_partkey * 37) % 700, ',', (l_suppkey * 53) % 700, ',', (l_partkey * 37) % 700 + 90, ',', (l_suppkey * 53) % 700 + 80, ']}')""")
    listed = li.groupBy(F.col("l_orderkey").alias("image_id"), F.least("l_linenumber", F.lit(3)).alias("round")).agg(F.array_sort(F.collect_list(entry)).alias("e"))
    # All rounds read their replies from here, so that the lines are grouped once.
    listed = durable(listed)
    end = F.when(F.col("image_id") % 5 == 0, ",]</answer>").otherwise("]</answer>")
    text = F.concat(F.lit("<think>t</think><answer>["), F.array_join("e", ","), end)
    replies = listed.select("image_id", "round", F.when((F.col("image_id") + F.col("round")) % 7 != 0, text).alias("reply"))
    looks = listed.select("image_id", "round", F.posexplode("e").alias("pos", "x")).select(
        "image_id", "round", "pos", F.expr("case (image_id + pos) % 4 when 0 then '<present>NO</present>' when 2 then 'yes' when 3 then '<present> yes </present>' end").alias("reply")
    )
    scores = images.select("image_id", F.explode(F.array(F.lit(1), F.lit(2), F.lit(3))).alias("round")).withColumn("reply", F.concat(F.lit("<score>"), ((F.col("image_id") * 7 + F.col("round") * 3) % 11).cast("string"), F.lit("</score><feedback>f</feedback>")))
    models = loop.replay(replies, ["image_id", "round"]), loop.replay(scores, ["image_id", "round"])
    rounds, _ = loop.detect(images, *models, shapes.CATEGORIES, tiled=False, verifier=loop.replay(looks, ["image_id", "round", "pos"]))
    return round_ops.best_rounds(rounds).select("image_id", F.col("round").alias("best_round"), F.col("score").alias("best_score"), "n")


DETECT_SQL = """
with e as (select l_orderkey, least(l_linenumber, 3) as round, l_returnflag as label, '{"label":"' || l_returnflag || '","bbox_2d":[' || (l_partkey * 37) % 700 || ',' || (l_suppkey * 53) % 700 || ',' || ((l_partkey * 37) % 700 + 90) || ',' || ((l_suppkey * 53) % 700 + 80) || ']}' as x from lineitem),
p as (select *, row_number() over (partition by l_orderkey, round order by x) - 1 as pos from e),
n as (select l_orderkey, round, count(*) filter (label in ('A', 'R') and (l_orderkey + round) % 7 <> 0 and (l_orderkey + pos) % 4 <> 0) as n from p group by 1, 2),
s as (select o_orderkey as image_id, cast(r as int) as round, cast((o_orderkey * 7 + r * 3) % 11 as int) as score from orders, range(1, 4) t(r)),
d as (select *, coalesce(max(case when score >= 8 then 1 else 0 end) over (partition by image_id order by round rows between unbounded preceding and 1 preceding), 0) as done from s),
b as (select *, row_number() over (partition by image_id order by score desc, round) as k from d where done = 0)
select image_id, b.round as best_round, score as best_score, coalesce(n, 0) as n from b left join n on image_id = l_orderkey and b.round = n.round where k = 1
"""


def json_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Replies with faults that models make, repaired where Spark cannot read them as they are."""
    e = read_table(spark, sf_dir, "events")
    reply = F.expr("""case event_id % 5 when 0 then concat('{"a":', event_id, ',}') when 1 then concat("{'a': ", event_id, '}') when 2 then concat('[{"a":', event_id, '}') when 3 then concat('```json\n{"a":', event_id, '}\n```') else concat('{"a":', event_id, '}') end""")
    fixed = repaired(e.select("event_id", reply.alias("reply")), "reply")
    v = F.try_parse_json("reply")
    return fixed.select("event_id", F.coalesce(F.try_variant_get(v, "$.a", "long"), F.try_variant_get(v, "$[0].a", "long")).alias("a"))


REPAIR_SQL = "select event_id, event_id as a from events"


#: Pixels in a row of a document's picture.
PICTURE_WIDTH = 32


def pictures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(image_id, content): the bytes of every document's text as the pixels of a PNG file, row by row.

    Its scan lines have the filter doc_id % 5, it states the orientation 1 + doc_id % 8, and every eleventh file is cut.
    The texts are few and the pixels' work is much, so they are dealt over all cores.
    """

    def draw(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            files = []
            for ident, text in zip(b["doc_id"], b["text"]):
                raw = bytes(text) if text is not None else b""
                rows = max(1, -(-len(raw) // (3 * PICTURE_WIDTH)))
                img = np.frombuffer(raw.ljust(rows * 3 * PICTURE_WIDTH, b"\0"), np.uint8).reshape(rows, PICTURE_WIDTH, 3)
                file = encode_png(img, int(ident % 5), int(1 + ident % 8))
                files.append(file[: len(file) // 2] if ident % 11 == 0 else file)
            yield pd.DataFrame({"image_id": b["doc_id"], "content": files})

    docs = read_table(spark, sf_dir, "documents").where("doc_id is not null").select("doc_id", F.col("text").cast("binary").alias("text"))
    return docs.repartition(max(spark.sparkContext.defaultParallelism, docs.rdd.getNumPartitions()), "doc_id").mapInPandas(draw, "image_id long, content binary")


def image_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Status, size, orientation and channel means of the documents' pictures, some of which are cut."""
    out = pix.inspected(pictures(spark, sf_dir))
    return out.select("image_id", "status", "w", "h", "orientation", *[F.round(c, 6).alias(c) for c in ("mean_r", "mean_g", "mean_b")])


FILES_SQL = f"""
with t as (select doc_id, regexp_extract_all(hex(encode(coalesce(text, ''))), '..') as x, strlen(coalesce(text, '')) as n from documents where doc_id is not null),
p as (select doc_id, unnest(x) as b, generate_subscripts(x, 1) - 1 as i from t),
m as (select doc_id, sum(cast('0x' || b as int)) filter (i % 3 = 0) as r, sum(cast('0x' || b as int)) filter (i % 3 = 1) as g, sum(cast('0x' || b as int)) filter (i % 3 = 2) as b from p group by 1),
s as (select *, cast(greatest(1, ceil(n / {3 * PICTURE_WIDTH})) as int) as rows, doc_id % 11 = 0 as cut, cast(case when doc_id % 11 = 0 then 1 else 1 + doc_id % 8 end as int) as o from t left join m using (doc_id))
select doc_id as image_id, case when cut then 'unreadable' else 'ok' end as status, case when cut then null when o < 5 then {PICTURE_WIDTH} else rows end as w, case when cut then null when o < 5 then rows else {PICTURE_WIDTH} end as h, o as orientation,
  case when not cut then round(coalesce(r, 0) / (rows * {PICTURE_WIDTH}), 6) end as mean_r, case when not cut then round(coalesce(g, 0) / (rows * {PICTURE_WIDTH}), 6) end as mean_g, case when not cut then round(coalesce(b, 0) / (rows * {PICTURE_WIDTH}), 6) end as mean_b
from s
"""


def frame_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blur, edge and texture metrics of the documents' pictures."""
    return pix.metrics(pictures(spark, sf_dir))


#: Two ways of conditioning that between them have all steps.
CONDITIONED = {"prep_enabled": True, "prep_white_balance": True, "prep_contrast_method": "clahe", "prep_gamma": 1.2, "prep_denoise_method": "bilateral", "prep_sharpen": True, "prep_short_edge": 16}
DENOISED = {"prep_enabled": True, "prep_contrast_method": "autocontrast", "prep_denoise_method": "nlm", "prep_short_edge": 48, "prep_pad_square": True}


def conditioned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Channel means of the pictures after white balance, equalised lightness, gamma, bilateral smoothing, sharpening and letterboxing."""
    return pix.conditioned(pictures(spark, sf_dir), layered(CONDITIONED), (64, 64))


def denoised(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Channel means of the pictures after stretching, non-local means, enlarging and padding to a square."""
    return pix.conditioned(pictures(spark, sf_dir), layered(DENOISED))


def region_proposals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidate regions of the pictures: thresholded, closed, connected and sized."""
    return pix.proposals(pictures(spark, sf_dir))


def drawn_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Connected parts of what was drawn on images: a line of an order is two pixels, some of them too faint."""
    marks = shapes.plain_boxes(spark, sf_dir).selectExpr("image_id", "cast(x1 % 64 as int) as x", "cast(y1 % 48 as int) as y", "cast(l_linenumber * 5 as int) as alpha")
    return pix.drawn_regions(marks.withColumn("x", F.explode(F.array("x", F.col("x") + 1))))


DRAWN_SQL = f"""
with recursive b as (select cast(l_orderkey // {shapes.ORDERS_PER_IMAGE} as bigint) as image_id, cast(((l_partkey * 37) % 700) % 64 as int) as x, cast(((l_suppkey * 53 + l_orderkey * 11) % 700) % 48 as int) as y from lineitem where l_linenumber * 5 > 10),
m as materialized (select distinct image_id, x, y from (select * from b union all select image_id, x + 1, y from b)),
e as materialized (select p.image_id, p.y * 100 + p.x as a, q.y * 100 + q.x as b from (select *, unnest([-1, 0, 1]) as dx from (select *, unnest([-1, 0, 1]) as dy from m)) p join m q on p.image_id = q.image_id and q.x = p.x + dx and q.y = p.y + dy),
r as (select image_id, y * 100 + x as a, y * 100 + x as b from m union select r.image_id, r.a, e.b from r join e on e.image_id = r.image_id and e.a = r.b),
c as (select image_id, a, min(b) as part from r group by 1, 2),
g as (select image_id, part, min(a % 100) as x1, min(a // 100) as y1, max(a % 100) + 1 as x2, max(a // 100) + 1 as y2 from c group by 1, 2)
select image_id, cast(row_number() over (partition by image_id order by part) as int) as region, x1, y1, x2, y2 from g
"""

QUERIES = {
    "bytetrack": bytetrack, "sot_merge": sot_merge, "tracker_ticks": tracker_ticks, "pass_through": pass_through, "iou_matrix": iou_matrix, "session_gate": session_gate, "detect_replay": detect_replay,
    "frame_overlaps": frame_overlaps, "live_ticks": live_ticks, "live_stream": live_stream, "json_repair": json_repair, "frame_metrics": frame_metrics, "conditioned": conditioned, "region_proposals": region_proposals,
    "image_files": image_files, "denoised": denoised, "drawn_regions": drawn_regions,
}

ORACLES = {"pass_through": PASS_SQL, "iou_matrix": IOU_SQL, "frame_overlaps": OVERLAPS_SQL, "detect_replay": DETECT_SQL, "json_repair": REPAIR_SQL, "image_files": FILES_SQL, "drawn_regions": DRAWN_SQL}
