"""Queries on boxes, tiles and crops."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from boxloom.functions import geometry as g
from boxloom.operators import boxes as ops
from boxloom.plans import shapes
from boxloom.sources.tables import read_table

IOU_SQL = """(case when greatest(0, least({a}.x2, {b}.x2) - greatest({a}.x1, {b}.x1)) * greatest(0, least({a}.y2, {b}.y2) - greatest({a}.y1, {b}.y1)) = 0 then 0.0::double else
 greatest(0, least({a}.x2, {b}.x2) - greatest({a}.x1, {b}.x1)) * greatest(0, least({a}.y2, {b}.y2) - greatest({a}.y1, {b}.y1)) /
 (({a}.x2 - {a}.x1) * ({a}.y2 - {a}.y1) + ({b}.x2 - {b}.x1) * ({b}.y2 - {b}.y1) - greatest(0, least({a}.x2, {b}.x2) - greatest({a}.x1, {b}.x1)) * greatest(0, least({a}.y2, {b}.y2) - greatest({a}.y1, {b}.y1))) end)"""

FOLD_SQL = """
r as (select {keys}, 1 as pos, [{{'i': det_idx, 'x1': x1, 'y1': y1, 'x2': x2, 'y2': y2}}] as kept from ranked where pos = 1
  union all
  select {r_keys}, b.pos, case when len(list_filter(r.kept, lambda k: {iou} > {threshold})) > 0 then r.kept
     else list_append(r.kept, {{'i': b.det_idx, 'x1': b.x1, 'y1': b.y1, 'x2': b.x2, 'y2': b.y2}}) end
  from r join ranked b on {on} and b.pos = r.pos + 1),
fin as (select {keys}, arg_max(kept, pos) as kept from r group by {keys})
"""


def _fold(keys: list[str], threshold: float) -> str:
    return FOLD_SQL.format(
        keys=", ".join(keys), r_keys=", ".join(f"r.{k}" for k in keys), on=" and ".join(f"b.{k} = r.{k}" for k in keys),
        iou=IOU_SQL.format(a="k", b="b"), threshold=threshold,
    )


def nms_by_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = ops.suppress(shapes.boxes(spark, sf_dir), ["image_id", "label"], ["det_idx"], 0.5)
    return kept.select("image_id", "label", "det_idx", "x1", "y1", "x2", "y2")


NMS_SQL = f"""
with recursive {shapes.WITH},
ranked as (select *, row_number() over (partition by image_id, label order by (x2 - x1) * (y2 - y1), det_idx) as pos from boxes),
{_fold(["image_id", "label"], 0.5)}
select image_id, label, k.i as det_idx, k.x1 as x1, k.y1 as y1, k.x2 as x2, k.y2 as y2 from (select image_id, label, unnest(kept) as k from fin)
"""


def nms_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flagship flow: tile boxes to the image, suppress, count by image."""
    moved = _tile_boxes(spark, sf_dir).select("image_id", "label", "det_idx", *[F.col(f"{k}_o1000").alias(k) for k in ("x1", "y1", "x2", "y2")])
    kept = ops.suppress(moved, ["image_id", "label"], ["det_idx"], 0.5)
    return kept.groupBy("image_id").agg(F.count("*").alias("n_detections"))


def _tile_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boxes read as tile detections: tile at (l_partkey % 5, l_suppkey % 5) hundreds, image of the part."""
    b = shapes.boxes(spark, sf_dir).join(shapes.images(spark, sf_dir).withColumnRenamed("image_id", "part_id"), F.col("l_partkey") == F.col("part_id"))
    tx, ty = (F.col("l_partkey") % 5 * 40).cast("int"), (F.col("l_suppkey") % 5 * 30).cast("int")
    tw, th = F.least(F.lit(512), F.col("w") - tx), F.least(F.lit(512), F.col("h") - ty)
    x1, x2 = g.ordered(*[g.tile_to_original(F.col(c), tx, tw, F.col("w")) for c in ("x1", "x2")])
    y1, y2 = g.ordered(*[g.tile_to_original(F.col(c), ty, th, F.col("h")) for c in ("y1", "y2")])
    return b.select("image_id", "label", "det_idx", x1.alias("x1_o1000"), y1.alias("y1_o1000"), x2.alias("x2_o1000"), y2.alias("y2_o1000"))


def tile_to_image(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _tile_boxes(spark, sf_dir)


def _tile_sql(axis: str) -> str:
    key, step, whole = ("l_partkey", 40, "w") if axis == "x" else ("l_suppkey", 30, "h")
    start = f"cast({key} % 5 * {step} as int)"
    length = f"least(512, i.{whole} - {start})"
    part = lambda c: f"({start} + {c} * {length} / 1000) * 1000 / i.{whole}"
    return f"{part(axis + '1')} as a{axis}, {part(axis + '2')} as b{axis}"


TILE_SQL = f"""
t as (select b.image_id, label, det_idx, {_tile_sql("x")}, {_tile_sql("y")} from boxes b join images i on b.l_partkey = i.image_id),
moved as (select image_id, label, det_idx, cast(greatest(0, least(1000, round_even(least(ax, bx), 0))) as int) as x1_o1000, cast(greatest(0, least(1000, round_even(least(ay, by_), 0))) as int) as y1_o1000,
  cast(greatest(0, least(1000, round_even(greatest(ax, bx), 0))) as int) as x2_o1000, cast(greatest(0, least(1000, round_even(greatest(ay, by_), 0))) as int) as y2_o1000 from t)
""".replace("as by,", "as by_,").replace("as by ", "as by_ ")


def map_to_original(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boxes on squares padded around the part's image, back to the image."""
    b = shapes.boxes(spark, sf_dir).join(shapes.images(spark, sf_dir).withColumnRenamed("image_id", "part_id"), F.col("l_partkey") == F.col("part_id"))
    side = F.greatest("w", "h")
    pad_x, pad_y = (F.floor((side - F.col(c)) / 2) for c in ("w", "h"))
    x1, x2 = g.outward(*[g.prep_to_original(F.col(c), side, F.col("w"), pad_x) for c in ("x1", "x2")])
    y1, y2 = g.outward(*[g.prep_to_original(F.col(c), side, F.col("h"), pad_y) for c in ("y1", "y2")])
    out = b.select("image_id", "det_idx", x1.alias("x1_o1000"), y1.alias("y1_o1000"), x2.alias("x2_o1000"), y2.alias("y2_o1000"))
    return out.withColumn("is_degenerate", F.expr("x2_o1000 <= x1_o1000 or y2_o1000 <= y1_o1000"))


MAP_SQL = f"""
with {shapes.WITH},
j as (select b.image_id, det_idx, x1, y1, x2, y2, w, h, greatest(w, h) as s, floor((greatest(w, h) - w) / 2) as px, floor((greatest(w, h) - h) / 2) as py from boxes b join images i on b.l_partkey = i.image_id),
m as (select image_id, det_idx,
  cast(greatest(0, least(1000, floor((x1 * s / 1000 - px) * 1000 / w))) as int) as x1_o1000, cast(greatest(0, least(1000, floor((y1 * s / 1000 - py) * 1000 / h))) as int) as y1_o1000,
  cast(greatest(0, least(1000, ceil((x2 * s / 1000 - px) * 1000 / w))) as int) as x2_o1000, cast(greatest(0, least(1000, ceil((y2 * s / 1000 - py) * 1000 / h))) as int) as y2_o1000 from j)
select *, x2_o1000 <= x1_o1000 or y2_o1000 <= y1_o1000 as is_degenerate from m
"""


def map_to_preprocessed(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = shapes.boxes(spark, sf_dir).join(shapes.images(spark, sf_dir).withColumnRenamed("image_id", "part_id"), F.col("l_partkey") == F.col("part_id"))
    side = F.greatest("w", "h")
    pad_x, pad_y = (F.floor((side - F.col(c)) / 2) for c in ("w", "h"))
    x1, x2 = g.ordered(*[g.original_to_prep(F.col(c), side, F.col("w"), pad_x) for c in ("x1", "x2")])
    y1, y2 = g.ordered(*[g.original_to_prep(F.col(c), side, F.col("h"), pad_y) for c in ("y1", "y2")])
    return b.select("image_id", "det_idx", x1.alias("x1_p1000"), y1.alias("y1_p1000"), x2.alias("x2_p1000"), y2.alias("y2_p1000"))


PREP_SQL = f"""
with {shapes.WITH},
j as (select b.image_id, det_idx, x1, y1, x2, y2, w, h, greatest(w, h) as s, floor((greatest(w, h) - w) / 2) as px, floor((greatest(w, h) - h) / 2) as py from boxes b join images i on b.l_partkey = i.image_id)
select image_id, det_idx,
  cast(greatest(0, least(1000, round_even((x1 * w / 1000 + px) * 1000 / s, 0))) as int) as x1_p1000, cast(greatest(0, least(1000, round_even((y1 * h / 1000 + py) * 1000 / s, 0))) as int) as y1_p1000,
  cast(greatest(0, least(1000, round_even((x2 * w / 1000 + px) * 1000 / s, 0))) as int) as x2_p1000, cast(greatest(0, least(1000, round_even((y2 * h / 1000 + py) * 1000 / s, 0))) as int) as y2_p1000 from j
"""


def tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.tiles(shapes.images(spark, sf_dir))


TILES_SQL = f"""
with {shapes.WITH},
a as (select image_id, w, h,
  list_sort(list_distinct(list_concat(case when w < 512 then [] else range(0, w - 512 + 1, 410) end, [greatest(0, w - 512)]))) as xs,
  list_sort(list_distinct(list_concat(case when h < 512 then [] else range(0, h - 512 + 1, 410) end, [greatest(0, h - 512)]))) as ys from images),
b as (select image_id, w, h, xs, unnest(ys) as y, generate_subscripts(ys, 1) as r from a),
c as (select image_id, w, h, y, r, len(xs) as n, unnest(xs) as x, generate_subscripts(xs, 1) as k from b)
select image_id, cast((r - 1) * n + k - 1 as int) as tile_idx, cast(x as int) as tile_x, cast(y as int) as tile_y, cast(least(512, w - x) as int) as tile_w, cast(least(512, h - y) as int) as tile_h from c
"""


def iou_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.overlapping_pairs(shapes.boxes(spark, sf_dir), ["image_id", "label"], "det_idx", 0.5)


PAIRS_SQL = f"""
with {shapes.WITH},
q as materialized (select image_id, label, det_idx, x1, y1, x2, y2 from boxes),
t as materialized (select a.image_id, a.label, a.det_idx as a, b.det_idx as b, least(a.x2, b.x2) - greatest(a.x1, b.x1) as sx, least(a.y2, b.y2) - greatest(a.y1, b.y1) as sy,
  (a.x2 - a.x1) * (a.y2 - a.y1) + (b.x2 - b.x1) * (b.y2 - b.y1) as sides
  from q a join q b on a.image_id = b.image_id and a.label = b.label),
s as (select image_id, label, a, b, sx * sy as shared, sides from t where a < b and sx > 0 and sy > 0)
select image_id, label, a, b, shared / (sides - shared) as iou from s where shared / (sides - shared) > 0.5
"""


def som_nms_top30(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidate regions of an image, whatever their label: size filter, suppression at 0.4, the first 30."""
    b = shapes.boxes(spark, sf_dir).withColumn("area", F.expr("(x2 - x1) * (y2 - y1)")).where("area > 0.0005 * 1000000 and area < 0.3 * 1000000")
    return ops.suppress(b, ["image_id"], ["det_idx"], 0.4, most=30).select("image_id", F.col("rank").alias("proposal_id"), "x1", "y1", "x2", "y2")


SOM_SQL = f"""
with recursive {shapes.WITH},
ranked as (select *, row_number() over (partition by image_id order by (x2 - x1) * (y2 - y1), det_idx) as pos from boxes
  where (x2 - x1) * (y2 - y1) > 0.0005 * 1000000 and (x2 - x1) * (y2 - y1) < 0.3 * 1000000),
{_fold(["image_id"], 0.4)}
select image_id, cast(p as int) as proposal_id, k.x1 as x1, k.y1 as y1, k.x2 as x2, k.y2 as y2
from (select image_id, unnest(kept) as k, generate_subscripts(kept, 1) as p from fin) where p <= 30
"""


def det_to_yolo(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Detections with the id of their category; others are unmapped and have no line."""
    cats = spark.createDataFrame([(0, " a "), (1, "R"), (2, "A"), (3, "")], "pos int, name string")
    ids = F.broadcast(ops.category_ids(cats).withColumnRenamed("name", "cat"))
    b = shapes.plain_boxes(spark, sf_dir).join(ids, F.lower(F.trim("label")) == F.col("cat"), "left")
    xc, w = g.to_yolo(F.col("x1"), F.col("x2"), 1000.0)
    yc, h = g.to_yolo(F.col("y1"), F.col("y2"), 1000.0)
    known = F.col("id").isNotNull()
    return b.select("image_id", "label", F.col("id").alias("class_id"), *[F.when(known, v).alias(n) for n, v in (("xc", xc), ("yc", yc), ("w", w), ("h", h))])


YOLO_OUT_SQL = f"""
with {shapes.WITH},
b as (select *, case lower(label) when 'a' then 0 when 'r' then 1 end as id from boxes)
select image_id, label, cast(id as int) as class_id, case when id is not null then greatest(0.0::double, least(1.0::double, (x1 + x2) / 2.0::double / 1000.0::double)) end as xc, case when id is not null then greatest(0.0::double, least(1.0::double, (y1 + y2) / 2.0::double / 1000.0::double)) end as yc,
  case when id is not null then greatest(0.0::double, least(1.0::double, (x2 - x1) / 1000.0::double)) end as w, case when id is not null then greatest(0.0::double, least(1.0::double, (y2 - y1) / 1000.0::double)) end as h from b
"""


def det_to_pixel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Detections in pixels, y first, for the tracker; with the place of their label when drawn."""
    b = shapes.plain_boxes(spark, sf_dir).join(shapes.images(spark, sf_dir).withColumnRenamed("image_id", "part_id"), F.col("l_partkey") == F.col("part_id"))
    px = {k: (F.col(k) * F.col("w" if k[0] == "x" else "h") / 1000) for k in ("x1", "y1", "x2", "y2")}
    return b.select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", px["y1"].alias("ymin_px"), px["x1"].alias("xmin_px"), px["y2"].alias("ymax_px"), px["x2"].alias("xmax_px"),
        F.greatest(F.lit(0.0), F.least(px["y1"], px["y2"]) - 18).alias("label_y_px"),
        (F.expr("(x2 - x1) * (y2 - y1)") * F.col("w") * F.col("h") / 1000000 < 16).alias("is_tiny"),
    )


PIXEL_SQL = f"""
with {shapes.WITH}
select l_orderkey, l_linenumber, l_partkey, l_suppkey, y1 * h / 1000 as ymin_px, x1 * w / 1000 as xmin_px, y2 * h / 1000 as ymax_px, x2 * w / 1000 as xmax_px,
  greatest(0.0::double, least(y1 * h / 1000, y2 * h / 1000) - 18) as label_y_px, (x2 - x1) * (y2 - y1) * w * h / 1000000 < 16 as is_tiny
from boxes b join images i on b.l_partkey = i.image_id
"""


def crop_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Crops to verify boxes: padded by a fifth of their size; those under ten pixels are not asked about."""
    b = shapes.plain_boxes(spark, sf_dir).join(shapes.images(spark, sf_dir).withColumnRenamed("image_id", "part_id"), F.col("l_partkey") == F.col("part_id"))
    x1, x2 = g.crop_by_box(F.col("x1"), F.col("x2"), F.col("w"), 0.2)
    y1, y2 = g.crop_by_box(F.col("y1"), F.col("y2"), F.col("h"), 0.2)
    out = b.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", x1.alias("cx1"), y1.alias("cy1"), x2.alias("cx2"), y2.alias("cy2"))
    return out.withColumn("ask", F.expr("cx2 - cx1 >= 10 and cy2 - cy1 >= 10"))


CROP_SQL = f"""
with {shapes.WITH},
c as (select l_orderkey, l_linenumber, l_partkey, l_suppkey,
  greatest(0, cast(trunc(x1 * w / 1000 - (x2 * w / 1000 - x1 * w / 1000) * 0.2::double) as int)) as cx1, greatest(0, cast(trunc(y1 * h / 1000 - (y2 * h / 1000 - y1 * h / 1000) * 0.2::double) as int)) as cy1,
  least(w, cast(trunc(x2 * w / 1000 + (x2 * w / 1000 - x1 * w / 1000) * 0.2::double) as int)) as cx2, least(h, cast(trunc(y2 * h / 1000 + (y2 * h / 1000 - y1 * h / 1000) * 0.2::double) as int)) as cy2
  from boxes b join images i on b.l_partkey = i.image_id)
select *, cx2 - cx1 >= 10 and cy2 - cy1 >= 10 as ask from c
"""


def _regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Drawn regions in pixels of the part's image."""
    b = shapes.boxes(spark, sf_dir).join(shapes.images(spark, sf_dir).withColumnRenamed("image_id", "part_id"), F.col("l_partkey") == F.col("part_id"))
    px = {k: F.expr(f"cast({k} * {'w' if k[0] == 'x' else 'h'} div 1000 as int)") for k in ("x1", "y1")}
    ends = {"x2": F.expr("cast(x1 * w div 1000 + l_suppkey % 40 as int)"), "y2": F.expr("cast(y1 * h div 1000 + l_partkey % 40 as int)")}
    return b.select("image_id", "det_idx", "label", "w", "h", *[v.alias(f"r{k}") for k, v in (px | ends).items()])


REGIONS_SQL = """
regions as (select b.image_id, det_idx, label, w, h, cast(x1 * w // 1000 as int) as rx1, cast(y1 * h // 1000 as int) as ry1,
  cast(x1 * w // 1000 + l_suppkey % 40 as int) as rx2, cast(y1 * h // 1000 + l_partkey % 40 as int) as ry2 from boxes b join images i on b.l_partkey = i.image_id)
"""


def reading_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Regions large enough, the first 50 of an image from top to bottom, left to right, with a colour."""
    from pyspark.sql import Window

    r = _regions(spark, sf_dir).where(
        ((F.col("rx2") - F.col("rx1")) * (F.col("ry2") - F.col("ry1")) >= F.greatest(F.lit(16), (F.col("w") * F.col("h") * 0.0005).cast("int")))
        & (F.col("rx2") - F.col("rx1") >= 4) & (F.col("ry2") - F.col("ry1") >= 4)
    )
    no = F.row_number().over(Window.partitionBy("image_id").orderBy("ry1", "rx1", "det_idx"))
    return r.withColumn("region_no", no).where("region_no <= 50").select("image_id", "region_no", "rx1", "ry1", "rx2", "ry2", F.pmod(F.col("region_no") - 1, F.lit(10)).alias("colour"))


READING_SQL = f"""
with {shapes.WITH}, {REGIONS_SQL},
n as (select *, cast(row_number() over (partition by image_id order by ry1, rx1, det_idx) as int) as region_no from regions
  where (rx2 - rx1) * (ry2 - ry1) >= greatest(16, cast(trunc(w * h * 0.0005::double) as int)) and rx2 - rx1 >= 4 and ry2 - ry1 >= 4)
select image_id, region_no, rx1, ry1, rx2, ry2, (region_no - 1) % 10 as colour from n where region_no <= 50
"""


def region_crop(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = _regions(spark, sf_dir)
    c = g.crop_by_edge(g.corners("r"), F.col("w"), F.col("h"), 10)
    return r.select("image_id", "det_idx", *[v.alias(f"c{k}") for k, v in c.items()])


REGION_CROP_SQL = f"""
with {shapes.WITH}, {REGIONS_SQL},
p as (select *, cast(trunc(greatest(w, h) * 0.1::double) as int) as pad from regions),
c as (select *, greatest(0, rx1 - pad) as ax, greatest(0, ry1 - pad) as ay, least(w, rx2 + pad) as bx, least(h, ry2 + pad) as b_y from p)
select image_id, det_idx, case when bx <= ax or b_y <= ay then rx1 else ax end as cx1, case when bx <= ax or b_y <= ay then ry1 else ay end as cy1,
  case when bx <= ax or b_y <= ay then rx2 else bx end as cx2, case when bx <= ax or b_y <= ay then ry2 else b_y end as cy2 from c
"""


def region_to_yolo(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recognised regions as YOLO boxes; unknown and 'none' classes and empty boxes are left out."""
    ids = F.broadcast(spark.createDataFrame([("a", 0), ("r", 1)], "cat string, class_id int"))
    r = _regions(spark, sf_dir).where("rx2 > rx1 and ry2 > ry1").join(ids, F.lower("label") == F.col("cat"))
    xc, bw = g.to_yolo(F.col("rx1"), F.col("rx2"), F.col("w"))
    yc, bh = g.to_yolo(F.col("ry1"), F.col("ry2"), F.col("h"))
    return r.select("image_id", "det_idx", "class_id", xc.alias("xc"), yc.alias("yc"), bw.alias("bw"), bh.alias("bh"))


REGION_YOLO_SQL = f"""
with {shapes.WITH}, {REGIONS_SQL}
select image_id, det_idx, cast(case label when 'A' then 0 else 1 end as int) as class_id, greatest(0.0::double, least(1.0::double, (rx1 + rx2) / 2.0::double / w)) as xc, greatest(0.0::double, least(1.0::double, (ry1 + ry2) / 2.0::double / h)) as yc,
  greatest(0.0::double, least(1.0::double, (rx2 - rx1) / w)) as bw, greatest(0.0::double, least(1.0::double, (ry2 - ry1) / h)) as bh
from regions where rx2 > rx1 and ry2 > ry1 and label in ('A', 'R')
"""


def upscale_dims(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sizes after the shorter edge is brought to 1024, padded to a square."""
    w, h = g.upscaled(F.col("w"), F.col("h"), 1024)
    out = shapes.images(spark, sf_dir).select("image_id", w.alias("content_w"), h.alias("content_h"))
    side = F.greatest("content_w", "content_h")
    return out.select("*", side.alias("side"), F.expr("(greatest(content_w, content_h) - content_w) div 2").alias("pad_left"), F.expr("(greatest(content_w, content_h) - content_h) div 2").alias("pad_top"))


UPSCALE_SQL = f"""
with {shapes.WITH},
u as (select image_id, cast(case when least(w, h) < 1024 then round_even(w * (1024 / least(w, h)), 0) else w end as int) as content_w, cast(case when least(w, h) < 1024 then round_even(h * (1024 / least(w, h)), 0) else h end as int) as content_h from images)
select *, greatest(content_w, content_h) as side, cast((greatest(content_w, content_h) - content_w) // 2 as bigint) as pad_left, cast((greatest(content_w, content_h) - content_h) // 2 as bigint) as pad_top from u
"""


def letterbox_dims(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shapes.images(spark, sf_dir).select("image_id", *[v.alias(k) for k, v in g.letterbox(F.col("w"), F.col("h"), 1024, 1024).items()])


LETTERBOX_SQL = f"""
with {shapes.WITH},
s as (select image_id, w, h, least(1024 / w, 1024 / h) as scale from images),
c as (select image_id, scale, cast(greatest(1, round_even(w * scale, 0)) as int) as content_w, cast(greatest(1, round_even(h * scale, 0)) as int) as content_h from s)
select *, cast(floor((1024 - content_w) / 2) as int) as pad_left, cast(floor((1024 - content_h) / 2) as int) as pad_top from c
"""


def grid_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pixel places of the coordinate grid's lines, every 100 of the 0-1000 scale."""
    return shapes.images(spark, sf_dir).select("image_id", F.explode(F.sequence(F.lit(0), F.lit(1000), F.lit(100))).alias("at"), "w", "h").select(
        "image_id", "at", (F.col("at") * F.col("w") / 1000).cast("int").alias("x_px"), (F.col("at") * F.col("h") / 1000).cast("int").alias("y_px")
    )


GRID_SQL = f"""
with {shapes.WITH}
select image_id, cast(k as int) as "at", cast(trunc(k * w / 1000) as int) as x_px, cast(trunc(k * h / 1000) as int) as y_px from images, range(0, 1001, 100) t(k)
"""


def gamma_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Grey levels after gamma correction, with the pixels (here, lines of orders) that have them."""
    level = (F.col("l_partkey") % 256).cast("int")
    pix = read_table(spark, sf_dir, "lineitem").groupBy(level.alias("level")).agg(F.count("*").alias("n_pixels"))
    return pix.select("level", "n_pixels", g.gamma(F.col("level"), 2.2).alias("corrected"))


GAMMA_SQL = """
select cast(l_partkey % 256 as int) as level, count(*) as n_pixels, cast(trunc(pow(cast(l_partkey % 256 as int) / 255.0::double, 1.0::double / 2.2::double) * 255) as int) as corrected from lineitem group by 1, 3
"""

QUERIES = {
    "nms_counts": nms_counts,
    "nms_by_label": nms_by_label,
    "tile_to_image": tile_to_image,
    "map_to_original": map_to_original,
    "map_to_preprocessed": map_to_preprocessed,
    "tiles": tiles,
    "iou_pairs": iou_pairs,
    "som_nms_top30": som_nms_top30,
    "det_to_yolo": det_to_yolo,
    "det_to_pixel": det_to_pixel,
    "crop_window": crop_window,
    "reading_order": reading_order,
    "region_crop": region_crop,
    "region_to_yolo": region_to_yolo,
    "upscale_dims": upscale_dims,
    "letterbox_dims": letterbox_dims,
    "grid_lines": grid_lines,
    "gamma_levels": gamma_levels,
}

ORACLES = {
    "nms_counts": f"""
with recursive {shapes.WITH}, {TILE_SQL},
m as (select image_id, label, det_idx, x1_o1000 as x1, y1_o1000 as y1, x2_o1000 as x2, y2_o1000 as y2 from moved),
ranked as (select *, row_number() over (partition by image_id, label order by (x2 - x1) * (y2 - y1), det_idx) as pos from m),
{_fold(["image_id", "label"], 0.5)}
select image_id, cast(sum(len(kept)) as bigint) as n_detections from fin group by image_id
""",
    "nms_by_label": NMS_SQL,
    "tile_to_image": f"with {shapes.WITH}, {TILE_SQL} select * from moved",
    "map_to_original": MAP_SQL,
    "map_to_preprocessed": PREP_SQL,
    "tiles": TILES_SQL,
    "iou_pairs": PAIRS_SQL,
    "som_nms_top30": SOM_SQL,
    "det_to_yolo": YOLO_OUT_SQL,
    "det_to_pixel": PIXEL_SQL,
    "crop_window": CROP_SQL,
    "reading_order": READING_SQL,
    "region_crop": REGION_CROP_SQL,
    "region_to_yolo": REGION_YOLO_SQL,
    "upscale_dims": UPSCALE_SQL,
    "letterbox_dims": LETTERBOX_SQL,
    "grid_lines": GRID_SQL,
    "gamma_levels": GAMMA_SQL,
}
