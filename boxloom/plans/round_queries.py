"""Queries on rounds of detection, their results and logs of image states."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from boxloom.operators import ordering, rounds as ops
from boxloom.plans import progress, shapes
from boxloom.sources.tables import read_table

GOOD = 8


def best_round(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.best_rounds(shapes.rounds(spark, sf_dir)).select("image_id", "round", "score")


BEST_SQL = f"""
with {shapes.WITH}
select image_id, round, score from (select *, row_number() over (partition by image_id order by score desc, round) as k from rounds) where k = 1
"""


def early_stop(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.until_good(shapes.rounds(spark, sf_dir), GOOD).select("image_id", "round", "score")


STOP_SQL = f"""
with {shapes.WITH},
d as (select *, max(case when score >= {GOOD} then 1 else 0 end) over (partition by image_id order by round rows between unbounded preceding and 1 preceding) as done from rounds)
select image_id, round, score from d where coalesce(done, 0) = 0
"""


def carry_forward(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.carried(shapes.rounds(spark, sf_dir), ["feedback", "score"]).select("image_id", "round", "prev_feedback", "prev_score")


CARRY_SQL = f"""
with {shapes.WITH}
select image_id, round, lag(feedback) over w as prev_feedback, lag(score) over w as prev_score from rounds window w as (partition by image_id order by round)
"""


def round_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.history(ops.until_good(shapes.rounds(spark, sf_dir), GOOD), ["round", "score", "feedback"])


HISTORY_SQL = f"""
with s as ({STOP_SQL}), r as (with {shapes.WITH} select * from rounds)
select image_id, count(*) as n_rounds, '[' || string_agg('{{"round":' || round || ',"score":' || score || ',"feedback":"' || feedback || '"}}', ',' order by round) || ']' as history
from s join r using (image_id, round, score) group by image_id
"""


def run_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By image: its best round, that round's detections and whether it reached the threshold."""
    best = ops.best_rounds(ops.until_good(shapes.rounds(spark, sf_dir), GOOD)).select("image_id", F.col("round").alias("best_round"), F.col("score").alias("best_score"), "o_orderkey")
    n = read_table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.count("*").alias("n"))
    return best.join(n, F.col("o_orderkey") == F.col("l_orderkey"), "left").select(
        "image_id", "best_round", "best_score", F.coalesce("n", F.lit(0)).alias("n_detections"), F.when(F.col("best_score") >= GOOD, "success").otherwise("incomplete").alias("status")
    )


SUMMARY_SQL = f"""
with s as ({STOP_SQL}), r as (with {shapes.WITH} select * from rounds),
b as (select s.*, o_orderkey, row_number() over (partition by image_id order by score desc, round) as k from s join r using (image_id, round, score)),
n as (select l_orderkey, count(*) as n from lineitem group by 1)
select image_id, round as best_round, score as best_score, coalesce(n, 0) as n_detections, case when score >= {GOOD} then 'success' else 'incomplete' end as status from b left join n on o_orderkey = l_orderkey where k = 1
"""


def explorer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the explorer shows for round 2 of an image, else its best round."""
    r = shapes.rounds(spark, sf_dir)
    best = ops.best_rounds(r).select("image_id", F.col("round").alias("best"), F.col("score").alias("best_score"))
    second = r.where("round = 2").select("image_id", F.col("round").alias("asked"), F.col("score").alias("asked_score"))
    return best.join(second, "image_id", "left").select("image_id", F.coalesce("asked", "best").alias("round"), F.coalesce("asked_score", "best_score").alias("score"))


EXPLORER_SQL = f"""
with {shapes.WITH}
select image_id, round, score from (select *, row_number() over (partition by image_id order by (round = 2) desc, score desc, round) as k from rounds) where k = 1
"""


def box_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boxes numbered for the judge, with the colour each is drawn in."""
    b = shapes.boxes(spark, sf_dir)
    n = F.row_number().over(Window.partitionBy("image_id").orderBy("det_idx"))
    return b.select("image_id", "det_idx", F.concat(F.lit("#"), n.cast("string")).alias("name"), F.pmod(n - 1, F.lit(10)).alias("colour"))


INDEX_SQL = f"with {shapes.WITH} select image_id, det_idx, '#' || det_idx as name, cast((det_idx - 1) % 10 as int) as colour from boxes"


def image_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shapes.plain_boxes(spark, sf_dir).groupBy("image_id").agg(F.count("*").alias("n_detections"), F.count_distinct("label").alias("n_labels"))


COUNTS_SQL = f"with {shapes.WITH} select image_id, count(*) as n_detections, count(distinct label) as n_labels from boxes group by 1"


def tile_concat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw outputs of an order's lines, as tiles, joined in tile order; with the errors of failed ones."""
    li = read_table(spark, sf_dir, "lineitem").withColumn("out", F.concat(F.lit("tile "), F.col("l_linenumber").cast("string"), F.lit(":"), F.col("l_partkey").cast("string")))
    rows = F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_suppkey", "out")))
    errors = F.array_sort(F.collect_list(F.when(F.col("l_suppkey") % 4 == 0, F.struct("l_linenumber", "l_partkey", "l_suppkey", "out"))))
    agg = li.groupBy("l_orderkey").agg(rows.alias("rows"), errors.alias("errors"))
    return agg.select("l_orderkey", F.array_join(F.transform("rows", lambda r: r.out), "\n").alias("raw_output"), F.array_join(F.transform("errors", lambda r: r.out), "; ").alias("parse_error"))


CONCAT_SQL = """
select l_orderkey, string_agg('tile ' || l_linenumber || ':' || l_partkey, chr(10) order by l_linenumber, l_partkey, l_suppkey) as raw_output,
  coalesce(string_agg('tile ' || l_linenumber || ':' || l_partkey, '; ' order by l_linenumber, l_partkey, l_suppkey) filter (l_suppkey % 4 = 0), '') as parse_error from lineitem group by 1
"""


def status_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.last_states(read_table(spark, sf_dir, "events"), "user_id", "event_id", "event_type")


FOLD_SQL = "select user_id, arg_max(event_type, event_id) as state, count(*) as n_events from events group by 1"


def batch_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Images done and failed, and the percent reached, by day of the log."""
    e = read_table(spark, sf_dir, "events").groupBy(F.to_date("ts").cast("string").alias("day")).agg(
        F.count("*").alias("total"), F.count_if(F.col("event_id") % 3 > 0).alias("done"), F.count_if(F.col("event_id") % 3 == 1).alias("failed")
    )
    return e.select("day", (F.col("done") - F.col("failed")).alias("succeeded"), "failed", ops.progress(F.col("done"), F.col("total")).alias("percent"),
                    F.try_divide(F.col("total") - F.col("done"), F.try_divide(F.col("done"), F.lit(86400.0))).alias("eta_s"))


BATCH_SQL = """
with e as (select cast(cast(ts as date) as varchar) as day, count(*) as total, count(*) filter (event_id % 3 > 0) as done, count(*) filter (event_id % 3 = 1) as failed from events group by 1)
select day, done - failed as succeeded, failed, cast(trunc(done / total * 90) as int) as percent, case when done > 0 then (total - done) / (done / 86400.0::double) end as eta_s from e
"""


def late_drop(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Detection results, in a permuted order of arrival, that are newer than all applied before."""
    e = read_table(spark, sf_dir, "events").selectExpr("user_id", "event_id as frame_id", "event_id * 7919 % 10007 as arrival")
    w = e.withColumn("order", F.struct("arrival", "frame_id"))
    return ops.late_dropped(w, "user_id", "order", "frame_id").select("user_id", "frame_id", "arrival")


LATE_SQL = """
with e as (select user_id, event_id as frame_id, event_id * 7919 % 10007 as arrival from events),
w as (select *, coalesce(max(frame_id) over (partition by user_id order by arrival, frame_id rows between unbounded preceding and 1 preceding), -1) as last from e)
select user_id, frame_id, arrival from w where frame_id > last
"""


def frame_sampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every int(max(1, fps * interval))-th frame of a video; fps falls back to 30."""
    e = read_table(spark, sf_dir, "events").selectExpr("user_id as video", "event_id", "case when user_id % 3 > 0 then user_id % 3 * 12.5D end as fps")
    no = F.row_number().over(Window.partitionBy("video").orderBy("event_id")) - 1
    every = F.greatest(F.lit(1.0), F.coalesce("fps", F.lit(30.0)) * 0.2).cast("int")
    return e.withColumn("frame_no", no).where(F.col("frame_no") % every == 0).select("video", "event_id", "frame_no")


SAMPLING_SQL = """
with e as (select user_id as video, event_id, coalesce(case when user_id % 3 > 0 then user_id % 3 * 12.5::double end, 30.0::double) as fps, cast(row_number() over (partition by user_id order by event_id) - 1 as int) as frame_no from events)
select video, event_id, frame_no from e where frame_no % cast(trunc(greatest(1.0::double, fps * 0.2::double)) as int) = 0
"""


def progress_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as images that users' runs have finished: how many, at what rate, and how long the rest takes."""
    e = read_table(spark, sf_dir, "events").select("user_id", "event_id", "ts")
    out = progress.progress_log(e, "user_id", "ts", ["event_id"])
    return out.select("user_id", "event_id", "done", "total", F.round("rate", 9).alias("rate"), F.round("eta", 3).alias("eta"))


PROGRESS_SQL = """
with p as (select user_id, event_id, count(*) over (partition by user_id order by ts, event_id rows unbounded preceding) as done, count(*) over (partition by user_id) as total,
  (epoch_us(ts) - min(epoch_us(ts)) over (partition by user_id)) / 1e6 as t from events),
r as (select *, case when t > 0 then done / t else 0.0::double end as rate from p)
select user_id, event_id, done, total, round(rate, 9) as rate, case when rate > 0 then round((total - done) / rate, 3) end as eta from r
"""


def score_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tracker detections by score: high, low or dropped."""
    score = F.expr("event_id % 100 / 100.0D")
    kind = F.when(score >= 0.4, "high").when(score >= 0.1, "low").otherwise("drop")
    return read_table(spark, sf_dir, "events").groupBy("user_id", kind.alias("kind")).agg(F.count("*").alias("n"))


SPLIT_SQL = "select user_id, case when event_id % 100 / 100.0::double >= 0.4 then 'high' when event_id % 100 / 100.0::double >= 0.1 then 'low' else 'drop' end as kind, count(*) as n from events group by 1, 2"


def triage_decision(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frames passed on by their metrics: blurred ones never, else any trigger."""
    m = read_table(spark, sf_dir, "events").selectExpr("event_id", "event_id % 97 as lap", "event_id % 13 / 400.0D as edge", "user_id % 5 / 2.0D as texture", "event_id % 7 / 300.0D as ref")
    reasons = F.array_compact(F.array(F.when(F.expr("edge >= 0.02"), "edge"), F.when(F.expr("texture >= 2.0"), "texture"), F.when(F.expr("ref >= 0.015"), "reference")))
    out = m.select("event_id", (F.col("lap") < 30).alias("blurred"), F.array_join(reasons, ",").alias("reasons"))
    return out.select("event_id", (~F.col("blurred") & (F.col("reasons") != "")).alias("process"), F.when(F.col("blurred"), "blurred").when(F.col("reasons") == "", "none").otherwise(F.col("reasons")).alias("reason"))


TRIAGE_SQL = """
with m as (select event_id, event_id % 97 < 30 as b, concat_ws(',', case when event_id % 13 / 400.0::double >= 0.02::double then 'edge' end, case when user_id % 5 / 2.0::double >= 2 then 'texture' end, case when event_id % 7 / 300.0::double >= 0.015::double then 'reference' end) as r from events)
select event_id, not b and r <> '' as process, case when b then 'blurred' when r = '' then 'none' else r end as reason from m
"""


def image_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as images, in batches of 64 by id, each with its folder."""
    d = ordering.numbered(read_table(spark, sf_dir, "documents").select("doc_id"), "doc_id", [])
    b = ordering.batch_of(F.col("row_no"), 64)
    return d.select("doc_id", b.alias("batch"), ordering.batch_folder(b).alias("folder"))


BATCHES_SQL = "select doc_id, cast((row_number() over (order by doc_id) - 1) // 64 as int) as batch, 'batch_' || lpad(cast((row_number() over (order by doc_id) - 1) // 64 as varchar), 4, '0') as folder from documents"


def slice_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Images [100, 400) by id, of these the first 50: limits are what this operator is for."""
    return ordering.sliced(read_table(spark, sf_dir, "documents").select("doc_id", "lang"), "doc_id", [], 100, 400, 50)


SLICE_SQL = "select doc_id, lang from documents order by doc_id limit 50 offset 100"


def seeded_shuffle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Images in a reproducible random order."""
    d = read_table(spark, sf_dir, "documents").select("doc_id", ordering.shuffled_key(F.col("doc_id"), 7).alias("shuffle_key"))
    return ordering.numbered(d, "shuffle_key", ["doc_id"], "place").select("doc_id", "place")


def unique_stems(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stems of four documents each; of every second four one has the name that another would get."""
    taken = F.expr("case when doc_id % 8 = 7 or doc_id % 16 = 1 then '_1' else '' end")
    d = read_table(spark, sf_dir, "documents").select("doc_id", F.concat(F.lit("img"), F.expr("doc_id div 4").cast("string"), taken).alias("stem"))
    return ordering.unique_stems(d, "stem", ["doc_id"]).select("doc_id", "uniq_stem")


STEMS_SQL = """
with recursive s as (select doc_id, doc_id // 4 as f, 'img' || doc_id // 4 || case when doc_id % 8 = 7 or doc_id % 16 = 1 then '_1' else '' end as stem from documents),
o as (select *, row_number() over (partition by f order by doc_id) as k from s),
r as (select f, k, doc_id, stem as name, [stem] as taken from o where k = 1
  union all select f, k, doc_id, name, list_append(taken, name) from (select o.f, o.k, o.doc_id, r.taken,
    case when list_contains(r.taken, o.stem) then o.stem || '_' || list_filter(range(1, len(r.taken) + 2), lambda i: not list_contains(r.taken, o.stem || '_' || i))[1] else o.stem end as name
    from r join o on o.f = r.f and o.k = r.k + 1))
select doc_id, name as uniq_stem from r
"""

QUERIES = {
    "best_round": best_round, "early_stop": early_stop, "carry_forward": carry_forward, "round_history": round_history, "run_summary": run_summary,
    "explorer": explorer, "box_index": box_index, "image_counts": image_counts, "tile_concat": tile_concat, "status_fold": status_fold,
    "batch_summary": batch_summary, "late_drop": late_drop, "frame_sampling": frame_sampling, "score_split": score_split, "triage_decision": triage_decision,
    "image_batches": image_batches, "slice_sample": slice_sample, "seeded_shuffle": seeded_shuffle, "unique_stems": unique_stems,
    "progress_log": progress_log,
}

ORACLES = {
    "best_round": BEST_SQL, "early_stop": STOP_SQL, "carry_forward": CARRY_SQL, "round_history": HISTORY_SQL, "run_summary": SUMMARY_SQL,
    "explorer": EXPLORER_SQL, "box_index": INDEX_SQL, "image_counts": COUNTS_SQL, "tile_concat": CONCAT_SQL, "status_fold": FOLD_SQL,
    "batch_summary": BATCH_SQL, "late_drop": LATE_SQL, "frame_sampling": SAMPLING_SQL, "score_split": SPLIT_SQL, "triage_decision": TRIAGE_SQL,
    "image_batches": BATCHES_SQL, "slice_sample": SLICE_SQL, "unique_stems": STEMS_SQL,
    "progress_log": PROGRESS_SQL,
}
