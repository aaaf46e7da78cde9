"""Line dedup by distinct-site spread.

Lines are hashed; a HyperLogLog sketch of the sites is kept for each hash and merged by aggregation. A
line whose estimate is clearly at or above the threshold is boilerplate, one clearly below is not, and
lines whose estimate is too near the threshold to tell get an exact distinct count. A boilerplate line
stays at its first place (least document id, then position) and goes everywhere else.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from boxloom.llm.shared import fresh
from boxloom.sources.durable import durable

#: A line on so many distinct sites is boilerplate.
MIN_SITES = 10
#: log2 of the sketch's slots; its relative standard error is about 1.04 / sqrt(2 ** LG_K).
LG_K = 10
#: Estimates within so many standard errors of the threshold are counted exactly.
NEAR_ERRORS = 4.0


def split_lines(text: Column) -> Column:
    """The lines of ``text``, cut at newlines only."""
    return F.split(text, "\n")


def _keys(line: Column) -> list[Column]:
    """128 bits that stand for a trimmed line: two independently seeded hashes."""
    return [F.xxhash64(line).alias("k1"), F.xxhash64(F.lit(7), line).alias("k2")]


def spread(docs: DataFrame, min_sites: int = MIN_SITES, lg_k: int = LG_K) -> DataFrame:
    """(k1, k2, first) for every boilerplate line; ``first`` is struct(doc_id, pos) of its first place.

    Lines of a null or blank kind and rows without a site count for nothing.
    """
    lines = (
        docs.select("doc_id", "source", F.posexplode(split_lines(F.col("text"))).alias("pos", "line"))
        .withColumn("line", F.trim("line"))
        .where("line <> ''")
        .select("doc_id", "source", "pos", *_keys(F.col("line")))
    )
    margin = NEAR_ERRORS * 1.04 / (2 ** (lg_k / 2)) * min_sites
    seen = durable(
        lines.groupBy("k1", "k2")
        .agg(
            F.hll_sketch_agg("source", lg_k).alias("sketch"),
            F.min(F.when(F.col("doc_id").isNotNull(), F.struct("doc_id", "pos"))).alias("first"),
            F.count("source").alias("n"),
        )
        .where(F.col("n") >= min_sites)
        .select("k1", "k2", "first", F.hll_sketch_estimate("sketch").alias("sites"))
        .where(F.col("sites") >= min_sites - margin)
    )
    sure = seen.where(F.col("sites") > min_sites + margin)
    near = seen.where(F.col("sites") <= min_sites + margin)
    exact = (
        lines.join(near.select("k1", "k2"), ["k1", "k2"], "left_semi")
        .groupBy("k1", "k2")
        .agg(F.count_distinct("source").alias("n"))
        .where(F.col("n") >= min_sites)
        .select("k1", "k2")
    )
    return sure.select("k1", "k2", "first").union(near.join(exact, ["k1", "k2"]).select("k1", "k2", "first"))


def dedup_lines(docs: DataFrame, min_sites: int = MIN_SITES, counts: bool = True) -> DataFrame:
    """``docs`` with ``text`` freed of boilerplate lines and, with ``counts``, n_lines and n_removed (long).

    Every row of the input comes back, with its other columns; its own columns of those two names give way.
    A null text stays null with no lines; an empty text is one blank line; blank lines always stay. Rows
    that repeat a doc_id are one document as far as the first place of a line goes, and rows with a null
    doc_id keep all their lines.
    """
    boiler = durable(spread(docs, min_sites))
    text_key = F.xxhash64("text")
    id_, key_, at_, lines_, n_ = fresh(docs, "drop_id", "drop_key", "drop_at", "lines", "n")
    drops = (
        docs.select("doc_id", text_key.alias("text_key"), F.posexplode(split_lines(F.col("text"))).alias("pos", "line"))
        .withColumn("line", F.trim("line"))
        .where("line <> ''")
        .select("doc_id", "text_key", "pos", *_keys(F.col("line")))
        .join(boiler, ["k1", "k2"])
        .where((F.col("doc_id") != F.col("first.doc_id")) | (F.col("pos") != F.col("first.pos")))
        .groupBy(F.col("doc_id").alias(id_), F.col("text_key").alias(key_))
        .agg(F.sort_array(F.collect_set("pos")).alias(at_))
    )
    names = ("n_lines", "n_removed") if counts else ()
    cols = [c for c in docs.columns if c.lower() not in names]
    lines = F.when(F.col("text").isNotNull(), split_lines(F.col("text")))
    out = (
        docs.select(*cols)
        .join(drops, (F.col("doc_id") == F.col(id_)) & (text_key == F.col(key_)), "left")
        .withColumn(lines_, lines)
        .withColumn(n_, F.coalesce(F.when(F.col(lines_).isNotNull(), F.size(lines_)), F.lit(0)))
    )
    # What stays is the runs of lines between those that go, so that the work is in proportion to the lines.
    starts = F.concat(F.array(F.lit(0)), F.transform(at_, lambda x: x + 1))
    ends = F.concat(at_, F.array(n_))
    held = F.flatten(F.zip_with(starts, ends, lambda start, end: F.slice(lines_, start + 1, end - start)))
    text = F.when(F.col(at_).isNull(), F.col("text")).otherwise(F.array_join(held, "\n"))
    numbers = (F.col(n_), F.coalesce(F.array_size(at_), F.lit(0)))
    return out.select(*[text.alias("text") if c == "text" else F.col(c) for c in cols], *[n.cast("long").alias(name) for name, n in zip(names, numbers)])


ORACLE = """
with l as (
  select doc_id, source, trim(line, ' ') as line, pos
  from (select doc_id, source, unnest(string_split(text, chr(10))) as line,
               generate_subscripts(string_split(text, chr(10)), 1) as pos
        from documents where text is not null)
), b as (
  select line, min({'d': doc_id, 'p': pos}) as first from l where line <> ''
  group by line having count(distinct source) >= 10
), k as (
  select l.doc_id, l.pos, (b.line is not null and {'d': l.doc_id, 'p': l.pos} <> b.first) as gone
  from l left join b on l.line = b.line
), raw as (
  select doc_id, unnest(string_split(text, chr(10))) as line,
         generate_subscripts(string_split(text, chr(10)), 1) as pos
  from documents where text is not null
)
select d.doc_id, coalesce(x.n_lines, 0) as n_lines, coalesce(x.n_removed, 0) as n_removed, coalesce(x.t, d.text) as text
from documents d left join (
  select raw.doc_id, count(*) as n_lines, count(*) filter (gone) as n_removed,
         coalesce(string_agg(raw.line, chr(10) order by raw.pos) filter (not gone), '') as t
  from raw join k on raw.doc_id = k.doc_id and raw.pos = k.pos group by raw.doc_id) x on d.doc_id = x.doc_id
"""
