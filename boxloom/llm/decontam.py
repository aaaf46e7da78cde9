"""Benchmark decontamination with DataFrame functions only.

Test items become windows of WINDOW words (an item with fewer words is one window). The distinct windows
form a hash set that is broadcast if its measured size is within MAX_BROADCAST_BYTES. The windows of training
texts are then looked up by a hash of their first two words; those that are in that set too are hashed whole and
looked up again, and what is found is verified word by word. A larger set is met by shuffled hashes of whole
windows, without any words, and only what is found goes back to its text to be verified. A document with enough
of its words in hits counts as contaminated.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from boxloom.llm.shared import ascii_lower, fresh
from boxloom.sources.durable import durable

WINDOW = 13
#: A document is contaminated if it has a hit and SHARE times its hit words are at least its words.
SHARE = 20
#: Bytes of benchmark windows that are broadcast at most, each counted with OVERHEAD bytes for itself and its words.
MAX_BROADCAST_BYTES, OVERHEAD = 200_000_000, 256
#: Parts that a shuffled window is dealt into, as one passage may stand in a third of all documents.
SALT = 16
#: Stands for the row itself among the hashes of its windows' first words.
MARK = -1

#: What separates words once A-Z are lower-cased, and what makes a word before that.
GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def words_of(text: Column) -> Column:
    """Lower-cased words of ``text``; null has none."""
    return F.array_remove(F.split(ascii_lower(F.coalesce(text, F.lit(""))), GAP), "")


def benchmark_windows(benchmark: DataFrame) -> DataFrame:
    """(item_id, len, gram): the distinct windows of every item that has words."""
    words = benchmark.select(F.col("item_id").cast("string").alias("item_id"), words_of(F.col("text")).alias("w")).where("size(w) > 0")
    windows = F.transform(F.sequence(F.lit(0), F.size("w") - WINDOW), lambda i: F.array(*_from(i, WINDOW)))
    grams = F.when(F.size("w") <= WINDOW, F.array("w")).otherwise(windows)
    return words.select("item_id", F.least(F.size("w"), F.lit(WINDOW)).alias("len"), F.explode(grams).alias("gram")).distinct()


def _from(i: Column, n: int) -> list[Column]:
    """``n`` words from place ``i``, counted from 0. Within a lambda ``slice`` would read the whole array for each of them."""
    return [F.get("w", i + k) for k in range(n)]


def find_hits(docs: DataFrame, benchmark: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Hits (doc_id, text_key, n_words, pos, len, h, gram), and the items (h, gram, item_id) of every window.

    ``pos`` counts a document's words from 1. Each row of ``docs`` also has one row with pos 0, which is no
    hit but tells its words.
    """
    items = durable(benchmark_windows(benchmark).withColumn("h", F.xxhash64("gram")))
    # The bytes of all windows and their lengths decide the plan; both are single small values.
    size = F.sum(F.octet_length(F.array_join("gram", " ")).cast("long") + OVERHEAD)
    sizes = items.agg(F.coalesce(size, F.lit(0)).alias("bytes"), F.collect_set("len").alias("lens")).first()
    grams = items.select(F.col("h").alias("g_h"), "gram").distinct()
    words = docs.select("doc_id", F.xxhash64("text").alias("text_key"), words_of(F.col("text")).alias("w"))
    find = _by_broadcast if sizes.bytes <= MAX_BROADCAST_BYTES else _by_shuffle
    return find(words, items, grams, sorted(sizes.lens)), items.select("h", "gram", "item_id")


def _by_broadcast(words: DataFrame, items: DataFrame, grams: DataFrame, lens: list[int]) -> DataFrame:
    """Hits by two broadcast joins in one pass over the texts. Rows with pos 0 are carried through them; nothing is dealt by key."""
    start = F.xxhash64(F.get("gram", 0), F.get("gram", 1)) if 1 not in lens else F.when(F.col("len") == 1, F.xxhash64(F.get("gram", 0))).otherwise(F.xxhash64(F.get("gram", 0), F.get("gram", 1)))
    mark = F.lit(MARK).cast("long")
    starts = items.groupBy(start.alias("start")).agg(F.collect_set("len").alias("lens"))
    starts = starts.union(items.sparkSession.range(1).select(mark, F.array(F.lit(0))))
    pairs = F.transform("w", lambda x, i: F.xxhash64(x, F.get("w", i + 1)))
    keys = F.concat(F.array(mark), pairs, F.transform("w", lambda x: F.xxhash64(x))) if 1 in lens else F.concat(F.array(mark), pairs)
    scan = words.select("doc_id", "text_key", F.size("w").cast("long").alias("n_words"), "w", F.posexplode(keys).alias("p", "start"))
    pos = F.when(F.col("p") > F.col("n_words"), F.col("p") - F.col("n_words")).otherwise(F.col("p")).cast("int")
    near = (
        scan.withColumn("pos", pos)
        .join(F.broadcast(starts), "start")
        .select("doc_id", "text_key", "n_words", "pos", F.explode("lens").alias("len"), "w")
        .withColumn("seen", F.slice("w", F.greatest(F.lit(1), "pos"), F.col("len")))
        .select("doc_id", "text_key", "n_words", "pos", "len", "seen", F.xxhash64("seen").alias("h"))
    )
    hits = near.join(F.broadcast(grams), (F.col("h") == F.col("g_h")) & (F.col("seen") == F.col("gram")), "left").where("pos = 0 or gram is not null")
    return hits.select("doc_id", "text_key", "n_words", "pos", "len", "h", "gram")


def _by_shuffle(words: DataFrame, items: DataFrame, grams: DataFrame, lens: list[int]) -> DataFrame:
    """Hits by shuffled hashes of whole windows; windows and texts meet only where hashes do."""
    ids = words.select("doc_id", "text_key", F.size("w").cast("long").alias("n_words"), "w")
    # The hash of several words is that of their array.
    window = lambda n: lambda i: F.struct((i + 1).alias("pos"), F.lit(n).alias("len"), F.xxhash64(*_from(i, n)).alias("h"))
    each = [F.transform(F.sequence(F.lit(0), F.size("w") - n), window(n)) for n in lens]
    none = F.array().cast("array<struct<pos:int,len:int,h:bigint>>")
    seen = ids.select("doc_id", "text_key", F.explode(F.concat(*[F.when(F.size("w") >= n, a).otherwise(none) for n, a in zip(lens, each)])).alias("s")).select("doc_id", "text_key", "s.*")
    dealt = grams.select("g_h").distinct().select("g_h", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))).alias("g_salt"))
    met = durable(seen.join(dealt, (F.col("h") == F.col("g_h")) & (F.pmod(F.xxhash64("doc_id", "text_key", "pos"), F.lit(SALT)) == F.col("g_salt")), "left_semi"))
    texts = met.select(F.col("doc_id").alias("m_id"), F.col("text_key").alias("m_key")).distinct()
    texts = ids.distinct().join(texts, F.col("doc_id").eqNullSafe(F.col("m_id")) & F.col("text_key").eqNullSafe(F.col("m_key"))).select("m_id", "m_key", "n_words", "w")
    shown = met.join(texts, F.col("doc_id").eqNullSafe(F.col("m_id")) & F.col("text_key").eqNullSafe(F.col("m_key"))).select(
        "doc_id", "text_key", "n_words", "pos", "len", "h", F.slice("w", F.col("pos"), F.col("len")).alias("seen"), F.pmod(F.xxhash64("doc_id", "text_key", "pos"), F.lit(SALT)).alias("salt")
    )
    dealt = grams.select("*", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))).alias("g_salt"))
    hits = shown.join(dealt, (F.col("h") == F.col("g_h")) & (F.col("salt") == F.col("g_salt")) & (F.col("seen") == F.col("gram")))
    marks = ids.select("doc_id", "text_key", "n_words", F.lit(0).alias("pos"), F.lit(0).alias("len"), F.lit(None).cast("long").alias("h"), F.lit(None).cast("array<string>").alias("gram"))
    return hits.select("doc_id", "text_key", "n_words", "pos", "len", "h", "gram").union(marks)


def judge(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Per row: doc_id, text_key, n_words, n_hit, n_items, items_sha256, contaminated and hit_at.

    ``hit_at`` holds the positions (from 1) of words inside any hit. A null text and one without words
    has no words and is clean; so is every document when the benchmark has no words. Rows that repeat a
    doc_id are judged by their own text; a null doc_id is judged like any other.
    """
    found, items = find_hits(docs, benchmark)
    found = durable(found)
    hits = found.where("pos > 0")
    covered = hits.groupBy("doc_id", "text_key").agg(
        F.array_distinct(F.flatten(F.collect_set(F.sequence("pos", F.col("pos") + F.col("len") - 1)))).alias("hit_at")
    )
    named = (
        hits.select("doc_id", "text_key", "h", "gram").distinct()
        .join(items, ["h", "gram"])
        .groupBy(F.col("doc_id").alias("nd"), F.col("text_key").alias("nt"))
        .agg(F.sort_array(F.collect_set("item_id")).alias("items"))
    )
    of = covered.join(named, F.col("doc_id").eqNullSafe(F.col("nd")) & (F.col("text_key") == F.col("nt"))).select(
        F.col("doc_id").alias("found_id"), F.col("text_key").alias("found_key"), "hit_at", "items"
    )
    return (
        found.where("pos = 0")
        .select("doc_id", "text_key", "n_words")
        .join(of, F.col("doc_id").eqNullSafe(F.col("found_id")) & (F.col("text_key") == F.col("found_key")), "left")
        .withColumn("n_hit", F.when(F.col("hit_at").isNull(), 0).otherwise(F.size("hit_at")).cast("long"))
        .select(
            "doc_id",
            "text_key",
            "n_words",
            "n_hit",
            F.when(F.col("items").isNull(), 0).otherwise(F.size("items")).cast("long").alias("n_items"),
            F.sha2(F.coalesce(F.array_join("items", ","), F.lit("")), 256).alias("items_sha256"),
            ((F.col("n_hit") > 0) & (F.col("n_hit") * SHARE >= F.col("n_words"))).alias("contaminated"),
            "hit_at",
        )
    )


def drop_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``docs`` without contaminated documents; same columns."""
    id_, key_ = fresh(docs, "bad_id", "bad_key")
    bad = judge(docs, benchmark).where("contaminated").select(F.col("doc_id").alias(id_), F.col("text_key").alias(key_))
    return docs.join(bad, F.col("doc_id").eqNullSafe(F.col(id_)) & (F.xxhash64("text") == F.col(key_)), "left_anti")


def cut_spans(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``docs`` with every hit word, and what separates it from the next word, cut from ``text``."""
    id_, key_, at_ = fresh(docs, "hit_id", "hit_key", "hit_at")
    hits = judge(docs, benchmark).where("n_hit > 0").select(F.col("doc_id").alias(id_), F.col("text_key").alias(key_), F.col("hit_at").alias(at_)).dropDuplicates([id_, key_])
    gap = "[" + r"\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F" + "]*"
    parts = F.regexp_extract_all("text", F.lit(WORD + gap), F.lit(0))
    kept = F.filter(parts, lambda _, i: ~F.array_contains(at_, i + 1))
    text = F.when(F.col(at_).isNull(), F.col("text")).otherwise(
        F.concat(F.regexp_extract("text", "^" + gap, 0), F.array_join(kept, ""))
    )
    joined = docs.join(hits, F.col("doc_id").eqNullSafe(F.col(id_)) & (F.xxhash64("text") == F.col(key_)), "left")
    return joined.select(*[text.alias("text") if c == "text" else docs[c] for c in docs.columns])


ORACLE = r"""
with dw as (
  select doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') as w
  from documents
), bw as (
  select cast(item_id as varchar) as item_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') as w
  from benchmark
), bg as (
  select distinct item_id, least(len(w), 13) as n, list_slice(w, i, i + least(len(w), 13) - 1) as g
  from (select item_id, w, unnest(range(1, len(w) - least(len(w), 13) + 2)) as i from bw where len(w) > 0)
), lens as (select distinct n from bg),
dg as (
  select doc_id, n, i, list_slice(w, i, i + n - 1) as g
  from (select doc_id, w, n, unnest(range(1, len(w) - n + 2)) as i from dw, lens where len(w) >= n)
), hit as (select dg.doc_id, dg.i, dg.n, bg.item_id from dg join bg on dg.g = bg.g and dg.n = bg.n),
pos as (select doc_id, count(distinct p) as n_hit from (select doc_id, unnest(range(i, i + n)) as p from hit) group by doc_id),
its as (select doc_id, count(*) as n_items, string_agg(item_id, ',' order by item_id) as s from (select distinct doc_id, item_id from hit) group by doc_id)
select dw.doc_id, cast(len(w) as bigint) as n_words, coalesce(n_hit, 0) as n_hit, coalesce(n_items, 0) as n_items,
       sha256(coalesce(s, '')) as items_sha256, coalesce(n_hit, 0) > 0 and 20 * coalesce(n_hit, 0) >= len(w) as contaminated
from dw left join pos on dw.doc_id = pos.doc_id left join its on dw.doc_id = its.doc_id
"""
