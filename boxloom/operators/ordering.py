"""Numbering, slicing and batching over a whole table without one task that holds it all."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from boxloom.sources.durable import durable
from boxloom.streaming.folds import fold_batch

#: Rows that a slice may reach to and still be taken as the first so many of each partition.
TOP = 100_000


def numbered(df: DataFrame, key: str, ties: list[str], name: str = "row_no", ranges: int | None = None, hold: Callable[[DataFrame], DataFrame] = durable) -> DataFrame:
    """``df`` with ``name`` (long): the row's place from 1 in the order of ``key``, then ``ties``; nulls first.

    The table is cut into ranges of all these columns, ``ranges`` or as many as the session shuffles into, and sorted
    within them. Rows are numbered in their range and moved by the sizes of the ranges before it, of which there is one
    small row each. What is numbered is written out first, by ``hold``, so that a lost task finds the same ranges again.
    """
    order = [F.col(c).asc_nulls_first() for c in (key, *ties)]
    dealt = df.repartitionByRange(*order) if ranges is None else df.repartitionByRange(ranges, *order)
    ranged = hold(dealt.sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id()))
    ranged = ranged.withColumn("_range", F.shiftright("_at", 33))
    sizes = ranged.groupBy("_range").agg(F.count("*").alias("_n"))
    before = sizes.select(
        F.col("_range").alias("_of"),
        F.coalesce(F.sum("_n").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"),
    )
    inside = F.col("_at").bitwiseAND(F.lit((1 << 33) - 1)) + 1
    return ranged.join(before, F.col("_range") == F.col("_of")).withColumn(name, inside + F.col("_before")).drop("_at", "_range", "_of", "_before")


def batch_of(row_no: Column, size: int) -> Column:
    """Batch from 0 of the row with number ``row_no`` from 1; one batch if ``size`` is not positive."""
    return F.floor((row_no - 1) / size).cast("int") if size > 0 else F.lit(0)


def batch_folder(batch: Column) -> Column:
    return F.concat(F.lit("batch_"), F.lpad(batch.cast("string"), 4, "0"))


def sliced(df: DataFrame, key: str, ties: list[str], start: int, end: int | None, head: int | None) -> DataFrame:
    """Rows [start, end) in order, then the first ``head`` of them; an invalid range is ignored.

    A slice near the beginning takes the first rows of each partition only; any other numbers the table.
    """
    if start < 0 or (end is not None and end <= start):
        start, end = 0, None
    ends = [e for e in (end, None if head is None else start + head) if e is not None]
    last = min(ends) if ends else None
    if not start and last is None:
        return df
    if last is not None and last <= TOP:
        return df.orderBy(*[F.col(c).asc_nulls_first() for c in (key, *ties)]).offset(start).limit(last - start)
    out = numbered(df, key, ties, "_no").where(F.col("_no") > start)
    return (out if last is None else out.where(F.col("_no") <= last)).drop("_no")


def shuffled_key(name: Column, seed: int) -> Column:
    """A reproducible pseudo-random sort key."""
    return F.xxhash64(name, F.lit(seed))


def unique_stems(df: DataFrame, stem: str, order: list[str], name: str = "uniq_stem") -> DataFrame:
    """``df`` with ``name``: the stem itself if no row before has that name, else the first free of stem_1, stem_2 and so on.

    A null stem has a null name. Stems that differ by trailing numbers only can get in each other's way. Where all of such a family are one
    stem, its rows are numbered; else they are walked in order, with the names given so far as the state.
    """
    family = F.regexp_replace(stem, "(_[0-9]+)+$", "")
    rows, columns = df.withColumn("_family", family), df.columns
    mixed = rows.groupBy("_family").agg((F.min(stem) != F.max(stem)).alias("_mixed")).where("_mixed").select("_family")
    n = F.row_number().over(Window.partitionBy(stem).orderBy(*order)) - 1
    plain = rows.join(mixed, "_family", "left_anti").withColumn("_n", n)
    plain = plain.select(*df.columns, F.when(F.col("_n") == 0, F.col(stem)).otherwise(F.concat(stem, F.lit("_"), F.col("_n").cast("string"))).alias(name))

    def step(state: dict, row: dict) -> tuple[dict, list[dict]]:
        taken, k = state["names"], state["next"].get(row[stem], 0)
        while (free := f"{row[stem]}_{k}" if k else row[stem]) in taken:
            k += 1
        taken.add(free)
        state["next"][row[stem]] = k
        return state, [{**{c: row[c] for c in columns}, name: free}]

    schema = ", ".join([*(f"{f.name} {f.dataType.simpleString()}" for f in df.schema), f"{name} string"])
    walked = fold_batch(rows.join(mixed, "_family", "left_semi"), "_family", order, lambda: {"names": set(), "next": {}}, step, schema)
    return plain.union(walked)
