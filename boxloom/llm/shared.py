"""Helpers that several operators of this subpackage need."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from boxloom.sources.durable import durable

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def ascii_lower(text: Column) -> Column:
    """``text`` with A-Z lower-cased and every other character kept.

    ``lower`` agrees with that on text that is ASCII throughout. Else each letter is replaced by itself:
    26 quick passes, where ``translate`` takes time that grows with the square of a text's length.
    """
    each = text
    for upper, lower in zip(UPPER, LOWER):
        each = F.replace(each, F.lit(upper), F.lit(lower))
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(each)


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Column names like ``names`` that ``df`` has none of, whatever the case of their letters."""
    taken = {c.lower() for c in df.columns}
    lead = "_"
    while any((lead + name).lower() in taken for name in names):
        lead += "_"
    return [lead + name for name in names]


def crc_bucket(doc_id: Column, n: int) -> Column:
    """crc32 of the id's decimal text, modulo ``n``."""
    return F.crc32(doc_id.cast("string").cast("binary")) % n


def fold_links(label: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Merge the classes of positions ``i[k]`` and ``j[k]``; a class is named by its least position.

    ``label`` maps each position to its class and is updated in place.
    """
    while True:
        a, b = label[i], label[j]
        open_ = a != b
        if not open_.any():
            return label
        i, j = i[open_], j[open_]
        a, b = a[open_], b[open_]
        np.minimum.at(label, np.maximum(a, b), np.minimum(a, b))
        while not np.array_equal(up := label[label], label):
            label[:] = up


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of ``edges`` (src, dst); component is the least node reachable.

    Alternating stars: each round first links every node's larger neighbours, then its smaller ones,
    to the least node seen, until nothing changes. A round is two aggregations and two joins, whose hot
    keys AQE splits; rounds grow with the logarithm of a component's size, not with its diameter.
    """
    e = (
        edges.where("src <> dst")
        .select(F.greatest("src", "dst").alias("u"), F.least("src", "dst").alias("v"))
        .distinct()
    )
    e = durable(e)
    mark = _mark(e)
    while mark[0]:
        both = e.union(e.select("v", "u"))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        down = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (
            large.join(down, "u")
            .where("v <> m")
            .select(F.col("v").alias("u"), F.col("m").alias("v"))
            .union(down.select("u", "m"))
            .distinct()
        )
        e = durable(small)
        before, mark = mark, _mark(e)
        if before == mark:
            break
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).union(
        e.select("v", "v").distinct()
    )


def _mark(edges: DataFrame) -> tuple:
    """A count and checksum that tell two edge sets apart."""
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
