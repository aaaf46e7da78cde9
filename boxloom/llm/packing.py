"""Best-fit packing into several sequence lengths.

Texts are cut into pieces of at most the longest permitted length. Pieces are dealt by hash into groups of
bounded size, copies of one piece evenly over all of them, and each group is packed by itself: pieces in
descending order go to the open bin with the least room that takes them; where none does, the bin size of least
cost per expected content is opened. At the end every bin shrinks to the least permitted length that holds its
contents.
"""

from __future__ import annotations

from bisect import bisect_left, insort

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from boxloom.sources.durable import durable

#: Permitted sequence lengths, in tokens.
CAPACITIES = (2048, 4096, 8192, 16384)
#: What a sequence costs besides its length, in tokens: longer sequences are cheaper by token.
BIN_COST = 64
#: Pieces aimed at in a group, and copies of a full piece that one row stands for until they are written out.
GROUP, COPIES = 8192, 4096


def byte_tokens(text: Column) -> Column:
    """Length of ``text`` in byte-level tokens (its UTF-8 bytes) and one end mark."""
    return F.octet_length(text).cast("long") + 1


def open_size(piece: int, rest: int, least: int, capacities: tuple[int, ...], bin_cost: int) -> int:
    """The permitted length of least cost by expected content for a bin that starts with ``piece``.

    ``rest`` is the length of all pieces to come and ``least`` that of the shortest; they fill the bin's
    room as far as they go. Of equal costs the shorter bin wins.
    """
    best, cost = capacities[-1], float("inf")
    for size in capacities:
        if size < piece:
            continue
        room = size - piece
        filled = piece + (min(room, rest) if least <= room else 0)
        if (size + bin_cost) / filled < cost:
            best, cost = size, (size + bin_cost) / filled
    return best


def best_fit(sizes: np.ndarray, capacities: tuple[int, ...] = CAPACITIES, bin_cost: int = BIN_COST) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bin, offset, capacity) for every piece, in the order given; pieces must fit the longest length.

    ``capacity`` is that of the piece's bin after shrinking. Pieces of equal size keep their order.
    """
    order = np.argsort(-sizes, kind="stable")
    rest, least = int(sizes.sum()), int(sizes.min()) if len(sizes) else 0
    bins, offset = np.zeros(len(sizes), np.int64), np.zeros(len(sizes), np.int64)
    used: list[int] = []
    room: list[tuple[int, int]] = []  # (room, bin) of open bins, ascending
    for i in order:
        size = int(sizes[i])
        rest -= size
        at = bisect_left(room, (size, -1))
        if at < len(room):
            left, b = room.pop(at)
        else:
            b, left = len(used), open_size(size, rest, least, capacities, bin_cost)
            used.append(0)
        bins[i], offset[i] = b, used[b]
        used[b] += size
        if left - size >= least:
            insort(room, (left - size, b))
    fits = np.asarray(capacities)[np.searchsorted(capacities, np.asarray(used, np.int64))] if used else np.zeros(0, np.int64)
    return bins, offset, fits[bins] if len(bins) else bins


def pieces_of(docs: DataFrame, tokens: Column, capacities: tuple[int, ...] = CAPACITIES) -> DataFrame:
    """(doc_id, row_key, piece, start, n_tokens): every row cut into pieces of at most the longest length."""
    top = capacities[-1]
    return (
        docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("doc_id", "text").alias("row_key"), F.coalesce(tokens, F.lit(1)).cast("long").alias("all"))
        .select("doc_id", "row_key", "all", F.explode(F.sequence(F.lit(0), F.ceil(F.col("all") / top).cast("int") - 1)).alias("piece"))
        .withColumn("start", F.col("piece").cast("long") * top)
        .select("doc_id", "row_key", "piece", "start", F.least(F.lit(top).cast("long"), F.col("all") - F.col("start")).alias("n_tokens"))
    )


def pack(docs: DataFrame, tokens: Column | None = None, capacities: tuple[int, ...] = CAPACITIES, group: int = GROUP) -> DataFrame:
    """(doc_id, piece, start, n_tokens, bin_id, bin_offset, bin_tokens, bin_capacity), one row for each piece.

    ``start`` is the piece's place in its text, ``bin_offset`` that in its sequence, ``bin_id`` a string.
    ``tokens`` gives a row's length; by default that of byte-level tokens with an end mark, so that a null
    or empty text is its end mark alone. Rows that repeat are packed each; a null doc_id stays null.
    """
    capacities = tuple(sorted(capacities))
    pieces = pieces_of(docs, byte_tokens(F.coalesce("text", F.lit(""))) if tokens is None else tokens, capacities)
    # Rows that repeat are alike in all that counts here, so that one row and their number stand for them.
    parts = durable(pieces.groupBy("doc_id", "row_key", "piece", "start", "n_tokens").agg(F.count("*").alias("copies")))
    full = F.col("n_tokens") == capacities[-1]
    groups = max(1, -(-(parts.where(~full).agg(F.sum("copies")).first()[0] or 0) // group))
    k = F.explode(F.sequence(F.lit(0), (F.least("copies", F.lit(groups)) - 1).cast("int"))).alias("k")
    loose = (
        parts.where(~full)
        .select("*", k)
        .withColumn("grp", F.pmod(F.pmod(F.xxhash64("row_key", "piece"), F.lit(groups)) + F.col("k"), F.lit(groups)).cast("int"))
        .withColumn("copies", F.floor(F.col("copies") / groups) + (F.col("k") < F.col("copies") % groups).cast("int"))
        .drop("k")
        .groupBy("grp")
        .applyInPandas(
            lambda rows: _pack_group(rows, capacities),
            "doc_id long, piece int, start long, n_tokens long, bin_id string, bin_offset long, bin_tokens long, bin_capacity long",
        )
    )
    some = F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1, F.lit(COPIES).cast("long"))).alias("from")
    each = F.explode(F.sequence("from", F.least("copies", F.col("from") + COPIES) - 1)).alias("copy")
    alone = (
        parts.where(full).select("*", some).repartition("row_key", "piece", "from").select("doc_id", "row_key", "piece", "start", "n_tokens", each)
    ).select(
        "doc_id", "piece", "start", "n_tokens",
        F.concat_ws("-", F.lit("full"), F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), F.hex("row_key"), "piece", "copy").alias("bin_id"),
        F.lit(0).cast("long").alias("bin_offset"), F.col("n_tokens").alias("bin_tokens"), F.col("n_tokens").alias("bin_capacity"),
    )
    return loose.union(alone)


def _pack_group(rows: pd.DataFrame, capacities: tuple[int, ...]) -> pd.DataFrame:
    rows = rows.sort_values(["row_key", "doc_id", "piece"], kind="stable").reset_index(drop=True)
    rows = rows.loc[rows.index.repeat(rows["copies"])]
    bins, offset, capacity = best_fit(rows["n_tokens"].to_numpy(), capacities)
    total = np.bincount(bins, weights=rows["n_tokens"]).astype(np.int64)
    names = np.char.add(f"{rows['grp'].iloc[0]}-", bins.astype(str))
    return pd.DataFrame(
        {"doc_id": rows["doc_id"], "piece": rows["piece"], "start": rows["start"], "n_tokens": rows["n_tokens"], "bin_id": names, "bin_offset": offset, "bin_tokens": total[bins], "bin_capacity": capacity}
    )
