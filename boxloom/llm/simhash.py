"""Near-duplicate documents by SimHash and a binary trie self-join.

Fingerprints link at MAX_BITS or fewer differing bits. Equal fingerprints are one node. Two fingerprints
that differ in at most three bits differ in at most one bit of their first or of their last half, so two
tries are joined with themselves, one for each half leading: node pairs are walked together from the
root, their differing bits add up, and a pair is left as soon as it has more than HALF_BITS in the
leading half or more than MAX_BITS in all. The upper levels are walked by Spark, which deals the pairs
of subtrees out as groups and walks on below those that are too large; the lower levels by numpy within a group.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from boxloom.llm.shared import connected_components, fold_links, fresh
from boxloom.sources.durable import durable

SHINGLE = 3
SEED = 42
MAX_BITS = 3
HALF_BITS = MAX_BITS // 2
#: Fingerprints aimed at in a subtree that one group of a task takes; a pair of subtrees with LIMIT times as many is
#: walked further by Spark, STEP levels at a time.
SUBTREE, LIMIT, STEP = 8192, 4, 4
#: Hashes whose bits are counted at once.
CHUNK = 1 << 16
#: Node pairs walked at once, and the size of a pair that is compared outright.
FRONT, LEAF = 1 << 19, 16


def shingle_hashes(text: bytes | None) -> np.ndarray:
    """XXH64 of the word shingles of ``text``, repeats included; none without words."""
    words = text.lower().split() if text else []
    if len(words) < SHINGLE:
        grams = [b" ".join(words)] if words else []
    else:
        grams = map(b" ".join, zip(words, words[1:], words[2:]))
    return np.fromiter(map(partial(xxhash.xxh64_intdigest, seed=SEED), grams), np.uint64)


def fingerprint(hashes: np.ndarray) -> np.uint64:
    """Bit b is 1 if more than half of ``hashes`` have it."""
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), CHUNK):
        part = np.ascontiguousarray(hashes[at : at + CHUNK])
        bits = np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += np.add.reduce(bits, axis=0, dtype=np.int32)
    return np.packbits(2 * ones > len(hashes), bitorder="little").view(np.uint64)[0]


def _fingerprint_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        prints = np.fromiter((fingerprint(shingle_hashes(x.as_py())) for x in batch.column(1)), np.uint64, len(batch))
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(prints.view(np.int64)), *batch.columns[2:]], ["doc_id", "fp", *batch.schema.names[2:]])


def fingerprints(docs: DataFrame, keyed: bool = False) -> DataFrame:
    """(doc_id, fp long) for every row, and a hash ``key`` of its text if ``keyed``.

    A null text has no words and so fingerprint zero.
    """
    key = [F.xxhash64("text").alias("key")] if keyed else []
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("binary"), *key).mapInArrow(
        _fingerprint_batches, "doc_id long, fp long" + ", key long" * keyed
    )


def _near(a: np.ndarray, b: np.ndarray, same: bool, top: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Positions in sorted ``a`` and ``b`` of values within the budgets; the tries share ``64 - top`` levels.

    ``same``: both are one trie, and each pair of its positions comes once.
    """
    start = np.array([[0, len(a), 0, len(b)]])
    err = np.bitwise_count(a[:1] >> np.uint64(top) ^ b[:1] >> np.uint64(top)).astype(np.int64) if top < 64 else np.zeros(1, np.int64)
    stack = [(start, err, top)]
    while stack:
        nodes, err, level = stack.pop()
        if len(nodes) > FRONT:
            half = len(nodes) // 2
            stack += [(nodes[:half], err[:half], level), (nodes[half:], err[half:], level)]
            continue
        size = (nodes[:, 1] - nodes[:, 0]) * (nodes[:, 3] - nodes[:, 2])
        done = size <= LEAF if level else np.ones(len(nodes), bool)
        if done.any():
            yield from _compare(a, b, nodes[done], size[done], same)
            nodes, err = nodes[~done], err[~done]
        if not len(nodes):
            continue
        level -= 1
        bit = np.uint64(1 << level)
        low = bit - np.uint64(1)
        cut = [np.searchsorted(x, x[nodes[:, k]] & ~(bit | low) | bit) for x, k in ((a, 0), (b, 2))]
        own = (nodes[:, 0] == nodes[:, 2]) if same else np.zeros(len(nodes), bool)
        limit = HALF_BITS if level >= 32 else MAX_BITS
        lo_a, hi_a, lo_b, hi_b = nodes.T
        kids, errs = [], []
        for x, y in ((0, 0), (1, 1), (0, 1), (1, 0)):
            to = np.stack([cut[0] if x else lo_a, hi_a if x else cut[0], cut[1] if y else lo_b, hi_b if y else cut[1]], axis=1)
            e = err + (x != y)
            take = (to[:, 0] < to[:, 1]) & (to[:, 2] < to[:, 3]) & (e <= limit)
            if (x, y) == (1, 0):
                take &= ~own
            kids.append(to[take])
            errs.append(e[take])
        stack.append((np.concatenate(kids), np.concatenate(errs), level))


def _compare(a: np.ndarray, b: np.ndarray, nodes: np.ndarray, size: np.ndarray, same: bool) -> Iterator:
    """The near pairs among all that ``nodes`` span, some ``FRONT`` at a time."""
    for part in np.array_split(np.arange(len(nodes)), max(1, int(size.sum()) // FRONT)):
        n = size[part]
        if not n.sum():
            continue
        node = np.repeat(part, n)
        k = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        width = (nodes[:, 3] - nodes[:, 2])[node]
        i, j = nodes[node, 0] + k // width, nodes[node, 2] + k % width
        hit = np.bitwise_count(a[i] ^ b[j]) <= MAX_BITS
        if same:
            hit &= i < j
        if hit.any():
            yield i[hit], j[hit]


def _join_subtrees(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
    """Star edges (src, dst) of fingerprints that connect what is linked between or in the subtrees of a group."""
    turn, first, second, top = (int(x) for x in key)
    value = rows["fp"].to_numpy().view(np.uint64)
    if turn:
        value = value << np.uint64(32) | value >> np.uint64(32)
    order = np.argsort(value, kind="stable")
    value, ids = value[order], rows["fp"].to_numpy()[order]
    split = np.searchsorted(value >> np.uint64(top), np.uint64(second)) if second != first else 0
    label = np.arange(len(value))
    if second == first:
        pairs, shift = _near(value, value, True, top), 0
    elif 0 < split < len(value):
        pairs, shift = _near(value[:split], value[split:], False, top), split
    else:
        pairs, shift = [], 0
    for i, j in pairs:
        fold_links(label, i, j + shift)
    linked = np.flatnonzero(label != np.arange(len(label)))
    return pd.DataFrame({"src": ids[linked], "dst": ids[label[linked]]})


GROUP = ("turn", "first", "second", "top")


def _walked(rows: DataFrame, levels: int) -> DataFrame:
    """``rows`` (fp, turn, v, mate, err, top) after so many more levels of the tries.

    A row stands for a fingerprint in the pair of its own node and ``mate``. A level down it meets both children of
    the mate, with one error more where the bits differ, as far as the budget allows.
    """
    for _ in range(levels):
        bit = F.explode(F.array(F.lit(0), F.lit(1))).alias("bit")
        limit = F.when(F.col("top") >= 32, HALF_BITS).otherwise(MAX_BITS)
        own = F.expr("shiftrightunsigned(v, top) & 1")
        rows = (
            rows.select("fp", "turn", "v", "mate", "err", (F.col("top") - 1).alias("top"), bit)
            .select("fp", "turn", "v", (F.col("mate") * 2 + F.col("bit")).alias("mate"), (F.col("err") + (own != F.col("bit")).cast("int")).alias("err"), "top")
            .where(F.col("err") <= limit)
        )
    return rows


def _grouped(rows: DataFrame) -> DataFrame:
    """``rows`` with own, first and second: each in the pair of nodes it stands for."""
    own = F.expr("shiftrightunsigned(v, top)")
    return rows.withColumns({"own": own, "first": F.least(own, "mate"), "second": F.greatest(own, "mate")})


def link_fingerprints(nodes: DataFrame, n: int) -> DataFrame:
    """Edges (src, dst) that connect all fingerprints that link; ``nodes`` has distinct ``fp``.

    Not every link is an edge, but linked nodes are always reachable. ``n`` is the number of nodes; it
    sets how many levels Spark walks at first. Pairs of subtrees that are still too large are walked further, so
    that a group is bounded however alike the leading bits are: STEP levels above the leaves a pair holds few anyway.
    """
    levels = int(min(20, max(2, np.ceil(np.log2(max(n, 1) / SUBTREE)))))
    turned = F.explode(
        F.array(
            F.struct(F.lit(0).alias("turn"), F.col("fp").alias("v")),
            F.struct(
                F.lit(1).alias("turn"),
                F.shiftleft("fp", 32).bitwiseOR(F.shiftrightunsigned("fp", 32)).alias("v"),
            ),
        )
    ).alias("t")
    own = F.shiftrightunsigned("v", 64 - levels)
    flips = F.explode(F.array(F.lit(0), *[F.lit(1 << i) for i in range(levels)])).alias("flip")
    rows = (
        nodes.select("fp", turned)
        .select("fp", "t.turn", "t.v", flips)
        .select("fp", "turn", "v", own.bitwiseXOR(F.col("flip").cast("long")).alias("mate"), (F.col("flip") != 0).cast("int").alias("err"), F.lit(64 - levels).alias("top"))
    )
    taken, rows = None, _grouped(rows)
    while True:
        both = (F.col("first") == F.col("second")) | (F.min("own") < F.max("own"))
        pairs = rows.groupBy(*GROUP).agg(F.count("*").alias("size"), both.alias("both")).where("size > 1 and both")
        pairs = durable(pairs.select(*[F.col(c).alias(f"l_{c}") for c in GROUP], ((F.col("size") > LIMIT * SUBTREE) & (F.col("top") > STEP)).alias("large")))
        last = pairs.where("large").isEmpty()
        # Pairs with an empty side are left here, so that walking on is in proportion to what is there.
        found = rows.join(pairs, (F.col("turn") == F.col("l_turn")) & (F.col("first") == F.col("l_first")) & (F.col("second") == F.col("l_second")) & (F.col("top") == F.col("l_top")))
        small = (rows if last and taken is None else found.where("not large")).select("fp", *GROUP)
        taken = small if taken is None else taken.union(small)
        if last:
            break
        rows = _grouped(durable(_walked(found.where("large"), STEP)))
    return taken.groupBy(*GROUP).applyInPandas(_join_subtrees, "src long, dst long")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """(doc_id, fingerprint, component_id) for every row of ``docs``.

    component_id is the least doc_id reachable over links, the document's own included. Documents
    without words have fingerprint zero and link like any other. A null doc_id takes part, but names a
    component only if all its documents lack one (then null).
    """
    return _with_components(durable(fingerprints(docs))).select(
        "doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id"
    )


def _with_components(prints: DataFrame) -> DataFrame:
    """``prints`` (doc_id, fp and others) with component_id; fingerprints are the nodes, ids only name what they form."""
    nodes = durable(prints.groupBy("fp").agg(F.min("doc_id").alias("rep")))
    component = connected_components(link_fingerprints(nodes, nodes.count()))
    linked = nodes.join(component, F.col("fp") == F.col("node")).select("fp", "rep", "component")
    least = linked.groupBy("component").agg(F.min("rep").alias("least"))
    linked = linked.join(least, "component").select(F.col("fp").alias("l_fp"), "least")
    by_print = nodes.join(linked, F.col("fp") == F.col("l_fp"), "left").select("fp", F.coalesce("least", "rep").alias("component_id"))
    return prints.join(by_print, "fp")


def dedup_documents(docs: DataFrame) -> DataFrame:
    """``docs`` without the rows whose component has one of a smaller doc_id; same columns.

    Texts that share a doc_id are judged each by its own component. Rows that repeat a doc_id and text all
    stay or all go; rows with a null doc_id stay.
    """
    found = _with_components(durable(fingerprints(docs, keyed=True)))
    id_, key_ = fresh(docs, "gone_id", "gone_key")
    gone = found.where("doc_id <> component_id").select(F.col("doc_id").alias(id_), F.col("key").alias(key_)).distinct()
    return docs.join(gone, (F.col("doc_id") == F.col(id_)) & (F.xxhash64("text") == F.col(key_)), "left_anti")
