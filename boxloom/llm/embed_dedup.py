"""Embedding near-dedup with randomised-rotation binary codes.

Unit vectors are rotated at random and kept as packed sign bits with a correction factor, the inner product of
vector and code. Codes and factors are stored once. Bands of code bits decide which codes meet; what meets is
compared by XOR and popcount, whose share of differing bits is an unbiased estimate of the angle. Only of pairs
whose confidence bound reaches the threshold are the vectors fetched. With these the inner product of a code and
the other rotated vector, divided by the stored factor, is an unbiased estimate of the cosine with a narrower
bound, and pairs that it leaves open are recomputed exactly in double precision.

Equal vectors are one class; crowded buckets are cut into blocks that meet pairwise, so that no task holds more
than two blocks. What is shuffled for each band is a code, not a vector.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from boxloom.llm.shared import connected_components, fold_links
from boxloom.sources.durable import durable

THRESHOLD = 0.95
#: Chance that a linked pair right at the threshold agrees on no band.
MISS = 0.003
#: Bits of a code at least; vectors of fewer dimensions are rotated several times.
WIDTH = 192
#: Classes aimed at in a bucket, and the most that a block of a crowded bucket holds.
BUCKET, BLOCK = 128, 1024
#: Classes aimed at in a group of uncrowded buckets.
SHARD = 4096
#: Standard errors of the estimates that a bound allows.
ERRORS = 4.0
SEED = 20


def rotations(dim: int, count: int, seed: int = SEED) -> np.ndarray:
    """``count`` random orthogonal (dim x dim) matrices side by side: (dim, count * dim)."""
    rng = np.random.default_rng(seed)
    return np.concatenate([np.linalg.qr(rng.standard_normal((dim, dim)))[0] for _ in range(count)], axis=1)


@lru_cache(maxsize=8)
def turn_of(dim: int) -> np.ndarray:
    """The rotations of vectors of ``dim`` that give a code of WIDTH bits or more; unit vectors stay unit vectors."""
    count = -(-WIDTH // dim)
    return rotations(dim, count) / math.sqrt(count)


def plan_bands(n: int, threshold: float = THRESHOLD, miss: float = MISS) -> tuple[int, int]:
    """(bits of a band, bands) for ``n`` vectors: buckets of about BUCKET, and ``miss`` at the threshold.

    A band is a sample of the code's bits, so the chance is taken over how many of these differ.
    """
    bits = int(min(30, max(6, round(math.log2(max(n, 1) / BUCKET)))))
    p = math.acos(threshold) / math.pi
    share = [math.comb(WIDTH, h) * p**h * (1 - p) ** (WIDTH - h) for h in range(WIDTH + 1)]
    agree = [math.comb(WIDTH - h, bits) / math.comb(WIDTH, bits) for h in range(WIDTH + 1)]
    bands = 1
    while sum(w * (1 - a) ** bands for w, a in zip(share, agree)) > miss:
        bands += 1 + bands // 32
    return bits, bands


@lru_cache(maxsize=8)
def band_bits(width: int, bits: int, bands: int) -> np.ndarray:
    """(bands, bits) places of the code's bits that make up each band."""
    rng = np.random.default_rng(SEED + 1)
    return np.stack([rng.permutation(width)[:bits] for _ in range(bands)])


def words_of(bits: np.ndarray) -> np.ndarray:
    """Rows of booleans as rows of 64-bit words, the last padded with zeros."""
    return np.packbits(np.pad(bits, ((0, 0), (0, -bits.shape[1] % 64))), axis=1).view(np.uint64)


def signs_of(words: np.ndarray, width: int) -> np.ndarray:
    """Codes of +-1/sqrt(width) from rows of words."""
    return (np.unpackbits(words.view(np.uint8), axis=1)[:, :width] * 2.0 - 1.0) / math.sqrt(width)


@lru_cache(maxsize=8)
def band_masks(width: int, bits: int, bands: int) -> np.ndarray:
    """(bands, words): the bits of each band, as in a code."""
    on = np.zeros((bands, width), bool)
    on[np.arange(bands)[:, None], band_bits(width, bits, bands)] = True
    return words_of(on)


def usable(embedding: str = "embedding"):
    """Whether a vector can link: not null, no null or non-finite component, and not zero."""
    v = F.col(embedding)
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.coalesce(v.isNotNull() & finite & F.exists(v, lambda x: x != 0), F.lit(False))


def coded(classes: DataFrame, bits: int, bands: int) -> DataFrame:
    """``classes`` (rep, n, embedding) with code (packed bits), factor and buckets, one of each band."""

    def code(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        weight = 1 << np.arange(bits, dtype=np.int64)
        for b in batches:
            for dim, rows in b.groupby(b["embedding"].map(len)):
                turn = turn_of(dim)
                rotated, signs, factor = sign_codes(_unit(rows["embedding"])[1], turn)
                on = signs > 0
                words = words_of(on)
                buckets = on[:, band_bits(turn.shape[1], bits, bands)] @ weight
                yield rows.assign(code=[w.tobytes() for w in words], factor=factor, buckets=list(buckets.astype(np.int32)))

    kind = classes.schema["embedding"].dataType.simpleString()
    return classes.mapInPandas(code, f"rep long, n long, embedding {kind}, code binary, factor double, buckets array<int>")


def _unit(embedding: pd.Series) -> tuple[np.ndarray, np.ndarray]:
    """Vectors in double precision, and scaled to length one."""
    x = np.stack(embedding.to_numpy()).astype(np.float64)
    scale = np.abs(x).max(axis=1, keepdims=True)
    y = x / scale
    return y, y / np.linalg.norm(y, axis=1, keepdims=True)


def sign_codes(unit: np.ndarray, turn: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(rotated, code, factor): rotated vectors, their codes of +-1/sqrt(width), and the product of both."""
    rotated = unit @ turn
    code = np.where(rotated >= 0, 1.0, -1.0) / math.sqrt(turn.shape[1])
    return rotated, code, np.einsum("ij,ij->i", rotated, code)


def may_link(code: np.ndarray, factor: np.ndarray, other: np.ndarray, threshold: float, errors: float = ERRORS) -> np.ndarray:
    """Where the upper bound of the estimated cosine of coded and rotated vectors reaches ``threshold``.

    ``code`` and ``other`` are matched row by row. Of a pair with cosine ``threshold`` or more the estimate's standard
    error is at most sqrt((1 - threshold ** 2) * (1 - factor ** 2) / (width - 1)) / factor.
    """
    guess = np.einsum("ij,ij->i", code, other) / factor
    error = np.sqrt(np.maximum(0, 1 - factor**2) * max(0.0, 1 - threshold**2) / max(1, code.shape[1] - 1)) / factor
    return guess + errors * error >= threshold - 1e-9


def most_differing(width: int, threshold: float, errors: float = ERRORS) -> float:
    """Differing bits of ``width`` that a pair at the threshold has at most, within ``errors`` standard errors."""
    p = math.acos(threshold) / math.pi
    return width * p + errors * math.sqrt(width * p * (1 - p))


def pairs_in_runs(start: np.ndarray, end: np.ndarray, most: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All i < j within each run [start, end) of positions, about ``most`` pairs at a time."""
    row = np.concatenate([np.arange(s, e) for s, e in zip(start, end)]) if len(start) else np.zeros(0, np.int64)
    left = np.repeat(end, end - start) - row - 1
    cuts = np.searchsorted(np.cumsum(left), np.arange(most, left.sum(), most))
    for part in np.split(np.arange(len(row)), cuts):
        n = left[part]
        if n.sum():
            i = np.repeat(row[part], n)
            yield i, i + 1 + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)


def pairs_across(left: np.ndarray, right: np.ndarray, most: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All pairs of a position of ``left`` and one of ``right``, about ``most`` at a time."""
    for part in np.array_split(left, max(1, len(left) * len(right) // most)):
        yield np.repeat(part, len(right)), np.tile(right, len(part))


def _meetings(rows: pd.DataFrame, first: int, second: int, most: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of positions of ``rows`` (sorted by bucket) that meet: in one bucket, or of two blocks of it."""
    if first == second:
        bucket = rows["bucket"].to_numpy()
        start = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]])
        return pairs_in_runs(start, np.r_[start[1:], len(bucket)], most)
    block = rows["block"].to_numpy()
    return pairs_across(np.flatnonzero(block == first), np.flatnonzero(block == second), most)


def _open_pairs(words: np.ndarray, pairs: Iterator, dim: int, band: int, bits: int, bands: int, threshold: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Those of ``pairs`` that may link by their codes and agree on no earlier band, to which they are left."""
    width = turn_of(dim).shape[1]
    most, masks = most_differing(width, threshold), band_masks(width, bits, bands)[:band]
    for i, j in pairs:
        differ = words[i] ^ words[j]
        near = np.bitwise_count(differ).sum(axis=1) <= most
        i, j, differ = i[near], j[near], differ[near]
        for mask in masks:
            fresh = (differ & mask).any(axis=1)
            if not fresh.all():
                i, j, differ = i[fresh], j[fresh], differ[fresh]
        if len(i):
            yield i, j


def _sorted(rows: pd.DataFrame) -> tuple[pd.DataFrame, np.ndarray]:
    rows = rows.sort_values(["bucket", "block", "rep"], kind="stable")
    return rows, np.frombuffer(b"".join(rows["code"]), np.uint64).reshape(len(rows), -1)


KEY = ("dim", "band", "part", "first", "second")
KEY_SCHEMA = ", ".join(f"{k} int" for k in KEY)


def candidates(key: tuple, rows: pd.DataFrame, bits: int, bands: int, threshold: float, most: int = 1 << 17) -> pd.DataFrame:
    """(KEY, bucket, block, rep) of the classes in a group of buckets, or pair of blocks, that may link there."""
    dim, band, _, first, second = (int(x) for x in key)
    rows, words = _sorted(rows)
    some = np.zeros(len(rows), bool)
    for i, j in _open_pairs(words, _meetings(rows, first, second, most), dim, band, bits, bands, threshold):
        some[i] = some[j] = True
    return rows.loc[some, [*KEY, "bucket", "block", "rep"]]


def compare_group(key: tuple, rows: pd.DataFrame, bits: int, bands: int, threshold: float, most: int = 1 << 17) -> pd.DataFrame:
    """Links found among the candidates of a group: (rep, links, root).

    ``links`` counts the vectors of linked classes found here, ``root`` is a class reachable by them.
    """
    dim, band, _, first, second = (int(x) for x in key)
    rows, words = _sorted(rows)
    x, unit = _unit(rows["embedding"])
    length = np.linalg.norm(x, axis=1)
    rotated, factor = unit @ turn_of(dim), rows["factor"].to_numpy()
    codes = signs_of(words, rotated.shape[1])
    rep, n = rows["rep"].to_numpy(), rows["n"].to_numpy()
    links, label = np.zeros(len(rep), np.int64), np.arange(len(rep))
    for i, j in _open_pairs(words, _meetings(rows, first, second, most), dim, band, bits, bands, threshold):
        near = may_link(codes[i], factor[i], rotated[j], threshold)
        i, j = i[near], j[near]
        hit = np.einsum("ij,ij->i", x[i], x[j]) / (length[i] * length[j]) >= threshold
        i, j = i[hit], j[hit]
        np.add.at(links, i, n[j])
        np.add.at(links, j, n[i])
        fold_links(label, i, j)
    out = links > 0
    return pd.DataFrame({"rep": rep[out], "links": links[out], "root": rep[label[out]]})


def near_duplicates(vectors: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for every row of ``vectors``.

    Null or zero vectors and those with null or non-finite components link with nothing, and so have
    no links and their own id as component. Rows that repeat a vec_id count as vectors of their own.
    Vectors of different lengths never link. A row without a vec_id links like any other, but names a component
    only if no row of it has an id (then null); it is kept only there.
    """
    # 128 bits stand for a vector where rows meet their class, so that vectors are shuffled once.
    keys = [F.when(usable(), F.xxhash64("embedding")).alias("k1"), F.when(usable(), F.xxhash64(F.lit(7), "embedding")).alias("k2")]
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding", *keys)
    classes = (
        rows.where("k1 is not null")
        .groupBy("k1", "k2")
        .agg(F.min("vec_id").alias("id"), F.count("*").alias("n"), F.any_value("embedding").alias("embedding"))
    )
    # Classes are numbered, since those of one least vec_id are still two.
    classes = durable(classes.withColumn("rep", F.monotonically_increasing_id()))
    n = classes.count()
    found = durable(_links_of(classes, n, *plan_bands(n, threshold), threshold))
    links = found.groupBy("rep").agg(F.sum("links").alias("links"))
    component = connected_components(found.select(F.col("rep").alias("src"), F.col("root").alias("dst")))
    named = classes.select("rep", "id", "n", "k1", "k2")
    linked = named.join(component, F.col("rep") == F.col("node")).select("node", "component", "id")
    least = linked.groupBy("component").agg(F.min("id").alias("least"))
    component = linked.join(least, "component").select("node", "least")
    known = (
        named.join(links.withColumnRenamed("rep", "l_rep"), F.col("rep") == F.col("l_rep"), "left")
        .join(component, F.col("rep") == F.col("node"), "left")
        .select(
            F.col("k1").alias("c1"),
            F.col("k2").alias("c2"),
            (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"),
            F.coalesce("least", "id").alias("component_id"),
        )
    )
    return rows.select("vec_id", "k1", "k2").join(known, (F.col("k1") == F.col("c1")) & (F.col("k2") == F.col("c2")), "left").select(
        "vec_id",
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        F.coalesce("component_id", "vec_id").alias("component_id"),
        F.coalesce("component_id", "vec_id").eqNullSafe(F.col("vec_id")).alias("kept"),
    )


def _links_of(classes: DataFrame, n: int, bits: int, bands: int, threshold: float) -> DataFrame:
    """(rep, links, root) found anywhere among ``n`` classes."""
    codes = durable(coded(classes.select("rep", "n", "embedding"), bits, bands))
    small = codes.select("rep", "code", F.size("embedding").alias("dim"), F.posexplode("buckets").alias("band", "bucket"))
    places = ("dim", "band", "bucket")
    crowded = (
        small.groupBy(*places).count().where(F.col("count") > BLOCK)
        .select(*[F.col(c).alias(f"c_{c}") for c in places], F.ceil(F.col("count") / BLOCK).cast("int").alias("blocks"))
    )
    shards = max(1, n // SHARD)
    alone = F.col("blocks") == 1
    blocked = (
        small.join(crowded, [F.col(c) == F.col(f"c_{c}") for c in places], "left")
        .withColumn("blocks", F.coalesce("blocks", F.lit(1)))
        .withColumn("block", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int"))
        .select("*", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("mate"))
        .select(
            "dim", "band",
            F.when(alone, F.pmod(F.xxhash64("bucket"), F.lit(shards)).cast("int")).otherwise(-1 - F.col("bucket")).alias("part"),
            F.least("block", "mate").alias("first"), F.greatest("block", "mate").alias("second"),
            "bucket", "block", "rep", "code",
        )
    )
    may = durable(
        blocked.groupBy(*KEY).applyInPandas(lambda key, rows: candidates(key, rows, bits, bands, threshold), f"{KEY_SCHEMA}, bucket int, block int, rep long")
    )
    held = may.join(codes.select(F.col("rep").alias("c_rep"), "n", "embedding", "code", "factor"), F.col("rep") == F.col("c_rep")).drop("c_rep")
    return held.groupBy(*KEY).applyInPandas(lambda key, rows: compare_group(key, rows, bits, bands, threshold), "rep long, links long, root long")


ORACLE = """
with recursive u as (select vec_id, cast(embedding as double[]) as e from embeddings
  where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
    and len(list_filter(embedding, lambda x: x <> 0)) > 0),
p as (select a.vec_id as a, b.vec_id as b from u a join u b
  on a.vec_id <> b.vec_id and len(a.e) = len(b.e) and list_cosine_similarity(a.e, b.e) >= 0.95),
r as (select vec_id as a, vec_id as b from embeddings union select r.a, p.b from r join p on r.b = p.a)
select vec_id, coalesce(n, 0) as n_links, c as component_id, vec_id = c as kept
from (select a as vec_id, min(b) as c from r group by a)
left join (select a, count(*) as n from p group by a) l on vec_id = l.a
"""
