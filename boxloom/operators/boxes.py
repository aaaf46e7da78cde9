"""Operators on detections: validation, overlap, suppression and tiles."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from boxloom.functions import geometry as g


def suppress(df: DataFrame, keys: list[str], order: list[str], threshold: float, most: int | None = None) -> DataFrame:
    """Greedy non-maximum suppression within ``keys``: (keys, rank, order, x1, y1, x2, y2) of the boxes kept.

    Boxes go by area ascending, then ``order``, then corners; one is kept unless its overlap with a kept box is above
    ``threshold``. ``most`` keeps the first so many. Rows are clustered by key and sorted, and a task walks them once:
    it holds one group's kept boxes, never the group, and compares a batch of boxes with them at a time.
    """
    box = ["x1", "y1", "x2", "y2"]
    area = ((F.col("x2") - F.col("x1")) * (F.col("y2") - F.col("y1"))).cast("long")
    rows = df.select(*keys, *order, *box, area.alias("_area"))
    types = {f.name: f.dataType.simpleString() for f in rows.schema}
    schema = ", ".join([*(f"`{k}` {types[k]}" for k in keys), "rank int", *(f"`{c}` {types[c]}" for c in [*order, *box])])

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last, held = None, np.zeros((0, 4))
        for b in batches:
            if not len(b):
                continue
            code = b.groupby(keys, dropna=False, sort=False).ngroup().to_numpy()
            starts = np.flatnonzero(np.r_[True, code[1:] != code[:-1]])
            corners = b[box].to_numpy(np.float64)
            keep, rank = np.zeros(len(b), bool), np.zeros(len(b), np.int32)
            names = list(b[keys].iloc[starts].itertuples(index=False, name=None))
            for start, end, name in zip(starts, [*starts[1:], len(b)], names):
                if not _same(name, last):
                    last, held = name, np.zeros((0, 4))
                for at in range(start, end, CHUNK):
                    part = corners[at : min(end, at + CHUNK)]
                    good = _kept(held, part, threshold) if most is None or len(held) < most else np.zeros(len(part), bool)
                    if most is not None:
                        good &= np.cumsum(good) + len(held) <= most
                    keep[at : at + len(part)] = good
                    rank[at : at + len(part)] = len(held) + np.cumsum(good)
                    held = np.concatenate([held, part[good]])
            out = b.assign(rank=rank)[keep]
            yield out[[*keys, "rank", *order, *box]]

    sort = [*keys, "_area", *order, *box]
    return rows.repartition(*keys).sortWithinPartitions(*sort).mapInPandas(walk, schema)


#: Boxes that are compared with each other at once.
CHUNK = 512


def _same(a: tuple, b: tuple | None) -> bool:
    """Whether two keys are one; nulls are alike."""
    return b is not None and all(x == y or (pd.isna(x) and pd.isna(y)) for x, y in zip(a, b))


def _over(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Intersection over union of every box of ``a`` with every one of ``b``; 0 where the union is empty."""
    low, high = np.maximum(a[:, None, :2], b[None, :, :2]), np.minimum(a[:, None, 2:], b[None, :, 2:])
    shared = np.clip(high - low, 0, None).prod(axis=2)
    union = (a[:, 2:] - a[:, :2]).prod(axis=1)[:, None] + (b[:, 2:] - b[:, :2]).prod(axis=1)[None] - shared
    return np.divide(shared, union, out=np.zeros_like(shared), where=union != 0)


def _kept(held: np.ndarray, boxes: np.ndarray, threshold: float) -> np.ndarray:
    """Which of ``boxes``, best first, stay beside the kept boxes ``held``."""
    good = np.ones(len(boxes), bool)
    for at in range(0, len(held), 4 * CHUNK):
        good &= ~(_over(held[at : at + 4 * CHUNK], boxes) > threshold).any(axis=0)
    near = _over(boxes, boxes) > threshold
    for i in np.flatnonzero(np.triu(near, 1).any(axis=1)):
        if good[i]:
            good[i + 1 :] &= ~near[i, i + 1 :]
    return good


#: Boxes of a group that a cell of its grid holds, about, where they are spread evenly.
CELL = 64


def overlapping_pairs(df: DataFrame, keys: list[str], ident: str, threshold: float) -> DataFrame:
    """(keys, a, b, iou) of boxes of one group, a < b, whose overlap is above ``threshold``, which is 0 or more.

    Each group has a grid of its own, of one cell where it is small; cells are no narrower than its boxes are on
    average, so that a box is in four of them or so. Boxes that touch meet in every cell they share and count in the one
    that holds the upper left corner of what they share. Work grows with the boxes that touch, not with a group's
    square. Null keys and corners pair with nothing.
    """
    side = {"x": F.col("x2") - F.col("x1"), "y": F.col("y2") - F.col("y1")}
    box = df.select(*keys, F.col(ident).alias("_id"), *[F.col(c).cast("double").alias(f"_{c}") for c in ("x1", "y1", "x2", "y2")], *["x1", "y1", "x2", "y2"])
    stats = [F.count("*").alias("_n")]
    for axis, length in side.items():
        stats += [F.min(f"_{axis}1").alias(f"_{axis}0"), (F.max(f"_{axis}2") - F.min(f"_{axis}1")).alias(f"_{axis}all"), F.avg(length).alias(f"_{axis}avg")]
    cells = F.greatest(F.lit(1.0), F.floor(F.sqrt(F.col("_n") / CELL)).cast("double"))
    grid = box.groupBy(*keys).agg(*stats)
    grid = grid.select(*keys, "_x0", "_y0", *[F.greatest(F.col(f"_{c}all") / cells, F.col(f"_{c}avg"), F.lit(1e-9)).alias(f"_{c}cell") for c in "xy"])
    cell = lambda at, axis: F.floor((at - F.col(f"_{axis}0")) / F.col(f"_{axis}cell"))
    held = box.join(grid, keys).where("_x2 >= _x1 and _y2 >= _y1")
    for axis in "xy":
        held = held.withColumn(f"_c{axis}", F.explode(F.sequence(cell(F.col(f"_{axis}1"), axis), cell(F.col(f"_{axis}2"), axis))))
    names = ("x1", "y1", "x2", "y2")
    left = held.select(*keys, "_cx", "_cy", *[f"_{axis}{k}" for axis in "xy" for k in ("0", "cell")], F.col("_id").alias("a"), *[F.col(c).alias(f"a_{c}") for c in names])
    right = held.select(*keys, "_cx", "_cy", F.col("_id").alias("b"), *[F.col(c).alias(f"b_{c}") for c in names])
    met = left.join(right, [*keys, "_cx", "_cy"]).where("a < b and a_x1 < b_x2 and b_x1 < a_x2 and a_y1 < b_y2 and b_y1 < a_y2")
    for axis in "xy":
        met = met.where(cell(F.greatest(f"a_{axis}1", f"b_{axis}1").cast("double"), axis) == F.col(f"_c{axis}"))
    return met.select(*keys, "a", "b", g.iou(g.corners("a_"), g.corners("b_")).alias("iou")).where(F.col("iou") > threshold)


def overlap_matrix(rows: DataFrame, cols: DataFrame, keys: list[str], row: str, col: str) -> DataFrame:
    """(keys, row, col, iou): every box of ``rows`` with every one of ``cols`` in the same group, a frame's tracks and detections say.

    The matrix is whole: boxes that don't touch have 0, and a group that lacks one side has no rows. It is as large as
    what it describes, so groups should be frames, not tables.
    """
    names = ("x1", "y1", "x2", "y2")
    left = rows.select(*keys, F.col(row), *[F.col(c).alias(f"a_{c}") for c in names])
    right = cols.select(*keys, F.col(col), *[F.col(c).alias(f"b_{c}") for c in names])
    return left.join(right, keys).select(*keys, row, col, g.iou(g.corners("a_"), g.corners("b_")).alias("iou"))


def tiles(images: DataFrame, size: int = 512, overlap: float = 0.2) -> DataFrame:
    """(image_id, tile_idx, tile_x, tile_y, tile_w, tile_h), row by row from the top; tile_idx from 0."""
    ys = g.tile_starts(F.col("h"), size, overlap)
    xs = g.tile_starts(F.col("w"), size, overlap)
    return (
        images.select("image_id", "w", "h", xs.alias("xs"), F.posexplode(ys).alias("row", "tile_y"))
        .select("image_id", "w", "h", "row", "tile_y", F.size("xs").alias("n"), F.posexplode("xs").alias("col", "tile_x"))
        .select(
            "image_id",
            (F.col("row") * F.col("n") + F.col("col")).alias("tile_idx"),
            "tile_x",
            "tile_y",
            F.least(F.lit(size), F.col("w") - F.col("tile_x")).alias("tile_w"),
            F.least(F.lit(size), F.col("h") - F.col("tile_y")).alias("tile_h"),
        )
    )


#: What is read of a detection, all at once.
ENTRY = "struct<label:variant,bbox_2d:variant>"


def validated(items: DataFrame, item: str, categories: list[str]) -> DataFrame:
    """``items`` with drop_reason (null if valid), label and x1..x2 of a detection in column ``item``, a VARIANT or an ``ENTRY``.

    Checks come in a fixed order: object, known label, box of four, numbers, then corners are sorted and
    clamped to 0-1000 and a side under 1 drops the box; what is left is cut to integers.
    """
    kept = [c for c in items.columns if c != item]
    entry = F.col(item) if isinstance(items.schema[item].dataType, StructType) else F.try_variant_get(item, "$", ENTRY)
    label, box = F.col("_entry.label"), F.col("_entry.bbox_2d")
    held = items.select(*kept, entry.alias("_entry"))
    held = held.select(*kept, F.col("_entry").isNotNull().alias("_object"), F.when(F.schema_of_variant(label) == "STRING", label.cast("string")).alias("_label"), box.alias("_box"))
    # Numbers are read as one array; only where one of them is none are they read one by one.
    each = F.transform(F.try_variant_get("_box", "$", "array<variant>"), lambda b: F.try_variant_get(b, "$", "double"))
    read = held.withColumn("_n", F.when(F.col("_label").isin(categories), F.coalesce(F.try_variant_get("_box", "$", "array<double>"), each)))
    side = {}
    for axis, i, j in (("x", 0, 2), ("y", 1, 3)):
        a, b = F.get("_n", i), F.get("_n", j)
        side[f"{axis}1"] = g.clamp(F.least(a, b), 0.0, 1000.0)
        side[f"{axis}2"] = g.clamp(F.greatest(a, b), 0.0, 1000.0)
    numbers = [F.get("_n", i).isNull() for i in range(4)]
    read = read.select(*kept, "_object", "_label", "_n", *[x.alias(f"_{k}") for k, x in side.items()])
    reason = (
        F.when(~F.col("_object"), "not an object")
        .when(F.col("_label").isNull() | ~F.col("_label").isin(categories), "unknown label")
        .when(F.col("_n").isNull() | (F.size("_n") != 4), "malformed box")
        .when(numbers[0] | numbers[1] | numbers[2] | numbers[3], "not numeric")
        .when((F.col("_x2") - F.col("_x1") < 1) | (F.col("_y2") - F.col("_y1") < 1), "degenerate")
    )
    out = read.withColumn("drop_reason", reason)
    return out.select(*kept, "drop_reason", F.col("_label").alias("label"), *[F.when(F.col("drop_reason").isNull(), F.col(f"_{k}").cast("int")).alias(k) for k in side])


def category_ids(names: DataFrame) -> DataFrame:
    """(name, id) from (pos, name): lower-cased, trimmed, blanks left out, the first of duplicates."""
    clean = names.select(F.lower(F.trim("name")).alias("name"), "pos").where("name <> ''")
    return clean.groupBy("name").agg(F.min("pos").alias("id"))
