"""Pixel operators over tables of image files; each task decodes, computes and drops its own images, one at a time."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from boxloom.config import Settings
from boxloom.functions import imagefile
from boxloom.functions import pixels as px


def read_binary(spark, path: str, pattern: str = "*.{jpg,jpeg,png}") -> DataFrame:
    """(path, length, content) of image files, from any store Spark can read; it passes over files of no bytes."""
    return spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(path).select("path", "length", "content")


def _mapped(images: DataFrame, key: str, each: Callable[[np.ndarray], list[tuple]], columns: str) -> DataFrame:
    """(key, columns): the rows that ``each`` makes of every image of ``images`` (key, content) that can be read, upright."""
    kind = images.schema[key].dataType.simpleString()
    names = [key, *[c.split()[0] for c in columns.split(", ")]]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for ident, content in zip(b[key], b["content"]):
                _, img, turned = imagefile.decode(content)
                if img is not None:
                    rows += [(ident, *row) for row in each(px.oriented(img, turned))]
            yield pd.DataFrame(rows, columns=names)

    return images.select(key, "content").mapInPandas(run, f"`{key}` {kind}, {columns}")


def inspected(images: DataFrame, key: str = "image_id") -> DataFrame:
    """(key, status, w, h, orientation, mean_r, mean_g, mean_b) of every file of ``images`` (key, content).

    ``status`` is ok, unreadable for a file that is cut, damaged, empty or null, or unsupported for a format that is not
    decoded. ``w`` and ``h`` are of the upright image; they and the means are null without one.
    """
    kind = images.schema[key].dataType.simpleString()
    columns = ["status", "w", "h", "orientation", "mean_r", "mean_g", "mean_b"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for content in b["content"]:
                status, img, turned = imagefile.decode(content)
                size = (None, None) if img is None else px.oriented(img, turned).shape[1::-1]
                means = (None,) * 3 if img is None else px.channel_means(img)
                rows.append((status, *size, turned, *means))
            out = pd.DataFrame(rows, columns=columns, dtype=object)
            out.insert(0, key, b[key].to_numpy())
            yield out

    return images.select(key, "content").mapInPandas(run, f"`{key}` {kind}, status string, w int, h int, orientation int, mean_r double, mean_g double, mean_b double")


def metrics(images: DataFrame, key: str = "image_id") -> DataFrame:
    """(key, laplacian_var, edge_density, texture_spread) of images that can be read."""
    each = lambda img: [(px.blur_score(img), px.edge_ratio(img), px.texture(img))]
    return _mapped(images, key, each, "laplacian_var double, edge_density double, texture_spread double")


def condition(img: np.ndarray, settings: Settings) -> np.ndarray:
    """An upright image as a model gets it: white balance, contrast, gamma, denoising, sharpening, size."""
    prep = settings.preprocessing()
    if prep["white_balance"]:
        img = px.white_balance(img)
    if prep["contrast_method"] == "clahe":
        img = px.equalise_lightness(img)
    elif prep["contrast_method"] == "autocontrast":
        img = px.stretch(img)
    if prep["gamma"] != 1.0:
        img = px.gamma(img, prep["gamma"])
    if prep["denoise_method"] == "bilateral":
        img = px.bilateral(img)
    elif prep["denoise_method"] == "nlm":
        img = px.denoised(img)
    if prep["sharpen"]:
        img = np.stack([px.unsharp(img[..., k]) for k in range(3)], -1)
    return px.fitted(img, prep["short_edge"], prep["pad_square"]) if prep["resolution"] else img


def conditioned(images: DataFrame, settings: Settings, box: tuple[int, int] | None = None, key: str = "image_id") -> DataFrame:
    """(key, w, h, mean_r, mean_g, mean_b) of images that can be read after ``condition``, and in a letterbox of ``box`` if given."""

    def each(img: np.ndarray) -> list[tuple]:
        out = condition(img, settings)
        out = out if box is None else px.letterbox(out, *box)
        return [(out.shape[1], out.shape[0], *px.channel_means(out))]

    return _mapped(images, key, each, "w int, h int, mean_r double, mean_g double, mean_b double")


def proposals(images: DataFrame, least: float = 0.0005, most: float = 0.3, key: str = "image_id") -> DataFrame:
    """(key, proposal_id, x1, y1, x2, y2): regions of images on the 0-1000 scale, at most 30 of an image."""
    from boxloom.operators.boxes import suppress

    def each(img: np.ndarray) -> list[tuple]:
        h, w = img.shape[:2]
        found = enumerate(px.regions(px.som_mask(img)).tolist())
        return [
            (k, *(round(v * 1000 / s) for v, s in ((x1, w), (y1, h), (x2, w), (y2, h))))
            for k, (x1, y1, x2, y2) in found if least * w * h < (x2 - x1) * (y2 - y1) < most * w * h
        ]

    found = _mapped(images, key, each, "ord int, x1 int, y1 int, x2 int, y2 int")
    return suppress(found, [key], ["ord"], 0.4, most=30).select(key, F.col("rank").alias("proposal_id"), "x1", "y1", "x2", "y2")


#: A drawn pixel is more opaque than this.
OPAQUE = 10


def drawn_regions(marks: DataFrame, key: str = "image_id") -> DataFrame:
    """(key, region, x1, y1, x2, y2): the 8-connected parts of each image's drawn pixels, ``marks`` (key, x, y, alpha).

    Pixels are joined to runs by Spark; runs are clustered by image and sorted, and a task joins those of all images of a
    batch at once. Regions are numbered from 1 by their first pixel, row by row. Pixels that repeat count once, if one of
    them is opaque; null places count for nothing.
    """
    kind = marks.schema[key].dataType.simpleString()
    pixels = marks.where((F.col("alpha") > OPAQUE) & F.col("x").isNotNull() & F.col("y").isNotNull()).select(key, "x", "y").repartition(key, "y").distinct()
    place = F.col("x") - F.row_number().over(Window.partitionBy(key, "y").orderBy("x"))
    runs = pixels.withColumn("_run", place).groupBy(key, "y", "_run").agg(F.min("x").alias("start"), (F.max("x") + 1).alias("end"))

    def regions(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
        rows = pa.Table.from_batches(parts)
        ys, starts, ends = (rows[c].to_numpy().astype(np.int64) for c in ("y", "start", "end"))
        images = np.append(0, _changes(rows[key].combine_chunks()).cumsum())
        # Rows of one image after those of another, with one between that is empty.
        steps = np.where(np.diff(images) > 0, 2, np.minimum(np.diff(ys), 2))
        heads, boxes = px.boxes_of(px.joined_runs(np.append(0, steps.cumsum()), starts, ends), ys, starts, ends)
        own = images[heads]
        number = np.arange(len(heads)) - np.searchsorted(own, own) + 1
        columns = [rows[key].combine_chunks().take(pa.array(heads)), *[pa.array(v.astype(np.int32)) for v in (number, *boxes.T)]]
        return pa.RecordBatch.from_arrays(columns, [key, "region", "x1", "y1", "x2", "y2"])

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []  # of the last image, which may go on in the next batch
        for b in batches:
            if not b.num_rows:
                continue
            cuts = np.flatnonzero(_changes(b.column(key))) + 1
            if len(cuts):
                done, held = [*held, b.slice(0, cuts[-1])], [b.slice(cuts[-1])]
            elif held and _changes(pa.concat_arrays([held[-1].column(key).slice(0, 1), b.column(key).slice(0, 1)]))[0]:
                done, held = held, [b]
            else:
                held.append(b)
                continue
            yield regions(done)
        if held:
            yield regions(held)

    sorted_runs = runs.select(key, "y", "start", "end").repartition(key).sortWithinPartitions(key, "y", "start")
    return sorted_runs.mapInArrow(join, f"`{key}` {kind}, region int, x1 int, y1 int, x2 int, y2 int")


def _changes(keys: pa.Array) -> np.ndarray:
    """Whether each of ``keys`` but the first differs from the one before; nulls are alike."""
    codes = keys.dictionary_encode("encode").indices.to_numpy(zero_copy_only=False)
    return codes[1:] != codes[:-1]
