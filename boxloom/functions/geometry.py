"""Box geometry as column expressions.

Coordinate systems are told by suffix: p1000 (0-1000 of the preprocessed image), t1000 (of a tile), o1000 (of
the original image), px (pixels) and yolo (0-1, centre form). No function clamps silently a null: a null
operand gives null, although ``greatest`` and ``least`` would skip it.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def clamp(x: Column, low: Column | float, high: Column | float) -> Column:
    """``x`` held within [low, high]; null stays null."""
    low, high = (v if isinstance(v, Column) else F.lit(v) for v in (low, high))
    return F.when(x.isNotNull(), F.greatest(low, F.least(high, x)))


def half_even(x: Column) -> Column:
    """``x`` rounded to an integer, halves to the even one."""
    return F.bround(x.cast("double")).cast("long")


def scaled(x: Column) -> Column:
    """``x`` as an integer within 0-1000, halves to even."""
    return clamp(half_even(x), 0, 1000).cast("int")


def outward(a: Column, b: Column) -> tuple[Column, Column]:
    """The lower of both rounded down and the higher rounded up, each within 0-1000."""
    low = F.floor(F.least(a, b)).cast("long")
    high = F.ceil(F.greatest(a, b)).cast("long")
    return clamp(low, 0, 1000).cast("int"), clamp(high, 0, 1000).cast("int")


def ordered(a: Column, b: Column) -> tuple[Column, Column]:
    """Both, the lower first, as integers within 0-1000 rounded half to even."""
    return scaled(F.least(a, b)), scaled(F.greatest(a, b))


def prep_to_original(v: Column, prep: Column, content: Column, pad: Column) -> Column:
    """One coordinate from p1000 to o1000, unrounded: the padding comes off, then the scale of the content."""
    return (v * prep / 1000 - pad) * 1000 / content


def original_to_prep(v: Column, prep: Column, content: Column, pad: Column) -> Column:
    """One coordinate from o1000 to p1000, unrounded."""
    return (v * content / 1000 + pad) * 1000 / prep


def tile_to_original(v: Column, start: Column, length: Column, whole: Column) -> Column:
    """One coordinate from t1000 to o1000, unrounded; ``start`` and ``length`` are the tile's in pixels."""
    return (start + v * length / 1000) * 1000 / whole


def tile_starts(length: Column, tile: int, overlap: float) -> Column:
    """Ascending starts of the tiles that cover an axis of ``length`` pixels.

    Tiles step by their size less the overlap; a last one is aligned to the far edge. A shorter axis has one
    tile that starts at 0.
    """
    step = int(round(tile * (1.0 - overlap)))
    step = step if step > 0 else tile
    regular = F.when(length < tile, F.array().cast("array<int>")).otherwise(F.sequence(F.lit(0), (length - tile).cast("int"), F.lit(step)))
    edge = F.array(F.greatest(F.lit(0), length - tile).cast("int"))
    return F.array_sort(F.array_distinct(F.concat(regular, edge)))


def overlap_area(a: dict, b: dict) -> Column:
    """Area common to two boxes given as dicts of x1, y1, x2, y2."""
    wide = F.greatest(F.lit(0), F.least(a["x2"], b["x2"]) - F.greatest(a["x1"], b["x1"]))
    high = F.greatest(F.lit(0), F.least(a["y2"], b["y2"]) - F.greatest(a["y1"], b["y1"]))
    return wide * high


def area(b: dict) -> Column:
    return (b["x2"] - b["x1"]) * (b["y2"] - b["y1"])


def iou(a: dict, b: dict) -> Column:
    """Intersection over union; 0 where the union is empty."""
    inter = overlap_area(a, b)
    union = area(a) + area(b) - inter
    return F.coalesce(inter / F.nullif(union, F.lit(0)), F.lit(0.0)).cast("double")


def corners(prefix: str = "", suffix: str = "") -> dict:
    """x1, y1, x2, y2 by column name."""
    return {k: F.col(f"{prefix}{k}{suffix}") for k in ("x1", "y1", "x2", "y2")}


def yolo_to_pixels(c: Column, size: Column, length: Column) -> tuple[Column, Column]:
    """The ends of a centre-form extent, in pixels, half-even and within the image."""
    ends = ((c - size / 2) * length, (c + size / 2) * length)
    return tuple(clamp(half_even(e), 0, length).cast("int") for e in ends)


def to_yolo(a: Column, b: Column, length: Column | float) -> tuple[Column, Column]:
    """Centre and size, within 0-1, of the extent from ``a`` to ``b`` on an axis of ``length``."""
    return clamp((a + b) / 2.0 / length, 0.0, 1.0), clamp((b - a) / length, 0.0, 1.0)


def upscaled(w: Column, h: Column, short_edge: int) -> tuple[Column, Column]:
    """Size after the shorter edge is brought up to ``short_edge``; larger images keep theirs."""
    short = F.least(w, h)
    factor = F.lit(short_edge) / short
    return tuple(F.when(short < short_edge, half_even(v * factor)).otherwise(v).cast("int") for v in (w, h))


def letterbox(w: Column, h: Column, to_w: int, to_h: int) -> dict[str, Column]:
    """Scale, content size and padding that fit an image into ``to_w`` x ``to_h`` with its aspect kept."""
    scale = F.least(F.lit(to_w) / w, F.lit(to_h) / h)
    cw, ch = (F.greatest(F.lit(1), half_even(v * scale)).cast("int") for v in (w, h))
    return {
        "scale": scale,
        "content_w": cw,
        "content_h": ch,
        "pad_left": F.floor((F.lit(to_w) - cw) / 2).cast("int"),
        "pad_top": F.floor((F.lit(to_h) - ch) / 2).cast("int"),
    }


def crop_by_box(a: Column, b: Column, length: Column, ratio: float) -> tuple[Column, Column]:
    """Ends of a crop around o1000 extent ``a``-``b`` in pixels, padded by its own size times ``ratio``."""
    low, high = a * length / 1000, b * length / 1000
    pad = (high - low) * ratio
    return F.greatest(F.lit(0), (low - pad).cast("int")), F.least(length, (high + pad).cast("int"))


def crop_by_edge(b: dict, w: Column, h: Column, percent: float) -> dict[str, Column]:
    """A pixel region padded by ``percent`` of the longer image edge; the region itself if that inverts it."""
    pad = (F.greatest(w, h) * (percent / 100.0)).cast("int")
    out = {
        "x1": F.greatest(F.lit(0), b["x1"] - pad),
        "y1": F.greatest(F.lit(0), b["y1"] - pad),
        "x2": F.least(w, b["x2"] + pad),
        "y2": F.least(h, b["y2"] + pad),
    }
    bad = (out["x2"] <= out["x1"]) | (out["y2"] <= out["y1"])
    return {k: F.when(bad, b[k]).otherwise(v) for k, v in out.items()}


def gamma(level: Column, value: float) -> Column:
    """A grey level 0-255 after gamma correction, cut to an integer."""
    return (F.pow(level / 255.0, F.lit(1.0 / value)) * 255).cast("int")
