"""Image files, pixel kernels and the operators over them, against plain versions."""

from __future__ import annotations

import random
import struct
import zlib

import numpy as np
import pytest

from boxloom.config import layered
from boxloom.functions import imagefile as f
from boxloom.functions import pixels as px
from boxloom.operators import images as ops
from boxloom.plans import tracking_queries as q
from tests.oracle import SF_DIR


def noise(seed, *shape):
    return np.random.default_rng(seed).integers(0, 256, shape, dtype=np.uint8)


def png(w, h, depth, colour, lines, palette=None, laced=0):
    parts = [(b"IHDR", struct.pack(">IIBBBBB", w, h, depth, colour, 0, 0, laced))] + ([(b"PLTE", palette)] if palette else [])
    parts += [(b"IDAT", zlib.compress(b"".join(b"\0" + line for line in lines))), (b"IEND", b"")]
    return b"\x89PNG\r\n\x1a\n" + b"".join(struct.pack(">I", len(d)) + k + d + struct.pack(">I", zlib.crc32(k + d)) for k, d in parts)


@pytest.mark.parametrize("channels", [1, 2, 3, 4])
def test_all_filters_and_channels(channels):
    img = noise(channels, 19, 23, channels)
    want = np.repeat(img[..., :1], 3, 2) if channels < 3 else img[..., :3]
    for filters in (0, 1, 2, 3, 4, [k % 5 for k in range(19)]):
        status, got, turned = f.decode(f.encode_png(img, filters))
        assert (status, turned) == ("ok", 1) and (got == want).all()


def test_other_depths_and_palettes():
    assert f.decode(png(3, 2, 16, 0, [bytes([1, 9, 2, 9, 3, 9])] * 2))[1][..., 0].tolist() == [[1, 2, 3]] * 2
    assert f.decode(png(9, 1, 1, 0, [bytes([0b10100000, 0b10000000])]))[1][0, :, 1].tolist() == [255, 0, 255, 0, 0, 0, 0, 0, 255]
    assert f.decode(png(3, 1, 2, 0, [bytes([0b00011011])]))[1][0, :, 2].tolist() == [0, 85, 170]
    palette = bytes([1, 2, 3, 4, 5, 6])
    assert f.decode(png(3, 1, 4, 3, [bytes([0x01, 0x00])], palette))[1].tolist() == [[[1, 2, 3], [4, 5, 6], [1, 2, 3]]]
    assert f.decode(png(3, 1, 8, 3, [bytes([0, 1, 2])], palette))[0] == "unreadable"
    assert f.decode(png(3, 1, 8, 0, [bytes(3)], laced=1))[0] == "unsupported"
    assert f.decode(png(3, 1, 3, 0, [bytes(3)]))[0] == "unreadable" and f.decode(png(0, 1, 8, 0, [b""]))[0] == "unreadable"


def test_pixmaps():
    assert f.decode(b"P6\n# note\n2 1\n255\n" + bytes(range(6)))[1].tolist() == [[[0, 1, 2], [3, 4, 5]]]
    assert f.decode(b"P5 2 2 127 " + bytes([0, 127, 64, 1]))[1][..., 0].tolist() == [[0, 255], [129, 2]]
    for bad in (b"P6\n2 1\n255\n" + bytes(5), b"P6\n", b"P6 2", b"P5 0 0 255 ", b"P6 x 1 255 abc"):
        assert f.decode(bad) == ("unreadable", None, 1), bad
    assert f.decode(b"P5 1 1 65535 ab")[0] == "unsupported"


def test_cut_and_damaged_files_are_unreadable():
    whole = f.encode_png(noise(1, 30, 30, 3), 4, 6)
    for cut in range(len(whole)):
        assert f.decode(whole[:cut])[0] == "unreadable"
    rng = random.Random(2)
    for _ in range(200):
        at = rng.randrange(len(whole))
        broken = whole[:at] + bytes([whole[at] ^ (1 << rng.randrange(8))]) + whole[at + 1 :]
        assert f.decode(broken)[0] == "unreadable"
    assert f.decode(None) == f.decode(b"") == f.decode(b"text") == ("unreadable", None, 1)


def test_orientation_of_files():
    img = noise(3, 4, 5, 3)
    places = {
        1: lambda y, x: (y, x), 2: lambda y, x: (y, 4 - x), 3: lambda y, x: (3 - y, 4 - x), 4: lambda y, x: (3 - y, x),
        5: lambda y, x: (x, y), 6: lambda y, x: (x, 3 - y), 7: lambda y, x: (4 - x, 3 - y), 8: lambda y, x: (4 - x, y),
    }
    for k, to in places.items():
        status, got, turned = f.decode(f.encode_png(img, 1, k))
        up = px.oriented(got, turned)
        assert turned == k and up.shape[:2] == ((4, 5) if k < 5 else (5, 4))
        assert all((up[to(y, x)] == img[y, x]).all() for y in range(4) for x in range(5))
    exif = b"II*\0" + struct.pack("<IHHHIHHI", 8, 1, 0x0112, 3, 1, 8, 0, 0)
    jpeg = b"\xff\xd8\xff\xe0" + struct.pack(">H", 4) + b"xx" + b"\xff\xe1" + struct.pack(">H", 8 + len(exif)) + b"Exif\0\0" + exif + b"\xff\xda"
    assert f.decode(jpeg) == ("unsupported", None, 8)
    for bad in (b"", b"II", b"MM\0*\0\0", exif[:14], exif.replace(b"\x08\0\0\0\0\0", b"\x09\0\0\0\0\0")):
        assert f.exif_orientation(bad) == 1


def plain_lanczos(img, w, h):
    def line(v, n):
        out, scale = [], max(1.0, len(v) / n)
        for k in range(n):
            centre, total, norm = (k + 0.5) * len(v) / n, 0.0, 0.0
            for i, value in enumerate(v):
                x = (i + 0.5 - centre) / scale
                if abs(x) < 3:
                    a = 1.0 if x == 0 else 3 * np.sin(np.pi * x) * np.sin(np.pi * x / 3) / (np.pi * x) ** 2
                    total, norm = total + a * value, norm + a
            out.append(min(255, max(0, round(total / norm))))
        return out

    for c in range(3):
        rows = [line(row, w) for row in img[..., c].tolist()]
        yield np.array([line(col, h) for col in np.array(rows).T.tolist()]).T


@pytest.mark.parametrize("size", [(40, 30), (7, 5), (13, 64), (20, 16), (1, 1)])
def test_sinc_resampling_against_a_double_loop(size):
    img = noise(4, 16, 20, 3)
    got = px.lanczos(img, *size)
    assert got.shape == (size[1], size[0], 3)
    assert all(np.abs(got[..., c].astype(int) - want).max() <= 1 for c, want in enumerate(plain_lanczos(img, *size)))
    assert (px.lanczos(np.full((9, 9, 3), 77, np.uint8), *size) == 77).all()


def plain_means(img, strength, patch, search):
    near, far = patch // 2, search // 2
    full = np.pad(img.astype(float), ((near + far,) * 2, (near + far,) * 2, (0, 0)), mode="reflect")
    views = np.lib.stride_tricks.sliding_window_view(full, (patch, patch), (0, 1))
    out = np.zeros(img.shape)
    for y in range(img.shape[0]):
        for x in range(img.shape[1]):
            around = views[y : y + search, x : x + search]
            d = ((around - views[y + far, x + far]) ** 2).mean((-1, -2, -3))
            weight = np.exp(-d / strength**2)
            out[y, x] = (weight[..., None] * around[..., near, near]).sum((0, 1)) / weight.sum()
    return np.clip(np.round(out), 0, 255)


@pytest.mark.parametrize("channels", [1, 2])
def test_non_local_means_against_patches(channels):
    y, x = np.mgrid[:64, :64]
    img = np.clip((x // 16 * 40 + y // 16 * 20)[..., None] + np.random.default_rng(5).normal(0, 4, (64, 64, channels)), 0, 255).astype(np.uint8)
    got = px.non_local_means(img, 6.0)
    want = plain_means(img, 6.0, 7, 21)
    assert np.abs(got - want).max() <= 1 and (got == want).mean() > 0.99
    flat = img[:16, :16, 0].astype(int)
    assert got[:16, :16, 0].astype(int).std() < 0.6 * flat.std()
    assert px.non_local_means(noise(6, 3, 70)).shape == (3, 70, 1) and px.non_local_means(noise(6, 1, 1, 3)).shape == (1, 1, 3)


def test_lightness_is_equalised_and_colours_stay():
    assert px.to_lab(np.array([[[255, 255, 255], [0, 0, 0], [255, 0, 0], [0, 255, 0], [0, 0, 255]]], np.uint8)).tolist() == [[[255, 128, 128], [0, 128, 128], [136, 208, 195], [224, 42, 211], [82, 207, 20]]]
    img = noise(7, 64, 64, 3) // 4 + 90
    assert np.abs(px.from_lab(px.to_lab(img)).astype(int) - img).max() <= 6
    out = px.equalise_lightness(img)
    before, after = px.to_lab(img), px.to_lab(out)
    assert after[..., 0].std() > 1.3 * before[..., 0].std() and np.abs(after[..., 1:].astype(int) - before[..., 1:]).mean() < 3
    grey = np.repeat(noise(8, 40, 40, 1), 3, 2)
    assert np.ptp(px.equalise_lightness(grey).astype(int), axis=2).max() <= 1
    assert px.gamma(np.arange(256, dtype=np.uint8), 2.0).tolist() == [int((i / 255) ** 0.5 * 255) for i in range(256)]


def flood(mask):
    left, out = {(y, x) for y, x in zip(*np.nonzero(mask))}, []
    for start in sorted(left):
        if start in left:
            part, stack = set(), [start]
            left.discard(start)
            while stack:
                y, x = stack.pop()
                part.add((y, x))
                for p in [(y + a, x + b) for a in (-1, 0, 1) for b in (-1, 0, 1)]:
                    if p in left:
                        left.discard(p)
                        stack.append(p)
            ys, xs = zip(*part)
            out.append([min(xs), min(ys), max(xs) + 1, max(ys) + 1])
    return out


def test_regions_against_flood_filling(spark):
    rng = np.random.default_rng(9)
    masks = [rng.random((rng.integers(1, 30), rng.integers(1, 30))) < share for share in (0, 0.1, 0.3, 0.45, 0.6, 1) for _ in range(8)]
    spiral = np.zeros((41, 41), bool)
    for k in range(0, 20, 2):
        spiral[k, k : 41 - k] = spiral[k : 41 - k, 40 - k] = spiral[40 - k, k : 41 - k] = spiral[k + 2 : 41 - k, k] = True
    masks.append(spiral)
    for mask in masks:
        assert px.regions(mask).tolist() == flood(mask)
    rows = [(k, int(x), int(y), int(a)) for k, m in enumerate(masks) for y, x in zip(*np.nonzero(m)) for a in ([200, 5] if (x + y) % 3 else [11])]
    rows += [(0, 3, 3, 10), (500, None, 1, 99), (501, 1, 1, None), (502, -4, -7, 99), (502, -4, -7, 99), (None, 2, 2, 99)]
    got = {}
    for r in ops.drawn_regions(spark.createDataFrame(rows, "image_id long, x int, y int, alpha int")).orderBy("image_id", "region").collect():
        got.setdefault(r.image_id, []).append([r.x1, r.y1, r.x2, r.y2])
    assert got == {k: flood(m) for k, m in enumerate(masks) if m.any()} | {502: [[-4, -7, -3, -6]], None: [[2, 2, 3, 3]]}


def test_files_on_disk_have_a_status(spark, tmp_path):
    img = noise(10, 6, 9, 3)
    for name, content in {"a.png": f.encode_png(img, 4, 6), "b.png": f.encode_png(img)[:60], "c.jpg": b"\xff\xd8\xff\xda", "d.png": b"no image", "e.txt": b"x"}.items():
        (tmp_path / name).write_bytes(content)
    got = {r.path.rsplit("/", 1)[1]: (r.status, r.w, r.h, r.orientation, r.mean_g) for r in ops.inspected(ops.read_binary(spark, str(tmp_path)), "path").collect()}
    assert got == {"a.png": ("ok", 6, 9, 6, img[..., 1].mean()), "b.png": ("unreadable", None, None, 1, None), "c.jpg": ("unsupported", None, None, 1, None), "d.png": ("unreadable", None, None, 1, None)}
    empty = spark.createDataFrame([], "image_id long, content binary")
    assert ops.inspected(empty).collect() == ops.metrics(empty).collect() == ops.proposals(empty).collect() == []
    assert ops.inspected(spark.createDataFrame([(1, None)], "image_id long, content binary")).first().status == "unreadable"


def test_preprocessing_that_is_off_changes_no_pixel():
    img = noise(11, 8, 8, 3)
    assert (ops.condition(img, layered({"prep_contrast_method": "clahe", "prep_gamma": 2.0, "prep_denoise_method": "nlm"})) == img).all()
    off = layered({"prep_grid_step": 50, "prep_send_pixel_bounds": True, "prep_gamma": 2.0}).preprocessing()
    assert (off["resolution"], off["grid_step"], off["send_pixel_bounds"], off["gamma"]) == (False, 50, True, 1.0)
    on = layered({"prep_enabled": True, "prep_gamma": 2.0, "prep_tile_size": 99}).preprocessing()
    assert (on["resolution"], on["gamma"], on["tile_size"]) == (True, 2.0, 99) and on.keys() == off.keys()
    out = ops.condition(img, layered({"prep_enabled": True, "prep_short_edge": 20, "prep_pad_square": True}))
    assert out.shape == (20, 20, 3)
    assert px.fitted(noise(1, 10, 30, 3), 5, True).shape == (30, 30, 3) and (px.fitted(noise(1, 10, 30, 3), 5, True)[0] == 128).all()


@pytest.fixture(scope="module")
def upright(spark):
    """The pictures that can be read, upright, from the texts themselves."""
    out = {}
    for r in spark.read.parquet(f"{SF_DIR}/documents.parquet").collect():
        raw = (r.text or "").encode()
        h = max(1, -(-len(raw) // 96))
        img = np.frombuffer(raw.ljust(h * 96, b"\0"), np.uint8).reshape(h, 32, 3)
        if r.doc_id % 11:
            out[r.doc_id] = px.oriented(img, 1 + r.doc_id % 8)
    return out


def test_picture_queries_against_plain_versions(spark, upright):
    got = {r.image_id: (r.laplacian_var, r.edge_density, r.texture_spread) for r in q.frame_metrics(spark, SF_DIR).collect()}
    assert got == {k: (px.blur_score(i), px.edge_ratio(i), px.texture(i)) for k, i in upright.items()}
    for query, settings, box in ((q.conditioned, q.CONDITIONED, (64, 64)), (q.denoised, q.DENOISED, None)):
        want = {}
        for k, i in upright.items():
            if settings.get("prep_white_balance"):
                i = px.white_balance(i)
            i = px.equalise_lightness(i) if settings["prep_contrast_method"] == "clahe" else px.stretch(i)
            i = px.gamma(i, settings.get("prep_gamma", 1.0)) if "prep_gamma" in settings else i
            i = px.denoised(i) if settings["prep_denoise_method"] == "nlm" else np.stack([px.bilateral(i[..., c]) for c in range(3)], -1)
            i = np.stack([px.unsharp(i[..., c]) for c in range(3)], -1) if settings.get("prep_sharpen") else i
            i = px.fitted(i, settings["prep_short_edge"], settings.get("prep_pad_square", False))
            i = px.letterbox(i, *box) if box else i
            want[k] = (i.shape[1], i.shape[0], *i.reshape(-1, 3).mean(0).tolist())
        got = {r.image_id: (r.w, r.h, r.mean_r, r.mean_g, r.mean_b) for r in query(spark, SF_DIR).collect()}
        # Sums in floating point differ in their last digits from machine to machine, and so may a rounded pixel.
        assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k], abs=0.01) for k in want)
    found = {}
    for r in q.region_proposals(spark, SF_DIR).collect():
        found.setdefault(r.image_id, set()).add((r.x1, r.y1, r.x2, r.y2))
    assert found and all(len(v) <= 30 and k in upright for k, v in found.items())
    for k, boxes in found.items():
        h, w = upright[k].shape[:2]
        all_ = {tuple(round(v * 1000 / s) for v, s in ((a, w), (b, h), (c, w), (d, h))) for a, b, c, d in flood(px.som_mask(upright[k])) if 0.0005 * w * h < (c - a) * (d - b) < 0.3 * w * h}
        assert boxes <= all_
    assert found.keys() == {k for k, i in upright.items() if any(0.0005 * i.shape[0] * i.shape[1] < (c - a) * (d - b) < 0.3 * i.shape[0] * i.shape[1] for a, b, c, d in flood(px.som_mask(i)))}
