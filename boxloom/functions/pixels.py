"""Pixel kernels on height x width (x 3) uint8 arrays, in numpy."""

from __future__ import annotations

from functools import lru_cache

import numpy as np


def grey(img: np.ndarray) -> np.ndarray:
    return img[..., :3].astype(float) @ np.array([0.299, 0.587, 0.114])


def white_balance(img: np.ndarray) -> np.ndarray:
    """Channels scaled to one mean; an image with an empty channel stays."""
    mean = img.reshape(-1, 3).mean(axis=0)
    if not (mean > 0).all():
        return img
    return np.clip(img * (mean.mean() / mean), 0, 255).astype(np.uint8)


def stretch(img: np.ndarray) -> np.ndarray:
    """Every channel spread over 0-255."""
    low, high = img.min(axis=(0, 1)).astype(float), img.max(axis=(0, 1)).astype(float)
    span = np.where(high > low, high - low, 1)
    return np.where(high > low, np.clip(np.round((img - low) * 255 / span), 0, 255), img).astype(np.uint8)


def equalise(plane: np.ndarray, clip: float = 2.0, grid: int = 8) -> np.ndarray:
    """Contrast-limited histogram equalisation of a plane by tiles, blended between their centres."""
    h, w = plane.shape
    th, tw = -(-h // grid), -(-w // grid)
    full = np.pad(plane, ((0, th * grid - h), (0, tw * grid - w)), mode="reflect" if min(h, w) > max(th * grid - h, tw * grid - w) else "edge")
    tiles = full.reshape(grid, th, grid, tw).swapaxes(1, 2).reshape(grid * grid, -1)
    of = np.arange(grid * grid)[:, None] * 256
    hist = np.bincount((tiles + of).reshape(-1), minlength=grid * grid * 256).reshape(-1, 256).astype(float)
    top = max(1.0, clip * th * tw / 256)
    over = np.clip(hist - top, 0, None).sum(axis=1, keepdims=True)
    table = (np.minimum(hist, top) + over / 256).cumsum(axis=1) * 255 / (th * tw)
    table = table.reshape(grid, grid, 256)
    ys, xs = (np.arange(h) + 0.5) / th - 0.5, (np.arange(w) + 0.5) / tw - 0.5
    y0, x0 = np.floor(ys).astype(int), np.floor(xs).astype(int)
    fy, fx = (ys - y0)[:, None], (xs - x0)[None]
    at = lambda v: np.clip(v, 0, grid - 1)
    look = lambda a, b: table[at(a)[:, None], at(b)[None], plane]
    out = (look(y0, x0) * (1 - fx) + look(y0, x0 + 1) * fx) * (1 - fy) + (look(y0 + 1, x0) * (1 - fx) + look(y0 + 1, x0 + 1) * fx) * fy
    return np.clip(np.round(out), 0, 255).astype(np.uint8)


def windows(plane: np.ndarray, size: int) -> np.ndarray:
    """All size x size neighbourhoods, edges reflected."""
    return np.lib.stride_tricks.sliding_window_view(padded(plane, size // 2), (size, size))


def padded(plane: np.ndarray, r: int) -> np.ndarray:
    """``plane`` with ``r`` more pixels on every side, reflected; its edge repeated if it is too small."""
    return np.pad(plane, r, mode="reflect" if min(plane.shape) > r else "edge")


def bilateral(img: np.ndarray, size: int = 9, colour: float = 75, space: float = 75) -> np.ndarray:
    """Smoothing that keeps edges, of a plane or of each channel of an image."""
    r = size // 2
    planes = img[None] if img.ndim == 2 else img.transpose(2, 0, 1)
    full = np.stack([padded(p, r) for p in planes]).astype(np.intp)
    h, w = planes.shape[1:]
    # Places in a table of all differences between two bytes, from -255: their weights, and the weighted differences as imaginary parts.
    own = full[:, r : r + h, r : r + w] - 255
    apart = np.arange(-255, 256)
    table = np.exp(-(apart**2) / (2 * colour**2)) * (1 + 1j * apart)
    total = np.zeros(own.shape, complex)
    for dy in range(-r, r + 1):
        for dx in range(-r, r + 1):
            if dy**2 + dx**2 <= r**2:
                at = full[:, r + dy : r + dy + h, r + dx : r + dx + w] - own
                total += np.take(table * np.exp(-(dy**2 + dx**2) / (2 * space**2)), at, mode="clip")
    out = np.round(own + 255 + total.imag / total.real).astype(np.uint8)
    return out[0] if img.ndim == 2 else out.transpose(1, 2, 0)


def unsharp(plane: np.ndarray, percent: float = 150, least: int = 3) -> np.ndarray:
    soft = box_sums(padded(plane.astype(np.int32), 2), 5) / 25
    diff = plane - soft
    return np.clip(np.where(np.abs(diff) >= least, plane + diff * percent / 100, plane), 0, 255).astype(np.uint8)


def resize(img: np.ndarray, w: int, h: int) -> np.ndarray:
    """Bilinear resampling."""
    ys, xs = (np.arange(h) + 0.5) * img.shape[0] / h - 0.5, (np.arange(w) + 0.5) * img.shape[1] / w - 0.5
    ys, xs = np.clip(ys, 0, img.shape[0] - 1), np.clip(xs, 0, img.shape[1] - 1)
    y0, x0 = np.floor(ys).astype(int), np.floor(xs).astype(int)
    y1, x1 = np.minimum(y0 + 1, img.shape[0] - 1), np.minimum(x0 + 1, img.shape[1] - 1)
    fy, fx = (ys - y0)[:, None, None], (xs - x0)[None, :, None]
    top = img[y0][:, x0] * (1 - fx) + img[y0][:, x1] * fx
    low = img[y1][:, x0] * (1 - fx) + img[y1][:, x1] * fx
    return np.round(top * (1 - fy) + low * fy).astype(np.uint8)


#: Half the width of the windowed sinc, in pixels of the coarser image.
LOBES = 3


#: Weights of resampling are kept for so many lines, read and made.
FEW_LINES = 400


@lru_cache(maxsize=512)
def _sinc_weights(size: int, out: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of the lines, of ``size``, that each of ``out`` lines is made of, and their weights."""
    scale = max(1.0, size / out)
    centre = (np.arange(out) + 0.5) * size / out
    at = np.floor(centre - LOBES * scale - 0.5).astype(int)[:, None] + np.arange(int(2 * LOBES * scale) + 3)
    x = (at + 0.5 - centre[:, None]) / scale
    weight = np.where((np.abs(x) < LOBES) & (at >= 0) & (at < size), np.sinc(x) * np.sinc(x / LOBES), 0.0)
    weight /= weight.sum(axis=1, keepdims=True)
    return np.clip(at, 0, size - 1), weight


def _sinc_lines(lines: np.ndarray, out: int) -> np.ndarray:
    """``lines`` (line, values) resampled to ``out`` lines, of those near each alone. On reduction the filter widens with the scale."""
    size = len(lines)
    at, weight = (_sinc_weights if size + out <= FEW_LINES else _sinc_weights.__wrapped__)(size, out)
    made = np.empty((out, lines.shape[1]), np.uint8)
    step = max(1, 10 * CACHED // (at.shape[1] * lines.shape[1]))
    for k in range(0, out, step):
        some = slice(k, k + step)
        made[some] = np.clip(np.round(np.matmul(weight[some, None], lines[at[some]].astype(float))[:, 0]), 0, 255)
    return made


def lanczos(img: np.ndarray, w: int, h: int) -> np.ndarray:
    """Resampling by a windowed sinc, along rows and then along columns, rounded after each."""
    channels = img.shape[2]
    if img.shape[1] != w:
        img = _sinc_lines(img.swapaxes(0, 1).reshape(img.shape[1], -1), w).reshape(w, -1, channels).swapaxes(0, 1)
    if img.shape[0] != h:
        img = _sinc_lines(img.reshape(img.shape[0], -1), h).reshape(h, -1, channels)
    return img


#: sRGB to XYZ, and the white of D65 that LAB is told from.
_XYZ = np.array([[0.412453, 0.357580, 0.180423], [0.212671, 0.715160, 0.072169], [0.019334, 0.119193, 0.950227]])
_WHITE = np.array([0.950456, 1.0, 1.088754])
_RGB = np.linalg.inv(_XYZ).T


def to_lab(img: np.ndarray) -> np.ndarray:
    """Lightness scaled to 0-255 and both colour axes about 128, as bytes."""
    c = np.arange(256) / 255
    linear = np.where(c <= 0.04045, c / 12.92, ((c + 0.055) / 1.055) ** 2.4)[img]
    t = linear @ _XYZ.T / _WHITE
    f = np.where(t > 0.008856, np.cbrt(t), 7.787 * t + 16 / 116)
    light = np.where(t[..., 1] > 0.008856, 116 * np.cbrt(t[..., 1]) - 16, 903.3 * t[..., 1])
    lab = np.stack([light * 255 / 100, 500 * (f[..., 0] - f[..., 1]) + 128, 200 * (f[..., 1] - f[..., 2]) + 128], -1)
    return np.clip(np.round(lab), 0, 255).astype(np.uint8)


def from_lab(lab: np.ndarray) -> np.ndarray:
    light, a, b = np.arange(256) * (100 / 255), lab[..., 1] - 128.0, lab[..., 2] - 128.0
    y = np.where(light > 7.9996, ((light + 16) / 116) ** 3, light / 903.3)
    fy = np.where(light > 7.9996, (light + 16) / 116, 7.787 * y + 16 / 116)[lab[..., 0]]
    f = np.stack([fy + a / 500, fy - b / 200], -1)
    xz = np.where(f > 0.206893, f**3, (f - 16 / 116) / 7.787)
    t = np.stack([xz[..., 0], y[lab[..., 0]], xz[..., 1]], -1)
    linear = np.clip(t * _WHITE @ _RGB, 0, 1)
    c = np.where(linear <= 0.0031308, linear * 12.92, 1.055 * linear ** (1 / 2.4) - 0.055)
    return np.clip(np.round(c * 255), 0, 255).astype(np.uint8)


def equalise_lightness(img: np.ndarray, clip: float = 2.0, grid: int = 8) -> np.ndarray:
    """``equalise`` on the lightness alone; colours stay."""
    lab = to_lab(img)
    lab[..., 0] = equalise(lab[..., 0], clip, grid)
    return from_lab(lab)


def gamma(img: np.ndarray, value: float) -> np.ndarray:
    """Every byte by the table of ((i / 255) ** (1 / value)) * 255, cut to whole numbers."""
    return (((np.arange(256) / 255.0) ** (1.0 / value)) * 255).astype(np.uint8)[img]


#: Values of an array that stay in a core's cache while sums run over it.
CACHED = 60_000
#: A pixel's own weight is 1, so that weights below this change no digit of a sum in double precision.
NO_WEIGHT = 1e-25


def run_sums(flat: np.ndarray, size: int, step: int) -> np.ndarray:
    """From each place on, the sum of ``size`` values that are ``step`` apart, by doubling: a few additions of whole arrays."""
    places, part, out, width, done = len(flat) - (size - 1) * step, flat, None, 1, 0
    while True:
        if size & width:
            some = part[done * step : done * step + places]
            out, done = some if out is None else out + some, done + width
        if 2 * width > size:
            return out
        part = part[: -width * step] + part[width * step :]
        width *= 2


def box_sums(a: np.ndarray, size: int) -> np.ndarray:
    """Sums over all size x size neighbourhoods that lie within the last two axes."""
    h, w = a.shape[-2:]
    sums = run_sums(run_sums(a.reshape(-1), size, w), size, 1)
    out = np.empty(a.shape, sums.dtype)
    out.reshape(-1)[: len(sums)] = sums  # those that run over the end of a row are cut off below
    return out[..., : h - size + 1, : w - size + 1]


def non_local_means(img: np.ndarray, strength: float = 3.0, patch: int = 7, search: int = 21) -> np.ndarray:
    """Each pixel as the mean of those in its search window, weighted by how alike the patches around both are.

    A patch's distance d is the mean squared difference over its pixels and channels, its weight exp(-d / strength ** 2).
    Weights are taken only where they reach ``NO_WEIGHT``. Patches of a block of pixels share a core, which can't be
    further apart than they are: products of matrices tell the shifts at which cores are near, in whole numbers that are
    exact in their type, and only there patches are compared, over a part of the image at a time. Where many are near,
    distances to all pixels at the shifts of a line are box sums.
    """
    img = img if img.ndim == 3 else img[..., None]
    h, w, channels = img.shape
    near, far = patch // 2, search // 2
    exact = np.float32 if patch * patch * channels * 255**2 < 1 << 24 else np.float64
    full = np.ascontiguousarray(_reflected(img, near + far).transpose(2, 0, 1).astype(exact))
    scale = patch * patch * channels * strength**2
    most = -np.log(NO_WEIGHT) * scale
    out = np.empty((h, w, channels), np.uint8)
    apart, wide = True, min(w, 32)
    tall = max(8, CACHED // ((wide + 2 * near) * (2 * far + 1)) - 2 * near)
    for top in range(0, h, tall):
        for left in range(0, w, wide):
            rows, columns = min(tall, h - top), min(wide, w - left)
            part = full[:, top : top + rows + 2 * (near + far), left : left + columns + 2 * (near + far)]
            found = _near_patches(part, patch, far, most) if apart else None
            apart = found is not None  # where patches of a part are alike, those of the next are, too
            made = _weighted_means(part, patch, far, scale, most) if found is None else _means_of(part, patch, far, scale, *found)
            out[top : top + rows, left : left + columns] = made
    return out


#: Height and width of the blocks of pixels whose patches are told apart by the core they share.
BLOCK = (2, 3)
#: Share of the shifts of all blocks beyond which box sums take less time than patches one by one.
MANY = 1 / 16


@lru_cache
def _patches_inside(patch: int) -> np.ndarray:
    """Which pixels around a block are in the patch of each of its own, as columns of ones."""
    tall, wide = BLOCK
    inside = np.zeros((patch + tall - 1, patch + wide - 1, tall, wide), np.float32)
    for i, j in np.ndindex(BLOCK):
        inside[i : i + patch, j : j + patch, i, j] = 1
    return inside.reshape(-1, tall * wide)


def _near_patches(full: np.ndarray, patch: int, far: int, most: float) -> tuple[np.ndarray, ...] | None:
    """(pixel, shift down, shift right, distance) of the patches of the middle of ``full`` within ``most`` of one at another place.

    In order of shifts; None if cores leave too many to compare.
    """
    channels, near, shifts, (tall, wide) = full.shape[0], patch // 2, 2 * far + 1, BLOCK
    h, w = full.shape[1] - 2 * (near + far), full.shape[2] - 2 * (near + far)
    down, right, core = -(-h // tall), -(-w // wide), (patch - tall + 1, patch - wide + 1)
    n = channels * core[0] * core[1]
    if min(core) < 1 or 3 * n * 255**2 >= 1 << 24 or full.dtype != np.float32:
        return None
    # Of blocks that reach over the edge the rest is not there.
    part, full = full, np.zeros((channels, full.shape[1] + tall - 1, full.shape[2] + wide - 1), np.float32)
    full[:, : part.shape[1], : part.shape[2]] = part
    rows, columns = full.shape[1] - core[0] + 1, full.shape[2] - core[1] + 1
    cores = np.empty((n + 1, rows, columns), np.float32)
    cores[:n].reshape(channels, *core, rows, columns)[:] = np.lib.stride_tricks.sliding_window_view(full, core, axis=(1, 2)).transpose(0, 3, 4, 1, 2)
    np.einsum("nyx,nyx->yx", cores[:n], cores[:n], out=cores[n])
    own = cores[:, far + tall - 1 :: tall, far + wide - 1 :: wide][:, :down, :right].transpose(1, 2, 0)
    limit = np.floor(most) - own[..., n]
    own = own * np.float32(-2)
    own[..., n] = 1
    # For each row of blocks, the rows of cores that its shifts reach: |other|^2 - 2 own * other, whole numbers.
    first = cores[:, tall - 1 :]
    reach = np.lib.stride_tricks.as_strided(first, (down, n + 1, shifts * columns), (tall * first.strides[1], *first.strides[::2]))
    apart = np.matmul(own, reach)[..., wide - 1 :]
    a, b, c = apart.strides
    apart = np.lib.stride_tricks.as_strided(apart, (down, right, shifts, shifts), (a, b + wide * c, columns * c, c))
    is_near = apart <= limit[..., None, None]
    is_near[:, :, far, far] = False
    found = np.flatnonzero(is_near)
    if len(found) > MANY * is_near.size:
        return None
    block, shift = np.divmod(found, shifts * shifts)
    (y, x), (dy, dx) = np.divmod(block, right), np.divmod(shift, shifts)
    y, x = tall * y, wide * x
    # The distances of a block's patches, from the squares of differences around it.
    inside = _patches_inside(patch)
    cells = (np.arange(patch + tall - 1)[:, None] * full.shape[2] + np.arange(patch + wide - 1)).reshape(-1)
    here, there = (far + y) * full.shape[2] + far + x, (dy + y) * full.shape[2] + dx + x
    around = np.zeros((len(found), tall * wide), np.float32)
    for plane in full.reshape(channels, -1):
        d = plane[here[:, None] + cells] - plane[there[:, None] + cells]
        around += (d * d) @ inside
    pair, k = np.nonzero(around <= most)
    y, x, dy, dx, around = y[pair] + k // wide, x[pair] + k % wide, dy[pair], dx[pair], around[pair, k]
    kept = np.flatnonzero((y < h) & (x < w))
    kept = kept[np.argsort((dy * shifts + dx)[kept], kind="stable")]
    return (y * w + x)[kept], dy[kept], dx[kept], around[kept]


def _means_of(full: np.ndarray, patch: int, far: int, scale: float, at: np.ndarray, dy: np.ndarray, dx: np.ndarray, around: np.ndarray) -> np.ndarray:
    """``non_local_means`` of the middle of ``full``, where the patches at ``at`` are near those at their shifts, and to themselves."""
    channels, near = full.shape[0], patch // 2
    h, w = full.shape[1] - 2 * (near + far), full.shape[2] - 2 * (near + far)
    weight = np.exp(around / -scale)
    weights = 1 + np.bincount(at, weight, h * w)
    y, x = np.divmod(at, w)
    total = full[:, near + far : near + far + h, near + far : near + far + w].reshape(channels, -1).astype(float)
    for c in range(channels):
        total[c] += np.bincount(at, weight * full[c, near + dy + y, near + dx + x], h * w)
    return np.clip(np.round(total / weights), 0, 255).astype(np.uint8).T.reshape(h, w, channels)


def _weighted_means(full: np.ndarray, patch: int, far: int, scale: float, most: float) -> np.ndarray:
    """``non_local_means`` of the middle of ``full`` (channels first), which has patch // 2 + far pixels more on every side."""
    channels, near, shifts = full.shape[0], patch // 2, 2 * far + 1
    h, w = full.shape[1] - 2 * (near + far), full.shape[2] - 2 * (near + far)
    tall, wide = h + 2 * near, w + 2 * near
    own = full[:, far : far + tall, far : far + wide]
    others = np.lib.stride_tricks.sliding_window_view(full, (tall, wide), axis=(1, 2))
    lines = max(1, CACHED // (shifts * tall * wide))
    total, weights = np.zeros((channels, h * w)), np.zeros(h * w)
    for dy in range(0, shifts, lines):
        n = min(lines, shifts - dy)
        squares, more = (np.empty((n, shifts, tall, wide), full.dtype) for _ in range(2))
        for c in range(channels):
            d = more if c else squares
            np.subtract(others[c, dy : dy + n], own[c], out=d)
            np.multiply(d, d, out=d)
            if c:
                squares += d
        around = box_sums(squares, patch)
        shift, at = np.divmod(np.flatnonzero(around <= most), h * w)
        (down, right), (y, x) = np.divmod(shift, shifts), np.divmod(at, w)
        weight = np.exp(around[down, right, y, x] / -scale)
        weights += np.bincount(at, weight, h * w)
        for c in range(channels):
            total[c] += np.bincount(at, weight * full[c, dy + down + near + y, right + near + x], h * w)
    return np.clip(np.round(total / weights), 0, 255).astype(np.uint8).T.reshape(h, w, channels)


def _reflected(img: np.ndarray, by: int) -> np.ndarray:
    """``img`` with ``by`` more pixels on every side, mirrored at its edge pixels as often as it takes."""
    at = []
    for n in img.shape[:2]:
        k = np.abs(np.arange(-by, n + by)) % max(1, 2 * (n - 1))
        at.append(np.minimum(k, 2 * (n - 1) - k) if n > 1 else np.zeros(n + 2 * by, int))
    return img[at[0]][:, at[1]]


def denoised(img: np.ndarray, strength: float = 3.0) -> np.ndarray:
    """``non_local_means`` of the lightness, and of both colour axes together."""
    lab = to_lab(img)
    return from_lab(np.concatenate([non_local_means(lab[..., :1], strength), non_local_means(lab[..., 1:], strength)], -1))


def oriented(img: np.ndarray, orientation: int) -> np.ndarray:
    """``img`` upright, for the orientation that its file states."""
    if orientation in (5, 6, 7, 8):
        img = img.swapaxes(0, 1)
    if orientation in (2, 3, 6, 7):
        img = img[:, ::-1]
    if orientation in (3, 4, 7, 8):
        img = img[::-1]
    return img


def fitted(img: np.ndarray, short_edge: int, square: bool, fill: int = 128) -> np.ndarray:
    """``img`` enlarged to a short edge, never reduced, and if ``square`` in the middle of a square."""
    h, w = img.shape[:2]
    if min(w, h) < short_edge:
        scale = short_edge / min(w, h)
        img = lanczos(img, round(w * scale), round(h * scale))
    if square:
        h, w = img.shape[:2]
        side = max(w, h)
        out = np.full((side, side, 3), fill, np.uint8)
        out[(side - h) // 2 : (side - h) // 2 + h, (side - w) // 2 : (side - w) // 2 + w] = img
        img = out
    return img


def letterbox(img: np.ndarray, w: int, h: int, fill: int = 0) -> np.ndarray:
    """``img`` as large as a box of ``w`` by ``h`` takes, by ``lanczos``, in its middle."""
    scale = min(w / img.shape[1], h / img.shape[0])
    cw, ch = max(1, round(img.shape[1] * scale)), max(1, round(img.shape[0] * scale))
    out = np.full((h, w, 3), fill, np.uint8)
    top, left = (h - ch) // 2, (w - cw) // 2
    out[top : top + ch, left : left + cw] = lanczos(img, cw, ch)
    return out


def channel_means(img: np.ndarray) -> list[float]:
    """Mean of every channel, from sums of whole numbers along columns."""
    h, w, channels = img.shape
    return (img.reshape(h, -1).sum(axis=0, dtype=np.uint32).reshape(w, channels).sum(axis=0, dtype=np.int64) / (h * w)).tolist()


def blur_score(img: np.ndarray) -> float:
    """Variance of the Laplacian; low for blurred images."""
    p = np.pad(grey(img), 1, mode="reflect")
    return float((p[:-2, 1:-1] + p[2:, 1:-1] + p[1:-1, :-2] + p[1:-1, 2:] - 4 * p[1:-1, 1:-1]).var())


def edge_ratio(img: np.ndarray, low: float = 50, high: float = 150) -> float:
    """Share of edge pixels: strong gradients, and weak ones connected to them."""
    p = np.pad(grey(img), 1, mode="edge")
    gx = p[:-2, 2:] + 2 * p[1:-1, 2:] + p[2:, 2:] - p[:-2, :-2] - 2 * p[1:-1, :-2] - p[2:, :-2]
    gy = p[2:, :-2] + 2 * p[2:, 1:-1] + p[2:, 2:] - p[:-2, :-2] - 2 * p[:-2, 1:-1] - p[:-2, 2:]
    size = np.abs(gx) + np.abs(gy)
    strong, weak = size > high, size > low
    # Weak pixels that touch a strong one, and all weak ones connected to them.
    seeds = weak & (box_sums(np.pad(strong, 1).astype(np.uint8), 3) > 0)
    ys, starts, ends = runs_of(weak)
    names = joined_runs(ys, starts, ends)
    until = np.pad(seeds.cumsum(axis=1, dtype=np.int64), ((0, 0), (1, 0)))
    kept = np.zeros(len(ys), bool)
    kept[names[until[ys, ends] > until[ys, starts]]] = True
    return float((ends - starts)[kept[names]].sum() / weak.size)


def thousandths(img: np.ndarray) -> np.ndarray:
    """``grey`` in thousandths, whole numbers, whose sums are exact."""
    return img[..., :3].astype(np.int32) @ np.array([299, 587, 114], np.int32)


def texture(img: np.ndarray) -> float:
    """Spread of the local standard deviation."""
    full = padded(thousandths(img).astype(np.int64), 2)
    return float((np.sqrt(25 * box_sums(full**2, 5) - box_sums(full, 5) ** 2) / 25_000).std())


def changed_ratio(img: np.ndarray, reference: np.ndarray | None, least: float = 25) -> float:
    """Share of pixels that differ from ``reference``; 1 without one of the same shape."""
    if reference is None or reference.shape != img.shape:
        return 1.0
    return float((grey(np.abs(img.astype(int) - reference.astype(int)).astype(np.uint8)) > least).mean())


def regions(mask: np.ndarray) -> np.ndarray:
    """Bounding boxes (x1, y1, x2, y2) of the 8-connected parts of ``mask``, in the order of their first pixel.

    Runs of pixels in a row are joined with those that they touch in the row above.
    """
    return connected_runs(*runs_of(mask))


def runs_of(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows, starts and ends of the runs of pixels in ``mask``, in order of row and start."""
    edge = np.diff(np.pad(mask.astype(np.int8), ((0, 0), (1, 1))), axis=1)
    ys, starts = np.nonzero(edge == 1)
    return ys, starts, np.nonzero(edge == -1)[1]


def joined_runs(ys: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """For each of the runs [starts, ends) in rows ``ys``, the place of the first run of its 8-connected part.

    Runs are in order of row and start, and those of a row don't touch. Those that touch in the row above are looked up
    for all at once; then parts hang themselves on the first part that they touch until none is left to.
    """
    names = np.arange(len(ys))
    if not len(ys):
        return names
    rows = np.append(0, np.minimum(np.diff(ys), 2).cumsum())  # of the rows between, one is enough
    low = starts.min()
    wide = ends.max() - low + 2
    first, last = rows * wide + starts - low, rows * wide + ends - low
    begin = np.searchsorted(last, first - wide, "left")
    n = np.searchsorted(first, last - wide, "right") - begin
    here = np.repeat(names, n)
    above = np.arange(len(here)) - np.repeat(n.cumsum() - n, n) + np.repeat(begin, n)
    while True:
        a, b = names[here], names[above]
        apart = a != b
        if not apart.any():
            return names
        here, above, a, b = here[apart], above[apart], a[apart], b[apart]
        np.minimum.at(names, np.maximum(a, b), np.minimum(a, b))
        while not np.array_equal(up := names[names], names):
            names = up


def connected_runs(ys: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Bounding boxes (x1, y1, x2, y2) of the 8-connected parts of runs [starts, ends) in rows ``ys``.

    Runs are in order of row and start, and those of a row don't touch; so are the boxes, by their first run.
    """
    return boxes_of(joined_runs(ys, starts, ends), ys, starts, ends)[1]


def boxes_of(names: np.ndarray, ys: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The first runs of the parts that ``names`` tells of, in their order, and the parts' bounding boxes."""
    heads, place = np.unique(names, return_inverse=True)
    out = np.empty((len(heads), 4), np.int64)
    for k, (v, f) in enumerate(((starts, np.minimum), (ys, np.minimum), (ends, np.maximum), (ys + 1, np.maximum))):
        out[:, k] = v[heads]
        f.at(out[:, k], place, v)
    return heads, out


def som_mask(img: np.ndarray) -> np.ndarray:
    """Pixels darker than their surroundings, with small gaps closed.

    A pixel's 5 x 5 mean is compared with the 11 x 11 mean of such means less 2, both as sums of whole numbers.
    """
    near = box_sums(padded(thousandths(img), 2), 5)
    dark = 121 * near < box_sums(padded(near, 5), 11) - 2 * 121 * 25 * 1000
    grown = box_sums(np.pad(dark, 1).astype(np.uint8), 3) > 0
    return box_sums(np.pad(grown, 1, constant_values=True).astype(np.uint8), 3) == 9


def stroke_mask(layer: np.ndarray | None, composite: np.ndarray | None, background: np.ndarray) -> np.ndarray:
    """Drawn pixels: those of a layer that are opaque, else coloured; else where composite and background differ."""
    mask = np.zeros(background.shape[:2], bool)
    if layer is not None:
        if (layer[..., 3] > 10).any():
            mask = layer[..., 3] > 10
        else:
            mask = layer[..., :3].max(-1) > 20
    if not mask.any() and composite is not None:
        mask = np.abs(composite[..., :3].astype(int) - background[..., :3].astype(int)).sum(-1) > 25
    return mask
