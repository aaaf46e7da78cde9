"""Image files in memory: PNG and portable pixmaps to RGB arrays and back, and the orientation that a file states.

Other formats are told apart but not decoded. A file that is cut or damaged is unreadable, never half an image.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np

OK, UNREADABLE, UNSUPPORTED = "ok", "unreadable", "unsupported"
#: An image of more pixels is not decoded.
MOST_PIXELS = 1 << 28

_PNG = b"\x89PNG\r\n\x1a\n"
#: Channels by colour type: grey, RGB, palette, grey and alpha, RGB and alpha.
_CHANNELS = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}
_DEPTHS = {0: (1, 2, 4, 8, 16), 2: (8, 16), 3: (1, 2, 4, 8), 4: (8, 16), 6: (8, 16)}


class Unreadable(ValueError):
    """A file that is no whole image."""


class Unsupported(ValueError):
    """A file that may be an image, of a kind that is not decoded."""


def decode(content: bytes | None) -> tuple[str, np.ndarray | None, int]:
    """(status, height x width x 3 uint8 array or None, orientation 1 to 8) of a file's bytes.

    The array is as stored; ``pixels.oriented`` turns it. Transparency is dropped.
    """
    try:
        content = b"" if content is None else bytes(content)
        if content.startswith(_PNG):
            return OK, *_png(content)
        if content[:2] in (b"P5", b"P6") and content[2:3].isspace():
            return OK, _pixmap(content), 1
        if content[:2] == b"\xff\xd8" or content[:4] in (b"GIF8", b"RIFF", b"II*\0", b"MM\0*") or content[:2] == b"BM":
            return UNSUPPORTED, None, _jpeg_orientation(content) if content[:2] == b"\xff\xd8" else 1
        return UNREADABLE, None, 1
    except Unsupported:
        return UNSUPPORTED, None, 1
    except (ValueError, struct.error, zlib.error, IndexError):
        return UNREADABLE, None, 1


def _chunks(content: bytes):
    """(kind, data) of a PNG's chunks up to its end; their checksums must fit."""
    at = len(_PNG)
    while True:
        size, kind = struct.unpack_from(">I4s", content, at)
        data = content[at + 8 : at + 8 + size]
        (check,) = struct.unpack_from(">I", content, at + 8 + size)
        if len(data) < size or zlib.crc32(kind + data) != check:
            raise Unreadable("a chunk is damaged")
        yield kind, data
        if kind == b"IEND":
            return
        at += 12 + size


def _png(content: bytes) -> tuple[np.ndarray, int]:
    header, palette, packed, turned = None, None, [], 1
    for kind, data in _chunks(content):
        if kind == b"IHDR":
            header = struct.unpack(">IIBBBBB", data)
        elif kind == b"PLTE":
            palette = np.frombuffer(data, np.uint8).reshape(-1, 3)
        elif kind == b"IDAT":
            packed.append(data)
        elif kind == b"eXIf":
            turned = exif_orientation(data)
    if header is None:
        raise Unreadable("there is no header")
    w, h, depth, colour, _, _, laced = header
    if colour not in _CHANNELS or depth not in _DEPTHS[colour] or not w or not h:
        raise Unreadable("the header is no PNG's")
    if laced or w * h > MOST_PIXELS:
        raise Unsupported("interlaced or too large")
    channels = _CHANNELS[colour]
    stride = (w * channels * depth + 7) // 8
    raw = zlib.decompressobj().decompress(b"".join(packed), h * (stride + 1) + 1)
    if len(raw) != h * (stride + 1):
        raise Unreadable("pixels are missing")
    rows = unfiltered(np.frombuffer(raw, np.uint8).reshape(h, stride + 1), max(1, channels * depth // 8))
    if depth == 16:
        rows = rows[:, ::2]
    elif depth < 8:
        bits = np.unpackbits(rows, axis=1).reshape(h, -1, depth)
        rows = (bits @ (1 << np.arange(depth - 1, -1, -1))).astype(np.uint8)[:, : w * channels]
        if colour == 0:
            rows = rows * np.uint8(255 // ((1 << depth) - 1))
    img = rows.reshape(h, w, channels)
    if colour == 3:
        if palette is None or img.max() >= len(palette):
            raise Unreadable("colours are missing")
        return palette[img[..., 0]], turned
    return np.repeat(img[..., :1], 3, axis=2) if colour in (0, 4) else img[..., :3].copy(), turned


def unfiltered(rows: np.ndarray, step: int) -> np.ndarray:
    """Scan lines without their filters; ``rows`` have the filter's type first, ``step`` is the bytes of a pixel."""
    out = np.zeros((rows.shape[0], rows.shape[1] - 1), np.uint8)
    above = np.zeros(out.shape[1], np.uint8)
    # Lines of one filter that follow each other are done at once, but for those that hang on their neighbours both ways.
    cuts = [0, *(np.flatnonzero(np.diff(rows[:, 0])) + 1).tolist(), len(rows)]
    for y, end in zip(cuts, cuts[1:]):
        kind, lines = rows[y, 0], rows[y:end, 1:]
        if kind == 0:
            out[y:end] = lines
        elif kind == 1:
            for c in range(step):
                np.cumsum(lines[:, c::step], axis=1, dtype=np.uint8, out=out[y:end, c::step])
        elif kind == 2:
            np.cumsum(lines, axis=0, dtype=np.uint8, out=out[y:end])
            out[y:end] += above
        elif kind in (3, 4):
            last = above.tolist()
            for k in range(y, end):
                last = _running(rows[k, 1:].tolist(), last, step, kind == 4)
                out[k] = last
        else:
            raise Unreadable("a filter is unknown")
        above = out[end - 1]
    return out


def _running(line: list[int], above: list[int], step: int, paeth: bool) -> list[int]:
    """A line whose bytes were told from those before and above: their mean, or whichever is nearest to their plane."""
    out = [0] * step  # before the line, then the line itself, whose bytes the loops meet again a pixel later
    if paeth:
        for x, a, b, c in zip(line, out, above, [0] * step + above):
            p, q = b - c, a - c
            p, q, r = abs(p), abs(q), abs(p + q)
            out.append((x + (a if p <= q and p <= r else b if q <= r else c)) & 255)
    else:
        for x, a, b in zip(line, out, above):
            out.append((x + ((a + b) >> 1)) & 255)
    return out[step:]


def _pixmap(content: bytes) -> np.ndarray:
    """A binary portable grey or pixmap of one byte a channel; comments may stand in its header."""
    words, at = [], 2
    while len(words) < 3:
        while content[at : at + 1].isspace():
            at += 1
        if content[at : at + 1] == b"#":
            at = content.index(b"\n", at)
            continue
        end = at
        while content[end : end + 1].isdigit():
            end += 1
        words.append(int(content[at:end]))
        at = end
    w, h, most = words
    if not 0 < most < 256:
        raise Unsupported("more than a byte a channel")
    if w * h > MOST_PIXELS:
        raise Unsupported("too large")
    channels = 3 if content[:2] == b"P6" else 1
    data = np.frombuffer(content, np.uint8, w * h * channels, at + 1).reshape(h, w, channels)
    if not data.size:
        raise Unreadable("there are no pixels")
    if most != 255:
        data = np.round(np.minimum(data, most) * (255 / most)).astype(np.uint8)
    return np.repeat(data, 3, axis=2) if channels == 1 else data.copy()


def exif_orientation(data: bytes) -> int:
    """The orientation that EXIF data states, 1 to 8; 1 if it states none."""
    order = {b"II": "<", b"MM": ">"}.get(data[:2])
    try:
        if order is None or struct.unpack_from(f"{order}H", data, 2)[0] != 42:
            return 1
        (at,) = struct.unpack_from(f"{order}I", data, 4)
        (n,) = struct.unpack_from(f"{order}H", data, at)
        for k in range(n):
            tag, kind, _, value = struct.unpack_from(f"{order}HHIH", data, at + 2 + 12 * k)
            if tag == 0x0112 and kind == 3:
                return value if 1 <= value <= 8 else 1
    except struct.error:
        pass
    return 1


def _jpeg_orientation(content: bytes) -> int:
    """The orientation in a JPEG's first EXIF segment."""
    at = 2
    while content[at : at + 1] == b"\xff" and content[at + 1 : at + 2] not in (b"\xda", b""):
        (size,) = struct.unpack_from(">H", content, at + 2)
        if content[at + 1] == 0xE1 and content[at + 4 : at + 10] == b"Exif\0\0":
            return exif_orientation(content[at + 10 : at + 2 + size])
        at += 2 + size
    return 1


def encode_png(img: np.ndarray, filters: list[int] | int = 0, orientation: int | None = None, level: int = 1) -> bytes:
    """``img`` (height x width, or x 1 to 4 channels, uint8) as PNG; ``filters`` has the type of every scan line."""
    img = img if img.ndim == 3 else img[..., None]
    h, w, channels = img.shape
    colour = {n: c for c, n in _CHANNELS.items() if c != 3}[channels]
    kinds = [filters] * h if isinstance(filters, int) else filters
    lines = np.zeros((h, 1 + w * channels), np.uint8)
    flat = img.reshape(h, -1).astype(np.int16)
    left, above, corner = (np.zeros_like(flat) for _ in range(3))
    left[:, channels:], above[1:], corner[1:, channels:] = flat[:, :-channels], flat[:-1], flat[:-1, :-channels]
    nearest = None
    if 4 in kinds:
        far = [np.abs(above - corner), np.abs(left - corner), np.abs(left + above - 2 * corner)]
        nearest = np.where((far[0] <= far[1]) & (far[0] <= far[2]), left, np.where(far[1] <= far[2], above, corner))
    guesses = (0, left, above, (left + above) >> 1, nearest)
    for y, kind in enumerate(kinds):
        lines[y, 0] = kind
        lines[y, 1:] = (flat[y] - (guesses[kind][y] if kind else 0)) & 255
    parts = [(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, colour, 0, 0, 0))]
    if orientation is not None:
        parts.append((b"eXIf", b"MM\0*" + struct.pack(">IHHHIHHI", 8, 1, 0x0112, 3, 1, orientation, 0, 0)))
    parts += [(b"IDAT", zlib.compress(lines.tobytes(), level)), (b"IEND", b"")]
    return _PNG + b"".join(struct.pack(">I", len(d)) + k + d + struct.pack(">I", zlib.crc32(k + d)) for k, d in parts)
