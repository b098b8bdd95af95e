"""Page images as numpy arrays: decoding, clean-up before recognition, and the regions that are read by themselves.

Gray images are uint8 arrays of (height, width). Only formats without patents or codecs are decoded here: PNG, portable
any-maps, BMP and TIFF without compression. Other formats need an engine that reads them itself.
"""

from __future__ import annotations

import math
import struct
import zlib
from collections.abc import Callable

import numpy as np

# --- Fixed values: sizes, thresholds, and regions as (x, y, width, height, scale) in shares of the page. ---
LEAST_WIDTH = 1200
LEAST_SKEW, MOST_SKEW, LEAST_INK = 0.5, 45.0, 20
THRESHOLD, BORDER = 128, 2
TALL, WIDE = 1.35, 1.20
TALL_REGIONS = ((0.0, 0.00, 1.00, 0.56, 2.6), (0.0, 0.42, 1.00, 0.58, 2.8), (0.18, 0.60, 0.74, 0.18, 4.0), (0.08, 0.76, 0.84, 0.14, 4.2))
WIDE_REGIONS = ((0.00, 0.00, 1.00, 0.24, 4.0), (0.08, 0.14, 0.84, 0.42, 3.6), (0.30, 0.16, 0.62, 0.30, 4.0), (0.05, 0.60, 0.90, 0.28, 4.0))
BANDS = (0.3, 0.4)
# --- End of fixed values. ---


# --- decoding ----------------------------------------------------------------------------------------------------------


def to_gray(image: np.ndarray) -> np.ndarray:
    """Luminance of an image with one, three or four channels; gray images as they are."""
    if image.ndim == 2:
        return image
    if image.shape[2] < 3:
        return image[:, :, 0]
    return np.rint(image[:, :, :3] @ np.array([0.299, 0.587, 0.114])).astype(np.uint8)


def read_png(raw: bytes) -> np.ndarray:
    """An 8-bit PNG without interlacing: gray, RGB, palette, or with alpha."""
    at, data, palette, header = 8, b"", None, None
    while at + 8 <= len(raw):
        size, kind = struct.unpack(">I4s", raw[at : at + 8])
        body = raw[at + 8 : at + 8 + size]
        if kind == b"IHDR":
            header = struct.unpack(">IIBBBBB", body)
        elif kind == b"PLTE":
            palette = np.frombuffer(body, dtype=np.uint8).reshape(-1, 3)
        elif kind == b"IDAT":
            data += body
        at += 12 + size
    width, height, depth, color, _, _, interlace = header
    if depth != 8 or interlace:
        raise ValueError("only 8-bit PNG without interlacing")
    n = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}[color]
    rows = np.frombuffer(zlib.decompress(data), dtype=np.uint8).reshape(height, 1 + width * n)
    out = np.zeros((height, width * n), dtype=np.uint8)
    above = np.zeros(width * n, dtype=np.int64)
    for y in range(height):
        kind, line = int(rows[y, 0]), rows[y, 1:].astype(np.int64)
        if kind == 1:
            line = np.cumsum(line.reshape(width, n), axis=0).ravel()
        elif kind == 2:
            line = line + above
        elif kind in (3, 4):
            for x in range(width * n):
                left, up, corner = (line[x - n] if x >= n else 0), above[x], (above[x - n] if x >= n else 0)
                if kind == 3:
                    guess = (left + up) // 2
                else:
                    p = left + up - corner
                    guess = min((abs(p - left), 0, left), (abs(p - up), 1, up), (abs(p - corner), 2, corner))[2]
                line[x] = (line[x] + guess) & 255
        above = line & 255
        out[y] = above
    image = out.reshape(height, width, n)
    return palette[image[:, :, 0]] if color == 3 else image if n > 1 else image[:, :, 0]


def write_png(image: np.ndarray) -> bytes:
    """A gray or RGB image as PNG."""
    height, width = image.shape[:2]
    rows = np.concatenate([np.zeros((height, 1), dtype=np.uint8), image.reshape(height, -1)], axis=1)
    chunk = lambda kind, body: struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))
    header = struct.pack(">IIBBBBB", width, height, 8, 0 if image.ndim == 2 else 2, 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", header) + chunk(b"IDAT", zlib.compress(rows.tobytes())) + chunk(b"IEND", b"")


def read_pnm(raw: bytes) -> list[np.ndarray]:
    """The images of a portable gray- or pixmap (binary), one after another."""
    out, at = [], 0
    while raw[at : at + 2] in (b"P5", b"P6"):
        n, fields, end = (1 if raw[at + 1 : at + 2] == b"5" else 3), [], at + 2
        while len(fields) < 3:
            while raw[end : end + 1].isspace():
                end += 1
            if raw[end : end + 1] == b"#":
                end = raw.index(b"\n", end)
                continue
            start = end
            while not raw[end : end + 1].isspace():
                end += 1
            fields.append(int(raw[start:end]))
        width, height, _ = fields
        end += 1
        image = np.frombuffer(raw, dtype=np.uint8, count=width * height * n, offset=end).reshape(height, width, n)
        out.append(image if n > 1 else image[:, :, 0])
        at = end + width * height * n
        while raw[at : at + 1].isspace():
            at += 1
    return out


def read_bmp(raw: bytes) -> np.ndarray:
    """A BMP of 24 or 32 bits without compression."""
    start, width, height, bits, packed = struct.unpack("<I", raw[10:14])[0], *struct.unpack("<ii", raw[18:26]), *struct.unpack("<HI", raw[28:34])
    if bits not in (24, 32) or packed not in (0, 3):
        raise ValueError("only BMP of 24 or 32 bits without compression")
    stride, n = -(-width * bits // 32) * 4, bits // 8
    rows = np.frombuffer(raw, dtype=np.uint8, count=stride * abs(height), offset=start).reshape(abs(height), stride)
    image = rows[:, : width * n].reshape(abs(height), width, n)[:, :, 2::-1]
    return image[::-1] if height > 0 else image


def read_tiff(raw: bytes) -> list[np.ndarray]:
    """The frames of a TIFF with 8-bit samples in strips without compression."""
    order = "<" if raw[:2] == b"II" else ">"
    at, out = struct.unpack(order + "I", raw[4:8])[0], []
    while at:
        count = struct.unpack(order + "H", raw[at : at + 2])[0]
        tags = {}
        for k in range(count):
            tag, kind, n, _ = struct.unpack(order + "HHII", raw[at + 2 + 12 * k : at + 14 + 12 * k])
            size = {1: 1, 3: 2, 4: 4}.get(kind)
            if size:
                where = at + 10 + 12 * k if n * size <= 4 else struct.unpack(order + "I", raw[at + 10 + 12 * k : at + 14 + 12 * k])[0]
                tags[tag] = struct.unpack(order + f"{n}{'BHI'[(1, 2, 4).index(size)]}", raw[where : where + n * size])
        if tags.get(259, (1,))[0] != 1 or any(b != 8 for b in tags.get(258, (8,))):
            raise ValueError("only TIFF with 8-bit samples without compression")
        n = tags.get(277, (1,))[0]
        data = b"".join(raw[s : s + c] for s, c in zip(tags[273], tags[279], strict=True))
        image = np.frombuffer(data, dtype=np.uint8).reshape(tags[257][0], tags[256][0], n)
        image = 255 - image if tags.get(262, (1,))[0] == 0 else image
        out.append(image if n > 1 else image[:, :, 0])
        at = struct.unpack(order + "I", raw[at + 2 + 12 * count : at + 6 + 12 * count])[0]
    return out


def frames(raw: bytes) -> list[np.ndarray]:
    """All images of a file; a file that is none of the known kinds is a ValueError."""
    if raw[:4] == b"\x89PNG":
        return [read_png(raw)]
    if raw[:2] in (b"P5", b"P6"):
        return read_pnm(raw)
    if raw[:2] == b"BM":
        return [read_bmp(raw)]
    if raw[:4] in (b"II*\0", b"MM\0*"):
        return read_tiff(raw)
    raise ValueError("not an image of a known kind")


# --- resampling --------------------------------------------------------------------------------------------------------


def sample(image: np.ndarray, ys: np.ndarray, xs: np.ndarray, fill: int | None = None) -> np.ndarray:
    """Gray values between pixels, linear in both directions; outside the edge's, or `fill`."""
    h, w = image.shape
    y, x = np.clip(ys, 0, h - 1), np.clip(xs, 0, w - 1)
    y0, x0 = np.floor(y).astype(int), np.floor(x).astype(int)
    y1, x1, fy, fx = np.minimum(y0 + 1, h - 1), np.minimum(x0 + 1, w - 1), y - y0, x - x0
    top = image[y0, x0] * (1 - fx) + image[y0, x1] * fx
    out = top * (1 - fy) + (image[y1, x0] * (1 - fx) + image[y1, x1] * fx) * fy
    if fill is not None:
        out = np.where((ys < -0.5) | (xs < -0.5) | (ys > h - 0.5) | (xs > w - 0.5), fill, out)
    return np.rint(out).astype(np.uint8)


def scaled(image: np.ndarray, factor: float) -> np.ndarray:
    """A gray image with its sides multiplied."""
    h, w = max(1, round(image.shape[0] * factor)), max(1, round(image.shape[1] * factor))
    ys, xs = (np.arange(h) + 0.5) * image.shape[0] / h - 0.5, (np.arange(w) + 0.5) * image.shape[1] / w - 0.5
    return sample(image, *np.meshgrid(ys, xs, indexing="ij"))


def at_most(image: np.ndarray, side: int) -> np.ndarray:
    """The image, scaled down if a side is longer."""
    return image if max(image.shape) <= side else scaled(image, side / max(image.shape))


def rotated(image: np.ndarray, degrees: float) -> np.ndarray:
    """A gray image turned about its middle, white where nothing was."""
    h, w = image.shape
    a = math.radians(degrees)
    ys, xs = np.meshgrid(np.arange(h) - (h - 1) / 2, np.arange(w) - (w - 1) / 2, indexing="ij")
    return sample(image, ys * math.cos(a) + xs * math.sin(a) + (h - 1) / 2, xs * math.cos(a) - ys * math.sin(a) + (w - 1) / 2, fill=255)


# --- skew --------------------------------------------------------------------------------------------------------------


def otsu(image: np.ndarray) -> int:
    """The threshold that separates dark from light with the greatest variance between them."""
    counts = np.bincount(image.ravel(), minlength=256).astype(float)
    below, sums = np.cumsum(counts), np.cumsum(counts * np.arange(256))
    with np.errstate(divide="ignore", invalid="ignore"):
        between = (sums[-1] * below / below[-1] - sums) ** 2 / (below * (below[-1] - below))
    return int(np.nanargmax(np.where(np.isfinite(between), between, -1)))


def hull(points: np.ndarray) -> np.ndarray:
    """The convex hull of points (x, y), in order."""
    points = points[np.lexsort((points[:, 1], points[:, 0]))]

    def chain(rows: np.ndarray) -> list:
        out: list = []
        for p in rows:
            while len(out) > 1 and (out[-1][0] - out[-2][0]) * (p[1] - out[-2][1]) <= (out[-1][1] - out[-2][1]) * (p[0] - out[-2][0]):
                out.pop()
            out.append(p)
        return out[:-1]

    return np.array(chain(points) + chain(points[::-1]) or points[:1])


def skew(image: np.ndarray) -> float:
    """Degrees, -45 to 45, by which the smallest rectangle around all ink is turned; 0 with hardly any ink."""
    ys, xs = np.nonzero(image <= otsu(image))
    if len(ys) < LEAST_INK:
        return 0.0
    first, last = np.full(image.shape[0], image.shape[1]), np.full(image.shape[0], -1)
    np.minimum.at(first, ys, xs)
    np.maximum.at(last, ys, xs)
    own = np.flatnonzero(last >= 0)
    edge = hull(np.concatenate([np.stack([first[own], own], axis=1), np.stack([last[own], own], axis=1)]).astype(float))
    best = (math.inf, 0.0)
    for side in np.roll(edge, -1, axis=0) - edge:
        a = math.atan2(side[1], side[0])
        turned = edge @ np.array([[math.cos(a), -math.sin(a)], [math.sin(a), math.cos(a)]])
        area = float(np.prod(turned.max(axis=0) - turned.min(axis=0)))
        angle = (math.degrees(a) + 45) % 90 - 45
        if (area, abs(angle)) < (best[0] - 1e-9, abs(best[1])) or area < best[0] - 1e-6:
            best = (area, angle)
    return best[1]


def deskewed(image: np.ndarray) -> np.ndarray:
    """The image turned upright, unless it is by less than LEAST_SKEW or more than MOST_SKEW degrees."""
    angle = skew(image)
    return rotated(image, angle) if LEAST_SKEW <= abs(angle) <= MOST_SKEW else image


# --- filters -----------------------------------------------------------------------------------------------------------


def windows(image: np.ndarray, size: int) -> np.ndarray:
    """Views of the square around each pixel, the edge repeated."""
    return np.lib.stride_tricks.sliding_window_view(np.pad(image, size // 2, mode="edge"), (size, size))


def box(image: np.ndarray, size: int) -> np.ndarray:
    """Means over squares."""
    sums = np.pad(np.pad(image.astype(float), size // 2, mode="edge").cumsum(0).cumsum(1), ((1, 0), (1, 0)))
    return (sums[size:, size:] - sums[:-size, size:] - sums[size:, :-size] + sums[:-size, :-size]) / size**2


def gaussian(image: np.ndarray, size: int, sigma: float) -> np.ndarray:
    weights = np.exp(-((np.arange(size) - size // 2) ** 2) / (2 * sigma**2))
    weights /= weights.sum()
    padded = np.pad(image.astype(float), size // 2, mode="edge")
    rows = sum(w * padded[k : k + image.shape[0]] for k, w in enumerate(weights))
    return sum(w * rows[:, k : k + image.shape[1]] for k, w in enumerate(weights))


def denoised(image: np.ndarray, strength: float = 10, patch: int = 7, search: int = 21) -> np.ndarray:
    """Non-local means: each pixel is the mean of those around it, weighted by how alike their patches are."""
    r, plain = search // 2, image.astype(float)
    padded, total, weight = np.pad(plain, r, mode="reflect" if min(image.shape) > r else "edge"), np.zeros(image.shape), np.zeros(image.shape)
    for dy in range(search):
        for dx in range(search):
            other = padded[dy : dy + image.shape[0], dx : dx + image.shape[1]]
            w = np.exp(-box((other - plain) ** 2, patch) / strength**2)
            total += w * other
            weight += w
    return np.rint(total / weight).astype(np.uint8)


def equalized(image: np.ndarray, limit: float = 2.0, tiles: int = 8) -> np.ndarray:
    """Local histogram equalisation with a contrast limit, linear between the middles of tiles."""
    h, w = image.shape
    ys, xs = np.linspace(0, h, tiles + 1).astype(int), np.linspace(0, w, tiles + 1).astype(int)
    maps = np.zeros((tiles, tiles, 256))
    for i in range(tiles):
        for j in range(tiles):
            tile = image[ys[i] : ys[i + 1], xs[j] : xs[j + 1]]
            counts = np.bincount(tile.ravel(), minlength=256).astype(float)
            top = max(1.0, limit * tile.size / 256)
            counts = np.minimum(counts, top) + np.maximum(counts - top, 0).sum() / 256
            maps[i, j] = 255 * counts.cumsum() / max(counts.sum(), 1)
    ty, tx = np.clip((np.arange(h) + 0.5) * tiles / h - 0.5, 0, tiles - 1), np.clip((np.arange(w) + 0.5) * tiles / w - 0.5, 0, tiles - 1)
    i, j = np.minimum(ty.astype(int), max(tiles - 2, 0)), np.minimum(tx.astype(int), max(tiles - 2, 0))
    fy, fx = (ty - i)[:, None], (tx - j)[None, :]
    at = lambda a, b: maps[(i + a)[:, None], (j + b)[None, :], image]
    return np.rint((at(0, 0) * (1 - fx) + at(0, 1) * fx) * (1 - fy) + (at(1, 0) * (1 - fx) + at(1, 1) * fx) * fy).astype(np.uint8)


def prepared_card(raw: bytes) -> bytes:
    """An identity card made ready: upright, wide enough, denoised, evened, black on white, sharp, without specks.

    A file that cannot be read is returned as it is.
    """
    try:
        image = deskewed(to_gray(frames(raw)[0]))
    except (ValueError, KeyError, IndexError, struct.error, zlib.error, TypeError):
        return raw
    image = scaled(image, LEAST_WIDTH / image.shape[1]) if image.shape[1] < LEAST_WIDTH else image
    image = equalized(denoised(image))
    image = np.where(image > gaussian(image, 11, 2.0) - 2, 255, 0).astype(np.uint8)
    image = np.clip(1.5 * image - 0.5 * gaussian(image, 5, 1.0), 0, 255).astype(np.uint8)
    eroded = np.minimum.reduce([np.roll(image, (a, b), (0, 1)) for a in (0, 1) for b in (0, 1)])
    return write_png(np.maximum.reduce([np.roll(eroded, (-a, -b), (0, 1)) for a in (0, 1) for b in (0, 1)]))


def prepared_invoice(image: np.ndarray) -> np.ndarray:
    """An invoice's page made ready: black on white at THRESHOLD, median of nine, without its outermost pixels."""
    black = np.where(to_gray(image) < THRESHOLD, 0, 255).astype(np.uint8)
    median = np.median(windows(black, 3), axis=(2, 3)).astype(np.uint8)
    h, w = median.shape
    return median[BORDER : h - BORDER, BORDER : w - BORDER] if min(h, w) > 2 * BORDER else median


def regions(image: np.ndarray) -> list[np.ndarray]:
    """The parts of a card that are read by themselves, enlarged: four of a tall page, four others of one that is wide."""
    h, w = image.shape[:2]
    chosen = (TALL_REGIONS if h / w > TALL else ()) + (WIDE_REGIONS if h / w < WIDE else ())
    out = []
    for x, y, width, height, factor in chosen:
        x, y = min(w - 1, round(w * x)), min(h - 1, round(h * y))
        part = to_gray(image)[y : y + max(1, round(h * height)), x : x + max(1, round(w * width))]
        out.append(scaled(part, factor))
    return out


def bands(image: np.ndarray) -> list[np.ndarray]:
    """Top, middle and bottom of a page."""
    a = int(image.shape[0] * BANDS[0])
    b = a + int(image.shape[0] * BANDS[1])
    return [image[:a], image[a:b], image[b:]]


def image_engine(engine: Callable[[np.ndarray], str]) -> Callable[[bytes], list[str]]:
    """An engine for files from one for single images: each frame is a page. A file that cannot be read is one blank page."""

    def read(raw: bytes) -> list[str]:
        try:
            pages = frames(raw)
        except (ValueError, KeyError, IndexError, struct.error, zlib.error, TypeError):
            pages = [np.full((1, 1), 255, dtype=np.uint8)]
        return [engine(p) for p in pages]

    return read
