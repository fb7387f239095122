"""Pixel kernels in numpy: masks, fills, feathering, blending, composing. Images are float arrays of height x width."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import ArrowUDFType


def box_mask(height: int, width: int, box: tuple[int, int, int, int], padding: int = 0) -> np.ndarray:
    """255 inside the padded and clamped box; all 0 if nothing is left of it."""
    mask = np.zeros((height, width), np.uint8)
    x1, y1, x2, y2 = max(0, box[0] - padding), max(0, box[1] - padding), min(width, box[2] + padding), min(height, box[3] + padding)
    if x2 > x1 and y2 > y1:
        mask[y1:y2, x1:x2] = 255
    return mask


def combine(*masks: np.ndarray) -> np.ndarray:
    return np.maximum.reduce(masks)


def gaussian(image: np.ndarray, radius: int) -> np.ndarray:
    """Separable blur with 2 * radius + 1 taps and a deviation of half the radius; borders are reflected."""
    if radius <= 0:
        return image.astype(float)
    x = np.arange(-radius, radius + 1)
    taps = np.exp(-(x**2) / (2 * (radius / 2) ** 2))
    taps /= taps.sum()
    out = image.astype(float)
    for axis in (0, 1):
        pad = [(0, 0), (0, 0)]
        pad[axis] = (radius, radius)
        wide = np.pad(out, pad, mode="reflect" if out.shape[axis] > radius else "edge")
        out = sum(t * np.take(wide, np.arange(k, k + out.shape[axis]), axis=axis) for k, t in enumerate(taps))
    return out


def feather(mask: np.ndarray, radius: int) -> np.ndarray:
    """A mask's soft edge, 0..1."""
    return np.clip(gaussian(mask, radius) / 255.0, 0, 1)


def distance_field(mask: np.ndarray) -> np.ndarray:
    """Straight-line distance of every set pixel from the nearest unset one: first along columns, then the least sum of
    squares along rows. Without an unset pixel, height + width."""
    h, w = mask.shape
    far = float(h + w)
    d = np.where(mask > 0, far, 0.0)
    for y in range(1, h):
        d[y] = np.minimum(d[y], d[y - 1] + 1)
    for y in range(h - 2, -1, -1):
        d[y] = np.minimum(d[y], d[y + 1] + 1)
    squares, steps, out = d * d, np.arange(w), np.full((h, w), far * far)
    for x in range(w):
        out = np.minimum(out, squares[:, x : x + 1] + (steps - x) ** 2)
    return np.minimum(np.sqrt(out), far)


def border_median(image: np.ndarray, border: int) -> float:
    """Median of the four strips along the edges."""
    b = min(border, *image.shape)
    strips = [image[:b].ravel(), image[-b:].ravel(), image[:, :b].ravel(), image[:, -b:].ravel()]
    return float(np.median(np.concatenate(strips)))


def background(image: np.ndarray, mask: np.ndarray | None = None, border: int = 12, least: int = 20) -> float:
    """Median outside the mask if more than `least` pixels are there, else of the border, else white."""
    if image.size == 0:
        return 1.0
    outside = image[mask == 0] if mask is not None else np.zeros(0)
    return float(np.median(outside)) if outside.size > least else border_median(image, border)


def is_simple(image: np.ndarray, white: float = 0.92, spread: float = 0.07) -> bool:
    return bool(np.mean(image >= 0.9) >= white or image.std() < spread)


def fill(image: np.ndarray, mask: np.ndarray, value: float, smooth: int = 1) -> np.ndarray:
    """The masked area in one value, its border blended softly with what was there."""
    soft = np.maximum(feather(mask, smooth), mask / 255.0)
    return image * (1 - soft) + value * soft


def blend(under: np.ndarray, over: np.ndarray, alpha: np.ndarray) -> np.ndarray:
    return under * (1 - alpha) + over * alpha


def _linear(v: np.ndarray) -> np.ndarray:
    return np.where(v <= 0.04045, v / 12.92, ((v + 0.055) / 1.055) ** 2.4)


def _srgb(v: np.ndarray) -> np.ndarray:
    return np.where(v <= 0.0031308, v * 12.92, 1.055 * np.maximum(v, 0) ** (1 / 2.4) - 0.055)


def blend_linear(under: np.ndarray, over: np.ndarray, alpha: np.ndarray) -> np.ndarray:
    return _srgb(_linear(under) * (1 - alpha) + _linear(over) * alpha)


def similarity(a: np.ndarray, b: np.ndarray) -> float:
    return 0.0 if a.shape != b.shape or not a.size else float(1 / (1 + 100 * np.mean((a - b) ** 2)))


def compose(original: np.ndarray, patch: np.ndarray, preserve: float = 0.98, least: float = 0.015, radius: int = 2) -> tuple[np.ndarray, bool]:
    """The original where the patch hardly differs, else a feathered blend where it does; and whether it was kept."""
    if similarity(original, patch) >= preserve:
        return original, True
    mask = (np.abs(original - patch) > least).astype(np.uint8) * 255
    return blend_linear(original, patch, feather(mask, radius)), False


def grain(shape: tuple[int, int], strength: float, seed: int) -> np.ndarray:
    return np.random.default_rng(seed).normal(0, strength, shape)


def ellipse(size: int) -> np.ndarray:
    """Offsets (dy, dx) of a round structuring element of size x size."""
    r = (size - 1) / 2
    ys, xs = np.mgrid[0:size, 0:size]
    inside = (ys - r) ** 2 + (xs - r) ** 2 <= (size / 2) ** 2
    return np.argwhere(inside) - size // 2


def dilate(mask: np.ndarray, size: int) -> np.ndarray:
    """Every set pixel spread over the element; erosion is the same on the inverted mask."""
    h, w = mask.shape
    pad = size
    wide = np.zeros((h + 2 * pad, w + 2 * pad), mask.dtype)
    wide[pad : pad + h, pad : pad + w] = mask
    out = np.zeros_like(mask)
    for dy, dx in ellipse(size):
        np.maximum(out, wide[pad - dy : pad - dy + h, pad - dx : pad - dx + w], out=out)
    return out


def close(mask: np.ndarray, size: int, times: int = 1) -> np.ndarray:
    """Gaps narrower than the element are filled; the image is taken to go on beyond its edges when eroding."""
    out = mask
    for _ in range(times):
        out = dilate(out, size)
    for _ in range(times):
        out = 255 - dilate(255 - out, size)
    return out


def text_mask(grey: np.ndarray, box: tuple[int, int, int, int], dilation: int = 12, extra: int = 6, block: int = 13, offset: float = 7.0) -> np.ndarray:
    """Mask (0 or 255) of dark text in a box of a page of grey values 0..255: darker than a weighted local mean by
    `offset`, gaps closed, then spread twice, so soft edges are covered."""
    h, w = grey.shape
    full = np.zeros((h, w), np.uint8)
    x1, y1, x2, y2 = max(0, box[0]), max(0, box[1]), min(w, box[2]), min(h, box[3])
    if x2 <= x1 or y2 <= y1:
        return full
    part = grey[y1:y2, x1:x2].astype(float)
    mask = np.where(part <= gaussian(part, block // 2) - offset, 255, 0).astype(np.uint8)
    mask = dilate(close(mask, dilation, 2), dilation)
    full[y1:y2, x1:x2] = dilate(mask, extra) if extra > 0 else mask
    return full


def regions(scores: np.ndarray, threshold: float, least_area: int = 10) -> list[tuple[int, int, int, int]]:
    """Boxes (x1, y1, x2, y2) of 8-connected areas above the threshold, larger than least_area, in order of their first
    pixel. Rows are joined run by run, so cost grows with the runs."""
    label: list[int] = []

    def root(k: int) -> int:
        while label[k] != k:
            label[k] = label[label[k]]
            k = label[k]
        return k

    runs, before = [], []
    for y, row in enumerate(scores > threshold):
        edge = np.flatnonzero(np.diff(row.astype(np.int8), prepend=0, append=0))
        now = []
        for a, b in zip(edge[::2].tolist(), edge[1::2].tolist()):
            k = len(label)
            label.append(k)
            for c, d, j in before:
                if c <= b and a <= d:
                    x, z = root(k), root(j)
                    label[max(x, z)] = min(x, z)
            now.append((a, b, k))
            runs.append((y, a, b, k))
        before = now
    boxes: dict[int, list[int]] = {}
    for y, a, b, k in runs:
        box = boxes.setdefault(root(k), [a, y, b, y + 1, 0])
        box[:] = [min(box[0], a), min(box[1], y), max(box[2], b), max(box[3], y + 1), box[4] + b - a]
    return [tuple(b[:4]) for _, b in sorted(boxes.items()) if b[4] >= least_area]


def text_boxes(scores: np.ndarray, threshold: float, scale_x: float, scale_y: float, width: int, height: int, ratio: float = 1.6, least_area: int = 10) -> list[tuple[float, float, float, float]]:
    """Regions of a detector's score map, grown by area * ratio / perimeter on every side, in page pixels."""
    out = []
    for x1, y1, x2, y2 in regions(scores, threshold, least_area):
        w, h = x2 - x1, y2 - y1
        d = w * h * ratio / max(2 * (w + h), 1)
        clip = lambda v, most: float(min(max(v, 0), most - 1))
        out.append((clip((x1 - d) * scale_x, width), clip((y1 - d) * scale_y, height), clip((x2 + d) * scale_x, width), clip((y2 + d) * scale_y, height)))
    return out


def resize(image: np.ndarray, height: int, width: int) -> np.ndarray:
    """Bilinear, pixel centres aligned."""
    ys = np.clip((np.arange(height) + 0.5) * image.shape[0] / height - 0.5, 0, image.shape[0] - 1)
    xs = np.clip((np.arange(width) + 0.5) * image.shape[1] / width - 0.5, 0, image.shape[1] - 1)
    y0, x0 = np.floor(ys).astype(int), np.floor(xs).astype(int)
    y1, x1 = np.minimum(y0 + 1, image.shape[0] - 1), np.minimum(x0 + 1, image.shape[1] - 1)
    fy, fx = (ys - y0)[:, None], (xs - x0)[None, :]
    top = image[np.ix_(y0, x0)] * (1 - fx) + image[np.ix_(y0, x1)] * fx
    low = image[np.ix_(y1, x0)] * (1 - fx) + image[np.ix_(y1, x1)] * fx
    return top * (1 - fy) + low * fy


def recogniser_input(crop: np.ndarray, height: int = 48, least: int = 32, most: int = 1200) -> np.ndarray:
    """A crop of grey values 0..255 at the recogniser's height, width bounded, scaled to -1..1."""
    width = int(min(max(round(crop.shape[1] * height / max(crop.shape[0], 1)), least), most))
    return normalise(resize(crop.astype(float), height, width) / 255.0, 0.5, 0.5)


def order_points(points: np.ndarray) -> np.ndarray:
    """A quad's corners from the top left clockwise."""
    total, slope = points.sum(axis=1), points[:, 1] - points[:, 0]
    return points[[total.argmin(), slope.argmin(), total.argmax(), slope.argmax()]]


def perspective_crop(image: np.ndarray, quad: np.ndarray, least: int = 4) -> np.ndarray | None:
    """The quad's content as a rectangle (nearest pixels); None for a side below `least`."""
    q = order_points(np.asarray(quad, float))
    side = lambda i, j: float(np.hypot(*(q[i] - q[j])))
    w, h = int(round(max(side(0, 1), side(3, 2)))), int(round(max(side(0, 3), side(1, 2))))
    if w < least or h < least:
        return None
    corners = np.array([[0, 0], [w - 1, 0], [w - 1, h - 1], [0, h - 1]], float)
    rows, values = [], []
    for (x, y), (u, v) in zip(corners, q):
        rows += [[x, y, 1, 0, 0, 0, -u * x, -u * y], [0, 0, 0, x, y, 1, -v * x, -v * y]]
        values += [u, v]
    m = np.append(np.linalg.solve(np.array(rows), np.array(values)), 1).reshape(3, 3)
    ys, xs = np.mgrid[0:h, 0:w]
    at = m @ np.stack([xs.ravel(), ys.ravel(), np.ones(w * h)])
    u, v = np.rint(at[:2] / at[2]).astype(int)
    return image[np.clip(v, 0, image.shape[0] - 1), np.clip(u, 0, image.shape[1] - 1)].reshape(h, w)


def normalise(image: np.ndarray, mean: float, deviation: float) -> np.ndarray:
    return (image - mean) / deviation


def _each(work, kind: str, column: str):
    """An Arrow function that maps every 8 x 8 tile (64 values) to a struct; null for other sizes."""

    def run(tiles: pa.Array) -> pa.Array:
        rows = []
        for t in tiles.to_pylist():
            rows.append(work(1 / (1 + np.exp(-np.array(t, float).reshape(8, 8)))) if t is not None and len(t) == 64 else None)
        return pa.array(rows, type_)

    from pyspark.sql.pandas.types import to_arrow_type
    from pyspark.sql.types import StructType

    schema = StructType.fromDDL(kind)
    type_ = to_arrow_type(schema)
    return F.arrow_udf(run, schema, ArrowUDFType.SCALAR)(column)


def tile_features(tiles: DataFrame) -> DataFrame:
    """Each tile's masked centre filled with its background: sums in millionths, and whether the tile is of one colour."""

    def work(t: np.ndarray) -> dict:
        mask = box_mask(8, 8, (2, 2, 6, 6), 1)
        out = fill(t, mask, background(t, mask, 1))
        return {"filled": int(out.sum() * 1e6), "depth": int(distance_field(mask).max()), "simple": is_simple(t)}

    return tiles.select("vec_id", _each(work, "filled bigint, depth int, simple boolean", "embedding").alias("r")).select("vec_id", "r.*")


def compose_features(tiles: DataFrame) -> DataFrame:
    """Each tile composed with its mirror image: sums in millionths, and whether it was kept."""

    def work(t: np.ndarray) -> dict:
        out, kept = compose(t, t[:, ::-1])
        return {"composed": int(out.sum() * 1e6), "kept": kept}

    return tiles.select("vec_id", _each(work, "composed bigint, kept boolean", "embedding").alias("r")).select("vec_id", "r.*")
