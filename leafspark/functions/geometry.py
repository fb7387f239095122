"""Box and polygon arithmetic as column expressions. Boxes are four columns x1, y1, x2, y2 (pixels, x2 and y2 exclusive)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

BOX = ("x1", "y1", "x2", "y2")


def _c(x: Column | str | float | int) -> Column:
    return F.col(x) if isinstance(x, str) else x if isinstance(x, Column) else F.lit(x)


def field(box: Column, name: str) -> Column:
    return box[name]


def area(b: Column) -> Column:
    return (b["x2"] - b["x1"]) * (b["y2"] - b["y1"])


def intersection(a: Column, b: Column) -> Column:
    """Area that two box structs share."""
    w = F.least(a["x2"], b["x2"]) - F.greatest(a["x1"], b["x1"])
    h = F.least(a["y2"], b["y2"]) - F.greatest(a["y1"], b["y1"])
    return F.greatest(w, F.lit(0)) * F.greatest(h, F.lit(0))


def iou(a: Column, b: Column) -> Column:
    inter = intersection(a, b)
    return F.when(inter == 0, F.lit(0.0)).otherwise(inter.cast("double") / F.greatest(area(a) + area(b) - inter, F.lit(1)))


def overlap_ratio(a: Column, b: Column) -> Column:
    """Shared area over the smaller box's."""
    inter = intersection(a, b)
    return F.when(inter == 0, F.lit(0.0)).otherwise(inter.cast("double") / F.greatest(F.least(area(a), area(b)), F.lit(1)))


def gap(a: Column, b: Column, low: str, high: str) -> Column:
    """Distance along one axis, 0 where the boxes meet or overlap there."""
    return F.greatest(F.lit(0), F.greatest(a[low], b[low]) - F.least(a[high], b[high]))


def adjacent(a: Column, b: Column, gap_px: Column | int, least_overlap: float = 0.05) -> Column:
    """Whether two boxes belong to one panel: they overlap, or lie within gap_px in a shared row, column or corner."""
    h, v, g = gap(a, b, "x1", "x2"), gap(a, b, "y1", "y2"), _c(gap_px)
    x_meets = F.least(a["x2"], b["x2"]) > F.greatest(a["x1"], b["x1"])
    y_meets = F.least(a["y2"], b["y2"]) > F.greatest(a["y1"], b["y1"])
    return (overlap_ratio(a, b) > least_overlap) | (x_meets & (v <= g)) | (y_meets & (h <= g)) | ((h <= g) & (v <= g))


def panel_gap(width: Column | int, height: Column | int, ratio: float = 0.04) -> Column:
    return F.greatest(F.floor(F.least(_c(width), _c(height)) * F.lit(ratio)).cast("int"), F.lit(8))


def _clip_axis(low: Column, high: Column, size: Column, least: int) -> tuple[Column, Column]:
    """Clamped ends of one axis, widened to `least` to the right, else to the left, else from 0."""
    a = F.greatest(F.lit(0), F.floor(low)).cast("int")
    b = F.least(size, F.ceil(high)).cast("int")
    narrow, right, left = b - a < least, a + least <= size, b - least >= 0
    start = F.when(narrow & ~right & left, b - least).when(narrow & ~right, F.lit(0)).otherwise(a)
    end = F.when(narrow & right, a + least).when(narrow & ~left, F.least(size, F.lit(least))).otherwise(b)
    return start, end


def clip_box(x1: Column, y1: Column, x2: Column, y2: Column, width: Column | int, height: Column | int, scale_x: float = 1.0, scale_y: float = 1.0, least: int = 8) -> list[Column]:
    """Model coordinates as page pixels: scaled outwards, clamped to the page, at least `least` wide and high."""
    sx, sy = F.lit(float(scale_x)), F.lit(float(scale_y))
    a, c = _clip_axis(x1 * sx, x2 * sx, _c(width).cast("int"), least)
    b, d = _clip_axis(y1 * sy, y2 * sy, _c(height).cast("int"), least)
    return [a.alias("x1"), b.alias("y1"), c.alias("x2"), d.alias("y2")]


def box_status(x1: Column, y1: Column, x2: Column, y2: Column, width: Column | int, height: Column | int, tiny: int = 4) -> Column:
    """INVALID for a box that is empty after clamping, TINY for a side below `tiny`, else OK."""
    clamp = lambda v, most: F.greatest(F.lit(0), F.least(v, _c(most)))
    w, h = clamp(x2, width) - clamp(x1, width), clamp(y2, height) - clamp(y1, height)
    return F.when((w <= 0) | (h <= 0), "INVALID").when((w < tiny) | (h < tiny), "TINY").otherwise("OK")


def polygon_box(points: Column) -> list[Column]:
    """Enclosing box of an array of points {x, y}."""
    xs, ys = F.transform(points, lambda p: p["x"]), F.transform(points, lambda p: p["y"])
    low, high = lambda v: F.floor(F.array_min(v)).cast("int"), lambda v: F.ceil(F.array_max(v)).cast("int")
    return [low(xs).alias("x1"), low(ys).alias("y1"), high(xs).alias("x2"), high(ys).alias("y2")]


def rotation(points: Column) -> Column:
    """Angle of the first edge in degrees; 0 for an edge without length, or fewer than two points."""
    dx, dy = F.get(points, 1)["x"] - F.get(points, 0)["x"], F.get(points, 1)["y"] - F.get(points, 0)["y"]
    return F.when((F.size(points) >= 2) & ((F.abs(dx) > 1e-3) | (F.abs(dy) > 1e-3)), F.degrees(F.atan2(dy, dx))).otherwise(0.0)


def line_height(points: Column) -> Column:
    """Mean length of the left and right sides of a quad; of other polygons the height of the box."""
    side = lambda i, j: F.hypot(F.get(points, i)["x"] - F.get(points, j)["x"], F.get(points, i)["y"] - F.get(points, j)["y"])
    box = polygon_box(points)
    return F.when(F.size(points) >= 4, (side(3, 0) + side(2, 1)) / 2).otherwise((box[3] - box[1]).cast("double"))


def order_quad(points: Column) -> Column:
    """Corners from the top left clockwise: by the least and greatest x + y, and y - x; of ties the first."""
    pick = lambda key, sign: F.array_min(F.transform(points, lambda p, i: F.struct((F.lit(sign) * key(p)).alias("k"), i.alias("i"), p.alias("p"))))["p"]
    total, slope = lambda p: p["x"] + p["y"], lambda p: p["y"] - p["x"]
    return F.array(pick(total, 1), pick(slope, 1), pick(total, -1), pick(slope, -1))


def unclip(w: Column, h: Column, ratio: float = 1.6) -> list[Column]:
    """Width and height of a rectangle that grows by area * ratio / perimeter on every side."""
    move = w * h * F.lit(ratio) / F.greatest(2 * (w + h), F.lit(1e-6))
    return [(w + 2 * move).alias("w"), (h + 2 * move).alias("h")]


def shape_class(aspect: Column, fill: Column, corners: Column) -> Column:
    """Outline class from width over height, filled share and number of corners (null: no polygon)."""
    return (
        F.when(aspect < 0.55, "TALL").when(aspect > 2.2, "WIDE").when((fill > 0.90) & (aspect > 0.8) & (corners <= 6), "RECTANGLE")
        .when(fill < 0.65, "IRREGULAR").when(corners > 12, "IRREGULAR").otherwise("ELLIPSE")
    )


def safe_box(shape: Column, x1: Column, y1: Column, x2: Column, y2: Column, padding: float = 0.12, least: int = 6) -> list[Column]:
    """The part of a box where text may stand; margins are wider in ellipses and, across, in tall shapes."""
    share_x = F.when(shape == "ELLIPSE", max(padding, 0.18)).when(shape == "TALL", padding + 0.05).otherwise(padding)
    share_y = F.when(shape == "ELLIPSE", max(padding, 0.15)).otherwise(padding)
    px = F.greatest(F.lit(least), ((x2 - x1) * share_x).cast("int"))
    py = F.greatest(F.lit(least), ((y2 - y1) * share_y).cast("int"))
    return [(x1 + px).alias("sx1"), (y1 + py).alias("sy1"), (x2 - px).alias("sx2"), (y2 - py).alias("sy2")]


def norm_to_pixel(value: Column, size: Column | int) -> Column:
    """A coordinate of 0..1000 in pixels, cut off."""
    return ((value / F.lit(1000.0)) * _c(size)).cast("int")
