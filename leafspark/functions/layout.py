"""Typography and layout arithmetic: outlines, spacing, sizes, scores of candidate layouts, gamma."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .bind import bound

#: Presets (name, align, padding, line spacing, widest outline), page sizes and score weights.
PRESETS = (("bubble", "center", 0.12, 1.22, 3), ("narbox", "left", 0.08, 1.18, 2), ("thought", "center", 0.14, 1.22, 3))
FONT_MIN, FONT_MAX = 9, 42
WEIGHTS = {"balance": 0.25, "coverage": 0.20, "font_size": 0.20, "edge_safety": 0.20, "orphan": 0.15}


def _d(x) -> Column:
    return F.lit(float(x))


def outline_width(font_size: Column, most: Column | int = 3, least: int = 1) -> Column:
    """From `most` at 12 px linearly to `least` at 28 px, halves to even."""
    most = most if isinstance(most, Column) else F.lit(most)
    between = F.bround(most - (font_size - 12) / _d(16) * (most - least)).cast("int")
    return F.when(font_size <= 12, most).when(font_size >= 28, F.lit(least)).otherwise(F.greatest(F.lit(least), between)).cast("int")


def line_spacing(font_size: Column, base: Column | float = 1.22) -> Column:
    base = base if isinstance(base, Column) else _d(base)
    return F.when(font_size <= 12, base * _d(1.15)).when(font_size >= 28, base * _d(0.95)).otherwise(base)


def measure_block(lines: Column, widths: Column, default: Column | int, line_height: Column, spacing: Column | float = 1.22) -> Column:
    """Struct of the widest line and the height of all, from a map of characters to widths."""
    default = default if isinstance(default, Column) else F.lit(default)
    spacing = spacing if isinstance(spacing, Column) else _d(spacing)
    width = lambda t: F.aggregate(F.split(t, ""), F.lit(0).cast("int"), lambda a, c: a + F.when(c == "", 0).otherwise(F.coalesce(F.try_element_at(widths, c), default)).cast("int"))
    widest = F.coalesce(F.array_max(F.transform(lines, width)), F.lit(0))
    return F.struct(widest.alias("width"), ((line_height * spacing).cast("int") * F.size(lines)).alias("height"))


def resize_factor(width: Column, height: Column, longest: int = 2560) -> Column:
    """Factor that brings the longer side down to `longest`; never above 1."""
    side = F.greatest(width, height)
    return F.when(side > longest, _d(longest) / side).otherwise(_d(1))


def unscale(v: Column, factor: Column) -> Column:
    return (v / factor).cast("int")


def pad_to(size: Column, unit: int = 8) -> Column:
    """Pixels that are missing to a multiple of unit."""
    return F.pmod(F.lit(unit) - F.pmod(size, F.lit(unit)), F.lit(unit))


def round_to(size: Column, unit: int = 32) -> Column:
    """Nearest multiple of unit, halves to even, unit at least."""
    return F.greatest(F.lit(unit), (F.bround(size / _d(unit)) * unit).cast("int"))


def text_position(safe_low: Column, safe_high: Column, size: Column) -> Column:
    """Start of a centred stretch, not before the safe box."""
    return F.greatest(safe_low, F.least(safe_low + F.floor((safe_high - safe_low - size) / 2).cast("int"), F.greatest(safe_low, safe_high - size)))


def to_linear(v: Column) -> Column:
    """sRGB (0..1) to linear light."""
    return F.when(v <= 0.04045, v / _d(12.92)).otherwise(F.pow((v + _d(0.055)) / _d(1.055), _d(2.4)))


def to_srgb(v: Column) -> Column:
    return F.when(v <= 0.0031308, v * _d(12.92)).otherwise(_d(1.055) * F.pow(v, _d(1 / 2.4)) - _d(0.055))


def blend_linear(over: Column, under: Column, alpha: Column) -> Column:
    """Alpha blend of sRGB values in linear light."""
    return to_srgb(to_linear(over) * alpha + to_linear(under) * (_d(1) - alpha))


def _clip(x: Column) -> Column:
    return F.greatest(_d(0), F.least(_d(1), x))


def line_balance(lines: Column) -> Column:
    """Middle lines longest is best; one line is fine."""
    n = F.size(lines)
    length = lambda at: F.length(F.get(lines, at))

    def score(longest: Column) -> Column:
        share = lambda at: length(at) / longest.cast("double")
        middle = F.floor(n / 2).cast("int")
        bonus = F.when(length(middle) == longest, share(middle)).otherwise(share(middle) * _d(0.8))
        edges = (length(F.lit(0)) < length(middle)) & (length(n - 1) < length(middle))
        mean = (share(F.lit(0)) + share(F.lit(1))) / 2
        return F.when(n <= 1, _d(0.85)).when(longest == 0, _d(0.5)).otherwise(_clip(F.when(n >= 3, bonus * F.when(edges, _d(1.1)).otherwise(_d(0.85))).otherwise(mean)))

    return bound(F.array_max(F.transform(lines, lambda t: F.length(t))), score)


def coverage_score(share: Column) -> Column:
    return (
        F.when(share < 0.25, share / _d(0.25) * _d(0.6)).when(share <= 0.78, _d(0.8) + (share - _d(0.25)) / _d(0.53) * _d(0.2))
        .otherwise(F.greatest(_d(0), _d(1) - (share - _d(0.78)) * _d(3)))
    )


def edge_safety(width: Column, height: Column, safe_width: Column, safe_height: Column) -> Column:
    worst = F.greatest(width / F.greatest(safe_width, F.lit(1)).cast("double"), height / F.greatest(safe_height, F.lit(1)).cast("double"))
    return F.when((safe_width <= 0) | (safe_height <= 0), _d(0.5)).when(worst <= 0.85, _d(1)).when(worst <= 1.0, _d(1) - (worst - _d(0.85)) * _d(6)).otherwise(_d(0))


def orphan_score(lines: Column) -> Column:
    n, last = F.size(lines), F.trim(F.element_at(lines, -1))
    mean = F.aggregate(F.slice(lines, F.lit(1), F.greatest(n - 1, F.lit(0))), F.lit(0), lambda a, t: a + F.length(t)) / F.greatest(n - 1, F.lit(1)).cast("double")
    return (
        F.when(n == 0, _d(0.5)).when(n == 1, _d(0.9)).when(last == "", _d(0.5)).when((F.size(F.split(last, " +")) == 1) & (n > 2), _d(0.3))
        .when((mean > 0) & (F.length(last) / mean < 0.25), _d(0.5)).otherwise(_d(1))
    )


def layout_score(lines: Column, width: Column, height: Column, font_size: Column, safe_width: Column, safe_height: Column) -> Column:
    """0..1: weighted sum of balance, coverage, font size, distance from the edge and orphans."""
    return bound(lines, lambda once: _layout_score(once, width, height, font_size, safe_width, safe_height))


def _layout_score(lines: Column, width: Column, height: Column, font_size: Column, safe_width: Column, safe_height: Column) -> Column:
    share = (width * height) / F.greatest(safe_width * safe_height, F.lit(1)).cast("double")
    parts = {
        "balance": line_balance(lines), "coverage": coverage_score(share), "font_size": (font_size - FONT_MIN) / _d(FONT_MAX - FONT_MIN),
        "edge_safety": edge_safety(width, height, safe_width, safe_height), "orphan": orphan_score(lines),
    }
    total = None
    for name, weight in WEIGHTS.items():
        total = _d(weight) * parts[name] if total is None else total + _d(weight) * parts[name]
    return _clip(total)


def largest_font(fits, low: int = FONT_MIN, high: int = FONT_MAX) -> Column:
    """Largest size in low..high that a binary search with the predicate finds, else low; as with any binary search a
    predicate that isn't monotone may hide larger sizes that fit."""
    steps = F.sequence(F.lit(1), F.lit((high - low + 1).bit_length() + 1))
    start = F.struct(F.lit(low).alias("lo"), F.lit(high).alias("hi"), F.lit(low).alias("best"))

    def step(s: Column, _: Column) -> Column:
        mid = F.floor((s["lo"] + s["hi"]) / 2).cast("int")
        ok = fits(mid)
        go = s["lo"] <= s["hi"]
        return F.when(~go, s).otherwise(F.struct(F.when(ok, mid + 1).otherwise(s["lo"]).alias("lo"), F.when(ok, s["hi"]).otherwise(mid - 1).alias("hi"), F.when(ok, mid).otherwise(s["best"]).alias("best")))

    return F.aggregate(steps, start, step)["best"]
