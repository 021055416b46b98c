"""Boxes: relative (0 to 1, double) and pixel (integer) geometry as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def right(x: Column, w: Column) -> Column:
    return x + w


def bottom(y: Column, h: Column) -> Column:
    return y + h


def middle(start: Column, size: Column) -> Column:
    return start + size / 2


def pixel_middle(start: Column, size: Column) -> Column:
    """Centre of a pixel box: halves are floored."""
    return start + F.floor(size / 2)


def area(w: Column, h: Column) -> Column:
    return w * h


def relative_box(x1: Column, y1: Column, x2: Column, y2: Column, width: Column, height: Column) -> dict[str, Column]:
    """Corners in pixels -> relative x, y, width, height; null for an image without extent."""
    return {"x": F.try_divide(x1, width), "y": F.try_divide(y1, height), "width": F.try_divide(x2 - x1, width), "height": F.try_divide(y2 - y1, height)}


def pixels(value: Column, size: Column) -> Column:
    """A relative length in whole pixels, truncated."""
    return (value * size).cast("int")


def clamped_box(x: Column, y: Column, w: Column, h: Column, width: Column, height: Column) -> dict[str, Column]:
    """A pixel box that lies in the image and has at least one pixel."""
    left = F.greatest(F.lit(0), F.least(pixels(x, width), width - 1))
    top = F.greatest(F.lit(0), F.least(pixels(y, height), height - 1))
    return {"px": left, "py": top, "pw": F.greatest(F.lit(1), F.least(pixels(w, width), width - left)), "ph": F.greatest(F.lit(1), F.least(pixels(h, height), height - top))}


def inside(x: Column, y: Column, w: Column, h: Column) -> Column:
    """Lenient validity: every part in [0, 1], and the box within the page."""
    parts = [c.between(0, 1) for c in (x, y, w, h)]
    return parts[0] & parts[1] & parts[2] & parts[3] & (x + w <= 1) & (y + h <= 1)


def valid(x: Column, y: Column, w: Column, h: Column) -> Column:
    """Strict validity: inside, and with an extent."""
    return inside(x, y, w, h) & (w > 0) & (h > 0)


def overlaps(a: dict[str, Column], b: dict[str, Column]) -> Column:
    """Boxes share more than an edge; a and b hold x, y, w, h."""
    return ~((a["x"] + a["w"] <= b["x"]) | (b["x"] + b["w"] <= a["x"]) | (a["y"] + a["h"] <= b["y"]) | (b["y"] + b["h"] <= a["y"]))


def tenths(x: Column, w: Column) -> Column:
    """The tenths of the page's width that a header reaches over, as an array."""
    return F.sequence((x * 10).cast("int"), ((x + w) * 10).cast("int"))


def large(w: Column, h: Column, most: int = 10000) -> Column:
    """Whether a box counts as large: its area times 100 over most (never so for relative boxes)."""
    return w * h * 100 > most


def aspect(width: Column, height: Column) -> Column:
    return F.try_divide(width, height)
