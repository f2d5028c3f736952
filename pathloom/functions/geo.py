"""Points, boxes, grid cells and normalisers as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Metres.
EARTH_RADIUS = 6378137.0


def finite(v: Column) -> Column:
    """Whether a number is there, and neither NaN nor infinite."""
    return F.coalesce(~F.isnan(v.cast("double")) & (F.abs(v.cast("double")) != float("inf")), F.lit(False))


def placed_points(points: Column) -> Column:
    """Those points of an array that have a place; null points have none."""
    return F.filter(points, lambda p: finite(p["x"]) & finite(p["y"]))


def euclid(x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    return F.sqrt((x1 - x2) * (x1 - x2) + (y1 - y2) * (y1 - y2))


def haversine(lon1: Column, lat1: Column, lon2: Column, lat2: Column) -> Column:
    """Metres between two points in degrees."""
    a, b = F.radians(lat1), F.radians(lat2)
    s, t = F.sin((a - b) / 2), F.sin((F.radians(lon1) - F.radians(lon2)) / 2)
    return F.lit(2 * EARTH_RADIUS) * F.asin(F.sqrt(s * s + F.cos(a) * F.cos(b) * t * t))


BOX = ("min_x", "min_y", "max_x", "max_y")


def box(side: str = "") -> dict[str, Column]:
    """The columns of a box, by name; ``side`` is a prefix such as ``q_``."""
    return {n: F.col(f"{side}{n}") for n in BOX}


def diagonal(b: dict[str, Column]) -> Column:
    """Length of a box's diagonal; an empty box (null corners) has 0."""
    return F.coalesce(euclid(b["min_x"], b["min_y"], b["max_x"], b["max_y"]), F.lit(0.0))


def area(b: dict[str, Column]) -> Column:
    return F.coalesce((b["max_x"] - b["min_x"]) * (b["max_y"] - b["min_y"]), F.lit(0.0))


def union(a: dict[str, Column], b: dict[str, Column]) -> dict[str, Column]:
    """The smallest box around both; empty boxes add nothing."""
    return {n: (F.least if n.startswith("min") else F.greatest)(a[n], b[n]) for n in BOX}


def include(a: dict[str, Column], x: Column, y: Column) -> dict[str, Column]:
    return union(a, {"min_x": x, "min_y": y, "max_x": x, "max_y": y})


def box_distance(a: dict[str, Column], b: dict[str, Column]) -> Column:
    """The least distance between points of two boxes; 0 if they meet."""
    zero = F.lit(0.0)
    dx = F.greatest(zero, a["min_x"] - b["max_x"], b["min_x"] - a["max_x"])
    dy = F.greatest(zero, a["min_y"] - b["max_y"], b["min_y"] - a["max_y"])
    return F.sqrt(dx * dx + dy * dy)


def point_box_distance(x: Column, y: Column, b: dict[str, Column]) -> Column:
    return box_distance({"min_x": x, "min_y": y, "max_x": x, "max_y": y}, b)


def cell(v: Column, size: float) -> Column:
    """Grid index of a coordinate, 32-bit as grids are."""
    return F.floor(v / F.lit(float(size))).cast("int")


def cell_distance(cx1: Column, cy1: Column, cx2: Column, cy2: Column) -> Column:
    """The least distance between two cells, in cells."""
    apart = lambda u, v: F.greatest(F.lit(0.0), F.abs(u.cast("double") - v.cast("double")) - 1)
    dx, dy = apart(cx1, cx2), apart(cy1, cy2)
    return F.sqrt(dx * dx + dy * dy)


def sigmoid(d: Column, gamma: float) -> Column:
    """Closeness of a distance: 1 at 0, 0 at infinity."""
    return F.lit(2.0) - F.lit(2.0) / (F.lit(1.0) + F.exp(-F.lit(float(gamma)) * d))


def identity(d: Column, gamma: float = 0.0) -> Column:
    return d


def _summed(products: Column) -> Column:
    return F.aggregate(products, F.lit(0.0), lambda a, x: a + x)


def dot(u: Column, v: Column) -> Column:
    return _summed(F.zip_with(u, v, lambda a, b: a.cast("double") * b.cast("double")))


def l2(u: Column, v: Column) -> Column:
    return F.sqrt(_summed(F.zip_with(u, v, lambda a, b: (a.cast("double") - b.cast("double")) * (a.cast("double") - b.cast("double")))))


def cosine_distance(u: Column, v: Column) -> Column:
    """1 - cosine; null if either vector has length 0."""
    return F.lit(1.0) - dot(u, v) / F.nullif(F.sqrt(dot(u, u) * dot(v, v)), F.lit(0.0))


def difference(a: Column, b: Column) -> Column:
    """How far two distances are apart, for the triangle inequality."""
    return F.abs(a - b)
