"""Scalar functions of points: arrays of struct<x,y> as Column expressions, without UDFs.

Sums are left folds over the vertices, in their order.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def _folded(items: Column, step) -> Column:
    return F.aggregate(items, F.lit(0.0), step)


def nexts(points: Column) -> Column:
    """The following point of each, around the ring."""
    return F.concat(F.slice(points, 2, F.greatest(F.size(points) - 1, F.lit(0))), F.slice(points, 1, 1))


def edges(points: Column, closed: Column | bool = True) -> Column:
    """struct<a,b> of neighbouring points; with the closing edge if closed."""
    closed = F.lit(closed) if isinstance(closed, bool) else closed
    ring = F.zip_with(points, nexts(points), lambda a, b: F.struct(a.alias("a"), b.alias("b")))
    return F.when(closed, ring).otherwise(F.slice(ring, 1, F.greatest(F.size(points) - 1, F.lit(0))))


def point(x: Column, y: Column) -> Column:
    return F.struct(x.alias("x"), y.alias("y"))


def distance(a: Column, b: Column) -> Column:
    dx, dy = a["x"] - b["x"], a["y"] - b["y"]
    return F.sqrt(dx * dx + dy * dy)


def signed_area(points: Column) -> Column:
    """Each edge's cross product is worked out by itself and then added, as sums over a list are in SQL: where a half is rounded, another order gives another integer."""
    return _folded(edges(points), lambda s, e: s + (e["a"]["x"] * e["b"]["y"] - e["b"]["x"] * e["a"]["y"])) / 2


def area(points: Column) -> Column:
    return F.when(F.size(points) < 3, 0.0).otherwise(F.abs(signed_area(points)))


def length(points: Column, closed: Column | bool) -> Column:
    """Of a polyline; the closing edge counts if closed and over two points."""
    closed = F.lit(closed) if isinstance(closed, bool) else closed
    return _folded(edges(points, closed & (F.size(points) > 2)), lambda s, e: s + distance(e["a"], e["b"]))


def bounds(points: Column) -> Column:
    xs, ys = points["x"], points["y"]
    return F.struct(F.array_min(xs).alias("min_x"), F.array_min(ys).alias("min_y"), F.array_max(xs).alias("max_x"), F.array_max(ys).alias("max_y"))


def clockwise(points: Column) -> Column:
    """The ring turned so that the shoelace sum over the given points, without a closing edge, is not positive."""
    turn = _folded(edges(points, False), lambda s, e: s + (e["a"]["x"] * e["b"]["y"] - e["b"]["x"] * e["a"]["y"]))
    return F.when(turn > 0, F.reverse(points)).otherwise(points)


def angle(a: Column, b: Column) -> Column:
    return F.atan2(b["y"] - a["y"], b["x"] - a["x"])


def right_angle_remainder(a: Column) -> Column:
    """An angle modulo a quarter turn."""
    return F.pmod(a, F.lit(math.pi / 2))


def orientation(points: Column) -> Column:
    """Main direction modulo a quarter turn: the length-weighted mean of four times the edges' angles; edges under one are left out."""
    zero = F.struct(F.lit(0.0).alias("s"), F.lit(0.0).alias("c"))

    def step(acc, e):
        n, t = distance(e["a"], e["b"]), 4 * angle(e["a"], e["b"])
        w = F.when(n < 1, 0.0).otherwise(n)
        return F.struct((acc["s"] + w * F.sin(t)).alias("s"), (acc["c"] + w * F.cos(t)).alias("c"))

    return F.aggregate(edges(points), zero, step, lambda acc: right_angle_remainder(F.atan2(acc["s"], acc["c"]) / 4))


def segment_distance(p: Column, a: Column, b: Column) -> Column:
    """Of a point to a segment."""
    dx, dy = b["x"] - a["x"], b["y"] - a["y"]
    norm = dx * dx + dy * dy
    t = F.greatest(F.lit(0.0), F.least(F.lit(1.0), ((p["x"] - a["x"]) * dx + (p["y"] - a["y"]) * dy) / norm))
    return F.when(norm == 0, distance(p, a)).otherwise(distance(p, point(a["x"] + t * dx, a["y"] + t * dy)))


def intersection(a: Column, b: Column, c: Column, d: Column) -> Column:
    """Of two lines; null if they are all but parallel."""
    det = (a["x"] - b["x"]) * (c["y"] - d["y"]) - (a["y"] - b["y"]) * (c["x"] - d["x"])
    t = ((a["x"] - c["x"]) * (c["y"] - d["y"]) - (a["y"] - c["y"]) * (c["x"] - d["x"])) / det
    return F.when(F.abs(det) >= 1e-6, point(a["x"] + t * (b["x"] - a["x"]), a["y"] + t * (b["y"] - a["y"])))


def contains(points: Column, p: Column) -> Column:
    """Even-odd rule."""

    def crosses(e):
        a, b = e["a"], e["b"]
        return ((a["y"] > p["y"]) != (b["y"] > p["y"])) & (p["x"] < (b["x"] - a["x"]) * (p["y"] - a["y"]) / (b["y"] - a["y"]) + a["x"])

    return F.size(F.filter(edges(points), crosses)) % 2 == 1


def near(points: Column, p: Column, tolerance: float, closed: Column | bool = False) -> Column:
    """Whether any segment is within the tolerance."""
    return F.exists(edges(points, closed), lambda e: segment_distance(p, e["a"], e["b"]) <= tolerance)


def deduplicated(points: Column, least: float = 1.0) -> Column:
    """Without points nearer than ``least`` to the last one kept."""
    start = F.slice(points, 1, 1)
    return F.aggregate(F.slice(points, 2, F.greatest(F.size(points) - 1, F.lit(0))), start, lambda kept, p: F.when(distance(F.element_at(kept, -1), p) >= least, F.concat(kept, F.array(p))).otherwise(kept))


def without_collinear(points: Column, tolerance: float = 1.2) -> Column:
    """Without inner points within the tolerance of the segment from the last one kept to the next; the ends stay."""
    inner = F.slice(edges(points, False), 2, F.greatest(F.size(points) - 2, F.lit(0)))
    kept = F.aggregate(inner, F.slice(points, 1, 1), lambda out, e: F.when(segment_distance(e["a"], F.element_at(out, -1), e["b"]) > tolerance, F.concat(out, F.array(e["a"]))).otherwise(out))
    return F.when(F.size(points) <= 2, points).otherwise(F.concat(kept, F.slice(points, -1, 1)))


def affine(p: Column, m: list) -> Column:
    a, b, c, d, e, f = m
    return point(p["x"] * a + p["y"] * b + c, p["x"] * d + p["y"] * e + f)
