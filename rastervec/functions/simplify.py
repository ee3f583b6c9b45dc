"""Point reduction that depends on order or recursion: small helpers over one feature, in Arrow batches."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from rastervec.schema import POINT


def segment_distance(p, a, b) -> float:
    dx, dy = b[0] - a[0], b[1] - a[1]
    norm = dx * dx + dy * dy
    if norm == 0:
        return math.sqrt((p[0] - a[0]) ** 2 + (p[1] - a[1]) ** 2)
    t = max(0.0, min(1.0, ((p[0] - a[0]) * dx + (p[1] - a[1]) * dy) / norm))
    ex, ey = p[0] - (a[0] + t * dx), p[1] - (a[1] + t * dy)
    return math.sqrt(ex * ex + ey * ey)


def rdp(points: list[tuple[float, float]], epsilon: float) -> list[tuple[float, float]]:
    """Ramer-Douglas-Peucker with a stack; the first farthest point splits."""
    if len(points) < 3:
        return points
    keep, stack = {0, len(points) - 1}, [(0, len(points) - 1)]
    while stack:
        lo, hi = stack.pop()
        best, at = 0.0, 0
        for i in range(lo + 1, hi):
            d = segment_distance(points[i], points[lo], points[hi])
            if d > best:
                best, at = d, i
        if best > epsilon:
            keep.add(at)
            stack += [(lo, at), (at, hi)]
    return [points[i] for i in sorted(keep)]


def simplified(points: Column, epsilon: float) -> Column:
    @F.pandas_udf(f"array<{POINT}>")
    def reduce(v: pd.Series) -> pd.Series:
        return v.map(lambda ps: None if ps is None else [{"x": x, "y": y} for x, y in rdp([(p["x"], p["y"]) for p in ps], epsilon)])

    return reduce(points)
