"""Right-angled outlines: oriented boxes by NumPy over a batch, snapping of edges in Arrow batches (a small helper over one feature)."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

from rastervec.functions.numeric import fixed_text, fixed_texts
from rastervec.functions.simplify import rdp
from rastervec.schema import POINT


#: Outlines whose points are Python's own numbers at once.
SLICE = 256


def _boxes(at: np.ndarray, x: np.ndarray, y: np.ndarray, filled: float) -> tuple[np.ndarray, np.ndarray]:
    """Of outlines between the offsets ``at``: which fill enough of their box, and the corners (outline, corner, axis) of all. Sums go along the vertices, in their order."""
    n, rows = np.diff(at), len(at) - 1
    of, some = np.repeat(np.arange(rows), n), n > 0
    after = np.arange(1, len(x) + 1)
    after[at[1:][some] - 1] = at[:-1][some]
    dx, dy = x[after] - x, y[after] - y
    length, turn = np.sqrt(dx * dx + dy * dy), 4 * np.arctan2(dy, dx)
    length = np.where(length < 1, 0.0, length)
    s, c = (np.bincount(of, length * f(turn), rows) for f in (np.sin, np.cos))
    angle = np.mod(np.arctan2(s, c) / 4, math.pi / 2)
    area = np.abs(np.bincount(of, x * y[after] - x[after] * y, rows) / 2)
    spun = lambda u, v, by: (u * np.cos(by) - v * np.sin(by), u * np.sin(by) + v * np.cos(by))
    low, high = np.zeros((2, rows)), np.zeros((2, rows))
    if len(x):
        for axis, level in enumerate(spun(x, y, -angle[of])):
            low[axis, some], high[axis, some] = (f.reduceat(level, at[:-1][some]) for f in (np.minimum, np.maximum))
    whole = (high[0] - low[0]) * (high[1] - low[1])
    corners = np.stack(spun(np.stack([low[0], high[0], high[0], low[0]], 1), np.stack([low[1], low[1], high[1], high[1]], 1), angle[:, None]), 2)
    return (n >= 3) & (whole > 0) & (area >= filled * whole), corners


def _flat(v: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Offsets, x and y of arrays of points; a null array has none."""
    n = pc.fill_null(pc.list_value_length(v), 0).to_numpy(zero_copy_only=False)
    return np.concatenate([[0], np.cumsum(n)]).astype(np.int32), *(c.to_numpy(zero_copy_only=False) for c in v.flatten().flatten())


def _rings(at: np.ndarray, xy: np.ndarray, mask: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.StructArray.from_arrays([pa.array(xy[:, k]) for k in (0, 1)], ["x", "y"]), mask=pa.array(mask))


def oriented_box(points: Column, *, filled: float = 0.7) -> Column:
    """Four corners along the main direction, two digits; null if the outline fills less than ``filled`` of the box, is flat or has under three points. All outlines of a batch in one go."""

    @F.arrow_udf(f"array<{POINT}>")
    def fitted(v: pa.Array) -> pa.Array:
        fits, corners = _boxes(*_flat(v), filled)
        corners = np.array(fixed_texts(corners[fits].ravel(), 2), np.float64).reshape(-1, 2)
        return _rings(np.concatenate([[0], np.cumsum(4 * fits)]), corners, ~fits)

    return fitted(points)


def _main_direction(ring: list[tuple[float, float]]) -> float:
    s = c = 0.0
    for (ax, ay), (bx, by) in zip(ring, ring[1:] + ring[:1]):
        n, t = math.sqrt((bx - ax) ** 2 + (by - ay) ** 2), 4 * math.atan2(by - ay, bx - ax)
        if n >= 1:
            s, c = s + n * math.sin(t), c + n * math.cos(t)
    return (math.atan2(s, c) / 4) % (math.pi / 2)


def _spin(p: tuple[float, float], angle: float) -> tuple[float, float]:
    c, s = math.cos(angle), math.sin(angle)
    return p[0] * c - p[1] * s, p[0] * s + p[1] * c


def _axis(a: tuple[float, float], b: tuple[float, float], tolerance: float) -> str:
    """h, v or nothing: the axis that an edge is within the tolerance of; the nearer one, level before upright."""
    turn = math.atan2(b[1] - a[1], b[0] - a[0]) % math.pi
    level, upright = min(turn, math.pi - turn), abs(turn - math.pi / 2)
    return "h" if level <= tolerance and level <= upright else "v" if upright <= tolerance else ""


def _corner(own: tuple[float, float], before: tuple, after: tuple) -> tuple[float, float]:
    """Where the edge before a vertex meets the edge after it; an edge is (axis, middle, direction, length)."""
    (p, (mx, my), (ux, uy), _), (q, (nx, ny), (vx, vy), n) = before, after
    if p + q == "hv":
        return nx, my
    if p + q == "vh":
        return mx, ny
    det = 2500 * (ux * vy - uy * vx)  # both directions drawn 50 long
    if abs(det) < 1e-6:
        return own
    t = 2500 * ((nx - mx) * vy - (ny - my) * vx) / det
    met = mx + t * ux, my + t * uy
    return met if math.dist(met, own) < max(30.0, 0.8 * n) else own


def right_angled(points: list[tuple[float, float]], tolerance: float, snap: float) -> list[tuple[float, float]]:
    """Edges near an axis of the outline's main direction are laid on it and met with their neighbours; edges shorter than ``snap`` go."""
    ring = rdp(points, 2.0)
    if len(ring) >= 3 and math.dist(ring[0], ring[-1]) < 2:
        ring = ring[:-1]
    if len(ring) < 3:
        return points
    main = _main_direction(ring)
    level = [_spin(p, -main) for p in ring]
    edges = []
    for a, b in zip(level, level[1:] + level[:1]):
        dx, dy, n, axis = b[0] - a[0], b[1] - a[1], math.hypot(b[0] - a[0], b[1] - a[1]), _axis(a, b, tolerance)
        ahead = {"h": (math.copysign(1, dx), 0.0), "v": (0.0, math.copysign(1, dy))}.get(axis) or ((dx / n, dy / n) if n else (1.0, 0.0))
        edges.append((axis, ((a[0] + b[0]) / 2, (a[1] + b[1]) / 2), ahead, n))
    met = [_spin(_corner(p, edges[i - 1], edges[i]), main) for i, p in enumerate(level)]
    met = [(float(fixed_text(x, 2)), float(fixed_text(y, 2))) for x, y in met]
    kept = [a for a, b in zip(met, met[1:] + met[:1]) if math.dist(a, b) >= snap]
    return kept if len(kept) >= 3 else ring


def squared_rings(v: pa.Array, degrees: float, snap: float) -> pa.Array:
    """right_angled() of arrays of points, a slice at a time; null stays null."""
    (at, x, y), out, n = _flat(v), [np.zeros((0, 2))], np.zeros(len(v), np.int64)
    for lo in range(0, len(v), SLICE):
        hi, own = min(lo + SLICE, len(v)), []
        flat = list(zip(x[at[lo] : at[hi]].tolist(), y[at[lo] : at[hi]].tolist()))
        for k in range(lo, hi):
            ring = right_angled(flat[at[k] - at[lo] : at[k + 1] - at[lo]], math.radians(degrees), snap)
            n[k] = len(ring)
            own += ring
        out.append(np.array(own, np.float64).reshape(-1, 2))
    return _rings(np.concatenate([[0], np.cumsum(n)]), np.concatenate(out), v.is_null().to_numpy(zero_copy_only=False))


def orthogonalised(points: Column, *, degrees: float = 20.0, snap: float = 4.0) -> Column:
    """The oriented box where it fits, else right-angled; outlines of under three points stay. Null stays null."""

    @F.arrow_udf(f"array<{POINT}>")
    def squared(v: pa.Array) -> pa.Array:
        return squared_rings(v, degrees, snap)

    return F.when(F.size(points) < 3, points).otherwise(F.coalesce(oriented_box(points), squared(points)))
