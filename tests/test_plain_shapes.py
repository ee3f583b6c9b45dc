"""Right-angled outlines and centre lines of random shapes against plain versions, in complex numbers and on grids."""

import cmath
import math
import random
from decimal import ROUND_HALF_UP, Decimal

import numpy as np
from pyspark.sql import functions as F

from rastervec.functions.regularise import orthogonalised
from rastervec.operators import outlines as L


def digits(v, n):
    """Exact decimal expansion, ties away from zero."""
    return float(Decimal(v).quantize(Decimal(1).scaleb(-n), ROUND_HALF_UP))


def thinned_line(z, epsilon):
    if len(z) < 3:
        return z
    a, b = z[0], z[-1]

    def off(p):
        along = ((p - a) * (b - a).conjugate()).real / abs(b - a) ** 2 if a != b else 0
        return abs(p - (a + min(1, max(0, along)) * (b - a)))

    far = [off(p) for p in z[1:-1]]
    k = 1 + far.index(max(far))
    return thinned_line(z[: k + 1], epsilon)[:-1] + thinned_line(z[k:], epsilon) if max(far) > epsilon else [a, b]


def main_direction(z):
    total = sum(abs(e) * cmath.exp(4j * cmath.phase(e)) for a, b in zip(z, z[1:] + z[:1]) if abs(e := b - a) >= 1)
    return (cmath.phase(total) / 4) % (math.pi / 2)


def plain_box(z):
    turn = cmath.exp(1j * main_direction(z))
    flat = [p / turn for p in z]
    x0, x1, y0, y1 = min(p.real for p in flat), max(p.real for p in flat), min(p.imag for p in flat), max(p.imag for p in flat)
    area = abs(sum((a.conjugate() * b).imag for a, b in zip(z, z[1:] + z[:1]))) / 2
    if (x1 - x0) * (y1 - y0) <= 0 or area < 0.7 * (x1 - x0) * (y1 - y0):
        return None
    return [turn * complex(x, y) for x, y in ((x0, y0), (x1, y0), (x1, y1), (x0, y1))]


def plain_right_angles(z, degrees, snap):
    if len(z) < 3:
        return z
    if (box := plain_box(z)) is not None:
        return [complex(digits(p.real, 2), digits(p.imag, 2)) for p in box]
    ring = thinned_line(z, 2.0)
    if len(ring) >= 3 and abs(ring[0] - ring[-1]) < 2:
        ring = ring[:-1]
    if len(ring) < 3:
        return z
    turn = cmath.exp(1j * main_direction(ring))
    flat = [p / turn for p in ring]
    n, out = len(flat), []

    def edge(i):
        a, b = flat[i % n], flat[(i + 1) % n]
        angle = cmath.phase(b - a) % math.pi
        level, upright, near = min(angle, math.pi - angle), abs(angle - math.pi / 2), math.radians(degrees)
        if level <= near and not (upright <= near and upright < level):
            return "h", (a + b) / 2, complex(-1 if (b - a).real < 0 else 1, 0), abs(b - a)
        if upright <= near:
            return "v", (a + b) / 2, complex(0, -1 if (b - a).imag < 0 else 1), abs(b - a)
        return "", (a + b) / 2, (b - a) / abs(b - a) if a != b else 1, abs(b - a)

    for i in range(n):
        (p, m, u, _), (q, k, v, length) = edge(i - 1), edge(i)
        if (p, q) == ("h", "v"):
            out.append(complex(k.real, m.imag))
        elif (p, q) == ("v", "h"):
            out.append(complex(m.real, k.imag))
        else:
            cross = (u.conjugate() * v).imag
            met = m + u * ((k - m).conjugate() * v).imag / cross if abs(2500 * cross) >= 1e-6 else None
            out.append(met if met is not None and abs(met - flat[i]) < max(30, 0.8 * length) else flat[i])
    out = [complex(digits((p * turn).real, 2), digits((p * turn).imag, 2)) for p in out]
    kept = [a for a, b in zip(out, out[1:] + out[:1]) if abs(a - b) >= snap]
    return kept if len(kept) >= 3 else ring


def test_right_angled_outlines_of_random_shapes(spark):
    rng, shapes = random.Random(21), []
    for k in range(120):
        turn, steps = cmath.exp(1j * rng.uniform(0, 3)), rng.randint(2, 5)
        z = [complex(0, 0)]
        for _ in range(steps):  # stairs with noise: most fill less than 0.7 of their box
            z += [z[-1] + rng.uniform(4, 30), z[-1] + rng.uniform(4, 30) + 1j * rng.uniform(4, 25)]
        z += [complex(rng.uniform(-5, 5), z[-1].imag + rng.uniform(1, 40))]
        z = [p * turn + complex(rng.gauss(0, 0.8), rng.gauss(0, 0.8)) for p in z]
        shapes.append(z if k % 4 else [complex(rng.uniform(0, 90), rng.uniform(0, 90)) for _ in range(rng.randint(1, 9))])
    for _ in range(12):
        w, h, turn = rng.uniform(10, 60), rng.uniform(10, 60), cmath.exp(1j * rng.uniform(0, 3))
        shapes.append([turn * p + complex(rng.gauss(0, 0.5), rng.gauss(0, 0.5)) for p in (0, w, w + 1j * h, 1j * h)])
    rows = spark.createDataFrame([(k, [(p.real, p.imag) for p in z]) for k, z in enumerate(shapes)], "k int, points array<struct<x:double,y:double>>")
    got = {r["k"]: [complex(p["x"], p["y"]) for p in r["q"]] for r in rows.select("k", orthogonalised(F.col("points"), degrees=12.0, snap=5.0).alias("q")).collect()}
    boxes = 0
    for k, z in enumerate(shapes):
        want = plain_right_angles(z, 12.0, 5.0)
        boxes += len(z) > 2 and plain_box(z) is not None
        assert len(got[k]) == len(want) and all(abs(a - b) < 0.011 for a, b in zip(got[k], want)), k
    assert 10 < boxes < 100


def plain_centre_line(mask):
    h, w = mask.shape
    order = [(1, 0), (1, 1), (0, 1), (-1, 1), (-1, 0), (-1, -1), (0, -1), (1, -1)]
    left = mask.copy()
    near = lambda x, y: [(x + dx, y + dy) for dx, dy in order if 0 <= x + dx < w and 0 <= y + dy < h and left[y + dy, x + dx]]
    places = [(int(x), int(y)) for y, x in zip(*np.nonzero(mask))]
    at = next((p for p in places if len(near(*p)) == 1), places[0])
    path = [at]
    left[at[1], at[0]] = False
    while len(path) < 3000 and (more := near(*at)):
        at = more[0]
        left[at[1], at[0]] = False
        path.append(at)
    return path


def test_centre_lines_of_random_skeletons(spark):
    rng, masks = random.Random(22), []
    for _ in range(30):
        mask, x, y = np.zeros((40, 60), bool), 30, 20
        for _ in range(rng.randint(1, 120)):
            mask[y, x] = True
            x, y = min(59, max(0, x + rng.randint(-1, 1))), min(39, max(0, y + rng.randint(-1, 1)))
        masks.append(mask)
    rows = [(k, 0, int(x), int(y)) for k, m in enumerate(masks) for y, x in zip(*np.nonzero(m))]
    rng.shuffle(rows)
    got = {r["image_id"]: [(int(p["x"]), int(p["y"])) for p in r["points"]] for r in L.centrelines(spark.createDataFrame(rows, "image_id int, label int, x int, y int")).collect()}
    assert got == {k: path for k, m in enumerate(masks) if len(path := plain_centre_line(m)) > 1}
