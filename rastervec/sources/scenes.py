"""Four synthetic scenes as pixels. A pixel has the colour of the last shape that holds its middle: borders are sharp, not blended."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rastervec.functions import geometry as G

WIDTH, HEIGHT = 1000, 800


def _at() -> tuple[Column, Column]:
    return F.col("x") + 0.5, F.col("y") + 0.5


def rect(x: float, y: float, w: float, h: float) -> Column:
    px, py = _at()
    return (px >= x) & (px < x + w) & (py >= y) & (py < y + h)


def disc(x: float, y: float, r: float) -> Column:
    px, py = _at()
    return (px - x) * (px - x) + (py - y) * (py - y) <= r * r


def ring(x: float, y: float, r: float, width: float) -> Column:
    return disc(x, y, r + width / 2) & ~disc(x, y, r - width / 2)


def line(x1: float, y1: float, x2: float, y2: float, width: float, dashes: tuple[float, ...] = ()) -> Column:
    """An upright or level line; dashes: lengths of strokes and gaps in turn, from its first point on."""
    level, (px, py) = y1 == y2, _at()
    body = rect(min(x1, x2), y1 - width / 2, abs(x2 - x1), width) if level else rect(x1 - width / 2, min(y1, y2), width, abs(y2 - y1))
    if not dashes:
        return body
    along, starts = ((px - x1) if level else (py - y1)) % sum(dashes), [sum(dashes[:i]) for i in range(len(dashes))]
    return body & reduce(Column.__or__, [(along >= a) & (along < a + d) for a, d in list(zip(starts, dashes))[::2]])


def frame(x: float, y: float, w: float, h: float, width: float) -> Column:
    e = width / 2
    return rect(x - e, y - e, w + width, h + width) & ~rect(x + e, y + e, w - width, h - width)


def curve(start: tuple, *parts: tuple, steps: int = 24) -> list[tuple[float, float]]:
    """Points along a path: a part is an end point, or two control points and an end point."""
    out = [start]
    for p in parts:
        if len(p) == 2:
            out.append(p)
            continue
        (ax, ay), (bx, by, cx, cy, dx, dy) = out[-1], p
        for i in range(1, steps + 1):
            t, u = i / steps, 1 - i / steps
            out.append((u**3 * ax + 3 * u * u * t * bx + 3 * u * t * t * cx + t**3 * dx, u**3 * ay + 3 * u * u * t * by + 3 * u * t * t * cy + t**3 * dy))
    return out


def _points(path: list[tuple[float, float]]) -> Column:
    return F.array(*(G.point(F.lit(float(x)), F.lit(float(y))) for x, y in path))


def area(path: list[tuple[float, float]]) -> Column:
    xs, ys = zip(*path)
    px, py = _at()
    return rect(min(xs), min(ys), max(xs) - min(xs), max(ys) - min(ys)) & G.contains(_points(path), G.point(px, py))


def stroke(path: list[tuple[float, float]], width: float) -> Column:
    xs, ys = zip(*path)
    px, py = _at()
    return rect(min(xs) - width, min(ys) - width, max(xs) - min(xs) + 2 * width, max(ys) - min(ys) + 2 * width) & G.near(_points(path), G.point(px, py), width / 2)


#: Fixed values from here on: what the scenes show, in the order in which it is painted.
def _urban() -> list[tuple[str, Column]]:
    shapes = [("#4D6B3C", rect(x, y, w, 320)) for y in (40, 440) for x, w in ((40, 240), (340, 260), (660, 300))]
    shapes += [("#373D44", s) for s in (rect(0, 360, 1000, 70), rect(280, 0, 60, 800), rect(600, 0, 60, 800))]
    shapes += [("#8E9A9D", rect(0, y, 1000, 5)) for y in (355, 430)] + [("#8E9A9D", rect(x, 0, 5, 800)) for x in (275, 340, 595, 660)]
    shapes += [("#FFFFFF", s) for s in (line(0, 395, 1000, 395, 3, (20, 15)), line(310, 0, 310, 800, 3, (20, 15)), line(630, 0, 630, 800, 3, (20, 15)))]
    roofs = [("#B84A39", 60, 60, 160, 110), ("#B84A39", 60, 170, 90, 80), ("#D9D7CE", 360, 60, 200, 140), ("#8B8C89", 390, 80, 40, 30), ("#8B8C89", 470, 80, 50, 40), ("#A74232", 700, 80, 210, 180), ("#3E444B", 70, 480, 180, 120), ("#C25943", 370, 490, 180, 150), ("#E3E0D8", 690, 490, 230, 160), ("#1D97BD", 100, 630, 80, 45)]
    shapes += [(c, rect(*r)) for c, *r in roofs]
    for x, y, r in [(190, 280, 18), (230, 300, 22), (380, 250, 20), (440, 270, 24), (530, 240, 19), (740, 300, 26), (800, 280, 21), (860, 310, 23), (100, 720, 20), (200, 710, 25), (500, 700, 22), (560, 720, 28), (750, 710, 24), (840, 690, 21)]:
        shapes += [("#265C2B", disc(x, y, r)), ("#39783F", disc(x - 2, y - 2, r * 0.7))]
    return shapes


def _highway() -> list[tuple[str, Column]]:
    shapes = [("#7A8C5E", rect(50, 50, 250, 200)), ("#8E774A", rect(320, 50, 280, 200)), ("#4A6B48", rect(620, 50, 320, 200)), ("#6E8552", rect(50, 520, 300, 230)), ("#546A42", rect(650, 520, 300, 230))]
    shapes.append(("#1B658A", area(curve((0, 700), (300, 680, 600, 740, 1000, 690), (1000, 770), (600, 820, 300, 760, 0, 780)))))
    shapes.append(("#2F363F", area(curve((0, 350), (400, 330, 600, 420, 1000, 370), (1000, 450), (600, 500, 400, 410, 0, 430)))))
    shapes.append(("#2F363F", area(curve((250, 340), (320, 220, 480, 230, 500, 370), (540, 380), (520, 180, 280, 180, 210, 330)))))
    shapes.append(("#D9A74A", stroke(curve((0, 390), (400, 370, 600, 460, 1000, 410)), 3)))
    return shapes + [("#D4CEBF", rect(*r)) for r in ((100, 100, 140, 90), (720, 90, 180, 110), (120, 560, 160, 120), (700, 560, 200, 130))]


def _blueprint() -> list[tuple[str, Column]]:
    shapes = [("#18385A", (F.col("x") % 40 == 0) | (F.col("y") % 40 == 0)), ("#E2EDF8", frame(100, 100, 800, 580, 3))]
    walls = [(100, 360, 900, 360), (100, 440, 900, 440), (350, 100, 350, 360), (620, 100, 620, 360), (380, 440, 380, 680), (650, 440, 650, 680)]
    shapes += [("#E2EDF8", line(*w, 3)) for w in walls] + [("#E2EDF8", ring(x, 230, 45, 3)) for x in (220, 480, 760)]
    shapes += [("#6BA4D9", line(80, 400, 920, 400, 1.5, (12, 4, 3, 4))), ("#6BA4D9", line(220, 80, 220, 380, 1.5, (12, 4, 3, 4)))]
    return [*shapes, ("#E2EDF8", frame(620, 580, 260, 80, 2))]


def _floor_plan() -> list[tuple[str, Column]]:
    shapes = [("#1A1A1A", frame(120, 100, 760, 600, 4))]
    walls = [(120, 340, 440, 340), (440, 100, 440, 340), (560, 100, 560, 420), (560, 420, 880, 420), (120, 520, 500, 520), (500, 520, 500, 700)]
    shapes += [("#1A1A1A", line(*w, 3)) for w in walls]
    columns = [(120, 100), (440, 100), (560, 100), (880, 100), (120, 340), (440, 340), (560, 420), (880, 420), (120, 700), (500, 700), (880, 700)]
    shapes += [("#1A1A1A", rect(x - 7, y - 7, 14, 14)) for x, y in columns]
    return shapes + [("#666666", line(*w, 1)) for w in ((120, 70, 120, 90), (880, 70, 880, 90), (120, 80, 880, 80))]


#: Name to ground colour, shapes and metres per pixel.
SCENES = {"sample_drone_urban": ("#65784C", _urban, 0.05), "sample_satellite_highway": ("#5A684C", _highway, 0.5), "sample_scanned_blueprint": ("#102A45", _blueprint, 0.02), "sample_arch_floorplan": ("#F5F5F0", _floor_plan, 0.025)}


def scene(spark: SparkSession, name: str) -> DataFrame:
    """(image_id, x, y, r, g, b, a) of a scene."""
    ground, shapes, _ = SCENES[name]
    rows = spark.range(WIDTH * HEIGHT).select(F.lit(name).alias("image_id"), (F.col("id") % WIDTH).cast("int").alias("x"), F.expr(f"int(id div {WIDTH})").alias("y"))
    colour = F.coalesce(*(F.when(holds, c) for c, holds in reversed(shapes())), F.lit(ground))
    rows = rows.withColumn("_c", colour)
    part = lambda k: F.conv(F.substring("_c", k, 2), 16, 10).cast("int")
    return rows.select("image_id", "x", "y", part(2).alias("r"), part(4).alias("g"), part(6).alias("b"), F.lit(255).alias("a"))


def scenes(spark: SparkSession) -> DataFrame:
    return reduce(DataFrame.unionByName, [scene(spark, name) for name in SCENES])
