"""Whole-image statistics and neighbourhood operators on the pixel relation (image_id, x, y, ...).

Neighbourhoods are windows: along x within (image_id, y), along y within (image_id, x), so a task holds single rows and columns of an
image, never an image. Squares are separable into the two.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rastervec.functions import spectral
from rastervec.operators import tiles as T


def along_x():
    return Window.partitionBy("image_id", "y").orderBy("x")


def along_y():
    return Window.partitionBy("image_id", "x").orderBy("y")


def _ratio(test: Column) -> Column:
    return F.sum(test.cast("long")) / F.count("*")


def image_analysis(pixels: DataFrame) -> DataFrame:
    """Per image: shares of colours, kind, confidence and metres per pixel."""
    r, g, b, lum, sat = F.col("r"), F.col("g"), F.col("b"), spectral.luminance(), spectral.saturation()
    out = pixels.groupBy("image_id").agg(
        F.count("*").alias("n_pixels"), F.avg(sat).alias("mean_saturation"),
        _ratio((b > 100) & (b > r + 30) & (b > g + 20) & (lum < 140)).alias("blueprint"),
        _ratio(((lum < 40) | (lum > 220)) & (sat < 0.15)).alias("black_white"),
        _ratio((g > r + 15) & (g > b + 15) & (sat > 0.2)).alias("vegetation"),
        _ratio((sat < 0.12) & (lum > 40) & (lum < 160)).alias("asphalt"),
        _ratio((r > 130) & (r > g + 25) & (r > b + 25)).alias("roof"),
    )
    out = out.join(edge_statistics(pixels), "image_id", "left")
    land = (F.col("vegetation") > 0.08) | (F.col("roof") > 0.03) | (F.col("asphalt") > 0.15)
    near = (F.col("density") > 0.35) & ((F.col("roof") > 0.02) | (F.col("asphalt") > 0.1))
    kind = (
        F.when(F.col("blueprint") > 0.35, "CAD_SCAN_BLUEPRINT")
        .when((F.col("black_white") > 0.65) & (F.col("mean_saturation") < 0.08), F.when(F.col("orthogonal") > 0.45, "ARCHITECTURAL_DRAWING").otherwise("BLACK_WHITE_LINE"))
        .when(land, F.when(near, "AERIAL_DRONE").otherwise("SATELLITE"))
        .when((F.col("mean_saturation") > 0.25) & (F.col("orthogonal") > 0.3), "URBAN_CADASTRAL")
        .otherwise("GENERAL_IMAGE")
    )
    #: Confidence and metres per pixel of each kind.
    known = {"CAD_SCAN_BLUEPRINT": (0.94, 0.02), "ARCHITECTURAL_DRAWING": (0.92, 0.025), "BLACK_WHITE_LINE": (0.89, 0.05), "AERIAL_DRONE": (0.93, 0.05), "SATELLITE": (0.87, 0.5), "URBAN_CADASTRAL": (0.90, 0.1), "GENERAL_IMAGE": (0.82, 0.1)}
    pick = lambda k: F.element_at(F.create_map(*(F.lit(x) for n, v in known.items() for x in (n, v[k]))), F.col("kind"))
    out = out.withColumn("kind", kind).withColumns({"confidence": pick(0), "metres_per_pixel": pick(1)})
    return out.withColumns({"grayscale": F.col("mean_saturation") < 0.08, "high_contrast": F.col("black_white") > 0.6, "richness": F.least(F.lit(1.0), F.col("mean_saturation") * 2.5)})


def edge_statistics(pixels: DataFrame) -> DataFrame:
    """Per image, over every fourth pixel and its right and lower neighbours: density of edges, and the share of upright ones."""
    even = (F.col("r") + F.col("g") + F.col("b")) / 3
    # a sampled pixel needs its neighbours only: each pixel is sent to the sampled places it serves, at most three
    cell = F.explode(F.array(*(F.struct((F.col("x") - dx).alias("x"), (F.col("y") - dy).alias("y"), F.lit(k).alias("k")) for k, (dx, dy) in enumerate(((0, 0), (1, 0), (0, 1))))))
    places = pixels.select("image_id", even.alias("v"), cell.alias("c")).select("image_id", "v", "c.*").where("x % 4 = 1 and y % 4 = 1 and x > 0 and y > 0")
    value = lambda k: F.max(F.when(F.col("k") == k, F.col("v")))
    at = places.groupBy("image_id", "x", "y").agg(value(0).alias("here"), value(1).alias("right"), value(2).alias("down"))
    at = at.where("here is not null and right is not null and down is not null").select("image_id", (F.col("right") - F.col("here")).alias("gx"), (F.col("down") - F.col("here")).alias("gy"))
    strong = F.abs("gx") + F.abs("gy") > 35
    upright = strong & ((F.abs("gx") < 6) | (F.abs("gy") < 6))
    n = pixels.groupBy("image_id").agg(F.count("*").alias("n"))
    sums = at.groupBy("image_id").agg(F.sum(strong.cast("long")).alias("edges"), F.sum(upright.cast("long")).alias("upright")).join(n, "image_id")
    return sums.select("image_id", "edges", F.least(F.lit(1.0), F.col("edges") * 16 / (F.col("n") * 0.4)).alias("density"), F.when(F.col("edges") > 0, F.col("upright") / F.col("edges")).otherwise(0.0).alias("orthogonal"))


def luma_stats(pixels: DataFrame) -> DataFrame:
    """Per image: mean luminance, mean step between neighbours in raster order over 255, width and megapixels.

    The step into a row's first pixel comes from the end of the row before: that pair is joined, so no window spans an image."""
    p = pixels.select("image_id", "x", "y", spectral.luminance().alias("lum"))
    within = p.withColumn("step", F.abs(F.col("lum") - F.lag("lum").over(along_x())))
    sums = within.groupBy("image_id").agg(F.count("*").alias("n"), F.avg("lum").alias("mean_luma"), F.sum("step").alias("inner"), (F.max("x") + 1).alias("width"))
    ends = p.groupBy("image_id", "y").agg(F.min_by("lum", "x").alias("first"), F.max_by("lum", "x").alias("last"))
    before = ends.select("image_id", (F.col("y") + 1).alias("y"), F.col("last").alias("prior"))
    turns = ends.join(before, ["image_id", "y"]).groupBy("image_id").agg(F.sum(F.abs(F.col("first") - F.col("prior"))).alias("turns"))
    out = sums.join(turns, "image_id", "left")
    edge = F.least(F.lit(1.0), (F.coalesce("inner", F.lit(0.0)) + F.coalesce("turns", F.lit(0.0))) / (F.col("n") * 255))
    return out.select("image_id", "mean_luma", edge.alias("edge"), "width", (F.col("n") / 1e6).alias("megapixels"))


def integral_image(plane: DataFrame, value: str) -> DataFrame:
    """Adds total and total_squares over all pixels up and left of each, itself included."""
    v = F.col(value).cast("long")
    upto = lambda w: w.rowsBetween(Window.unboundedPreceding, 0)
    rows = plane.withColumns({"_s": F.sum(v).over(upto(along_x())), "_q": F.sum(v * v).over(upto(along_x()))})
    return rows.withColumns({"total": F.sum("_s").over(upto(along_y())), "total_squares": F.sum("_q").over(upto(along_y()))}).drop("_s", "_q")


def box_sums(plane: DataFrame, value: str, radius: int) -> DataFrame:
    """Adds n, total and total_squares of the square around each pixel, cut at the borders."""
    v = F.col(value).cast("long")
    x, y = along_x().rowsBetween(-radius, radius), along_y().rowsBetween(-radius, radius)
    rows = plane.withColumns({"_n": F.count("*").over(x), "_s": F.sum(v).over(x), "_q": F.sum(v * v).over(x)})
    return rows.withColumns({"n": F.sum("_n").over(y), "total": F.sum("_s").over(y), "total_squares": F.sum("_q").over(y)}).drop("_n", "_s", "_q")


def sauvola(plane: DataFrame, value: str = "gray", *, radius: int = 12, k: float = 0.2, dynamic: float = 128.0) -> DataFrame:
    """Adds bit: 1 where the value is below mean * (1 + k * (deviation / dynamic - 1)) of its square."""
    rows = box_sums(plane, value, radius)
    mean = F.col("total") / F.col("n")
    deviation = F.sqrt(F.greatest(F.lit(0.0), F.col("total_squares") / F.col("n") - mean * mean))
    bit = (F.col(value) < mean * (1 + k * (deviation / dynamic - 1))).cast("int")
    return rows.withColumn("bit", bit).drop("n", "total", "total_squares")


def _cross(mask: DataFrame, fold) -> DataFrame:
    """fold() over a pixel and its four neighbours; where one is missing, 0."""
    sides = {"_l": F.lag("bit").over(along_x()), "_r": F.lead("bit").over(along_x()), "_u": F.lag("bit").over(along_y()), "_d": F.lead("bit").over(along_y())}
    rows = mask.withColumns(sides)
    inner = F.col("_l").isNotNull() & F.col("_r").isNotNull() & F.col("_u").isNotNull() & F.col("_d").isNotNull()
    return rows.withColumn("bit", F.when(inner, fold("bit", *sides)).otherwise(0)).drop(*sides)


def dilated(mask: DataFrame) -> DataFrame:
    return _cross(mask, F.greatest)


def eroded(mask: DataFrame) -> DataFrame:
    return _cross(mask, F.least)


def closed(mask: DataFrame) -> DataFrame:
    """Dilation, then erosion; two rings of pixels at the border end up 0."""
    return eroded(dilated(mask))


def sobel(pixels: DataFrame) -> DataFrame:
    """(image_id, x, y, gradient): magnitude on luminance as 32-bit float, 0 at the border."""
    p = pixels.select("image_id", "x", "y", spectral.luminance().alias("v"))
    p = p.withColumns({"_l": F.lag("v").over(along_x()), "_r": F.lead("v").over(along_x())})
    near = {f"{c}{d}": f("v" if c == "c" else f"_{c}").over(along_y()) for c in "lcr" for d, f in (("u", F.lag), ("d", F.lead))}
    p = p.withColumns(near)
    c = F.col
    gx = (c("ru") + 2 * c("_r") + c("rd")) - (c("lu") + 2 * c("_l") + c("ld"))
    gy = (c("ld") + 2 * c("cd") + c("rd")) - (c("lu") + 2 * c("cu") + c("ru"))
    return p.select("image_id", "x", "y", F.coalesce(F.sqrt(gx * gx + gy * gy), F.lit(0.0)).cast("float").alias("gradient"))


def peaks(plane: DataFrame, value: str, *, ratio: float = 0.35, least: float = 3.0, radius: int = 4) -> DataFrame:
    """Pixels of the stride-2 grid, a radius off the border, that reach the threshold and no value of their square exceeds."""
    rows = plane.withColumn("_m", F.max(value).over(along_x().rowsBetween(-radius, radius)))
    rows = rows.withColumn("_m", F.max("_m").over(along_y().rowsBetween(-radius, radius)))
    size = plane.groupBy("image_id").agg(F.max(value).alias("_max"), F.max("x").alias("_w"), F.max("y").alias("_h"))
    grid = F.expr(f"x >= {radius} and y >= {radius} and x % 2 = {radius % 2} and y % 2 = {radius % 2} and x <= _w - {radius} and y <= _h - {radius}")
    return rows.join(size, "image_id").where(grid & (F.col(value) >= F.greatest(F.lit(least), F.col("_max") * ratio)) & (F.col("_m") <= F.col(value))).drop("_m", "_max", "_w", "_h")


#: NumPy types of the columns that go along with a tile.
NUMPY = {"tinyint": "int8", "smallint": "int16", "int": "int32", "bigint": "int64", "float": "float32", "double": "float64"}


def bilateral(pixels: DataFrame, *, radius: int = 2, sigma: float = 25.0) -> DataFrame:
    """Smoothed r, g, b: weights fall with distance and with difference of luminance; the square is cut at the borders. Other columns are numbers and stay.

    On tiles with a margin: each of the (2 radius + 1)^2 shifts is one step over whole arrays."""
    others = {f.name: f.dataType.simpleString() for f in pixels.schema if f.name not in ("image_id", "x", "y", "r", "g", "b")}
    steps = [(dx, dy) for dy in range(-radius, radius + 1) for dx in range(-radius, radius + 1)]

    def smooth(present: np.ndarray, planes: dict[str, np.ndarray], x0: int, y0: int) -> tuple[np.ndarray, dict[str, np.ndarray]]:
        colours = {c: planes[c].astype(np.float64) for c in "rgb"}
        light = colours["r"] * 0.299 + colours["g"] * 0.587 + colours["b"] * 0.114
        sums, weights = {c: np.zeros(light.shape) for c in "rgb"}, np.zeros(light.shape)
        for dx, dy in steps:
            at = lambda plane, dx=dx, dy=dy: np.roll(plane, (-dy, -dx), (0, 1))  # what comes round lies in the margin
            w = at(present) * math.exp(-(dx * dx + dy * dy) / (2 * radius * radius)) * np.exp(-((at(light) - light) ** 2) / (2 * sigma * sigma))
            weights += w
            for c in "rgb":
                sums[c] += w * at(colours[c])
        out = {c: np.floor(sums[c] / np.where(present, weights, 1) + 0.5).astype(np.int32) for c in "rgb"}
        return present, out | {c: planes[c] for c in others}

    kinds = {"r": "int32", "g": "int32", "b": "int32"} | {c: NUMPY[t] for c, t in others.items()}
    out = T.on_tiles(pixels, kinds, smooth, ", ".join(["r int", "g int", "b int", *(f"{c} {t}" for c, t in others.items())]), margin=radius)
    return out.select(*pixels.columns)
