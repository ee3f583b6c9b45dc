"""Scalar functions of a pixel's r, g, b."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F



def luminance() -> Column:
    return F.col("r") * 0.299 + F.col("g") * 0.587 + F.col("b") * 0.114


def saturation() -> Column:
    most, least = F.greatest("r", "g", "b"), F.least("r", "g", "b")
    return F.when(most == 0, 0.0).otherwise((most - least).cast("double") / most)


def excess_green() -> Column:
    return 2 * F.col("g") - F.col("r") - F.col("b")


def shadow() -> Column:
    return (luminance() < 45) & (F.col("b") > F.col("r") + 8)


def gray(inverted: bool = False) -> Column:
    lum = 255 - luminance() if inverted else luminance()
    return F.floor(lum + 0.5).cast("int")


def surface(*, water: bool = True, trees: bool = True) -> Column:
    """Class of the ground: 4 water, 3 vegetation, 2 road, 1 building, 5 parcel, 0 none; the first that holds."""
    r, g, b, lum, sat = F.col("r"), F.col("g"), F.col("b"), luminance(), saturation()
    lit = ~shadow()
    wet = lit & (b > r + 15) & (b > g - 12) & (lum < 140)
    green = lit & ((excess_green() > 12) | ((g > r + 12) & (g > b + 12) & (sat > 0.15)))
    paved = lit & (sat < 0.12) & (lum > 42) & (lum < 160)
    clay = (r > 115) & (r > g + 22) & (r > b + 22)
    light = (lum > 165) & (sat < 0.25)
    dark = (lum > 25) & (lum < 48) & (sat < 0.18) & lit
    metal = (sat < 0.15) & (lum > 80) & (lum < 155) & (F.abs(r - b) < 12)
    out = F.when(wet & F.lit(water), 4).when(green & F.lit(trees), 3).when(paved, 2).when(clay | light | dark | metal, 1)
    return out.when((g > b) & (g > r) & (sat > 0.08), 5).otherwise(0)
