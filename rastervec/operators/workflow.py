"""From an image to its drawing: analysis, smoothing, the conversion that suits the kind of image, and what is said about the result."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rastervec.operators import features as O
from rastervec.operators import pixels as P
from rastervec.operators import vectorise as V
from rastervec.operators.components import settled
from rastervec.schema import Parameters, layers

#: Kinds of image that are drawings, radius and strength of the smoothing, width that an image is looked at with, and metres per pixel if nothing else is known.
DRAWINGS = ("CAD_SCAN_BLUEPRINT", "ARCHITECTURAL_DRAWING", "BLACK_WHITE_LINE")
RADIUS, SIGMA, SAMPLE_WIDTH, DEFAULT_SCALE = 2, 22.0, 400, 0.05


def sampled(pixels: DataFrame, *, width: int = SAMPLE_WIDTH) -> DataFrame:
    """Images at most ``width`` pixels wide: of a wider one the pixel in the middle of each new pixel's square."""
    size = pixels.groupBy("image_id").agg((F.max("x") + 1).alias("_w"), (F.max("y") + 1).alias("_h"))
    rows = pixels.join(size, "image_id").withColumn("_nw", F.least("_w", F.lit(width))).withColumn("_nh", F.floor(F.col("_h") / F.col("_w") * F.col("_nw") + 0.5))
    at = lambda c, new, old: F.floor(((F.col(c) + 0.5) * F.col(new)) / F.col(old))
    # a pixel is the middle of the new pixel it lies in if that one's middle lies in it
    chosen = lambda c, new, old: F.floor((at(c, new, old) + 0.5) * F.col(old) / F.col(new)) == F.col(c)
    rows = rows.where(chosen("x", "_nw", "_w") & chosen("y", "_nh", "_h"))
    return rows.withColumns({"x": at("x", "_nw", "_w").cast("int"), "y": at("y", "_nh", "_h").cast("int")}).select(pixels.columns)


def convert(pixels: DataFrame, report: DataFrame, params: Parameters = Parameters(), *, inv: float = 1.0) -> DataFrame:
    """Features of all images, smoothed first: drawings by their ink (of blueprints the light is the ink), others by their surfaces. report: image_analysis()'s rows."""
    kinds = report.select("image_id", "kind")
    smooth = settled(P.bilateral(pixels, radius=RADIUS, sigma=SIGMA).join(kinds, "image_id"))
    of = lambda test: smooth.where(test).drop("kind")
    present = {r["kind"] for r in kinds.distinct().collect()}  # seven kinds at most
    found = []
    if present - {*DRAWINGS}:
        found.append(V.aerial(of(~F.col("kind").isin(*DRAWINGS)), params, inv=inv))
    if present & {*DRAWINGS[1:]}:
        found.append(V.drawing(of(F.col("kind").isin(*DRAWINGS[1:])), params, inv=inv))
    if DRAWINGS[0] in present or not found:
        found.append(V.drawing(of(F.col("kind") == DRAWINGS[0]), params, inv=inv, inverted=True))
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out


def load(pixels: DataFrame, *, params: Parameters = Parameters(), suggested: float | None = None) -> dict[str, DataFrame]:
    """report, calibration, features, layers and issues of images: the scale is the suggested one, or what the analysis estimates, or a default."""
    spark = pixels.sparkSession
    report = settled(P.image_analysis(sampled(pixels)))
    scale = F.coalesce(*(F.when(c != 0, c) for c in (F.lit(suggested).cast("double"), F.col("metres_per_pixel"))), F.lit(DEFAULT_SCALE))
    features = settled(convert(pixels, report, params))
    return {
        "report": report,
        "calibration": report.select("image_id", F.lit(True).alias("is_calibrated"), scale.alias("metres_per_pixel")),
        "features": features,
        "layers": O.layer_rollup(features, layers(spark)),
        "issues": O.topology_issues(features),
    }
