"""Images to features: classes or ink, their components, outlines, and what becomes of them.

All components of all classes and images go through the same few jobs: a component's key is its image and class as text.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rastervec.functions import geometry as G
from rastervec.functions import spectral
from rastervec.functions.numeric import js_round, points_fixed, to_fixed
from rastervec.functions.regularise import orthogonalised
from rastervec.functions.simplify import simplified
from rastervec.operators import components as C
from rastervec.operators import features as O
from rastervec.operators import outlines as L
from rastervec.operators import pixels as P
from rastervec.operators import watershed as W
from rastervec.operators.components import settled
from rastervec.schema import Parameters

BUILDING, ROAD, PLANT, WATER = 1, 2, 3, 4
#: Components of an image, the size from which plants are an area, and the identifier of a feature with its layer, confidence and class.
MOST_COMPONENTS, TREE_BELOW = 400, 550
KINDS = {
    "BLD_": ("BUILDINGS", 0.96, "Building Footprint", "AI_SEGMENTATION"),
    "RD_BND_": ("ROAD_BOUNDARIES", 0.91, "Road Boundary Corridor", "AI_SEGMENTATION"),
    "RD_CTR_": ("ROAD_CENTERLINES", 0.90, "Road Centerline", "AI_SEGMENTATION"),
    "TREE_": ("TREES", 0.94, "Tree Canopy", "AI_SEGMENTATION"),
    "VEG_": ("VEGETATION", 0.89, "Vegetation Area", "AI_SEGMENTATION"),
    "WATER_": ("WATER", 0.95, "Water Reservoir", "AI_SEGMENTATION"),
    "COL_": ("WALLS", 0.97, "Circular Column / Tank", "LINE_DETECTION"),
    "WALL_": ("WALLS", 0.94, "Wall Line", "LINE_DETECTION"),
}
COLUMNS = ["image_id", "group", "k", "sub", "id", "layer", "geometry_type", "is_closed", "points", "center", "radius", "confidence", "classification", "source", "area", "length"]


def _scaled(points: Column, inv: float) -> Column:
    at = F.transform(points, lambda p: G.point(p["x"] * inv, p["y"] * inv))
    return F.transform(points_fixed(at, 1), lambda p: G.point(p["x"].cast("double"), p["y"].cast("double")))


def _one_digit(c: Column) -> Column:
    return to_fixed(c, 1).cast("double")


def _named(rows: DataFrame, prefix: str, group: int, *, kind: str = "LWPOLYLINE", closed: Column | bool = True, sub: int = 0, area: Column | None = None, length: Column | None = None, classification: Column | None = None) -> DataFrame:
    """COLUMNS of rows with image_id, k and points; center and radius where they have them."""
    layer, confidence, what, source = KINDS[prefix]
    have = lambda c, t: F.col(c) if c in rows.columns else F.lit(None).cast(t)
    closed = F.lit(closed) if isinstance(closed, bool) else closed
    nothing = F.lit(None).cast("long")
    out = rows.select(
        "image_id", F.lit(group).alias("group"), "k", F.lit(sub).alias("sub"), F.concat(F.lit(prefix), F.col("k").cast("string")).alias("id"), F.lit(layer).alias("layer"), F.lit(kind).alias("geometry_type"), closed.alias("is_closed"), "points",
        have("center", "struct<x:double,y:double>").alias("center"), have("radius", "double").alias("radius"), F.lit(confidence).alias("confidence"), (F.lit(what) if classification is None else classification).alias("classification"), F.lit(source).alias("source"),
        (nothing if area is None else area).alias("area"), (nothing if length is None else length).alias("length"),
    )
    return out.select(*COLUMNS)


def _ordered(features: DataFrame) -> DataFrame:
    """seq instead of group, k and sub; an image has at most a few thousand features, as its components are limited."""
    place = F.row_number().over(Window.partitionBy("image_id").orderBy("group", "k", "sub"))
    return features.withColumn("seq", place.cast("long")).select("image_id", "seq", *COLUMNS[4:])


def _area() -> Column:
    return js_round(G.area(F.col("points")))


def _around() -> Column:
    return js_round(G.length(F.col("points"), True))


def aerial(pixels: DataFrame, params: Parameters = Parameters(), *, inv: float = 1.0) -> DataFrame:
    """Features of aerial images: buildings, roads with centre lines, trees, vegetation, water. ``inv`` scales pixels to image units.

    Ids count components before those with too short an outline go, so they may have gaps. Images without such surfaces give no row."""
    image = pixels.select("image_id").schema[0].dataType
    surface = settled(pixels.withColumn("class", spectral.surface(water=params.water, trees=params.trees)).select("image_id", "x", "y", "r", "g", "b", "class"))
    least_building = max(25, math.floor(params.min_feature_size / inv**2 + 0.5))
    least = {ROAD: max(100, math.floor(2 * params.min_feature_size / inv**2 + 0.5)), PLANT: 15, WATER: 80}
    key = F.concat_ws("/", "class", F.col("image_id").cast("string"))
    classes = F.explode(F.array(*map(F.lit, (BUILDING, ROAD, PLANT, WATER)))).alias("class")
    sizes = settled(C.image_sizes(surface).select("*", classes).select(key.alias("image_id"), "_w", "_h"))
    parts = settled(C.components(surface.where(F.col("class").isin(BUILDING, ROAD, PLANT, WATER)).select(key.alias("image_id"), "x", "y")))
    kind = F.substring("image_id", 1, 1).cast("int")
    # buildings: components large enough are painted again and cut into instances
    large = parts.where(kind == BUILDING).join(C.summarised(parts.where(kind == BUILDING), least=max(8, least_building), most=MOST_COMPONENTS, sizes=sizes).select("image_id", "label"), ["image_id", "label"], "left_semi")
    painted = surface.select(F.concat_ws("/", F.lit(BUILDING), F.col("image_id").cast("string")).alias("image_id"), "x", "y", "r", "g", "b")
    mask = painted.join(large.select("image_id", "x", "y", F.lit(1).alias("_in")), ["image_id", "x", "y"], "left").withColumn("bit", F.coalesce("_in", F.lit(0)))
    cut = W.instances(mask.select("image_id", "x", "y", "bit"), painted)
    every = settled(cut.unionByName(parts.where(kind != BUILDING)))
    gate = F.when(kind == BUILDING, least_building).when(kind == ROAD, least[ROAD]).when(kind == PLANT, least[PLANT]).otherwise(least[WATER])
    kept = settled(C.summarised(every, least=gate, most=MOST_COMPONENTS, sizes=sizes, number=True))
    drawn = every.join(kept.where((kind != PLANT) | (F.col("n") >= TREE_BELOW)).select("image_id", "label"), ["image_id", "label"], "left_semi")
    lines = L.outlines(drawn).join(kept.select("image_id", "label", "k"), ["image_id", "label"])
    lines = settled(lines.withColumns({"class": kind, "_n": F.size("points"), "points": _scaled(F.col("points"), inv)}).withColumn("image_id", F.expr("substring(image_id, 3)").cast(image)))
    tol = params.rdp_tolerance
    shaped = lambda of, long, e: lines.where((F.col("class") == of) & (F.col("_n") >= long)).withColumn("points", e)
    houses = orthogonalised(F.col("points"), degrees=params.orthogonal_degrees, snap=params.snap * inv) if params.regularise else simplified(F.col("points"), tol * inv)
    houses = shaped(BUILDING, 4, houses).withColumn("points", G.without_collinear(F.col("points"), 1.5 * inv)).where(F.size("points") >= 3)
    found = [
        _named(houses, "BLD_", 0, area=_area(), length=_around()),
        _named(shaped(ROAD, 5, simplified(F.col("points"), 1.5 * tol * inv)).where(F.size("points") >= 3), "RD_BND_", 1, area=_area(), length=_around()),
        _named(shaped(PLANT, 4, simplified(F.col("points"), 2 * tol * inv)), "VEG_", 2, area=_area()),
        _named(shaped(WATER, 4, simplified(F.col("points"), 1.5 * tol * inv)), "WATER_", 3, area=_area()),
    ]
    trees = kept.where((kind == PLANT) & (F.col("n") < TREE_BELOW)).withColumn("image_id", F.expr("substring(image_id, 3)").cast(image))
    trees = trees.withColumns({"center": G.point(_one_digit((F.col("min_x") + F.col("max_x")) / 2 * inv), _one_digit((F.col("min_y") + F.col("max_y")) / 2 * inv)), "radius": F.greatest(F.lit(6.0), _one_digit((F.col("max_x") - F.col("min_x") + F.col("max_y") - F.col("min_y")) / 4 * inv))})
    found.append(_named(trees.withColumn("points", F.array("center")), "TREE_", 2, kind="CIRCLE", area=js_round(math.pi * F.col("radius") * F.col("radius"))))
    if params.centrelines:
        roads = every.join(kept.where(kind == ROAD).select("image_id", "label", "k"), ["image_id", "label"])
        alone = roads.select(F.concat_ws("/", "k", "image_id").alias("image_id"), (F.col("x") + 1).alias("x"), (F.col("y") + 1).alias("y"))  # a component by itself has no border
        thin = C.thinned(alone, width=1 << 30, height=1 << 30)
        walked = L.centrelines(thin.withColumn("label", F.lit(0)))
        walked = walked.withColumn("points", simplified(F.transform("points", lambda p: G.point(p["x"] - 1, p["y"] - 1)), 2.0)).withColumn("points", _scaled(F.col("points"), inv))
        walked = walked.select(F.substring_index("image_id", "/", 1).cast("int").alias("k"), F.regexp_replace("image_id", r"^\d+/\d/", "").cast(image).alias("image_id"), "points")
        own = lines.where(F.col("class") == ROAD).where(F.col("_n") >= 5).withColumn("_s", simplified(F.col("points"), 1.5 * tol * inv)).where(F.size("_s") >= 3).select("image_id", "k")
        found.append(_named(walked.join(own, ["image_id", "k"], "left_semi"), "RD_CTR_", 1, sub=1, closed=False, length=js_round(G.length(F.col("points"), False))))
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return _ordered(out)


def drawing(pixels: DataFrame, params: Parameters = Parameters(), *, inv: float = 1.0, inverted: bool = False) -> DataFrame:
    """Features of drawings: ink by a local threshold; outlines that fit a circle, and walls. Images without ink give no row."""
    ink = P.sauvola(pixels.withColumn("gray", spectral.gray(inverted)), radius=14, k=0.22).where("bit = 1").select("image_id", "x", "y")
    labelled = settled(C.components(ink))
    kept = settled(C.summarised(labelled, least=20, most=MOST_COMPONENTS, sizes=C.image_sizes(pixels), number=True))
    lines = L.outlines(labelled.join(kept.select("image_id", "label"), ["image_id", "label"], "left_semi")).join(kept.select("image_id", "label", "k"), ["image_id", "label"])
    lines = settled(lines.where(F.size("points") >= 3).withColumn("points", _scaled(F.col("points"), inv)))
    place = F.struct("image_id", "label").alias("id")
    fit = O.circle_fit(lines.select(place, F.explode("points").alias("p")).select("id", "p.x", "p.y"))
    fit = fit.select("id.image_id", "id.label", G.point(_one_digit(F.col("cx")), _one_digit(F.col("cy"))).alias("center"), _one_digit(F.col("radius")).alias("radius"), "error")
    rings = settled(fit.where((F.col("error") < 1.6) & (F.col("radius") > 5 * inv) & (F.col("radius") < 85 * inv)))
    round_ = lines.drop("points").join(rings, ["image_id", "label"]).withColumn("points", F.array("center"))
    walls = lines.join(rings, ["image_id", "label"], "left_anti").withColumn("points", simplified(F.col("points"), params.rdp_tolerance * inv))
    if params.regularise:
        walls = walls.withColumn("points", orthogonalised(F.col("points"), degrees=params.orthogonal_degrees, snap=params.snap * inv))
    walls = walls.withColumn("points", G.without_collinear(F.col("points"), 1.2 * inv)).where(F.size("points") >= 2)
    shut = (G.distance(F.get("points", F.lit(0)), F.element_at("points", -1)) < 8 * inv) & (F.size("points") >= 4)
    walls = walls.withColumn("_shut", shut)
    area = F.when(F.col("_shut") & (G.area(F.col("points")) > 0), _area())
    what = F.when(F.col("_shut"), "Closed Wall Contour").otherwise("Wall Line")
    out = _named(round_, "COL_", 0, kind="CIRCLE", area=js_round(math.pi * F.col("radius") * F.col("radius")))
    return _ordered(out.unionByName(_named(walls, "WALL_", 0, closed=F.col("_shut"), area=area, length=js_round(G.length(F.col("points"), F.col("_shut"))), classification=what)))
