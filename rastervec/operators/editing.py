"""Edits of features and layers as DataFrame operations: nothing is changed in place, an edit gives a new table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rastervec.functions import geometry as G
from rastervec.functions.numeric import js_round, to_fixed

#: Bounds of the zoom, the most that fitting zooms in, the margin around a fitted image, and steps in and out.
LEAST_ZOOM, MOST_ZOOM, MOST_FIT, MARGIN = 0.05, 30.0, 2.5, 32
ZOOM_IN, ZOOM_OUT = 1.25, 0.8


def to_world(p: Column, pan: Column, zoom: Column) -> Column:
    """A point of the screen in the drawing."""
    return G.point((p["x"] - pan["x"]) / zoom, (p["y"] - pan["y"]) / zoom)


def to_screen(p: Column, pan: Column, zoom: Column) -> Column:
    return G.point(p["x"] * zoom + pan["x"], p["y"] * zoom + pan["y"])


def fitted(width: Column, height: Column, image_width: Column, image_height: Column) -> Column:
    """struct<zoom,pan> with the whole image in the middle of a view."""
    zoom = F.least((width - MARGIN) / image_width, (height - MARGIN) / image_height, F.lit(MOST_FIT))
    return F.struct(zoom.alias("zoom"), G.point((width - image_width * zoom) / 2, (height - image_height * zoom) / 2).alias("pan"))


def zoomed(zoom: Column, factor: Column | float) -> Column:
    return F.greatest(F.lit(LEAST_ZOOM), F.least(zoom * factor, F.lit(MOST_ZOOM)))


def zoomed_at(pan: Column, zoom: Column, mouse: Column, factor: Column | float) -> Column:
    """struct<zoom,pan> after a zoom that leaves the point under the mouse where it is."""
    new = zoomed(zoom, factor)
    at = lambda c: mouse[c] - (mouse[c] - pan[c]) * (new / zoom)
    return F.struct(new.alias("zoom"), G.point(at("x"), at("y")).alias("pan"))


def measured(a: Column, b: Column, metres_per_pixel: Column | None = None) -> Column:
    """The distance as text: metres with two digits if the drawing is calibrated, else pixels with one."""
    d = G.distance(a, b)
    pixels = F.concat(to_fixed(d, 1), F.lit(" px"))
    return pixels if metres_per_pixel is None else F.when(metres_per_pixel.isNull(), pixels).otherwise(F.concat(to_fixed(d * metres_per_pixel, 2), F.lit(" m")))


def moved(features: DataFrame, moves: DataFrame) -> DataFrame:
    """The features, those with a row (id, dx, dy) in ``moves`` shifted, their centres too."""
    rows = features.join(moves.select(F.col("id"), F.col("dx").alias("_dx"), F.col("dy").alias("_dy")), "id", "left")
    dx, dy = F.coalesce("_dx", F.lit(0.0)), F.coalesce("_dy", F.lit(0.0))
    shifted = {"points": F.transform("points", lambda p: G.point(p["x"] + dx, p["y"] + dy))}
    if "center" in features.columns:
        shifted["center"] = F.when(F.col("center").isNotNull(), G.point(F.col("center.x") + dx, F.col("center.y") + dy))
    return rows.withColumns(shifted).select(features.columns)


def dragged(features: DataFrame, drags: DataFrame) -> DataFrame:
    """The features, those with a row (id, vertex, x, y) in ``drags`` with that vertex (from 0 on) there, to a tenth; other vertices' numbers are passed over."""
    rows = features.join(drags.select("id", F.col("vertex").alias("_v"), F.col("x").alias("_x"), F.col("y").alias("_y")), "id", "left")
    tenth = lambda c: js_round(F.col(c) * 10) / 10
    points = F.transform("points", lambda p, i: F.when(i == F.col("_v"), G.point(tenth("_x"), tenth("_y"))).otherwise(p))
    return rows.withColumn("points", F.when(F.col("_v").isNull(), F.col("points")).otherwise(points)).select(features.columns)


def upserted(features: DataFrame, updates: DataFrame, *, insert: bool = True) -> DataFrame:
    """The features with the rows of ``updates`` in place of those with their ids; with ``insert`` also those whose ids are new."""
    kept = features.join(updates.select("id"), "id", "left_anti").select(features.columns)
    new = updates if insert else updates.join(features.select("id"), "id", "left_semi")
    return kept.unionByName(new.select(features.columns))


def layer_name(typed: Column) -> Column:
    """The name of a new layer: trimmed, in capitals, white space as underscores; null for none."""
    clean = F.regexp_replace(F.upper(F.regexp_replace(typed, r"^\s+|\s+$", "")), r"\s+", "_")
    return F.when(clean != "", clean)


def with_layer(layers: DataFrame, typed: str, color: str = "#3B82F6") -> DataFrame:
    """The layers and a new one with defaults; a name of white space alone adds none."""
    new = layers.sparkSession.range(1).select(layer_name(F.lit(typed)).alias("name"), F.lit(color).alias("color"), F.lit(7).alias("aci"), F.lit(0.25).alias("lineweight"), F.lit("CONTINUOUS").alias("linetype"), F.lit(True).alias("visible"), F.lit(False).alias("locked"))
    return layers.unionByName(new.where("name is not null"), allowMissingColumns=True)


def with_layers_changed(layers: DataFrame, names: list[str], *, toggle: str | None = None, color: str | None = None) -> DataFrame:
    """The layers, of those named ``visible`` or ``locked`` turned round, or the colour changed."""
    own = F.col("name").isin(*names)
    if toggle:
        layers = layers.withColumn(toggle, F.col(toggle) != own)
    return layers.withColumn("color", F.when(own, color).otherwise(F.col("color"))) if color else layers


def pushed(log: DataFrame, changes: DataFrame, *, at: int) -> DataFrame:
    """An edit log (version, id, ...) after an edit at version ``at``: what had been undone is cut off, and the changes are version at + 1."""
    return log.where(F.col("version") <= at).unionByName(changes.withColumn("version", F.lit(at + 1).cast(log.schema["version"].dataType)).select(log.columns))
