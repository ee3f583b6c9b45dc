"""Schemas, the layer dimension and the parameters of a conversion."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

POINT = "struct<x:double,y:double>"
FEATURE = f"image_id string, seq long, id string, layer string, geometry_type string, is_closed boolean, points array<{POINT}>, center {POINT}, radius double, start_angle double, end_angle double, text string, text_height double, confidence double, classification string, source string, area double, length double, attributes map<string,string>"
LAYER = "name string, color string, aci int, lineweight double, linetype string, visible boolean, locked boolean, order int"

#: The layers of a drawing with colour, colour index, line weight and line type.
LAYERS = [
    ("BUILDINGS", "#E63946", 1, 0.35, "CONTINUOUS"),
    ("ROADS", "#457B9D", 4, 0.25, "CONTINUOUS"),
    ("ROAD_CENTERLINES", "#F4A261", 2, 0.35, "CENTER"),
    ("ROAD_BOUNDARIES", "#2A9D8F", 3, 0.25, "CONTINUOUS"),
    ("PARCELS", "#9D4EDD", 6, 0.35, "CONTINUOUS"),
    ("WALLS", "#E76F51", 1, 0.50, "CONTINUOUS"),
    ("FENCES", "#D4A373", 8, 0.18, "DASHED"),
    ("SIDEWALKS", "#A8DADC", 130, 0.15, "CONTINUOUS"),
    ("PARKING", "#6C757D", 9, 0.18, "CONTINUOUS"),
    ("TREES", "#52B788", 3, 0.25, "CONTINUOUS"),
    ("VEGETATION", "#74C69D", 72, 0.18, "CONTINUOUS"),
    ("WATER", "#0077B6", 5, 0.35, "CONTINUOUS"),
    ("DRAINAGE", "#00B4D8", 4, 0.25, "CONTINUOUS"),
    ("RAILWAYS", "#B5179E", 6, 0.35, "PHANTOM"),
    ("POWER_LINES", "#FFB703", 2, 0.25, "DASHED"),
    ("POLES", "#FB8500", 30, 0.25, "CONTINUOUS"),
    ("CONTOURS", "#B08968", 34, 0.15, "CONTINUOUS"),
    ("DIMENSIONS", "#FFFFFF", 7, 0.18, "CONTINUOUS"),
    ("OTHER", "#ADB5BD", 8, 0.18, "CONTINUOUS"),
]


def layers(spark: SparkSession) -> DataFrame:
    """The layer dimension; 19 rows, so a broadcast of it is bounded."""
    return spark.createDataFrame([(*row, True, False, k) for k, row in enumerate(LAYERS)], LAYER)


@dataclass(frozen=True)
class Parameters:
    """What a conversion can be told; lengths in pixels."""

    min_feature_size: float = 80
    rdp_tolerance: float = 1.8
    orthogonal_degrees: float = 12
    snap: float = 5
    regularise: bool = True
    centrelines: bool = True
    trees: bool = True
    water: bool = True
