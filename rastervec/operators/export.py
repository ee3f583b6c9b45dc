"""Encoders: a line, document part or record for each feature, in parallel; documents are concatenated per image in order of seq."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rastervec.functions import geometry as G
from rastervec.functions.numeric import points_fixed, to_fixed, truthy_or
from rastervec.operators.components import settled
from rastervec.operators.features import boxed, safe_layer_name


def export_set(features: DataFrame) -> DataFrame:
    """Adds shape: polygons, lines, points, or null for what a shapefile can't hold."""
    n = F.size("points")
    point = F.col("geometry_type").isin("POINT", "CIRCLE")
    return features.withColumn("shape", F.when(F.col("is_closed") & (n >= 3), "polygons").when(~F.col("is_closed") & (n >= 2), "lines").when(point, "points"))


def first_point(features: DataFrame) -> Column:
    own = F.get("points", F.lit(0))
    at = F.coalesce("center", own) if "center" in features.columns else own
    return F.coalesce(at, G.point(F.lit(0.0), F.lit(0.0)))


def shape_of(features: DataFrame) -> Column:
    """point, ring, line or null."""
    n = F.size("points")
    return F.when(F.col("geometry_type").isin("POINT", "CIRCLE"), "point").when(F.col("is_closed") & (n >= 3), "ring").when(n >= 2, "line")


def csv_lines(features: DataFrame) -> DataFrame:
    """(seq, line): id, layer, type, confidence, length, area, vertices and WKT; nothing is escaped, rings repeat their first point."""
    rows = features.withColumn("_shape", shape_of(features))
    chosen = F.when(F.col("_shape") == "point", F.array(first_point(features))).when(F.col("_shape") == "ring", F.concat("points", F.slice("points", 1, 1))).otherwise(F.col("points"))
    rows = rows.withColumn("_p", points_fixed(chosen, 2))
    body = F.array_join(F.transform("_p", lambda p: F.concat_ws(" ", p["x"], p["y"])), ", ")
    wkt = F.when(F.col("_shape") == "point", F.concat(F.lit('"POINT('), body, F.lit(')"'))).when(F.col("_shape") == "ring", F.concat(F.lit('"POLYGON(('), body, F.lit('))"'))).when(F.col("_shape") == "line", F.concat(F.lit('"LINESTRING('), body, F.lit(')"'))).otherwise("")
    number = lambda c: to_fixed(F.coalesce(F.col(c), F.lit(0.0)) if c in features.columns else F.lit(0.0), 2)
    kind = F.col("classification") if "classification" in features.columns else F.lit("")
    return rows.select("seq", F.concat_ws(",", F.col("id").cast("string"), "layer", kind, "geometry_type", number("confidence"), number("length"), number("area"), F.size("points").cast("string"), wkt).alias("line"))


def quoted(c: Column) -> Column:
    """A JSON text of one value."""
    text = F.to_json(F.array(c))
    return F.substring(text, F.lit(2), F.length(text) - 2)


def properties(features: DataFrame) -> Column:
    """A feature's properties as JSON; its attributes replace those with the same name and follow the others. Nulls are left out."""
    own = {*features.columns}
    number = lambda c, digits: quoted(to_fixed(F.coalesce(F.col(c), F.lit(0.0)), digits).cast("double")) if c in own else F.lit("0.0")
    text = lambda c: F.when(F.col(c).isNotNull(), quoted(F.col(c))) if c in own else F.lit(None).cast("string")
    entries = [("id", text("id")), ("layer", text("layer")), ("classification", text("classification")), ("confidence", number("confidence", 2)), ("geometryType", text("geometry_type")), ("source", text("source")), ("area", number("area", 1)), ("length", number("length", 1))]
    base = F.array(*(F.struct(F.lit(k).alias("key"), v.alias("value")) for k, v in entries))
    if "attributes" in own:
        given = F.transform(F.map_entries(F.coalesce("attributes", F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>")))), lambda e: F.struct(e["key"].alias("key"), quoted(e["value"]).alias("value")))
        base = F.transform(base, lambda e: F.struct(e["key"].alias("key"), F.coalesce(F.try_element_at(F.map_from_entries(given), e["key"]), e["value"]).alias("value")))
        base = F.concat(base, F.filter(given, lambda e: ~e["key"].isin(*(k for k, _ in entries))))
    return F.concat(F.lit("{"), F.array_join(F.transform(F.filter(base, lambda e: e["value"].isNotNull()), lambda e: F.concat(quoted(e["key"]), F.lit(":"), e["value"])), ","), F.lit("}"))


def geojson_parts(features: DataFrame, *, height: float = 1000.0, metres_per_pixel: float = 1.0, affine: list[float] | None = None) -> DataFrame:
    """(seq, geojson): one GeoJSON feature each, in local metres with y up, or by the affine map; features without a geometry go."""
    rows = features.withColumn("_shape", shape_of(features)).where("_shape is not null")
    chosen = F.when(F.col("_shape") == "point", F.array(first_point(features))).otherwise(F.col("points"))
    at = F.transform(chosen, lambda p: G.affine(p, affine) if affine else G.point(p["x"] * metres_per_pixel, (height - p["y"]) * metres_per_pixel))
    rows = rows.withColumn("_p", F.transform(points_fixed(at, 6 if affine else 3), lambda p: F.array(p["x"].cast("double"), p["y"].cast("double"))))
    first, last = F.get("_p", F.lit(0)), F.element_at("_p", -1)
    ring = F.when((first[0] != last[0]) | (first[1] != last[1]), F.concat("_p", F.array(first))).otherwise(F.col("_p"))
    shape = F.when(F.col("_shape") == "point", F.to_json(F.struct(F.lit("Point").alias("type"), first.alias("coordinates"))))
    shape = shape.when(F.col("_shape") == "ring", F.to_json(F.struct(F.lit("Polygon").alias("type"), F.array(ring).alias("coordinates"))))
    shape = shape.otherwise(F.to_json(F.struct(F.lit("LineString").alias("type"), F.col("_p").alias("coordinates"))))
    return rows.select("seq", F.concat(F.lit('{"type":"Feature","id":'), quoted(F.col("id")), F.lit(',"properties":'), properties(features), F.lit(',"geometry":'), shape, F.lit("}")).alias("geojson"))


def extents(features: DataFrame, *, height: float = 0.0, scale: float = 1.0, invert_y: bool = False) -> DataFrame:
    """(min_x, min_y, max_x, max_y) of all features, circles by centre and radius; 0 to 100 if there are none. Bounds are taken for each feature first."""
    b = boxed(features.withColumn("radius", truthy_or(F.col("radius"), 10.0)) if "radius" in features.columns else features).where("_box.min_x is not null").select("_box.*")
    if invert_y:
        b = b.select("min_x", "max_x", (height - F.col("max_y")).alias("min_y"), (height - F.col("min_y")).alias("max_y"))
    out = b.agg(*(f(F.col(c) * scale).alias(c) for c, f in (("min_x", F.min), ("min_y", F.min), ("max_x", F.max), ("max_y", F.max))))
    return out.select(*(F.coalesce(c, F.lit(d)).alias(c) for c, d in (("min_x", 0.0), ("min_y", 0.0), ("max_x", 100.0), ("max_y", 100.0))))


def numbered(rows: DataFrame, *, key: str = "seq", total: Column | None = None) -> DataFrame:
    """Adds _k, the number of a row from 1 on in the order of ``key``, and _before, the sum of ``total`` (rows) over all rows before it.

    Rows are put into ranges of the key and written once, with their range and their place in it, so all that follows reads the same ranges, whatever adaptive execution makes of a plan.
    Ranges are then summed, and the sums, a row for each range, are broadcast: no task sees all rows, and rows are shuffled once."""
    rows = rows.withColumn("_size", F.lit(1).cast("long") if total is None else total.cast("long")).repartitionByRange(key).sortWithinPartitions(key)
    if total is not None:
        rows = rows.mapInArrow(_running, T.StructType([*rows.schema, T.StructField("_run", T.LongType())]))
    rows = settled(rows.withColumn("_at", F.monotonically_increasing_id()))  # the partition, and the place in it in the lower 33 bits
    part, own = F.shiftright("_at", 33), F.col("_at").bitwiseAND((1 << 33) - 1)
    earlier = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    sums = rows.groupBy(part.alias("_part")).agg(F.count("*").alias("_n"), F.sum("_size").alias("_sum"))
    sums = settled(sums.select("_part", *(F.coalesce(F.sum(c).over(earlier), F.lit(0)).alias(a) for c, a in (("_n", "_base"), ("_sum", "_start")))))
    rows = rows.withColumns({"_part": part, "_k": own + 1, "_before": own if total is None else F.col("_run")}).join(F.broadcast(sums), "_part")
    return rows.withColumns({"_k": F.col("_k") + F.col("_base"), "_before": F.col("_before") + F.col("_start")}).drop("_part", "_at", "_run", "_base", "_start", "_size")


def _running(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds the sum of _size over the rows before, in the order in which a partition's rows come."""
    so_far = 0
    for batch in batches:
        sizes = batch.column(batch.schema.get_field_index("_size")).to_numpy()
        upto = so_far + np.cumsum(sizes)
        so_far = int(upto[-1]) if len(upto) else so_far
        yield batch.append_column("_run", pa.array(upto - sizes))


def pair(code: int, value) -> Column:
    """A group code and its value, each on a line (CRLF)."""
    return F.concat(F.lit(f"{code}\r\n"), value if isinstance(value, Column) else F.lit(str(value)), F.lit("\r\n"))


def dxf_entities(features: DataFrame, *, height: float = 1000.0, scale: float = 1.0, invert_y: bool = True, first_handle: int = 0x28, owner: str = "22") -> DataFrame:
    """(seq, entity): group codes and values, each on a line of its own (CRLF); features that give no entity go, but use up their handle. owner: handle of the model space."""
    rows = numbered(features).withColumn("_handle", F.hex(F.col("_k") + (first_handle - 1)))
    have = lambda c, d: truthy_or(F.col(c), d) if c in features.columns else F.lit(d)
    n = F.size("points")
    same = G.distance(F.get("points", F.lit(0)), F.element_at("points", -1)) < 1e-4
    outline = F.when(F.col("is_closed") & (n > 2) & same, F.slice("points", 1, n - 1)).otherwise(F.col("points"))
    kind = F.col("geometry_type")
    line = (kind == "LINE") & (n == 2)
    chosen = F.when(kind.isin("CIRCLE", "ARC", "TEXT"), F.array(first_point(features))).when(kind == "POINT", F.slice("points", 1, 1)).when(line, F.col("points")).otherwise(outline)
    place = F.transform(chosen, lambda p: G.point(p["x"] * scale, ((height - p["y"]) if invert_y else p["y"]) * scale))
    rows = rows.withColumn("_p", points_fixed(place, 4))
    head = lambda name: F.concat(pair(0, name), pair(5, F.col("_handle")), pair(330, owner), pair(100, "AcDbEntity"), pair(8, safe_layer_name(F.col("layer"))))
    xy = lambda i, a, b: F.concat(pair(a, F.get("_p", F.lit(i))["x"]), pair(b, F.get("_p", F.lit(i))["y"]))
    degrees = lambda c, d: (360 - have(c, d) * 180 / math.pi) % 360 if invert_y else have(c, d) * 180 / math.pi
    round_ = F.concat(xy(0, 10, 20), pair(30, 0), pair(40, to_fixed(have("radius", 10.0) * scale, 4)))
    entity = (
        F.when((kind == "POINT") & (n > 0), F.concat(head("POINT"), pair(100, "AcDbPoint"), xy(0, 10, 20), pair(30, 0)))
        .when(line, F.concat(head("LINE"), pair(100, "AcDbLine"), xy(0, 10, 20), pair(30, 0), xy(1, 11, 21), pair(31, 0)))
        .when((kind.isin("LWPOLYLINE", "POLYLINE") | ((kind == "LINE") & (n > 2))) & (F.size("_p") >= 2), F.concat(head("LWPOLYLINE"), pair(100, "AcDbPolyline"), pair(90, F.size("_p").cast("string")), pair(70, F.when(F.col("is_closed"), "1").otherwise("0")), pair(43, 0), F.array_join(F.transform("_p", lambda p: F.concat(F.lit("10\r\n"), p["x"], F.lit("\r\n20\r\n"), p["y"], F.lit("\r\n"))), "")))
        .when(kind == "CIRCLE", F.concat(head("CIRCLE"), pair(100, "AcDbCircle"), round_))
        .when(kind == "ARC", F.concat(head("ARC"), pair(100, "AcDbCircle"), round_, pair(100, "AcDbArc"), pair(50, to_fixed(degrees("start_angle", 0.0), 2)), pair(51, to_fixed(degrees("end_angle", math.pi), 2))))
        .when(kind == "TEXT", F.concat(head("TEXT"), pair(100, "AcDbText"), xy(0, 10, 20), pair(30, 0), pair(40, to_fixed(have("text_height", 12.0) * scale, 2)), pair(1, F.coalesce("text", F.lit("")) if "text" in features.columns else ""), pair(7, "STANDARD")))
    )
    return rows.select("seq", entity.alias("entity")).where("entity is not null")


def dbf_records(features: DataFrame) -> DataFrame:
    """(seq, record): 91 characters - deletion mark, id, layer, class, confidence, area and length in fixed widths; beyond ASCII: an underscore."""
    text = lambda c, n: F.rpad(F.substring(F.regexp_replace(F.coalesce(c.cast("string"), F.lit("")), r"[^\x20-\x7E]", "_"), 1, n), n, " ")
    number = lambda c, n: F.lpad(F.substring(to_fixed(F.coalesce(F.col(c), F.lit(0.0)), 2) if c in features.columns else F.lit("0.00"), 1, n), n, " ")
    kind = F.col("classification") if "classification" in features.columns else F.lit("")
    return features.select("seq", F.concat(F.lit(" "), text(F.col("id"), 16), text(F.col("layer"), 20), text(kind, 24), number("confidence", 6), number("area", 12), number("length", 12)).alias("record"))


def svg_parts(features: DataFrame, layers: DataFrame) -> DataFrame:
    """(layer, seq, svg): an element for each drawable feature of a declared layer."""
    rows = features.join(layers.select(F.col("name").alias("layer"), "color", "lineweight", "linetype"), "layer").withColumn("_shape", shape_of(features))
    circle = F.col("geometry_type") == "CIRCLE"
    rows = rows.where(circle | F.col("_shape").isin("ring", "line")).withColumn("_p", points_fixed(F.when(circle, F.array(first_point(features))).otherwise(F.col("points")), 1))
    named = F.col("id").cast("string")
    width = F.greatest(F.lit(1.0), F.floor(F.col("lineweight") * 4 + 0.5)).cast("int").cast("string")
    dash = F.when(F.col("linetype") == "DASHED", ' stroke-dasharray="6,4"').when(F.col("linetype") == "CENTER", ' stroke-dasharray="14,4,4,4"').otherwise("")
    style = F.concat(F.lit(' stroke="'), F.col("color"), F.lit('" stroke-width="'), width, F.lit('"'), dash, F.lit("/>"))
    body = F.array_join(F.transform("_p", lambda p: F.concat_ws(",", p["x"], p["y"])), " ")
    fill = lambda share: F.concat(F.lit('" fill="'), F.col("color"), F.lit(f'" fill-opacity="{share}"'))
    radius = to_fixed(truthy_or(F.col("radius"), 10.0) if "radius" in features.columns else F.lit(10.0), 1)
    round_ = F.concat(F.lit('<circle id="'), named, F.lit('" cx="'), F.get("_p", F.lit(0))["x"], F.lit('" cy="'), F.get("_p", F.lit(0))["y"], F.lit('" r="'), radius, fill(0.25), F.concat(F.lit(' stroke="'), F.col("color"), F.lit('" stroke-width="'), width, F.lit('"/>')))
    svg = F.when(circle, round_).when(F.col("_shape") == "ring", F.concat(F.lit('<polygon id="'), named, F.lit('" points="'), body, fill(0.2), style)).otherwise(F.concat(F.lit('<polyline id="'), named, F.lit('" points="'), body, F.lit('" fill="none"'), style))
    return rows.select("layer", "seq", svg.alias("svg"))


def kml_parts(features: DataFrame, *, height: float = 1000.0, metres_per_pixel: float = 1.0, longitude: float = 31.2357, latitude: float = 30.0444, affine: list[float] | None = None) -> DataFrame:
    """(seq, kml): placemarks around an anchor, or by the affine map (then not rounded); rings always repeat their first point."""
    rows = features.withColumn("_shape", shape_of(features)).where("_shape is not null")
    chosen = F.when(F.col("_shape") == "point", F.array(first_point(features))).when(F.col("_shape") == "ring", F.concat("points", F.slice("points", 1, 1))).otherwise(F.col("points"))
    place = F.transform(chosen, lambda p: G.point(F.lit(longitude) + p["x"] * metres_per_pixel / 111320, F.lit(latitude) + (height - p["y"]) * metres_per_pixel / 110540))
    plain = F.transform(F.transform(chosen, lambda p: G.affine(p, affine)), lambda p: F.struct(p["x"].cast("string").alias("x"), p["y"].cast("string").alias("y"))) if affine else None
    rows = rows.withColumn("_p", points_fixed(place, 6) if plain is None else plain)
    own = lambda c, d: F.coalesce(F.col(c).cast("string"), F.lit(d)) if c in features.columns else F.lit(d)
    data = F.concat(F.lit("<ExtendedData>"), *(F.concat(F.lit(f'<Data name="{n}"><value>'), v, F.lit("</value></Data>")) for n, v in (("Layer", F.col("layer")), ("Class", own("classification", "")), ("Confidence", own("confidence", "0.0")), ("Area", own("area", "0.0")), ("Length", own("length", "0.0")))), F.lit("</ExtendedData>"))
    body = F.concat(F.lit("<coordinates>"), F.array_join(F.transform("_p", lambda p: F.concat(p["x"], F.lit(","), p["y"], F.lit(",0"))), " "), F.lit("</coordinates>"))
    shape = F.when(F.col("_shape") == "point", F.concat(F.lit("<Point>"), body, F.lit("</Point>"))).when(F.col("_shape") == "ring", F.concat(F.lit("<Polygon><outerBoundaryIs><LinearRing>"), body, F.lit("</LinearRing></outerBoundaryIs></Polygon>"))).otherwise(F.concat(F.lit("<LineString>"), body, F.lit("</LineString>")))
    return rows.select("seq", F.concat(F.lit("<Placemark><name>"), F.col("id").cast("string"), F.lit("</name><styleUrl>#style_"), "layer", F.lit("</styleUrl>"), data, shape, F.lit("</Placemark>")).alias("kml"))


def document(parts: DataFrame, path: str, *, column: str, key: str = "seq", separator: str = "\n") -> None:
    """Writes the parts as text files whose names are in the order of the key: to read them one after another gives the whole document."""
    parts.repartitionByRange(key).sortWithinPartitions(key).select(column).write.mode("overwrite").option("lineSep", separator).text(path)


def file_name(name: Column) -> Column:
    """Without its extension, white space as underscores; a default for none."""
    clean = F.regexp_replace(F.regexp_replace(F.coalesce(name, F.lit("")), r"\.[^/.]+$", ""), r"\s+", "_")
    return F.when(clean == "", "drawing").otherwise(clean)
