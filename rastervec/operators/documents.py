"""Whole documents: (part, seq, text) or (file, part, seq, bytes) rows that, one after another in this order, are the files.

Features give a row each, in parallel; what stands before and after them are rows of their own. Nothing is gathered.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from datetime import UTC, date, datetime

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rastervec.functions import geometry as G
from rastervec.functions.numeric import to_fixed
from rastervec.operators import export as X
from rastervec.operators.archive import archive
from rastervec.operators.components import settled
from rastervec.operators.features import layer_registry, safe_layer_name

HEAD, BODY, TAIL = 0, 1, 2


def _row(spark, part: int, text: Column, rows: DataFrame | None = None) -> DataFrame:
    return (spark.range(1) if rows is None else rows).select(F.lit(part).alias("part"), F.lit(0).cast("long").alias("seq"), text.alias("text"))


def _document(body: DataFrame, column: str, head: DataFrame, tail: DataFrame | None) -> DataFrame:
    rows = head.unionByName(body.select(F.lit(BODY).alias("part"), F.col("seq").cast("long").alias("seq"), F.col(column).alias("text")))
    return rows if tail is None else rows.unionByName(tail)


def csv_document(features: DataFrame, *, calibrated: bool = False) -> DataFrame:
    """A header that names the unit, and a line for each feature."""
    unit = "m" if calibrated else "px"
    head = f"Feature_ID,Layer,Classification,Geometry_Type,Confidence,Length_{unit},Area_{unit}2,Vertex_Count,WKT_Geometry"
    return _document(X.csv_lines(features), "line", _row(features.sparkSession, HEAD, F.lit(head)), None)


def geojson_document(features: DataFrame, *, name: str = "plan", **how) -> DataFrame:
    """A feature collection."""
    spark, parts = features.sparkSession, X.geojson_parts(features, **how)
    first = parts.agg(F.min("seq").alias("_first"))
    parts = parts.join(F.broadcast(first)).select("seq", F.concat(F.when(F.col("seq") > F.col("_first"), ",").otherwise(""), "geojson").alias("geojson"))  # one row on the right
    head = F.concat(F.lit('{"type":"FeatureCollection","name":'), X.quoted(F.lit(name)), F.lit(',"features":['))
    return _document(parts, "geojson", _row(spark, HEAD, head), _row(spark, TAIL, F.lit("]}")))


def _place(layers: DataFrame) -> Column:
    """A layer's place: its column order, or none."""
    return F.coalesce(F.col("order") if "order" in layers.columns else F.lit(None).cast("int"), F.lit((1 << 31) - 1))


def kml_styles(layers: DataFrame) -> Column:
    """A layer's style: colours are alpha, blue, green, red."""
    hexes = F.rpad(F.regexp_replace("color", "#", ""), 6, "0")
    bgr = F.concat(F.substring(hexes, 5, 2), F.substring(hexes, 3, 2), F.substring(hexes, 1, 2))
    width = F.greatest(F.lit(1), F.floor(F.col("lineweight") * 5 + 0.5)).cast("string")
    return F.concat(F.lit('<Style id="style_'), "name", F.lit('"><LineStyle><color>ff'), bgr, F.lit("</color><width>"), width, F.lit("</width></LineStyle><PolyStyle><color>66"), bgr, F.lit("</color></PolyStyle></Style>"))


def kml_document(features: DataFrame, layers: DataFrame, *, name: str = "plan", **how) -> DataFrame:
    """Styles of all layers in their order, then a placemark for each feature."""
    spark = features.sparkSession
    styles = layers.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(_place(layers).alias("k"), "name", kml_styles(layers).alias("s")))), lambda r: r["s"]), "\n").alias("s"))  # the layer dimension is small
    head = F.concat(F.lit(f'<?xml version="1.0" encoding="UTF-8"?>\n<kml xmlns="http://www.opengis.net/kml/2.2">\n<Document><name>{name}</name>\n'), "s")
    return _document(X.kml_parts(features, **how), "kml", _row(spark, HEAD, head, styles), _row(spark, TAIL, F.lit("</Document>\n</kml>")))


def svg_document(features: DataFrame, layers: DataFrame, *, width: int, height: int) -> DataFrame:
    """A group for each declared layer that has elements, in the order of the layers (column order, then the name)."""
    spark = features.sparkSession
    order = layers.select(F.col("name").alias("layer"), F.dense_rank().over(X.Window.orderBy(_place(layers), "name")).alias("order"))  # the layer dimension is small
    parts = X.svg_parts(features, layers).join(F.broadcast(order), "layer")
    used = parts.select("layer", "order").distinct()
    place = lambda k: (F.col("order") * 3 + k).cast("int").alias("part")
    zero = F.lit(0).cast("long").alias("seq")
    rows = used.select(place(1), zero, F.concat(F.lit('<g id="layer_'), "layer", F.lit('">')).alias("text"))
    rows = rows.unionByName(parts.select(place(2), F.col("seq").cast("long").alias("seq"), F.col("svg").alias("text"))).unionByName(used.select(place(3), zero, F.lit("</g>").alias("text")))
    head = f'<?xml version="1.0" encoding="UTF-8"?>\n<svg xmlns="http://www.w3.org/2000/svg" version="1.1" width="{width}" height="{height}" viewBox="0 0 {width} {height}">\n<rect width="100%" height="100%" fill="#0F172A"/>'
    return _row(spark, HEAD, F.lit(head)).unionByName(rows).unionByName(_row(spark, (1 << 31) - 1, F.lit("</svg>")))


# ---- drawings ----

#: Codes of drawing units, and drawing units in a metre.
UNIT_CODE = {"m": 6, "ft": 2, "cm": 5}
PER_METRE = {"ft": 3.280839895, "cm": 100.0}

#: Line types with what they look like, the length of their pattern, and its dashes (negative: gaps).
LINE_TYPES = [
    ("ByBlock", "", 0, []),
    ("ByLayer", "", 0, []),
    ("CONTINUOUS", "Solid line", 0, []),
    ("CENTER", "Center ____ _ ____ _ ____", 31.75, [19.05, -6.35, 0, -6.35]),
    ("DASHED", "Dashed __ __ __ __", 19.05, [12.7, -6.35]),
    ("PHANTOM", "Phantom ____ _ _ ____ _ _", 38.1, [19.05, -6.35, 6.35, -6.35, 6.35, -6.35]),
    ("DOT", "Dot . . . . .", 6.35, [0, -6.35]),
]
#: Handles of the tables and spaces, in the order in which they are given out; the next is the first free one.
FIRST_HANDLE = 0x21
OWNERS = ("blocks", "model", "paper", "layers", "line_types", "styles", "applications", "views")


class _Codes:
    """Group codes and values as Columns, with handles that count up."""

    def __init__(self, handle: int):
        self.handle, self.pairs = handle, []

    def add(self, *pairs) -> _Codes:
        self.pairs += pairs
        return self

    def record(self, kind: str, owner: str, *more) -> _Codes:
        self.handle += 1
        return self.add((0, kind), (5, f"{self.handle - 1:X}"), (330, owner), *more)

    def text(self) -> Column:
        return F.concat(*(X.pair(code, value) for code, value in self.pairs))


def _number(value: float) -> str:
    return f"{value:g}"


def _head(extent: DataFrame, code: int, own: dict[str, str], registry: DataFrame, n_layers: int) -> DataFrame:
    """All before the entities, from one row of extents and one of the layers' records."""
    at = {c: to_fixed(F.col(c), 4) for c in ("min_x", "min_y", "max_x", "max_y")}
    middle = lambda a, b: to_fixed((F.col(a) + F.col(b)) / 2, 4)
    c = _Codes(FIRST_HANDLE + len(OWNERS))
    variable = lambda name, *pairs: c.add((9, f"${name}"), *pairs)
    c.add((0, "SECTION"), (2, "HEADER"))
    variable("ACADVER", (1, "AC1027"))
    variable("ACADMAINTVER", (70, 105))
    variable("DWGCODEPAGE", (3, "ANSI_1252"))
    variable("INSBASE", (10, 0), (20, 0), (30, 0))
    variable("EXTMIN", (10, at["min_x"]), (20, at["min_y"]), (30, 0))
    variable("EXTMAX", (10, at["max_x"]), (20, at["max_y"]), (30, 0))
    variable("LIMMIN", (10, 0), (20, 0))
    variable("LIMMAX", (10, at["max_x"]), (20, at["max_y"]))
    for name, value in (("INSUNITS", code), ("MEASUREMENT", 1), ("LUNITS", 2), ("LUPREC", 4), ("AUNITS", 0), ("AUPREC", 2)):
        variable(name, (70, value))
    variable("HANDSEED", (5, "FFFF")).add((0, "ENDSEC"), (0, "SECTION"), (2, "CLASSES"), (0, "ENDSEC"), (0, "SECTION"), (2, "TABLES"))
    table = lambda name, key, n: c.add((0, "TABLE"), (2, name), (5, own[key]), (100, "AcDbSymbolTable"), (70, n))
    entry = lambda kind, key, marker, *more: c.record(kind, own[key], (100, "AcDbSymbolTableRecord"), (100, marker), *more)
    table("VPORT", "views", 1)
    height = to_fixed(F.greatest(F.lit(10.0), F.col("max_y") - F.col("min_y")), 4)
    entry("VPORT", "views", "AcDbViewportTableRecord", (2, "*ACTIVE"), (70, 0), (10, 0), (20, 0), (11, 1), (21, 1), (12, middle("min_x", "max_x")), (22, middle("min_y", "max_y")), (40, height), (41, 1.4)).add((0, "ENDTAB"))
    table("LTYPE", "line_types", len(LINE_TYPES))
    for name, looks, whole, dashes in LINE_TYPES:
        entry("LTYPE", "line_types", "AcDbLinetypeTableRecord", (2, name), (70, 0), (3, looks), (72, 65), (73, len(dashes)), (40, _number(whole)), *((49, _number(d)) for d in dashes))
    c.add((0, "ENDTAB"))
    table("LAYER", "layers", n_layers + 1)
    entry("LAYER", "layers", "AcDbLayerTableRecord", (2, "0"), (70, 0), (62, 7), (6, "CONTINUOUS"), (370, -3))
    before, layers = c.text(), F.col("_layers")
    c.pairs, c.handle = [(0, "ENDTAB")], c.handle + n_layers
    table("STYLE", "styles", 1)
    entry("STYLE", "styles", "AcDbTextStyleTableRecord", (2, "STANDARD"), (70, 0), (40, 0), (41, 1), (50, 0), (71, 0), (42, 2.5), (3, "txt"), (4, "")).add((0, "ENDTAB"))
    table("APPID", "applications", 1)
    entry("APPID", "applications", "AcDbRegAppTableRecord", (2, "ACAD"), (70, 0)).add((0, "ENDTAB"))
    table("BLOCK_RECORD", "blocks", 2)
    for space in ("model", "paper"):
        c.add((0, "BLOCK_RECORD"), (5, own[space]), (330, own["blocks"]), (100, "AcDbSymbolTableRecord"), (100, "AcDbBlockTableRecord"), (2, f"*{space.upper()}_SPACE"))
    c.add((0, "ENDTAB"), (0, "ENDSEC"), (0, "SECTION"), (2, "BLOCKS"))
    for space in ("model", "paper"):
        name, begin = f"*{space.upper()}_SPACE", ((100, "AcDbEntity"), (8, "0"))
        c.record("BLOCK", own[space], *begin, (100, "AcDbBlockBegin"), (2, name), (70, 0), (10, 0), (20, 0), (30, 0), (3, name), (1, ""))
        c.record("ENDBLK", own[space], *begin, (100, "AcDbBlockEnd"))
    c.add((0, "ENDSEC"), (0, "SECTION"), (2, "ENTITIES"))
    return extent.join(F.broadcast(registry)).select(F.concat(before, layers, c.text()).alias("text")), c.handle  # one row on either side


def layer_records(features: DataFrame, layers: DataFrame, *, owner: str, first_handle: int) -> DataFrame:
    """(n, _layers): the records of all layers but 0, declared ones first and in their order, others as features name them first; a row, for a drawing's layers are few."""
    known = layers.select(F.col("name"), *(F.col(c) if c in layers.columns else F.lit(d).alias(c) for c, d in (("visible", True), ("locked", False))), _place(layers).alias("_place")).dropDuplicates(["name"])
    met = features.groupBy(safe_layer_name(F.col("layer")).alias("safe")).agg(F.min("seq").alias("_met"))
    rows = layer_registry(features, layers).where("safe <> '0'").join(known.withColumn("_declared", F.lit(0)), "name", "left").join(met, "safe", "left")
    order = F.when(F.col("_declared") == 0, F.struct(F.lit(0).alias("k"), F.col("_place").cast("long").alias("at"))).otherwise(F.struct(F.lit(1).alias("k"), F.col("_met").cast("long").alias("at")))
    rows = rows.withColumn("_k", F.row_number().over(X.Window.orderBy(order, "safe")))
    colour = F.when(F.coalesce("visible", F.lit(True)), F.col("aci")).otherwise(-F.col("aci"))
    weight = F.floor(F.when(F.coalesce("lineweight", F.lit(0.0)) == 0, 0.25).otherwise(F.col("lineweight")) * 100 + 0.5)
    record = F.concat(
        X.pair(0, "LAYER"), X.pair(5, F.hex(F.col("_k") + (first_handle - 1))), X.pair(330, owner), X.pair(100, "AcDbSymbolTableRecord"), X.pair(100, "AcDbLayerTableRecord"), X.pair(2, F.col("safe")), X.pair(70, F.when(F.coalesce("locked", F.lit(False)), "4").otherwise("0")),
        X.pair(62, colour.cast("string")), X.pair(6, F.coalesce("linetype", F.lit("CONTINUOUS"))), X.pair(370, weight.cast("string")),
    )
    rows = rows.agg(F.count("*").alias("n"), F.array_sort(F.collect_list(F.struct("_k", record.alias("r")))).alias("_r"))
    return rows.select("n", F.array_join(F.transform("_r", lambda r: r["r"]), "").alias("_layers"))


def dxf_document(features: DataFrame, layers: DataFrame, *, height: float = 1000.0, invert_y: bool = True, unit: str = "", metres_per_pixel: float = 1.0) -> DataFrame:
    """Header, classes, tables, blocks, entities, objects; (part, seq, text), whose texts end with a line end themselves."""
    spark, scale = features.sparkSession, metres_per_pixel * PER_METRE.get(unit, 1.0)
    own = {k: f"{FIRST_HANDLE + i:X}" for i, k in enumerate(OWNERS)}
    first_layer = FIRST_HANDLE + len(OWNERS) + 1 + len(LINE_TYPES) + 1  # after the view, the line types and layer 0
    registry = layer_records(features, layers, owner=own["layers"], first_handle=first_layer)
    n_layers = registry.first()["n"]
    head, handle = _head(X.extents(features, height=height, scale=scale, invert_y=invert_y), UNIT_CODE.get(unit, 0), own, registry, n_layers)
    entities = X.dxf_entities(features, height=height, scale=scale, invert_y=invert_y, first_handle=handle, owner=own["model"])
    root = F.hex(F.col("n") + handle)
    end = F.concat(*(X.pair(k, v) for k, v in ((0, "ENDSEC"), (0, "SECTION"), (2, "OBJECTS"), (0, "DICTIONARY"), (5, root), (330, "0"), (100, "AcDbDictionary"), (281, 1), (0, "ENDSEC"), (0, "EOF"))))
    return _document(entities, "entity", _row(spark, HEAD, F.col("text"), head), _row(spark, TAIL, end, features.agg(F.count("*").alias("n"))))


# ---- shapefiles ----

#: Types of shapes, and the texts of the coordinate systems.
SHAPE_TYPE = {"polygons": 5, "lines": 3, "points": 1}
WGS84 = 'GEOGCS["GCS_WGS_1984",DATUM["D_WGS_1984",SPHEROID["WGS_1984",6378137.0,298.257223563]],PRIMEM["Greenwich",0.0],UNIT["Degree",0.0174532925199433]]'
LOCAL = f'PROJCS["Local_Metric_Grid",{WGS84},PROJECTION["Transverse_Mercator"],UNIT["Meter",1.0]]'
#: Fields of the attribute table with type, width and decimals.
FIELDS = [("FEAT_ID", "C", 16, 0), ("LAYER", "C", 20, 0), ("CLASS", "C", 24, 0), ("CONF", "N", 6, 2), ("AREA", "N", 12, 2), ("LENGTH", "N", 12, 2)]


def _shape_header(shape: int, size: int, box: tuple) -> bytes:
    return struct.pack(">7i", 9994, 0, 0, 0, 0, 0, size // 2) + struct.pack("<2i8d", 1000, shape, *box, 0, 0, 0, 0)


def _table_header(n: int, today: date) -> bytes:
    head = struct.pack("<4BIHH20x", 3, (today.year - 1900) % 256, today.month, today.day, n, 32 + 32 * len(FIELDS) + 1, 1 + sum(f[2] for f in FIELDS))
    return head + b"".join(struct.pack("<11sc4xBB14x", name.encode(), kind.encode(), width, digits) for name, kind, width, digits in FIELDS) + b"\r"


def _bodies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(seq, body): what follows a record's header, from (seq, shape number, points); coordinates are cut from the batch's own buffer."""
    for batch in batches:
        out, points = [], batch.column(2)
        at = points.offsets.to_numpy()
        flat = np.stack([points.values.field(c).to_numpy(zero_copy_only=False) for c in ("x", "y")], 1).astype("<f8")
        for shape, a, b in zip(batch.column(1).to_pylist(), at, at[1:]):
            own = flat[a:b]
            lines = b"" if shape == 1 else np.concatenate([own.min(0), own.max(0)]).tobytes() + struct.pack("<3i", 1, len(own), 0)
            out.append(struct.pack("<i", shape) + lines + own.tobytes())
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], names=["seq", "body"])


def _big_endian(c: Column) -> Column:
    return F.unhex(F.lpad(F.hex(c), 8, "0"))


def shapefile(features: DataFrame, kind: str, *, height: float = 1000.0, metres_per_pixel: float = 1.0, affine: list[float] | None = None, today: date | None = None) -> DataFrame:
    """(file, part, seq, bytes) of <kind>.shp, .shx, .dbf and .prj for the polygons, lines or points among the features; no row if there are none.

    Rings are closed and turned clockwise. Record numbers and offsets are running totals over ranges of seq."""
    spark, shape = features.sparkSession, SHAPE_TYPE[kind]
    own = features.where(F.col("geometry_type").isin("POINT", "CIRCLE")) if kind == "points" else X.export_set(features).where(F.col("shape") == kind)
    chosen = F.array(X.first_point(features)) if kind == "points" else F.col("points")
    at = F.transform(chosen, lambda p: G.affine(p, affine) if affine else G.point(p["x"] * metres_per_pixel, (height - p["y"]) * metres_per_pixel))
    rows = own.withColumn("_at", at).withColumn("seq", F.col("seq").cast("long"))
    if kind == "polygons":
        first, last = F.get("_at", F.lit(0)), F.element_at("_at", -1)
        shut = rows.withColumn("_at", F.when((first["x"] != last["x"]) | (first["y"] != last["y"]), F.concat("_at", F.array(first))).otherwise(F.col("_at")))
        shut = shut.withColumn("_at", G.clockwise(F.col("_at")))
    bodies = (shut if kind == "polygons" else rows).select("seq", F.lit(shape).alias("shape"), "_at").mapInArrow(_bodies, "seq long, body binary")
    bodies = X.numbered(bodies, total=F.length("body") + 8)
    box = rows.select(G.bounds(F.col("_at")).alias("b")).agg(F.count("*").alias("n"), F.min("b.min_x").alias("x0"), F.min("b.min_y").alias("y0"), F.max("b.max_x").alias("x1"), F.max("b.max_y").alias("y1"))
    total = box.join(F.broadcast(bodies.agg(F.sum(F.length("body") + 8).alias("size")))).where("n > 0")  # one row on either side
    day = today or date.today()

    @F.pandas_udf("binary")
    def shape_header(size: pd.Series, x0: pd.Series, y0: pd.Series, x1: pd.Series, y1: pd.Series) -> pd.Series:
        return pd.Series([_shape_header(shape, 100 + int(s), box) for s, *box in zip(size, x0, y0, x1, y1)])

    @F.pandas_udf("binary")
    def table_header(n: pd.Series) -> pd.Series:
        return pd.Series([_table_header(int(x), day) for x in n])

    file = lambda end, part, seq, data, rows: rows.select(F.lit(f"{kind}.{end}").alias("file"), F.lit(part).alias("part"), seq.cast("long").alias("seq"), data.cast("binary").alias("bytes"))
    zero, words = F.lit(0), F.expr("length(body) div 2")
    head = lambda size: shape_header(size, "x0", "y0", "x1", "y1")
    parts = [
        file("shp", HEAD, zero, head(F.col("size")), total), file("shp", BODY, F.col("seq"), F.concat(_big_endian(F.col("_k")), _big_endian(words), F.col("body")), bodies),
        file("shx", HEAD, zero, head(F.col("n") * 8), total), file("shx", BODY, F.col("seq"), F.concat(_big_endian(F.expr("(_before + 100) div 2")), _big_endian(words)), bodies),
        file("dbf", HEAD, zero, table_header("n"), total), file("dbf", BODY, F.col("seq"), F.encode("record", "US-ASCII"), X.dbf_records(rows)), file("dbf", TAIL, zero, F.unhex(F.lit("1A")), total),
        file("prj", HEAD, zero, F.encode(F.lit(WGS84 if affine else LOCAL), "UTF-8"), total),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def shapefiles(features: DataFrame, **how) -> DataFrame:
    """The parts of all files: polygons, lines and points. The features are worked out and written once; ranges, bodies, bounds and records of all kinds read them from there."""
    features = settled(features)
    out = shapefile(features, "polygons", **how)
    return out.unionByName(shapefile(features, "lines", **how)).unionByName(shapefile(features, "points", **how))


#: The order of the files in an archive, and what is said about them.
MEMBERS = [f"{kind}.{end}" for kind in SHAPE_TYPE for end in ("shp", "shx", "dbf", "prj")] + ["README_GIS.txt"]
README = """Shapefile Package
Generated at: {now}
CRS: {crs}

Layers Included:
- polygons.shp (.shx, .dbf, .prj): Closed building footprints, parcels, vegetation, water bodies
- lines.shp (.shx, .dbf, .prj): Roads, centerlines, walls, boundary lines
- points.shp (.shx, .dbf, .prj): Point features, columns, poles, trees

Compatible with: QGIS 3.x, ArcGIS Pro, Civil 3D Map, Global Mapper."""


def shapefile_archive(features: DataFrame, *, now: datetime | None = None, **how) -> DataFrame:
    """(member, seq, bytes) of a zip archive of the shapefiles and a file that tells what they are."""
    at = (now or datetime.now(UTC)).strftime("%Y-%m-%dT%H:%M:%S.000Z")
    said = README.format(now=at, crs="WGS 84 (EPSG:4326)" if how.get("affine") else "Local Metric Grid (Meters)")
    about = features.sparkSession.range(1).select(F.lit(MEMBERS[-1]).alias("file"), F.lit(HEAD).alias("part"), F.lit(0).cast("long").alias("seq"), F.encode(F.lit(said), "UTF-8").alias("bytes"))
    return archive(shapefiles(features, **how).unionByName(about), order=MEMBERS)
