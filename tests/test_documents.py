"""Whole documents: drawings by their codes, shapefiles byte by byte, the others by a parser of their format."""

import hashlib
import io
import json
import struct
import zipfile
from datetime import date
from xml.etree import ElementTree

import pytest
from pyspark.sql import functions as F
from test_operators import feature

from rastervec.functions.numeric import fixed_text, fixed_texts
from rastervec.operators import documents as D
from rastervec.operators import export as X
from rastervec.operators import features as O
from rastervec.schema import FEATURE, layers


@pytest.fixture(scope="module")
def drawing(spark):
    pts = lambda *p: [{"x": float(x), "y": float(y)} for x, y in p]
    rows = [
        feature(seq=1, id="b-1", layer="BUILDINGS", geometry_type="LWPOLYLINE", is_closed=True, points=pts((0, 0), (10, 0), (10, 5), (0, 5), (0, 0)), confidence=0.956, classification="Building", source="AI", area=50.04, attributes={"layer": "own", "note": 'a "quote"'}),
        feature(seq=2, id="text-1", layer="SURVEY/ANNOTATIONS", geometry_type="TEXT", points=pts((2, 2)), text="TEST", text_height=1.5, confidence=1.0),
        feature(seq=3, id="c", layer="TREES", geometry_type="CIRCLE", points=[], center={"x": 4.0, "y": 4.0}, radius=2.0, confidence=0.9),
        feature(seq=4, id="line é", layer="FENCES", geometry_type="LINE", points=pts((0, 0), (3, 4)), confidence=0.5, length=5.0),
        feature(seq=5, id="ring", layer="WATER", geometry_type="LWPOLYLINE", is_closed=True, points=pts((0, 0), (0, 4), (4, 4), (4, 0)), confidence=0.5),
        feature(seq=6, id="one", layer="WATER", geometry_type="LWPOLYLINE", points=pts((1, 1)), confidence=0.5),
    ]
    return spark.createDataFrame([tuple(r.values()) for r in rows], FEATURE).repartition(3)


def joined(rows, between="\n"):
    return between.join(r["text"] for r in rows.orderBy("part", "seq").collect())


def test_drawing_document(drawing, spark):
    text = joined(D.dxf_document(drawing, layers(spark).withColumn("locked", F.col("name") == "WATER").withColumn("visible", F.col("name") != "TREES"), height=10, invert_y=False, unit="m"), "")
    lines = text.split("\r\n")
    assert lines.pop() == "" and len(lines) % 2 == 0
    pairs = [(int(a), b) for a, b in zip(lines[::2], lines[1::2])]
    for token in ("0\r\nSECTION\r\n2\r\nHEADER", "9\r\n$ACADVER\r\n1\r\nAC1027", "9\r\n$INSUNITS\r\n70\r\n6", "2\r\nLAYER", "2\r\nSURVEY_ANNOTATIONS", "0\r\nLWPOLYLINE", "0\r\nTEXT", "0\r\nENDSEC", "0\r\nEOF"):
        assert token in text
    names = [b for a, b in pairs if a == 0]
    assert names.count("LWPOLYLINE") == 2 and names.count("TEXT") == 1 and names.count("CIRCLE") == 1 and names.count("LINE") == 1
    assert names.count("SECTION") == names.count("ENDSEC") == 6 and names.count("TABLE") == names.count("ENDTAB") == 6 and names[-1] == "EOF"
    sections = [pairs[i + 1][1] for i, p in enumerate(pairs) if p == (0, "SECTION")]
    assert sections == ["HEADER", "CLASSES", "TABLES", "BLOCKS", "ENTITIES", "OBJECTS"]
    handles = [int(b, 16) for a, b in pairs if a == 5][1:]  # the first is the seed
    assert len(handles) == len({*handles}) and min(handles) == 0x21
    # tables take 0x21 to 0x28, then records; six features use up a handle each, the dictionary the next
    assert handles[-1] == max(handles) == 0x38 + 20 + 6
    owners = {b for a, b in pairs if a == 330}
    assert owners <= {f"{h:X}" for h in handles} | {"0"}
    at = text.index("$EXTMIN")
    assert text[at:].startswith("$EXTMIN\r\n10\r\n0.0000\r\n20\r\n0.0000\r\n30\r\n0\r\n9\r\n$EXTMAX\r\n10\r\n10.0000\r\n20\r\n6.0000\r\n")
    water = text.index("2\r\nWATER\r\n")
    assert text[water:].startswith("2\r\nWATER\r\n70\r\n4\r\n62\r\n5\r\n6\r\nCONTINUOUS\r\n370\r\n35\r\n")
    assert "2\r\nTREES\r\n70\r\n0\r\n62\r\n-3\r\n" in text and "2\r\nLAYER\r\n5\r\n24\r\n100\r\nAcDbSymbolTable\r\n70\r\n21\r\n" in text


@pytest.mark.parametrize("unit,scale,code", [("ft", 3.280839895 * 0.5, 2), ("cm", 50.0, 5), ("", 0.5, 0)])
def test_drawing_units(drawing, spark, unit, scale, code):
    text = joined(D.dxf_document(drawing, layers(spark), height=10, unit=unit, metres_per_pixel=0.5), "")
    assert f"$INSUNITS\r\n70\r\n{code}\r\n" in text and f"40\r\n{fixed_text(2.0 * scale, 4)}\r\n" in text
    assert f"10\r\n{fixed_text(4.0 * scale, 4)}\r\n20\r\n{fixed_text(6.0 * scale, 4)}\r\n" in text  # the circle, y up


def test_shapefiles(drawing):
    rows = D.shapefiles(drawing, height=10.0, metres_per_pixel=0.5, today=date(2024, 3, 9)).orderBy("file", "part", "seq").collect()
    files = {}
    for r in rows:
        files[r["file"]] = files.get(r["file"], b"") + bytes(r["bytes"])
    assert sorted(files) == sorted(f"{k}.{e}" for k in ("polygons", "lines", "points") for e in ("shp", "shx", "dbf", "prj"))
    for kind, shape, ids in (("polygons", 5, ["b-1", "ring"]), ("lines", 3, ["line _"]), ("points", 1, ["c"])):
        shp, shx, dbf = (files[f"{kind}.{e}"] for e in ("shp", "shx", "dbf"))
        for data in (shp, shx):
            assert struct.unpack_from(">i", data)[0] == 9994 and 2 * struct.unpack_from(">i", data, 24)[0] == len(data) and struct.unpack_from("<2i", data, 28) == (1000, shape)
        at, xs, ys = 100, [], []
        for k in range(len(ids)):
            number, words = struct.unpack_from(">2i", shp, at)
            assert number == k + 1 and struct.unpack_from(">2i", shx, 100 + 8 * k) == (at // 2, words)
            assert struct.unpack_from("<i", shp, at + 8)[0] == shape
            if shape == 1:
                points = [struct.unpack_from("<2d", shp, at + 12)]
            else:
                box = struct.unpack_from("<4d", shp, at + 12)
                parts, n, first = struct.unpack_from("<3i", shp, at + 44)
                points = [struct.unpack_from("<2d", shp, at + 56 + 16 * i) for i in range(n)]
                assert (parts, first) == (1, 0) and 2 * words == 48 + 16 * n and box == (min(x for x, _ in points), min(y for _, y in points), max(x for x, _ in points), max(y for _, y in points))
            if shape == 5:
                assert points[0] == points[-1] and sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(points, points[1:])) < 0
            xs, ys, at = xs + [x for x, _ in points], ys + [y for _, y in points], at + 8 + 2 * words
        assert at == len(shp) and len(shx) == 100 + 8 * len(ids)
        assert struct.unpack_from("<4d", shp, 36) == struct.unpack_from("<4d", shx, 36) == (min(xs), min(ys), max(xs), max(ys))
        assert dbf[:4] == bytes([3, 124, 3, 9]) and struct.unpack_from("<IHH", dbf, 4) == (len(ids), 225, 91) and dbf[224:225] == b"\r" and dbf[-1:] == b"\x1a"
        assert [dbf[32 + 32 * i : 43 + 32 * i].rstrip(b"\0") for i in range(6)] == [b"FEAT_ID", b"LAYER", b"CLASS", b"CONF", b"AREA", b"LENGTH"] and len(dbf) == 225 + 91 * len(ids) + 1
        assert [dbf[225 + 91 * i :][1:17].decode().strip() for i in range(len(ids))] == ids
        assert files[f"{kind}.prj"].startswith(b"PROJCS")
    assert struct.unpack_from("<2d", files["points.shp"], 112) == (2.0, 3.0)
    affine = D.shapefile(drawing, "points", affine=[1.0, 0.0, 5.0, 0.0, -1.0, 7.0])
    assert {bytes(r["bytes"]).startswith(b"GEOGCS") for r in affine.where("file = 'points.prj'").collect()} == {True}
    assert D.shapefile(drawing.where("false"), "lines").count() == 0


def unzipped(rows):
    data = b"".join(bytes(r["bytes"]) for r in rows.orderBy("member", "seq").collect())
    return zipfile.ZipFile(io.BytesIO(data))


def test_archive_holds_the_files(spark, drawing):
    files = {}
    for r in D.shapefiles(drawing, today=date(2024, 3, 9)).orderBy("file", "part", "seq").collect():
        files[r["file"]] = files.get(r["file"], b"") + bytes(r["bytes"])
    with unzipped(D.shapefile_archive(drawing, today=date(2024, 3, 9))) as z:
        assert z.testzip() is None and z.namelist() == D.MEMBERS
        assert {n: z.read(n) for n in z.namelist()[:-1]} == files and b"Local Metric Grid" in z.read("README_GIS.txt")
    with unzipped(D.shapefile_archive(drawing.where("is_closed"), affine=[1.0, 0.0, 5.0, 0.0, -1.0, 7.0])) as z:
        assert b"EPSG:4326" in z.read("README_GIS.txt") and "lines.shp" not in z.namelist()


def test_archive_is_packed_in_parts_by_many_tasks(spark, monkeypatch):
    from rastervec.operators import archive as R

    monkeypatch.setattr(R, "PART", 1 << 12)
    rows = spark.range(60_000).select(F.concat(F.lit("f"), F.col("id") % 3).alias("file"), F.lit(1).alias("part"), F.col("id").alias("seq"), F.sha2(F.col("id").cast("string"), 256).cast("binary").alias("bytes"))
    rows = rows.unionByName(spark.createDataFrame([("empty", 0, 0, None), ("f1", 2, 0, None)], rows.schema)).repartition(7)
    with unzipped(D.archive(rows, order=["f2"])) as z:
        assert z.testzip() is None and z.namelist() == ["f2", "empty", "f0", "f1"] and z.read("empty") == b""
        for k in range(3):
            assert z.read(f"f{k}") == b"".join(hashlib.sha256(str(i).encode()).hexdigest().encode() for i in range(k, 60_000, 3))
    with unzipped(D.archive(rows.where("false"))) as z:
        assert z.namelist() == []


@pytest.mark.parametrize("adaptive", ["true", "false"])
def test_numbers_and_offsets_of_many_rows(spark, adaptive):
    """All columns are read, with several ranges: handles rise with seq without a gap, offsets are running lengths."""
    spark.conf.set("spark.sql.adaptive.enabled", adaptive)
    try:
        n = 120_000
        at = lambda i: F.array(*(F.struct((F.col("id") * k).cast("double").alias("x"), F.lit(1.0 * k).alias("y")) for k in range(i)))
        rows = spark.range(n).select(F.col("id").cast("string").alias("id"), (F.col("id") * 7919 % n).alias("seq"), F.lit("L").alias("layer"), F.lit(False).alias("is_closed"), F.lit("LWPOLYLINE").alias("geometry_type"), F.when(F.col("id") % 2 == 0, at(2)).otherwise(at(5)).alias("points")).repartition(9)
        found = X.dxf_entities(rows).select("seq", F.regexp_extract("entity", "^0\r\n[A-Z]+\r\n5\r\n([0-9A-F]+)", 1).alias("h"), F.md5("entity")).collect()
        assert [int(r["h"], 16) - 0x28 for r in sorted(found, key=lambda r: r["seq"])] == list(range(n))
        parts = D.shapefile(rows, "lines").where("part = 1 and file <> 'lines.dbf'").select("file", "seq", F.length("bytes").alias("n"), F.substring("bytes", 1, 4).alias("first")).collect()
        shp, shx = ([r for r in sorted(parts, key=lambda r: r["seq"]) if r["file"] == f"lines.{e}"] for e in ("shp", "shx"))
        assert [struct.unpack(">i", r["first"])[0] for r in shp] == list(range(1, n + 1))
        offset = 100
        for a, b in zip(shp, shx, strict=True):
            assert 2 * struct.unpack(">i", b["first"])[0] == offset
            offset += a["n"]
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")


def test_layers_stand_in_their_order(spark, drawing):
    names = [r["name"] for r in layers(spark).orderBy("order").collect()]
    text = joined(D.dxf_document(drawing, layers(spark)), "")
    assert [record.split("\r\n")[0] for record in text.split("AcDbLayerTableRecord\r\n2\r\n")[2:]][:19] == names
    styles = joined(D.kml_document(drawing, layers(spark)))
    assert sorted(names, key=lambda n: styles.index(f'"style_{n}"')) == names
    every = spark.createDataFrame([(str(i), i, n, False, "LINE", [(0.0, 0.0), (1.0, 1.0)]) for i, n in enumerate(reversed(names))], "id string, seq long, layer string, is_closed boolean, geometry_type string, points array<struct<x:double,y:double>>")
    svg = joined(D.svg_document(every, layers(spark), width=9, height=9))
    assert sorted(names, key=lambda n: svg.index(f'"layer_{n}"')) == names


def test_geojson_document(drawing):
    own = json.loads(joined(D.geojson_document(drawing, height=10.0)))
    assert own["type"] == "FeatureCollection" and [f["id"] for f in own["features"]] == ["b-1", "c", "line é", "ring"]
    first = own["features"][0]
    assert first["properties"] == {"id": "b-1", "layer": "own", "classification": "Building", "confidence": 0.96, "geometryType": "LWPOLYLINE", "source": "AI", "area": 50.0, "length": 0.0, "note": 'a "quote"'}
    assert list(first["properties"]) == ["id", "layer", "classification", "confidence", "geometryType", "source", "area", "length", "note"]
    assert own["features"][3]["geometry"]["coordinates"][0] == [[0, 10], [0, 6], [4, 6], [4, 10], [0, 10]] and len(first["geometry"]["coordinates"][0]) == 5
    moved = json.loads(joined(D.geojson_document(drawing, affine=[0.1, 0.0, 30.1234567, 0.0, -0.1, 31.0])))
    assert moved["features"][1]["geometry"] == {"type": "Point", "coordinates": [30.523457, 30.6]}
    assert json.loads(joined(D.geojson_document(drawing.where("false"))))["features"] == []


def test_kml_document(drawing, spark):
    root = ElementTree.fromstring(joined(D.kml_document(drawing, layers(spark), height=10.0)))
    space = {"k": "http://www.opengis.net/kml/2.2"}
    assert len(root.findall(".//k:Style", space)) == 19 and [p.find("k:name", space).text for p in root.findall(".//k:Placemark", space)] == ["b-1", "c", "line é", "ring"]
    style = root.find(".//k:Style[@id='style_WALLS']", space)
    assert style.find(".//k:LineStyle/k:color", space).text == "ff516fe7".lower() or style.find(".//k:LineStyle/k:color", space).text == "ff516FE7"[:2] + "51" + "6F" + "E7"
    assert style.find(".//k:width", space).text == "3"
    data = root.find(".//k:Placemark", space).findall(".//k:Data", space)
    assert {d.get("name"): d.find("k:value", space).text for d in data} == {"Layer": "BUILDINGS", "Class": "Building", "Confidence": "0.956", "Area": "50.04", "Length": "0.0"}
    moved = joined(D.kml_document(drawing, layers(spark), affine=[1.0, 0.0, 5.0, 0.0, -1.0, 7.0]))
    assert "<coordinates>9.0,3.0,0</coordinates>" in moved


def test_svg_document(drawing, spark):
    root = ElementTree.fromstring(joined(D.svg_document(drawing, layers(spark), width=20, height=10)))
    groups = [g for g in root if g.tag.endswith("}g")]
    assert [g.get("id") for g in groups] == ["layer_BUILDINGS", "layer_FENCES", "layer_TREES", "layer_WATER"] and root.get("viewBox") == "0 0 20 10"
    assert groups[1][0].get("stroke-dasharray") == "6,4" and groups[2][0].get("r") == "2.0" and groups[2][0].get("fill-opacity") == "0.25"
    ordered = D.svg_document(drawing, layers(spark).withColumn("order", F.when(F.col("name") == "WATER", 0).otherwise(5)), width=20, height=10)
    assert joined(ordered).index("layer_WATER") < joined(ordered).index("layer_BUILDINGS")


def test_csv_document(drawing):
    lines = joined(D.csv_document(drawing, calibrated=True)).split("\n")
    assert lines[0] == "Feature_ID,Layer,Classification,Geometry_Type,Confidence,Length_m,Area_m2,Vertex_Count,WKT_Geometry" and len(lines) == 7
    assert "Length_px,Area_px2" in joined(D.csv_document(drawing))


def test_batches_of_numbers_print_like_single_ones():
    import numpy as np

    values = np.array([1.005, 0.125, -0.125, 2.5, -0.0, -0.001, 1e-9, 123456.785, 0.375, 17.0, -3.5])
    for digits in range(5):
        assert fixed_texts(values, digits) == [fixed_text(float(v), digits) for v in values]


def test_picking_circles(drawing, spark):
    picks = spark.createDataFrame([(1, 4.0, 6.4), (2, 4.0, 6.6), (3, 20.0, 20.0), (4, 9.0, 0.2)], "pick int, x double, y double")
    got = {r["pick"]: r["id"] for r in O.picked(drawing, picks, tolerance=0.5, cell=5.0).collect()}
    assert got == {1: "c", 4: "b-1"}
    assert {r["pick"] for r in O.picked(drawing, picks, tolerance=0.5, cell=5.0, interior=False).collect()} == {4}
