"""The reference-type operators against plain versions and fixed values."""

import math
import struct

import pytest
from pyspark.sql import functions as F

from rastervec.functions import geometry as G
from rastervec.functions import spectral
from rastervec.functions.numeric import fixed_text, js_round, to_fixed, truthy_or
from rastervec.functions.simplify import rdp
from rastervec.operators import components as C
from rastervec.operators import export as X
from rastervec.operators import features as O
from rastervec.operators import pixels as P
from rastervec.schema import FEATURE, layers
from rastervec.sources import adapters, projects


def fnv(data: bytes) -> int:
    h = 2166136261
    for b in data:
        h = (h ^ b) * 16777619 & 0xFFFFFFFF
    return h


@pytest.fixture(scope="module")
def roof(spark):
    return adapters.striped_roof(spark).cache()


def test_bilateral_filter_gives_the_known_checksum(roof):
    rows = P.bilateral(roof, radius=2, sigma=25.0).orderBy("y", "x").collect()
    assert fnv(b"".join(struct.pack("4B", r["r"], r["g"], r["b"], r["a"]) for r in rows)) == 3884067805
    assert fnv(bytes(r["a"] for r in rows)) == 1840294853


def test_sauvola_threshold_gives_the_known_checksum(roof):
    rows = P.sauvola(roof.withColumn("gray", spectral.gray()), radius=6).orderBy("y", "x").collect()
    assert fnv(bytes(r["bit"] for r in rows)) == 4177005890 and sum(r["bit"] for r in rows) == 617


@pytest.mark.parametrize(
    "colour,kind",
    [("#65784C", 3), ("#373D44", 0), ("#8E9A9D", 2), ("#B84A39", 1), ("#D9D7CE", 1), ("#1D97BD", 4), ("#2F363F", 4), ("#102A45", 0), ("#18385A", 4), ("#F5F5F0", 1), ("#1A1A1A", 1)],
)
def test_palette_classes(spark, colour, kind):
    r, g, b = (int(colour[i : i + 2], 16) for i in (1, 3, 5))
    assert spark.createDataFrame([(r, g, b)], "r int, g int, b int").select(spectral.surface()).first()[0] == kind


def test_rounding_is_ecmascripts(spark):
    assert [fixed_text(*x) for x in ((1.005, 2), (0.125, 2), (-0.125, 2), (2.5, 0), (-0.0, 1), (1e21 / 1e21, 1))] == ["1.00", "0.13", "-0.13", "3", "0.0", "1.0"]
    row = spark.createDataFrame([(-2.5, 0.0, None)], "a double, b double, c double").select(js_round(F.col("a")), truthy_or(F.col("b"), 10.0), truthy_or(F.col("c"), 7.0), to_fixed(F.col("c"), 2)).first()
    assert tuple(row) == (-2, 10.0, 7.0, None)


BLOB = ["..##....#", ".##..#..#", "##...#...", "......#..", "###...###", "#.#......", "###.....#"]


def cells(rows):
    return {(x, y) for y, row in enumerate(rows) for x, c in enumerate(row) if c == "#"}


def masks(spark, rows):
    return spark.createDataFrame([(k, x, y) for k in (0, 1) for x, y in cells(rows)], "image_id int, x int, y int")


def plain_components(fore, diagonal):
    left, out = set(fore), []
    steps = [(dx, dy) for dx in (-1, 0, 1) for dy in (-1, 0, 1) if (dx or dy) and (diagonal or not (dx and dy))]
    while left:
        todo, part = [left.pop()], set()
        while todo:
            x, y = todo.pop()
            part.add((x, y))
            for dx, dy in steps:
                if (x + dx, y + dy) in left:
                    left.discard((x + dx, y + dy))
                    todo.append((x + dx, y + dy))
        out.append(frozenset(part))
    return set(out)


@pytest.mark.parametrize("diagonal", [True, False])
def test_components(spark, diagonal):
    got: dict = {}
    for r in C.components(masks(spark, BLOB), diagonal=diagonal).collect():
        got.setdefault((r["image_id"], r["label"]), set()).add((r["x"], r["y"]))
    assert all(label == min((y << 32) + x for x, y in part) for (_, label), part in got.items())
    for k in (0, 1):
        assert {frozenset(v) for (i, _), v in got.items() if i == k} == plain_components(cells(BLOB), diagonal)
    assert C.components(masks(spark, ["....", "...."])).count() == 0
    few = C.summarised(C.components(masks(spark, BLOB)), least=3, most=1).collect()
    assert len(few) == 2 and all(r["n"] >= 3 for r in few)


def test_chamfer_distances(spark):
    rows = ["#" * 15] * 9
    got = {(r["x"], r["y"]): r["d"] for r in C.chamfer(masks(spark, rows)).where("image_id = 0").collect()}

    def plain(x, y):
        outside = [(a, b) for a in range(-1, 16) for b in range(-1, 10) if not (0 <= a < 15 and 0 <= b < 9)]
        return min(1.414 * min(abs(a - x), abs(b - y)) + abs(abs(a - x) - abs(b - y)) for a, b in outside)

    assert all(abs(d - plain(*p)) < 1e-4 for p, d in got.items()) and len(got) == 135


def test_thinning_leaves_a_thin_connected_line(spark):
    rows = ["." * 20] * 2 + [".." + "#" * 15 + "..."] * 5 + ["." * 20] * 2
    thin = {(r["x"], r["y"]) for r in C.thinned(masks(spark, rows), width=20, height=9).where("image_id = 1").collect()}
    assert thin <= cells(rows) and 5 <= len(thin) <= 15 and len(plain_components(thin, True)) == 1


def test_morphology_zeroes_the_border(spark):
    full = spark.createDataFrame([(0, x, y, 1) for x in range(8) for y in range(7)], "image_id int, x int, y int, bit int")
    got = {(r["x"], r["y"]) for r in P.closed(full).where("bit = 1").collect()}
    assert got == {(x, y) for x in range(2, 6) for y in range(2, 5)}


def test_geometry_expressions(spark):
    square = [(0.0, 0.0), (10.0, 0.0), (10.0, 10.0), (0.0, 10.0)]
    data = [("square", square), ("line", [(0.0, 0.0), (3.0, 4.0)]), ("dot", [(1.0, 1.0)]), ("none", []), ("slivers", [(0.0, 0.0), (0.2, 0.0), (5.0, 0.5), (10.0, 0.0), (10.0, 10.0)])]
    df = spark.createDataFrame([(n, [{"x": x, "y": y} for x, y in p]) for n, p in data], "id string, points array<struct<x:double,y:double>>")
    p = F.col("points")
    got = {r["id"]: r for r in df.select("id", G.area(p).alias("area"), G.length(p, True).alias("ring"), G.length(p, False).alias("line"), G.contains(p, G.point(F.lit(5.0), F.lit(5.0))).alias("holds"), G.orientation(p).alias("angle"), F.size(G.without_collinear(G.deduplicated(p))).alias("n"), G.near(p, G.point(F.lit(0.0), F.lit(5.0)), 0.5, True).alias("near")).collect()}
    assert (got["square"]["area"], got["square"]["ring"], got["square"]["line"]) == (100.0, 40.0, 30.0)
    assert got["square"]["holds"] and got["square"]["near"] and not got["line"]["near"]
    assert (got["line"]["ring"], got["dot"]["ring"], got["none"]["area"]) == (5.0, 0.0, 0.0)
    assert abs(math.sin(4 * got["square"]["angle"])) < 1e-9 and got["slivers"]["n"] == 3


def test_rdp_keeps_ends_and_corners():
    line = [(float(i), 0.1 * (i % 2)) for i in range(20)] + [(19.0, 15.0)]
    assert rdp(line, 1.0) == [line[0], line[19], line[20]]


def feature(**own):
    empty = dict.fromkeys(c.split()[0] for c in FEATURE.replace("struct<x:double,y:double>", "p").replace("map<string,string>", "m").split(", "))
    return {**empty, "image_id": "i", "is_closed": False, **own}


@pytest.fixture(scope="module")
def drawing(spark):
    pts = lambda *p: [{"x": float(x), "y": float(y)} for x, y in p]
    rows = [
        feature(seq=1, id="b-1", layer="BUILDINGS", geometry_type="LWPOLYLINE", is_closed=True, points=pts((0, 0), (10, 0), (10, 5), (0, 5), (0, 0))),
        feature(seq=2, id="text-1", layer="SURVEY/ANNOTATIONS", geometry_type="TEXT", points=pts((2, 2)), text="TEST", text_height=1.5),
        feature(seq=3, id="c", layer="TREES", geometry_type="CIRCLE", points=[], center={"x": 4.0, "y": 4.0}, radius=0.0),
        feature(seq=4, id="gap", layer="BUILDINGS", geometry_type="LWPOLYLINE", points=pts((0, 0), (0.1, 0), (9, 0))),
        feature(seq=5, id="empty", layer="WATER", geometry_type="LWPOLYLINE", points=pts((1, 1))),
    ]
    return spark.createDataFrame([tuple(r.values()) for r in rows], FEATURE)


def test_dxf_entities(drawing):
    got = {r["seq"]: r["entity"] for r in X.dxf_entities(drawing, height=10, invert_y=False).collect()}
    assert sorted(got) == [1, 2, 3, 4]
    assert got[1].count("LWPOLYLINE") == 1 and "\r\n90\r\n4\r\n70\r\n1\r\n" in got[1] and "SURVEY_ANNOTATIONS" in got[2]
    assert "\r\n40\r\n10.0000\r\n" in got[3] and "TEST" in got[2] and "\r\n40\r\n1.50\r\n" in got[2]
    handles = [int(e.split("\r\n")[3], 16) for _, e in sorted(got.items())]
    assert handles == list(range(handles[0], handles[0] + 4))


def test_text_exports(drawing, spark):
    lines = {r["seq"]: r["line"] for r in X.csv_lines(drawing).collect()}
    assert lines[1].endswith('5,"POLYGON((0.00 0.00, 10.00 0.00, 10.00 5.00, 0.00 5.00, 0.00 0.00, 0.00 0.00))"') and lines[5].endswith(",1,")
    parts = {r["seq"]: r["geojson"] for r in X.geojson_parts(drawing, height=10).collect()}
    assert sorted(parts) == [1, 3, 4] and '"coordinates":[[[0.0,10.0],' in parts[1]
    assert {r["seq"] for r in X.svg_parts(drawing, layers(spark)).collect()} == {1, 3, 4}
    assert X.extents(drawing).first() == (-6.0, -6.0, 14.0, 14.0) and X.extents(drawing.where("false")).first() == (0.0, 0.0, 100.0, 100.0)
    assert all(len(r["record"]) == 91 for r in X.dbf_records(drawing).collect())
    assert {r["seq"]: r["kml"].count("<coordinates>") for r in X.kml_parts(drawing).collect()} == {1: 1, 3: 1, 4: 1}


def test_topology(drawing):
    issues = {(r["id"], r["kind"]) for r in O.topology_issues(drawing).collect()}
    assert issues == {("gap", "UNCLOSED_POLYGON"), ("gap", "DUPLICATE_VERTICES")}
    fixed = {r["id"]: r for r in O.topology_repaired(drawing).collect()}
    assert "empty" not in fixed and fixed["gap"]["is_closed"] and fixed["gap"]["modified"] and not fixed["b-1"]["modified"] and fixed["b-1"]["area"] == 50


def test_layer_registry_takes_the_first_of_one_safe_name(drawing, spark):
    got = {r["safe"]: r for r in O.layer_registry(drawing, layers(spark)).collect()}
    assert got["BUILDINGS"]["aci"] == 1 and got["SURVEY_ANNOTATIONS"]["aci"] == 7 and "0" in got and len(got) == 21


def test_project_round_trip(drawing, spark, tmp_path):
    projects.save_project(drawing, str(tmp_path / "p"))
    assert sorted(r["id"] for r in projects.load_project(spark, str(tmp_path / "p")).collect()) == ["b-1", "c", "empty", "gap", "text-1"]


def test_calibration_refuses_points_that_coincide(spark):
    rows = spark.createDataFrame([(1, 0.0, 0.0, 0.5, 0.0, 1.0, "m")], "id int, x1 double, y1 double, x2 double, y2 double, known double, unit string")
    with pytest.raises(Exception, match="less than a pixel"):
        O.calibrated(rows).collect()
