"""Scenes, the look at an image, the conversion that suits it, and edits."""

from pyspark.sql import functions as F

from rastervec.functions import geometry as G
from rastervec.functions import spectral
from rastervec.operators import components as C
from rastervec.operators import editing as E
from rastervec.operators import workflow as K
from rastervec.schema import layers
from rastervec.sources import scenes as S


def test_scenes_show_what_they_should(spark):
    rows = S.scenes(spark)
    assert rows.count() == 4 * 800_000
    wanted = {("sample_drone_urban", 100, 100): 1, ("sample_drone_urban", 140, 650): 4, ("sample_drone_urban", 10, 10): 3, ("sample_drone_urban", 320, 300): 0, ("sample_drone_urban", 20, 357): 2, ("sample_satellite_highway", 150, 150): 1, ("sample_satellite_highway", 700, 760): 4, ("sample_satellite_highway", 40, 400): 4, ("sample_scanned_blueprint", 40, 55): 4, ("sample_scanned_blueprint", 265, 230): 1, ("sample_scanned_blueprint", 10, 10): 0, ("sample_arch_floorplan", 120, 300): 1}
    at = spark.createDataFrame([k for k in wanted], "image_id string, x int, y int")
    got = {(r["image_id"], r["x"], r["y"]): r["class"] for r in rows.join(F.broadcast(at), ["image_id", "x", "y"]).withColumn("class", spectral.surface()).collect()}
    assert got == wanted


def test_wide_images_are_sampled(spark):
    small = K.sampled(S.scene(spark, "sample_arch_floorplan")).cache()
    assert small.count() == 400 * 320 and small.agg(F.max("x"), F.max("y")).first() == (399, 319) and small.dropDuplicates(["x", "y"]).count() == 400 * 320
    tiny = spark.createDataFrame([(0, x, y, x) for x in range(7) for y in range(5)], "image_id int, x int, y int, v int")
    assert sorted(K.sampled(tiny).collect()) == sorted(tiny.collect())
    assert sorted(r["v"] for r in K.sampled(tiny, width=3).collect()) == [1, 1, 3, 3, 5, 5]


def test_components_start_inside(spark):
    """One on the border alone is none; another's order is that of its first inner pixel."""
    rows = ["#..##.", "#.....", "..#...", ".#..#.", "....#.", "......"]
    fore = spark.createDataFrame([(0, x, y) for y, r in enumerate(rows) for x, c in enumerate(r) if c == "#"] , "image_id int, x int, y int")
    sizes = spark.createDataFrame([(0, 5, 5)], "image_id int, _w int, _h int")
    got = C.summarised(C.components(fore), sizes=sizes, most=1, number=True).collect()
    assert [(r["n"], r["k"], r["min_x"], r["min_y"]) for r in got] == [(2, 1, 1, 2)]
    assert C.summarised(C.components(fore), sizes=sizes).count() == 2 and C.summarised(C.components(fore)).count() == 4


def test_a_drawing_is_loaded(spark):
    ink = lambda x, y: 20 <= x < 23 and 10 <= y < 50 or 20 <= x < 50 and 10 <= y < 13
    pixels = spark.createDataFrame([(0, x, y, *([10] * 3 if ink(x, y) else [245] * 3)) for y in range(60) for x in range(60)], "image_id int, x int, y int, r int, g int, b int")
    got = {k: v.collect() for k, v in K.load(pixels, suggested=0.02).items()}
    assert got["report"][0]["kind"] in K.DRAWINGS
    assert [(r["image_id"], r["is_calibrated"], r["metres_per_pixel"]) for r in got["calibration"]] == [(0, True, 0.02)]
    assert {r["layer"] for r in got["features"]} == {"WALLS"} and [r["seq"] for r in got["features"]] == list(range(1, len(got["features"]) + 1))
    assert {r["name"]: r["features"] for r in got["layers"]} == {"BUILDINGS": 0, "ROADS": 0, "PARCELS": 0, "WALLS": len(got["features"])}
    assert got["issues"] == []


def test_views(spark):
    row = spark.createDataFrame([(10.0, 20.0)], "x double, y double")
    p, pan, mouse = G.point(F.col("x"), F.col("y")), G.point(F.lit(4.0), F.lit(-2.0)), G.point(F.lit(50.0), F.lit(60.0))
    zoomed = E.zoomed_at(pan, F.lit(2.0), mouse, 1.15)
    under = E.to_world(mouse, zoomed["pan"], zoomed["zoom"])
    got = row.select(E.to_world(p, pan, F.lit(2.0)), E.to_screen(E.to_world(p, pan, F.lit(2.0)), pan, F.lit(2.0)), E.to_world(mouse, pan, F.lit(2.0)), under, E.zoomed(F.lit(29.0), E.ZOOM_IN), E.zoomed(F.lit(0.06), E.ZOOM_OUT), E.fitted(F.lit(832.0), F.lit(632.0), F.lit(100.0), F.lit(100.0))).first()
    assert (got[0]["x"], got[0]["y"]) == (3.0, 11.0) and (got[1]["x"], got[1]["y"]) == (10.0, 20.0)
    assert abs(got[2]["x"] - got[3]["x"]) < 1e-9 and abs(got[2]["y"] - got[3]["y"]) < 1e-9
    assert got[4] == 30.0 and got[5] == 0.05 and got[6]["zoom"] == 2.5 and got[6]["pan"]["x"] == 291.0


def test_layers_by_name(spark):
    assert E.with_layer(layers(spark), " \t").count() == 19
    new = E.with_layer(layers(spark), " north wing ").where("name = 'NORTH_WING'").first()
    assert (new["aci"], new["lineweight"], new["linetype"], new["visible"], new["locked"]) == (7, 0.25, "CONTINUOUS", True, False)
