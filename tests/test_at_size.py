"""Work that must grow with its input, and sums that must be those of the SQL."""

import math
import time

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from rastervec.functions import geometry as G
from rastervec.functions import regularise as R
from rastervec.operators import checksums as Q
from rastervec.operators import documents as D
from rastervec.operators import features as O
from rastervec.operators import watershed as W


def rings(spark, shapes):
    return spark.createDataFrame([(k, z) for k, z in enumerate(shapes)], "k int, points array<struct<x:double,y:double>>")


def test_oriented_box_takes_time_by_vertices(spark):
    turn = math.radians(20)
    side = [(60.0 * t / 1500, 0.0) for t in range(1500)] + [(60.0, 40.0 * t / 1000) for t in range(1000)]
    ring = side + [(60.0 - x, 40.0 - y) for x, y in side]
    wide = [(30 * (x * math.cos(turn) - y * math.sin(turn)), 30 * (x * math.sin(turn) + y * math.cos(turn))) for x, y in ring]
    rows = rings(spark, [wide, [], None, wide[:2], [(0.0, 0.0), (4.0, 0.0), (8.0, 0.0)], [(0.0, 0.0), (9.0, 9.0), (0.0, 1.0)]])
    began = time.perf_counter()
    got = {r["k"]: r["b"] for r in rows.select("k", R.oriented_box(F.col("points")).alias("b")).collect()}
    assert time.perf_counter() - began < 60  # the angle was worked out again for every vertex
    assert [got[k] for k in range(1, 6)] == [None] * 5 and len(got[0]) == 4
    far = max(range(4), key=lambda i: got[0][i]["x"] + got[0][i]["y"])
    assert abs(got[0][far]["x"] - wide[2500][0]) < 0.011 and abs(got[0][far]["y"] - wide[2500][1]) < 0.011


def test_areas_on_a_half_are_summed_like_the_sql(spark):
    points = [(q, e / 1000) for q, e in ((27.0, 65833.06), (35.0, 94352.21), (5.0, 36958.27), (33.0, 84280.4), (31.0, 16210.46), (25.0, 6318.04))]  # order 56338 of sf0.1
    got = rings(spark, [points]).select(F.floor(G.area(F.col("points")) + 0.5).alias("a"), G.area(F.col("points")).alias("b")).first()
    total = 0.0
    for (ax, ay), (bx, by) in zip(points, points[1:] + points[:1]):
        total += ax * by - bx * ay
    assert got["b"] == abs(total) / 2 and got["a"] == 273  # 272 before, when the products were added one by one


def test_picks_of_one_place_are_looked_up_once(spark):
    rows = spark.range(5000).select("id", F.col("id").alias("seq"), F.lit(True).alias("is_closed"), F.array(*(G.point(F.lit(x), F.lit(y) + F.col("id") / 1e5) for x, y in ((0.0, 0.0), (9.0, 0.0), (9.0, 9.0), (0.0, 9.0)))).alias("points"))
    picks = spark.range(100_000).select(F.col("id").alias("pick"), (F.col("id") % 2 * 4.5 + 4.25).alias("x"), F.when(F.col("id") % 5 == 0, 70.0).otherwise(4.0).alias("y"))
    began = time.perf_counter()
    got = O.picked(rows, picks, tolerance=0.5, cell=5.0).groupBy("id").count().collect()
    assert time.perf_counter() - began < 40  # each pick met each feature: 500 million pairs
    assert [tuple(r) for r in got] == [(4999, 80_000)]
    assert [tuple(r) for r in O.picked(rows, picks, tolerance=0.5, cell=5.0, interior=False).groupBy("id").count().collect()] == [(4999, 40_000)]
    again = spark.createDataFrame([(1, 4.0, 4.0), (1, 70.0, 70.0), (2, 70.0, 70.0), (3, None, 4.0)], "pick int, x double, y double")
    assert [tuple(r) for r in O.picked(rows, again, tolerance=0.5, cell=5.0).collect()] == [(1, 4999)]
    assert O.picked(rows, again.where("false"), tolerance=0.5, cell=5.0).count() == 0


def test_an_image_is_folded_by_many_tasks(spark):
    data = np.random.default_rng(5).integers(0, 256, 5000).astype(np.uint8)
    for n in (0, 1, 511, 512, 5000):
        assert [int(v) for v in Q.effect(data[:n])[[0, 7, 255]]] == [Q.folded(data[:n].tobytes(), s) for s in (0, 7, 255)]
    rows = spark.range(60_000).select(F.lit(None).cast("string").alias("image_id"), (F.col("id") % 40).alias("x"), F.floor(F.col("id") / 40 - 500).alias("y"), F.pmod(F.xxhash64("id"), F.lit(256)).alias("v"), F.when(F.col("id") % 3 > 0, F.col("id") % 250).alias("w"))
    rows = rows.unionByName(rows.withColumn("image_id", F.lit("b")).where("y < 70")).repartition(5, "x")
    plain = {}
    for name, kept in ((None, "true"), ("b", "y < 70")):
        own = rows.where(F.col("image_id").eqNullSafe(name)).where(kept).orderBy("y", "x").select("v", F.coalesce("w", F.lit(0)).alias("w")).collect()
        plain[name] = (len(own), Q.folded(bytes(v for r in own for v in r)))
    got = Q.checksums(rows, "v", "w")
    assert {r["image_id"]: (r["n"], r["checksum"]) for r in got.collect()} == plain
    held = rows.where("image_id is null").groupBy(F.floor(F.col("y") / Q.ROWS)).count()
    assert held.count() > 8 and held.agg(F.max("count")).first()[0] == 40 * Q.ROWS  # what a task has to sort together; all of an image before


def test_right_angled_outlines_hold_a_slice_at_once():
    import tracemalloc

    shapes = [[(float((37 * k + 11 * i * i) % 97), float((53 * k + 29 * i) % 89)) for i in range(32)] for k in range(4096)]
    most = {}
    for n in (512, 4096):
        v = pa.array([[{"x": x, "y": y} for x, y in z] for z in shapes[:n]], pa.list_(pa.struct([("x", pa.float64()), ("y", pa.float64())])))
        tracemalloc.start()
        out = R.squared_rings(v, 12.0, 5.0)
        most[n] = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
    assert out[7].as_py() == [{"x": x, "y": y} for x, y in R.right_angled(shapes[7], math.radians(12), 5.0)] and len(out) == 4096
    assert R.squared_rings(pa.array([None, [], [{"x": 1.0, "y": 2.0}]], v.type), 12.0, 5.0).to_pylist() == [None, [], [{"x": 1.0, "y": 2.0}]]
    assert most[4096] < 4 * most[512]  # all outlines of a batch were points of Python's own at once, twice: in and out


def test_a_flood_holds_numbers_and_not_rows(spark):
    import tracemalloc

    y, x = (a.ravel().astype(np.int32) for a in np.mgrid[0:600, 0:100])
    cost, label = ((37 * x + 11 * y) % 251).astype(np.float64), np.where((x % 50 == 7) & (y % 100 == 3), 2 + x + y, 0).astype(np.int32)
    tracemalloc.start()
    got = W._flood(x, y, cost, label)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert (got > 0).all() and most < 70 * len(x)  # lists of Python's own numbers took over twice as much
    rows = spark.createDataFrame([(0, int(a), int(b), float(c)) for a, b, c in zip(x, y, cost)], "image_id int, x int, y int, cost double")
    marked = spark.createDataFrame([(0, int(a), int(b), int(n)) for a, b, n in zip(x, y, label) if n], "image_id int, x int, y int, label int")
    out = W.flooded(rows, marked)
    assert {(r["x"], r["y"]): r["label"] for r in out.collect()} == dict(zip(zip(x.tolist(), y.tolist()), got.tolist()))


def test_shapefiles_work_features_out_once(spark):
    seen = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            seen.add(len(batch))
            yield batch

    corner = lambda x, y: G.point(F.lit(x) + F.col("id"), F.lit(y))
    ring = F.array(corner(0.0, 0.0), corner(4.0, 0.0), corner(4.0, 3.0))
    kind = F.when(F.col("id") % 3 == 0, "POINT").otherwise("LWPOLYLINE")
    rows = spark.range(300).select("id", F.col("id").alias("seq"), F.lit("ROADS").alias("layer"), (F.col("id") % 3 == 1).alias("is_closed"), kind.alias("geometry_type"), F.lit(80.0).alias("confidence"), F.when(F.col("id") % 3 == 0, F.slice(ring, 1, 1)).otherwise(ring).alias("points"))
    parts = D.shapefiles(rows.mapInArrow(counted, rows.schema)).groupBy("file").count().collect()
    assert {r["file"]: r["count"] for r in parts} == {f"{k}.{e}": n for k in ("polygons", "lines", "points") for e, n in (("shp", 101), ("shx", 101), ("dbf", 102), ("prj", 1))}
    assert 300 <= seen.value <= 600  # each kind's ranges, bodies, bounds and records worked them out before
