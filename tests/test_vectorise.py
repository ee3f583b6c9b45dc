"""Outlines, centre lines, watershed, regularisation and shapefiles against plain versions."""

import random

from pyspark.sql import functions as F

from rastervec.functions import regularise as R
from rastervec.operators import components as C
from rastervec.operators import outlines as L
from rastervec.operators import vectorise as V
from rastervec.operators import watershed as W
from rastervec.schema import Parameters

CLOCKWISE = L.CLOCKWISE


def plain_outline(blob, most=3000):
    start = min(blob, key=lambda p: (p[1], p[0]))
    at, back, points = start, 6, [start]
    for step in range(1, most + 1):
        move = next(((k, q) for i in range(8) for k in [(back + 1 + i) % 8] for q in [(at[0] + CLOCKWISE[k][0], at[1] + CLOCKWISE[k][1])] if q in blob), None)
        if move is None:
            break
        back, at = (move[0] + 4) % 8, move[1]
        if at == start:
            break
        if step % 2 == 0:
            points.append(at)
    return points


def test_outlines_of_random_blobs(spark):
    rng, rows = random.Random(5), []
    for image in range(12):
        rows += [(image, x, y) for y in range(14) for x in range(17) if rng.random() < 0.3 + image * 0.05]
    labelled = C.components(spark.createDataFrame(rows, "image_id int, x int, y int"))
    blobs = {}
    for r in labelled.collect():
        blobs.setdefault((r["image_id"], r["label"]), set()).add((r["x"], r["y"]))
    found = {(r["image_id"], r["label"]): [(int(p["x"]), int(p["y"])) for p in r["points"]] for r in L.outlines(labelled, most_steps=200).collect()}
    assert found == {k: plain_outline(b, 200) for k, b in blobs.items()}


def test_centreline_walks_from_an_end(spark):
    rows = [(0, 7, x, 3) for x in range(2, 9)] + [(0, 8, 0, 0)] + [(0, 9, 20, y) for y in range(4)]
    found = {r["label"]: [(p["x"], p["y"]) for p in r["points"]] for r in L.centrelines(spark.createDataFrame(rows, "image_id int, label long, x int, y int")).collect()}
    assert found == {7: [(x, 3) for x in range(2, 9)], 9: [(20, y) for y in range(4)]}


def plain_flood(fore, marked, cost):
    label, queue, waiting = dict(marked), [], set()
    for y, x in sorted((y, x) for x, y in marked):
        for dx, dy in W.SIDES:
            q = (x + dx, y + dy)
            if q in fore and q not in label and q not in waiting:
                queue.append(q)
                waiting.add(q)
    queue.sort(key=lambda q: cost[q])
    for p in queue:
        label[p] = next(label[q] for dx, dy in W.AROUND for q in [(p[0] + dx, p[1] + dy)] if q in label)
        for dx, dy in W.SIDES:
            q = (p[0] + dx, p[1] + dy)
            if q in fore and q not in label and q not in waiting:
                queue.append(q)
                waiting.add(q)
    return label


def test_flood_matches_the_queue(spark):
    rng = random.Random(3)
    fore = {(x, y) for y in range(12) for x in range(15) if rng.random() < 0.8}
    cost = {p: float(rng.randrange(4)) for p in fore}
    marked = {p: 2 + i for i, p in enumerate(rng.sample(sorted(fore), 4))}
    found = W.flooded(spark.createDataFrame([(0, *p, c) for p, c in cost.items()], "image_id int, x int, y int, cost double"), spark.createDataFrame([(0, *p, k) for p, k in marked.items()], "image_id int, x int, y int, label int"))
    assert {(r["x"], r["y"]): r["label"] for r in found.collect()} == plain_flood(fore, marked, cost)


def test_two_joined_squares_are_two_instances(spark):
    inside = lambda x, y: (4 <= x < 20 and 4 <= y < 20) or (26 <= x < 42 and 4 <= y < 20) or (20 <= x < 26 and 11 <= y < 13)
    rows = [(0, x, y, int(inside(x, y)), 90, 90, 90) for y in range(24) for x in range(46)]
    pixels = spark.createDataFrame(rows, "image_id int, x int, y int, bit int, r int, g int, b int")
    found = W.instances(pixels.select("image_id", "x", "y", "bit"), pixels.drop("bit")).groupBy("label").agg(F.count("*").alias("n"), F.min("x").alias("lo"), F.max("x").alias("hi")).where("n >= 25").collect()
    assert len(found) >= 2 and any(r["hi"] < 26 for r in found) and any(r["lo"] >= 20 for r in found)


def test_regularisation(spark):
    square = [(0.0, 0.0), (20.2, 0.1), (20.0, 10.0), (0.1, 10.2)]
    bent = [(0.0, 0.0), (40.0, 0.6), (40.3, 10.0), (10.0, 10.4), (10.2, 40.0), (0.0, 40.0)]
    as_points = lambda ps: [{"x": x, "y": y} for x, y in ps]
    rows = spark.createDataFrame([(0, as_points(square)), (1, as_points(bent)), (2, as_points(square[:2])), (3, None)], "id int, points array<struct<x:double,y:double>>")
    got = {r["id"]: r["p"] for r in rows.select("id", R.orthogonalised(F.col("points"), degrees=12, snap=5).alias("p")).collect()}
    assert len(got[0]) == 4 and len(got[1]) == 6 and [tuple(p) for p in got[2]] == square[:2] and got[3] is None
    for ring in (got[0], got[1]):
        for a, b, c in zip(ring, ring[1:] + ring[:1], ring[2:] + ring[:2]):
            u, v = (b["x"] - a["x"], b["y"] - a["y"]), (c["x"] - b["x"], c["y"] - b["y"])
            assert abs(u[0] * v[0] + u[1] * v[1]) <= 0.02 * (abs(u[0]) + abs(u[1])) * (abs(v[0]) + abs(v[1]))


def test_aerial_features(spark):
    def colour(x, y):
        if 6 <= x < 30 and 6 <= y < 24:
            return (184, 74, 57)  # a roof
        if 40 <= y < 52:
            return (142, 154, 157)  # a road
        if 60 <= y < 74 and 10 <= x < 24:
            return (101, 150, 76)  # a tree
        if 60 <= y < 76 and 40 <= x < 60:
            return (29, 97, 189)  # water
        return (0, 0, 0)

    rows = [(0, x, y, *colour(x, y)) for y in range(84) for x in range(70)]
    found = V.aerial(spark.createDataFrame(rows, "image_id int, x int, y int, r int, g int, b int"), Parameters()).orderBy("seq").collect()
    layers = [r["layer"] for r in found]
    assert layers == ["BUILDINGS", "ROAD_BOUNDARIES", "ROAD_CENTERLINES", "TREES", "WATER"] and [r["seq"] for r in found] == [1, 2, 3, 4, 5]
    roof, _, centre, tree, _ = found
    assert len(roof["points"]) == 4 and abs(roof["area"] - 23 * 17) <= 40 and roof["is_closed"]
    assert (tree["center"]["x"], tree["center"]["y"], tree["radius"]) == (16.5, 66.5, 6.5)
    assert not centre["is_closed"] and centre["length"] >= 50


def test_drawing_features(spark):
    ink = lambda x, y: abs(((x - 30) ** 2 + (y - 30) ** 2) ** 0.5 - 15) < 1.2 or (60 <= x < 63 and 10 <= y < 60)
    rows = [(0, x, y, *([10] * 3 if ink(x, y) else [245] * 3)) for y in range(70) for x in range(80)]
    found = V.drawing(spark.createDataFrame(rows, "image_id int, x int, y int, r int, g int, b int")).orderBy("seq").collect()
    assert [r["geometry_type"] for r in found] == ["LWPOLYLINE", "CIRCLE"] or [r["geometry_type"] for r in found] == ["CIRCLE", "LWPOLYLINE"]
    ring = next(r for r in found if r["geometry_type"] == "CIRCLE")
    assert abs(ring["center"]["x"] - 30) <= 1 and abs(ring["center"]["y"] - 30) <= 1 and abs(ring["radius"] - 16) <= 1
