"""Tiles, floods, walks and folds against plain versions that see a whole image."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from rastervec.functions import spectral
from rastervec.operators import checksums as Q
from rastervec.operators import components as C
from rastervec.operators import outlines as L
from rastervec.operators import pixels as P
from rastervec.operators import tiles as T
from rastervec.operators import watershed as W
from rastervec.sources import adapters

AROUND = [(dx, dy) for dx in (-1, 0, 1) for dy in (-1, 0, 1) if dx or dy]


def blobs(seed, width=70, height=45, share=0.6):
    rng = np.random.default_rng(seed)
    noise = rng.random((height, width))
    smooth = sum(np.roll(noise, (dy, dx), (0, 1)) for dx in (-1, 0, 1) for dy in (-1, 0, 1)) / 9
    return smooth > np.quantile(smooth, share)


def pixels_of(spark, masks):
    rows = [(k, int(x), int(y)) for k, mask in enumerate(masks) for y, x in zip(*np.nonzero(mask))]
    return spark.createDataFrame(rows + rows[:5], "image_id int, x int, y int").repartition(5)


def plain_components(mask, around):
    label, (h, w) = {}, mask.shape
    for y, x in zip(*map(list, np.nonzero(mask))):
        if (x, y) not in label:
            stack, first = [(x, y)], (int(y) << 32) + int(x)
            label[x, y] = first
            while stack:
                a, b = stack.pop()
                for dx, dy in around:
                    n = (a + dx, b + dy)
                    if 0 <= n[0] < w and 0 <= n[1] < h and mask[n[1], n[0]] and n not in label:
                        label[n] = first
                        stack.append(n)
    return {(int(x), int(y), v) for (x, y), v in label.items()}


@pytest.mark.parametrize("diagonal", [True, False])
def test_components_across_tiles(spark, diagonal):
    masks = [blobs(1), blobs(2, share=0.3), np.eye(40, dtype=bool)[::-1]]
    around = AROUND if diagonal else [(0, 1), (1, 0), (0, -1), (-1, 0)]
    got = C.components(pixels_of(spark, masks), diagonal=diagonal, size=16).collect()
    for k, mask in enumerate(masks):
        rows = [(r["x"], r["y"], r["label"]) for r in got if r["image_id"] == k]
        assert len(rows) == mask.sum() and set(rows) == plain_components(mask, around)
    assert C.components(pixels_of(spark, masks).where("false")).count() == 0


def test_chamfer_distances_equal_the_two_passes(spark):
    masks = [blobs(3, share=0.2), np.ones((30, 50), bool)]
    got = C.chamfer(pixels_of(spark, masks), columns=16).collect()
    for k, mask in enumerate(masks):
        d = np.where(np.pad(mask, 1), 1e9, 0)
        for _ in range(60):
            for dx, dy in AROUND:
                d = np.where(d > 0, np.minimum(d, np.roll(d, (dy, dx), (0, 1)) + (1.414 if dx and dy else 1)), 0)
        rows = {(r["x"], r["y"]): r["d"] for r in got if r["image_id"] == k}
        assert len(rows) == mask.sum() and all(abs(v - d[y + 1, x + 1]) < 1e-4 for (x, y), v in rows.items())


def test_thinning_does_not_depend_on_tiles(spark):
    masks = [blobs(4, share=0.3), blobs(5)]
    rows = pixels_of(spark, masks)
    small, large = ({tuple(r) for r in C.thinned(rows, width=70, height=45, most=21, size=s).collect()} for s in (16, 128))
    whole = {(k, int(x), int(y)) for k, m in enumerate(masks) for y, x in zip(*np.nonzero(T.thinning(m, 0, 0, width=70, height=45, times=21)))}
    assert small == large == whole and len(whole) < sum(m.sum() for m in masks)


def plain_flood(mask, cost, marked):
    label = dict(marked)
    queued, queue = set(), []
    for x, y in sorted(marked, key=lambda p: (p[1], p[0])):
        for dx, dy in W.SIDES:
            n = (x + dx, y + dy)
            if n in mask and n not in label and n not in queued:
                queued.add(n)
                queue.append(n)
    queue.sort(key=lambda p: cost[p])
    while queue:
        x, y = queue.pop(0)
        label[x, y] = next(label[n] for dx, dy in W.AROUND if (n := (x + dx, y + dy)) in label)
        for dx, dy in W.SIDES:
            n = (x + dx, y + dy)
            if n in mask and n not in label and n not in queued:
                queued.add(n)
                queue.append(n)
    return label


def test_floods_equal_a_sequential_queue(spark):
    rng, rows, marks, want = random.Random(6), [], [], {}
    for k in range(4):
        mask = {(int(x), int(y)) for y, x in zip(*np.nonzero(blobs(10 + k, share=0.35)))}
        cost = {p: float(rng.randint(0, 6)) for p in mask}
        marked = {p: 2 + i for i, p in enumerate(sorted(rng.sample(sorted(mask), 9), key=lambda p: (p[1], p[0])))}
        rows += [(k, x, y, c) for (x, y), c in cost.items()]
        marks += [(k, x, y, n) for (x, y), n in marked.items()]
        want |= {(k, *p): n for p, n in plain_flood(mask, cost, marked).items()}
    got = W.flooded(spark.createDataFrame(rows, "image_id int, x int, y int, cost double").repartition(4), spark.createDataFrame(marks, "image_id int, x int, y int, label int"))
    assert {(r["image_id"], r["x"], r["y"]): r["label"] for r in got.collect()} == want


def plain_walk(mask, width):
    inside = {int(y) * width + int(x) for y, x in zip(*np.nonzero(mask))}
    at = start = (min(inside) % width, min(inside) // width)
    path, back = [start], 6
    for step in range(1, 3001):
        for i in range(8):
            d = (back + 1 + i) % 8
            n = (at[0] + L.CLOCKWISE[d][0], at[1] + L.CLOCKWISE[d][1])
            if n[1] * width + n[0] in inside:
                at, back = n, (d + 4) % 8
                break
        else:
            break
        if at == start:
            break
        if step % 2 == 0:
            path.append(at)
    return path


def test_walks_cross_row_ends(spark):
    masks = [np.zeros((12, 20), bool) for _ in range(3)]
    masks[0][3:8, :4] = masks[0][2:7, 16:] = masks[0][5, :] = True  # on both sides of the image
    masks[1][4:7, 5:9] = True
    masks[2][:, 0] = masks[2][:, 19] = masks[2][0, :] = True
    rows = pixels_of(spark, masks).withColumn("label", F.lit(1))
    widths = spark.createDataFrame([(0, 20), (1, 20)], "image_id int, width int")
    got = {r["image_id"]: [(int(p["x"]), int(p["y"])) for p in r["points"]] for r in L.outlines(rows, widths=widths).collect()}
    assert got == {0: plain_walk(masks[0], 20), 1: plain_walk(masks[1], 20), 2: plain_walk(masks[2], 1000)}
    assert any(not 0 <= x < 20 for x, _ in got[0])


def test_kernels_see_margins(spark):
    mask = blobs(8)
    grown = T.on_tiles(pixels_of(spark, [mask]).withColumn("v", F.col("x") + 100 * F.col("y")), {"v": "int64"}, lambda present, planes, x0, y0: (present, {"s": sum(np.roll(planes["v"], (dy, dx), (0, 1)) for dx in range(-3, 4) for dy in range(-3, 4))}), "s long", margin=3, size=16)
    value = np.pad(np.where(mask, np.arange(70)[None, :] + 100 * np.arange(45)[:, None], 0), 3)
    got = {(r["x"], r["y"]): r["s"] for r in grown.collect()}
    assert got == {(int(x), int(y)): int(value[y : y + 7, x : x + 7].sum()) for y, x in zip(*np.nonzero(mask))}


def test_golden_checksums_of_the_fixture(spark):
    roof = adapters.striped_roof(spark)
    bits = P.sauvola(roof.withColumn("gray", spectral.gray()), radius=6)
    smooth = P.bilateral(roof, radius=2, sigma=25.0)
    assert tuple(Q.checksums(smooth, "r", "g", "b", "a").first()) == (0, 1536, 3884067805)
    assert Q.checksums(smooth, "a").first()["checksum"] == 1840294853
    assert Q.checksums(bits, "bit").first()["checksum"] == 4177005890 and bits.where("bit = 1").count() == 617
    many = spark.range(60_000).select((F.col("id") % 3).alias("image_id"), (F.col("id") % 250).alias("x"), F.expr("id div 250").alias("y"), F.when(F.col("id") % 7 > 0, F.col("id") % 256).alias("v")).repartition(6)
    plain = {k: Q.folded(bytes(i % 256 if i % 7 else 0 for i in range(60_000) if i % 3 == k)) for k in range(3)}
    assert {r["image_id"]: r["checksum"] for r in Q.checksums(many, "v").collect()} == plain and Q.checksums(many.where("false"), "v").count() == 0
