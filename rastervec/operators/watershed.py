"""Marker-controlled watershed.

Peaks of the distance map are markers; a queue floods the foreground from them. What the queue does in one component of the foreground does not depend on the
others, so components are flooded by many tasks at once, and what a task holds is bounded by a component.
"""

from __future__ import annotations

from array import array

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rastervec.operators import components as C
from rastervec.operators import pixels as P
from rastervec.operators import tiles as T
from rastervec.operators.components import settled

SIDES = [(-1, 0), (1, 0), (0, -1), (0, 1)]
AROUND = [*SIDES, (-1, -1), (1, -1), (-1, 1), (1, 1)]
PIXEL = ["image_id", "x", "y"]


def _moves(offsets) -> F.Column:
    return F.explode(F.array(*(F.struct((F.col("x") + dx).alias("x"), (F.col("y") + dy).alias("y"), F.lit(k).alias("k")) for k, (dx, dy) in enumerate(offsets))))


def markers(plane: DataFrame, *, ratio: float = 0.35, least: float = 3.0) -> DataFrame:
    """(image_id, x, y, label) from all pixels (image_id, x, y, d): labels from 2 on, in raster order of the peaks.

    A peak marks its square of nine where the distance reaches 0.7 of the threshold; where squares meet, the later peak's label stays."""
    tops = P.peaks(plane, "d", ratio=ratio, least=least).select(*PIXEL)
    tops = tops.withColumn("label", F.row_number().over(Window.partitionBy("image_id").orderBy("y", "x")) + 1)
    square = [(dx, dy) for dy in (-1, 0, 1) for dx in (-1, 0, 1)]
    spread = tops.select("image_id", "label", _moves(square).alias("n")).select("image_id", "label", "n.x", "n.y").groupBy(*PIXEL).agg(F.max("label").alias("label"))
    limit = plane.groupBy("image_id").agg((F.greatest(F.lit(least), F.max("d").cast("double") * ratio) * 0.7).alias("_limit"))
    return spread.join(plane, PIXEL).join(limit, "image_id").where(F.col("d") >= F.col("_limit")).select(*PIXEL, "label")


def _flood(x: np.ndarray, y: np.ndarray, cost: np.ndarray, label: np.ndarray) -> np.ndarray:
    """Labels after the flood of one component: markers (label > 0) flood what has a cost; 0 is what they don't reach."""
    x0, y0, w = int(x.min()) - 1, int(y.min()) - 1, int(x.max() - x.min()) + 3
    at = (y.astype(np.int64) - y0) * w + x - x0
    area = w * (int(y.max()) - y0 + 2)
    own, priced = np.full(area, -2, np.int32), np.zeros(area)  # -2: not foreground, 0: free, -1: in the queue
    own[at], priced[at] = label, cost
    of, price = array("i", own.tobytes()), array("d", priced.tobytes())  # 20 bytes a pixel with the queue
    del own, priced
    sides, around = [dy * w + dx for dx, dy in SIDES], [dy * w + dx for dx, dy in AROUND]
    first = []
    for i in np.sort(at[label > 0]).tolist():
        for step in sides:
            if of[i + step] == 0:
                of[i + step] = -1
                first.append(i + step)
    first.sort(key=price.__getitem__)  # ties stay in the order in which they were met
    queue = array("q", first)
    del first
    for i in queue:  # grows while it is read
        of[i] = next(n for step in around if (n := of[i + step]) > 0)
        for step in sides:
            if of[i + step] == 0:
                of[i + step] = -1
                queue.append(i + step)
    return np.frombuffer(of, np.int32)[at]


def flooded(fore: DataFrame, marked: DataFrame) -> DataFrame:
    """(image_id, x, y, label): markers and what they flood of the foreground (image_id, x, y, cost).

    The queue starts with the markers' side neighbours by rising cost, ties in the order in which they were met; from then on first come, first served. Pixels only ever ask
    their neighbours, so components of the foreground are flooded each by itself, in a task of their own; foreground that no marker reaches gets no row.
    What a component has in a tile goes to that task as one row of arrays, so that a pixel takes there what its numbers do and not a row."""
    image = fore.schema["image_id"].dataType.simpleString()
    every = settled(fore.select(*PIXEL, F.col("cost").cast("double").alias("cost")).join(marked.select(*PIXEL, "label"), PIXEL, "full").select(*PIXEL, F.coalesce("cost", F.lit(0.0)).alias("cost"), F.coalesce("label", F.lit(0)).cast("int").alias("label")))
    parts = C.components(every).withColumnRenamed("label", "part")
    reached = every.join(parts, PIXEL)

    def packed(table: pa.Table) -> pa.Table:
        table = table.sort_by("part")
        part = table["part"].to_numpy()
        cuts = np.concatenate([[0], np.flatnonzero(part[1:] != part[:-1]) + 1, [len(part)]])
        lists = {c: pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), table[c].combine_chunks()) for c in kinds}
        return pa.table({"image_id": table["image_id"].take(pa.array(cuts[:-1])), "part": pa.array(part[cuts[:-1]])} | lists)

    def flood(table: pa.Table) -> pa.Table:
        x, y, cost, label = (table[c].combine_chunks().flatten().to_numpy() for c in kinds)
        label = _flood(x, y, cost, label)
        out = {"image_id": pa.repeat(table["image_id"][0], len(x)), "x": pa.array(x), "y": pa.array(y), "label": pa.array(label)}
        return pa.table(out).filter(pa.array(label > 0))

    kinds = {"x": "int", "y": "int", "cost": "double", "label": "int"}
    tile = {f"_t{c}": T.tile_of(F.col(c), T.SIZE) for c in "xy"}
    tiles = T.spread(reached.select("image_id", "part", *(F.col(c).cast(k).alias(c) for c, k in kinds.items())).withColumns(tile), "image_id", *tile).groupBy("image_id", *tile)
    parts = tiles.applyInArrow(packed, f"image_id {image}, part long, " + ", ".join(f"{c} array<{k}>" for c, k in kinds.items()))
    return T.spread(parts, "image_id", "part").groupBy("image_id", "part").applyInArrow(flood, f"image_id {image}, x int, y int, label int")


def instances(mask: DataFrame, pixels: DataFrame, *, ratio: float = 0.35, least_peak: float = 3.2) -> DataFrame:
    """(image_id, x, y, label): the mask (image_id, x, y, bit of all pixels), closed and cut into instances; images without a peak: components by sides."""
    clean = settled(P.closed(mask).select(*PIXEL, "bit"))
    fore = clean.where("bit = 1").select(*PIXEL)
    far = C.chamfer(fore)
    plane = settled(clean.join(far, PIXEL, "left").select(*PIXEL, "bit", F.coalesce("d", F.lit(0.0).cast("float")).alias("d")))
    marked = settled(markers(plane.drop("bit"), ratio=ratio, least=least_peak))
    cost = (F.lit(255.0) - F.col("d").cast("double") * 8 + F.col("gradient").cast("double") * 0.45).alias("cost")
    priced = plane.where("bit = 1").join(P.sobel(pixels), PIXEL).select(*PIXEL, cost)
    cut = flooded(priced, marked).select(*PIXEL, F.col("label").cast("long").alias("label"))
    rest = fore.join(C.small(marked.select("image_id").distinct()), "image_id", "left_anti")
    return cut.unionByName(C.components(rest, diagonal=False).select(*PIXEL, "label"))
