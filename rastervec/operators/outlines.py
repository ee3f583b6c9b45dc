"""Outlines and centre lines of components, as ordered points.

Walks depend on all steps before, so a component is walked in one task, and components are spread over tasks. What a task holds is a component as runs, or its skeleton; a walk has 3000 steps at most.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rastervec.operators import tiles as T

#: Directions clockwise from above, and the order in which a centre line looks for its next pixel.
CLOCKWISE = [(0, -1), (1, -1), (1, 0), (1, 1), (0, 1), (-1, 1), (-1, 0), (-1, -1)]
FORWARD = [(1, 0), (1, 1), (0, 1), (-1, 1), (-1, 0), (-1, -1), (0, -1), (1, -1)]
MOST_STEPS = 3000


def _traced(row: np.ndarray, first: np.ndarray, last: np.ndarray, width: int | None, most_steps: int, every: int) -> list[tuple[int, int]]:
    """The walk around one component, given as runs. With ``width`` places are y * width + x, as in an image's buffer: what is left of a row is the end of the one above."""
    pitch = width if width is not None else int(last.max()) + 3
    inside = {i for y, a, b in zip(row.tolist(), first.tolist(), last.tolist()) for i in range(y * pitch + a, y * pitch + b + 1)}
    k = int(np.lexsort((first, row))[0])
    start = at = (int(first[k]), int(row[k]))
    path, back = [start], 6
    for step in range(1, most_steps + 1):
        for d in (back + 1, back + 2, back + 3, back + 4, back + 5, back + 6, back + 7, back + 8):
            dx, dy = CLOCKWISE[d % 8]
            if (at[1] + dy) * pitch + at[0] + dx in inside:
                at, back = (at[0] + dx, at[1] + dy), (d + 4) % 8
                break
        else:
            break
        if at == start:
            break
        if step % every == 0:
            path.append(at)
    return path


def outlines(labelled: DataFrame, *, most_steps: int = MOST_STEPS, every: int = 2, widths: DataFrame | None = None) -> DataFrame:
    """(image_id, label, points) from (image_id, label, x, y): each component's boundary, clockwise from its first pixel in raster order.

    Every second step gives a point; the walk ends when it comes back to its first pixel, which isn't repeated, or after ``most_steps``. A component of one pixel has one point. An empty relation gives no row.
    With ``widths`` (image_id, width) the walk looks for neighbours by their place in the image's buffer: a component on both sides of an image is left at one and entered again at the other, a row off.
    A component comes to its task as the runs of its rows."""
    image, name = (labelled.schema[c].dataType.simpleString() for c in ("image_id", "label"))
    row = Window.partitionBy("image_id", "label", "y").orderBy("x")
    runs = labelled.select("image_id", "label", "x", "y").distinct().withColumn("_run", F.col("x") - F.row_number().over(row))
    runs = runs.groupBy("image_id", "label", "y", "_run").agg(F.min("x").alias("first"), F.max("x").alias("last")).drop("_run")
    runs = runs.withColumn("width", F.lit(None).cast("int")) if widths is None else runs.join(widths.select("image_id", F.col("width").cast("int").alias("width")), "image_id", "left")

    def walk(table: pa.Table) -> pa.Table:
        width = table["width"][0].as_py()
        path = _traced(*(table[c].to_numpy() for c in ("y", "first", "last")), width, most_steps, every)
        points = [[{"x": float(x), "y": float(y)} for x, y in path]]
        return pa.table({"image_id": table["image_id"][:1], "label": table["label"][:1], "points": pa.array(points, pa.list_(pa.struct([("x", pa.float64()), ("y", pa.float64())])))})

    return T.spread(runs, "image_id", "label").groupBy("image_id", "label").applyInArrow(walk, f"image_id {image}, label {name}, points array<struct<x:double,y:double>>")


def _walked(rows: pd.DataFrame) -> list[dict[str, float]]:
    """From the first end, else the first pixel, always to the first neighbour not yet visited."""
    free = set(zip(rows["x"].tolist(), rows["y"].tolist()))
    around = lambda p: [q for dx, dy in FORWARD if (q := (p[0] + dx, p[1] + dy)) in free]
    order = sorted(free, key=lambda p: (p[1], p[0]))
    at, path = next((p for p in order if len(around(p)) == 1), order[0]), []
    while at is not None and len(path) < MOST_STEPS:
        path.append({"x": float(at[0]), "y": float(at[1])})
        free.discard(at)
        at = next(iter(around(at)), None)
    return path


def centrelines(skeleton: DataFrame) -> DataFrame:
    """(image_id, label, points) from the thinned pixels (image_id, label, x, y); branches off the walk are left out, and lines of one point.

    A step depends on all steps before, so a component's skeleton, one pixel wide, is walked in one task; components are spread over tasks.
    """
    kinds = {f.name: f.dataType.simpleString() for f in skeleton.schema}

    def walk(rows: pd.DataFrame) -> pd.DataFrame:
        path = _walked(rows)
        return rows[["image_id", "label"]].head(1).assign(points=[path]) if len(path) > 1 else rows[["image_id", "label"]].head(0).assign(points=pd.Series(dtype=object))

    return T.spread(skeleton.select("image_id", "label", "x", "y"), "image_id", "label").groupBy("image_id", "label").applyInPandas(walk, f"image_id {kinds['image_id']}, label {kinds['label']}, points array<struct<x:double,y:double>>")
