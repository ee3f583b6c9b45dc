"""Work on tiles: pixels of a square and of a margin around it become arrays, a NumPy kernel works on them, and the square's own pixels come back as rows.

A tile and its margin bound what a task holds, whatever the size of an image. A pixel near a tile's border is sent to its neighbours as well, so an operator
that looks at most a margin away takes one shuffle.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SIZE = 256
#: present, the planes, and the place of the first cell -> cells to keep, and planes to return
Kernel = Callable[[np.ndarray, dict[str, np.ndarray], int, int], tuple[np.ndarray, dict[str, np.ndarray]]]


def tile_of(c: Column, size: int) -> Column:
    return F.floor(c / size).cast("int")


def spread(rows: DataFrame, *keys: str) -> DataFrame:
    """Rows by their keys in as many partitions as a shuffle has. The number is fixed, so adaptive execution, which goes by bytes, does not put little data with much work into one task."""
    return rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


def on_tiles(rows: DataFrame, planes: dict[str, str], kernel: Kernel, returned: str = "", *, margin: int, size: int = SIZE) -> DataFrame:
    """(image_id, x, y and ``returned`` columns) of the cells that the kernel keeps, from rows (image_id, x, y and ``planes``: column and NumPy type).

    Cells without a row are not ``present`` and zero in all planes: beyond an image's border, or background. A tile without a row gives none; of rows with the same place one counts."""
    image = rows.schema["image_id"].dataType.simpleString()
    reach = lambda c: F.explode(F.sequence(tile_of(F.col(c) - margin, size), tile_of(F.col(c) + margin, size)))
    sent = rows.select("image_id", "x", "y", *planes).withColumn("_tx", reach("x")).withColumn("_ty", reach("y"))
    names = [c.split()[0] for c in returned.split(",") if c.strip()]

    def work(table: pa.Table) -> pa.Table:
        x0, y0 = table["_tx"][0].as_py() * size - margin, table["_ty"][0].as_py() * size - margin
        at = table["y"].to_numpy() - y0, table["x"].to_numpy() - x0
        present = np.zeros((size + 2 * margin, size + 2 * margin), bool)
        present[at] = True
        filled = {}
        for name, kind in planes.items():
            filled[name] = np.zeros(present.shape, kind)
            filled[name][at] = table[name].to_numpy()
        keep, out = kernel(present, filled, x0, y0)
        own = np.s_[margin : margin + size, margin : margin + size]
        y, x = np.nonzero(keep[own])
        columns = {"image_id": pa.repeat(table["image_id"][0], len(x)), "x": pa.array((x + x0 + margin).astype(np.int32)), "y": pa.array((y + y0 + margin).astype(np.int32))}
        return pa.table(columns | {name: pa.array(out[name][own][y, x]) for name in names})

    return spread(sent, "image_id", "_tx", "_ty").groupBy("image_id", "_tx", "_ty").applyInArrow(work, f"image_id {image}, x int, y int" + (f", {returned}" if returned else ""))


def runs_of(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, first, last) of all runs of a mask, in raster order."""
    steps = np.diff(np.pad(mask, ((0, 0), (1, 1))).astype(np.int8), axis=1)
    row, first = np.nonzero(steps == 1)
    return row, first, np.nonzero(steps == -1)[1] - 1


def merged(n: int, u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """The least member of each of n members' groups, from links between u and v."""
    root = np.arange(n)
    while True:
        a, b = root[u], root[v]
        apart = a != b
        if not apart.any():
            return root
        u, v, a, b = u[apart], v[apart], a[apart], b[apart]
        np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
        while not np.array_equal(further := root[root], root):
            root = further


def labelled_runs(mask: np.ndarray, diagonal: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Runs of a mask, and for each the first run of its component."""
    row, first, last = runs_of(mask)
    pitch, reach = mask.shape[1] + 3, int(diagonal)
    low = np.searchsorted(row * pitch + last + 1, (row + 1) * pitch + first + 1 - reach)
    high = np.searchsorted(row * pitch + first + 1, (row + 1) * pitch + last + 1 + reach, "right")
    many = np.maximum(0, high - low)
    above = np.repeat(np.arange(len(row)), many)
    below = np.arange(len(above)) + np.repeat(low - (np.cumsum(many) - many), many)
    return row, first, last, merged(len(row), above, below)


def thinning(present: np.ndarray, x0: int, y0: int, *, width: int, height: int, times: int) -> np.ndarray:
    """Zhang and Suen's two sub-iterations on inner cells, ``times`` times; a cell is right if it is twice as many cells from the array's border."""
    rows, columns = present.shape
    x, y = np.arange(columns) + x0, np.arange(rows) + y0
    inner = ((y > 0) & (y < height - 1))[:, None] & ((x > 0) & (x < width - 1))[None, :]
    mask = np.pad(present, 1)
    for _ in range(times):
        for first in (True, False):
            ring = [mask[1 + dy : 1 + dy + rows, 1 + dx : 1 + dx + columns] for dx, dy in ((0, -1), (1, -1), (1, 0), (1, 1), (0, 1), (-1, 1), (-1, 0), (-1, -1))]
            count = sum(r.astype(np.int8) for r in ring)
            turns = sum((~a & b).astype(np.int8) for a, b in zip(ring, ring[1:] + ring[:1]))
            up, right, down, left = ring[0], ring[2], ring[4], ring[6]
            kept = (up & right & down) | (right & down & left) if first else (up & right & left) | (up & down & left)
            own = mask[1:-1, 1:-1]
            mask = np.pad(own & ~(inner & (count >= 2) & (count <= 6) & (turns == 1) & ~kept), 1)
    return mask[1:-1, 1:-1]
