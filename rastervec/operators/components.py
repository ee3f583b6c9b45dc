"""Operators on the relation of foreground pixels (image_id, x, y) whose reach has no bound: components, chamfer distances, thinning.

Tiles do what can be done within them; every exchange between tiles is written to the checkpoint folder, so a lost executor costs one round and plans stay short.
"""

from __future__ import annotations

import re
import tempfile

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rastervec.operators import tiles as T

AROUND = [(-1, -1), (0, -1), (1, -1), (-1, 0), (1, 0), (-1, 1), (0, 1), (1, 1)]


def settled(df: DataFrame) -> DataFrame:
    """A reliable checkpoint. A session on one machine (tests) without a folder gets a temporary one; on a cluster that is an error."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        folder = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if not folder and not re.fullmatch(r"local(\[.*\])?", context.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="spark-"))
    return df.checkpoint()


def _neighbours(offsets) -> F.Column:
    return F.explode(F.array(*(F.struct((F.col("x") + dx).alias("x"), (F.col("y") + dy).alias("y"), F.lit(i).alias("k")) for i, (dx, dy) in enumerate(offsets))))


#: Rows of a table that is broadcast at most; a larger one is joined by a shuffle.
MOST_BROADCAST = 1 << 19


def small(table: DataFrame) -> DataFrame:
    """A stored table for the small side of a join: broadcast behind a count of its rows."""
    return F.broadcast(table) if table.limit(MOST_BROADCAST + 1).count() <= MOST_BROADCAST else table


def components(mask: DataFrame, *, diagonal: bool = True, size: int = T.SIZE) -> DataFrame:
    """(image_id, x, y, label) of all foreground pixels; label is the least y * 2^32 + x of the component.

    Components are found within tiles by merging the runs of neighbouring rows. Pixels on a tile's border then meet those across it, and alternating large and small
    stars join the labels that touch, in a logarithmic number of rounds: what is shuffled there grows with the borders, not with the pixels."""
    image = mask.schema["image_id"].dataType.simpleString()
    rows = mask.select("image_id", F.col("x").cast("int").alias("x"), F.col("y").cast("int").alias("y"), T.tile_of(F.col("x"), size).alias("_tx"), T.tile_of(F.col("y"), size).alias("_ty"))

    def label(table: pa.Table) -> pa.Table:
        x0, y0 = table["_tx"][0].as_py() * size, table["_ty"][0].as_py() * size
        inside = np.zeros((size, size), bool)
        inside[table["y"].to_numpy() - y0, table["x"].to_numpy() - x0] = True
        row, first, last, root = T.labelled_runs(inside, diagonal)
        many = last - first + 1
        x = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many) + np.repeat(first, many) + x0
        names = ((row[root].astype(np.int64) + y0) << 32) + first[root] + x0
        return pa.table({"image_id": pa.repeat(table["image_id"][0], len(x)), "x": pa.array(x.astype(np.int32)), "y": pa.array(np.repeat(row + y0, many).astype(np.int32)), "label": pa.array(np.repeat(names, many))})

    named = settled(T.spread(rows, "image_id", "_tx", "_ty").groupBy("image_id", "_tx", "_ty").applyInArrow(label, f"image_id {image}, x int, y int, label long"))
    border = named.where(F.pmod("x", F.lit(size)).isin(0, size - 1) | F.pmod("y", F.lit(size)).isin(0, size - 1))
    side = range(-1, 2) if diagonal else (0,)
    none = F.array().cast("array<struct<dx:int,dy:int>>")
    steps = lambda c, offsets: F.when(F.pmod(c, F.lit(size)) == size - 1, F.array(*(F.struct(F.lit(dx).alias("dx"), F.lit(dy).alias("dy")) for dx, dy in offsets))).otherwise(none)
    over = F.concat(steps("x", [(1, d) for d in side]), steps("y", [(d, 1) for d in side]))
    asks = border.select("image_id", "x", "y", F.col("label").alias("v"), F.explode(over).alias("d")).select("image_id", (F.col("x") + F.col("d.dx")).alias("x"), (F.col("y") + F.col("d.dy")).alias("y"), "v")
    roots = settled(stars(border.join(asks, ["image_id", "x", "y"]).select("image_id", F.col("label").alias("u"), "v").distinct()))
    found = named.join(small(roots), (named["image_id"] == roots["r_image"]) & (named["label"] == roots["node"]), "left")
    return found.select("image_id", "x", "y", F.coalesce("root", "label").alias("label"))


def stars(links: DataFrame) -> DataFrame:
    """(r_image, node, root) of the graph (image_id, u, v): every node that has a link, with the least node of its component."""
    state = settled(links.select("image_id", F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct())
    before = None
    while True:
        mark = state.agg(F.count("*"), F.sum(F.xxhash64("image_id", "u", "v").cast("decimal(20,0)"))).first()
        if mark == before or mark[0] == 0:
            every = state.select("image_id", F.col("u").alias("node"), F.col("v").alias("root")).union(state.select("image_id", "v", "v").distinct())
            return every.withColumnRenamed("image_id", "r_image")
        before = mark
        both = state.union(state.select("image_id", F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("image_id", "u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.where("v > u").join(least, ["image_id", "u"]).select("image_id", F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        least = large.groupBy("image_id", "u").agg(F.min("v").alias("m"))
        pairs = large.join(least, ["image_id", "u"]).select("image_id", F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("e"))
        state = settled(pairs.select("image_id", "e.*").where("u <> v").distinct())


def image_sizes(pixels: DataFrame) -> DataFrame:
    """(image_id, _w, _h): the last column and row of each image."""
    return pixels.groupBy("image_id").agg(F.max("x").alias("_w"), F.max("y").alias("_h"))


def summarised(labelled: DataFrame, *, least: Column | int = 1, most: int | None = None, sizes: DataFrame | None = None, number: bool = False) -> DataFrame:
    """Per component: n pixels and bounds; of at least ``least`` pixels, and the first ``most`` of an image in raster order of their first pixel; with ``number`` also k, from 1 on.

    With the ``sizes`` of the images, components are found from inner pixels: one on the border alone is none, and the first inner pixel sets the order."""
    rows, inner = labelled, F.lit(True)
    if sizes is not None:
        rows, inner = labelled.join(sizes, "image_id"), (F.col("x") > 0) & (F.col("y") > 0) & (F.col("x") < F.col("_w")) & (F.col("y") < F.col("_h"))
    first = F.min(F.when(inner, F.struct("y", "x")))
    out = rows.groupBy("image_id", "label").agg(F.count("*").alias("n"), F.min("x").alias("min_x"), F.min("y").alias("min_y"), F.max("x").alias("max_x"), F.max("y").alias("max_y"), first.alias("_first")).where((F.col("n") >= least) & F.col("_first").isNotNull())
    if most is not None or number:
        out = out.withColumn("k", F.row_number().over(Window.partitionBy("image_id").orderBy("_first")))
    out = out if most is None else out.where(F.col("k") <= most)
    return out.drop("_first") if number else out.drop("_first", "k")


def chamfer(mask: DataFrame, *, straight: float = 1.0, diagonal: float = 1.414, columns: int = 64) -> DataFrame:
    """(image_id, x, y, d): steps of 1 and 1.414 from each foreground pixel to the next background pixel.

    Of the background pixels of a row the next one is nearest, from whatever row one looks. So distances within rows are found first, from the ends of runs, and then, in bands of
    ``columns`` columns, the least of what the rows above and below offer. Two shuffles, however far the distances; a task holds a row's runs, then a band of columns."""
    image = mask.schema["image_id"].dataType.simpleString()
    row = Window.partitionBy("image_id", "y").orderBy("x")
    runs = mask.select("image_id", F.col("x").cast("int").alias("x"), F.col("y").cast("int").alias("y")).distinct().withColumn("_run", F.col("x") - F.row_number().over(row))
    run = Window.partitionBy("image_id", "y", "_run")
    beside = F.least(F.col("x") - F.min("x").over(run), F.max("x").over(run) - F.col("x")) + 1
    rows = runs.select("image_id", "x", "y", beside.cast("int").alias("beside"), T.tile_of(F.col("x"), columns).alias("_tx"))

    def work(table: pa.Table) -> pa.Table:
        x, y = table["x"].to_numpy(), table["y"].to_numpy()
        x0, y0 = int(x.min()), int(y.min()) - 1
        near = np.zeros((int(y.max()) - y0 + 2, int(x.max()) - x0 + 1))
        near[y - y0, x - x0] = table["beside"].to_numpy()
        best, k = near * straight, 0
        while (k := k + 1) * straight < best.max():
            for a, b in ((np.s_[k:], np.s_[:-k]), (np.s_[:-k], np.s_[k:])):
                short, long = np.minimum(near[b], k), np.maximum(near[b], k)
                best[a] = np.minimum(best[a], diagonal * short + straight * (long - short))
        return pa.table({"image_id": table["image_id"], "x": table["x"], "y": table["y"], "d": pa.array(best[y - y0, x - x0].astype(np.float32))})

    return T.spread(rows, "image_id", "_tx").groupBy("image_id", "_tx").applyInArrow(work, f"image_id {image}, x int, y int, d float")


#: Iterations of thinning between two exchanges of margins.
THIN_AT_ONCE = 8


def thinned(mask: DataFrame, *, width: int, height: int, most: int = 60, size: int = T.SIZE) -> DataFrame:
    """The skeleton by Zhang and Suen's two sub-iterations on inner pixels, at most ``most`` times.

    An iteration looks two pixels far, so tiles with a margin do several before they exchange what is left; that goes on until nothing changes."""
    fore = settled(mask.select("image_id", F.col("x").cast("int").alias("x"), F.col("y").cast("int").alias("y")).distinct())
    left = fore.count()
    for done in range(0, most, THIN_AT_ONCE):
        times = min(THIN_AT_ONCE, most - done)
        kernel = lambda present, _, x0, y0, n=times: (T.thinning(present, x0, y0, width=width, height=height, times=n), {})
        fore = settled(T.on_tiles(fore, {}, kernel, margin=2 * times, size=size))
        before, left = left, fore.count()
        if left == before:
            break
    return fore
