"""Checksums whose order matters, over the pixels of an image.

A step of FNV-1a, (state ^ byte) * FACTOR, changes the low eight bits of a state by themselves and moves the others in proportion. So what a piece does to any state is known
from what it does to the 256 states below 256: pieces are folded by many tasks, and then one after another in order.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rastervec.operators import tiles as T

#: Start and factor of FNV-1a with 32 bits.
START, FACTOR = 2166136261, 16777619
#: Rows of an image that are sorted and folded together, and bytes that are folded side by side with others.
ROWS, STRIDE = 64, 512


def folded(data: bytes, state: int = START) -> int:
    for byte in data:
        state = (state ^ byte) * FACTOR & 0xFFFFFFFF
    return state


def _then(state: np.ndarray, after: np.ndarray, factor: int) -> np.ndarray:
    """States (32 bits) after a piece, from where it takes the states below 256 and FACTOR to the power of its bytes."""
    low = state & np.uint32(255)
    return (state - low) * np.uint32(factor) + after[low]


def effect(data: np.ndarray) -> np.ndarray:
    """Where bytes take each of the 256 states below 256. Strides of them are folded side by side."""
    whole, out = len(data) // STRIDE, np.arange(256, dtype=np.uint32)
    strides = [data[: whole * STRIDE].reshape(whole, STRIDE), data[None, whole * STRIDE :]]
    for block in strides:
        for lo in range(0, len(block), 64):
            part = block[lo : lo + 64].astype(np.uint32)
            states = np.tile(np.arange(256, dtype=np.uint32), (len(part), 1))
            for k in range(part.shape[1]):
                states ^= part[:, k, None]
                states *= np.uint32(FACTOR)
            factor = pow(FACTOR, part.shape[1], 1 << 32)
            for after in states:
                out = _then(out, after, factor)
    return out


def checksums(planes: DataFrame, *columns: str) -> DataFrame:
    """(image_id, n, checksum): FNV-1a over the bytes ``columns`` of all pixels in raster order, and how many pixels there are; nulls count as 0.

    Bands of ROWS rows are sorted and folded by tasks of their own, whatever the size of an image; a kilobyte for each batch of a band then meets the others of its image, in order.
    Images are spread over tasks. An empty table gives no row."""
    image = planes.schema["image_id"].dataType.simpleString()
    rows = planes.select("image_id", T.tile_of(F.col("y"), ROWS).alias("_band"), *(F.coalesce(F.col(c), F.lit(0)).cast("int").alias(f"_{k}") for k, c in enumerate(columns)), "y", "x")
    rows = T.spread(rows, "image_id", "_band").sortWithinPartitions("image_id", "_band", "y", "x").drop("y", "x")
    width = len(columns)

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k = 0
        for batch in batches:
            if not len(batch):
                continue
            ids, bands = batch.column(0), batch.column(1)
            data = np.stack([c.to_numpy() for c in batch.columns[2:]], 1).astype(np.uint8)
            apart = [c[1:].to_numpy(zero_copy_only=False) != c[:-1].to_numpy(zero_copy_only=False) for c in (ids, bands)]
            cuts = [0, *(np.flatnonzero(apart[0] | apart[1]) + 1).tolist(), len(ids)]
            for a, b in zip(cuts, cuts[1:]):
                own = [ids.slice(a, 1), bands.slice(a, 1), pa.array([k], pa.int64()), pa.array([b - a], pa.int64()), pa.array([effect(data[a:b].ravel()).tobytes()], pa.binary())]
                yield pa.RecordBatch.from_arrays(own, names=["image_id", "_band", "_k", "n", "effect"])
                k += 1

    def joined(table: pa.Table) -> pa.Table:
        table = table.sort_by([("_band", "ascending"), ("_k", "ascending")])
        state = np.array([START], np.uint32)
        for n, after in zip(table["n"].to_pylist(), table["effect"].to_pylist()):
            state = _then(state, np.frombuffer(after, np.uint32), pow(FACTOR, n * width, 1 << 32))
        return pa.table({"image_id": table["image_id"][:1], "n": pa.array([sum(table["n"].to_pylist())], pa.int64()), "checksum": pa.array(state.astype(np.int64))})

    parts = rows.mapInArrow(fold, f"image_id {image}, _band int, _k long, n long, effect binary")
    return parts.groupBy("image_id").applyInArrow(joined, f"image_id {image}, n long, checksum long")
