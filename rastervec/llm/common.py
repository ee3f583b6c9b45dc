"""What the operators of this subpackage share: tables, scratch tables and text batches."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space of the word rules: space and the five controls from tab to carriage return.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Spark removes the shuffle files of a query at its end.
_CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared checkpoint folder. A session on one machine (tests) without such a setting gets a local folder; on a cluster that is an error."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        root = tempfile.mkdtemp(prefix="spark-scratch-")
        spark.conf.set("spark.checkpoint.dir", root)
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """Writes a table into the shared folder and reads it again: later stages start from files, not from lineage, and the shuffle files go at once."""
    spark = df.sparkSession
    path, before = scratch(spark, name), spark.conf.get(_CLEAN)
    spark.conf.set(_CLEAN, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(_CLEAN, before)
    out = spark.read.schema(df.schema).parquet(path)
    out._scratch = path
    return out


def discard(*tables: DataFrame) -> None:
    """Deletes tables of stored() when all that is made of them is stored itself."""
    for table in tables:
        spark = table.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(table._scratch)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


#: Bytes of a batch of rows on its way to Python and back; the pipeline's own, since an executor holds a batch several times outside its heap (vectors and a stream that double as they grow), and keeps what it once took.
BATCH_BYTES, SMALL_BATCH = 8 << 20, 1 << 20


def mapped(rows: DataFrame, function, schema, most: int = BATCH_BYTES) -> DataFrame:
    """mapInArrow() with batches of bounded bytes: ten thousand rows, Spark's own bound, of long texts or of blocks may be more than a worker should hold. The session keeps this setting."""
    rows.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(most))
    return rows.mapInArrow(function, schema)


def written_order() -> list[Column]:
    """Columns of a table that was read from Parquet files of one Spark write, to sort by: the writing task, then the place in its file."""
    return [F.regexp_extract("_metadata.file_name", r"part-(\d+)", 1).cast("int"), F.col("_metadata.file_name"), F.col("_metadata.row_index")]


def sized(table: DataFrame, most: int = 1 << 19) -> DataFrame:
    """A stored table of a few numbers a row, for the small side of a join: broadcast if it has at most ``most`` rows, else joined by a shuffle."""
    return F.broadcast(table) if table.limit(most + 1).count() <= most else table


def ident(col: str) -> Column:
    """A column by its exact name, dots and all."""
    return F.col("`" + col.replace("`", "``") + "`")


def texts_of(batch: pa.RecordBatch, name: str) -> pa.Array:
    """A text column without nulls (null: empty) whose offsets start at zero."""
    col = batch.column(batch.schema.get_field_index(name))
    if not pa.types.is_large_string(col.type):
        col = col.cast(pa.large_string())
    col = col.fill_null("") if col.null_count else col
    return pa.concat_arrays([col]) if col.offset else col


def bytes_of(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a large_string array that texts_of() made, and its offsets."""
    _, offsets, data = col.buffers()
    at = np.frombuffer(offsets, dtype=np.int64, count=len(col) + 1 + col.offset)[col.offset :]
    raw = np.frombuffer(data, dtype=np.uint8)[at[0] : at[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw, at - at[0]


def slices(batches: Iterator[pa.RecordBatch], text: str, most_bytes: int, most_rows: int = 4096) -> Iterator[pa.RecordBatch]:
    """Cuts batches so that each holds about most_bytes of text; a longer text stands alone, whole."""
    for batch in batches:
        lengths = np.diff(bytes_of(texts_of(batch, text))[1])
        at, total = 0, 0
        for i, n in enumerate(lengths):
            if i > at and (total + n > most_bytes or i - at >= most_rows):
                yield batch.slice(at, i - at)
                at, total = i, 0
            total += n
        if at < batch.num_rows:
            yield batch.slice(at)
        pa.default_memory_pool().release_unused()


def crc_of_id(col: Column | str) -> Column:
    """crc32 of an id written as text; null ids count as the empty text."""
    col = F.col(col) if isinstance(col, str) else col
    return F.crc32(F.coalesce(col.cast("string"), F.lit("")).cast("binary"))
