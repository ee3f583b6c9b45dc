"""Images as files, and projects as JSON documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rastervec.schema import FEATURE


def read_images(spark: SparkSession, path: str, *, glob: str = "*") -> DataFrame:
    """(image_id, content) of all files below a folder; nothing is decoded."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(path)
    return files.select(F.col("path").alias("image_id"), "content")


def watch_images(spark: SparkSession, path: str, *, glob: str = "*") -> DataFrame:
    """The same as a stream of new files."""
    stream = spark.readStream.format("binaryFile").option("pathGlobFilter", glob).load(path)
    return stream.select(F.col("path").alias("image_id"), "content")


def save_project(features: DataFrame, path: str) -> None:
    features.write.mode("overwrite").json(path)


def load_project(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(FEATURE).json(path)
