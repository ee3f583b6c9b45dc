"""Views of the test tables as pixels, polygons, polylines, features and control points."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

LAYER_OF_LABEL = ("BUILDINGS", "ROADS", "PARCELS", "TREES", "WATER", "WALLS", "FENCES", "PARKING", "SURVEY", "OTHER")
WIDTH = 100


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(image_id, x, y, r, g, b): one image of width 100 from the events."""
    e = table(spark, sf_dir, "events")
    byte = lambda c: F.pmod(c, F.lit(256)).cast("int")
    return e.select(
        F.lit(0).alias("image_id"), (F.col("event_id") % WIDTH).cast("int").alias("x"), F.expr(f"int(event_id div {WIDTH})").alias("y"),
        byte(F.floor(F.col("value") * 7)).alias("r"), byte(F.col("event_id") * 37 + F.col("user_id") * 11).alias("g"), byte(F.col("event_id") * 101 + F.col("user_id") * 29).alias("b"),
    )


def polygons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, layer, points): 32 points from each embedding, in thousandths."""
    e = table(spark, sf_dir, "embeddings")
    at = lambda i: F.get("embedding", i).cast("double") * 1000
    points = F.transform(F.sequence(F.lit(0), F.lit(31)), lambda i: F.struct(at(2 * i).alias("x"), at(2 * i + 1).alias("y")))
    return e.select(F.col("vec_id").alias("id"), F.element_at(F.array(*map(F.lit, LAYER_OF_LABEL)), F.pmod("label", F.lit(10)).cast("int") + 1).alias("layer"), points.alias("points"))


def polylines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, points): the lines of an order as points, in a fixed order."""
    line = table(spark, sf_dir, "lineitem")
    order = ("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice")
    rows = line.select("l_orderkey", F.struct(*(F.col(c) for c in order)).alias("p"))
    points = F.transform(F.sort_array(F.collect_list("p")), lambda p: F.struct(p["l_quantity"].cast("double").alias("x"), (p["l_extendedprice"].cast("double") / 1000).alias("y")))
    return rows.groupBy(F.col("l_orderkey").alias("id")).agg(points.alias("points"))


def plots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, points): a turned rectangle for each customer."""
    key = F.col("c_custkey")
    x, w, h, t = 500 + key % 7, 20 + key % 30, 10 + key % 17, F.radians(5 + key % 80)
    corner = lambda u, v: F.struct((x + u * F.cos(t) - v * F.sin(t)).cast("double").alias("x"), (F.lit(300) + u * F.sin(t) + v * F.cos(t)).cast("double").alias("y"))
    return table(spark, sf_dir, "customer").select(key.alias("id"), F.array(corner(F.lit(0), F.lit(0)), corner(w, F.lit(0)), corner(w, h), corner(F.lit(0), h)).alias("points"))


LAYER_OF_PRIORITY = {"1-URGENT": "BUILDINGS", "2-HIGH": "PARCELS", "3-MEDIUM": "ROADS", "4-NOT SPECIFIED": "WATER", "5-LOW": "SURVEY"}


def features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, seq, layer, is_closed, geometry_type, confidence, points): orders with their polyline; orders without lines have none."""
    o = table(spark, sf_dir, "orders")
    layer = F.element_at(F.create_map(*(F.lit(x) for kv in LAYER_OF_PRIORITY.items() for x in kv)), F.col("o_orderpriority"))
    rows = o.select(F.col("o_orderkey").alias("id"), F.coalesce(layer, F.lit("OTHER")).alias("layer"), (F.col("o_orderstatus") == "F").alias("is_closed"))
    rows = rows.join(polylines(spark, sf_dir), "id")
    kind = F.when(F.size("points") == 1, "POINT").when(F.size("points") == 2, "LINE").otherwise("LWPOLYLINE")
    return rows.select("id", F.col("id").alias("seq"), "layer", "is_closed", kind.alias("geometry_type"), (F.lit(80.0) + F.pmod("id", F.lit(20))).alias("confidence"), "points")


def control_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, pixel_x, pixel_y, world_x, world_y) from the suppliers: an affine map with a little noise."""
    s = table(spark, sf_dir, "supplier")
    px, py = F.col("s_suppkey").cast("double"), (F.col("s_nationkey") * F.col("s_nationkey") % 97).cast("double")
    noise = F.col("s_acctbal").cast("double") / 100000
    return s.select(F.col("s_suppkey").alias("id"), px.alias("pixel_x"), py.alias("pixel_y"), (px * 0.5 + py * 0.25 + 100 + noise).alias("world_x"), (px * -0.25 + py * 0.75 + 50 - noise).alias("world_y"))


def striped_roof(spark: SparkSession) -> DataFrame:
    """(image_id, x, y, r, g, b, a): a 48 x 32 image with a light stripe, by formula."""
    x, y = F.col("id") % 48, F.expr("id div 48")
    v = F.when(x.between(13, 20) & y.between(5, 26), 235).otherwise(35 + (7 * x + 3 * y + 11 * ((x + y) % 5)) % 40)
    rows = spark.range(1536).select(F.lit(0).alias("image_id"), x.cast("int").alias("x"), y.cast("int").alias("y"), v.cast("int").alias("v"))
    return rows.select("image_id", "x", "y", F.col("v").alias("r"), F.least(F.lit(255), F.col("v") + 8).alias("g"), F.greatest(F.lit(0), F.col("v") - 5).alias("b"), F.lit(255).alias("a"))
