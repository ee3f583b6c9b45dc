"""Named queries over the test tables, each with SQL that gives the same rows where SQL can."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rastervec.functions import geometry as G
from rastervec.functions import regularise as R
from rastervec.functions import spectral
from rastervec.functions.numeric import to_fixed
from rastervec.functions.simplify import simplified
from rastervec.operators import checksums as Q
from rastervec.operators import components as C
from rastervec.operators import documents as D
from rastervec.operators import editing as E
from rastervec.operators import export as X
from rastervec.operators import features as O
from rastervec.operators import outlines as L
from rastervec.operators import pixels as P
from rastervec.operators import vectorise as V
from rastervec.operators import watershed as W
from rastervec.operators import workflow as K
from rastervec.schema import LAYERS, layers
from rastervec.sources import adapters as A
from rastervec.sources import scenes as S

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a function of (spark, sf_dir) under its name, and SQL with the same rows."""

    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return register


# ---- views in SQL ----

_PX = """WITH px0 AS (SELECT (event_id % 100)::INT AS x, (event_id // 100)::INT AS y, (((floor(value * 7)::BIGINT % 256) + 256) % 256)::INT AS r, ((event_id * 37 + user_id * 11) % 256)::INT AS g, ((event_id * 101 + user_id * 29) % 256)::INT AS b FROM events),
px AS (SELECT *, r * 0.299::DOUBLE + g * 0.587::DOUBLE + b * 0.114::DOUBLE AS lum, CASE WHEN greatest(r, g, b) = 0 THEN 0::DOUBLE ELSE (greatest(r, g, b) - least(r, g, b))::DOUBLE / greatest(r, g, b) END AS sat FROM px0),
gp AS (SELECT x, y, floor(lum + 0.5::DOUBLE)::INT AS gray FROM px)"""
_PG = f"""WITH pg AS (SELECT vec_id AS id, {list(A.LAYER_OF_LABEL)!r}[label % 10 + 1] AS layer, list_transform(range(0, 32), lambda i: {{'x': embedding[2 * i + 1]::DOUBLE * 1000, 'y': embedding[2 * i + 2]::DOUBLE * 1000}}) AS p FROM embeddings)"""
_FT = """WITH pl AS (SELECT l_orderkey AS id, list({'x': l_quantity::DOUBLE, 'y': l_extendedprice::DOUBLE / 1000} ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) AS p FROM lineitem GROUP BY l_orderkey),
ft AS (SELECT id, id AS seq, CASE o_orderpriority WHEN '1-URGENT' THEN 'BUILDINGS' WHEN '2-HIGH' THEN 'PARCELS' WHEN '3-MEDIUM' THEN 'ROADS' WHEN '4-NOT SPECIFIED' THEN 'WATER' WHEN '5-LOW' THEN 'SURVEY' ELSE 'OTHER' END AS layer, o_orderstatus = 'F' AS closed,
  CASE len(p) WHEN 1 THEN 'POINT' WHEN 2 THEN 'LINE' ELSE 'LWPOLYLINE' END AS kind, 80::DOUBLE + id % 20 AS confidence, p FROM orders JOIN pl ON o_orderkey = id),
edges AS (SELECT id, i, p[i] AS a, p[i + 1] AS b FROM (SELECT id, p, unnest(range(1, len(p))) AS i FROM ft)),
ly(name, color, aci, lineweight, linetype) AS (VALUES """ + ", ".join(f"('{n}', '{c}', {a}, {w}::DOUBLE, '{t}')" for n, c, a, w, t in LAYERS) + ")"
_AREA = "coalesce(abs(list_sum(list_transform(range(1, len(p) + 1), lambda i: p[i].x * p[i % len(p) + 1].y - p[i % len(p) + 1].x * p[i].y))) / 2, 0)"
_CLASS = """CASE WHEN {w} AND NOT dim AND b > r + 15 AND b > g - 12 AND lum < 140 THEN 4 WHEN {t} AND NOT dim AND (2 * g - r - b > 12 OR (g > r + 12 AND g > b + 12 AND sat > 0.15::DOUBLE)) THEN 3 WHEN NOT dim AND sat < 0.12::DOUBLE AND lum > 42 AND lum < 160 THEN 2
 WHEN (r > 115 AND r > g + 22 AND r > b + 22) OR (lum > 165 AND sat < 0.25::DOUBLE) OR (lum > 25 AND lum < 48 AND sat < 0.18::DOUBLE AND NOT dim) OR (sat < 0.15::DOUBLE AND lum > 80 AND lum < 155 AND abs(r - b) < 12) THEN 1 WHEN g > b AND g > r AND sat > 0.08::DOUBLE THEN 5 ELSE 0 END"""
_FIX = "CASE WHEN {v} * 8 = floor({v} * 8) THEN printf('%.2f', {v} + sign({v}) * 0.001::DOUBLE) ELSE printf('%.2f', {v}) END"


def _fix(v: str, digits: int) -> str:
    """Text with so many digits, ties away from zero: a nudge takes exact ties over."""
    tie = 2 ** (digits + 1)
    return f"CASE WHEN ({v}) * {tie} = floor(({v}) * {tie}) THEN printf('%.{digits}f', ({v}) + sign({v}) * {10.0 ** -(digits + 1):.{digits + 1}f}::DOUBLE) ELSE printf('%.{digits}f', {v}) END"


# ---- pixels ----


@query(f"{_PX} SELECT (floor(lum / 16))::BIGINT AS bin, count(*)::BIGINT AS n FROM px GROUP BY 1")
def luminance_hist(spark, sf):
    return A.pixels(spark, sf).groupBy(F.floor(spectral.luminance() / 16).alias("bin")).agg(F.count("*").alias("n"))


@query(f"{_PX} SELECT y, round(avg(sat), 6) AS mean_saturation, round(max(sat), 6) AS max_saturation FROM px GROUP BY y")
def saturation_stats(spark, sf):
    return A.pixels(spark, sf).groupBy("y").agg(F.round(F.avg(spectral.saturation()), 6).alias("mean_saturation"), F.round(F.max(spectral.saturation()), 6).alias("max_saturation"))


@query(f"{_PX} SELECT y, sum(2 * g - r - b)::BIGINT AS excess FROM px GROUP BY y")
def excess_green(spark, sf):
    return A.pixels(spark, sf).groupBy("y").agg(F.sum(spectral.excess_green()).alias("excess"))


@query(f"{_PX} SELECT x, y FROM px WHERE lum < 45 AND b > r + 8")
def shadow_mask(spark, sf):
    return A.pixels(spark, sf).where(spectral.shadow()).select("x", "y")


@query(f"{_PX} SELECT x, y, floor(lum + 0.5::DOUBLE)::INT AS gray, floor(255 - lum + 0.5::DOUBLE)::INT AS inverted FROM px")
def gray_plane(spark, sf):
    return A.pixels(spark, sf).select("x", "y", spectral.gray().alias("gray"), spectral.gray(True).alias("inverted"))


def _classes(**gates):
    w, t = str(gates.get("water", True)).upper(), str(gates.get("trees", True)).upper()
    return f"{_PX} SELECT x, y, {_CLASS.format(w=w, t=t)} AS class FROM (SELECT *, lum < 45 AND b > r + 8 AS dim FROM px)"


@query(_classes())
def classify_pixels(spark, sf):
    return A.pixels(spark, sf).select("x", "y", spectral.surface().alias("class"))


@query(_classes(water=False))
def classify_no_water(spark, sf):
    return A.pixels(spark, sf).select("x", "y", spectral.surface(water=False).alias("class"))


@query(_classes(trees=False))
def classify_no_tree(spark, sf):
    return A.pixels(spark, sf).select("x", "y", spectral.surface(trees=False).alias("class"))


_EDGES = """here AS (SELECT a.x, a.y, (b.r + b.g + b.b) / 3::DOUBLE - (a.r + a.g + a.b) / 3::DOUBLE AS gx, (c.r + c.g + c.b) / 3::DOUBLE - (a.r + a.g + a.b) / 3::DOUBLE AS gy FROM px a JOIN px b ON b.x = a.x + 1 AND b.y = a.y JOIN px c ON c.x = a.x AND c.y = a.y + 1 WHERE a.x % 4 = 1 AND a.y % 4 = 1),
es AS (SELECT count(*) FILTER (abs(gx) + abs(gy) > 35)::BIGINT AS edges, count(*) FILTER (abs(gx) + abs(gy) > 35 AND (abs(gx) < 6 OR abs(gy) < 6))::BIGINT AS upright, (SELECT count(*) FROM px) AS n FROM here),
ed AS (SELECT edges, least(1, edges * 16 / (n * 0.4::DOUBLE)) AS density, CASE WHEN edges > 0 THEN upright / edges ELSE 0 END AS orthogonal FROM es)"""


@query(f"{_PX}, {_EDGES} SELECT edges, round(density, 6) AS density, round(orthogonal, 6) AS orthogonal FROM ed")
def edge_orientation(spark, sf):
    return P.edge_statistics(A.pixels(spark, sf)).select("edges", F.round("density", 6).alias("density"), F.round("orthogonal", 6).alias("orthogonal"))


@query(f"""{_PX}, {_EDGES}, s AS (SELECT count(*) AS n_pixels, avg(sat) AS mean_saturation, avg((b > 100 AND b > r + 30 AND b > g + 20 AND lum < 140)::INT) AS blueprint, avg(((lum < 40 OR lum > 220) AND sat < 0.15::DOUBLE)::INT) AS bw,
 avg((g > r + 15 AND g > b + 15 AND sat > 0.2::DOUBLE)::INT) AS veg, avg((sat < 0.12::DOUBLE AND lum > 40 AND lum < 160)::INT) AS asphalt, avg((r > 130 AND r > g + 25 AND r > b + 25)::INT) AS roof FROM px),
k AS (SELECT *, CASE WHEN blueprint > 0.35 THEN 'CAD_SCAN_BLUEPRINT' WHEN bw > 0.65 AND mean_saturation < 0.08 THEN CASE WHEN orthogonal > 0.45 THEN 'ARCHITECTURAL_DRAWING' ELSE 'BLACK_WHITE_LINE' END WHEN veg > 0.08 OR roof > 0.03 OR asphalt > 0.15 THEN CASE WHEN density > 0.35 AND (roof > 0.02 OR asphalt > 0.1) THEN 'AERIAL_DRONE' ELSE 'SATELLITE' END WHEN mean_saturation > 0.25 AND orthogonal > 0.3 THEN 'URBAN_CADASTRAL' ELSE 'GENERAL_IMAGE' END AS kind FROM s, ed)
SELECT n_pixels, round(mean_saturation, 6) AS mean_saturation, round(blueprint, 6) AS blueprint, round(bw, 6) AS black_white, round(veg, 6) AS vegetation, round(asphalt, 6) AS asphalt, round(roof, 6) AS roof, kind FROM k""")
def image_analysis(spark, sf):
    return P.image_analysis(A.pixels(spark, sf)).select("n_pixels", *(F.round(c, 6).alias(c) for c in ("mean_saturation", "blueprint", "black_white", "vegetation", "asphalt", "roof")), "kind")


@query(f"{_PX}, steps AS (SELECT x, lum, abs(lum - lag(lum) OVER (ORDER BY y, x)) AS step FROM px) SELECT round(avg(lum), 6) AS mean_luma, round(least(1, sum(step) / (count(*) * 255)), 6) AS edge, max(x) + 1 AS width, count(*) / 1e6::DOUBLE AS megapixels FROM steps")
def native_luma_stats(spark, sf):
    return P.luma_stats(A.pixels(spark, sf)).select(F.round("mean_luma", 6).alias("mean_luma"), F.round("edge", 6).alias("edge"), "width", "megapixels")


def _gray(spark, sf):
    return A.pixels(spark, sf).select("image_id", "x", "y", spectral.gray().alias("gray"))


@query(f"{_PX}, rows AS (SELECT x, y, sum(gray) OVER w AS s, sum(gray * gray) OVER w AS q FROM gp WINDOW w AS (PARTITION BY y ORDER BY x)) SELECT x, y, (sum(s) OVER w)::BIGINT AS total, (sum(q) OVER w)::BIGINT AS total_squares FROM rows WINDOW w AS (PARTITION BY x ORDER BY y)")
def integral_image(spark, sf):
    return P.integral_image(_gray(spark, sf), "gray").select("x", "y", "total", "total_squares")


def _box(r):
    return f"boxes0 AS (SELECT x, y, gray, count(*) OVER w AS n, sum(gray) OVER w AS s, sum(gray * gray) OVER w AS q FROM gp WINDOW w AS (PARTITION BY y ORDER BY x ROWS BETWEEN {r} PRECEDING AND {r} FOLLOWING)), boxes AS (SELECT x, y, gray, sum(n) OVER w AS n, sum(s) OVER w AS s, sum(q) OVER w AS q FROM boxes0 WINDOW w AS (PARTITION BY x ORDER BY y ROWS BETWEEN {r} PRECEDING AND {r} FOLLOWING))"


@query(f"{_PX}, {_box(2)} SELECT x, y, n::BIGINT AS n, s::BIGINT AS total, q::BIGINT AS total_squares FROM boxes")
def box_sum_5x5(spark, sf):
    return P.box_sums(_gray(spark, sf), "gray", 2).select("x", "y", "n", "total", "total_squares")


@query(f"{_PX}, {_box(14)} SELECT x, y, (gray < m * (1 + 0.22::DOUBLE * (sqrt(greatest(0, q::DOUBLE / n::DOUBLE - m * m)) / 128 - 1)))::INT AS bit FROM (SELECT *, s::DOUBLE / n::DOUBLE AS m FROM boxes)")
def sauvola(spark, sf):
    return P.sauvola(_gray(spark, sf), radius=14, k=0.22).select("x", "y", "bit")


_FOLD = "list_reduce(list_prepend(2166136261, list({v} ORDER BY y, x)), lambda h, b: (xor(h, b) * 16777619) & 4294967295)"


@query(f"""{_PX}, {_box(14)}, bits AS (SELECT x, y, (gray < m * (1 + 0.22::DOUBLE * (sqrt(greatest(0, q::DOUBLE / n::DOUBLE - m * m)) / 128 - 1)))::BIGINT AS bit FROM (SELECT *, s::DOUBLE / n::DOUBLE AS m FROM boxes)),
bytes AS (SELECT y, x * 4 + c AS x, v FROM (SELECT x, y, unnest([0, 1, 2, 3]) AS c, unnest([r, g, b, 255])::BIGINT AS v FROM px))
SELECT (SELECT count(*) FROM px) AS n, (SELECT {_FOLD.format(v='v')}::BIGINT FROM bytes) AS colours, (SELECT sum(bit)::BIGINT FROM bits) AS foreground, (SELECT {_FOLD.format(v='bit')}::BIGINT FROM bits) AS bits""")
def filter_checksums(spark, sf):
    colours = Q.checksums(A.pixels(spark, sf).withColumn("a", F.lit(255)), "r", "g", "b", "a").withColumnRenamed("checksum", "colours")
    bits = P.sauvola(_gray(spark, sf), radius=14, k=0.22)
    found = Q.checksums(bits, "bit").select("image_id", F.col("checksum").alias("bits")).join(bits.groupBy("image_id").agg(F.sum("bit").alias("foreground")), "image_id")
    return colours.join(found, "image_id").select("n", "colours", "foreground", "bits")


_MASK = "mask AS (SELECT x, y, (gray >= 128)::INT AS bit FROM gp)"


def _cross(name, source, f):
    return f"{name} AS (SELECT x, y, coalesce({f}(bit + 0 * (l + r + u + d), l, r, u, d), 0) * (CASE WHEN l IS NULL OR r IS NULL OR u IS NULL OR d IS NULL THEN 0 ELSE 1 END) AS bit FROM (SELECT *, lag(bit) OVER h AS l, lead(bit) OVER h AS r, lag(bit) OVER v AS u, lead(bit) OVER v AS d FROM {source} WINDOW h AS (PARTITION BY y ORDER BY x), v AS (PARTITION BY x ORDER BY y)))"


def _mask(spark, sf):
    return _gray(spark, sf).select("image_id", "x", "y", (F.col("gray") >= 128).cast("int").alias("bit"))


@query(f"{_PX}, {_MASK}, {_cross('m1', 'mask', 'greatest')} SELECT x, y, bit FROM m1")
def dilate(spark, sf):
    return P.dilated(_mask(spark, sf)).select("x", "y", "bit")


@query(f"{_PX}, {_MASK}, {_cross('m1', 'mask', 'least')} SELECT x, y, bit FROM m1")
def erode(spark, sf):
    return P.eroded(_mask(spark, sf)).select("x", "y", "bit")


@query(f"{_PX}, {_MASK}, {_cross('m1', 'mask', 'greatest')}, {_cross('m2', 'm1', 'least')} SELECT x, y, bit FROM m2")
def morph_close(spark, sf):
    return P.closed(_mask(spark, sf)).select("x", "y", "bit")


@query(f"""{_PX}, s0 AS (SELECT x, y, lum, lag(lum) OVER h AS l, lead(lum) OVER h AS r FROM px WINDOW h AS (PARTITION BY y ORDER BY x)),
s1 AS (SELECT x, y, (lead(r) OVER v + lag(r) OVER v + 2 * r) - (lag(l) OVER v + 2 * l + lead(l) OVER v) AS gx, (lead(l) OVER v + 2 * lead(lum) OVER v + lead(r) OVER v) - (lag(l) OVER v + 2 * lag(lum) OVER v + lag(r) OVER v) AS gy FROM s0 WINDOW v AS (PARTITION BY x ORDER BY y))
SELECT x, y, round(coalesce(sqrt(gx * gx + gy * gy), 0)::FLOAT::DOUBLE, 2) AS gradient FROM s1""")
def sobel(spark, sf):
    return P.sobel(A.pixels(spark, sf)).select("x", "y", F.round(F.col("gradient").cast("double"), 2).alias("gradient"))


@query(f"""{_PX}, h AS (SELECT *, max(gray) OVER (PARTITION BY y ORDER BY x ROWS BETWEEN 4 PRECEDING AND 4 FOLLOWING) AS m0 FROM gp), v AS (SELECT *, max(m0) OVER (PARTITION BY x ORDER BY y ROWS BETWEEN 4 PRECEDING AND 4 FOLLOWING) AS m FROM h), z AS (SELECT max(gray) AS top, max(x) AS w, max(y) AS h FROM gp)
SELECT x, y, gray FROM v, z WHERE x >= 4 AND y >= 4 AND x % 2 = 0 AND y % 2 = 0 AND x <= w - 4 AND y <= z.h - 4 AND gray >= greatest(3, top * 0.35::DOUBLE) AND m <= gray""")
def peak_pixels(spark, sf):
    return P.peaks(_gray(spark, sf), "gray").select("x", "y", "gray")


@query(f"""{_PX}, w AS (SELECT a.x, a.y, b.r, b.g, b.b, exp(-((b.x - a.x) ** 2 + (b.y - a.y) ** 2) / 8::DOUBLE) * exp(-((b.lum - a.lum) ** 2) / 968::DOUBLE) AS w
  FROM px a JOIN (SELECT *, unnest(range(-2, 3)) AS dy FROM px) b ON b.y = a.y + b.dy AND b.x BETWEEN a.x - 2 AND a.x + 2)
SELECT x, y, floor(sum(w * r) / sum(w) + 0.5::DOUBLE)::INT AS r, floor(sum(w * g) / sum(w) + 0.5::DOUBLE)::INT AS g, floor(sum(w * b) / sum(w) + 0.5::DOUBLE)::INT AS b FROM w GROUP BY x, y""")
def bilateral_smooth(spark, sf):
    return P.bilateral(A.pixels(spark, sf), radius=2, sigma=22.0).select("x", "y", "r", "g", "b")


# ---- iterative operators on masks: rows only, tests hold them against plain versions ----


def _green(spark, sf):
    return A.pixels(spark, sf).where(spectral.surface() == 3).select("image_id", "x", "y")


_PARTS = f"""{_PX.replace('WITH px0', 'WITH RECURSIVE px0')}, fore AS (SELECT y::BIGINT * 4294967296 + x AS pos, x, y FROM (SELECT *, lum < 45 AND b > r + 8 AS dim FROM px) WHERE {_CLASS.format(w='true', t='true')} = 3),
near AS (SELECT a.pos, b.pos AS other FROM fore a JOIN fore b ON b.y BETWEEN a.y - 1 AND a.y + 1 AND b.x BETWEEN a.x - 1 AND a.x + 1 AND b.pos <> a.pos),
named(pos, label) USING KEY (pos) AS (SELECT pos, pos AS label FROM fore
  UNION (SELECT n.pos, min(r.label) AS label FROM named r JOIN near n ON n.other = r.pos JOIN recurring.named o ON o.pos = n.pos WHERE r.label < o.label GROUP BY n.pos)),
sizes AS (SELECT max(x) AS mx, max(y) AS my FROM px),
parts AS (SELECT 0 AS image_id, label, count(*)::BIGINT AS n, min(x) AS min_x, min(y) AS min_y, max(x) AS max_x, max(y) AS max_y, min(pos) FILTER (x > 0 AND y > 0 AND x < mx AND y < my) AS first FROM named JOIN fore USING (pos), sizes GROUP BY label HAVING first IS NOT NULL)"""


@query(f"{_PARTS} SELECT * EXCLUDE (first) FROM parts")
def component_bbox(spark, sf):
    return C.summarised(C.components(_green(spark, sf)), sizes=C.image_sizes(A.pixels(spark, sf)))


@query(f"{_PARTS} SELECT * EXCLUDE (first) FROM parts WHERE n >= 15 ORDER BY first LIMIT 400")
def component_filter(spark, sf):
    return C.summarised(C.components(_green(spark, sf)), least=15, most=400, sizes=C.image_sizes(A.pixels(spark, sf)))


_FORE = f"""{_PX.replace('WITH px0', 'WITH RECURSIVE px0')}, fore AS (SELECT y::BIGINT * 4294967296 + x AS pos, x, y FROM (SELECT *, lum < 45 AND b > r + 8 AS dim FROM px) WHERE {_CLASS.format(w='true', t='true')} = 3),
steps(k, dx, dy) AS (VALUES (0, 0, -1), (1, 1, -1), (2, 1, 0), (3, 1, 1), (4, 0, 1), (5, -1, 1), (6, -1, 0), (7, -1, -1))"""


@query(f"""{_FORE}, around AS (SELECT f.pos, g.pos AS other, CASE WHEN dx <> 0 AND dy <> 0 THEN 1.414::DOUBLE ELSE 1 END AS c FROM fore f CROSS JOIN steps LEFT JOIN fore g ON g.x = f.x + dx AND g.y = f.y + dy),
near AS (SELECT pos, other, c FROM around WHERE other IS NOT NULL),
dist(pos, d) USING KEY (pos) AS (SELECT pos, min(c) AS d FROM around WHERE other IS NULL GROUP BY pos
  UNION (SELECT n.pos, min(r.d + n.c) AS d FROM dist r JOIN near n ON n.other = r.pos LEFT JOIN recurring.dist o ON o.pos = n.pos WHERE o.d IS NULL OR r.d + n.c < o.d - 1e-9::DOUBLE GROUP BY n.pos))
SELECT x, y, round(d, 3) AS d FROM dist JOIN fore USING (pos)""")
def distance_transform(spark, sf):
    return C.chamfer(_green(spark, sf)).select("x", "y", F.round(F.col("d").cast("double"), 3).alias("d"))


@query(f"""{_FORE}, sizes AS (SELECT max(x) AS mx, max(y) AS my FROM px),
thin(round, x, y) AS (SELECT 0, x, y FROM fore UNION ALL
  SELECT round + 1, x, y FROM (SELECT t.round, t.x, t.y, coalesce(list(s.k) FILTER (u.x IS NOT NULL), []) AS b FROM thin t CROSS JOIN steps s LEFT JOIN thin u ON u.x = t.x + s.dx AND u.y = t.y + s.dy GROUP BY t.round, t.x, t.y), sizes
  WHERE round < 120 AND NOT (x > 0 AND y > 0 AND x < mx AND y < my AND len(b) BETWEEN 2 AND 6 AND len(list_filter(b, lambda k: NOT list_contains(b, (k + 7) % 8))) = 1
    AND NOT CASE WHEN round % 2 = 0 THEN (list_contains(b, 0) AND list_contains(b, 2) AND list_contains(b, 4)) OR (list_contains(b, 2) AND list_contains(b, 4) AND list_contains(b, 6))
      ELSE (list_contains(b, 0) AND list_contains(b, 2) AND list_contains(b, 6)) OR (list_contains(b, 0) AND list_contains(b, 4) AND list_contains(b, 6)) END))
SELECT x, y FROM thin WHERE round = 120""")
def thinning(spark, sf):
    rows = A.pixels(spark, sf).agg(F.max("y")).first()
    return C.thinned(_green(spark, sf), width=A.WIDTH, height=rows[0] + 1).select("x", "y")


@query()
def outlines(spark, sf):
    return L.outlines(C.components(_green(spark, sf))).select("label", F.size("points").alias("n"), F.to_json("points").alias("points"))


@query()
def centrelines(spark, sf):
    rows = A.pixels(spark, sf).agg(F.max("y")).first()
    labelled = C.components(_green(spark, sf))
    thin = C.thinned(labelled, width=A.WIDTH, height=rows[0] + 1).join(labelled, ["image_id", "x", "y"])
    return L.centrelines(thin).select("label", F.size("points").alias("n"), F.to_json("points").alias("points"))


@query()
def watershed_instances(spark, sf):
    px = A.pixels(spark, sf)
    mask = px.select("image_id", "x", "y", (spectral.surface() == 3).cast("int").alias("bit"))
    return C.summarised(W.instances(mask, px), least=25)


# ---- geometry ----


@query("""WITH q AS (SELECT c_custkey AS id, 500 + c_custkey % 7 AS x, 20 + c_custkey % 30 AS w, 10 + c_custkey % 17 AS h, radians(5 + c_custkey % 80) AS t FROM customer)
SELECT id, x::DOUBLE AS x1, 300::DOUBLE AS y1, round(x + w * cos(t) - h * sin(t), 2) AS x3, round(300 + w * sin(t) + h * cos(t), 2) AS y3 FROM q""")
def oriented_box(spark, sf):
    box = R.oriented_box(F.col("points"))
    rows = A.plots(spark, sf).select("id", box.alias("b"))
    at = lambda i, c: F.get("b", F.lit(i))[c].alias(f"{c}{i + 1}")
    return rows.select("id", at(0, "x"), at(0, "y"), at(2, "x"), at(2, "y"))


@query()
def orthogonal_outline(spark, sf):
    return A.polygons(spark, sf).select("id", R.orthogonalised(F.col("points"), degrees=12, snap=5).alias("p")).select("id", F.size("p").alias("n"), F.round(G.area(F.col("p")), 2).alias("area"))


@query(f"{_PG} SELECT id, round({_AREA}, 4) AS area FROM pg")
def polygon_area(spark, sf):
    return A.polygons(spark, sf).select("id", F.round(G.area(F.col("points")), 4).alias("area"))


@query(f"{_PG} SELECT id, round(list_sum(list_transform(range(1, len(p) + 1), lambda i: sqrt((p[i].x - p[i % len(p) + 1].x) ** 2 + (p[i].y - p[i % len(p) + 1].y) ** 2))), 4) AS perimeter FROM pg")
def polygon_perimeter(spark, sf):
    return A.polygons(spark, sf).select("id", F.round(G.length(F.col("points"), True), 4).alias("perimeter"))


@query(f"{_PG} SELECT id, list_min(list_transform(p, lambda q: q.x)) AS min_x, list_min(list_transform(p, lambda q: q.y)) AS min_y, list_max(list_transform(p, lambda q: q.x)) AS max_x, list_max(list_transform(p, lambda q: q.y)) AS max_y FROM pg")
def polygon_bbox(spark, sf):
    return A.polygons(spark, sf).select("id", G.bounds(F.col("points")).alias("b")).select("id", "b.*")


@query(f"""{_PG}, e AS (SELECT id, unnest(list_transform(range(1, len(p) + 1), lambda i: {{'dx': p[i % len(p) + 1].x - p[i].x, 'dy': p[i % len(p) + 1].y - p[i].y}})) AS d FROM pg), w AS (SELECT id, sqrt(d.dx * d.dx + d.dy * d.dy) AS n, 4 * atan2(d.dy, d.dx) AS t FROM e),
s AS (SELECT id, coalesce(sum(n * sin(t)) FILTER (n >= 1), 0) AS s, coalesce(sum(n * cos(t)) FILTER (n >= 1), 0) AS c FROM w GROUP BY id), a AS (SELECT id, atan2(s, c) / 4 AS a FROM s) SELECT id, round(CASE WHEN a < 0 THEN a + pi() / 2 ELSE a END, 6) AS angle FROM a""")
def orientation(spark, sf):
    return A.polygons(spark, sf).select("id", F.round(G.orientation(F.col("points")), 6).alias("angle"))


@query(f"{_PG}, t AS (SELECT id, p, list_sum(list_transform(range(1, len(p)), lambda i: p[i].x * p[i + 1].y - p[i + 1].x * p[i].y)) AS s FROM pg) SELECT id, s > 0 AS turned, round(CASE WHEN s > 0 THEN p[len(p)].x ELSE p[1].x END, 4) AS first_x FROM t")
def ring_orientation(spark, sf):
    ring = G.clockwise(F.col("points"))
    return A.polygons(spark, sf).select("id", (ring != F.col("points")).alias("turned"), F.round(F.get(ring, F.lit(0))["x"], 4).alias("first_x"))


@query(f"""{_PG}, q AS (SELECT id, unnest(p).x AS x, unnest(p).y AS y FROM pg), m AS (SELECT id, count(*) AS n, avg(x) AS mx, avg(y) AS my FROM q GROUP BY id), u AS (SELECT q.id, x, y, n, mx, my, x - mx AS u, y - my AS v FROM q JOIN m USING (id)),
s AS (SELECT id, any_value(n) AS n, any_value(mx) AS mx, any_value(my) AS my, sum(u*u) AS uu, sum(v*v) AS vv, sum(u*v) AS uv, sum(u*u*u) AS uuu, sum(v*v*v) AS vvv, sum(u*v*v) AS uvv, sum(v*u*u) AS vuu FROM u GROUP BY id),
c AS (SELECT *, (0.5*(uuu+uvv)*vv - 0.5*(vvv+vuu)*uv) / (uu*vv-uv*uv) AS uc, (0.5*(vvv+vuu)*uu - 0.5*(uuu+uvv)*uv) / (uu*vv-uv*uv) AS vc FROM s)
SELECT id, round(any_value(uc + c.mx), 2) AS cx, round(any_value(vc + c.my), 2) AS cy, round(avg(sqrt((u.u - uc)*(u.u - uc) + (u.v - vc)*(u.v - vc))), 2) AS radius FROM c JOIN u USING (id) WHERE abs(uu*vv-uv*uv) >= 1e-7 GROUP BY id""")
def circle_fit(spark, sf):
    points = A.polygons(spark, sf).select("id", F.explode("points").alias("p")).select("id", "p.x", "p.y")
    return O.circle_fit(points).select("id", *(F.round(c, 2).alias(c) for c in ("cx", "cy", "radius")))


_GC = "WITH gc AS (SELECT s_suppkey AS id, s_suppkey::DOUBLE AS x, (s_nationkey * s_nationkey % 97)::DOUBLE AS y, s_acctbal::DOUBLE / 100000 AS e FROM supplier), wc AS (SELECT id, x, y, x * 0.5::DOUBLE + y * 0.25::DOUBLE + 100 + e AS u, x * -0.25::DOUBLE + y * 0.75::DOUBLE + 50 - e AS v FROM gc), cm AS (SELECT count(*) AS n, avg(x) AS mx, avg(y) AS my, avg(u) AS mu, avg(v) AS mv, covar_pop(x, x) AS xx, covar_pop(y, y) AS yy, covar_pop(x, y) AS xy, covar_pop(x, u) AS xu, covar_pop(y, u) AS yu, covar_pop(x, v) AS xv, covar_pop(y, v) AS yv FROM wc), lm AS (SELECT *, (xu*yy - yu*xy)/(xx*yy-xy*xy) AS a, (yu*xx - xu*xy)/(xx*yy-xy*xy) AS b, (xv*yy - yv*xy)/(xx*yy-xy*xy) AS d, (yv*xx - xv*xy)/(xx*yy-xy*xy) AS e FROM cm), af AS (SELECT n, a, b, mu - a*mx - b*my AS c, d, e, mv - d*mx - e*my AS f FROM lm)"


@query(f"{_GC} SELECT round(a, 4) AS a, round(b, 4) AS b, round(c, 4) AS c, round(d, 4) AS d, round(e, 4) AS e, round(f, 4) AS f, (SELECT round(sqrt(avg((a*x+b*y+c-u)**2 + (d*x+e*y+f-v)**2)), 4) FROM wc) AS rmse FROM af")
def affine_fit(spark, sf):
    return O.affine_fit(A.control_points(spark, sf)).select(*(F.round(c, 4).alias(c) for c in (*"abcdef", "rmse")))


@query(f"{_GC} SELECT id, round(x * 0.5::DOUBLE + y * 0.25::DOUBLE + 100, 6) AS x, round(x * -0.25::DOUBLE + y * 0.75::DOUBLE + 50, 6) AS y FROM gc")
def affine_apply(spark, sf):
    at = G.affine(G.point(F.col("pixel_x"), F.col("pixel_y")), [0.5, 0.25, 100.0, -0.25, 0.75, 50.0])
    return A.control_points(spark, sf).select("id", at.alias("p")).select("id", F.round("p.x", 6).alias("x"), F.round("p.y", 6).alias("y"))


_SEGD = "CASE WHEN ({b}.x-{a}.x)**2 + ({b}.y-{a}.y)**2 = 0 THEN sqrt(({p}.x-{a}.x)**2 + ({p}.y-{a}.y)**2) ELSE sqrt(({p}.x - ({a}.x + {t} * ({b}.x-{a}.x)))**2 + ({p}.y - ({a}.y + {t} * ({b}.y-{a}.y)))**2) END"


def _segd(p, a, b):
    t = f"greatest(0, least(1, (({p}.x-{a}.x)*({b}.x-{a}.x) + ({p}.y-{a}.y)*({b}.y-{a}.y)) / nullif(({b}.x-{a}.x)**2 + ({b}.y-{a}.y)**2, 0)))"
    return _SEGD.format(p=p, a=a, b=b, t=t)


@query(f"{_FT} SELECT id, (i - 1)::INT AS i, round(sqrt((a.x-b.x)**2 + (a.y-b.y)**2), 6) AS length FROM edges")
def segments(spark, sf):
    e = A.features(spark, sf).select("id", F.posexplode(G.edges(F.col("points"), False)).alias("i", "e"))
    return e.select("id", "i", F.round(G.distance(F.col("e.a"), F.col("e.b")), 6).alias("length"))


@query(f"{_PG} SELECT id, i::INT AS i, round({_segd('p[i + 1]', 'p[i]', 'p[i + 2]')}, 4) AS distance FROM (SELECT id, p, unnest(range(1, 31)) AS i FROM pg)")
def segment_distance(spark, sf):
    p = [F.get("points", F.col("i") + k) for k in (-1, 0, 1)]
    rows = A.polygons(spark, sf).select("id", "points", F.explode(F.sequence(F.lit(1), F.size("points") - 2)).alias("i"))
    return rows.select("id", "i", F.round(G.segment_distance(p[1], p[0], p[2]), 4).alias("distance"))


@query(f"{_PG}, q AS (SELECT id, i::INT AS i, p[i] AS a, p[i + 1] AS b, p[i + 2] AS c, p[i + 3] AS e FROM (SELECT id, p, unnest(range(1, 30)) AS i FROM pg)), t AS (SELECT *, (a.x-b.x)*(c.y-e.y) - (a.y-b.y)*(c.x-e.x) AS d FROM q), u AS (SELECT *, ((a.x-c.x)*(c.y-e.y) - (a.y-c.y)*(c.x-e.x)) / d AS t FROM t WHERE abs(d) >= 100) SELECT id, i, round(a.x + t*(b.x-a.x), 2) AS x, round(a.y + t*(b.y-a.y), 2) AS y FROM u")
def line_intersection(spark, sf):
    p = [F.get("points", F.col("i") + k) for k in range(-1, 3)]
    det = (p[0]["x"] - p[1]["x"]) * (p[2]["y"] - p[3]["y"]) - (p[0]["y"] - p[1]["y"]) * (p[2]["x"] - p[3]["x"])
    rows = A.polygons(spark, sf).select("id", "points", F.explode(F.sequence(F.lit(1), F.size("points") - 3)).alias("i"))
    rows = rows.where(F.abs(det) >= 100).select("id", "i", G.intersection(*p).alias("q"))
    return rows.select("id", "i", F.round("q.x", 2).alias("x"), F.round("q.y", 2).alias("y"))


def _vertices(rows: DataFrame, points) -> DataFrame:
    """(id, i, x, y) of all points."""
    return rows.select("id", F.posexplode(points).alias("i", "p")).select("id", "i", F.round("p.x", 6).alias("x"), F.round("p.y", 6).alias("y"))


_POINTS = ", ks AS MATERIALIZED (SELECT id, {k} AS k FROM ft) SELECT id, (i - 1)::INT AS i, round(q.x, 6) AS x, round(q.y, 6) AS y FROM (SELECT id, generate_subscripts(k, 1) AS i, unnest(k) AS q FROM ks)"


@query(f"""WITH RECURSIVE {_PG.removeprefix('WITH ')}, cuts AS (SELECT id, p, 1::BIGINT AS lo, len(p)::BIGINT AS hi FROM pg
  UNION ALL SELECT id, p, unnest([lo, mid]) AS lo, unnest([mid, hi]) AS hi FROM (SELECT id, p, lo, hi, lo + list_position(d, list_max(d)) AS mid, list_max(d) AS most
    FROM (SELECT id, p, lo, hi, list_transform(range(lo + 1, hi), lambda i: {_segd('p[i]', 'p[lo]', 'p[hi]')}) AS d FROM cuts WHERE hi > lo + 1)) WHERE most > 40)
SELECT id, (row_number() OVER (PARTITION BY id ORDER BY m) - 1)::INT AS i, round(p[m].x, 6) AS x, round(p[m].y, 6) AS y FROM (SELECT DISTINCT id, lo AS m FROM cuts UNION SELECT id, len(p) FROM pg) JOIN pg USING (id)""")
def rdp_simplify(spark, sf):
    return _vertices(A.polygons(spark, sf), simplified(F.col("points"), 40.0))


_SLIM = "CASE WHEN len({p}) <= 2 THEN {p} ELSE list_append(list_reduce(list_prepend([{p}[1]], list_transform(range(2, len({p})), lambda i: [{p}[i], {p}[i + 1]])), lambda k, e: CASE WHEN " + _segd("e[1]", "k[-1]", "e[2]") + " > 1.2::DOUBLE THEN list_append(k, e[1]) ELSE k END), {p}[-1]) END"
_THIN = "list_reduce(list_transform(p, lambda q: [q]), lambda k, q: CASE WHEN sqrt((q[1].x - k[-1].x)**2 + (q[1].y - k[-1].y)**2) >= 1 THEN list_concat(k, q) ELSE k END)"


@query(f"{_FT}{_POINTS.format(k=_THIN)}")
def dedup_vertices(spark, sf):
    return _vertices(A.features(spark, sf), G.deduplicated(F.col("points")))


@query(f"{_FT}{_POINTS.format(k=_SLIM.format(p='p'))}")
def merge_collinear(spark, sf):
    return _vertices(A.features(spark, sf), G.without_collinear(F.col("points")))


_INSIDE = "len(list_filter(range(1, len(p) + 1), lambda i: (p[i].y > {y}) != (p[i % len(p) + 1].y > {y}) AND {x} < (p[i % len(p) + 1].x - p[i].x) * ({y} - p[i].y) / (p[i % len(p) + 1].y - p[i].y) + p[i].x)) % 2 = 1"


@query(f"{_PG} SELECT id, {_INSIDE.format(x='0', y='0')} AS inside FROM pg")
def point_in_polygon(spark, sf):
    return A.polygons(spark, sf).select("id", G.contains(F.col("points"), G.point(F.lit(0.0), F.lit(0.0))).alias("inside"))


_PICKS = "picks AS (SELECT c_custkey AS pick, (c_custkey % 50)::DOUBLE + 0.5::DOUBLE AS x, (c_custkey // 50 % 100)::DOUBLE + 0.25::DOUBLE AS y FROM customer WHERE c_custkey % 100 = 0)"


def _picks(spark, sf):
    c = A.table(spark, sf, "customer").where("c_custkey % 100 = 0")
    return c.select(F.col("c_custkey").alias("pick"), ((F.col("c_custkey") % 50).cast("double") + 0.5).alias("x"), (F.expr("c_custkey div 50") % 100).cast("double").alias("y")).withColumn("y", F.col("y") + 0.25)


@query(f"{_FT}, {_PICKS}, hits AS (SELECT pick, id, seq FROM ft, picks WHERE closed AND len(p) >= 3 AND {_INSIDE.format(x='picks.x', y='picks.y')} UNION ALL SELECT pick, id, id FROM edges, picks WHERE {_segd('picks', 'a', 'b')} <= 0.5::DOUBLE) SELECT pick, max_by(id, seq) AS id FROM hits GROUP BY pick")
def spatial_pick(spark, sf):
    return O.picked(A.features(spark, sf), _picks(spark, sf), tolerance=0.5, cell=25.0)


@query(f"{_FT}, {_PICKS} SELECT pick, max(id) AS id FROM edges, picks WHERE {_segd('picks', 'a', 'b')} <= 1.5::DOUBLE GROUP BY pick")
def hover_pick(spark, sf):
    return O.picked(A.features(spark, sf), _picks(spark, sf), tolerance=1.5, cell=25.0, interior=False)


@query("SELECT s_suppkey AS id, round(sqrt((s_suppkey + 3)::DOUBLE ** 2 + 16), 1) AS pixel_distance, round(10 * 0.3048::DOUBLE / sqrt((s_suppkey + 3)::DOUBLE ** 2 + 16), 4) AS metres_per_pixel FROM supplier")
def calibrate(spark, sf):
    s = A.table(spark, sf, "supplier").select(F.col("s_suppkey").alias("id"), F.lit(0.0).alias("x1"), F.lit(0.0).alias("y1"), (F.col("s_suppkey") + 3).cast("double").alias("x2"), F.lit(4.0).alias("y2"), F.lit(10.0).alias("known"), F.lit("ft").alias("unit"))
    return O.calibrated(s)


# ---- features ----


@query(f"{_FT}, a AS (SELECT layer, {_AREA} AS area FROM ft), s AS (SELECT layer, count(*) AS features, sum(area) AS area FROM a GROUP BY layer) SELECT name, coalesce(features, 0)::BIGINT AS features, round(coalesce(area, 0), 2) AS area FROM ly LEFT JOIN s ON layer = name WHERE features > 0 OR name IN ('BUILDINGS', 'ROADS', 'PARCELS')")
def layer_rollup(spark, sf):
    return O.layer_rollup(A.features(spark, sf), layers(spark)).select("name", "features", F.round("area", 2).alias("area"))


@query(f"{_FT} SELECT id, layer, color FROM ft LEFT JOIN ly ON layer = name")
def layer_outer_join(spark, sf):
    return O.styled(A.features(spark, sf), layers(spark)).select("id", "layer", "color")


@query(f"{_FT} SELECT id, layer, color FROM ft JOIN ly ON layer = name")
def layer_inner_join(spark, sf):
    return O.styled(A.features(spark, sf), layers(spark), how="inner").select("id", "layer", "color")


@query(f"{_FT} SELECT id FROM ft WHERE layer <> 'WATER'")
def visible_features(spark, sf):
    return O.visible(A.features(spark, sf), layers(spark).withColumn("visible", F.col("name") != "WATER")).select("id")


_ISSUES = """near AS (SELECT id, min(i) - 1 AS pos FROM edges WHERE sqrt((a.x-b.x)**2 + (a.y-b.y)**2) < 0.7::DOUBLE GROUP BY id), len AS (SELECT ft.id, sum(sqrt((a.x-b.x)**2 + (a.y-b.y)**2)) + any_value(CASE WHEN closed AND len(p) > 2 THEN sqrt((p[1].x-p[-1].x)**2 + (p[1].y-p[-1].y)**2) ELSE 0 END) AS n FROM ft JOIN edges USING (id) GROUP BY ft.id),
issues AS (SELECT id, layer, 'UNCLOSED_POLYGON' AS kind, 'ERROR' AS severity, 0 AS at FROM ft WHERE layer IN ('BUILDINGS', 'PARCELS') AND NOT closed UNION ALL SELECT id, layer, 'DUPLICATE_VERTICES', 'WARNING', pos::INT FROM ft JOIN near USING (id) UNION ALL SELECT id, layer, 'ZERO_LENGTH', 'ERROR', 0 FROM ft JOIN len USING (id) WHERE n < 1)"""


@query(f"{_FT}, {_ISSUES} SELECT * FROM issues")
def topology_issues(spark, sf):
    return O.topology_issues(A.features(spark, sf))


@query(f"{_FT}, {_ISSUES} SELECT kind, severity, count(*)::BIGINT AS n FROM issues GROUP BY ALL")
def issue_summary(spark, sf):
    return O.topology_issues(A.features(spark, sf)).groupBy("kind", "severity").agg(F.count("*").alias("n"))


@query(f"{_FT}, {_ISSUES} SELECT id, layer FROM ft WHERE id IN (SELECT id FROM issues)")
def features_with_issues(spark, sf):
    f = A.features(spark, sf)
    return f.join(O.topology_issues(f).select("id"), "id", "left_semi").select("id", "layer")


@query(f"{_FT}, {_ISSUES} SELECT id, layer FROM ft WHERE id NOT IN (SELECT id FROM issues)")
def features_clean(spark, sf):
    f = A.features(spark, sf)
    return f.join(O.topology_issues(f).select("id"), "id", "left_anti").select("id", "layer")


@query(f"""{_FT}, thin AS (SELECT id, layer, closed, len(p) AS before, {_THIN} AS d FROM ft WHERE len(p) >= 2 OR kind IN ('POINT', 'CIRCLE')),
slim AS (SELECT id, before, closed OR layer IN ('BUILDINGS', 'PARCELS') AS shut, layer IN ('BUILDINGS', 'PARCELS') AND NOT closed AS forced, CASE WHEN len(d) >= 3 THEN {_SLIM.format(p='d')} ELSE d END AS p FROM thin)
SELECT id, shut AS is_closed, len(p) <> before OR forced AS modified, len(p)::INT AS n, CASE WHEN shut AND len(p) >= 3 THEN floor({_AREA} + 0.5::DOUBLE)::BIGINT ELSE 0 END AS area,
  floor(coalesce(list_sum(list_transform(range(1, len(p)), lambda i: sqrt((p[i].x - p[i + 1].x)**2 + (p[i].y - p[i + 1].y)**2))), 0) + CASE WHEN shut AND len(p) > 2 THEN sqrt((p[1].x - p[-1].x)**2 + (p[1].y - p[-1].y)**2) ELSE 0 END + 0.5::DOUBLE)::BIGINT AS length FROM slim""")
def topology_autofix(spark, sf):
    return O.topology_repaired(A.features(spark, sf)).select("id", "is_closed", "modified", F.size("points").alias("n"), F.coalesce("area", F.lit(0)).alias("area"), "length")


@query(f"{_FT}, every AS (SELECT name, aci, lineweight, linetype, 0 AS k FROM ly UNION ALL SELECT DISTINCT layer, 7, 0.25::DOUBLE, 'CONTINUOUS', 1 FROM ft UNION ALL SELECT '0', 7, 0.25::DOUBLE, 'CONTINUOUS', 2) SELECT name AS safe, name, aci, lineweight, linetype FROM every QUALIFY row_number() OVER (PARTITION BY name ORDER BY k) = 1")
def layer_registry(spark, sf):
    return O.layer_registry(A.features(spark, sf), layers(spark))


@query(r"""SELECT DISTINCT name, CASE WHEN trim(s) = '' THEN '0' ELSE trim(s) END AS safe FROM (SELECT event_type AS name, trim(regexp_replace(event_type || '/a:b*' || props, '[<>/\\":;?*|=,]', '_', 'g'))[1:255] AS s FROM events)""")
def safe_layer_name(spark, sf):
    e = A.table(spark, sf, "events")
    return e.select(F.col("event_type").alias("name"), O.safe_layer_name(F.concat("event_type", F.lit("/a:b*"), "props")).alias("safe")).distinct()


@query(f"{_FT} SELECT shape, count(*)::BIGINT AS n FROM (SELECT CASE WHEN closed AND len(p) >= 3 THEN 'polygons' WHEN NOT closed AND len(p) >= 2 THEN 'lines' WHEN kind IN ('POINT', 'CIRCLE') THEN 'points' END AS shape FROM ft) GROUP BY shape")
def export_sets(spark, sf):
    return X.export_set(A.features(spark, sf)).groupBy("shape").agg(F.count("*").alias("n"))


_WKT = f"list_transform(q, lambda z: ({_FIX.format(v='z.x')}) || ' ' || ({_FIX.format(v='z.y')}))"


@query(f"""{_FT}, g AS (SELECT *, CASE WHEN kind = 'POINT' THEN 'POINT(' WHEN closed AND len(p) >= 3 THEN 'POLYGON((' ELSE 'LINESTRING(' END AS head, CASE WHEN closed AND len(p) >= 3 THEN list_append(p, p[1]) ELSE p END AS q FROM ft)
SELECT seq, id || ',' || layer || ',,' || kind || ',' || printf('%.2f', confidence) || ',0.00,0.00,' || len(p) || ',"' || head || array_to_string({_WKT}, ', ') || CASE WHEN head LIKE 'POLY%' THEN '))' ELSE ')' END || '"' AS line FROM g""")
def export_csv(spark, sf):
    return X.csv_lines(A.features(spark, sf))


_XY = "array_to_string(list_transform(q, lambda z: {x} || ',' || {y}), {sep})"


@query(f"""{_FT}, c AS (SELECT *, list_transform(p, lambda z: '[' || ({_fix('z.x', 3)})::DOUBLE || ',' || ({_fix('1000 - z.y', 3)})::DOUBLE || ']') AS c FROM ft)
SELECT seq, '{{"type":"Feature","id":' || id || ',"properties":{{"id":' || id || ',"layer":"' || layer || '","confidence":' || confidence || ',"geometryType":"' || kind || '","area":0.0,"length":0.0}},"geometry":{{"type":"' ||
  CASE WHEN kind = 'POINT' THEN 'Point","coordinates":' || c[1] WHEN closed AND len(p) >= 3 THEN 'Polygon","coordinates":[[' || array_to_string(CASE WHEN c[1] <> c[-1] THEN list_append(c, c[1]) ELSE c END, ',') || ']]' ELSE 'LineString","coordinates":[' || array_to_string(c, ',') || ']' END || '}}}}' AS geojson FROM c""")
def export_geojson(spark, sf):
    return X.geojson_parts(A.features(spark, sf))


@query(f"""{_FT}, c AS (SELECT *, CASE WHEN kind <> 'POINT' AND closed AND len(p) >= 3 THEN list_append(p, p[1]) ELSE p END AS q FROM ft),
t AS (SELECT *, '<coordinates>' || array_to_string(list_transform(q, lambda z: ({_fix('31.2357::DOUBLE + z.x / 111320', 6)}) || ',' || ({_fix('30.0444::DOUBLE + (1000 - z.y) / 110540', 6)}) || ',0'), ' ') || '</coordinates>' AS body FROM c)
SELECT seq, '<Placemark><name>' || id || '</name><styleUrl>#style_' || layer || '</styleUrl><ExtendedData><Data name="Layer"><value>' || layer || '</value></Data><Data name="Class"><value></value></Data><Data name="Confidence"><value>' || confidence || '</value></Data><Data name="Area"><value>0.0</value></Data><Data name="Length"><value>0.0</value></Data></ExtendedData>' ||
  CASE WHEN kind = 'POINT' THEN '<Point>' || body || '</Point>' WHEN closed AND len(p) >= 3 THEN '<Polygon><outerBoundaryIs><LinearRing>' || body || '</LinearRing></outerBoundaryIs></Polygon>' ELSE '<LineString>' || body || '</LineString>' END || '</Placemark>' AS kml FROM t""")
def export_kml(spark, sf):
    return X.kml_parts(A.features(spark, sf))


@query(f"""{_FT}, t AS (SELECT ft.*, color, greatest(1, floor(lineweight * 4 + 0.5::DOUBLE))::INT AS width, CASE linetype WHEN 'DASHED' THEN ' stroke-dasharray="6,4"' WHEN 'CENTER' THEN ' stroke-dasharray="14,4,4,4"' ELSE '' END AS dash,
  array_to_string(list_transform(p, lambda z: ({_fix('z.x', 1)}) || ',' || ({_fix('z.y', 1)})), ' ') AS body FROM ft JOIN ly ON layer = name WHERE len(p) >= 2)
SELECT layer, seq, CASE WHEN closed AND len(p) >= 3 THEN '<polygon id="' || id || '" points="' || body || '" fill="' || color || '" fill-opacity="0.2"' ELSE '<polyline id="' || id || '" points="' || body || '" fill="none"' END || ' stroke="' || color || '" stroke-width="' || width || '"' || dash || '/>' AS svg FROM t""")
def export_svg(spark, sf):
    return X.svg_parts(A.features(spark, sf), layers(spark))


_LF = "chr(13) || chr(10)"


def _codes(*pairs: tuple[int, str]) -> str:
    return " || ".join(f"'{k}' || {_LF} || {v} || {_LF}" for k, v in pairs)


def _at(i: int, a: int, b: int) -> str:
    return _codes((a, f"x[{i}]"), (b, f"y[{i}]"))


_ENTITY = lambda name, marker: _codes((0, f"'{name}'"), (5, "printf('%X', 39 + k)"), (330, "'22'"), (100, "'AcDbEntity'"), (8, "layer"), (100, f"'{marker}'"))


@query(f"""{_FT}, o AS (SELECT *, row_number() OVER (ORDER BY seq) AS k, CASE WHEN closed AND len(p) > 2 AND sqrt((p[1].x - p[-1].x)**2 + (p[1].y - p[-1].y)**2) < 1e-4::DOUBLE THEN p[1:-2] ELSE p END AS q FROM ft),
t AS (SELECT *, list_transform(q, lambda z: {_fix('z.x', 4)}) AS x, list_transform(q, lambda z: {_fix('1000 - z.y', 4)}) AS y FROM o)
SELECT seq, CASE WHEN kind = 'POINT' THEN {_ENTITY('POINT', 'AcDbPoint')} || {_at(1, 10, 20)} || {_codes((30, "'0'"))} WHEN kind = 'LINE' THEN {_ENTITY('LINE', 'AcDbLine')} || {_at(1, 10, 20)} || {_codes((30, "'0'"))} || {_at(2, 11, 21)} || {_codes((31, "'0'"))}
  ELSE {_ENTITY('LWPOLYLINE', 'AcDbPolyline')} || {_codes((90, 'len(q)'), (70, "closed::INT"), (43, "'0'"))} || array_to_string(list_transform(range(1, len(q) + 1), lambda i: {_codes((10, 'x[i]'), (20, 'y[i]'))}), '') END AS entity FROM t""")
def export_dxf_entities(spark, sf):
    return X.dxf_entities(A.features(spark, sf))


@query(f"{_FT} SELECT min(list_min(list_transform(p, lambda q: q.x))) AS min_x, min(list_min(list_transform(p, lambda q: q.y))) AS min_y, max(list_max(list_transform(p, lambda q: q.x))) AS max_x, max(list_max(list_transform(p, lambda q: q.y))) AS max_y FROM ft")
def dxf_extents(spark, sf):
    return X.extents(A.features(spark, sf))


@query(f"{_FT} SELECT seq, ' ' || rpad(id::VARCHAR, 16, ' ') || rpad(layer, 20, ' ') || repeat(' ', 24) || lpad(printf('%.2f', confidence), 6, ' ') || lpad('0.00', 12, ' ') || lpad('0.00', 12, ' ') AS record FROM ft")
def dbf_rows(spark, sf):
    return X.dbf_records(A.features(spark, sf))


_LOG = "lg AS (SELECT event_id % 7 AS version, user_id AS id, max_by(event_type, event_id) AS layer, bool_or(event_id % 11 = 0) AS deleted FROM events GROUP BY 1, 2)"


def _log(spark, sf):
    e = A.table(spark, sf, "events")
    return e.groupBy((F.col("event_id") % 7).alias("version"), F.col("user_id").alias("id")).agg(F.max_by("event_type", "event_id").alias("layer"), F.bool_or(F.col("event_id") % 11 == 0).alias("deleted"))


@query(f"WITH {_LOG}, last AS (SELECT * FROM lg WHERE version <= 4 QUALIFY row_number() OVER (PARTITION BY id ORDER BY version DESC) = 1) SELECT id, version, layer FROM last WHERE NOT deleted")
def edit_log_undo(spark, sf):
    return O.at_version(_log(spark, sf), 4).select("id", "version", "layer")


@query(f"{_FT} SELECT id, layer FROM ft WHERE id % 10 <> 0")
def delete_feature(spark, sf):
    gone = A.table(spark, sf, "orders").where("o_orderkey % 10 = 0").select(F.col("o_orderkey").alias("id"))
    return A.features(spark, sf).join(gone, "id", "left_anti").select("id", "layer")


@query(f"{_FT} SELECT id, CASE WHEN layer = 'SURVEY' THEN 'OTHER' ELSE layer END AS layer FROM ft")
def reassign_layer(spark, sf):
    return A.features(spark, sf).select("id", F.when(F.col("layer") == "SURVEY", "OTHER").otherwise(F.col("layer")).alias("layer"))


@query(f"{_FT} SELECT id, closed OR len(p) >= 3 AS is_closed FROM ft")
def close_polygon(spark, sf):
    return A.features(spark, sf).select("id", (F.col("is_closed") | (F.size("points") >= 3)).alias("is_closed"))


_LONG = "coalesce(list_sum(list_transform(range(1, len(p)), lambda i: sqrt((p[i].x - p[i + 1].x)**2 + (p[i].y - p[i + 1].y)**2))), 0) + CASE WHEN closed AND len(p) > 2 THEN sqrt((p[1].x - p[-1].x)**2 + (p[1].y - p[-1].y)**2) ELSE 0 END"


@query(f"{_FT} SELECT id, round({_AREA} * 0.0025::DOUBLE, 1) AS square_metres, round(({_LONG}) * 0.05::DOUBLE, 1) AS metres, len(p)::INT AS vertices, (floor(confidence + 0.5::DOUBLE))::BIGINT AS confidence FROM ft")
def display_metrics(spark, sf):
    shown = F.round(G.area(F.col("points")) * 0.0025, 1).alias("square_metres"), F.round(G.length(F.col("points"), F.col("is_closed")) * 0.05, 1).alias("metres")
    return A.features(spark, sf).select("id", *shown, F.size("points").alias("vertices"), F.floor(F.col("confidence") + 0.5).alias("confidence"))


@query(f"{_FT}, v AS (SELECT id, i::INT AS i, p[i].y AS y FROM (SELECT id, p, unnest(range(1, len(p) + 1)) AS i FROM ft)) SELECT id, i, {_FIX.format(v='y')} AS y FROM v")
def fixed_digits(spark, sf):
    rows = A.features(spark, sf).select("id", F.posexplode("points").alias("i", "p"))
    return rows.select("id", (F.col("i") + 1).alias("i"), to_fixed(F.col("p.y"), 2).alias("y"))


@query(f"""{_FT}, thin AS (SELECT id, layer, closed, len(p) AS before, {_THIN} AS d FROM ft WHERE len(p) >= 2 OR kind IN ('POINT', 'CIRCLE')),
slim AS (SELECT before, layer IN ('BUILDINGS', 'PARCELS') AND NOT closed AS forced, len(CASE WHEN len(d) >= 3 THEN {_SLIM.format(p='d')} ELSE d END) AS n FROM thin)
SELECT ((SELECT count(*) FROM ft) - count(*) + count(*) FILTER (n <> before OR forced))::BIGINT AS fixed FROM slim""")
def topology_fixes(spark, sf):
    return O.topology_fixes(A.features(spark, sf))


def _moves(spark, sf):
    return A.table(spark, sf, "orders").where("o_orderkey % 3 = 0").select(F.col("o_orderkey").alias("id"), (F.col("o_custkey") % 10).cast("double").alias("dx"), F.lit(-2.5).alias("dy"))


@query(f"{_FT}, s AS (SELECT id, p, CASE WHEN id % 3 = 0 THEN (o_custkey % 10)::DOUBLE ELSE 0 END AS dx, CASE WHEN id % 3 = 0 THEN -2.5::DOUBLE ELSE 0 END AS dy FROM ft JOIN orders ON o_orderkey = id) SELECT id, (i - 1)::INT AS i, round(p[i].x + dx, 6) AS x, round(p[i].y + dy, 6) AS y FROM (SELECT *, unnest(range(1, len(p) + 1)) AS i FROM s)")
def move_feature(spark, sf):
    return _vertices(E.moved(A.features(spark, sf), _moves(spark, sf)), F.col("points"))


@query(f"{_FT} SELECT id, (i - 1)::INT AS i, round(CASE WHEN id % 3 = 0 AND i = 2 THEN floor((o_custkey % 97 / 7) * 10 + 0.5::DOUBLE) / 10 ELSE p[i].x END, 6) AS x, round(CASE WHEN id % 3 = 0 AND i = 2 THEN 1 ELSE p[i].y END, 6) AS y FROM (SELECT *, unnest(range(1, len(p) + 1)) AS i FROM ft JOIN orders ON o_orderkey = id WHERE len(p) >= 2)")
def drag_vertex(spark, sf):
    drags = A.table(spark, sf, "orders").where("o_orderkey % 3 = 0").select(F.col("o_orderkey").alias("id"), F.lit(1).alias("vertex"), (F.col("o_custkey") % 97 / 7).alias("x"), F.lit(1.0).alias("y"))
    return _vertices(E.dragged(A.features(spark, sf).where(F.size("points") >= 2), drags), F.col("points"))


@query(f"{_FT} SELECT id, {_fix('sqrt((p[1].x - p[-1].x)**2 + (p[1].y - p[-1].y)**2)', 1)} || ' px' AS pixels, {_fix('sqrt((p[1].x - p[-1].x)**2 + (p[1].y - p[-1].y)**2) * 0.05::DOUBLE', 2)} || ' m' AS metres FROM ft")
def measure(spark, sf):
    a, b = F.get("points", F.lit(0)), F.element_at("points", -1)
    return A.features(spark, sf).select("id", E.measured(a, b).alias("pixels"), E.measured(a, b, F.lit(0.05)).alias("metres"))


@query("SELECT s_suppkey AS id, round((least((s_suppkey + 400 - 32) / 1000, (600 - 32) / 800, 2.5)), 6) AS zoom, round(((120 + s_suppkey) - 30) / 1.25::DOUBLE, 4) AS x, round((s_nationkey + 15) / 1.25::DOUBLE, 4) AS y FROM supplier")
def screen_to_world(spark, sf):
    s = A.table(spark, sf, "supplier")
    fit = E.fitted((F.col("s_suppkey") + 400).cast("double"), F.lit(600.0), F.lit(1000.0), F.lit(800.0))
    at = E.to_world(G.point((F.col("s_suppkey") + 120).cast("double"), F.col("s_nationkey").cast("double")), G.point(F.lit(30.0), F.lit(-15.0)), F.lit(1.25))
    return s.select(F.col("s_suppkey").alias("id"), F.round(fit["zoom"], 6).alias("zoom"), F.round(at["x"], 4).alias("x"), F.round(at["y"], 4).alias("y"))


@query(f"{_FT} SELECT id, layer FROM ft WHERE id % 5 <> 0 UNION ALL SELECT id, 'OTHER' FROM ft WHERE id % 5 = 0 UNION ALL SELECT -id, 'NEW' FROM ft WHERE id % 7 = 0")
def upsert_features(spark, sf):
    f = A.features(spark, sf)
    updates = f.where("id % 5 = 0").withColumn("layer", F.lit("OTHER")).unionByName(f.where("id % 7 = 0").withColumns({"id": -F.col("id"), "layer": F.lit("NEW")}))
    return E.upserted(f, updates).select("id", "layer")


@query(f"WITH {_LOG}, cut AS (SELECT version, id, layer, deleted FROM lg WHERE version <= 4 UNION ALL SELECT 5, id, 'EDITED', false FROM lg WHERE version = 6 AND id % 2 = 0), last AS (SELECT * FROM cut QUALIFY row_number() OVER (PARTITION BY id ORDER BY version DESC) = 1) SELECT id, version, layer FROM last WHERE NOT deleted")
def edit_log_push(spark, sf):
    log = _log(spark, sf)
    changes = log.where("version = 6 and id % 2 = 0").withColumns({"layer": F.lit("EDITED"), "deleted": F.lit(False)})
    return O.at_version(E.pushed(log, changes, at=4), 9).select("id", "version", "layer")


@query(f"{_FT} SELECT name, CASE name WHEN 'ROADS' THEN '#000000' ELSE color END AS color, name <> 'WATER' AS visible, name = 'TREES' AS locked FROM ly UNION ALL SELECT 'MY_LAYER', '#3B82F6', true, false")
def layer_edits(spark, sf):
    edited = E.with_layers_changed(E.with_layers_changed(E.with_layer(layers(spark), "  my  layer "), ["WATER"], toggle="visible"), ["TREES"], toggle="locked")
    return E.with_layers_changed(edited, ["ROADS"], color="#000000").select("name", "color", "visible", "locked")


# ---- scenes ----


def _rect(x, y, w, h):
    return f"x + 0.5 >= {x} AND x + 0.5 < {x + w} AND y + 0.5 >= {y} AND y + 0.5 < {y + h}"


_PLAN = [(118, 98, 764, 604), (122, 102, 756, 596)]
_INK = [(120, 338.5, 320, 3), (438.5, 100, 3, 240), (558.5, 100, 3, 320), (560, 418.5, 320, 3), (120, 518.5, 380, 3), (498.5, 520, 3, 180), *((x - 7, y - 7, 14, 14) for x, y in ((120, 100), (440, 100), (560, 100), (880, 100), (120, 340), (440, 340), (560, 420), (880, 420), (120, 700), (500, 700), (880, 700)))]
_DIMENSIONS = [(119.5, 70, 1, 20), (879.5, 70, 1, 20), (120, 79.5, 760, 1)]


@query(f"SELECT c AS colour, count(*)::BIGINT AS n FROM (SELECT CASE WHEN {' OR '.join(f'({_rect(*r)})' for r in _DIMENSIONS)} THEN '666666' WHEN ({_rect(*_PLAN[0])} AND NOT ({_rect(*_PLAN[1])})) OR {' OR '.join(f'({_rect(*r)})' for r in _INK)} THEN '1A1A1A' ELSE 'F5F5F0' END AS c FROM (SELECT i % 1000 AS x, i // 1000 AS y FROM range(800000) t(i))) GROUP BY c")
def scene_floor_plan(spark, sf):
    rows = S.scene(spark, "sample_arch_floorplan")
    return rows.select(F.upper(F.concat(*(F.lpad(F.hex(c), 2, "0") for c in "rgb"))).alias("colour")).groupBy("colour").agg(F.count("*").alias("n"))


@query()
def aerial_features(spark, sf):
    found = V.aerial(A.pixels(spark, sf))
    return found.select("seq", "id", "layer", "geometry_type", "is_closed", "points", "area", "length")


@query()
def drawing_features(spark, sf):
    found = V.drawing(A.pixels(spark, sf))
    return found.select("seq", "id", "layer", "geometry_type", "is_closed", "points", "area", "length")


@query()
def scene_analysis(spark, sf):
    report = P.image_analysis(K.sampled(S.scenes(spark)))
    return report.select("image_id", "kind", "confidence", "metres_per_pixel", F.round("mean_saturation", 6).alias("mean_saturation"), F.round("density", 6).alias("density"))


@query(f"""{_PX}, z AS (SELECT w, h, 64 AS nw, floor(h / w * 64 + 0.5::DOUBLE)::INT AS nh FROM (SELECT max(x) + 1 AS w, max(y) + 1 AS h FROM px)),
i AS (SELECT k AS nx, floor((k + 0.5::DOUBLE) * w / nw)::INT AS x FROM z, range(64) t(k)), j AS (SELECT ny, floor((ny + 0.5::DOUBLE) * h / nh)::INT AS y FROM (SELECT h, nh, unnest(range(nh)) AS ny FROM z))
SELECT nx::INT AS x, ny::INT AS y, r, g, b FROM px JOIN i USING (x) JOIN j USING (y)""")
def analysis_sample(spark, sf):
    return K.sampled(A.pixels(spark, sf), width=64).select("x", "y", "r", "g", "b")


# ---- whole documents ----


@query(f"{_FT} SELECT 1000.0::DOUBLE - max(y) AS min_y, 1000 - min(y) AS max_y, min(x) AS min_x, max(x) AS max_x FROM (SELECT unnest(p).x AS x, unnest(p).y AS y FROM ft)")
def drawing_extents(spark, sf):
    return X.extents(A.features(spark, sf), height=1000.0, invert_y=True)


_RECORDS = """every AS (SELECT name, aci, lineweight, linetype, row_number() OVER () AS d, 0 AS met FROM ly UNION ALL SELECT layer, 7, 0.25::DOUBLE, 'CONTINUOUS', 1000000, min(seq) FROM ft WHERE layer NOT IN (SELECT name FROM ly) GROUP BY layer),
placed AS (SELECT *, row_number() OVER (ORDER BY d, met, name) AS k FROM every)"""
_RECORD = lambda first: _codes((0, "'LAYER'"), (5, f"printf('%X', {first - 1} + k)"), (330, "'24'"), (100, "'AcDbSymbolTableRecord'"), (100, "'AcDbLayerTableRecord'"), (2, "name"), (70, "'0'"), (62, "aci"), (6, "linetype"), (370, "floor(lineweight * 100 + 0.5::DOUBLE)::INT"))


@query(f"{_FT}, {_RECORDS} SELECT count(*)::BIGINT AS n, string_agg({_RECORD(0x32)}, '' ORDER BY k) AS records FROM placed")
def drawing_layers(spark, sf):
    return D.layer_records(A.features(spark, sf), layers(spark), owner="24", first_handle=0x32).withColumnRenamed("_layers", "records")


def _said(text: str) -> str:
    """SQL for codes with fixed values: `code value|code value`."""
    lines = "~".join(f"{code}~{value}" for code, _, value in (pair.partition(" ") for pair in text.split("|")))
    return f"replace('{lines}~', '~', {_LF})"


_OF = "100 AcDbSymbolTableRecord|100 AcDb"
_HANDLE = lambda n: (5, f"printf('%X', {n} + n)")
#: What stands before the entities, by the format; n is the number of layers.
_HEAD = [
    _said("0 SECTION|2 HEADER|9 $ACADVER|1 AC1027|9 $ACADMAINTVER|70 105|9 $DWGCODEPAGE|3 ANSI_1252|9 $INSBASE|10 0|20 0|30 0|9 $EXTMIN"),
    _codes((10, _fix("min_x", 4)), (20, _fix("min_y", 4))), _said("30 0|9 $EXTMAX"), _codes((10, _fix("max_x", 4)), (20, _fix("max_y", 4))),
    _said("30 0|9 $LIMMIN|10 0|20 0|9 $LIMMAX"), _codes((10, _fix("max_x", 4)), (20, _fix("max_y", 4))),
    _said("9 $INSUNITS|70 6|9 $MEASUREMENT|70 1|9 $LUNITS|70 2|9 $LUPREC|70 4|9 $AUNITS|70 0|9 $AUPREC|70 2|9 $HANDSEED|5 FFFF|0 ENDSEC|0 SECTION|2 CLASSES|0 ENDSEC|0 SECTION|2 TABLES"),
    _said(f"0 TABLE|2 VPORT|5 28|100 AcDbSymbolTable|70 1|0 VPORT|5 29|330 28|{_OF}ViewportTableRecord|2 *ACTIVE|70 0|10 0|20 0|11 1|21 1"),
    _codes((12, _fix("(min_x + max_x) / 2", 4)), (22, _fix("(min_y + max_y) / 2", 4)), (40, _fix("greatest(10, max_y - min_y)", 4))), _said("41 1.4|0 ENDTAB|0 TABLE|2 LTYPE|5 25|100 AcDbSymbolTable|70 7"),
    _said(f"0 LTYPE|5 2A|330 25|{_OF}LinetypeTableRecord|2 ByBlock|70 0|3 |72 65|73 0|40 0|0 LTYPE|5 2B|330 25|{_OF}LinetypeTableRecord|2 ByLayer|70 0|3 |72 65|73 0|40 0"),
    _said(f"0 LTYPE|5 2C|330 25|{_OF}LinetypeTableRecord|2 CONTINUOUS|70 0|3 Solid line|72 65|73 0|40 0"),
    _said(f"0 LTYPE|5 2D|330 25|{_OF}LinetypeTableRecord|2 CENTER|70 0|3 Center ____ _ ____ _ ____|72 65|73 4|40 31.75|49 19.05|49 -6.35|49 0|49 -6.35"),
    _said(f"0 LTYPE|5 2E|330 25|{_OF}LinetypeTableRecord|2 DASHED|70 0|3 Dashed __ __ __ __|72 65|73 2|40 19.05|49 12.7|49 -6.35"),
    _said(f"0 LTYPE|5 2F|330 25|{_OF}LinetypeTableRecord|2 PHANTOM|70 0|3 Phantom ____ _ _ ____ _ _|72 65|73 6|40 38.1|49 19.05|49 -6.35|49 6.35|49 -6.35|49 6.35|49 -6.35"),
    _said(f"0 LTYPE|5 30|330 25|{_OF}LinetypeTableRecord|2 DOT|70 0|3 Dot . . . . .|72 65|73 2|40 6.35|49 0|49 -6.35|0 ENDTAB|0 TABLE|2 LAYER|5 24|100 AcDbSymbolTable"),
    _codes((70, "n + 1")), _said(f"0 LAYER|5 31|330 24|{_OF}LayerTableRecord|2 0|70 0|62 7|6 CONTINUOUS|370 -3"), "records", _said("0 ENDTAB|0 TABLE|2 STYLE|5 26|100 AcDbSymbolTable|70 1|0 STYLE"),
    _codes(_HANDLE(50)), _said(f"330 26|{_OF}TextStyleTableRecord|2 STANDARD|70 0|40 0|41 1|50 0|71 0|42 2.5|3 txt|4 |0 ENDTAB|0 TABLE|2 APPID|5 27|100 AcDbSymbolTable|70 1|0 APPID"),
    _codes(_HANDLE(51)), _said(f"330 27|{_OF}RegAppTableRecord|2 ACAD|70 0|0 ENDTAB|0 TABLE|2 BLOCK_RECORD|5 21|100 AcDbSymbolTable|70 2"),
    _said(f"0 BLOCK_RECORD|5 22|330 21|{_OF}BlockTableRecord|2 *MODEL_SPACE|0 BLOCK_RECORD|5 23|330 21|{_OF}BlockTableRecord|2 *PAPER_SPACE|0 ENDTAB|0 ENDSEC|0 SECTION|2 BLOCKS|0 BLOCK"),
    _codes(_HANDLE(52)), _said("330 22|100 AcDbEntity|8 0|100 AcDbBlockBegin|2 *MODEL_SPACE|70 0|10 0|20 0|30 0|3 *MODEL_SPACE|1 |0 ENDBLK"), _codes(_HANDLE(53)), _said("330 22|100 AcDbEntity|8 0|100 AcDbBlockEnd|0 BLOCK"),
    _codes(_HANDLE(54)), _said("330 23|100 AcDbEntity|8 0|100 AcDbBlockBegin|2 *PAPER_SPACE|70 0|10 0|20 0|30 0|3 *PAPER_SPACE|1 |0 ENDBLK"), _codes(_HANDLE(55)), _said("330 23|100 AcDbEntity|8 0|100 AcDbBlockEnd|0 ENDSEC|0 SECTION|2 ENTITIES"),
]


@query(f"""WITH layer_table AS ({ORACLES['drawing_layers']}), extent AS ({ORACLES['drawing_extents']}), entities AS ({ORACLES['export_dxf_entities'].replace("printf('%X', 39 + k)", "printf('%X', 55 + k + (SELECT n FROM layer_table))")})
SELECT 0 AS part, 0::BIGINT AS seq, array_to_string([{', '.join(_HEAD)}], '') AS text FROM layer_table, extent UNION ALL SELECT 1, seq, entity FROM entities
UNION ALL SELECT 2, 0, {_said('0 ENDSEC|0 SECTION|2 OBJECTS|0 DICTIONARY')} || {_codes((5, "printf('%X', 56 + n + (SELECT count(*) FROM entities))"))} || {_said('330 0|100 AcDbDictionary|281 1|0 ENDSEC|0 EOF')} FROM layer_table""")
def document_dxf(spark, sf):
    return D.dxf_document(A.features(spark, sf), layers(spark), unit="m")


@query(f"""SELECT 0 AS part, 0::BIGINT AS seq, '{{"type":"FeatureCollection","name":"plan","features":[' AS text UNION ALL SELECT 2, 0, ']}}' UNION ALL
SELECT 1, seq, CASE WHEN seq > min(seq) OVER () THEN ',' ELSE '' END || geojson FROM ({ORACLES['export_geojson']})""")
def document_geojson(spark, sf):
    return D.geojson_document(A.features(spark, sf))


_LAYERS = f"(VALUES {', '.join(f"({k}, '{n}', '{c}', {w}::DOUBLE)" for k, (n, c, _, w, _) in enumerate(LAYERS, 1))}) ly(k, name, color, lineweight)"


@query(f"""SELECT 0 AS part, 0::BIGINT AS seq, '<?xml version="1.0" encoding="UTF-8"?>' || chr(10) || '<kml xmlns="http://www.opengis.net/kml/2.2">' || chr(10) || '<Document><name>plan</name>' || chr(10) || string_agg(style, chr(10) ORDER BY k) AS text
  FROM (SELECT k, '<Style id="style_' || name || '"><LineStyle><color>ff' || bgr || '</color><width>' || greatest(1, floor(lineweight * 5 + 0.5::DOUBLE)::INT) || '</width></LineStyle><PolyStyle><color>66' || bgr || '</color></PolyStyle></Style>' AS style FROM (SELECT *, color[6:7] || color[4:5] || color[2:3] AS bgr FROM {_LAYERS}))
UNION ALL SELECT 2, 0, '</Document>' || chr(10) || '</kml>' UNION ALL SELECT 1, seq, kml FROM ({ORACLES['export_kml']})""")
def document_kml(spark, sf):
    return D.kml_document(A.features(spark, sf), layers(spark))


@query(f"""WITH parts AS ({ORACLES['export_svg']}), ranks AS (SELECT name AS layer, k AS r FROM {_LAYERS}), used AS (SELECT DISTINCT layer, r FROM parts JOIN ranks USING (layer))
SELECT 0 AS part, 0::BIGINT AS seq, '<?xml version="1.0" encoding="UTF-8"?>' || chr(10) || '<svg xmlns="http://www.w3.org/2000/svg" version="1.1" width="1000" height="800" viewBox="0 0 1000 800">' || chr(10) || '<rect width="100%" height="100%" fill="#0F172A"/>' AS text
UNION ALL SELECT (3 * r + 1)::INT, 0, '<g id="layer_' || layer || '">' FROM used UNION ALL SELECT (3 * r + 2)::INT, seq, svg FROM parts JOIN ranks USING (layer) UNION ALL SELECT (3 * r + 3)::INT, 0, '</g>' FROM used UNION ALL SELECT 2147483647, 0, '</svg>'""")
def document_svg(spark, sf):
    return D.svg_document(A.features(spark, sf), layers(spark), width=1000, height=800)


@query(f"SELECT 0 AS part, 0::BIGINT AS seq, 'Feature_ID,Layer,Classification,Geometry_Type,Confidence,Length_px,Area_px2,Vertex_Count,WKT_Geometry' AS text UNION ALL SELECT 1, seq, line FROM ({ORACLES['export_csv']})")
def document_csv(spark, sf):
    return D.csv_document(A.features(spark, sf))


@query()
def document_shapefiles(spark, sf):
    return D.shapefiles(A.features(spark, sf)).select("file", "part", "seq", F.length("bytes").alias("n"), F.md5("bytes").alias("digest"))
