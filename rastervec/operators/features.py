"""Relational operators on features: joins with layers, roll-ups, topology, picking, editing, fits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rastervec.functions import geometry as G


def layer_rollup(features: DataFrame, layers: DataFrame, *, always: tuple[str, ...] = ("BUILDINGS", "ROADS", "PARCELS")) -> DataFrame:
    """(name, features, area) of layers with a feature, and of those listed; features are summed before they meet the layers."""
    sums = features.groupBy(F.col("layer").alias("name")).agg(F.count("*").alias("features"), F.sum(G.area(F.col("points"))).alias("area"))
    rows = layers.select("name").join(sums, "name", "left").select("name", F.coalesce("features", F.lit(0)).alias("features"), F.coalesce("area", F.lit(0.0)).alias("area"))
    return rows.where((F.col("features") > 0) | F.col("name").isin(*always))


def styled(features: DataFrame, layers: DataFrame, *, how: str = "left") -> DataFrame:
    """Features with the colour of their layer; ``left`` keeps features of unknown layers."""
    return features.join(layers.select(F.col("name").alias("layer"), "color", "visible"), "layer", how)


def visible(features: DataFrame, layers: DataFrame) -> DataFrame:
    return styled(features, layers).where("visible or visible is null")


def safe_layer_name(name: Column) -> Column:
    """Characters that a drawing's names can't have become underscores; at most 255 characters, empty: 0."""
    clean = F.substring(F.regexp_replace(F.regexp_replace(name, r'[<>/\\":;?*|=,]', "_"), r"^\s+|\s+$", ""), 1, 255)
    return F.when(F.coalesce(clean, F.lit("")) == "", "0").otherwise(clean)


def layer_registry(features: DataFrame, layers: DataFrame) -> DataFrame:
    """(safe, name, aci, lineweight, linetype): declared layers, then those of features alone with defaults; of one safe name the first, and always 0."""
    own = layers.select("name", "aci", "lineweight", "linetype", F.lit(0).alias("_from"))
    more = features.select(F.col("layer").alias("name")).distinct().select("name", F.lit(7).alias("aci"), F.lit(0.25).alias("lineweight"), F.lit("CONTINUOUS").alias("linetype"), F.lit(1).alias("_from"))
    zero = features.sparkSession.range(1).select(F.lit("0").alias("name"), F.lit(7).alias("aci"), F.lit(0.25).alias("lineweight"), F.lit("CONTINUOUS").alias("linetype"), F.lit(2).alias("_from"))
    every = own.unionByName(more).unionByName(zero).withColumn("safe", safe_layer_name(F.col("name")))
    first = F.row_number().over(Window.partitionBy("safe").orderBy("_from", "name"))
    return every.withColumn("_k", first).where("_k = 1").select("safe", "name", F.greatest(F.lit(1), F.least(F.lit(255), "aci")).alias("aci"), "lineweight", "linetype")


CLOSED_LAYERS = ("BUILDINGS", "PARCELS")


def topology_issues(features: DataFrame) -> DataFrame:
    """(id, layer, kind, severity, at): open outlines, the first pair of coincident vertices, lines without length."""
    p, open_ = F.col("points"), F.col("layer").isin(*CLOSED_LAYERS) & ~F.col("is_closed")
    close = F.filter(F.transform(G.edges(p, False), lambda e, i: F.struct(i.alias("i"), (G.distance(e["a"], e["b"]) < 0.7).alias("near"))), lambda e: e["near"])
    issue = lambda kind, severity, at: F.struct(F.lit(kind).alias("kind"), F.lit(severity).alias("severity"), at.cast("int").alias("at"))
    found = F.array(
        F.when(open_, issue("UNCLOSED_POLYGON", "ERROR", F.lit(0))),
        F.when(F.size(close) > 0, issue("DUPLICATE_VERTICES", "WARNING", F.get(close, F.lit(0))["i"])),
        F.when((F.size(p) >= 2) & (G.length(p, F.col("is_closed")) < 1.0), issue("ZERO_LENGTH", "ERROR", F.lit(0))),
    )
    return features.select("id", "layer", F.explode(F.filter(found, lambda x: x.isNotNull())).alias("i")).select("id", "layer", "i.*")


def topology_repaired(features: DataFrame) -> DataFrame:
    """Features with at least two points (or POINT and CIRCLE): vertices thinned, outlines closed, slivers merged, area and length anew; modified says if."""
    rows = features.where((F.size("points") >= 2) | F.col("geometry_type").isin("POINT", "CIRCLE"))
    rows = rows.withColumn("_d", G.deduplicated(F.col("points"))).withColumn("_m", F.when(F.size("_d") >= 3, G.without_collinear(F.col("_d"))).otherwise(F.col("_d")))
    shut = F.col("layer").isin(*CLOSED_LAYERS) & ~F.col("is_closed")
    rows = rows.withColumn("modified", (F.size("_m") != F.size("points")) | shut).withColumn("is_closed", F.col("is_closed") | shut).withColumn("points", F.col("_m")).drop("_d", "_m")
    area = F.when(F.col("is_closed") & (F.size("points") >= 3), F.floor(G.area(F.col("points")) + 0.5))
    area = area.otherwise(F.col("area")) if "area" in features.columns else area
    return rows.withColumns({"area": area, "length": F.floor(G.length(F.col("points"), F.col("is_closed")) + 0.5)})


def topology_fixes(features: DataFrame) -> DataFrame:
    """(fixed): how many features topology_repaired() changes or drops."""
    kept = topology_repaired(features).agg(F.count("*").alias("n"), F.coalesce(F.sum(F.col("modified").cast("long")), F.lit(0)).alias("m"))
    every = features.agg(F.count("*").alias("every"))
    return every.join(F.broadcast(kept)).select((F.col("every") - F.col("n") + F.col("m")).alias("fixed"))  # one row on either side


def _is_circle(features: DataFrame) -> Column:
    """Whether a row is a circle with a centre; tables without such columns hold none."""
    return (F.col("geometry_type") == "CIRCLE") & F.col("center").isNotNull() & F.col("radius").isNotNull() if {"geometry_type", "center", "radius"} <= {*features.columns} else F.lit(False)


def boxed(features: DataFrame) -> DataFrame:
    box = G.bounds(F.col("points"))
    if {"center", "radius"} <= {*features.columns}:
        c, r = F.col("center"), F.col("radius")
        box = F.when(_is_circle(features), F.struct((c["x"] - r).alias("min_x"), (c["y"] - r).alias("min_y"), (c["x"] + r).alias("max_x"), (c["y"] + r).alias("max_y"))).otherwise(box)
    return features.withColumn("_box", box)


#: Levels of the grid, each with cells twice as wide as the one before; parts that a segment is cut into; picks that are broadcast at most.
LEVELS, PARTS, MOST_PICKS = 24, 4, 20_000


def _cells(box: Column, cell: float) -> Column:
    """(level, cx, cy) of the cells that a box touches, on the level whose cells are as large as the box: four at most."""
    wide = F.greatest(box["max_x"] - box["min_x"], box["max_y"] - box["min_y"]) / cell
    level = F.when(wide <= 1, 0).otherwise(F.least(F.lit(LEVELS), F.ceil(F.log2(wide)))).cast("int")
    size = F.pow(F.lit(2.0), level) * cell
    along = lambda lo, hi: F.sequence(F.floor(lo / size), F.floor(hi / size))
    return F.flatten(F.transform(along(box["min_x"], box["max_x"]), lambda x: F.transform(along(box["min_y"], box["max_y"]), lambda y: F.struct(level.alias("level"), x.alias("cx"), y.alias("cy")))))


def _widened(box: Column, by: float) -> Column:
    return F.struct(*((box[c] + (by if c.startswith("max") else -by)).alias(c) for c in ("min_x", "min_y", "max_x", "max_y")))


def _within(box: Column) -> Column:
    return F.col("x").between(box["min_x"], box["max_x"]) & F.col("y").between(box["min_y"], box["max_y"])


def picked(features: DataFrame, points: DataFrame, *, tolerance: float, cell: float, interior: bool = True) -> DataFrame:
    """(pick, id): for each of (pick, x, y) the feature with the greatest seq that holds it or has a segment within the tolerance.

    A circle holds what is not farther from its centre than its radius and the tolerance; without ``interior`` circles are not picked. What is picked depends on the place alone, so
    picks of one place are looked up once. Features and places meet on grids of LEVELS widths:
    a segment is cut into PARTS, and the box of each, widened by the tolerance, is sent to the few cells it touches on the level of its own size, so a segment has at most
    4 * PARTS copies however long it is; a closed outline or circle goes the same way by its box. What lies outside the bounds of all places is left out before.
    A place looks on all levels, must lie in the box, and only then is measured."""
    places = points.select("x", "y").distinct()
    span = places.agg(F.count("*").alias("n"), *(f(c).alias(f"{f.__name__}_{c}") for c in "xy" for f in (F.min, F.max))).first()
    q = places.select("x", "y", F.explode(F.sequence(F.lit(0), F.lit(LEVELS))).alias("level"))
    size = F.pow(F.lit(2.0), F.col("level")) * cell
    q = q.withColumns({"cx": F.floor(F.col("x") / size), "cy": F.floor(F.col("y") / size)})
    q = F.broadcast(q) if span["n"] <= MOST_PICKS else q
    here, on = G.point(F.col("x"), F.col("y")), ["level", "cx", "cy"]
    reached = lambda low, high, c, by: (high >= F.lit(span[f"min_{c}"]).cast("double") - by) & (low <= F.lit(span[f"max_{c}"]).cast("double") + by)
    over = lambda box, by: reached(box["min_x"], box["max_x"], "x", by) & reached(box["min_y"], box["max_y"], "y", by)
    met = lambda rows, box: rows.withColumn("_box", box).select("*", F.inline(_cells(F.col("_box"), cell))).join(q, on).where(_within(F.col("_box")))
    circle, near = _is_circle(features), tolerance + 1e-6
    at = lambda k: G.point(F.col("a.x") + (F.col("b.x") - F.col("a.x")) * k / PARTS, F.col("a.y") + (F.col("b.y") - F.col("a.y")) * k / PARTS)
    lines = features.where(~F.coalesce(circle, F.lit(False))).where(over(G.bounds(F.col("points")), near)).select("id", "seq", F.inline(G.edges(F.col("points"), False)))
    lines = lines.where(over(G.bounds(F.array("a", "b")), near)).select("*", F.explode(F.array(*(_widened(G.bounds(F.array(at(k), at(k + 1))), near) for k in range(PARTS)))).alias("box")).where(over(F.col("box"), 0.0))
    hits = met(lines, F.col("box")).where(G.segment_distance(here, F.col("a"), F.col("b")) <= tolerance).select("x", "y", "id", "seq")
    if interior:
        shut = boxed(features).where("_box.min_x is not null").withColumn("_round", circle)
        shut = shut.where(F.col("_round") | (F.col("is_closed") & (F.size("points") >= 3)))
        held, wide = G.contains(F.col("points"), here), F.when(F.col("_round"), tolerance).otherwise(0.0) + 1e-6
        if {"center", "radius"} <= {*features.columns}:
            held = F.when(F.col("_round"), G.distance(here, F.col("center")) <= F.col("radius") + tolerance).otherwise(held)
        hits = hits.unionByName(met(shut.where(over(F.col("_box"), wide)), _widened(F.col("_box"), wide)).where(held).select("x", "y", "id", "seq"))
    best = hits.groupBy("x", "y").agg(F.max_by("id", "seq").alias("id"), F.max("seq").alias("seq"))
    return points.select("pick", "x", "y").join(F.broadcast(best) if span["n"] <= MOST_PICKS else best, ["x", "y"]).groupBy("pick").agg(F.max_by("id", "seq").alias("id"))


def circle_fit(points: DataFrame) -> DataFrame:
    """(id, cx, cy, radius, error) by Kasa's method over rows (id, x, y); no row where the points lie on a line. radius: mean distance from the centre; error: mean difference from it."""
    m = points.groupBy("id").agg(F.count("*").alias("n"), F.avg("x").alias("mx"), F.avg("y").alias("my"))
    u = points.join(m, "id").withColumns({"u": F.col("x") - F.col("mx"), "v": F.col("y") - F.col("my")})
    s = u.groupBy("id").agg(
        *(F.sum(F.expr(e)).alias(n) for n, e in (("uu", "u*u"), ("vv", "v*v"), ("uv", "u*v"), ("uuu", "u*u*u"), ("vvv", "v*v*v"), ("uvv", "u*v*v"), ("vuu", "v*u*u"))), F.first("mx").alias("mx"), F.first("my").alias("my"), F.first("n").alias("n"),
    )
    s = s.withColumn("det", F.expr("uu*vv - uv*uv")).where("abs(det) >= 1e-7 and n >= 3")
    s = s.withColumns({"a": F.expr("0.5*(uuu+uvv)"), "b": F.expr("0.5*(vvv+vuu)")}).withColumns({"uc": F.expr("(a*vv - b*uv)/det"), "vc": F.expr("(b*uu - a*uv)/det")})
    s = s.select("id", F.expr("uc+mx").alias("cx"), F.expr("vc+my").alias("cy"))
    far = points.join(s, "id").withColumn("d", F.expr("sqrt((x-cx)*(x-cx)+(y-cy)*(y-cy))"))
    far = far.withColumn("radius", F.avg("d").over(Window.partitionBy("id")))
    return far.groupBy("id", "cx", "cy", "radius").agg(F.avg(F.abs(F.col("d") - F.col("radius"))).alias("error"))


def affine_fit(points: DataFrame) -> DataFrame:
    """(a, b, c, d, e, f, rmse, n): the least-squares affine map of (pixel_x, pixel_y) to (world_x, world_y). Sums first, then algebra on one row.

    No row for fewer than three points or points on a line. The sums are taken about the means for accuracy."""
    p = points.select(*(F.col(c).alias(n) for c, n in (("pixel_x", "x"), ("pixel_y", "y"), ("world_x", "u"), ("world_y", "v"))))
    s = p.agg(F.count("*").alias("n"), *(F.avg(c).alias(f"m{c}") for c in "xyuv"), *(F.expr(f"covar_pop({a},{b})").alias(a + b) for a, b in ("xx", "yy", "xy", "xu", "yu", "xv", "yv")))
    s = s.withColumn("det", F.expr("xx*yy - xy*xy")).where("n >= 3 and abs(det) >= 1e-9")
    s = s.withColumns({k: F.expr(e) for k, e in (("a", "(xu*yy - yu*xy)/det"), ("b", "(yu*xx - xu*xy)/det"), ("d", "(xv*yy - yv*xy)/det"), ("e", "(yv*xx - xv*xy)/det"))})
    s = s.withColumns({"c": F.expr("mu - a*mx - b*my"), "f": F.expr("mv - d*mx - e*my")}).select("n", *"abcdef")
    off = p.crossJoin(F.broadcast(s)).agg(F.sqrt(F.avg(F.expr("(a*x+b*y+c-u)*(a*x+b*y+c-u) + (d*x+e*y+f-v)*(d*x+e*y+f-v)"))).alias("rmse"))  # one row on the right
    return s.crossJoin(F.broadcast(off))


def calibrated(rows: DataFrame) -> DataFrame:
    """(id, pixel_distance, metres_per_pixel) from (id, x1, y1, x2, y2, known, unit): a known distance between two points; an error below one pixel."""
    pixels = F.sqrt(F.expr("(x2-x1)*(x2-x1) + (y2-y1)*(y2-y1)"))
    metres = F.col("known") * F.when(F.col("unit") == "ft", 0.3048).when(F.col("unit") == "cm", 0.01).otherwise(1.0)
    checked = F.when(pixels < 1, F.raise_error("points are less than a pixel apart").cast("double")).otherwise(pixels)
    return rows.select("id", F.round(checked, 1).alias("pixel_distance"), F.round(metres / checked, 4).alias("metres_per_pixel"))


def at_version(log: DataFrame, version: int) -> DataFrame:
    """The features as of a version of an edit log (version, id, deleted, ...): for each id its last row up to there, if that isn't a deletion."""
    columns = [c for c in log.columns if c != "id"]
    last = log.where(F.col("version") <= version).groupBy("id").agg(F.max_by(F.struct(*columns), "version").alias("_r"))
    return last.select("id", "_r.*").where("not deleted")
