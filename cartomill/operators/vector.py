"""Joins of points, markers and polygons, and rasterisation.

Theta joins are turned into equi-joins on rows or cells of the plane, so that no
plan needs a nested loop.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cartomill.functions import geometry as G
from cartomill.schemas import HIT_SLOP, PATH_WIDTH

CELL = 64
#: Cells along a pixel row, for rings.
ROW_CELL = 32


def edges(polygons: DataFrame) -> DataFrame:
    """Each ring's edges, closing one included; rings of under three points have none."""
    n = F.size("ring")
    rows = polygons.where(n >= 3).withColumn("_i", F.explode(F.sequence(F.lit(0), n - 1)))
    a, b = F.get("ring", F.col("_i")), F.get("ring", (F.col("_i") + 1) % n)
    return rows.select(*[c for c in polygons.columns if c != "ring"], *[p[c].cast("double").alias(f"{c}{k}") for k, p in ((1, a), (2, b)) for c in "xy"])


def _held(points: DataFrame, polygons: DataFrame) -> DataFrame:
    """(map_id, x, y, poly_id): each distinct place of the points, and the polygons that hold it by the even-odd rule.

    Rings are cut by pixel rows and by cells along them; a place meets only the edges of its own row.
    """
    e = edges(polygons).where("y1 <> y2")
    rows = F.sequence(F.floor(F.least("y1", "y2")), F.floor(F.greatest("y1", "y2")))
    e = e.select("map_id", "poly_id", F.explode(rows).alias("_row"), F.struct("x1", "y1", "x2", "y2").alias("_e"))
    # a pixel more on both sides: rounded crossings may lie beside their edges
    ends = F.floor(F.min(F.least("_e.x1", "_e.x2"))) - 1, F.floor(F.max(F.greatest("_e.x1", "_e.x2"))) + 1
    cut = e.groupBy("map_id", "poly_id", "_row").agg(F.collect_list("_e").alias("_edges"), ends[0].alias("_lo"), ends[1].alias("_hi"))
    cut = cut.withColumn("_cx", F.explode(F.sequence(F.floor(F.col("_lo") / ROW_CELL), F.floor(F.col("_hi") / ROW_CELL))))
    places = points.select("map_id", "x", "y").distinct().withColumns({"_row": F.floor("y"), "_cx": F.floor(F.floor("x") / ROW_CELL)})
    # merged, since Spark takes the cut rings for no larger than the rings and would broadcast them
    met = places.join(cut.hint("merge"), ["map_id", "_row", "_cx"]).where(F.floor("x").between(F.col("_lo"), F.col("_hi")))
    right = lambda e: ((e["y1"] > F.col("y")) != (e["y2"] > F.col("y"))) & (F.col("x") < (e["x2"] - e["x1"]) * (F.col("y") - e["y1"]) / (e["y2"] - e["y1"]) + e["x1"])
    return met.where(F.size(F.filter("_edges", right)) % 2 == 1).select("map_id", "x", "y", "poly_id")


def points_in_polygons(points: DataFrame, polygons: DataFrame) -> DataFrame:
    """(points' columns, poly_id) of even-odd containment.  points: map_id, pt_id, x, y."""
    held = _held(points, polygons).groupBy("map_id", "x", "y").agg(F.collect_list("poly_id").alias("_ids"))
    return points.join(held.hint("merge"), ["map_id", "x", "y"]).select(*points.columns, F.explode("_ids").alias("poly_id"))


def _tops(points: DataFrame, polygons: DataFrame) -> DataFrame:
    return _held(points, polygons).groupBy("map_id", "x", "y").agg(F.max("poly_id").alias("poly_id"))


def topmost(points: DataFrame, polygons: DataFrame) -> DataFrame:
    """(map_id, pt_id, poly_id): the last of the polygons that hold the point."""
    return points.join(_tops(points, polygons).hint("merge"), ["map_id", "x", "y"]).groupBy("map_id", "pt_id").agg(F.max("poly_id").alias("poly_id"))


def last_taps(taps: DataFrame, polygons: DataFrame, value: str) -> DataFrame:
    """(map_id, poly_id, value): of the last tap, by pt_id, whose topmost polygon it is.  taps: (map_id, pt_id, x, y, value)."""
    last = taps.where("pt_id is not null").groupBy("map_id", "x", "y").agg(F.max(F.struct("pt_id", value)).alias("_t"))
    met = last.join(_tops(taps, polygons).hint("merge"), ["map_id", "x", "y"])
    return met.groupBy("map_id", "poly_id").agg(F.max("_t").alias("_t")).select("map_id", "poly_id", F.col("_t")[value].alias(value))


def nearest_marker(points: DataFrame, markers: DataFrame, slop: float = HIT_SLOP) -> DataFrame:
    """(map_id, pt_id, id, d) of the nearest marker within its radius + slop; the first of equals.

    Distinct places meet distinct circles.
    """
    reach = F.col("radius") + slop
    span = lambda c: F.explode(F.sequence(F.floor((F.col(c) - reach) / CELL), F.floor((F.col(c) + reach) / CELL)))
    circles = markers.groupBy("map_id", F.col("x").alias("mx"), F.col("y").alias("my"), "radius").agg(F.min("id").alias("id"))
    cells = circles.withColumn("_cx", span("mx")).withColumn("_cy", span("my"))
    places = points.select("map_id", "x", "y").distinct().withColumns({"_cx": F.floor(F.col("x") / CELL), "_cy": F.floor(F.col("y") / CELL)})
    met = places.join(cells.hint("merge"), ["map_id", "_cx", "_cy"])
    met = met.withColumn("d", F.hypot(F.col("x") - F.col("mx"), F.col("y") - F.col("my"))).where(F.col("d") <= reach)
    best = met.groupBy("map_id", "x", "y").agg(F.min(F.struct("d", "id")).alias("m"))
    return points.join(best.hint("merge"), ["map_id", "x", "y"]).groupBy("map_id", "pt_id").agg(F.min("m").alias("m")).select("map_id", "pt_id", F.col("m.id").alias("id"), F.col("m.d").alias("d"))


def filled(polygons: DataFrame, key: list[str], boundary: bool = True) -> DataFrame:
    """Pixels (key, y, x) of even-odd filled rings; all rings of one key fill together.

    Vertices are rounded.  Each edge is cut by the pixel rows it spans; a row's sorted
    crossings pair up to runs of pixels.  With ``boundary`` the outlines count as filled.
    """
    snapped = polygons.withColumn("ring", F.transform("ring", lambda p: F.struct(F.round(p["x"]).alias("x"), F.round(p["y"]).alias("y"))))
    e = edges(snapped)
    up = e.where("y1 <> y2").withColumn("y", F.explode(F.sequence(F.least("y1", "y2").cast("int"), F.greatest("y1", "y2").cast("int") - 1)))
    at = (F.col("x2") - F.col("x1")) * (F.col("y") - F.col("y1")) / (F.col("y2") - F.col("y1")) + F.col("x1")
    runs = up.groupBy(*key, "y").agg(F.array_sort(F.collect_list(at)).alias("c")).withColumn("_i", F.explode(F.sequence(F.lit(0), F.size("c") - 2, F.lit(2))))
    span = F.sequence(F.ceil(F.get("c", F.col("_i"))).cast("int"), F.ceil(F.get("c", F.col("_i") + 1)).cast("int"))
    inner = runs.select(*key, "y", F.explode(F.slice(span, F.lit(1), F.size(span) - 1)).alias("x"))
    if not boundary:
        return inner
    return inner.unionByName(_traced(e, key)).distinct()


def _traced(e: DataFrame, key: list[str]) -> DataFrame:
    """Pixels of one-pixel lines between whole coordinates."""
    n = F.greatest(F.abs(F.col("x2") - F.col("x1")), F.abs(F.col("y2") - F.col("y1"))).cast("int")
    step = e.withColumn("_n", n).withColumn("_t", F.explode(F.sequence(F.lit(0), F.col("_n"))))
    share = F.when(F.col("_n") > 0, F.col("_t") / F.col("_n")).otherwise(0.0)
    return step.select(*key, F.round(F.col("y1") + share * (F.col("y2") - F.col("y1"))).cast("int").alias("y"), F.round(F.col("x1") + share * (F.col("x2") - F.col("x1"))).cast("int").alias("x"))


def lines(segments: DataFrame, key: list[str], width: int = PATH_WIDTH) -> DataFrame:
    """Pixels (key, y, x) within width / 2 of a segment (x1, y1, x2, y2)."""
    r = width // 2 + 1
    around = segments.select(*key, *[F.col(c).cast("double").alias(c) for c in ("x1", "y1", "x2", "y2")])
    along = _with_steps(around).withColumn("_dx", F.explode(F.sequence(F.lit(-r), F.lit(r)))).withColumn("_dy", F.explode(F.sequence(F.lit(-r), F.lit(r))))
    along = along.withColumns({"x": F.col("_px") + F.col("_dx"), "y": F.col("_py") + F.col("_dy")})
    near = G.to_segment(F.col("x"), F.col("y"), F.col("x1"), F.col("y1"), F.col("x2"), F.col("y2")) <= width / 2
    return along.where(near).select(*key, "y", "x").distinct()


def _with_steps(s: DataFrame) -> DataFrame:
    n = F.ceil(F.greatest(F.abs(F.col("x2") - F.col("x1")), F.abs(F.col("y2") - F.col("y1")))).cast("int")
    s = s.withColumn("_n", n).withColumn("_t", F.explode(F.sequence(F.lit(0), F.col("_n"))))
    share = F.when(F.col("_n") > 0, F.col("_t") / F.col("_n")).otherwise(0.0)
    return s.withColumns({"_px": F.round(F.col("x1") + share * (F.col("x2") - F.col("x1"))).cast("int"), "_py": F.round(F.col("y1") + share * (F.col("y2") - F.col("y1"))).cast("int")})


def largest(polygons: DataFrame) -> DataFrame:
    """Each map's ring of greatest area; the first of equals."""
    w = W.partitionBy("map_id").orderBy(F.desc("area"), "poly_id")
    return polygons.withColumn("area", G.shoelace(F.col("ring"))).withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")
