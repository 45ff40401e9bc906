"""Pictures for people: overlays on photos, and crops around controls for reading their codes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cartomill.functions import color
from cartomill.operators import vector

#: (class, blue, green, red).
COLOURS = [
    ("clearing", 80, 210, 250), ("forest", 90, 160, 60), ("thicket", 40, 100, 20), ("rock", 120, 120, 120), ("marsh", 200, 180, 60), ("water", 220, 120, 30),
    ("out_of_bounds", 150, 60, 160), ("path", 200, 200, 0), ("course_leg", 180, 0, 200), ("control", 180, 0, 220), ("route", 0, 0, 255),
]


def overlay(pixels: DataFrame, polygons: DataFrame, segments: DataFrame, controls: DataFrame, route_points: DataFrame) -> DataFrame:
    """Pixels with areas blended over the photo, and lines, circles and the route drawn on top; later layers hide earlier ones."""
    shades = F.broadcast(pixels.sparkSession.createDataFrame([(c, i, *v) for i, (c, *v) in enumerate(COLOURS)], "kind string, rank int, cb int, cg int, cr int"))
    areas = vector.filled(polygons, ["map_id", "class_name"]).select("map_id", "y", "x", F.col("class_name").alias("kind"))
    drawn = vector.lines(segments, ["map_id", "role"], 2).select("map_id", "y", "x", F.col("role").alias("kind"))
    turn = F.explode(F.transform(F.sequence(F.lit(0), F.lit(359)), lambda i: 2 * F.pi() * i / 360))
    rim = controls.withColumn("_t", turn).select("map_id", F.round(F.col("y") + F.col("radius") * F.sin("_t")).cast("int").alias("y"), F.round(F.col("x") + F.col("radius") * F.cos("_t")).cast("int").alias("x"), F.lit("control").alias("kind"))
    way = route_points.select("map_id", F.col("y").cast("int"), F.col("x").cast("int"), F.lit("route").alias("kind"))
    top = lambda df: df.join(shades, "kind").groupBy("map_id", "y", "x").agg(F.max(F.struct("rank", "cb", "cg", "cr")).alias("c"))
    out = pixels.join(top(areas), ["map_id", "y", "x"], "left")
    out = out.select("map_id", "y", "x", *[F.coalesce(color.blended(F.col(f"c.c{n}"), F.col(n)), F.col(n)).alias(n) for n in "bgr"])
    out = out.join(top(drawn.unionByName(rim).unionByName(way)), ["map_id", "y", "x"], "left")
    return out.select("map_id", "y", "x", *[F.coalesce(f"c.c{n}", n).alias(n) for n in "bgr"])


def reading_crops(pixels: DataFrame, controls: DataFrame, col: str, reach: float = 6.0, blank: float = 1.6, zoom: int = 3) -> DataFrame:
    """(map_id, seq, y, x, col): squares of ``reach`` radii about each control, its circle blanked to 0, enlarged by repeating pixels.

    Rows of the square meet pixels in an equi-join; what lies outside the raster is left out.
    """
    r = F.col("radius") * reach
    box = controls.select("map_id", "seq", F.col("x").cast("double").alias("cx"), F.col("y").cast("double").alias("cy"), "radius", F.ceil(F.col("x") - r).cast("int").alias("x0"), F.floor(F.col("x") + r).cast("int").alias("x1"), F.ceil(F.col("y") - r).cast("int").alias("y0"), F.floor(F.col("y") + r).cast("int").alias("y1"))
    met = pixels.select("map_id", "y", "x", col).join(box.withColumn("y", F.explode(F.sequence("y0", "y1"))), ["map_id", "y"]).where(F.col("x").between(F.col("x0"), F.col("x1")))
    near = F.hypot(F.col("x") - F.col("cx"), F.col("y") - F.col("cy")) <= blank * F.col("radius")
    met = met.withColumn(col, F.when(near, 0).otherwise(F.col(col))).withColumn("_i", F.explode(F.sequence(F.lit(0), F.lit(zoom - 1)))).withColumn("_j", F.explode(F.sequence(F.lit(0), F.lit(zoom - 1))))
    return met.select("map_id", "seq", ((F.col("y") - F.col("y0")) * zoom + F.col("_i")).alias("y"), ((F.col("x") - F.col("x0")) * zoom + F.col("_j")).alias("x"), col)


def ranked(shares: DataFrame) -> DataFrame:
    """Fractions of each route, greatest first, with their place."""
    return shares.withColumn("place", F.row_number().over(W.partitionBy("map_id", "route_id").orderBy(F.desc("fraction"), "class_name")))
