"""Line segments: attributes, one-dimensional clusters, regular spacing, votes for straight lines."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cartomill.functions import geometry as G
from cartomill.schemas import NORTH_TOLERANCE_DEG


def polar(segments: DataFrame, min_length: float = 0.0) -> DataFrame:
    """Adds length, angle, mid_x and mid_y; drops shorter segments."""
    ends = [F.col(c).cast("double") for c in ("x1", "y1", "x2", "y2")]
    out = segments.withColumns({"length": G.length(*ends), "angle": G.angle(*ends), "mid_x": (ends[0] + ends[2]) / 2, "mid_y": (ends[1] + ends[3]) / 2})
    return out.where(F.col("length") >= min_length)


def without_border(segments: DataFrame, width: float, height: float, margin: float = 0.03) -> DataFrame:
    return segments.where(F.col("mid_x").between(margin * width, (1 - margin) * width) & F.col("mid_y").between(margin * height, (1 - margin) * height))


def near_vertical(segments: DataFrame, tolerance: float = NORTH_TOLERANCE_DEG) -> DataFrame:
    return segments.where(F.abs(F.col("angle") - 90) <= tolerance)


def gap_clusters(df: DataFrame, key: list[str], col: str, gap: float, tie: list[str]) -> DataFrame:
    """Adds cluster: a new one starts where the gap to the member before exceeds ``gap``."""
    w = W.partitionBy(*key).orderBy(col, *tie)
    new = (F.col(col) - F.lag(col).over(w) > gap).cast("int")
    return df.withColumn("_new", F.coalesce(new, F.lit(0))).withColumn("cluster", F.sum("_new").over(w.rowsBetween(W.unboundedPreceding, 0))).drop("_new")


def cluster_centres(df: DataFrame, key: list[str], least: int, span: float) -> DataFrame:
    """Clusters of at least ``least`` members that reach over ``span`` in y: (key, cluster, centre, n)."""
    rows = df.groupBy(*key, "cluster").agg(F.count("*").alias("n"), (F.max("mid_y") - F.min("mid_y")).alias("_span"), F.avg("mid_x").alias("centre"))
    return rows.where((F.col("n") >= least) & (F.col("_span") >= span)).drop("_span")


def spacing(centres: DataFrame, key: list[str], tolerance: float = 0.4) -> DataFrame:
    """(key, kept array<double>, spacing): regular lines.

    The first centre is kept, and each whose gap to the one before differs from the median
    gap by less than ``tolerance`` of it.  spacing: median gap of those kept; null for under
    three centres, all of which are kept then.
    """
    w = W.partitionBy(*key).orderBy("centre")
    rows = centres.withColumn("gap", F.col("centre") - F.lag("centre").over(w))
    stats = rows.groupBy(*key).agg(F.count("*").alias("_all"), F.median("gap").alias("mid"))
    rows = rows.join(stats, key)
    regular = F.abs(F.col("gap") - F.col("mid")) / F.greatest(F.col("mid"), F.lit(1e-6)) < tolerance
    kept = rows.where((F.col("_all") < 3) | F.col("gap").isNull() | regular)
    kept = kept.withColumn("kept_gap", F.when(F.col("_all") >= 3, F.col("centre") - F.lag("centre").over(w)))
    return kept.groupBy(*key).agg(F.array_sort(F.collect_list("centre")).alias("kept"), F.median("kept_gap").alias("spacing"))


def line_votes(pixels: DataFrame, threshold: int, steps: int = 180) -> DataFrame:
    """(map_id, theta, rho, votes) of lines x cos + y sin = rho that at least ``threshold`` pixels lie on.

    pixels: (map_id, y, x), the edge pixels.  Votes are summed before the shuffle.
    """
    k = F.explode(F.sequence(F.lit(0), F.lit(steps - 1)))
    rows = pixels.select("map_id", "x", "y", k.alias("theta"))
    angle = F.col("theta") * (math.pi / steps)
    rho = F.round(F.round(F.col("x") * F.cos(angle) + F.col("y") * F.sin(angle), 6)).cast("int")
    return rows.groupBy("map_id", "theta", rho.alias("rho")).agg(F.count("*").alias("votes")).where(F.col("votes") >= threshold)


def line_segments(pixels: DataFrame, threshold: int, min_length: float, max_gap: float, steps: int = 180, consume: bool = False) -> DataFrame:
    """Runs of pixels along the lines that line_votes() finds: (map_id, theta, rho, x1, y1, x2, y2).

    consume: a pixel counts only for the line with the most votes through it, so that one
    drawn line doesn't come back as a bundle.
    """
    found = line_votes(pixels, threshold, steps)
    angle = F.col("theta") * (math.pi / steps)
    rho = F.round(F.round(F.col("x") * F.cos(angle) + F.col("y") * F.sin(angle), 6)).cast("int")
    on = pixels.select("map_id", "x", "y", F.explode(F.sequence(F.lit(0), F.lit(steps - 1))).alias("theta")).withColumn("rho", rho).join(found, ["map_id", "theta", "rho"])
    if consume:
        best = W.partitionBy("map_id", "x", "y").orderBy(F.desc("votes"), "theta", "rho")
        on = on.withColumn("_best", F.row_number().over(best)).where("_best = 1").drop("_best")
    on = on.withColumn("along", F.col("y") * F.cos(angle) - F.col("x") * F.sin(angle))
    runs = gap_clusters(on, ["map_id", "theta", "rho"], "along", max_gap, ["x", "y"])
    ends = runs.groupBy("map_id", "theta", "rho", "cluster").agg(F.min_by(F.struct("x", "y"), "along").alias("a"), F.max_by(F.struct("x", "y"), "along").alias("b"))
    out = ends.select("map_id", "theta", "rho", F.col("a.x").alias("x1"), F.col("a.y").alias("y1"), F.col("b.x").alias("x2"), F.col("b.y").alias("y2"))
    return out.where(F.hypot(F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")) >= min_length)
