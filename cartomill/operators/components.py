"""Connected components of masks, and holes in them.

Rows of a mask become runs of pixels first, so that the graph has a node for each
run; runs of neighbouring rows meet in an equi-join.  Components are found by
alternating large-star and small-star rounds.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cartomill.operators.raster import sizes
from cartomill.schemas import MIN_HATCH_HOLES, MIN_HOLE_AREA
from cartomill.storage import written

#: Columns of one strip in which runs of neighbouring rows are matched.
STRIP = 64


def runs(mask: DataFrame) -> DataFrame:
    """(map_id, y, x0, x1) of the pixels (map_id, y, x)."""
    w = W.partitionBy("map_id", "y").orderBy("x")
    rows = mask.select("map_id", "y", "x").distinct().withColumn("_g", F.col("x") - F.row_number().over(w))
    return rows.groupBy("map_id", "y", "_g").agg(F.min("x").alias("x0"), F.max("x").alias("x1")).drop("_g")


def connected(links: DataFrame) -> DataFrame:
    """(node, comp): comp is the component's least node."""
    edges = written(links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "links")
    before = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("m", "u"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        small = large.groupBy("u").agg(F.min("v").alias("m"))
        edges = written(large.join(small, "u").select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v")).where("u <> v").distinct(), "links")
        state = edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first()
        if state == before:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("comp"))
        before = state


def labelled(mask: DataFrame, diagonal: bool = True) -> DataFrame:
    """(map_id, y, x0, x1, label): runs with the least (y, x) of their component, as y * 2**32 + x."""
    r = runs(mask).withColumn("node", F.shiftleft(F.col("y").cast("long"), 32) + F.col("x0"))
    r = written(r, "runs")
    reach = 1 if diagonal else 0
    strip = lambda lo, hi: F.explode(F.sequence(F.floor(F.col(lo) / STRIP), F.floor((F.col(hi) + reach) / STRIP)))
    above = r.select("map_id", (F.col("y") + 1).alias("y"), F.col("x0").alias("ax0"), F.col("x1").alias("ax1"), F.col("node").alias("a")).withColumn("_s", F.explode(F.sequence(F.floor((F.col("ax0") - reach) / STRIP), F.floor((F.col("ax1") + reach) / STRIP))))
    below = r.select("map_id", "y", "x0", "x1", F.col("node").alias("b")).withColumn("_s", strip("x0", "x1"))
    met = above.join(below, ["map_id", "y", "_s"]).where((F.col("ax0") <= F.col("x1") + reach) & (F.col("ax1") >= F.col("x0") - reach))
    key = lambda c: F.struct("map_id", F.col(c).alias("n"))
    comp = connected(met.select(key("a").alias("a"), key("b").alias("b"))).select(F.col("node.map_id").alias("map_id"), F.col("node.n").alias("node"), F.col("comp.n").alias("comp"))
    return r.join(comp, ["map_id", "node"], "left").select("map_id", "y", "x0", "x1", F.coalesce("comp", "node").alias("label"))


def label_pixels(mask: DataFrame, diagonal: bool = True) -> DataFrame:
    return labelled(mask, diagonal).select("map_id", "y", F.explode(F.sequence("x0", "x1")).alias("x"), "label")


def areas(mask: DataFrame, diagonal: bool = True) -> DataFrame:
    """(map_id, label, area, bounds)."""
    return labelled(mask, diagonal).groupBy("map_id", "label").agg(F.sum(F.col("x1") - F.col("x0") + 1).alias("area"), F.min("x0").alias("x0"), F.min("y").alias("y0"), F.max("x1").alias("x1"), F.max("y").alias("y1"))


def holes(grid: DataFrame, col: str) -> DataFrame:
    """(map_id, hole, parent, area): background components (4-connected) that don't touch the frame, with the component around them.

    grid: the whole raster with an on/off column.  The pixel left of a hole's first pixel
    belongs to the component around it.
    """
    back = labelled(grid.where(F.col(col) == 0), diagonal=False).join(sizes(grid), "map_id")
    frame = F.max(((F.col("y") == 0) | (F.col("y") == F.col("h") - 1) | (F.col("x0") == 0) | (F.col("x1") == F.col("w") - 1)).cast("int"))
    inner = back.groupBy("map_id", "label").agg(frame.alias("_f"), F.sum(F.col("x1") - F.col("x0") + 1).alias("area")).where("_f = 0")
    inner = inner.select("map_id", F.col("label").alias("hole"), "area", F.shiftright("label", 32).cast("int").alias("y"), (F.col("label").bitwiseAND(0xFFFFFFFF) - 1).cast("int").alias("x"))
    return inner.join(label_pixels(grid.where(F.col(col) == 1)), ["map_id", "y", "x"]).select("map_id", "hole", F.col("label").alias("parent"), "area")


def hatched(grid: DataFrame, col: str, least: int = MIN_HATCH_HOLES, hole_area: float = MIN_HOLE_AREA) -> DataFrame:
    """(map_id, label) of components with at least ``least`` holes over ``hole_area``: hatched areas."""
    big = holes(grid, col).where(F.col("area") > hole_area)
    return big.groupBy("map_id", F.col("parent").alias("label")).agg(F.count("*").alias("holes")).where(F.col("holes") >= least)
