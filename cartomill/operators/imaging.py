"""Operators that Spark's own functions can't express: edges, medians, contours, warps.

Each takes one map (or one component of it) at a time, as Arrow batches; maps
are independent, and a working raster is bounded (see WORKING_MAX_SIDE).
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cartomill.functions import geometry as G
from cartomill.functions import shapes
from cartomill.operators import components, course, lines, raster
from cartomill.schemas import BLUR, MIN_PAPER_SHARE, MIN_POLYGON_AREA, MIN_QUAD_HULL, SIMPLIFY_EPS

RING = "array<struct<x:double,y:double>>"
RING_TYPE = T.ArrayType(T.StructType([T.StructField("x", T.DoubleType()), T.StructField("y", T.DoubleType())]))


def per_map(df: DataFrame, cols: list[str], out: str, f: Callable[..., np.ndarray]) -> DataFrame:
    """Adds an int column: f of the columns as whole rasters (0 in gaps)."""

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        shape = (int(pdf.y.max()) + 1, int(pdf.x.max()) + 1)
        grids = []
        for c in cols:
            g = np.zeros(shape, np.int64)
            g[pdf.y, pdf.x] = pdf[c]
            grids.append(g)
        return pdf.assign(**{out: f(*grids)[pdf.y, pdf.x].astype(np.int32)})

    return df.groupBy("map_id").applyInPandas(one, df.withColumn(out, F.lit(0)).schema)


def edges(df: DataFrame, col: str, low: float, high: float, out: str = "edge") -> DataFrame:
    return per_map(df, [col], out, lambda g: shapes.canny(g, low, high))


def median(df: DataFrame, col: str, k: int = BLUR, out: str | None = None) -> DataFrame:
    return per_map(df, [col], out or f"{col}_median", lambda g: shapes.median_filter(g, k))


def medians(df: DataFrame, cols: list[str], k: int = BLUR) -> DataFrame:
    """(map_id, y, x, cols): each column's medians over whole rasters, in one pass over the maps."""

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        shape = (int(pdf.y.max()) + 1, int(pdf.x.max()) + 1)
        out = {}
        for c in cols:
            grid = np.zeros(shape, np.int64)
            grid[pdf.y, pdf.x] = pdf[c]
            out[c] = shapes.median_filter(grid, k)[pdf.y, pdf.x].astype(np.int32)
        return pdf.assign(**out)

    rows = df.select("map_id", F.col("y").cast("int").alias("y"), F.col("x").cast("int").alias("x"), *[F.col(c).cast("int").alias(c) for c in cols])
    return rows.groupBy("map_id").applyInPandas(one, rows.schema)


def rock(df: DataFrame, gray: str, light: str, share: float = 0.18) -> DataFrame:
    """Light pixels in whose 15 x 15 neighbourhood over ``share`` are edges."""
    df = raster.box_mean(edges(df, gray, 60, 150, "_edge"), "_edge", 15, 15, "_share")
    return df.withColumn("rock", (F.col("_share") > share) & (F.col(light) == 1)).drop("_edge", "_share")


@F.pandas_udf(RING_TYPE)
def _simplified(rings: pd.Series, eps: pd.Series) -> pd.Series:
    return pd.Series([None if r is None else [{"x": x, "y": y} for x, y in shapes.simplified([(p["x"], p["y"]) for p in r], e)] for r, e in zip(rings, eps, strict=True)])


def simplified(ring: Column, eps: float = SIMPLIFY_EPS) -> Column:
    return _simplified(ring.cast(RING), F.lit(float(eps)))


@F.pandas_udf(RING_TYPE)
def hull(rings: pd.Series) -> pd.Series:
    return pd.Series([None if r is None else [{"x": x, "y": y} for x, y in shapes.hull([(p["x"], p["y"]) for p in r])] for r in rings])


@F.pandas_udf(T.BooleanType())
def is_simple(rings: pd.Series) -> pd.Series:
    return pd.Series([None if r is None else shapes.is_simple([(p["x"], p["y"]) for p in r]) for r in rings])


RINGS_TYPE = T.ArrayType(RING_TYPE)


@F.pandas_udf(RINGS_TYPE)
def simple_parts(rings: pd.Series) -> pd.Series:
    """Rings without crossings that a ring falls into at its crossings; a simple ring is its only part."""
    return pd.Series([None if r is None else [[{"x": x, "y": y} for x, y in part] for part in shapes.simple_parts([(p["x"], p["y"]) for p in r])] for r in rings])


@F.pandas_udf(RING_TYPE)
def approximated(rings: pd.Series, share: pd.Series) -> pd.Series:
    """Each ring simplified by a share of its own length."""
    out = []
    for r, e in zip(rings, share, strict=True):
        points = None if r is None else [(p["x"], p["y"]) for p in r]
        out.append(None if points is None else [{"x": x, "y": y} for x, y in shapes.simplified(points, e * shapes.arc_length(points))])
    return pd.Series(out)


def contours(mask: DataFrame) -> DataFrame:
    """(map_id, label, ring): outer contours of the components of (map_id, y, x)."""

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        y0, x0 = int(pdf.y.min()), int(pdf.x0.min())
        grid = np.zeros((int(pdf.y.max()) - y0 + 1, int(pdf.x1.max()) - x0 + 1), bool)
        for y, a, b in zip(pdf.y, pdf.x0, pdf.x1, strict=True):
            grid[y - y0, a - x0 : b - x0 + 1] = True
        ring = [{"x": x + x0, "y": y + y0} for x, y in shapes.outline(grid)]
        return pd.DataFrame({"map_id": [pdf.map_id.iloc[0]], "label": [pdf.label.iloc[0]], "ring": [ring]})

    return components.labelled(mask).groupBy("map_id", "label").applyInPandas(one, f"map_id string, label long, ring {RING}")


def polygons(grid: DataFrame, col: str, least: float = MIN_POLYGON_AREA, eps: float = SIMPLIFY_EPS) -> DataFrame:
    """(map_id, label, ring): closed mask's contours, large enough before and after simplification."""
    closed = raster.closing(grid.withColumn(col, F.col(col).cast("int")), col, 5)
    rows = contours(closed.where(F.col(col) == 1)).where(G.shoelace(F.col("ring")) >= least)
    rows = rows.withColumn("ring", F.explode(simple_parts(simplified(F.col("ring"), eps))))
    return rows.where((F.size("ring") >= 3) & (G.shoelace(F.col("ring")) >= least))


def hatched_polygons(grid: DataFrame, col: str, least: float = MIN_POLYGON_AREA) -> DataFrame:
    """Like polygons(), of components with several holes only."""
    closed = raster.closing(grid.withColumn(col, F.col(col).cast("int")), col, 5)
    kept = contours(closed.where(F.col(col) == 1)).join(components.hatched(closed, col).select("map_id", "label"), ["map_id", "label"])
    kept = kept.where(G.shoelace(F.col("ring")) >= least).withColumn("ring", simplified(F.col("ring")))
    return kept.where(F.size("ring") >= 3)


def paper(df: DataFrame) -> DataFrame:
    """(map_id, quad): corners, in order, of the largest contour of smoothed edges if it fills a quarter of the photo."""
    g = raster.gaussian5(raster.with_hsv(df), "gray", "soft")
    e = raster.dilate(edges(g, "soft", 40, 120), "edge", 5, 2)
    found = contours(e.where("edge = 1")).withColumn("area", G.shoelace(F.col("ring")))
    best = found.groupBy("map_id").agg(F.max_by(F.struct("ring", "area"), F.struct("area", -F.col("label"))).alias("b")).join(raster.sizes(df), "map_id")
    best = best.where(F.col("b.area") >= MIN_PAPER_SHARE * F.col("w") * F.col("h"))

    @F.pandas_udf(RING_TYPE)
    def quad(rings: pd.Series) -> pd.Series:
        return pd.Series([[{"x": x, "y": y} for x, y in shapes.quadrilateral([(p["x"], p["y"]) for p in r], MIN_QUAD_HULL)] for r in rings])

    c = G.corners(F.col("q"))
    return best.withColumn("q", quad(F.col("b.ring"))).select("map_id", F.array(c["tl"], c["tr"], c["br"], c["bl"]).alias("quad"))


def rectified(df: DataFrame, quads: DataFrame) -> DataFrame:
    """Pixels (map_id, y, x, b, g, r) with each map's quad made upright; maps without one stay."""

    def one(key: tuple, pdf: pd.DataFrame, q: pd.DataFrame) -> pd.DataFrame:
        img = np.zeros((int(pdf.y.max()) + 1, int(pdf.x.max()) + 1, 3), np.int32)
        img[pdf.y, pdf.x] = pdf[["b", "g", "r"]].to_numpy()
        if len(q):
            img = shapes.warped(img, [(p["x"], p["y"]) for p in q.quad.iloc[0]])
        ys, xs = np.indices(img.shape[:2])
        return pd.DataFrame({"map_id": key[0], "y": ys.ravel(), "x": xs.ravel(), **{c: img[..., i].ravel() for i, c in enumerate("bgr")}})

    return df.select("map_id", "y", "x", "b", "g", "r").groupBy("map_id").cogroup(quads.groupBy("map_id")).applyInPandas(one, "map_id string, y int, x int, b int, g int, r int")


def circles(ink: DataFrame, dims: DataFrame, votes: float, low: float = 0.006, high: float = 0.02) -> DataFrame:
    """(map_id, x, y, radius, strength): centres that ink pixels vote for along their gradient, the peaks among them.

    ink: (map_id, y, x, v) with v 0 or 255, without gaps.  Radii are shares of the diagonal.
    """
    diag = F.sqrt(F.col("w") * F.col("w") + F.col("h") * F.col("h"))
    g = raster.sobel(raster.gaussian5(ink, "v", "soft"), "soft").where("dx <> 0 or dy <> 0").where(F.abs("dx") + F.abs("dy") > 120)
    g = g.join(dims.select("map_id", F.greatest(F.lit(1), (low * diag).cast("int")).alias("r0"), F.greatest(F.lit(2), (high * diag).cast("int")).alias("r1")), "map_id")
    norm = F.hypot(F.col("dx"), F.col("dy"))
    rays = g.withColumn("r", F.explode(F.sequence("r0", "r1"))).withColumn("sign", F.explode(F.array(F.lit(-1), F.lit(1))))
    rays = rays.select("map_id", "r", F.round(F.col("x") + F.col("sign") * F.col("r") * F.col("dx") / norm).cast("int").alias("x"), F.round(F.col("y") + F.col("sign") * F.col("r") * F.col("dy") / norm).cast("int").alias("y"))
    count = rays.groupBy("map_id", "y", "x", "r").agg(F.count("*").alias("n"))
    best = count.groupBy("map_id", "y", "x").agg(F.sum("n").alias("strength"), F.max_by("r", F.struct("n", -F.col("r"))).alias("radius")).where(F.col("strength") >= votes)
    return peaks(best).select("map_id", *[F.col(c).cast("double").alias(c) for c in ("x", "y", "radius", "strength")])


def peaks(cells: DataFrame) -> DataFrame:
    """Those of (map_id, y, x, strength, ...) that no neighbouring cell outdoes; of equal neighbours the first by y and x stays."""
    rank = F.struct("strength", (-F.col("y")).alias("u"), (-F.col("x")).alias("l"))
    near = cells.select("map_id", "y", "x", rank.alias("rank"))
    for c in "yx":
        near = near.withColumn(c, F.explode(F.array(F.col(c) - 1, F.col(c), F.col(c) + 1)))
    most = near.groupBy("map_id", "y", "x").agg(F.max("rank").alias("most"))
    return cells.join(most, ["map_id", "y", "x"]).where(rank == F.col("most")).drop("most")


def spaced(circles: DataFrame, dims: DataFrame, share: float = 0.02) -> DataFrame:
    """Circles, strongest first, no two of a map nearer than ``share`` of its diagonal.

    Strengths decide in a few hundred peaks of a map, of which one row is folded.
    """
    far = dims.select("map_id", (share * F.sqrt(F.col("w") * F.col("w") + F.col("h") * F.col("h"))).alias("far"))
    order = F.array_sort(F.collect_list(F.struct((-F.col("strength")).alias("s"), "x", "y", "radius")))
    near = lambda c, far: lambda k: F.hypot(k["x"] - c["x"], k["y"] - c["y"]) < far
    kept = F.aggregate("all", F.slice("all", 1, 0), lambda acc, c: F.when(F.exists(acc, near(c, F.col("far"))), acc).otherwise(F.concat(acc, F.array(c))))
    rows = circles.groupBy("map_id").agg(order.alias("all")).join(far, "map_id").select("map_id", F.explode(kept).alias("c"))
    return rows.select("map_id", "c.x", "c.y", "c.radius", (-F.col("c.s")).alias("strength"))


def detected_controls(ink: DataFrame, votes: float, coverage: float) -> DataFrame:
    """(map_id, seq, x, y, radius, code): circles whose outline is inked well enough.  ink: (map_id, y, x, ink 0 or 1)."""
    inner = raster.border_mask(ink).withColumn("v", F.when(F.col("inner"), F.col("ink") * 255).otherwise(0))
    dims = raster.sizes(ink)
    found = course.suppressed(spaced(circles(inner.select("map_id", "y", "x", "v"), dims, votes), dims))
    kept = course.ring_coverage(found, inner.where("v > 0").select("map_id", "y", "x")).where(F.col("coverage") >= coverage)
    return kept.select("map_id", "seq", "x", "y", "radius", F.lit(None).cast("string").alias("code"))


def _long_segments(edge: DataFrame, dims: DataFrame, threshold: int, least: Column, gap: float) -> DataFrame:
    """(map_id, x1, y1, x2, y2) of at least ``least``, a column over the map's h; each pixel counts for its strongest line."""
    found = lines.line_segments(edge, threshold, 1, gap, consume=True).join(dims.select("map_id", least.alias("_least")), "map_id")
    return found.where(G.length(F.col("x1"), F.col("y1"), F.col("x2"), F.col("y2")) >= F.col("_least")).select("map_id", "x1", "y1", "x2", "y2")


def path_lines(df: DataFrame, gray: str, exclude: str, min_length: float = 15, gap: float = 8, threshold: int = 25) -> DataFrame:
    """(map_id, x1, y1, x2, y2) along edges of dark pixels that aren't excluded: ``min_length`` pixels, and 1.5 % of the height, or longer."""
    dark = df.select("map_id", "y", "x", F.when((F.col(gray) < 90) & (F.col(exclude) == 0), 255).otherwise(0).alias("dark"))
    edge = edges(dark, "dark", 40, 120).where("edge = 1").select("map_id", "y", "x")
    return _long_segments(edge, raster.sizes(df), threshold, F.greatest(F.lit(float(min_length)), 0.015 * F.col("h")), gap)


def legs(ink: DataFrame, controls: DataFrame, starts: DataFrame) -> DataFrame:
    """(map_id, x1, y1, x2, y2): straight ink between controls, with circles and start blanked: 4 % of the height or longer."""
    dims = raster.sizes(ink)
    disks = controls.select("map_id", F.col("x").alias("cx"), F.col("y").alias("cy"), (F.col("radius") * 1.4).alias("r"))
    disks = disks.unionByName(starts.join(dims, "map_id").select("map_id", F.col("x").alias("cx"), F.col("y").alias("cy"), (0.02 * F.col("h")).alias("r")))
    clear = raster.border_mask(raster.blank_disks(ink, disks, "ink")).withColumn("v", F.when(F.col("inner"), F.col("ink") * 255).otherwise(0))
    edge = edges(clear.select("map_id", "y", "x", "v"), "v", 40, 120).where("edge = 1").select("map_id", "y", "x")
    return _long_segments(edge, dims, 20, 0.04 * F.col("h"), 15)
