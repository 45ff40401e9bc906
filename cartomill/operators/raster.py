"""Operators on rasters in long form: one row (map_id, y, x, ...) for each pixel.

Neighbourhoods are two passes of window frames, along x then along y, with RANGE
frames on the coordinate, so gaps don't shift them.  A row or column of one map
is the unit of work; maps are independent.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cartomill.functions import color
from cartomill.schemas import WHITE_PERCENTILE


def _over(axis: str, reach: int | tuple[int, int]):
    lo, hi = reach if isinstance(reach, tuple) else (-reach, reach)
    other = "y" if axis == "x" else "x"
    return W.partitionBy("map_id", other).orderBy(axis).rangeBetween(lo, hi)


def separable(df: DataFrame, col: str, kx: int, ky: int, f: Callable[[str], Column], out: str | None = None) -> DataFrame:
    """f over the kx columns about each pixel, then over the ky rows about it."""
    out = out or col
    df = df.withColumn(out, f(col).over(_over("x", kx // 2)))
    return df.withColumn(out, f(out).over(_over("y", ky // 2)))


def dilate(df: DataFrame, col: str, k: int, times: int = 1) -> DataFrame:
    for _ in range(times):
        df = separable(df, col, k, k, F.max)
    return df


def erode(df: DataFrame, col: str, k: int) -> DataFrame:
    return separable(df, col, k, k, F.min)


def closing(df: DataFrame, col: str, k: int) -> DataFrame:
    return erode(dilate(df, col, k), col, k)


def opening(df: DataFrame, col: str, k: int) -> DataFrame:
    return dilate(erode(df, col, k), col, k)


def sizes(df: DataFrame) -> DataFrame:
    """(map_id, w, h): one row for each map."""
    return df.groupBy("map_id").agg((F.max("x") + 1).alias("w"), (F.max("y") + 1).alias("h"))


def mirrored(df: DataFrame, reach: int) -> DataFrame:
    """Pads each map by ``reach`` pixels, mirrored about the border pixels."""
    df = with_size(df)

    def at(c: str, n: str) -> Column:
        x, last = F.col(c), F.col(n) - 1
        return F.array_compact(F.array(x, F.when(x.between(1, reach), -x), F.when(x.between(last - reach, last - 1), 2 * last - x)))

    return df.withColumn("x", F.explode(at("x", "_w"))).withColumn("y", F.explode(at("y", "_h")))


def with_size(df: DataFrame) -> DataFrame:
    """Adds _w and _h, unless they are there: chains of operators that pad should find them once."""
    return df if {"_w", "_h"} <= set(df.columns) else df.join(sizes(df).withColumnsRenamed({"w": "_w", "h": "_h"}), "map_id")


def inside(df: DataFrame, keep_size: bool = False) -> DataFrame:
    df = df.where("x >= 0 and y >= 0 and x < _w and y < _h")
    return df if keep_size else df.drop("_w", "_h")


def box_sum(df: DataFrame, col: str, kx: int, ky: int, out: str) -> DataFrame:
    """Sum over the mirrored kx x ky neighbourhood."""
    return inside(separable(mirrored(df, max(kx, ky) // 2), col, kx, ky, F.sum, out), "_w" in df.columns)


def box_mean(df: DataFrame, col: str, kx: int, ky: int, out: str) -> DataFrame:
    return box_sum(df, col, kx, ky, out).withColumn(out, F.col(out) / (kx * ky))


def weighted(df: DataFrame, col: str, kernel_x: list[int], kernel_y: list[int], out: str) -> DataFrame:
    """Separable integer kernel on the mirrored raster, which must have no gaps."""
    reach, sized = max(len(kernel_x), len(kernel_y)) // 2, "_w" in df.columns
    df = mirrored(df, reach)
    for axis, kernel, src in (("x", kernel_x, col), ("y", kernel_y, out)):
        w = W.partitionBy("map_id", "y" if axis == "x" else "x").orderBy(axis)
        terms = [k * F.lag(src, len(kernel) // 2 - i).over(w) for i, k in enumerate(kernel) if k]
        df = df.withColumn(out, sum(terms[1:], terms[0]))
    return inside(df, sized)


def gaussian5(df: DataFrame, col: str, out: str) -> DataFrame:
    kernel = [1, 4, 6, 4, 1]
    return weighted(df, col, kernel, kernel, out).withColumn(out, color.half_up(F.col(out) / 256.0))


def sobel(df: DataFrame, col: str, dx: str = "dx", dy: str = "dy") -> DataFrame:
    return weighted(weighted(df, col, [-1, 0, 1], [1, 2, 1], dx), col, [1, 2, 1], [-1, 0, 1], dy)


def marsh(df: DataFrame, gray: str = "gray", vertical: int = 25, horizontal: int = 25, least: int = 15) -> DataFrame:
    """Stacks of horizontal edges: many strong vertical gradients below each other, and over twice as many as beside each other."""
    df = sobel(with_size(df), gray)
    df = df.withColumn("_ve", (F.abs("dy") > vertical).cast("int")).withColumn("_he", (F.abs("dx") > horizontal).cast("int"))
    df = box_mean(box_sum(df, "_ve", 1, 25, "_vs"), "_vs", 9, 1, "vcount")
    df = box_mean(box_sum(df, "_he", 25, 1, "_hs"), "_hs", 1, 9, "hcount")
    df = df.withColumn("marsh", ((F.col("vcount") > least) & (F.col("vcount") > 2 * F.col("hcount"))).cast("int"))
    return opening(df, "marsh", 5).drop("_ve", "_he", "_vs", "_hs", "_w", "_h")


def with_hsv(df: DataFrame) -> DataFrame:
    bgr = [F.col(c) for c in "bgr"]
    return df.withColumns({"gray": color.gray(*bgr), "h": color.hue(*bgr), "s": color.saturation(*bgr), "v": color.value(*bgr)})


def valid_mask(df: DataFrame, boxes: DataFrame) -> DataFrame:
    """Pixels in none of their map's boxes.  boxes: (map_id, x0, y0, x1, y1), shares of the sides; few for each map.

    Box corners are cut to whole pixels and clamped; the far sides are exclusive.
    """
    dims = sizes(df)
    px = lambda c, n: F.greatest(F.lit(0), F.least((F.col(c) * F.col(n)).cast("int"), F.col(n)))
    out = boxes.join(dims, "map_id").select("map_id", px("x0", "w").alias("bx0"), px("y0", "h").alias("by0"), px("x1", "w").alias("bx1"), px("y1", "h").alias("by1"))
    held = out.groupBy("map_id").agg(F.collect_list(F.struct("bx0", "by0", "bx1", "by1")).alias("_boxes"))
    hit = F.exists("_boxes", lambda b: (F.col("x") >= b["bx0"]) & (F.col("x") < b["bx1"]) & (F.col("y") >= b["by0"]) & (F.col("y") < b["by1"]))
    return df.join(held, "map_id", "left").withColumn("valid", ~F.coalesce(hit, F.lit(False))).drop("_boxes")


def border_mask(df: DataFrame, share: float = 0.015) -> DataFrame:
    """Pixels at least trunc(share * side) from each border."""
    mx, my = (F.lit(share) * F.col("_w")).cast("int"), (F.lit(share) * F.col("_h")).cast("int")
    keep = (F.col("x") >= mx) & (F.col("x") < F.col("_w") - mx) & (F.col("y") >= my) & (F.col("y") < F.col("_h") - my)
    return with_size(df).withColumn("inner", keep).drop("_w", "_h")


def blank_disks(df: DataFrame, disks: DataFrame, col: str) -> DataFrame:
    """Zeroes ``col`` within the map's disks (map_id, cx, cy, r; cut to whole pixels, few for each map)."""
    held = disks.select("map_id", *[F.col(c).cast("int").alias(c) for c in ("cx", "cy", "r")]).groupBy("map_id").agg(F.collect_list(F.struct("cx", "cy", "r")).alias("_disks"))
    sq = lambda c: c * c
    hit = F.exists("_disks", lambda d: sq(F.col("x") - d["cx"]) + sq(F.col("y") - d["cy"]) <= sq(d["r"]))
    return df.join(held, "map_id", "left").withColumn(col, F.when(F.coalesce(hit, F.lit(False)), F.lit(0)).otherwise(F.col(col))).drop("_disks")


def terrain_cascade(df: DataFrame) -> DataFrame:
    """Class of each pixel by the first rule that holds: validity, water, out of bounds, rock, marsh, dark line, vegetation."""
    h, s, v = (F.col(c) for c in "hsv")
    kind = (
        F.when(~F.col("valid"), "invalid").when(color.is_water(h, s, v), "water").when(color.is_out_of_bounds(h, s, v), "out_of_bounds")
        .when(F.col("rock"), "rock").when(F.col("marsh"), "marsh").when(color.is_dark(F.col("gray")), "path_ink").otherwise("vegetation")
    )
    return df.withColumn("terrain", kind)


def downscaled(df: DataFrame, col: str, factor: int) -> DataFrame:
    """Mean over factor x factor blocks."""
    return df.groupBy("map_id", F.floor(F.col("y") / factor).cast("int").alias("y"), F.floor(F.col("x") / factor).cast("int").alias("x")).agg(F.avg(col).alias(col))


def working_scale(w: Column, h: Column, max_side: int) -> Column:
    longest = F.greatest(w, h)
    return F.when(longest > max_side, max_side / longest).otherwise(F.lit(1.0))


def rotated(df: DataFrame, quarter_turns: int) -> DataFrame:
    """Counter-clockwise."""
    for _ in range(quarter_turns % 4):
        df = with_size(df).withColumn("_x", F.col("y")).withColumn("y", F.col("_w") - 1 - F.col("x")).withColumn("x", F.col("_x")).drop("_x", "_w", "_h")
    return df


def histogram(df: DataFrame, col: str) -> DataFrame:
    return df.groupBy("map_id", col).agg(F.count("*").alias("n"))


def nearest_rank(df: DataFrame, col: str, percent: int = WHITE_PERCENTILE) -> DataFrame:
    """(map_id, threshold): the least value at which the running count reaches ceil(total * percent / 100)."""
    run = W.partitionBy("map_id").orderBy(col).rowsBetween(W.unboundedPreceding, 0)
    rows = histogram(df, col).withColumn("run", F.sum("n").over(run)).withColumn("all", F.sum("n").over(W.partitionBy("map_id")))
    return rows.where(F.col("run") >= F.ceil(F.col("all") * percent / 100)).groupBy("map_id").agg(F.min(col).alias("threshold"))


def gains(df: DataFrame, percent: int = WHITE_PERCENTILE) -> DataFrame:
    """(map_id, gain_b, gain_g, gain_r) that make the brightest pixels neutral; 1 for under 100 of them."""
    bright = df.join(nearest_rank(df, "gray", percent), "map_id").where("gray >= threshold")
    means = bright.groupBy("map_id").agg(*[F.avg(c).alias(f"m{c}") for c in "bgr"], F.count("*").alias("n"))
    mid = (F.col("mb") + F.col("mg") + F.col("mr")) / 3
    return means.select("map_id", *[F.when(F.col("n") < 100, F.lit(1.0)).otherwise(mid / F.greatest(F.col(f"m{c}"), F.lit(1e-6))).alias(f"gain_{c}") for c in "bgr"])


def white_balanced(df: DataFrame, percent: int = WHITE_PERCENTILE) -> DataFrame:
    return df.join(gains(df, percent), "map_id").withColumns({c: color.gained(F.col(c), F.col(f"gain_{c}")) for c in "bgr"}).drop("gain_b", "gain_g", "gain_r")


def resized(df: DataFrame, cols: list[str], max_side: int) -> DataFrame:
    """Maps whose longest side exceeds ``max_side``, shrunk to it: means weighted by the area that each pixel shares with the new one.

    New sides are rounded.  Other maps stay as they are.
    """
    dims = sizes(df)
    scale = working_scale(F.col("w"), F.col("h"), max_side)
    dims = dims.select("map_id", *[(F.col(n) / F.greatest(F.lit(1), F.round(F.col(n) * scale))).alias(f"_f{c}") for c, n in (("x", "w"), ("y", "h"))])
    df = df.join(dims, "map_id")
    for c in "xy":
        lo, hi = F.col(c) / F.col(f"_f{c}"), (F.col(c) + 1) / F.col(f"_f{c}")
        cells = F.sequence(F.floor(lo + 1e-9), F.ceil(hi - 1e-9) - 1)
        df = df.withColumns({"_lo": lo, "_hi": hi}).withColumn(f"_{c}", F.explode(cells))
        df = df.withColumn(f"_w{c}", F.least("_hi", F.col(f"_{c}") + 1.0) - F.greatest("_lo", F.col(f"_{c}").cast("double")))
    weight = F.col("_wx") * F.col("_wy")
    out = df.groupBy("map_id", F.col("_y").cast("int").alias("y"), F.col("_x").cast("int").alias("x"))
    return out.agg(*[(F.sum(F.col(c) * weight) / F.sum(weight)).alias(c) for c in cols])
