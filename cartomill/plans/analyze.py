"""From photos to features, costs, a route and an export: lazily built tables, many maps at once."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cartomill.functions import color, geometry
from cartomill.operators import cluster, course, imaging, lines, raster, route
from cartomill.plans import geojson
from cartomill.schemas import CIRCLE_VOTES_DEFAULT, CLUSTERS, RING_COVERAGE_MIN, WORKING_MAX_SIDE
from cartomill.sources import images
from cartomill.storage import written


def preprocessed(pixels: DataFrame, max_side: int = WORKING_MAX_SIDE) -> dict[str, DataFrame]:
    """pixels (map_id, y, x, b, g, r) and maps (map_id, width, height, scale_to_original, quad_found, mn_line_xs, mn_line_spacing_px).

    Shrunk where the longest side exceeds ``max_side``, made upright if a sheet of paper is
    found, and white-balanced.
    """
    dims = raster.sizes(pixels)
    small = raster.resized(pixels, ["b", "g", "r"], max_side).withColumns({c: color.half_up(F.col(c)) for c in "bgr"})
    small = written(small, "small")
    quads = written(imaging.paper(small), "quads")
    upright = written(raster.with_hsv(imaging.rectified(small, quads)).select("map_id", "y", "x", "b", "g", "r", "gray"), "upright")
    balanced = written(raster.white_balanced(upright).select("map_id", "y", "x", "b", "g", "r"), "balanced")
    north = north_lines(balanced)
    maps = raster.sizes(balanced).select("map_id", F.col("w").alias("width"), F.col("h").alias("height"))
    maps = maps.join(dims.select("map_id", raster.working_scale(F.col("w"), F.col("h"), max_side).alias("scale_to_original")), "map_id").join(quads.select("map_id", F.lit(True).alias("_q")), "map_id", "left").join(north, "map_id", "left")
    return {"pixels": balanced, "maps": maps.select("map_id", "width", "height", "scale_to_original", F.coalesce("_q", F.lit(False)).alias("quad_found"), F.coalesce("kept", F.array().cast("array<double>")).alias("mn_line_xs"), F.col("spacing").alias("mn_line_spacing_px"))}


def north_lines(pixels: DataFrame) -> DataFrame:
    """(map_id, kept, spacing) of regular, nearly vertical lines; none for maps with under three of them."""
    dims = raster.sizes(pixels)
    e = imaging.edges(raster.with_hsv(pixels).select("map_id", "y", "x", "gray"), "gray", 30, 90).where("edge = 1").select("map_id", "y", "x")
    s = lines.polar(lines.line_segments(e, 50, 1, 90, 360)).join(dims, "map_id").where(F.col("length") >= 0.06 * F.col("h"))
    s = s.where(F.col("mid_x").between(0.03 * F.col("w"), 0.97 * F.col("w")) & F.col("mid_y").between(0.03 * F.col("h"), 0.97 * F.col("h")))
    s = lines.near_vertical(s).withColumn("at", F.col("mid_x") / F.col("w"))
    c = lines.gap_clusters(s, ["map_id"], "at", 0.01, ["mid_y", "theta", "rho"])
    c = c.groupBy("map_id", "cluster").agg(F.count("*").alias("n"), (F.max("mid_y") - F.min("mid_y")).alias("span"), F.avg("mid_x").alias("centre"), F.first("h").alias("h")).where((F.col("n") >= 3) & (F.col("span") >= 0.25 * F.col("h")))
    return lines.spacing(c.select("map_id", "centre"), ["map_id"])


def segmented(pixels: DataFrame, valid: str = "valid", clusters: int = CLUSTERS) -> dict[str, DataFrame]:
    """polygons (map_id, poly_id, class_name, ring) and segments (map_id, seg_id, role, x1, y1, x2, y2) of pixels with a validity column."""
    h, s, v = (F.col(c) for c in "hsv")
    p = raster.with_hsv(pixels).withColumn("ok", F.col(valid))
    p = p.withColumns({"water": color.is_water(h, s, v) & F.col("ok"), "oob": color.is_out_of_bounds(h, s, v) & F.col("ok")})
    p = p.withColumn("light", (color.is_light(s, v) & F.col("ok") & ~F.col("water") & ~F.col("oob")).cast("int"))
    p = imaging.rock(p, "gray", "light")
    p = written(raster.marsh(p).withColumn("marsh", (F.col("marsh") == 1) & F.col("ok") & ~F.col("water") & ~F.col("oob") & ~F.col("rock")), "layers")
    taken = ~F.col("ok") | F.col("water") | F.col("oob") | F.col("rock") | F.col("marsh")
    paths = imaging.path_lines(p.withColumn("_no", taken.cast("int")), "gray", "_no")
    # the whole photo is blurred, so that what lies under lines and beside borders takes part; then the rest is sampled
    soft = raster.with_hsv(imaging.medians(p, ["b", "g", "r"])).select("map_id", "y", "x", *[F.col(c).cast("double").alias(c) for c in "hsv"])
    rest = p.where(~taken & ~color.is_dark(F.col("gray"))).select("map_id", "y", "x").join(soft, ["map_id", "y", "x"])
    spots = written(cluster.kmeans_by_map(written(rest, "rest"), ["h", "s", "v"], clusters), "spots")
    centres = spots.where("cluster is not null").groupBy("map_id", "cluster").agg(*[F.avg(c).alias(c) for c in "hsv"])
    names = centres.select("map_id", "cluster", color.vegetation(h, s, v).alias("class_name"))
    green = spots.join(names, ["map_id", "cluster"]).select("map_id", "y", "x", "class_name")
    grid = p.join(green, ["map_id", "y", "x"], "left").select("map_id", "y", "x", "water", "oob", "rock", "marsh", *[(F.coalesce(F.col("class_name") == n, F.lit(False))).alias(n) for n in ("forest", "clearing", "thicket")])
    grid = written(grid, "grid")
    parts = [imaging.hatched_polygons(grid, "oob").withColumn("class_name", F.lit("out_of_bounds"))]
    parts += [imaging.polygons(grid, n).withColumn("class_name", F.lit(n)) for n in ("water", "rock", "marsh", "forest", "clearing", "thicket")]
    whole = parts[0]
    for x in parts[1:]:
        whole = whole.unionByName(x)
    number = lambda *by: F.row_number().over(W.partitionBy("map_id").orderBy(*by)).cast("long")
    polygons = whole.withColumn("poly_id", number("class_name", "label")).select("map_id", "poly_id", "class_name", "ring")
    return {"polygons": polygons, "segments": paths.withColumn("seg_id", number("x1", "y1", "x2", "y2")).select("map_id", "seg_id", F.lit("path").alias("role"), "x1", "y1", "x2", "y2")}


def detected(pixels: DataFrame, votes: float = CIRCLE_VOTES_DEFAULT, coverage: float = RING_COVERAGE_MIN) -> dict[str, DataFrame]:
    """ink, controls, starts, finishes and legs of pixels with a validity column."""
    h, s, v = (F.col(c) for c in "hsv")
    ink = raster.with_hsv(pixels).withColumn("ink", (color.is_ink(h, s, v) & F.col("valid")).cast("int")).select("map_id", "y", "x", "ink")
    ink = written(raster.closing(ink, "ink", 3), "ink")
    every = written(imaging.detected_controls(ink, votes, coverage), "controls")
    controls, finishes = course.without_finish(every), course.finish(every).select("map_id", "x", "y")
    clear = raster.blank_disks(ink, every.select("map_id", F.col("x").alias("cx"), F.col("y").alias("cy"), (F.col("radius") * 1.4).alias("r")), "ink")
    starts = written(starts_from(clear, every), "starts")
    return {"ink": ink, "controls": controls, "starts": starts, "finishes": finishes, "legs": imaging.legs(ink, every, starts)}


def starts_from(ink: DataFrame, controls: DataFrame) -> DataFrame:
    """(map_id, x, y) of the start triangle in the ink (map_id, y, x, ink) that is left when circles are blanked."""
    found = imaging.contours(ink.where("ink = 1")).withColumn("contour_area", geometry.shoelace(F.col("ring")))
    found = found.withColumn("ring", imaging.approximated(F.col("ring"), F.lit(0.04))).where(F.size("ring") == 3)
    tri = found.select("map_id", F.col("label").alias("tri_id"), "contour_area", *[F.get("ring", i)[c].alias(f"{c}{i + 1}") for i in range(3) for c in "xy"])
    return course.start_triangle(tri, controls).select("map_id", "x", "y")


def rectify_photo(pixels: DataFrame, max_side: int = WORKING_MAX_SIDE) -> DataFrame:
    """(map_id, png, width, height, scale_to_original, quad_found, mn_line_xs, mn_line_spacing_px): the upright, balanced photo without its analysis."""
    first = preprocessed(pixels, max_side)
    return first["maps"].join(images.encoded(first["pixels"]), "map_id")


def analyzed(pixels: DataFrame, boxes: DataFrame, names: DataFrame, votes: float = CIRCLE_VOTES_DEFAULT) -> dict[str, DataFrame]:
    """All tables of the analysis.  boxes: (map_id, x0, y0, x1, y1); names: (map_id, source_photo)."""
    first = preprocessed(pixels)
    p = written(raster.valid_mask(first["pixels"], boxes), "valid")
    found = detected(p, votes)
    free = p.join(found["ink"], ["map_id", "y", "x"]).withColumn("free", F.col("valid") & (F.col("ink") == 0))
    parts = segmented(free.drop("ink"), "free")
    # the cost raster uses the plain validity, not the one without ink
    classes = written(route.class_grid(p.select("map_id", "y", "x", "valid"), parts["polygons"], parts["segments"], "valid"), "classes")
    ends = course.endpoints(found["controls"], found["starts"]).withColumn("route_id", F.lit(0).cast("long"))
    routes = written(route.least_cost(classes, ends), "routes")
    points = routes.select("map_id", "route_id", F.posexplode("points").alias("seq", "p")).select("map_id", "route_id", "seq", "p.x", "p.y")
    routes = routes.join(route.summed_cost(points, classes), ["map_id", "route_id"], "left").withColumn("recomputed_cost", F.coalesce("recomputed_cost", F.lit(0.0)))
    shares = route.breakdown(points, classes)
    legs = found["legs"].select("map_id", F.row_number().over(W.partitionBy("map_id").orderBy("x1", "y1", "x2", "y2")).cast("long").alias("seg_id"), F.lit("course_leg").alias("role"), "x1", "y1", "x2", "y2")
    maps = first["maps"].join(names, "map_id", "left")
    out = {"maps": maps, **parts, **found, "classes": classes, "routes": routes, "breakdown": shares}
    out["segments"] = parts["segments"].unionByName(legs)
    return out | {"geojson": exported(out)}


def exported(t: dict[str, DataFrame]) -> DataFrame:
    """(map_id, geojson), from detected or corrected tables; a route passed through may be older than the corrections."""
    rows = geojson.features(t["maps"], t["polygons"], t["segments"], t["controls"], t["starts"], t["finishes"], t["routes"], t["breakdown"])
    return geojson.documents(t["maps"], rows)
