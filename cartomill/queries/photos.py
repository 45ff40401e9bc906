"""Queries whose operators need whole rasters or rings at once."""

from __future__ import annotations

from pyspark.sql import functions as F

from cartomill.functions import geometry as G
from cartomill.operators import drawing, imaging, raster
from cartomill.queries.data import RASTER, RINGS, mask, pixels, raster as base, rings
from cartomill.queries.routes import layers, walk
from cartomill.sources import images

QUERIES, SQL = {}, {}


def add(name: str, sql: str | None = None):
    def put(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return put


@add("median_blur", f"""WITH {RASTER}, o AS (SELECT p.map_id, p.y, p.x, q.v FROM g p, range(-2, 3) a(dy), range(-2, 3) b(dx), g q
  WHERE q.map_id = p.map_id AND q.y = greatest(0, least(31, p.y + dy)) AND q.x = greatest(0, least(47, p.x + dx))) SELECT map_id, y, x, CAST(median(v) AS INTEGER) AS m FROM o GROUP BY 1, 2, 3""")
def median(s, d):
    return imaging.median(base(s, d).select("map_id", "y", "x", "v"), "v", 5, "m").select("map_id", "y", "x", "m")


@add("warp_crop")
def warp(s, d):
    corners = F.array(*[F.struct(F.lit(float(x)).alias("x"), F.lit(float(y)).alias("y")) for x, y in ((10, 5), (29, 5), (29, 19), (10, 19))])
    quads = pixels(s, d).select("map_id").distinct().withColumn("quad", corners)
    out = imaging.rectified(pixels(s, d), quads)
    return out.select("map_id", "y", "x", "b", "g", "r")


add("canny")(lambda s, d: imaging.edges(base(s, d).select("map_id", "y", "x", "v"), "v", 200, 500).where("edge = 1").select("map_id", "y", "x"))
add("rock_mask")(lambda s, d: imaging.rock(base(s, d).select("map_id", "y", "x", "v", (F.col("v") > 100).cast("int").alias("light")), "v", "light").where("rock").select("map_id", "y", "x"))
add("mask_polygons")(lambda s, d: imaging.polygons(mask(s, d).withColumn("on", (F.col("v") > 40).cast("int")), "on", 10).select("map_id", "label", F.round(G.shoelace(F.col("ring")), 6).alias("area")))
add("simplify")(lambda s, d: rings(s, d).select("map_id", "poly_id", F.size(imaging.simplified(F.col("ring"), 2.0)).alias("n")))
add("path_lines")(lambda s, d: imaging.path_lines(base(s, d).select("map_id", "y", "x", "v", F.lit(0).alias("no")), "v", "no", 5, 3, 6))
add("circle_votes")(lambda s, d: imaging.circles(mask(s, d).select("map_id", "y", "x", (F.col("on") * 255).alias("v")), raster.sizes(mask(s, d)), 12, 0.05, 0.15))
add("png_sink")(lambda s, d: images.encoded(pixels(s, d)).select("map_id", F.length("png").alias("bytes"), F.md5("png").alias("md5")))


@add("convex_hull", f"""WITH {RINGS}, e AS (SELECT p.map_id, p.poly_id, a.i AS i, b.i AS j, p.ring[a.i].x AS ax, p.ring[a.i].y AS ay, p.ring[b.i].x AS bx, p.ring[b.i].y AS by_, p.ring FROM polys p, range(1, 5) a(i), range(1, 5) b(i) WHERE a.i <> b.i),
h AS (SELECT map_id, poly_id, ax, ay, bx, by_ FROM e WHERE len(list_filter(ring, lambda c: (bx - ax) * (c.y - ay) - (by_ - ay) * (c.x - ax) < 0)) = 0)
SELECT map_id, poly_id, round(abs(sum(ax * by_ - bx * ay)) / 2, 6) AS area FROM h GROUP BY 1, 2""")
def hulls(s, d):
    outer = rings(s, d).withColumn("ring", imaging.hull(F.col("ring").cast(imaging.RING)))
    return outer.select("map_id", "poly_id", F.round(G.shoelace(F.col("ring")), 6).alias("area"))


@add("ring_simple", f"""WITH {RINGS}, c AS (SELECT a.map_id, a.poly_id, bool_or(((a.x2 - a.x1) * (b.y1 - a.y1) - (a.y2 - a.y1) * (b.x1 - a.x1)) * ((a.x2 - a.x1) * (b.y2 - a.y1) - (a.y2 - a.y1) * (b.x2 - a.x1)) < 0
  AND ((b.x2 - b.x1) * (a.y1 - b.y1) - (b.y2 - b.y1) * (a.x1 - b.x1)) * ((b.x2 - b.x1) * (a.y2 - b.y1) - (b.y2 - b.y1) * (a.x2 - b.x1)) < 0) AS crossed FROM edge a JOIN edge b ON a.map_id = b.map_id AND a.poly_id = b.poly_id AND b.i = a.i + 2 GROUP BY 1, 2)
SELECT map_id, poly_id, NOT crossed AS simple FROM c""")
def simple(s, d):
    return rings(s, d).select("map_id", "poly_id", imaging.is_simple(F.col("ring").cast(imaging.RING)).alias("simple"))


@add("downscale_area", f"""WITH {RASTER}, a AS (SELECT map_id, v, CAST(t.c AS INTEGER) AS tx, y, least((x + 1) / (48 / 20.0::DOUBLE), t.c + 1) - greatest(x / (48 / 20.0::DOUBLE), t.c) AS wx FROM g, range(20) t(c) WHERE (x + 1) / (48 / 20.0::DOUBLE) > t.c + 1e-9 AND x / (48 / 20.0::DOUBLE) < t.c + 1 - 1e-9),
b AS (SELECT map_id, v, tx, CAST(t.c AS INTEGER) AS ty, wx, least((y + 1) / (32 / 13.0::DOUBLE), t.c + 1) - greatest(y / (32 / 13.0::DOUBLE), t.c) AS wy FROM a, range(13) t(c) WHERE (y + 1) / (32 / 13.0::DOUBLE) > t.c + 1e-9 AND y / (32 / 13.0::DOUBLE) < t.c + 1 - 1e-9)
SELECT map_id, ty AS y, tx AS x, round(sum(v * wx * wy) / sum(wx * wy), 9) AS v FROM b GROUP BY 1, 2, 3""")
def shrunk(s, d):
    return raster.resized(base(s, d).select("map_id", "y", "x", "v"), ["v"], 20).select("map_id", "y", "x", F.round("v", 9).alias("v"))


SPOTS = [("m0", 0, 12.0, 9.0, 1.5), ("m1", 0, 2.0, 30.0, 2.0), ("m1", 1, 40.0, 15.5, 1.0)]


@add("reading_crops", f"""WITH {RASTER}, c(map_id, seq, cx, cy, r) AS (VALUES {", ".join(str(t) for t in SPOTS)}),
p AS (SELECT g.map_id, seq, g.y - ceil(cy - 6 * r) AS y0, g.x - ceil(cx - 6 * r) AS x0, CASE WHEN sqrt((g.x - cx) * (g.x - cx) + (g.y - cy) * (g.y - cy)) <= 1.6 * r THEN 0 ELSE v END AS v FROM g JOIN c ON g.map_id = c.map_id AND g.x BETWEEN ceil(cx - 6 * r) AND floor(cx + 6 * r) AND g.y BETWEEN ceil(cy - 6 * r) AND floor(cy + 6 * r))
SELECT map_id, CAST(seq AS INTEGER) AS seq, CAST(y0 * 3 + i AS INTEGER) AS y, CAST(x0 * 3 + j AS INTEGER) AS x, v FROM p, range(3) a(i), range(3) b(j)""")
def crops(s, d):
    spots = s.createDataFrame(SPOTS, "map_id string, seq int, x double, y double, radius double")
    return drawing.reading_crops(base(s, d), spots, "v")


@add("qa_overlay")
def overlay(s, d):
    areas, paths = layers(s)
    spots = s.createDataFrame(SPOTS, "map_id string, seq int, x double, y double, radius double")
    return drawing.overlay(pixels(s, d), areas, paths.withColumn("role", F.lit("path")), spots, walk(s))
