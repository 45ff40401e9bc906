"""Raster queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from cartomill.functions import color
from cartomill.operators import cluster, components, lines, raster
from cartomill.queries.data import HSV, MASK, PIXELS, RASTER, mask, pixels, raster as base, table

QUERIES, SQL = {}, {}


def add(name: str, sql: str | None = None):
    def put(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return put


def framed(src: str, col: str, f: str, kx: int, ky: int, out: str, at: str) -> str:
    """CTEs: f over kx columns, then over ky rows."""
    return f""",
{out}_1 AS (SELECT *, {f}({col}) OVER (PARTITION BY map_id, y ORDER BY x RANGE BETWEEN {kx // 2} PRECEDING AND {kx // 2} FOLLOWING) AS {out}_x FROM {src}),
{at} AS (SELECT *, {f}({out}_x) OVER (PARTITION BY map_id, x ORDER BY y RANGE BETWEEN {ky // 2} PRECEDING AND {ky // 2} FOLLOWING) AS {out} FROM {out}_1)"""


def mirrored(src: str, reach: int, at: str, w: int = 48, h: int = 32) -> str:
    m = lambda c, n: f"unnest(list_filter([{c}, CASE WHEN {c} BETWEEN 1 AND {reach} THEN -{c} END, CASE WHEN {c} BETWEEN {n - 1 - reach} AND {n - 2} THEN {2 * (n - 1)} - {c} END], lambda z: z IS NOT NULL))"
    return f""",
{at}_1 AS (SELECT * EXCLUDE (x), {m('x', w)} AS x FROM {src}), {at} AS (SELECT * EXCLUDE (y), {m('y', h)} AS y FROM {at}_1)"""


INSIDE = "x >= 0 AND y >= 0 AND x < 48 AND y < 32"

add("raster_scan", f"WITH {RASTER} SELECT map_id, y, x, v, known FROM g")(base)
add("gray_hsv", f"WITH {HSV} SELECT map_id, y, x, gray, h, s, v FROM hsv")(lambda s, d: raster.with_hsv(pixels(s, d)).select("map_id", "y", "x", "gray", "h", "s", "v"))


@add("mask_algebra", f"""WITH {HSV}, m AS (SELECT *, h BETWEEN 90 AND 135 AND s >= 60 AND v >= 60 AS water, h BETWEEN 135 AND 170 AND s >= 40 AND v >= 40 AS oob,
  (h <= 15 OR h >= 150) AND s > 70 AND v > 40 AND v < 235 AS ink, s < 60 AND v > 150 AS pale, gray < 90 AS dark FROM hsv)
SELECT map_id, y, x, water, oob, ink, pale AND NOT water AND NOT oob AS light, dark, water AND dark AS both_, NOT water AS dry FROM m""")
def mask_algebra(s, d):
    h, sa, v = (F.col(c) for c in "hsv")
    m = raster.with_hsv(pixels(s, d)).withColumns({"water": color.is_water(h, sa, v), "oob": color.is_out_of_bounds(h, sa, v), "ink": color.is_ink(h, sa, v), "dark": color.is_dark(F.col("gray"))})
    light = color.is_light(sa, v) & ~F.col("water") & ~F.col("oob")
    return m.select("map_id", "y", "x", "water", "oob", "ink", light.alias("light"), "dark", (F.col("water") & F.col("dark")).alias("both_"), (~F.col("water")).alias("dry"))


BOXES = [("m0", 0.0, 0.0, 0.3, 0.25), ("m0", 0.5, 0.5, 1.2, 0.9), ("m1", 0.61, -0.2, 0.77, 0.4)]


@add("valid_mask", f"""WITH {RASTER}, bx(map_id, x0, y0, x1, y1) AS (VALUES {", ".join(str(b) for b in BOXES)})
SELECT map_id, y, x, NOT EXISTS (SELECT 1 FROM bx WHERE bx.map_id = g.map_id AND g.x >= greatest(0, least(trunc(x0 * 48), 48)) AND g.x < greatest(0, least(trunc(x1 * 48), 48))
  AND g.y >= greatest(0, least(trunc(y0 * 32), 32)) AND g.y < greatest(0, least(trunc(y1 * 32), 32))) AS valid FROM g""")
def valid(s, d):
    return raster.valid_mask(base(s, d).select("map_id", "y", "x"), s.createDataFrame(BOXES, "map_id string, x0 double, y0 double, x1 double, y1 double"))


add("border_mask", f"WITH {RASTER} SELECT map_id, y, x, x >= 4 AND x < 44 AND y >= 3 AND y < 29 AS \"inner\" FROM g")(lambda s, d: raster.border_mask(base(s, d).select("map_id", "y", "x"), 0.1))

DISKS = [("m0", 10.7, 9.2, 5.9), ("m1", 40.0, 20.0, 8.0), ("m1", 5.0, 5.0, 3.0)]


@add("blank_disks", f"""WITH {MASK}, dk(map_id, cx, cy, r) AS (SELECT map_id, trunc(cx), trunc(cy), trunc(r) FROM (VALUES {", ".join(str(b) for b in DISKS)}) t(map_id, cx, cy, r))
SELECT map_id, y, x, CASE WHEN EXISTS (SELECT 1 FROM dk WHERE dk.map_id = k.map_id AND (k.x - cx) * (k.x - cx) + (k.y - cy) * (k.y - cy) <= r * r) THEN 0 ELSE on_ END AS on_ FROM k""")
def disks(s, d):
    return raster.blank_disks(mask(s, d).select("map_id", "y", "x", F.col("on").alias("on_")), s.createDataFrame(DISKS, "map_id string, cx double, cy double, r double"), "on_")


@add("terrain_cascade", f"""WITH {HSV} SELECT map_id, y, x, CASE WHEN (x + y) % 17 = 0 THEN 'invalid' WHEN h BETWEEN 90 AND 135 AND s >= 60 AND v >= 60 THEN 'water' WHEN h BETWEEN 135 AND 170 AND s >= 40 AND v >= 40 THEN 'out_of_bounds'
  WHEN b % 11 = 0 THEN 'rock' WHEN g % 13 = 0 THEN 'marsh' WHEN gray < 90 THEN 'path_ink' ELSE 'vegetation' END AS terrain FROM hsv""")
def cascade(s, d):
    p = raster.with_hsv(pixels(s, d)).withColumns({"valid": (F.col("x") + F.col("y")) % 17 != 0, "rock": F.col("b") % 11 == 0, "marsh": F.col("g") % 13 == 0})
    return raster.terrain_cascade(p).select("map_id", "y", "x", "terrain")


add("downscale_avg", f"WITH {RASTER} SELECT map_id, CAST(floor(y / 4.0) AS INTEGER) AS y, CAST(floor(x / 4.0) AS INTEGER) AS x, avg(v) AS v FROM g GROUP BY 1, 2, 3")(lambda s, d: raster.downscaled(base(s, d), "v", 4))
add("rotate90", f"WITH {RASTER} SELECT map_id, 47 - x AS y, y AS x, v FROM g")(lambda s, d: raster.rotated(base(s, d).select("map_id", "y", "x", "v"), 1))
add("gray_hist", f"WITH {HSV} SELECT map_id, gray, count(*) AS n FROM hsv GROUP BY 1, 2")(lambda s, d: raster.histogram(raster.with_hsv(pixels(s, d)), "gray"))
add("pctl_white", f"WITH {HSV} SELECT map_id, quantile_disc(gray, 0.97) AS threshold FROM hsv GROUP BY 1")(lambda s, d: raster.nearest_rank(raster.with_hsv(pixels(s, d)), "gray"))


@add("white_balance", f"""WITH {HSV}, th AS (SELECT map_id, quantile_disc(gray, 0.7) AS threshold FROM hsv GROUP BY 1),
mn AS (SELECT map_id, avg(b) AS mb, avg(g) AS mg, avg(r) AS mr, count(*) AS n FROM hsv JOIN th USING (map_id) WHERE gray >= threshold GROUP BY 1),
gn AS (SELECT map_id, CASE WHEN n < 100 THEN 1 ELSE (mb + mg + mr) / 3 / greatest(mb, 1e-6) END AS kb, CASE WHEN n < 100 THEN 1 ELSE (mb + mg + mr) / 3 / greatest(mg, 1e-6) END AS kg, CASE WHEN n < 100 THEN 1 ELSE (mb + mg + mr) / 3 / greatest(mr, 1e-6) END AS kr FROM mn)
SELECT map_id, y, x, CAST(least(greatest(floor(b * kb + 0.5), 0), 255) AS INTEGER) AS b, CAST(least(greatest(floor(g * kg + 0.5), 0), 255) AS INTEGER) AS g, CAST(least(greatest(floor(r * kr + 0.5), 0), 255) AS INTEGER) AS r FROM hsv JOIN gn USING (map_id)""")
def white(s, d):
    return raster.white_balanced(raster.with_hsv(pixels(s, d)), 70).select("map_id", "y", "x", "b", "g", "r")


def focal(name, col, steps, run):
    """steps: (function, kernel) in order."""
    sql, src = MASK, "k"
    at = col
    for i, (f, n) in enumerate(steps):
        sql += framed(src, at, f, n, n, f"o{i}", f"s{i}")
        src, at = f"s{i}", f"o{i}"
    add(name, f"WITH {sql} SELECT map_id, y, x, {at} AS o FROM {src}")(lambda s, d: run(mask(s, d).withColumnRenamed("on", "on_").withColumn("o", F.col(col))).select("map_id", "y", "x", "o"))


focal("dilate", "v", [("max", 5)] * 2, lambda k: raster.dilate(k, "o", 5, 2))
focal("erode", "v", [("min", 3)], lambda k: raster.erode(k, "o", 3))
focal("close3", "on_", [("max", 3), ("min", 3)], lambda k: raster.closing(k, "o", 3))
focal("open5", "on_", [("min", 5), ("max", 5)], lambda k: raster.opening(k, "o", 5))

add("box15", "WITH " + RASTER + mirrored("g", 7, "p") + framed("p", "v", "sum", 15, 15, "o", "b") + f" SELECT map_id, y, x, o / 225.0::DOUBLE AS o FROM b WHERE {INSIDE}")(lambda s, d: raster.box_mean(base(s, d), "v", 15, 15, "o").select("map_id", "y", "x", "o"))

SOBEL = mirrored("src", 1, "sp") + """,
sx AS (SELECT *, lead(u) OVER (PARTITION BY map_id, y ORDER BY x) - lag(u) OVER (PARTITION BY map_id, y ORDER BY x) AS d1,
       lag(u) OVER (PARTITION BY map_id, y ORDER BY x) + 2 * u + lead(u) OVER (PARTITION BY map_id, y ORDER BY x) AS m1 FROM sp),
sy AS (SELECT *, lag(d1) OVER (PARTITION BY map_id, x ORDER BY y) + 2 * d1 + lead(d1) OVER (PARTITION BY map_id, x ORDER BY y) AS dx,
       lead(m1) OVER (PARTITION BY map_id, x ORDER BY y) - lag(m1) OVER (PARTITION BY map_id, x ORDER BY y) AS dy FROM sx),
so AS (SELECT map_id, y, x, CAST(dx AS INTEGER) AS dx, CAST(dy AS INTEGER) AS dy FROM sy WHERE """ + INSIDE + ")"
add("sobel", f"WITH {RASTER}, src AS (SELECT map_id, y, x, v AS u FROM g) {SOBEL} SELECT map_id, y, x, dx, dy FROM so")(lambda s, d: raster.sobel(base(s, d), "v").select("map_id", "y", "x", "dx", "dy"))


@add("gaussian5", f"WITH {RASTER}" + mirrored("g", 2, "p") + """, a AS (SELECT *, lag(v, 2) OVER w + 4 * lag(v) OVER w + 6 * v + 4 * lead(v) OVER w + lead(v, 2) OVER w AS t FROM p WINDOW w AS (PARTITION BY map_id, y ORDER BY x)),
b AS (SELECT *, lag(t, 2) OVER w + 4 * lag(t) OVER w + 6 * t + 4 * lead(t) OVER w + lead(t, 2) OVER w AS o FROM a WINDOW w AS (PARTITION BY map_id, x ORDER BY y))
SELECT map_id, y, x, CAST(floor(o / 256.0 + 0.5) AS INTEGER) AS o FROM b WHERE """ + INSIDE)
def gauss(s, d):
    return raster.gaussian5(base(s, d), "v", "o").select("map_id", "y", "x", "o")


MARSH = f"WITH {RASTER}, src AS (SELECT map_id, y, x, (v * y) % 256 AS u FROM g) {SOBEL}, e AS (SELECT map_id, y, x, CAST(abs(dy) > 25 AS INTEGER) AS ev, CAST(abs(dx) > 400 AS INTEGER) AS eh FROM so)"
MARSH += mirrored("e", 12, "e1") + framed("e1", "ev", "sum", 1, 25, "vs", "e2") + framed("e2", "eh", "sum", 25, 1, "hs", "e3") + f", e4 AS (SELECT map_id, y, x, vs, hs FROM e3 WHERE {INSIDE})"
MARSH += mirrored("e4", 4, "e5") + framed("e5", "vs", "sum", 9, 1, "vc", "e6") + framed("e6", "hs", "sum", 1, 9, "hc", "e7") + f", e8 AS (SELECT map_id, y, x, CAST(vc / 9.0::DOUBLE > 15 AND vc / 9.0::DOUBLE > 2 * (hc / 9.0::DOUBLE) AS INTEGER) AS mm FROM e7 WHERE {INSIDE})"
MARSH += framed("e8", "mm", "min", 5, 5, "er", "e9") + framed("e9", "er", "max", 5, 5, "marsh", "e10") + " SELECT map_id, y, x, marsh FROM e10"


@add("marsh", MARSH)
def marsh(s, d):
    g = base(s, d).select("map_id", "y", "x", ((F.col("v") * F.col("y")) % 256).alias("gray"))
    return raster.marsh(g, horizontal=400).select("map_id", "y", "x", "marsh")


CC = f"""WITH RECURSIVE {MASK}, n AS (SELECT map_id, y, x, CAST(y AS BIGINT) * 4294967296 + x AS id FROM k WHERE on_ = 1),
r(map_id, y, x, l) USING KEY (map_id, y, x) AS (
  SELECT map_id, y, x, id FROM n
  UNION
  SELECT map_id, y, x, min(c.l) FROM (
    SELECT b.map_id, b.y, b.x, r.l FROM r JOIN n b ON b.map_id = r.map_id AND abs(b.y - r.y) <= 1 AND abs(b.x - r.x) <= 1) c
  LEFT JOIN recurring.r o USING (map_id, y, x) WHERE c.l < o.l GROUP BY map_id, y, x)"""
add("components", CC + " SELECT map_id, y, x, l AS label FROM r")(lambda s, d: components.label_pixels(mask(s, d).where("`on` = 1")).select("map_id", "y", "x", "label"))
add("component_area", CC + " SELECT map_id, l AS label, count(*) AS area, min(x) AS x0, min(y) AS y0, max(x) AS x1, max(y) AS y1 FROM r GROUP BY 1, 2")(lambda s, d: components.areas(mask(s, d).where("`on` = 1")))
HOLES = CC.replace("), n AS", "), bg AS (SELECT map_id, y, x, CAST(y AS BIGINT) * 4294967296 + x AS id FROM k WHERE on_ = 0), n AS", 1) + """,
q(map_id, y, x, l) USING KEY (map_id, y, x) AS (
  SELECT map_id, y, x, id FROM bg
  UNION
  SELECT map_id, y, x, min(c.l) FROM (SELECT b.map_id, b.y, b.x, q.l FROM q JOIN bg b ON b.map_id = q.map_id AND abs(b.y - q.y) + abs(b.x - q.x) <= 1) c
  LEFT JOIN recurring.q o USING (map_id, y, x) WHERE c.l < o.l GROUP BY map_id, y, x),
ho AS (SELECT map_id, l AS hole, count(*) AS area FROM q GROUP BY 1, 2 HAVING min(x) > 0 AND min(y) > 0 AND max(x) < 47 AND max(y) < 31),
hp AS (SELECT ho.map_id, hole, r.l AS parent, area FROM ho JOIN r ON r.map_id = ho.map_id AND r.y = hole // 4294967296 AND r.x = hole % 4294967296 - 1)"""
add("hole_count", HOLES + " SELECT map_id, hole, parent, area FROM hp")(lambda s, d: components.holes(mask(s, d), "on"))
add("hatched_areas", HOLES + " SELECT map_id, parent AS label, count(*) AS holes FROM hp WHERE area > 1 GROUP BY 1, 2 HAVING count(*) >= 3")(lambda s, d: components.hatched(mask(s, d), "on", 3, 1))
add("cost_heat", f"WITH {RASTER} SELECT map_id, y, x, CAST(trunc(least(greatest(v / 32.0::DOUBLE, 0), 6.0) / 6.0 * 255) AS INTEGER) AS heat FROM g")(lambda s, d: base(s, d).select("map_id", "y", "x", color.heat_index(F.col("v") / 32.0).alias("heat")))
add("overlay_blend", f"WITH {PIXELS} SELECT map_id, y, x, CAST(floor(0.4::DOUBLE * 200 + 0.6::DOUBLE * b + 0.5) AS INTEGER) AS b FROM px")(lambda s, d: pixels(s, d).select("map_id", "y", "x", color.blended(F.lit(200), F.col("b")).alias("b")))
VOTE = "CAST(round(round(x * cos(t.theta * (pi() / 180)) + y * sin(t.theta * (pi() / 180)), 6)) AS INTEGER)"
add("hough_lines", f"WITH {MASK} SELECT map_id, CAST(t.theta AS INTEGER) AS theta, {VOTE} AS rho, count(*) AS votes FROM k, range(180) t(theta) GROUP BY 1, 2, 3 HAVING count(*) >= 8")(lambda s, d: lines.line_votes(mask(s, d), 8))

DIMS = ["e1", "e2", "e3"]
EMB = "e AS (SELECT vec_id, label, embedding[1]::DOUBLE AS e1, embedding[2]::DOUBLE AS e2, embedding[3]::DOUBLE AS e3 FROM embeddings), c AS (SELECT label AS cluster, avg(e1) AS a1, avg(e2) AS a2, avg(e3) AS a3 FROM e GROUP BY 1)"


def colours(s, d):
    e = table(s, d, "embeddings").select("vec_id", "label", *[F.get("embedding", F.lit(i)).cast("double").alias(n) for i, n in enumerate(DIMS)])
    return e, e.groupBy(F.col("label").alias("cluster")).agg(*[F.avg(c).alias(c) for c in DIMS])


@add("kmeans_step", f"""WITH {EMB}, a AS (SELECT vec_id, e1, e2, e3, cluster, row_number() OVER (PARTITION BY vec_id ORDER BY (e1 - a1) * (e1 - a1) + (e2 - a2) * (e2 - a2) + (e3 - a3) * (e3 - a3), cluster) AS n FROM e, c)
SELECT cluster, round(avg(e1), 9) AS e1, round(avg(e2), 9) AS e2, round(avg(e3), 9) AS e3, count(*) AS n FROM a WHERE n = 1 GROUP BY 1""")
def step(s, d):
    e, c = colours(s, d)
    return cluster.lloyd(e, c, DIMS).select("cluster", *[F.round(x, 9).alias(x) for x in DIMS], "n")


add("kmeans_ml")(lambda s, d: cluster.kmeans(colours(s, d)[0], DIMS).select("vec_id", "cluster"))
add("veg_class", f"""WITH {HSV} SELECT map_id, y, x, CASE WHEN h BETWEEN 12 AND 34 AND v >= 120 THEN 'clearing' WHEN h > 34 AND h <= 95 THEN CASE WHEN v < 150 OR s > 140 THEN 'thicket' ELSE 'forest' END ELSE 'forest' END AS class_name FROM hsv""")(
    lambda s, d: raster.with_hsv(pixels(s, d)).select("map_id", "y", "x", color.vegetation(F.col("h"), F.col("s"), F.col("v")).alias("class_name"))
)
