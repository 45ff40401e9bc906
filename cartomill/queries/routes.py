"""Queries on cost rasters, routes, edits and exports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cartomill.operators import edits, route
from cartomill.plans import geojson
from cartomill.queries.data import CONTROLS, POINTS, RASTER, RINGS, SEGMENTS, controls, points, raster, rings, segments
from cartomill.schemas import EXPORT_ORDER, TERRAIN

QUERIES, SQL = {}, {}


def add(name: str, sql: str | None = None):
    def put(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return put


#: (map, polygon, class, rectangle) and path lines on the derived raster; the sides lie between pixels.
AREAS = [(m, i, c, x0, y0, x1, y1) for m in ("m0", "m1") for i, (c, x0, y0, x1, y1) in enumerate([("clearing", 2, 2, 30, 20), ("forest", 10, 5, 44, 28), ("thicket", 20, 10, 35, 25), ("water", 24, 12, 33, 20), ("rock", 5, 14, 22, 18)])]
PATHS = [("m0", 0, 3.0, 24.0, 40.0, 24.0), ("m0", 1, 25.0, 6.0, 25.0, 26.0), ("m1", 2, 6.0, 8.0, 41.0, 8.0)]


def layers(spark: SparkSession) -> tuple[DataFrame, DataFrame]:
    r = spark.createDataFrame(AREAS, "map_id string, poly_id long, class_name string, x0 int, y0 int, x1 int, y1 int")
    p = lambda x, y: F.struct(F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y"))
    polygons = r.select("map_id", "poly_id", "class_name", F.array(p("x0", "y0"), p("x1", "y0"), p("x1", "y1"), p("x0", "y1")).alias("ring"))
    return polygons, spark.createDataFrame(PATHS, "map_id string, seg_id long, x1 double, y1 double, x2 double, y2 double")


def classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells that no row falls on, and a band at the right, are outside the valid mask."""
    polygons, paths = layers(spark)
    grid = raster(spark, sf_dir).select("map_id", "y", "x", "v", (F.col("known") & (F.col("x") < 46)).alias("valid"))
    return route.class_grid(grid, polygons, paths, "valid")


CLASSES = f"""{RASTER}, ar(map_id, i, class_name, x0, y0, x1, y1) AS (VALUES {", ".join(str(a) for a in AREAS)}), ln(map_id, i, x1, y1, x2, y2) AS (VALUES {", ".join(str(a) for a in PATHS)}),
dim(class_name, code, cost) AS (VALUES {", ".join(f"('{n}', {c}, {v}::DOUBLE)" for n, c, v in TERRAIN)}),
paint AS (SELECT g.map_id, y, x, code FROM g JOIN ar ON ar.map_id = g.map_id AND x BETWEEN x0 AND x1 AND y BETWEEN y0 AND y1 JOIN dim USING (class_name)
  UNION ALL SELECT g.map_id, y, x, 8 FROM g JOIN ln ON ln.map_id = g.map_id AND sqrt(power(greatest(x1 - x, 0, x - x2), 2) + power(greatest(y1 - y, 0, y - y2), 2)) <= 1.5),
top AS (SELECT map_id, y, x, max(code) AS code FROM paint GROUP BY ALL),
cls AS (SELECT g.map_id, g.y, g.x, v, CASE WHEN g.known AND g.x < 46 THEN coalesce(top.code, 0) ELSE 9 END AS code FROM g LEFT JOIN top USING (map_id, y, x)),
cg AS (SELECT cls.*, class_name, cost FROM cls JOIN dim USING (code))"""

add("cost_grid", f"WITH {CLASSES} SELECT map_id, y, x, cost FROM cg")(lambda s, d: classes(s, d).select("map_id", "y", "x", "cost"))
add("class_grid", f"WITH {CLASSES} SELECT map_id, y, x, CAST(code AS INTEGER) AS code, class_name FROM cg")(lambda s, d: classes(s, d).select("map_id", "y", "x", "code", "class_name"))

ENDS = [("m0", 0, 1.0, 1.0, 44.0, 30.0), ("m1", 0, -3.0, -5.0, 100.0, 100.0)]


def priced(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classes(spark, sf_dir).withColumn("cost", F.col("cost") + F.col("v") / 256.0)


def solved(spark: SparkSession, sf_dir: str) -> DataFrame:
    return route.least_cost(priced(spark, sf_dir), spark.createDataFrame(ENDS, "map_id string, route_id long, x1 double, y1 double, x2 double, y2 double"))


def walked(routes: DataFrame) -> DataFrame:
    return routes.select("map_id", "route_id", F.posexplode("points").alias("seq", "p")).select("map_id", "route_id", "seq", "p.x", "p.y")


@add("route_cost", f"""WITH RECURSIVE {CLASSES}, pg AS (SELECT map_id, y, x, cost + v / 256.0::DOUBLE AS c FROM cg),
r(map_id, x, y, d) USING KEY (map_id, x, y) AS (
  SELECT map_id, x, y, 0.0::DOUBLE FROM pg WHERE (map_id = 'm0' AND x = 1 AND y = 1) OR (map_id = 'm1' AND x = 0 AND y = 0)
  UNION
  SELECT map_id, x, y, min(n.nd) FROM (SELECT b.map_id, b.x, b.y, r.d + sqrt((b.x - a.x) ** 2 + (b.y - a.y) ** 2) * (a.c + b.c) / 2 AS nd
    FROM r JOIN pg a ON a.map_id = r.map_id AND a.x = r.x AND a.y = r.y JOIN pg b ON b.map_id = a.map_id AND b.x BETWEEN a.x - 1 AND a.x + 1 AND b.y BETWEEN a.y - 1 AND a.y + 1 AND (a.x <> b.x OR a.y <> b.y)) n
  LEFT JOIN recurring.r k USING (map_id, x, y) WHERE k.d IS NULL OR n.nd < k.d - 1e-12 GROUP BY map_id, x, y)
SELECT map_id, 0::BIGINT AS route_id, round(d, 6) AS cost FROM r WHERE (map_id = 'm0' AND x = 44 AND y = 30) OR (map_id = 'm1' AND x = 47 AND y = 31)""")
def cost(s, d):
    return solved(s, d).select("map_id", "route_id", F.round("cost", 6).alias("cost"))


#: The sum along a least-cost path is its cost.
RESUM = SQL["route_cost"].replace("round(d, 6) AS cost", "round(d, 6) AS cost, round(d, 6) AS recomputed_cost, 'OK' AS verdict")


@add("route_resum", RESUM)
def resum(s, d):
    """Cost of the path against the sum along its points."""
    r = solved(s, d)
    return r.join(route.summed_cost(walked(r), priced(s, d)), ["map_id", "route_id"]).select("map_id", "route_id", F.round("cost", 6).alias("cost"), F.round("recomputed_cost", 6).alias("recomputed_cost"), F.when(F.abs(F.col("cost") - F.col("recomputed_cost")) < 1e-3 * F.col("cost"), "OK").otherwise("MISMATCH").alias("verdict"))


add("route_path")(lambda s, d: walked(solved(s, d)))
WALK = """wk AS (SELECT map_id, route_id, seq, CAST(CASE WHEN seq < 20 THEN 2 + seq WHEN seq < 30 THEN 21 ELSE 21 + seq - 29 END AS INTEGER) AS x, CAST(CASE WHEN seq < 20 THEN 3 WHEN seq < 30 THEN 3 + seq - 19 ELSE 13 + (seq - 29) END AS INTEGER) AS y
  FROM (VALUES ('m0', 0::BIGINT), ('m1', 1::BIGINT)) m(map_id, route_id), range(44) t(seq)),
st AS (SELECT *, lead(x) OVER w AS x2, lead(y) OVER w AS y2 FROM wk WINDOW w AS (PARTITION BY map_id, route_id ORDER BY seq)),
sl AS (SELECT *, sqrt((x2 - x) ** 2 + (y2 - y) ** 2) AS length FROM st WHERE x2 IS NOT NULL AND (x2 <> x OR y2 <> y))"""


def walk(spark: SparkSession) -> DataFrame:
    q = F.col("seq")
    r = spark.createDataFrame([("m0", 0), ("m1", 1)], "map_id string, route_id long").withColumn("seq", F.explode(F.sequence(F.lit(0), F.lit(43))))
    return r.withColumns({"x": F.when(q < 20, 2 + q).when(q < 30, 21).otherwise(q - 8), "y": F.when(q < 20, 3).when(q < 30, q - 16).otherwise(q - 16)})


@add("path_resum", f"""WITH {CLASSES}, {WALK}, pg AS (SELECT map_id, y, x, cost + v / 256.0::DOUBLE AS c FROM cg)
SELECT sl.map_id, route_id, round(sum(length * (a.c + b.c) / 2), 6) AS recomputed_cost FROM sl JOIN pg a ON a.map_id = sl.map_id AND a.x = sl.x AND a.y = sl.y JOIN pg b ON b.map_id = sl.map_id AND b.x = x2 AND b.y = y2 GROUP BY 1, 2""")
def path_resum(s, d):
    return route.summed_cost(walk(s), priced(s, d)).select("map_id", "route_id", F.round("recomputed_cost", 6).alias("recomputed_cost"))


@add("route_breakdown", f"""WITH {CLASSES}, {WALK}, t AS (SELECT sl.map_id, route_id, class_name, sum(length) AS l FROM sl JOIN cg ON cg.map_id = sl.map_id AND cg.x = floor((sl.x + x2) / 2.0 + 0.5) AND cg.y = floor((sl.y + y2) / 2.0 + 0.5) GROUP BY 1, 2, 3)
SELECT map_id, route_id, class_name, round(l / sum(l) OVER (PARTITION BY map_id, route_id), 6) AS fraction FROM t""")
def route_breakdown(s, d):
    return route.breakdown(walk(s), classes(s, d)).select("map_id", "route_id", "class_name", F.round("fraction", 6).alias("fraction"))


add("barrier_check", f"WITH {CLASSES}, {WALK} SELECT wk.map_id, route_id, CAST(seq AS INTEGER) AS seq, wk.x, wk.y FROM wk JOIN cg USING (map_id, x, y) WHERE class_name IN ('water', 'out_of_bounds')")(lambda s, d: route.barriers(walk(s), classes(s, d)).select("map_id", "route_id", "seq", "x", "y"))

MARKERS = """
mk AS (SELECT map_id, CAST(row_number() OVER (PARTITION BY map_id ORDER BY seq) - 1 AS BIGINT) AS id, 'control' AS kind, x, y, radius, code FROM ctl),
mx AS (SELECT map_id, max(id) + 1 AS n FROM mk GROUP BY 1),
ed AS (SELECT * FROM mk UNION ALL SELECT map_id, n, 'start', 5.0, 6.0, 10.0, NULL FROM mx WHERE map_id IN ('0', '3') UNION ALL SELECT map_id, n + CAST(map_id IN ('0', '3') AS BIGINT), 'finish', 9.0, 8.0, 10.0, NULL FROM mx WHERE map_id IN ('3', '4'))"""


def editable(spark: SparkSession, sf_dir: str) -> DataFrame:
    starts = spark.createDataFrame([("0", 5.0, 6.0), ("3", 5.0, 6.0)], "map_id string, x double, y double")
    return edits.editable_markers(controls(spark, sf_dir), starts, spark.createDataFrame([("3", 9.0, 8.0), ("4", 9.0, 8.0)], "map_id string, x double, y double"))


MARKER_SCHEMA = "map_id string, kind string, x double, y double, radius double, code string"
add("edit_init", f"WITH {CONTROLS}, {MARKERS} SELECT map_id, id, kind, x, y, radius, code FROM ed")(editable)
add("edit_add", f"""WITH {CONTROLS}, {MARKERS} SELECT map_id, id, kind, x, y, radius, code FROM ed WHERE NOT (map_id = '3' AND kind = 'start')
UNION ALL SELECT map_id, max(id) + 1, CASE map_id WHEN '3' THEN 'start' ELSE 'control' END, 1.5, 2.5, CASE map_id WHEN '3' THEN 10.0 ELSE 12.0 END, NULL FROM ed WHERE map_id IN ('1', '3') GROUP BY 1""")(
    lambda s, d: edits.added(editable(s, d), s.createDataFrame([("3", "start", 1.5, 2.5, 10.0, None), ("1", "control", 1.5, 2.5, 12.0, None)], MARKER_SCHEMA))
)
add("edit_move", f"WITH {CONTROLS}, {MARKERS} SELECT map_id, id, kind, CASE WHEN id = 2 AND map_id IN ('1', '2') THEN 77.0 ELSE x END AS x, CASE WHEN id = 2 AND map_id IN ('1', '2') THEN 66.0 ELSE y END AS y, radius, code FROM ed")(
    lambda s, d: edits.moved(editable(s, d), s.createDataFrame([("1", 2, 77.0, 66.0), ("2", 2, 77.0, 66.0)], "map_id string, id long, x double, y double"))
)
add("edit_delete", f"WITH {CONTROLS}, {MARKERS} SELECT map_id, id, kind, x, y, radius, code FROM ed WHERE NOT (id = 1 AND map_id IN ('0', '5'))")(lambda s, d: edits.deleted(editable(s, d), s.createDataFrame([("0", 1), ("5", 1)], "map_id string, id long")))
add("edit_fold", f"WITH {CONTROLS}, {MARKERS} SELECT map_id, id, kind, CASE WHEN id = 3 AND map_id = '1' THEN 2.0 ELSE x END AS x, CASE WHEN id = 3 AND map_id = '1' THEN 3.0 ELSE y END AS y, radius, code FROM ed WHERE NOT (id = 4 AND map_id = '1')")(
    lambda s, d: edits.folded(editable(s, d), s.createDataFrame([("1", 1, "move", 3, 1.0, 1.0), ("1", 2, "move", 3, 2.0, 3.0), ("1", 3, "move", 4, 9.0, 9.0), ("1", 4, "delete", 4, None, None)], "map_id string, seq int, op string, id long, x double, y double"))
)


@add("edit_recolor", f"""WITH {POINTS}, {RINGS}, hit AS (SELECT p.map_id, pt_id, poly_id FROM pts p JOIN edge e ON e.map_id = p.map_id AND (y1 > y) <> (y2 > y) AND x < (x2 - x1) * (y - y1) / (y2 - y1) + x1 GROUP BY ALL HAVING count(*) % 2 = 1),
mt AS (SELECT map_id, pt_id, max(poly_id) AS poly_id FROM hit GROUP BY 1, 2), lt AS (SELECT map_id, poly_id, max(pt_id) AS pt_id FROM mt GROUP BY 1, 2)
SELECT p.map_id, p.poly_id, CASE WHEN lt.pt_id IS NULL THEN class_name WHEN lt.pt_id % 3 = 0 THEN 'forest' ELSE 'water' END AS class_name FROM polys p LEFT JOIN lt USING (map_id, poly_id)""")
def recoloured(s: SparkSession, d: str) -> DataFrame:
    taps = points(s, d).withColumn("class_name", F.when(F.col("pt_id") % 3 == 0, "forest").otherwise("water"))
    return edits.recoloured(rings(s, d), taps).select("map_id", "poly_id", "class_name")

add("corrected_groups", f"WITH {RINGS} SELECT map_id, class_name, min(poly_id) AS first, count(*) AS n FROM polys GROUP BY 1, 2")(lambda s, d: edits.grouped(rings(s, d)).select("map_id", "class_name", "first", F.size("rings").cast("long").alias("n")))
add("radius_default", f"WITH {CONTROLS}, dm(map_id) AS (VALUES ('0'), ('2'), ('none')) SELECT dm.map_id, round(coalesce(avg(radius), 0.013 * sqrt(200.0 ** 2 + 150.0 ** 2)), 6) AS radius FROM dm LEFT JOIN ctl USING (map_id) GROUP BY 1")(
    lambda s, d: edits.default_radius(controls(s, d).withColumn("kind", F.lit("control")), s.createDataFrame([("0", 200, 150), ("2", 200, 150), ("none", 200, 150)], "map_id string, w int, h int")).select("map_id", F.round("radius", 6).alias("radius"))
)


def exported(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    maps = rings(spark, sf_dir).select("map_id").distinct().select("map_id", F.concat(F.lit("map"), "map_id", F.lit(".jpg")).alias("source_photo"), F.lit(200).alias("width"), F.lit(150).alias("height"), F.lit(0.5).alias("scale_to_original"), F.when(F.col("map_id") == "2", 12.5).alias("mn_line_spacing_px"), (F.col("map_id") == "1").alias("quad_found"))
    xy = "map_id string, x double, y double"
    routes = spark.createDataFrame([("1", 0, 9.5, 9.5, [{"x": 1, "y": 2}, {"x": 3, "y": 4}]), ("2", 0, 0.0, 0.0, [{"x": 1, "y": 2}])], "map_id string, route_id long, cost double, recomputed_cost double, points array<struct<x:int,y:int>>")
    shares = spark.createDataFrame([("1", 0, "path", 0.75), ("1", 0, "forest", 0.25)], "map_id string, route_id long, class_name string, fraction double")
    return maps, geojson.features(maps, rings(spark, sf_dir), segments(spark, sf_dir), controls(spark, sf_dir), spark.createDataFrame([("0", 5.0, 6.0)], xy), spark.createDataFrame([("1", 9.5, 8.0)], xy), routes, shares)


NUMBER = "regexp_replace(printf('%.6f', round(CAST({} AS DOUBLE), 6)), '\\.?0+$', '')"
PT = "'[' || " + NUMBER.format("{0}") + " || ',' || " + NUMBER.format("150 - ({1})") + " || ']'"
FEATURES = f"""{RINGS}, {SEGMENTS}, {CONTROLS}, mp AS (SELECT DISTINCT map_id FROM polys),
ft AS (
  SELECT map_id, 0 AS layer, CAST(list_position({EXPORT_ORDER}, class_name) AS BIGINT) * 4294967296 + poly_id AS ord,
    '{{"type":"Feature","geometry":{{"type":"Polygon","coordinates":[[' || array_to_string(list_transform(list_concat(ring, [ring[1]]), lambda p: {PT.format('p.x', 'p.y')}), ',') || ']]}},"properties":{{"terrain_class":"' || class_name || '"}}}}' AS feature FROM polys
  UNION ALL SELECT map_id, CASE role WHEN 'path' THEN 1 ELSE 5 END, seg_id, '{{"type":"Feature","geometry":{{"type":"LineString","coordinates":[' || {PT.format('x1', 'y1')} || ',' || {PT.format('x2', 'y2')} || ']}},"properties":' || CASE role WHEN 'path' THEN '{{"terrain_class":"path"}}' ELSE '{{"role":"course_leg"}}' END || '}}' FROM seg JOIN mp USING (map_id)
  UNION ALL SELECT map_id, 2, seq, '{{"type":"Feature","geometry":{{"type":"Point","coordinates":' || {PT.format('x', 'y')} || '}},"properties":{{"role":"control","code":' || coalesce('"' || code || '"', 'null') || '}}}}' FROM ctl JOIN mp USING (map_id)
  UNION ALL SELECT '0', 3, 0, '{{"type":"Feature","geometry":{{"type":"Point","coordinates":[5,144]}},"properties":{{"role":"start"}}}}'
  UNION ALL SELECT '1', 4, 0, '{{"type":"Feature","geometry":{{"type":"Point","coordinates":[9.5,142]}},"properties":{{"role":"finish"}}}}'
  UNION ALL SELECT '1', 6, 0, '{{"type":"Feature","geometry":{{"type":"LineString","coordinates":[[1,148],[3,146]]}},"properties":{{"role":"demo_route","cost":9.5,"recomputed_cost":9.5,"terrain_breakdown":{{"path":0.75,"forest":0.25}}}}}}')"""
add("geojson_features", f"WITH {FEATURES} SELECT map_id, layer, ord, feature FROM ft")(lambda s, d: exported(s, d)[1])
DOCS = f"""WITH {FEATURES}, fl AS (SELECT map_id, string_agg(feature, ',' ORDER BY layer, ord) AS f FROM ft GROUP BY 1)
SELECT map_id, '{{"type":"FeatureCollection","features":[' || f || '],"properties":{{"source_photo":"map' || map_id || '.jpg","image_width_px":200,"image_height_px":150,"scale_to_original_photo":0.5,"magnetic_north_line_spacing_px":' || CASE map_id WHEN '2' THEN '12.5' ELSE 'null' END || ',"quad_rectification_found":' || CASE map_id WHEN '1' THEN 'true' ELSE 'false' END || '}}}}' AS geojson FROM mp JOIN fl USING (map_id)"""
add("geojson_doc", DOCS)(lambda s, d: geojson.documents(*exported(s, d)))
add("geojson_scale", f"WITH {RINGS} SELECT DISTINCT map_id, 0.5::DOUBLE AS scale FROM polys")(lambda s, d: geojson.documents(*exported(s, d)).select("map_id", geojson.original_scale(F.col("geojson")).alias("scale")))


@add("map_summary", f"""WITH {RINGS}, {CONTROLS}, c AS (SELECT map_id, count(*) AS controls, count(code) AS codes FROM ctl GROUP BY 1), k AS (SELECT map_id, class_name, count(*) AS n FROM polys GROUP BY 1, 2),
t AS (SELECT map_id, string_agg(class_name || '=' || CAST(n AS VARCHAR), ', ' ORDER BY n DESC, class_name) AS classes FROM k GROUP BY 1) SELECT map_id, classes, coalesce(controls, 0) AS controls, coalesce(codes, 0) AS codes FROM t LEFT JOIN c USING (map_id)""")
def summary(s, d):
    n = rings(s, d).groupBy("map_id", "class_name").agg(F.count("*").alias("n"))
    listed = n.groupBy("map_id").agg(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("o"), "class_name", "n"))).alias("l"))
    listed = listed.select("map_id", F.array_join(F.transform("l", lambda x: F.concat_ws("=", x["class_name"], x["n"].cast("string"))), ", ").alias("classes"))
    c = controls(s, d).groupBy("map_id").agg(F.count("*").alias("controls"), F.count("code").alias("codes"))
    return listed.join(c, "map_id", "left").select("map_id", "classes", F.coalesce("controls", F.lit(0)).alias("controls"), F.coalesce("codes", F.lit(0)).alias("codes"))


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raster, valid mask, cost grid, least-cost route, and what the route runs through."""
    return route.breakdown(walked(solved(spark, sf_dir)), classes(spark, sf_dir)).orderBy("map_id", F.desc("fraction"), "class_name")


add("terrain_route")(flagship)
