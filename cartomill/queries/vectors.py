"""Queries on points, rings, segments and courses."""

from __future__ import annotations

from pyspark.sql import functions as F

from cartomill.functions import geometry as G
from cartomill.operators import course, lines, vector
from cartomill.queries.data import CONTROLS, POINTS, RINGS, SEGMENTS, controls, points, rings, segments, table
from cartomill.schemas import EXPORT_ORDER

QUERIES, SQL = {}, {}


def add(name: str, sql: str | None = None):
    def put(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return put


PIP = f"WITH {POINTS}, {RINGS}, hit AS (SELECT p.map_id, pt_id, x, y, poly_id FROM pts p JOIN edge e ON e.map_id = p.map_id AND (y1 > y) <> (y2 > y) AND x < (x2 - x1) * (y - y1) / (y2 - y1) + x1 GROUP BY ALL HAVING count(*) % 2 = 1)"
add("pip_join", PIP + " SELECT map_id, pt_id, poly_id FROM hit")(lambda s, d: vector.points_in_polygons(points(s, d), rings(s, d)).select("map_id", "pt_id", "poly_id"))
add("top_polygon", PIP + " SELECT map_id, pt_id, max(poly_id) AS poly_id FROM hit GROUP BY 1, 2")(lambda s, d: vector.topmost(points(s, d), rings(s, d)))
SHOE = "polys_area AS (SELECT map_id, poly_id, abs(sum(x1 * y2 - x2 * y1)) / 2 AS area, sum(sqrt((x2 - x1) * (x2 - x1) + (y2 - y1) * (y2 - y1))) AS len FROM edge GROUP BY 1, 2)"
add("shoelace", f"WITH {RINGS}, {SHOE} SELECT map_id, poly_id, round(area, 6) AS area, round(len, 6) AS len FROM polys_area")(lambda s, d: rings(s, d).select("map_id", "poly_id", F.round(G.shoelace(F.col("ring")), 6).alias("area"), F.round(G.perimeter(F.col("ring")), 6).alias("len")))
add("largest_ring", f"WITH {RINGS}, {SHOE} SELECT map_id, poly_id, area FROM (SELECT *, row_number() OVER (PARTITION BY map_id ORDER BY area DESC, poly_id) AS n FROM polys_area) WHERE n = 1")(lambda s, d: vector.largest(rings(s, d)).select("map_id", "poly_id", "area"))
CORNER = "min_by(ring[i].x, ({0}) * 1000 + i) AS {1}x, min_by(ring[i].y, ({0}) * 1000 + i) AS {1}y"
CORNERS = ", ".join(CORNER.format(e, n) for e, n in (("ring[i].x + ring[i].y", "tl"), ("ring[i].y - ring[i].x", "tr"), ("-ring[i].x - ring[i].y", "br"), ("ring[i].x - ring[i].y", "bl")))


@add("order_corners", f"WITH {RINGS} SELECT map_id, poly_id, {CORNERS} FROM polys, range(1, 5) t(i) GROUP BY 1, 2")
def corners(s, d):
    c = G.corners(F.col("ring"))
    return rings(s, d).select("map_id", "poly_id", *[c[n][k].cast("double").alias(n + k) for n in c for k in "xy"])


@add("nearest_marker", f"""WITH {POINTS}, {CONTROLS}, hit AS (SELECT p.map_id, pt_id, seq, sqrt((p.x - c.x) * (p.x - c.x) + (p.y - c.y) * (p.y - c.y)) AS dd, radius FROM pts p JOIN ctl c USING (map_id))
SELECT map_id, pt_id, arg_min(seq, (dd, seq)) AS id, round(min(dd), 6) AS d FROM hit WHERE dd <= radius + 14 GROUP BY 1, 2""")
def nearest(s, d):
    return vector.nearest_marker(points(s, d), controls(s, d).withColumn("id", F.col("seq"))).select("map_id", "pt_id", "id", F.round("d", 6).alias("d"))


@add("fill_polygons", f"""WITH {RINGS}, cell AS (SELECT CAST(a.y AS INTEGER) AS y, CAST(b.x AS INTEGER) AS x FROM range(-5, 130) a(y), range(-10, 130) b(x))
SELECT map_id, class_name, y, x FROM edge e JOIN cell c ON (y1 > y) <> (y2 > y) AND x < (x2 - x1) * (y - y1) / (y2 - y1) + x1 GROUP BY ALL HAVING count(*) % 2 = 1""")
def fill(s, d):
    return vector.filled(rings(s, d), ["map_id", "class_name"], boundary=False).select("map_id", "class_name", "y", "x")


@add("draw_lines", f"""WITH {SEGMENTS}, p AS (SELECT map_id, x1, y1, x2, y2, CAST(b.x AS INTEGER) AS x, CAST(a.y AS INTEGER) AS y, (x2 - x1) * (x2 - x1) + (y2 - y1) * (y2 - y1) AS sq FROM seg, LATERAL (SELECT unnest(range(CAST(least(x1, x2) AS BIGINT) - 3, CAST(greatest(x1, x2) AS BIGINT) + 4)) AS x) b, LATERAL (SELECT unnest(range(CAST(least(y1, y2) AS BIGINT) - 3, CAST(greatest(y1, y2) AS BIGINT) + 4)) AS y) a),
t AS (SELECT *, least(greatest(((x - x1) * (x2 - x1) + (y - y1) * (y2 - y1)) / sq, 0), 1) AS k FROM p)
SELECT DISTINCT map_id, y, x FROM t WHERE sqrt(power(x - (x1 + k * (x2 - x1)), 2) + power(y - (y1 + k * (y2 - y1)), 2)) <= 1.5""")
def draw(s, d):
    return vector.lines(segments(s, d), ["map_id"])


POLAR = f"WITH {SEGMENTS}, p AS (SELECT *, sqrt((x2 - x1) * (x2 - x1) + (y2 - y1) * (y2 - y1)) AS length, ((degrees(atan2(y2 - y1, x2 - x1)) % 180) + 180) % 180 AS angle, (x1 + x2) / 2 AS mid_x, (y1 + y2) / 2 AS mid_y FROM seg)"
add("seg_polar", POLAR + " SELECT map_id, seg_id, round(length, 6) AS length, round(angle, 6) AS angle, mid_x, mid_y FROM p WHERE length >= 40")(lambda s, d: lines.polar(segments(s, d), 40).select("map_id", "seg_id", F.round("length", 6).alias("length"), F.round("angle", 6).alias("angle"), "mid_x", "mid_y"))
add("border_drop", POLAR + " SELECT map_id, seg_id FROM p WHERE mid_x BETWEEN 0.03::DOUBLE * 1000 AND (1 - 0.03::DOUBLE) * 1000 AND mid_y BETWEEN 0.03::DOUBLE * 700 AND (1 - 0.03::DOUBLE) * 700 AND abs(angle - 90) <= 10")(lambda s, d: lines.near_vertical(lines.without_border(lines.polar(segments(s, d)), 1000, 700)).select("map_id", "seg_id"))
GAPS = POLAR + """, v AS (SELECT * FROM p WHERE abs(angle - 90) <= 10), f AS (SELECT *, CASE WHEN mid_x - lag(mid_x) OVER (PARTITION BY map_id ORDER BY mid_x, seg_id) > 4 THEN 1 ELSE 0 END AS nw FROM v),
c AS (SELECT *, sum(nw) OVER (PARTITION BY map_id ORDER BY mid_x, seg_id ROWS UNBOUNDED PRECEDING) AS cluster FROM f),
z AS (SELECT map_id, CAST(cluster AS BIGINT) AS cluster, count(*) AS n, avg(mid_x) AS centre, max(mid_y) - min(mid_y) AS span FROM c GROUP BY 1, 2)"""


def clusters(s, d):
    return lines.cluster_centres(lines.gap_clusters(lines.near_vertical(lines.polar(segments(s, d))), ["map_id"], "mid_x", 4.0, ["seg_id"]), ["map_id"], 2, 20)


add("gap_clusters", GAPS + " SELECT map_id, cluster, n, round(centre, 6) AS centre FROM z WHERE n >= 2 AND span >= 20")(lambda s, d: clusters(s, d).select("map_id", "cluster", "n", F.round("centre", 6).alias("centre")))


@add("line_spacing", GAPS + """, a AS (SELECT map_id, centre, centre - lag(centre) OVER (PARTITION BY map_id ORDER BY centre) AS gap FROM z WHERE n >= 2 AND span >= 20), m AS (SELECT map_id, count(*) AS n, median(gap) AS mid FROM a GROUP BY 1),
k AS (SELECT map_id, centre, n FROM a JOIN m USING (map_id) WHERE n < 3 OR gap IS NULL OR abs(gap - mid) / greatest(mid, 1e-6) < 0.4),
kg AS (SELECT *, CASE WHEN n >= 3 THEN centre - lag(centre) OVER (PARTITION BY map_id ORDER BY centre) END AS kgap FROM k)
SELECT map_id, count(*) AS kept, round(sum(centre), 6) AS total, round(median(kgap), 6) AS spacing FROM kg GROUP BY 1""")
def spacing(s, d):
    r = lines.spacing(clusters(s, d), ["map_id"])
    return r.select("map_id", F.size("kept").cast("long").alias("kept"), F.round(F.aggregate("kept", F.lit(0.0), lambda a, x: a + x), 6).alias("total"), F.round("spacing", 6).alias("spacing"))


@add("greedy_nms", f"""WITH RECURSIVE {CONTROLS}, o AS (SELECT *, row_number() OVER (PARTITION BY map_id ORDER BY strength DESC, x, y) AS n FROM ctl),
r AS (SELECT map_id, 0::BIGINT AS n, []::STRUCT(x DOUBLE, y DOUBLE, radius DOUBLE)[] AS kept FROM (SELECT DISTINCT map_id FROM o)
  UNION ALL SELECT r.map_id, o.n, CASE WHEN len(list_filter(r.kept, lambda k: sqrt((k.x - o.x) * (k.x - o.x) + (k.y - o.y) * (k.y - o.y)) < o.radius)) > 0 THEN r.kept ELSE list_append(r.kept, {{'x': o.x, 'y': o.y, 'radius': o.radius}}) END
  FROM r JOIN o ON o.map_id = r.map_id AND o.n = r.n + 1),
l AS (SELECT map_id, arg_max(kept, n) AS kept FROM r GROUP BY 1)
SELECT map_id, CAST(i - 1 AS INTEGER) AS seq, kept[i].x AS x, kept[i].y AS y, kept[i].radius AS radius FROM l, range(1, 2000) t(i) WHERE i <= len(kept)""")
def nms(s, d):
    return course.suppressed(controls(s, d))


INK = "ink AS (SELECT DISTINCT CAST(l_partkey % 6 AS VARCHAR) AS map_id, CAST(l_orderkey % 160 AS INTEGER) AS y, CAST((l_partkey * 7 + l_linenumber) % 210 AS INTEGER) AS x FROM lineitem)"


@add("ring_coverage", f"""WITH {CONTROLS}, {INK}, pr AS (SELECT map_id, seq, i, CAST(trunc(round(x + (radius + dr) * cos(2 * pi() * i / 144), 6)) AS INTEGER) AS px, CAST(trunc(round(y + (radius + dr) * sin(2 * pi() * i / 144), 6)) AS INTEGER) AS py FROM ctl, range(144) a(i), range(-3, 4) b(dr)),
n AS (SELECT pr.map_id, seq, count(DISTINCT i) AS n FROM pr JOIN ink ON ink.map_id = pr.map_id AND ink.x = px AND ink.y = py GROUP BY 1, 2)
SELECT c.map_id, c.seq, round(coalesce(n, 0) / 144.0::DOUBLE, 6) AS coverage FROM ctl c LEFT JOIN n USING (map_id, seq)""")
def coverage(s, d):
    li = table(s, d, "lineitem")
    ink = li.select((F.col("l_partkey") % 6).cast("string").alias("map_id"), (F.col("l_orderkey") % 160).cast("int").alias("y"), ((F.col("l_partkey") * 7 + F.col("l_linenumber")) % 210).cast("int").alias("x"))
    return course.ring_coverage(controls(s, d), ink).select("map_id", "seq", F.round("coverage", 6).alias("coverage"))


FINISH = f"""WITH {CONTROLS.replace("ctl AS", "wide AS")}, ctl AS (SELECT map_id, seq, x % 60 AS x, y % 60 AS y, radius FROM wide), f AS (SELECT a.map_id, a.seq AS a, b.seq AS b, (a.x + b.x) / 2 AS x, (a.y + b.y) / 2 AS y, row_number() OVER (PARTITION BY a.map_id ORDER BY a.seq, b.seq) AS n FROM ctl a JOIN ctl b ON a.map_id = b.map_id AND a.seq < b.seq
  AND sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)) < 4 * greatest(a.radius, b.radius) AND abs(a.radius - b.radius) > 1.5)"""


def crowded(s, d):
    return controls(s, d).withColumns({"x": F.col("x") % 60, "y": F.col("y") % 60})


@add("finish_dedupe", FINISH.replace("< 4 *", "< 0.5 *") + " SELECT map_id, a, b, x, y FROM f WHERE n = 1")
def finish(s, d):
    return course.finish(crowded(s, d)).select("map_id", "a", "b", "x", "y")


@add("finish_removed", FINISH.replace("< 4 *", "< 0.5 *") + " SELECT map_id, seq FROM ctl WHERE NOT EXISTS (SELECT 1 FROM f WHERE f.n = 1 AND f.map_id = ctl.map_id AND ctl.seq IN (f.a, f.b))")
def removed(s, d):
    return course.without_finish(crowded(s, d)).select("map_id", "seq")


TRI = """tri AS (SELECT CAST(k % 6 AS VARCHAR) AS map_id, k AS tri_id, 10.0::DOUBLE AS x1, 10.0::DOUBLE AS y1, (10 + 20 + k % 9)::DOUBLE AS x2, (10 + k % 4)::DOUBLE AS y2, (10 + 8 + k % 7)::DOUBLE AS x3, (10 + 15 + k % 8)::DOUBLE AS y3 FROM (SELECT c_custkey AS k FROM customer))"""


@add("triangle_score", f"""WITH {CONTROLS}, {TRI}, ar AS (SELECT map_id, list_sort(list(pi() * radius * radius)) AS l FROM ctl GROUP BY 1), am AS (SELECT map_id, l[len(l) // 2 + 1] AS area FROM ar),
s AS (SELECT t.*, area, abs((x2 - x1) * (y3 - y1) - (x3 - x1) * (y2 - y1)) / 2 AS own, sqrt((x1 - x2) ** 2 + (y1 - y2) ** 2) AS a, sqrt((x2 - x3) ** 2 + (y2 - y3) ** 2) AS b, sqrt((x3 - x1) ** 2 + (y3 - y1) ** 2) AS c FROM tri t JOIN am USING (map_id)),
u AS (SELECT *, round(1 - sqrt(((a - (a + b + c) / 3) ** 2 + (b - (a + b + c) / 3) ** 2 + (c - (a + b + c) / 3) ** 2) / 3) / ((a + b + c) / 3), 9) AS score FROM s WHERE own BETWEEN 0.25 * area AND 1.3 * area)
SELECT map_id, round((x1 + x2 + x3) / 3, 6) AS x, round((y1 + y2 + y3) / 3, 6) AS y, round(score, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY map_id ORDER BY score DESC, tri_id) AS n FROM u WHERE score >= 0.85) WHERE n = 1""")
def triangles(s, d):
    k = F.col("c_custkey")
    t = table(s, d, "customer").select((k % 6).cast("string").alias("map_id"), k.alias("tri_id"), F.lit(10.0).alias("x1"), F.lit(10.0).alias("y1"), (30 + k % 9).cast("double").alias("x2"), (10 + k % 4).cast("double").alias("y2"), (18 + k % 7).cast("double").alias("x3"), (25 + k % 8).cast("double").alias("y3"))
    return course.start_triangle(t, controls(s, d)).select("map_id", F.round("x", 6).alias("x"), F.round("y", 6).alias("y"), F.round("score", 6).alias("score"))


STARTS = [("0", 50.0, 40.0), ("3", 120.0, 10.0), ("5", 0.0, 0.0)]


@add("endpoints", f"""WITH {CONTROLS}, st(map_id, x1, y1) AS (VALUES {", ".join(f"('{m}', {x}::DOUBLE, {y}::DOUBLE)" for m, x, y in STARTS)}),
n AS (SELECT map_id, x1, y1, c.x AS x2, c.y AS y2, row_number() OVER (PARTITION BY map_id ORDER BY (c.x - x1) ** 2 + (c.y - y1) ** 2, seq) AS n FROM st JOIN ctl c USING (map_id)),
o AS (SELECT map_id, list((x, y) ORDER BY seq) AS l FROM ctl WHERE map_id NOT IN (SELECT map_id FROM st) GROUP BY 1 HAVING count(*) >= 2)
SELECT map_id, x1, y1, x2, y2 FROM n WHERE n = 1 UNION ALL SELECT map_id, l[1][1], l[1][2], l[2][1], l[2][2] FROM o""")
def ends(s, d):
    return course.endpoints(controls(s, d), s.createDataFrame(STARTS, "map_id string, x double, y double"))


add("code_parse", r"SELECT doc_id, regexp_extract(trim(text, ' '), '\d{1,2}-\d{1,3}') AS code FROM documents WHERE regexp_extract(trim(text, ' '), '\d{1,2}-\d{1,3}') <> ''")(
    lambda s, d: course.control_codes(table(s, d, "documents").select(F.lit("d").alias("map_id"), F.col("doc_id").alias("seq"), F.lit(0).alias("ord"), "text", F.lit(1.0).alias("conf"))).select(F.col("seq").alias("doc_id"), "code")
)
add("calib_lookup", "SELECT doc_id, source, coalesce(CASE source WHEN 'src1' THEN 40.0 WHEN 'src7' THEN 44.0 WHEN 'src9' THEN 46.0 END, 38.0)::DOUBLE AS votes FROM documents")(
    lambda s, d: table(s, d, "documents").select("doc_id", "source").join(F.broadcast(s.createDataFrame([("src1", 40.0), ("src7", 44.0), ("src9", 46.0)], "source string, v double")), "source", "left").select("doc_id", "source", F.coalesce("v", F.lit(38.0)).alias("votes"))
)
add("layer_filter", f"WITH {RINGS}, {SHOE} SELECT p.map_id, poly_id FROM polys p JOIN polys_area USING (map_id, poly_id) WHERE class_name NOT IN ('rock', 'marsh') AND area >= 150")(
    lambda s, d: rings(s, d).where(~F.col("class_name").isin("rock", "marsh") & (F.size("ring") >= 2) & (G.shoelace(F.col("ring")) >= 150)).select("map_id", "poly_id")
)
add("layer_counts", f"WITH {RINGS}, cl(class_name) AS (VALUES {', '.join(repr((c,)).replace(',)', ')') for c in [*EXPORT_ORDER, 'path'])}) SELECT cl.class_name, count(poly_id) AS n FROM cl LEFT JOIN polys USING (class_name) GROUP BY 1")(
    lambda s, d: s.createDataFrame([(c,) for c in [*EXPORT_ORDER, "path"]], "class_name string").join(rings(s, d), "class_name", "left").groupBy("class_name").agg(F.count("poly_id").alias("n"))
)
add("flip_y", f"WITH {POINTS} SELECT map_id, pt_id, x, 100 - y AS y FROM pts")(lambda s, d: points(s, d).select("map_id", "pt_id", "x", G.flipped(F.col("y"), F.lit(100)).alias("y")))
add("json_scalar", "SELECT event_id, CAST(json_extract_string(props, '$.k') AS DOUBLE) AS k FROM events")(lambda s, d: table(s, d, "events").select("event_id", F.get_json_object("props", "$.k").cast("double").alias("k")))
add("coverage_ratio", f"WITH {RINGS}, {SHOE} SELECT map_id, round(sum(area) / 10000.0::DOUBLE, 9) AS ratio FROM polys_area GROUP BY 1")(lambda s, d: rings(s, d).groupBy("map_id").agg(F.round(F.sum(G.shoelace(F.col("ring"))) / 10000.0, 9).alias("ratio")))
