"""Operators on small synthetic inputs with known results."""

from __future__ import annotations

import json
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from cartomill.functions import geometry as G
from cartomill.functions import shapes
from cartomill.operators import components, course, edits, imaging, lines, raster, route, vector
from cartomill.plans import analyze
from cartomill.sources import images

RINGS = "map_id string, poly_id long, class_name string, ring array<struct<x:double,y:double>>"
SEGS = "map_id string, seg_id long, role string, x1 double, y1 double, x2 double, y2 double"


def square(c, a, b, i=0, m="m"):
    return (m, i, c, [{"x": float(x), "y": float(y)} for x, y in ((a, a), (b, a), (b, b), (a, b))])


def grid(spark, w, h):
    return spark.range(w * h).select(F.lit("m").alias("map_id"), F.floor(F.col("id") / w).cast("int").alias("y"), (F.col("id") % w).cast("int").alias("x"))


def classes(spark, w, h, polys, segs=(), valid=None):
    g = grid(spark, w, h)
    if valid:
        g = g.withColumn("valid", F.expr(valid))
    out = route.class_grid(g, spark.createDataFrame(list(polys), RINGS), spark.createDataFrame(list(segs), SEGS), "valid" if valid else None)
    return {(r.y, r.x): (r.cost, r.class_name) for r in out.collect()}


def test_cost_grid(spark):
    assert {v[0] for v in classes(spark, 20, 20, []).values()} == {1.0}
    c = classes(spark, 10, 10, [square("thicket", 2, 8)])
    assert c[5, 5][0] == 4.0 and c[0, 0][0] == 1.0
    c = classes(spark, 10, 10, [square("clearing", 0, 10), square("water", 3, 7, 1)], [("m", 0, "path", 0.0, 1.0, 9.0, 1.0)], "y < 9")
    assert (c[5, 5], c[8, 8][1], c[1, 8][1], c[9, 0][1]) == ((20.0, "water"), "clearing", "path", "outside_valid_mask")
    c = classes(spark, 20, 20, [square("forest", 0, 20)], [("m", 0, "path", 0.0, 10.0, 19.0, 10.0)])
    assert c[10, 10][0] == 0.8 and c[1, 1][0] == 1.5
    c = classes(spark, 10, 10, [], [], "x >= 2 and x < 8 and y >= 2 and y < 8")
    assert c[0, 0][0] == 50 and c[5, 5][0] == 1
    c = classes(spark, 10, 10, [square("thicket", 1, 8), square("rock", 3, 6, 1)])
    assert c[4, 4][1] == "rock"


def walk(spark, pts):
    return spark.createDataFrame([("m", 0, i, x, y) for i, (x, y) in enumerate(pts)], "map_id string, route_id long, seq int, x int, y int")


def test_breakdown(spark):
    g = grid(spark, 20, 20)
    cls = route.class_grid(g, spark.createDataFrame([square("forest", 0, 20)], RINGS), spark.createDataFrame([("m", 0, "path", 0.0, 10.0, 19.0, 10.0)], SEGS))
    got = {r.class_name: r.fraction for r in route.breakdown(walk(spark, [(0, 10), (15, 10), (15, 19)]), cls).collect()}
    assert got == pytest.approx({"path": 15 / 24, "forest": 9 / 24})
    assert route.breakdown(walk(spark, [(1, 1)]), cls).count() == 0


def solve(spark, costs, a, b):
    h, w = costs.shape
    cells = spark.createDataFrame([("m", y, x, float(costs[y, x])) for y in range(h) for x in range(w)], "map_id string, y int, x int, cost double")
    ends = spark.createDataFrame([("m", 0, *map(float, a), *map(float, b))], "map_id string, route_id long, x1 double, y1 double, x2 double, y2 double")
    r = route.least_cost(cells, ends).collect()[0]
    return cells, r.cost, [(p.x, p.y) for p in r.points]


def test_routes(spark):
    c = np.full((11, 11), 10.0)
    c[5] = 1
    _, cost, pts = solve(spark, c, (0, 0), (10, 10))
    assert 5 in {y for _, y in pts} and cost < math.sqrt(200) * 10
    _, cost, pts = solve(spark, np.ones((10, 10)), (0, 0), (9, 0))
    assert cost == 9 and {y for _, y in pts} == {0} and pts[0] == (0, 0) and pts[-1] == (9, 0)
    _, _, pts = solve(spark, np.ones((5, 5)), (-3, -3), (100, 100))
    assert pts[0] == (0, 0) and pts[-1] == (4, 4)
    seed, v = 12345, []
    for _ in range(900):
        seed = (seed * 1103515245 + 12345) % 2**32
        v.append(0.5 + 4.5 * ((seed >> 8) & 0xFFFF) / 65535)
    cells, cost, pts = solve(spark, np.array(v).reshape(30, 30), (1, 2), (27, 24))
    assert route.summed_cost(walk(spark, pts), cells).collect()[0].recomputed_cost == pytest.approx(cost, rel=1e-9)
    cells, _, pts = solve(spark, np.ones((4, 4)), (2, 2), (2, 2))
    assert pts == [(2, 2)]


def test_hand_cost(spark):
    cells = spark.createDataFrame([("m", y, x, float(c)) for y in range(3) for x, c in enumerate((1, 2, 4))], "map_id string, y int, x int, cost double")
    got = route.summed_cost(walk(spark, [(0, 0), (1, 0), (2, 1)]), cells).collect()[0].recomputed_cost
    assert got == pytest.approx(1.5 + 3 * math.sqrt(2))


@pytest.mark.parametrize(("holes", "side", "want"), [([(8, 8), (24, 8), (40, 8), (8, 24), (24, 24), (40, 24)], 10, 1), ([(20, 20)], 20, 0), ([], 0, 0)])
def test_hatching(spark, holes, side, want):
    cond = " or ".join(f"(x >= {a} and x < {a + side} and y >= {b} and y < {b + side})" for a, b in holes) or "false"
    g = grid(spark, 60, 60).withColumn("on", F.expr(f"not ({cond})").cast("int"))
    assert imaging.hatched_polygons(g, "on").count() == want


def test_valid_mask(spark):
    boxes = spark.createDataFrame([("m", 0.0, 0.0, 0.5, 0.5)], "map_id string, x0 double, y0 double, x1 double, y1 double")
    v = {(r.y, r.x): r.valid for r in raster.valid_mask(grid(spark, 200, 100), boxes).collect()}
    assert not v[10, 10] and v[90, 190] and v[90, 10] and v[10, 190]


def test_noise_is_dropped(spark):
    g = grid(spark, 100, 100).withColumn("on", F.expr("(x between 10 and 39 and y between 10 and 39) or (x = 80 and y = 80)").cast("int"))
    rings = imaging.polygons(g, "on").select(G.shoelace(F.col("ring")).alias("a"), "ring").collect()
    assert len(rings) == 1 and rings[0].a >= 60
    assert all(10 <= p.x <= 40 and 10 <= p.y <= 40 for p in rings[0].ring)


def test_finish(spark):
    rows = [("m", 0, 100.0, 100.0, 10.0), ("m", 1, 101.0, 99.0, 14.0), ("m", 2, 500.0, 500.0, 12.0), ("n", 0, 0.0, 0.0, 10.0), ("n", 1, 500.0, 500.0, 10.0)]
    c = spark.createDataFrame(rows, "map_id string, seq int, x double, y double, radius double")
    f = course.finish(c).collect()
    assert [(r.map_id, r.x, r.y) for r in f] == [("m", 100.5, 99.5)]
    assert sorted((r.map_id, r.seq) for r in course.without_finish(c).collect()) == [("m", 2), ("n", 0), ("n", 1)]


def test_start_triangle(spark):
    def tri(side, skew=0.0):
        r = side / math.sqrt(3)
        p = [(100 + r * math.sin(a), 100 - r * math.cos(a)) for a in (0, 2 * math.pi / 3, 4 * math.pi / 3)]
        return [*p[0], p[1][0] + skew, p[1][1], *p[2]]

    sc = "map_id string, tri_id long, x1 double, y1 double, x2 double, y2 double, x3 double, y3 double"
    t = spark.createDataFrame([("a", 0, *tri(72)), ("b", 0, *tri(10)), ("c", 0, *tri(72, 90.0)), ("d", 0, *tri(72))], sc)
    c = spark.createDataFrame([(m, i, 300.0, 300.0 - 200 * i, 36.0) for m in "abc" for i in (0, 1)], "map_id string, seq int, x double, y double, radius double")
    got = course.start_triangle(t, c).collect()
    assert [r.map_id for r in got] == ["a"] and math.dist((got[0].x, got[0].y), (100, 100)) < 10


def test_controls_on_drawn_circles(spark):
    g = grid(spark, 160, 120)
    ring = " or ".join(f"abs(sqrt(pow(x - {a}, 2) + pow(y - {b}, 2)) - 15) <= 1.5" for a, b in ((50, 60), (110, 55)))
    ink = g.withColumn("ink", F.expr(ring).cast("int"))
    found = course.suppressed(imaging.circles(ink.select("map_id", "y", "x", (F.col("ink") * 255).alias("v")), raster.sizes(ink), 20, 0.05, 0.1))
    kept = course.ring_coverage(found, ink.where("ink = 1").select("map_id", "y", "x")).where("coverage >= 0.75").collect()
    for a, b in ((50, 60), (110, 55)):
        assert any(math.dist((r.x, r.y), (a, b)) <= 3 for r in kept)


def test_straight_lines(spark):
    px = spark.createDataFrame([("m", y, 20) for y in range(10, 60)], "map_id string, y int, x int")
    got = lines.line_segments(px, 40, 30, 3).collect()
    assert any(r.x1 == r.x2 == 20 and {r.y1, r.y2} == {10, 59} for r in got)


def exported(spark, **over):
    xy = "map_id string, x double, y double"
    t = {
        "maps": spark.createDataFrame([("m", "map0.jpg", 200, 150, 0.5, 12.5, False)], "map_id string, source_photo string, width int, height int, scale_to_original double, mn_line_spacing_px double, quad_found boolean"),
        "polygons": spark.createDataFrame([], RINGS), "segments": spark.createDataFrame([], SEGS),
        "controls": spark.createDataFrame([], "map_id string, seq int, x double, y double, radius double, code string"),
        "starts": spark.createDataFrame([], xy), "finishes": spark.createDataFrame([], xy),
        "routes": spark.createDataFrame([], "map_id string, route_id long, cost double, recomputed_cost double, points array<struct<x:int,y:int>>"),
        "breakdown": spark.createDataFrame([], "map_id string, route_id long, class_name string, fraction double"),
    } | over
    return json.loads(analyze.exported(t).collect()[0].geojson)


def test_export(spark):
    doc = exported(spark)
    assert doc["features"] == []
    assert doc["properties"] == {"source_photo": "map0.jpg", "image_width_px": 200, "image_height_px": 150, "scale_to_original_photo": 0.5, "magnetic_north_line_spacing_px": 12.5, "quad_rectification_found": False}
    three = [("m", 0, "forest", [{"x": 0.0, "y": 4.0}, {"x": 5.0, "y": 4.0}, {"x": 5.0, "y": 9.0}])]
    doc = exported(spark, polygons=spark.createDataFrame(three, RINGS), controls=spark.createDataFrame([("m", 0, 1.0, 2.0, 3.0, None)], "map_id string, seq int, x double, y double, radius double, code string"),
                   routes=spark.createDataFrame([("m", 0, 1.0, 1.0, [{"x": 1, "y": 1}, {"x": 2, "y": 1}])], "map_id string, route_id long, cost double, recomputed_cost double, points array<struct<x:int,y:int>>"),
                   breakdown=spark.createDataFrame([("m", 0, "path", 1.0)], "map_id string, route_id long, class_name string, fraction double"))
    ring = doc["features"][0]["geometry"]["coordinates"][0]
    assert len(ring) == 4 and ring[0] == ring[-1] == [0, 146] and doc["features"][0]["properties"]["terrain_class"] == "forest"
    assert doc["features"][1]["properties"] == {"role": "control", "code": None}
    assert doc["features"][2]["properties"]["terrain_breakdown"] == {"path": 1}


def test_shapes():
    assert shapes.area(shapes.hull([(0, 0), (4, 0), (4, 4), (0, 4), (2, 2)])) == 16
    wave = [(x, math.sin(x / 7) * 0.5) for x in range(100)] + [(x, 40 + math.sin(x) * 0.5) for x in range(99, -1, -1)]
    s = shapes.simplified(wave, 2)
    assert len(s) < 12 and abs(shapes.area(s) / shapes.area(wave) - 1) < 0.05
    assert not shapes.is_simple([(0, 0), (4, 4), (4, 0), (0, 4)]) and shapes.is_simple([(0, 0), (4, 0), (4, 4), (0, 4)])
    m = np.zeros((12, 12), bool)
    m[3:8, 2:9] = True
    assert shapes.area(shapes.outline(m)) == 24
    assert (shapes.median_filter(np.pad(np.ones((3, 3), int) * 9, 5), 3).max()) == 9
    img = np.arange(75).reshape(5, 5, 3)
    assert shapes.warped(img, [(0, 0), (4, 0), (4, 4), (0, 4)]).shape == (4, 4, 3)
    assert (shapes.warped(img, [(0, 0), (4, 0), (4, 4), (0, 4)])[[0, 0, -1, -1], [0, -1, 0, -1]] == img[[0, 0, -1, -1], [0, -1, 0, -1]]).all()
    e = shapes.canny(np.pad(np.full((10, 10), 200), 10), 50, 150)
    assert e.any() and not e[13:17, 13:17].any()


def test_png_round_trip(spark, tmp_path):
    rng = np.random.default_rng(0)
    img = rng.integers(0, 256, (7, 5, 3), np.uint8)
    (tmp_path / "one.png").write_bytes(images.png_bytes(img))
    (tmp_path / "bad.png").write_bytes(b"nothing")
    (tmp_path / "note.txt").write_text("x")
    rows = images.pixels(images.photos(spark, str(tmp_path)))
    got = {(r.y, r.x): (r.b, r.g, r.r) for r in rows.collect()}
    assert len(got) == 35 and all(got[y, x] == tuple(img[y, x]) for y in range(7) for x in range(5))
    assert bytes(images.encoded(rows).collect()[0].png)[:4] == b"\x89PNG"


def test_components(spark):
    m = spark.createDataFrame([("m", y, x) for y, x in [(0, 0), (1, 1), (2, 2), (5, 5), (5, 6), (9, 0)]], "map_id string, y int, x int")
    assert sorted(r.area for r in components.areas(m).collect()) == [1, 2, 3]
    assert sorted(r.area for r in components.areas(m, diagonal=False).collect()) == [1, 1, 1, 1, 2]
    assert components.areas(m.limit(0)).count() == 0


def test_edits(spark):
    c = spark.createDataFrame([("m", 0, 1.0, 1.0, 8.0, None), ("m", 1, 9.0, 9.0, 12.0, "7-31")], "map_id string, seq int, x double, y double, radius double, code string")
    xy = "map_id string, x double, y double"
    m = edits.editable_markers(c, spark.createDataFrame([("m", 3.0, 3.0)], xy), spark.createDataFrame([], xy))
    new = spark.createDataFrame([("m", "start", 5.0, 5.0, 10.0, None)], "map_id string, kind string, x double, y double, radius double, code string")
    got = edits.added(m, new).collect()
    assert [(r.id, r.x) for r in got if r.kind == "start"] == [(3, 5.0)] and len(got) == 3
    assert edits.deleted(m, spark.createDataFrame([("m", 1)], "map_id string, id long")).count() == 2


def test_points_in_overlapping_rings(spark):
    p = spark.createDataFrame([("m", 1, 5.5, 5.5), ("m", 2, 50.5, 5.5)], "map_id string, pt_id long, x double, y double")
    top = vector.topmost(p, spark.createDataFrame([square("forest", 0, 10, 0), square("water", 2, 8, 1)], RINGS)).collect()
    assert [(r.pt_id, r.poly_id) for r in top] == [(1, 1)]


def test_analysis_of_a_drawn_map(spark):
    """A photo with water, a clearing and three circles goes through all stages."""
    g = grid(spark, 90, 70)
    circ = " or ".join(f"abs(sqrt(pow(x - {a}, 2) + pow(y - {b}, 2)) - 6) <= 1" for a, b in ((20, 20), (60, 25), (40, 50)))
    kind = F.expr(f"case when {circ} then 'ink' when x between 60 and 85 and y between 40 and 60 then 'water' else 'land' end")
    pick = lambda a, b, c: F.when(kind == "ink", a).when(kind == "water", b).otherwise(c)
    px = g.withColumns({"b": pick(120, 220, 90), "g": pick(30, 120, 190), "r": pick(200, 40, 235)})
    boxes = spark.createDataFrame([], "map_id string, x0 double, y0 double, x1 double, y1 double")
    got = analyze.analyzed(px, boxes, spark.createDataFrame([("m", "drawn.png")], "map_id string, source_photo string"), votes=15)
    assert "water" in {r.class_name for r in got["polygons"].collect()}
    assert got["classes"].count() == 90 * 70
    doc = json.loads(got["geojson"].collect()[0].geojson)
    assert doc["type"] == "FeatureCollection" and doc["properties"]["source_photo"] == "drawn.png"
