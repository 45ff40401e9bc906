"""What larger tables and odd rows bring: short lines, ties, copies of points and circles."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from cartomill import queries
from cartomill.operators import course, edits, imaging, vector


def test_path_lines_of_a_given_length(spark):
    """A bar of ten pixels is a line from five on, but not by the default of 15."""
    rows = [("m", y, x, 0 if 14 <= y <= 17 and 10 <= x <= 19 else 255) for y in range(32) for x in range(48)]
    df = spark.createDataFrame(rows, "map_id string, y int, x int, v int").withColumn("no", F.lit(0))
    short = imaging.path_lines(df, "v", "no", 5, 3, 6).collect()
    assert short and all(5 <= ((r.x2 - r.x1) ** 2 + (r.y2 - r.y1) ** 2) ** 0.5 < 15 for r in short)
    assert not imaging.path_lines(df, "v", "no", gap=3, threshold=6).collect()


RINGS = "map_id string, poly_id long, class_name string, ring array<struct<x:double,y:double>>"
POINTS = "map_id string, pt_id long, x double, y double"


def square(i, x, y, side):
    return ("m", i, "rock", [(float(a), float(b)) for a, b in ((x, y), (x + side, y), (x + side, y + side), (x, y + side))])


def test_equal_points_are_all_held(spark):
    """Rows that are equal in all columns don't cancel each other out, and a long ring is met in each of its cells."""
    p = spark.createDataFrame([("m", 1, 5.5, 5.5)] * 2 + [("m", 2, 150.25, 5.5), ("m", 3, 300.0, 5.5), ("m", 4, -0.0, 5.5), ("m", 5, None, 5.5)], POINTS)
    rings = spark.createDataFrame([square(1, 0, 0, 10), square(2, -40, -40, 340), square(3, 5, 5, 1)], RINGS)
    got = sorted((r.pt_id, r.poly_id) for r in vector.points_in_polygons(p, rings).collect())
    assert got == [(1, 1), (1, 1), (1, 2), (1, 2), (1, 3), (1, 3), (2, 2), (4, 1), (4, 2)]
    assert sorted((r.pt_id, r.poly_id) for r in vector.topmost(p, rings).collect()) == [(1, 3), (2, 2), (4, 2)]


@pytest.mark.parametrize("name", ["edit_recolor", "nearest_marker", "pip_join", "ring_coverage", "top_polygon"])
def test_exploded_tables_are_not_broadcast(spark, name):
    """Spark takes an exploded table for no larger than it was, and broadcasts 60 million rows of 60,000 circles."""
    plan = queries.QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan and "Cartesian" not in plan


def test_equal_markers(spark):
    """Equal circles count once, with the first id; of equal distances the first id wins."""
    p = spark.createDataFrame([("m", 1, 5.5, 5.5), ("m", 2, 5.5, 5.5), ("m", 3, 500.0, 5.5)], POINTS)
    markers = spark.createDataFrame([("m", 7, 5.5, 8.5, 2.0), ("m", 4, 5.5, 8.5, 2.0), ("m", 5, 5.5, 2.5, 3.0)], "map_id string, id int, x double, y double, radius double")
    got = vector.nearest_marker(p, markers)
    assert sorted(tuple(r) for r in got.collect()) == [("m", 1, 4, 3.0), ("m", 2, 4, 3.0)]


def test_last_tap_of_a_place(spark):
    """Taps of one place and of several, the last by id wins."""
    taps = spark.createDataFrame([("m", 1, 5.5, 5.5, "water"), ("m", 9, 5.5, 5.5, "forest"), ("m", 4, 6.5, 5.5, "marsh"), ("m", 3, 25.5, 5.5, "marsh"), ("m", 8, 50.5, 5.5, "marsh")], POINTS + ", class_name string")
    rings = spark.createDataFrame([square(1, 0, 0, 10), square(2, 20, 0, 10), square(3, 80, 0, 10)], RINGS)
    got = edits.recoloured(rings, taps)
    assert sorted((r.poly_id, r.class_name) for r in got.collect()) == [(1, "forest"), (2, "marsh"), (3, "rock")]


def test_equal_circles(spark):
    """Equal circles are probed once and all get their coverage; a circle without a place has none."""
    circles = spark.createDataFrame([("m", k, 20.0, 20.0, 8.0) for k in range(3)] + [("m", 3, None, 20.0, 8.0)], "map_id string, seq int, x double, y double, radius double")
    ink = spark.createDataFrame([("m", y, x) for y in range(40) for x in range(20, 40)], "map_id string, y int, x int")
    got = course.ring_coverage(circles, ink)
    rows = {r.seq: round(r.coverage, 2) for r in got.collect()}
    assert rows[3] == 0.0 and len({rows[k] for k in range(3)}) == 1 and 0.5 < rows[0] < 0.75
