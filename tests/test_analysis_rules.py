"""Rules of the analysis on drawn masks: start triangles, legs, peaks, clusters of each map, repaired rings, rejected photos."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from cartomill.functions import shapes
from cartomill.operators import cluster, imaging
from cartomill.plans import analyze
from cartomill.sources import images

CONTROLS = "map_id string, seq int, x double, y double, radius double"


def filled(corners, h=120, w=160):
    ys, xs = np.indices((h, w))
    inside = np.ones((h, w), bool)
    for (ax, ay), (bx, by) in zip(corners, [*corners[1:], corners[0]], strict=True):
        inside &= (bx - ax) * (ys - ay) - (by - ay) * (xs - ax) >= 0
    return inside


def ink(spark, *masks):
    rows = [(f"m{k}", int(y), int(x), 1) for k, m in enumerate(masks) for y, x in zip(*np.nonzero(m), strict=True)]
    return spark.createDataFrame(rows, "map_id string, y int, x int, ink int")


def test_start_triangles_from_masks(spark):
    """A triangle that suits the circles is the start; one too large, one too flat, and a square are none."""
    even = filled([(40, 80), (66, 35), (92, 80)][::1])
    large = filled([(10, 110), (75, 3), (150, 110)])
    flat = filled([(10, 80), (80, 60), (150, 80)])
    square = filled([(40, 30), (80, 30), (80, 70), (40, 70)])
    controls = spark.createDataFrame([(f"m{k}", 0, 130.0, 20.0, 24.0) for k in range(4)], CONTROLS)
    got = analyze.starts_from(ink(spark, even, large, flat, square), controls).collect()
    assert [r.map_id for r in got] == ["m0"]
    assert abs(got[0].x - 66) < 2.5 and abs(got[0].y - 65) < 2.5


def test_legs_are_long(spark):
    """Strokes shorter than 4 % of the height are no legs; a drawn line isn't a bundle of many."""
    h, w = 400, 500
    mask = np.zeros((h, w), np.int64)
    mask[200:203, 80:420] = 1
    mask[60:70, 90:92] = 1
    rows = [("m", int(y), int(x), int(v)) for (y, x), v in np.ndenumerate(mask)]
    df = spark.createDataFrame(rows, "map_id string, y int, x int, ink int")
    none = spark.createDataFrame([], "map_id string, x double, y double, radius double")
    got = imaging.legs(df, none, none.select("map_id", "x", "y")).collect()
    assert 1 <= len(got) <= 6
    assert all(195 <= r.y1 <= 207 and 195 <= r.y2 <= 207 and np.hypot(r.x2 - r.x1, r.y2 - r.y1) >= 0.04 * h for r in got)


def test_peaks_and_spacing(spark):
    cells = [("a", 5, 5, 3.0, 9), ("a", 5, 6, 3.0, 7), ("a", 6, 6, 3.0, 9), ("a", 9, 9, 3.0, 2), ("a", 5, 9, 3.0, 4), ("b", 5, 5, 3.0, 1)]
    df = spark.createDataFrame(cells, "map_id string, y int, x int, radius double, strength int")
    got = imaging.peaks(df)
    assert sorted((r.map_id, r.y, r.x) for r in got.collect()) == [("a", 5, 5), ("a", 5, 9), ("a", 9, 9), ("b", 5, 5)]
    dims = spark.createDataFrame([("a", 150, 200), ("b", 150, 200)], "map_id string, h int, w int")
    far = imaging.spaced(got.select("map_id", *[F.col(c).cast("double").alias(c) for c in ("x", "y", "radius", "strength")]), dims).collect()
    assert sorted((r.map_id, r.y, r.x) for r in far) == [("a", 5, 5), ("a", 9, 9), ("b", 5, 5)]


def test_clusters_of_a_map_alone_and_in_a_batch(spark):
    rng = np.random.default_rng(3)

    def points(map_id, centres):
        return [(map_id, i, j, *[float(round(v)) for v in rng.normal(c, 2)]) for i, c in enumerate(centres) for j in range(60)]

    one, two = points("a", [(40, 90, 120), (60, 200, 90), (20, 30, 220)]), points("b", [(90, 90, 90), (150, 10, 10), (5, 240, 240)])
    schema = "map_id string, y int, x int, h double, s double, v double"
    alone = cluster.kmeans_by_map(spark.createDataFrame(one, schema), ["h", "s", "v"], 3).collect()
    both = cluster.kmeans_by_map(spark.createDataFrame(one + two, schema), ["h", "s", "v"], 3).collect()
    assert {(r.y, r.x): r.cluster for r in alone} == {(r.y, r.x): r.cluster for r in both if r.map_id == "a"}
    assert {(r.y, r.cluster) for r in alone} == {(y, c) for y, c in {r.y: r.cluster for r in alone}.items()} and len({r.cluster for r in alone}) == 3
    few = cluster.kmeans_by_map(spark.createDataFrame(one[:30], schema), ["h", "s", "v"], 3).collect()
    assert {r.cluster for r in few} == {None}


def test_medians_are_of_the_whole_raster(spark):
    img = np.random.default_rng(0).integers(0, 255, (9, 11))
    df = spark.createDataFrame([("m", int(y), int(x), int(v)) for (y, x), v in np.ndenumerate(img)], "map_id string, y int, x int, b int")
    got = {(r.y, r.x): r.b for r in imaging.medians(df, ["b"], 3).collect()}
    pad = np.pad(img, 1, mode="edge")
    assert got == {(y, x): int(np.median(pad[y : y + 3, x : x + 3])) for y in range(9) for x in range(11)}


@pytest.mark.parametrize(
    ("ring", "areas"),
    [
        ([(0, 0), (4, 0), (4, 4), (0, 4)], [16]),
        ([(0, 0), (4, 4), (4, 0), (0, 4)], [4, 4]),
        ([(0, 0), (4, 0), (4, 4), (2, 4), (2, 8), (2, 4), (0, 4)], [16]),
        ([(0, 0), (2, 2), (4, 0), (4, 4), (2, 2), (0, 4)], [4, 4]),
        ([(0, 0), (1, 1)], []),
    ],
)
def test_rings_are_repaired(ring, areas):
    parts = shapes.simple_parts(ring)
    assert [round(shapes.area(p), 6) for p in parts] == areas and all(shapes.is_simple(p) for p in parts)


def test_rejected_photos_and_rectified_ones(spark, tmp_path):
    img = np.full((40, 60, 3), 200, np.uint8)
    (tmp_path / "good.png").write_bytes(images.png_bytes(img))
    (tmp_path / "bad.jpg").write_bytes(b"this is no photo")
    (tmp_path / "notes.txt").write_text("no photo either")
    assert [r.source_photo for r in images.rejected(spark, str(tmp_path)).collect()] == ["bad.jpg"]
    px = images.pixels(images.photos(spark, str(tmp_path)))
    got = analyze.rectify_photo(px).collect()
    assert [(r.map_id, r.width, r.height, r.quad_found) for r in got] == [("good", 60, 40, False)] and bytes(got[0].png)[:4] == b"\x89PNG"
