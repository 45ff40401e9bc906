"""Queries over whole tables, against brute force at the smallest scale."""

from __future__ import annotations

import json
import math
from collections import Counter, defaultdict

import duckdb

from cartomill import queries
from cartomill.queries.data import CONTROLS, MASK, POINTS, RINGS, SEGMENTS

SF = "/root/testdata/sf0.001"


def asked(sql):
    c = duckdb.connect()
    for t in ("events", "supplier", "customer", "lineitem"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c.execute(sql).fetchall()


def run(spark, name):
    return queries.QUERIES[name](spark, SF).collect()


def inside(ring, x, y):
    odd = False
    for a, b in zip(ring, ring[1:] + ring[:1]):
        if (b["y"] > y) != (a["y"] > y) and x < (b["x"] - a["x"]) * (y - a["y"]) / (b["y"] - a["y"]) + a["x"]:
            odd = not odd
    return odd


def test_all_taps_recolour(spark):
    rings = asked(f"WITH {RINGS} SELECT map_id, poly_id, class_name, ring FROM polys")
    want = {(m, i): c for m, i, c, _ in rings}
    for m, pt, x, y in asked(f"WITH {POINTS} SELECT map_id, pt_id, x, y FROM pts ORDER BY pt_id"):
        hit = [i for n, i, _, r in rings if n == m and inside(r, x, y)]
        if hit:
            want[m, max(hit)] = "forest" if pt % 3 == 0 else "water"
    assert {(r.map_id, r.poly_id): r.class_name for r in run(spark, "edit_recolor")} == want


def test_all_segments_are_exported(spark):
    maps = {m for (m,) in asked(f"WITH {RINGS} SELECT DISTINCT map_id FROM polys")}
    want = sorted((m, 1 if role == "path" else 5, i, [[x1, 150 - y1], [x2, 150 - y2]]) for m, i, role, x1, y1, x2, y2 in asked(f"WITH {SEGMENTS} SELECT map_id, seg_id, role, x1, y1, x2, y2 FROM seg") if m in maps)
    rows = run(spark, "geojson_features")
    lines = [r for r in rows if r.layer in (1, 5)]
    assert sorted((r.map_id, r.layer, r.ord, json.loads(r.feature)["geometry"]["coordinates"]) for r in lines) == want
    in_order = defaultdict(list)
    for r in sorted(rows, key=lambda r: (r.layer, r.ord)):
        in_order[r.map_id].append(json.loads(r.feature))
    assert {r.map_id: json.loads(r.geojson)["features"] for r in run(spark, "geojson_doc")} == dict(in_order)


def test_all_rows_are_ink(spark):
    ink = set(asked("SELECT DISTINCT CAST(l_partkey % 6 AS VARCHAR), l_orderkey % 160, (l_partkey * 7 + l_linenumber) % 210 FROM lineitem"))
    want = {}
    for m, seq, x, y, radius in asked(f"WITH {CONTROLS} SELECT map_id, seq, x, y, radius FROM ctl"):
        at = lambda i, k: (m, int(round(y + (radius + k) * math.sin(2 * math.pi * i / 144), 6)), int(round(x + (radius + k) * math.cos(2 * math.pi * i / 144), 6)))
        want[m, seq] = round(sum(any(at(i, k) in ink for k in range(-3, 4)) for i in range(144)) / 144, 6)
    assert {(r.map_id, r.seq): r.coverage for r in run(spark, "ring_coverage")} == want


def test_all_pixels_vote(spark):
    votes = Counter()
    for m, y, x in asked(f"WITH {MASK} SELECT map_id, y, x FROM k"):
        for t in range(180):
            v = round(x * math.cos(t * (math.pi / 180)) + y * math.sin(t * (math.pi / 180)), 6)
            votes[m, t, int(math.copysign(math.floor(abs(v) + 0.5), v))] += 1
    assert {(r.map_id, r.theta, r.rho): r.votes for r in run(spark, "hough_lines")} == {k: n for k, n in votes.items() if n >= 8}


def test_all_maps_are_warped(spark):
    assert dict(Counter(r.map_id for r in run(spark, "warp_crop"))).keys() == {"m0", "m1"}
