"""Cost rasters, least-cost paths over them, and what a path runs through."""

from __future__ import annotations

import heapq
import math

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cartomill.functions import geometry as G
from cartomill.operators import vector
from cartomill.schemas import PATH_WIDTH, terrain_dim

NEIGHBOURS = [(dx, dy) for dx in (-1, 0, 1) for dy in (-1, 0, 1) if dx or dy]


def class_grid(grid: DataFrame, polygons: DataFrame, segments: DataFrame, valid: str | None = None, boundary: bool = True) -> DataFrame:
    """grid (map_id, y, x, any others) with class_name, code and cost: of the layers painted on a pixel the last in paint order wins, not the dearest."""
    dim = terrain_dim(grid.sparkSession)
    known = F.broadcast(dim.select("class_name", "code"))
    painted = vector.filled(polygons, ["map_id", "class_name"], boundary).join(known, "class_name").select("map_id", "y", "x", "code")
    paths = vector.lines(segments, ["map_id"], PATH_WIDTH).select("map_id", "y", "x", F.lit(8).alias("code"))
    top = painted.unionByName(paths).groupBy("map_id", "y", "x").agg(F.max("code").alias("code"))
    out = grid.join(top, ["map_id", "y", "x"], "left").withColumn("code", F.coalesce("code", F.lit(0)))
    if valid:
        out = out.withColumn("code", F.when(F.col(valid), F.col("code")).otherwise(9))
    return out.join(F.broadcast(dim), "code")


def least_cost(grid: DataFrame, ends: DataFrame) -> DataFrame:
    """(map_id, route_id, cost, points array<struct<x,y>>): a path for each row of ends (map_id, route_id, x1, y1, x2, y2).

    Eight neighbours; a step costs its length times the mean of both pixels' costs.  Ends
    are rounded and clamped into the raster.  One task holds one map.
    """
    start = ends.select("map_id", "route_id", *[F.col(c).cast("double") for c in ("x1", "y1", "x2", "y2")])

    def solve(key: tuple, cells: pd.DataFrame, routes: pd.DataFrame) -> pd.DataFrame:
        import numpy as np

        out = []
        if len(cells):
            w, h = int(cells.x.max()) + 1, int(cells.y.max()) + 1
            cost = np.full((h, w), np.inf)
            cost[cells.y.to_numpy(), cells.x.to_numpy()] = cells.cost.to_numpy()
            snap = lambda v, n: max(0, min(n - 1, int(math.floor(abs(v) + 0.5) * (1 if v >= 0 else -1))))
            for r in routes.itertuples():
                total, path = dijkstra(cost, (snap(r.x1, w), snap(r.y1, h)), (snap(r.x2, w), snap(r.y2, h)))
                out.append((key[0], r.route_id, total, [{"x": x, "y": y} for x, y in path]))
        return pd.DataFrame(out, columns=["map_id", "route_id", "cost", "points"])

    schema = start.select("map_id", "route_id", F.lit(0.0).alias("cost"), F.array(F.struct(F.lit(0).alias("x"), F.lit(0).alias("y"))).alias("points")).schema
    return grid.select("map_id", "y", "x", F.col("cost").cast("double").alias("cost")).groupBy("map_id").cogroup(start.groupBy("map_id")).applyInPandas(solve, schema)


def dijkstra(cost, a: tuple[int, int], b: tuple[int, int]) -> tuple[float, list[tuple[int, int]]]:
    h, w = cost.shape
    rows, flat = w, cost.ravel().tolist()
    goal, first = b[1] * w + b[0], a[1] * w + a[0]
    dist, before, heap, done = {first: 0.0}, {}, [(0.0, first)], set()
    while heap:
        d, u = heapq.heappop(heap)
        if u in done:
            continue
        if u == goal:
            break
        done.add(u)
        x, y = u % rows, u // rows
        for dx, dy in NEIGHBOURS:
            if 0 <= x + dx < w and 0 <= y + dy < h:
                v = u + dy * rows + dx
                step = d + math.hypot(dx, dy) * (flat[u] + flat[v]) / 2
                if step < dist.get(v, math.inf):
                    dist[v], before[v] = step, u
                    heapq.heappush(heap, (step, v))
    if goal not in dist:
        return math.inf, []
    path = [goal]
    while path[-1] != first:
        path.append(before[path[-1]])
    return dist[goal], [(u % rows, u // rows) for u in reversed(path)]


def steps(points: DataFrame) -> DataFrame:
    """(map_id, route_id, seq, x1, y1, x2, y2, length) of route points (map_id, route_id, seq, x, y); steps of no length are left out."""
    w = W.partitionBy("map_id", "route_id").orderBy("seq")
    rows = points.select("map_id", "route_id", "seq", F.col("x").alias("x1"), F.col("y").alias("y1"), F.lead("x").over(w).alias("x2"), F.lead("y").over(w).alias("y2"))
    return rows.where("x2 is not null").withColumn("length", G.length(*[F.col(c).cast("double") for c in ("x1", "y1", "x2", "y2")])).where("length > 0")


def summed_cost(points: DataFrame, grid: DataFrame) -> DataFrame:
    """(map_id, route_id, recomputed_cost): the path's cost, from its points alone."""
    s = steps(points)
    at = lambda n: grid.select("map_id", F.col("x").alias(f"x{n}"), F.col("y").alias(f"y{n}"), F.col("cost").alias(f"c{n}"))
    s = s.join(at(1), ["map_id", "x1", "y1"]).join(at(2), ["map_id", "x2", "y2"])
    return s.groupBy("map_id", "route_id").agg(F.sum(F.col("length") * (F.col("c1") + F.col("c2")) / 2).alias("recomputed_cost"))


def breakdown(points: DataFrame, classes: DataFrame) -> DataFrame:
    """(map_id, route_id, class_name, fraction): share of the length by the class under each step's midpoint; none for under two points."""
    mid = steps(points).select("map_id", "route_id", "length", F.round((F.col("x1") + F.col("x2")) / 2.0).cast("int").alias("x"), F.round((F.col("y1") + F.col("y2")) / 2.0).cast("int").alias("y"))
    total = mid.join(classes.select("map_id", "y", "x", "class_name"), ["map_id", "y", "x"]).groupBy("map_id", "route_id", "class_name").agg(F.sum("length").alias("_l"))
    whole = F.sum("_l").over(W.partitionBy("map_id", "route_id"))
    return total.withColumn("fraction", F.col("_l") / whole).drop("_l")


def barriers(points: DataFrame, classes: DataFrame) -> DataFrame:
    """Route points on water or out of bounds."""
    bad = classes.where(F.col("class_name").isin("water", "out_of_bounds")).select("map_id", "y", "x")
    return points.join(bad, ["map_id", "y", "x"], "left_semi")
