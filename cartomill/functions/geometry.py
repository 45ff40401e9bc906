"""Functions of points and rings (array<struct<x,y>>), as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def shoelace(ring: Column) -> Column:
    """Area; 0 for under three points."""
    n = F.size(ring)
    pair = lambda i: (F.get(ring, i)["x"] * F.get(ring, (i + 1) % n)["y"] - F.get(ring, (i + 1) % n)["x"] * F.get(ring, i)["y"]).cast("double")
    total = F.aggregate(F.sequence(F.lit(0), n - 1), F.lit(0.0), lambda acc, i: acc + pair(i))
    return F.when(n >= 3, F.abs(total) / 2).otherwise(F.lit(0.0))


def perimeter(ring: Column) -> Column:
    n = F.size(ring)
    step = lambda i: F.hypot(F.get(ring, i)["x"] - F.get(ring, (i + 1) % n)["x"], F.get(ring, i)["y"] - F.get(ring, (i + 1) % n)["y"])
    return F.when(n >= 2, F.aggregate(F.sequence(F.lit(0), n - 1), F.lit(0.0), lambda acc, i: acc + step(i))).otherwise(F.lit(0.0))


def closed(ring: Column) -> Column:
    """With the first point again at the end, if there is one."""
    return F.concat(ring, F.slice(ring, 1, 1))


def flipped(y: Column, height: Column) -> Column:
    return height - y


def flipped_ring(ring: Column, height: Column) -> Column:
    return F.transform(ring, lambda p: F.struct(p["x"].alias("x"), (height - p["y"]).alias("y")))


def length(x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    return F.hypot(x2 - x1, y2 - y1)


def angle(x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    """Degrees in [0, 180)."""
    return F.pmod(F.degrees(F.atan2(y2 - y1, x2 - x1)), F.lit(180.0))


def to_segment(x: Column, y: Column, x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    """Distance of a point to a segment."""
    dx, dy = x2 - x1, y2 - y1
    sq = dx * dx + dy * dy
    t = F.when(sq > 0, F.least(F.greatest(((x - x1) * dx + (y - y1) * dy) / F.when(sq > 0, sq), F.lit(0.0)), F.lit(1.0))).otherwise(0.0)
    return F.hypot(x - (x1 + t * dx), y - (y1 + t * dy))


def grid_cell(v: Column, n: Column) -> Column:
    """Rounded half away from zero, then clamped to 0..n-1."""
    return F.greatest(F.lit(0), F.least(F.round(v).cast("int"), n - 1))


def corners(points: Column) -> dict[str, Column]:
    """Of four points: top left has the least x+y, bottom right the greatest, top right the least y-x, bottom left the greatest; the first of equals."""

    def pick(key, least: bool) -> Column:
        keys = F.transform(points, key)
        best = F.array_min(keys) if least else F.array_max(keys)
        return F.get(points, (F.array_position(keys, best) - 1).cast("int"))

    total, diff = (lambda p: p["x"] + p["y"]), (lambda p: p["y"] - p["x"])
    return {"tl": pick(total, True), "tr": pick(diff, True), "br": pick(total, False), "bl": pick(diff, False)}
