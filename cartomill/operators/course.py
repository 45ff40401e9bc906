"""Courses: control circles, start, finish, and the leg to demonstrate."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

CIRCLE = "array<struct<x:double,y:double,radius:double>>"


def suppressed(circles: DataFrame) -> DataFrame:
    """Greedy suppression within each map, strongest first (ties by x, then y): a circle goes if a kept one is nearer than its own radius.

    circles: (map_id, x, y, radius, strength), a few hundred for each map.
    """
    order = F.array_sort(F.collect_list(F.struct((-F.col("strength")).alias("s"), F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"), F.col("radius").cast("double").alias("radius"))))
    near = lambda c: lambda k: F.hypot(k["x"] - c["x"], k["y"] - c["y"]) < c["radius"]
    one = lambda c: F.array(F.struct(c["x"].alias("x"), c["y"].alias("y"), c["radius"].alias("radius")))
    kept = F.aggregate("all", F.lit([]).cast(CIRCLE), lambda acc, c: F.when(F.exists(acc, near(c)), acc).otherwise(F.concat(acc, one(c))))
    rows = circles.groupBy("map_id").agg(order.alias("all")).select("map_id", F.posexplode(kept).alias("seq", "c"))
    return rows.select("map_id", "seq", "c.x", "c.y", "c.radius")


def ring_coverage(circles: DataFrame, ink: DataFrame, samples: int = 144, band: int = 3) -> DataFrame:
    """Adds coverage: share of directions in which some pixel within ``band`` of the circle is inked.

    ink: (map_id, y, x) of inked pixels.  Equal circles are probed once.
    """
    of = ["map_id", "x", "y", "radius"]
    steps = F.explode(F.sequence(F.lit(0), F.lit(samples - 1)))
    probes = circles.select(*of).distinct().withColumn("_i", steps).withColumn("_d", F.explode(F.sequence(F.lit(-band), F.lit(band))))
    turn = 2 * F.pi() * F.col("_i") / samples
    at = lambda c, f: F.round(F.col(c) + (F.col("radius") + F.col("_d")) * f(turn), 6).cast("int")
    probes = probes.withColumns({"_px": at("x", F.cos), "_py": at("y", F.sin)})
    # merged, since Spark takes the probes for no more than the circles and would broadcast them
    hit = probes.hint("merge").join(ink.select("map_id", F.col("y").alias("_py"), F.col("x").alias("_px")).distinct(), ["map_id", "_py", "_px"])
    n = hit.groupBy(*of).agg((F.countDistinct("_i") / samples).alias("coverage"))
    return circles.join(n.hint("merge"), of, "left").withColumn("coverage", F.coalesce("coverage", F.lit(0.0))).select(*circles.columns, "coverage")


def finish(controls: DataFrame) -> DataFrame:
    """(map_id, x, y, a, b): the first pair, by seq, of concentric circles; a and b are their seq."""
    a = controls.select("map_id", *[F.col(c).alias(f"a_{c}") for c in ("seq", "x", "y", "radius")])
    b = controls.select("map_id", *[F.col(c).alias(f"b_{c}") for c in ("seq", "x", "y", "radius")])
    near = F.hypot(F.col("a_x") - F.col("b_x"), F.col("a_y") - F.col("b_y")) < 0.5 * F.greatest("a_radius", "b_radius")
    pairs = a.join(b, "map_id").where((F.col("a_seq") < F.col("b_seq")) & near & (F.abs(F.col("a_radius") - F.col("b_radius")) > 1.5))
    first = pairs.groupBy("map_id").agg(F.min(F.struct("a_seq", "b_seq", "a_x", "a_y", "b_x", "b_y")).alias("p"))
    return first.select("map_id", ((F.col("p.a_x") + F.col("p.b_x")) / 2).alias("x"), ((F.col("p.a_y") + F.col("p.b_y")) / 2).alias("y"), F.col("p.a_seq").alias("a"), F.col("p.b_seq").alias("b"))


def without_finish(controls: DataFrame) -> DataFrame:
    gone = finish(controls).select("map_id", F.explode(F.array("a", "b")).alias("seq"))
    return controls.join(gone, ["map_id", "seq"], "left_anti")


def equilateral_score(x: list[Column], y: list[Column]) -> Column:
    """1 - spread of the three sides over their mean."""
    sides = [F.hypot(x[i] - x[(i + 1) % 3], y[i] - y[(i + 1) % 3]) for i in range(3)]
    mean = (sides[0] + sides[1] + sides[2]) / 3
    spread = F.sqrt(((sides[0] - mean) ** 2 + (sides[1] - mean) ** 2 + (sides[2] - mean) ** 2) / 3)
    return F.when(mean > 0, 1 - spread / mean).otherwise(0.0)


def start_triangle(triangles: DataFrame, controls: DataFrame, ratio: tuple[float, float] = (0.25, 1.3), least: float = 0.85) -> DataFrame:
    """(map_id, x, y, score): the centre of the best triangle whose area suits the circles'.

    triangles: (map_id, tri_id, x1, y1, x2, y2, x3, y3), and ``contour_area`` where the corners
    stand for a contour, whose own area then counts.  The upper median of the circles' areas is
    the measure; maps without controls have no start.
    """
    circle = controls.groupBy("map_id").agg(F.array_sort(F.collect_list(F.pi() * F.col("radius") * F.col("radius"))).alias("_a")).select("map_id", F.get("_a", F.floor(F.size("_a") / 2).cast("int")).alias("area"))
    x, y = ([F.col(f"{c}{i}").cast("double") for i in (1, 2, 3)] for c in "xy")
    own = F.col("contour_area") if "contour_area" in triangles.columns else F.abs((x[1] - x[0]) * (y[2] - y[0]) - (x[2] - x[0]) * (y[1] - y[0])) / 2
    rows = triangles.join(circle, "map_id").where(own.between(ratio[0] * F.col("area"), ratio[1] * F.col("area"))).withColumn("score", equilateral_score(x, y)).where(F.col("score") >= least)
    best = rows.withColumn("_n", F.row_number().over(W.partitionBy("map_id").orderBy(F.desc("score"), "tri_id"))).where("_n = 1")
    return best.select("map_id", ((x[0] + x[1] + x[2]) / 3).alias("x"), ((y[0] + y[1] + y[2]) / 3).alias("y"), "score")


def endpoints(controls: DataFrame, starts: DataFrame) -> DataFrame:
    """(map_id, x1, y1, x2, y2): from the start to the nearest control (the first of equals); without a start between the first two controls."""
    c = controls.select("map_id", "seq", "x", "y")
    near = c.join(starts.select("map_id", F.col("x").alias("x1"), F.col("y").alias("y1")), "map_id")
    d = (F.col("x") - F.col("x1")) ** 2 + (F.col("y") - F.col("y1")) ** 2
    near = near.groupBy("map_id").agg(F.min(F.struct(d.alias("d"), "seq", "x1", "y1", F.col("x").alias("x2"), F.col("y").alias("y2"))).alias("p")).select("map_id", "p.x1", "p.y1", "p.x2", "p.y2")
    rest = c.join(starts.select("map_id"), "map_id", "left_anti").groupBy("map_id").agg(F.array_sort(F.collect_list(F.struct("seq", "x", "y"))).alias("c")).where(F.size("c") >= 2)
    return near.unionByName(rest.select("map_id", *[F.get("c", i)[n].alias(f"{n}{i + 1}") for i in (0, 1) for n in "xy"]))


def control_codes(texts: DataFrame, text: str = "text", confidence: str = "conf") -> DataFrame:
    """(map_id, seq, code): the code in the most confident reading that has one; the first of equals.  Readings: map_id, seq, ord, text, conf."""
    code = F.regexp_extract(F.trim(F.col(text)), r"\d{1,2}-\d{1,3}", 0)
    rows = texts.withColumn("code", code).where("code <> ''")
    return rows.groupBy("map_id", "seq").agg(F.max_by("code", F.struct(confidence, -F.col("ord"))).alias("code"))
