"""Rasters, points and shapes that are derived from the driver tables, for Spark and for SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

WIDTH, HEIGHT = 48, 32


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def raster(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(map_id, y, x, v, known): two maps without gaps; cells that no row falls on have v 0."""
    cell = [F.concat(F.lit("m"), (F.col("l_suppkey") % 2).cast("string")).alias("map_id"), (F.col("l_orderkey") % HEIGHT).cast("int").alias("y"), (F.col("l_partkey") % WIDTH).cast("int").alias("x")]
    seen = table(spark, sf_dir, "lineitem").groupBy(*cell).agg((F.sum(F.col("l_quantity").cast("int")) % 256).cast("int").alias("v"))
    grid = seen.select("map_id").distinct().withColumn("y", F.explode(F.sequence(F.lit(0), F.lit(HEIGHT - 1)))).withColumn("x", F.explode(F.sequence(F.lit(0), F.lit(WIDTH - 1))))
    return grid.join(seen, ["map_id", "y", "x"], "left").withColumn("known", F.col("v").isNotNull()).withColumn("v", F.coalesce("v", F.lit(0)))


def pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = raster(spark, sf_dir)
    return g.select("map_id", "y", "x", F.col("v").alias("b"), ((F.col("v") * 7 + F.col("x") * 5) % 256).alias("g"), ((F.col("v") * 13 + F.col("y") * 11) % 256).alias("r"))


def mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    return raster(spark, sf_dir).select("map_id", "y", "x", "v", ((F.col("v") + 3 * F.col("x") + F.col("y")) % 7 < 4).cast("int").alias("on"))


RASTER = f"""
g0 AS (SELECT 'm' || CAST(l_suppkey % 2 AS VARCHAR) AS map_id, CAST(l_orderkey % {HEIGHT} AS INTEGER) AS y, CAST(l_partkey % {WIDTH} AS INTEGER) AS x,
       CAST(sum(CAST(trunc(l_quantity) AS INTEGER)) % 256 AS INTEGER) AS v FROM lineitem GROUP BY 1, 2, 3),
grid AS (SELECT m.map_id, CAST(a.y AS INTEGER) AS y, CAST(b.x AS INTEGER) AS x FROM (SELECT DISTINCT map_id FROM g0) m, range({HEIGHT}) a(y), range({WIDTH}) b(x)),
g AS (SELECT grid.*, coalesce(g0.v, 0) AS v, g0.v IS NOT NULL AS known FROM grid LEFT JOIN g0 USING (map_id, y, x))"""
PIXELS = RASTER + """,
px AS (SELECT map_id, y, x, v AS b, (v * 7 + x * 5) % 256 AS g, (v * 13 + y * 11) % 256 AS r FROM g)"""
HSV = PIXELS + """,
t1 AS (SELECT *, greatest(b, g, r) AS v, least(b, g, r) AS lo FROM px),
t2 AS (SELECT *, CASE WHEN v = lo THEN 0.0::DOUBLE WHEN v = r THEN 60.0::DOUBLE * (g - b) / (v - lo) WHEN v = g THEN 120.0::DOUBLE + 60.0::DOUBLE * (b - r) / (v - lo) ELSE 240.0::DOUBLE + 60.0::DOUBLE * (r - g) / (v - lo) END AS deg FROM t1),
hsv AS (SELECT map_id, y, x, b, g, r, CAST(floor(0.299::DOUBLE * r + 0.587::DOUBLE * g + 0.114::DOUBLE * b + 0.5) AS INTEGER) AS gray,
        CAST(CASE WHEN v = lo THEN 0 ELSE CAST(floor((CASE WHEN deg < 0 THEN deg + 360 ELSE deg END) / 2 + 0.5) AS INTEGER) % 180 END AS INTEGER) AS h,
        CAST(CASE WHEN v = 0 THEN 0 ELSE floor(255.0::DOUBLE * (v - lo) / v + 0.5) END AS INTEGER) AS s, v FROM t2)"""
MASK = RASTER + """,
k AS (SELECT map_id, y, x, v, CAST((v + 3 * x + y) % 7 < 4 AS INTEGER) AS on_ FROM g)"""


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(map_id, pt_id, x, y): events at half-integer places, so that none lies on an edge between whole coordinates."""
    e = table(spark, sf_dir, "events")
    return e.select((F.col("user_id") % 7).cast("string").alias("map_id"), F.col("event_id").alias("pt_id"), ((F.col("event_id") * 37) % 101 + 0.5).alias("x"), ((F.col("event_id") * 53) % 97 + 0.5).alias("y"))


POINTS = """
pts AS (SELECT CAST(user_id % 7 AS VARCHAR) AS map_id, event_id AS pt_id, (event_id * 37) % 101 + 0.5::DOUBLE AS x, (event_id * 53) % 97 + 0.5::DOUBLE AS y FROM events)"""


def rings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(map_id, poly_id, class_name, ring): a quadrilateral for each supplier."""
    s = table(spark, sf_dir, "supplier").withColumn("k", F.col("s_suppkey"))
    x, y, w, h = (F.col("k") * 13) % 80, (F.col("k") * 29) % 70, 5 + F.col("k") % 17, 4 + F.col("k") % 23
    names = F.array(*[F.lit(c) for c in ("clearing", "forest", "thicket", "rock", "marsh", "water", "out_of_bounds")])
    p = lambda a, b: F.struct(a.cast("float").alias("x"), b.cast("float").alias("y"))
    ring = F.array(p(x, y), p(x + w, y + F.col("k") % 3), p(x + w + F.col("k") % 5, y + h), p(x - F.col("k") % 4, y + h + 2))
    return s.select((F.col("k") % 7).cast("string").alias("map_id"), F.col("k").cast("long").alias("poly_id"), F.get(names, (F.col("k") % 7).cast("int")).alias("class_name"), ring.alias("ring"))


RINGS = """
q AS (SELECT s_suppkey AS k, (s_suppkey * 13) % 80 AS x0, (s_suppkey * 29) % 70 AS y0, 5 + s_suppkey % 17 AS w, 4 + s_suppkey % 23 AS h FROM supplier),
polys AS (SELECT CAST(k % 7 AS VARCHAR) AS map_id, k AS poly_id, ['clearing', 'forest', 'thicket', 'rock', 'marsh', 'water', 'out_of_bounds'][k % 7 + 1] AS class_name,
          [{'x': x0::DOUBLE, 'y': y0::DOUBLE}, {'x': (x0 + w)::DOUBLE, 'y': (y0 + k % 3)::DOUBLE}, {'x': (x0 + w + k % 5)::DOUBLE, 'y': (y0 + h)::DOUBLE}, {'x': (x0 - k % 4)::DOUBLE, 'y': (y0 + h + 2)::DOUBLE}] AS ring FROM q),
edge AS (SELECT map_id, poly_id, class_name, i, ring[i].x AS x1, ring[i].y AS y1, ring[i % 4 + 1].x AS x2, ring[i % 4 + 1].y AS y2 FROM polys, range(1, 5) t(i))"""


def segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(map_id, seg_id, role, x1, y1, x2, y2): one for each customer."""
    c = table(spark, sf_dir, "customer").withColumn("k", F.col("c_custkey"))
    x, y = (F.col("k") * 17) % 1000, (F.col("k") * 31) % 700
    return c.select((F.col("k") % 5).cast("string").alias("map_id"), F.col("k").cast("long").alias("seg_id"), F.when(F.col("k") % 3 == 0, "path").otherwise("course_leg").alias("role"),
                    x.cast("double").alias("x1"), y.cast("double").alias("y1"), (x + F.col("k") % 9 - 4).cast("double").alias("x2"), (y + 30 + F.col("k") % 40).cast("double").alias("y2"))


SEGMENTS = """
seg AS (SELECT CAST(k % 5 AS VARCHAR) AS map_id, k AS seg_id, CASE WHEN k % 3 = 0 THEN 'path' ELSE 'course_leg' END AS role, ((k * 17) % 1000)::DOUBLE AS x1, ((k * 31) % 700)::DOUBLE AS y1,
        ((k * 17) % 1000 + k % 9 - 4)::DOUBLE AS x2, ((k * 31) % 700 + 30 + k % 40)::DOUBLE AS y2 FROM (SELECT c_custkey AS k FROM customer))"""


def controls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(map_id, seq, x, y, radius, code, strength): one for each supplier."""
    k = F.col("s_suppkey")
    return table(spark, sf_dir, "supplier").select((k % 6).cast("string").alias("map_id"), F.floor(k / 6).cast("int").alias("seq"), ((k * 41) % 200).cast("double").alias("x"), ((k * 59) % 150).cast("double").alias("y"),
                                                    (8 + k % 11).cast("double").alias("radius"), F.when(k % 4 == 0, F.lit(None)).otherwise(F.concat(k.cast("string"), F.lit("-"), (k % 90).cast("string"))).alias("code"), ((k * 7) % 13).cast("double").alias("strength"))


CONTROLS = """
ctl AS (SELECT CAST(k % 6 AS VARCHAR) AS map_id, CAST(floor(k / 6.0) AS INTEGER) AS seq, ((k * 41) % 200)::DOUBLE AS x, ((k * 59) % 150)::DOUBLE AS y, (8 + k % 11)::DOUBLE AS radius,
        CASE WHEN k % 4 = 0 THEN NULL ELSE CAST(k AS VARCHAR) || '-' || CAST(k % 90 AS VARCHAR) END AS code, ((k * 7) % 13)::DOUBLE AS strength FROM (SELECT s_suppkey AS k FROM supplier))"""
