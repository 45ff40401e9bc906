"""Schemas, terrain dimension and constants.  The values below are fixed: results depend on them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

POINT = T.StructType([T.StructField("x", T.FloatType()), T.StructField("y", T.FloatType())])
RING = T.ArrayType(POINT)
PIXELS = T.StructType([T.StructField("map_id", T.StringType()), *[T.StructField(c, T.IntegerType()) for c in ("y", "x", "b", "g", "r")]])
POLYGONS = T.StructType([T.StructField("map_id", T.StringType()), T.StructField("poly_id", T.LongType()), T.StructField("class_name", T.StringType()), T.StructField("ring", RING)])
SEGMENTS = T.StructType([T.StructField("map_id", T.StringType()), T.StructField("seg_id", T.LongType()), T.StructField("role", T.StringType()), *[T.StructField(c, T.FloatType()) for c in ("x1", "y1", "x2", "y2")]])
CONTROLS = T.StructType([T.StructField("map_id", T.StringType()), T.StructField("seq", T.IntegerType()), *[T.StructField(c, T.FloatType()) for c in ("x", "y", "radius")], T.StructField("code", T.StringType())])

WORKING_MAX_SIDE = 3000
WHITE_PERCENTILE = 97
NORTH_TOLERANCE_DEG = 10.0
MIN_PAPER_SHARE, MIN_QUAD_HULL = 0.25, 0.85
MIN_POLYGON_AREA, SIMPLIFY_EPS, BLUR = 60.0, 2.0, 21
MIN_HATCH_HOLES, MIN_HOLE_AREA = 3, 5.0
CLUSTERS = 6
CIRCLE_VOTES_DEFAULT = 38.0
RING_COVERAGE_MIN = 0.75
TRIANGLE_AREA, TRIANGLE_SCORE = (0.25, 1.3), 0.85
DEFAULT_COST, OUTSIDE_COST, PATH_WIDTH = 1.0, 50.0, 3
HIT_SLOP, MARKER_RADIUS, RADIUS_OF_DIAGONAL, RADIUS_FALLBACK = 14.0, 10.0, 0.013, 25.0

#: (class, code, cost); codes are in paint order, the greatest wins.
TERRAIN = [
    ("default_gap", 0, 1.0),
    ("clearing", 1, 1.0),
    ("forest", 2, 1.5),
    ("thicket", 3, 4.0),
    ("rock", 4, 2.5),
    ("marsh", 5, 3.0),
    ("water", 6, 20.0),
    ("out_of_bounds", 7, 50.0),
    ("path", 8, 0.8),
    ("outside_valid_mask", 9, 50.0),
]
#: Order of classes in exports.
EXPORT_ORDER = ["water", "out_of_bounds", "rock", "marsh", "forest", "clearing", "thicket"]


def terrain_dim(spark: SparkSession) -> DataFrame:
    """(class_name, code, cost): ten rows, safe to broadcast."""
    return spark.createDataFrame(TERRAIN, "class_name string, code int, cost double")
