"""Manual corrections as edits of a layer of their own; detections stay as they are."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cartomill.operators import vector
from cartomill.schemas import MARKER_RADIUS, RADIUS_FALLBACK, RADIUS_OF_DIAGONAL


def editable_markers(controls: DataFrame, starts: DataFrame, finishes: DataFrame) -> DataFrame:
    """(map_id, id, kind, x, y, radius, code): controls, then start, then finish, with dense ids from 0 in each map."""
    one = lambda df, kind, rank: df.select("map_id", F.lit(rank).alias("_rank"), F.lit(0).alias("_seq"), F.lit(kind).alias("kind"), F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"), F.lit(MARKER_RADIUS).alias("radius"), F.lit(None).cast("string").alias("code"))
    first = controls.select("map_id", F.lit(0).alias("_rank"), F.col("seq").alias("_seq"), F.lit("control").alias("kind"), *[F.col(c).cast("double").alias(c) for c in ("x", "y", "radius")], "code")
    every = first.unionByName(one(starts, "start", 1)).unionByName(one(finishes, "finish", 2))
    return every.withColumn("id", F.row_number().over(W.partitionBy("map_id").orderBy("_rank", "_seq")).cast("long") - 1).select("map_id", "id", "kind", "x", "y", "radius", "code")


def default_radius(markers: DataFrame, dims: DataFrame) -> DataFrame:
    """(map_id, radius): mean radius of the controls, else a share of the diagonal, else a constant."""
    mean = markers.where("kind = 'control'").groupBy("map_id").agg(F.avg("radius").alias("_mean"))
    rest = RADIUS_OF_DIAGONAL * F.sqrt(F.col("w") * F.col("w") + F.col("h") * F.col("h"))
    return dims.join(mean, "map_id", "left").select("map_id", F.coalesce("_mean", rest, F.lit(RADIUS_FALLBACK)).alias("radius"))


def added(markers: DataFrame, new: DataFrame) -> DataFrame:
    """new: (map_id, kind, x, y, radius, code), one for each map.  A start or finish takes the place of the one there was."""
    gone = new.where(F.col("kind").isin("start", "finish")).select("map_id", "kind")
    kept = markers.join(gone, ["map_id", "kind"], "left_anti")
    next_id = markers.groupBy("map_id").agg((F.max("id") + 1).alias("_next"))
    fresh = new.join(next_id, "map_id", "left").withColumn("id", F.coalesce("_next", F.lit(0)).cast("long")).select(markers.columns)
    return kept.select(markers.columns).unionByName(fresh)


def moved(markers: DataFrame, moves: DataFrame) -> DataFrame:
    """moves: (map_id, id, x, y); the radius and code stay."""
    to = moves.select("map_id", "id", F.col("x").alias("_x"), F.col("y").alias("_y"))
    return markers.join(to, ["map_id", "id"], "left").withColumns({"x": F.coalesce("_x", "x"), "y": F.coalesce("_y", "y")}).select(markers.columns)


def deleted(markers: DataFrame, ids: DataFrame) -> DataFrame:
    return markers.join(ids.select("map_id", "id"), ["map_id", "id"], "left_anti").select(markers.columns)


def recoloured(polygons: DataFrame, taps: DataFrame) -> DataFrame:
    """taps: (map_id, pt_id, x, y, class_name): the topmost polygon under each tap gets its class; later taps win."""
    last = vector.last_taps(taps.select("map_id", "pt_id", "x", "y", F.col("class_name").alias("_class")), polygons, "_class")
    return polygons.join(last, ["map_id", "poly_id"], "left").withColumn("class_name", F.coalesce("_class", "class_name")).select(polygons.columns)


def grouped(polygons: DataFrame) -> DataFrame:
    """(map_id, class_name, first, rings): rings of each class in the order of their ids, classes by their first."""
    return polygons.groupBy("map_id", "class_name").agg(F.min("poly_id").alias("first"), F.transform(F.array_sort(F.collect_list(F.struct("poly_id", "ring"))), lambda p: p["ring"]).alias("rings"))


def folded(markers: DataFrame, log: DataFrame) -> DataFrame:
    """State after an edit log (map_id, seq, op, id, x, y): the last write to a marker wins; op is move or delete."""
    last = log.groupBy("map_id", "id").agg(F.max_by(F.struct("op", "x", "y"), "seq").alias("_l"))
    rows = markers.join(last, ["map_id", "id"], "left").where(F.coalesce(F.col("_l.op"), F.lit("")) != "delete")
    return rows.withColumns({"x": F.coalesce("_l.x", "x"), "y": F.coalesce("_l.y", "y")}).select(markers.columns)
