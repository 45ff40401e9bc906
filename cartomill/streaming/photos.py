"""Photos as they arrive, and the state of markers under a stream of edits."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cartomill.plans.geojson import stem


def arriving(spark: SparkSession, path: str) -> DataFrame:
    """(map_id, source_photo, modified, content) of image files, each once."""
    raw = spark.readStream.format("binaryFile").option("pathGlobFilter", "*.{jpg,jpeg,png}").load(path)
    name = F.element_at(F.split("path", "/"), -1)
    return raw.select(stem(name).alias("map_id"), name.alias("source_photo"), F.col("modificationTime").alias("modified"), "content")


def latest(edits: DataFrame, lateness: str = "1 hour") -> DataFrame:
    """(map_id, id, last) of a stream of edits (map_id, id, ts, op, x, y): the last write to each marker; later ones than ``lateness`` are ignored."""
    return edits.withWatermark("ts", lateness).groupBy("map_id", "id").agg(F.max_by(F.struct("op", "x", "y"), "ts").alias("last"))
