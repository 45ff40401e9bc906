"""Photos as rows: reading, PNG encoding and decoding, and writing of exports."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cartomill.functions.color import half_up
from cartomill.plans.geojson import stem

_SIGN = b"\x89PNG\r\n\x1a\n"


def _read(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("image").option("dropInvalid", False).option("pathGlobFilter", "*.{jpg,jpeg,png,JPG,JPEG,PNG}").load(path)


def rejected(spark: SparkSession, path: str) -> DataFrame:
    """(source_photo): files with a photo's extension that can't be decoded."""
    return _read(spark, path).where("image.height <= 0").select(F.element_at(F.split("image.origin", "/"), -1).alias("source_photo"))


def photos(spark: SparkSession, path: str) -> DataFrame:
    """(map_id, source_photo, height, width, channels, data): decodable jpg, jpeg and png files; data is B, G, R by rows.

    rejected() lists the files that can't be decoded.
    """
    raw = _read(spark, path).where("image.height > 0")
    name = F.element_at(F.split("image.origin", "/"), -1)
    return raw.select(stem(name).alias("map_id"), name.alias("source_photo"), "image.height", "image.width", F.col("image.nChannels").alias("channels"), "image.data")


def pixels(images: DataFrame) -> DataFrame:
    """(map_id, y, x, b, g, r) of photos(); a band of rows at a time."""

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for key, h, w, n, data in zip(*(b.column(i).to_pylist() for i in range(5)), strict=True):
                img = np.frombuffer(data, np.uint8).reshape(h, w, n).astype(np.int32)
                img = np.repeat(img, 3, 2) if n == 1 else img
                band = max(1, 65_536 // max(1, w))
                for y in range(0, h, band):
                    part = img[y : y + band]
                    ys, xs = np.indices(part.shape[:2], dtype=np.int32)
                    cols = [pa.array([key] * ys.size), pa.array((ys + y).ravel()), pa.array(xs.ravel()), *[pa.array(part[..., c].ravel()) for c in range(3)]]
                    yield pa.RecordBatch.from_arrays(cols, ["map_id", "y", "x", "b", "g", "r"])

    return images.select("map_id", "height", "width", "channels", "data").mapInArrow(spread, "map_id string, y int, x int, b int, g int, r int")


def png_bytes(img: np.ndarray) -> bytes:
    """img: H x W x 3, blue first, or H x W."""
    rgb = img[..., ::-1] if img.ndim == 3 else img
    h, w = rgb.shape[:2]
    lines = np.concatenate([np.zeros((h, 1), np.uint8), np.ascontiguousarray(rgb.astype(np.uint8)).reshape(h, -1)], 1).tobytes()
    chunk = lambda kind, body: struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))
    return _SIGN + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 2 if rgb.ndim == 3 else 0, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(lines, 6)) + chunk(b"IEND", b"")


def encoded(rows: DataFrame) -> DataFrame:
    """(map_id, png) of (map_id, y, x, b, g, r): one map at a time."""

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        img = np.zeros((pdf.y.max() + 1, pdf.x.max() + 1, 3), np.uint8)
        img[pdf.y, pdf.x] = pdf[["b", "g", "r"]].to_numpy()
        return pd.DataFrame({"map_id": [pdf.map_id.iloc[0]], "png": [png_bytes(img)]})

    return rows.select("map_id", "y", "x", "b", "g", "r").groupBy("map_id").applyInPandas(one, "map_id string, png binary")


def save_geojson(docs: DataFrame, path: str) -> None:
    """One folder of text for each map, named by its id."""
    docs.select("geojson", "map_id").repartition("map_id").write.partitionBy("map_id").mode("overwrite").text(path)


def scale_bar(value: Column, low: float, high: float) -> Column:
    """Shade of a value between two bounds."""
    return half_up(255 * (F.least(F.greatest(value, F.lit(low)), F.lit(high)) - low) / (high - low))
