"""Queries over the driver tables, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from cartomill.queries import photos, rasters, routes, vectors

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {**rasters.QUERIES, **vectors.QUERIES, **routes.QUERIES, **photos.QUERIES}
ORACLE_SQL: dict[str, str] = {**rasters.SQL, **vectors.SQL, **routes.SQL, **photos.SQL}

flagship = routes.flagship
