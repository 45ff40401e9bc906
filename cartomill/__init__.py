"""Raster, vector and route analytics as Spark DataFrame operators."""
