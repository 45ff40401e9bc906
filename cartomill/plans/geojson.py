"""GeoJSON documents from feature tables: one string for each feature, assembled in order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cartomill.functions import geometry as G
from cartomill.schemas import EXPORT_ORDER


def _text(x: Column) -> Column:
    """JSON string or null."""
    return F.coalesce(F.to_json(F.array(x.cast("string"))).substr(F.lit(2), F.length(F.to_json(F.array(x.cast("string")))) - 2), F.lit("null"))


def number(x: Column) -> Column:
    """Six places at most, without needless zeros; null as null."""
    s = F.format_string("%.6f", F.round(x.cast("double"), 6))
    return F.when(x.isNull(), "null").otherwise(F.regexp_replace(s, r"\.?0+$", ""))


def pair(x: Column, y: Column, height: Column) -> Column:
    return F.concat(F.lit("["), number(x), F.lit(","), number(G.flipped(y, height)), F.lit("]"))


def point(x: Column, y: Column, height: Column) -> Column:
    return F.concat(F.lit('{"type":"Point","coordinates":'), pair(x, y, height), F.lit("}"))


def line(points: Column, height: Column) -> Column:
    return F.concat(F.lit('{"type":"LineString","coordinates":['), F.array_join(F.transform(points, lambda p: pair(p["x"], p["y"], height)), ","), F.lit("]}"))


def polygon(ring: Column, height: Column) -> Column:
    """The ring is closed and upright."""
    return F.concat(F.lit('{"type":"Polygon","coordinates":[['), F.array_join(F.transform(G.closed(ring), lambda p: pair(p["x"], p["y"], height)), ","), F.lit("]]}"))


def feature(geometry: Column, properties: Column) -> Column:
    return F.concat(F.lit('{"type":"Feature","geometry":'), geometry, F.lit(',"properties":'), properties, F.lit("}"))


def _role(name: str) -> Column:
    return F.lit(f'{{"role":"{name}"}}')


def features(maps: DataFrame, polygons: DataFrame, segments: DataFrame, controls: DataFrame, starts: DataFrame, finishes: DataFrame, routes: DataFrame, breakdown: DataFrame) -> DataFrame:
    """(map_id, layer, ord, feature): polygons by class, paths, controls, start, finish, legs, route, in this order.

    maps: (map_id, width, height, ...).  An unread control code is an explicit null; absent
    starts, finishes and routes of under two points give no feature.
    """
    dims = maps.select("map_id", F.col("height").alias("_h"))
    h = F.col("_h")
    with_h = lambda df: df.join(dims, "map_id")
    out = lambda df, layer, order, g, p: df.select("map_id", F.lit(layer).alias("layer"), order.cast("long").alias("ord"), feature(g, p).alias("feature"))
    rank = F.array_position(F.array(*[F.lit(c) for c in EXPORT_ORDER]), F.col("class_name"))
    areas = with_h(polygons)
    ends = F.array(F.struct(F.col("x1").alias("x"), F.col("y1").alias("y")), F.struct(F.col("x2").alias("x"), F.col("y2").alias("y")))
    segs = with_h(segments)
    ctl = with_h(controls)
    shares = breakdown.groupBy("map_id", "route_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("fraction")).alias("o"), "class_name", "fraction"))), lambda s: F.concat(_text(s["class_name"]), F.lit(":"), number(s["fraction"]))), ",").alias("_b"))
    way = with_h(routes).where(F.size("points") >= 2).join(shares, ["map_id", "route_id"], "left")
    extra = F.coalesce(F.concat(F.lit(',"terrain_breakdown":{'), F.col("_b"), F.lit("}")), F.lit(""))
    parts = [
        out(areas, 0, rank * 2**32 + F.col("poly_id"), polygon(F.col("ring"), h), F.concat(F.lit('{"terrain_class":'), _text(F.col("class_name")), F.lit("}"))),
        out(segs.where("role = 'path'"), 1, F.col("seg_id"), line(ends, h), F.lit('{"terrain_class":"path"}')),
        out(ctl, 2, F.col("seq"), point(F.col("x"), F.col("y"), h), F.concat(F.lit('{"role":"control","code":'), _text(F.col("code")), F.lit("}"))),
        out(with_h(starts), 3, F.lit(0), point(F.col("x"), F.col("y"), h), _role("start")),
        out(with_h(finishes), 4, F.lit(0), point(F.col("x"), F.col("y"), h), _role("finish")),
        out(segs.where("role = 'course_leg'"), 5, F.col("seg_id"), line(ends, h), _role("course_leg")),
        out(way, 6, F.col("route_id"), line(F.col("points"), h), F.concat(F.lit('{"role":"demo_route","cost":'), number(F.col("cost")), F.lit(',"recomputed_cost":'), number(F.col("recomputed_cost")), extra, F.lit("}"))),
    ]
    whole = parts[0]
    for p in parts[1:]:
        whole = whole.unionByName(p)
    return whole


def collection_properties() -> Column:
    """Of a row of maps (source_photo, width, height, scale_to_original, mn_line_spacing_px, quad_found)."""
    flag = F.when(F.col("quad_found"), "true").otherwise("false")
    return F.concat(
        F.lit('{"source_photo":'), _text(F.col("source_photo")), F.lit(',"image_width_px":'), F.col("width").cast("string"), F.lit(',"image_height_px":'), F.col("height").cast("string"),
        F.lit(',"scale_to_original_photo":'), number(F.col("scale_to_original")), F.lit(',"magnetic_north_line_spacing_px":'), number(F.col("mn_line_spacing_px")),
        F.lit(',"quad_rectification_found":'), flag, F.lit("}"),
    )


def documents(maps: DataFrame, rows: DataFrame) -> DataFrame:
    """(map_id, geojson): one document for each map, its features in order."""
    listed = rows.groupBy("map_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("layer", "ord", "feature"))), lambda f: f["feature"]), ",").alias("_f"))
    doc = F.concat(F.lit('{"type":"FeatureCollection","features":['), F.coalesce("_f", F.lit("")), F.lit('],"properties":'), collection_properties(), F.lit("}"))
    return maps.join(listed, "map_id", "left").select("map_id", doc.alias("geojson"))


def stem(name: Column) -> Column:
    return F.regexp_replace(name, r"\.[^.]+$", "")


def original_scale(doc: Column) -> Column:
    return F.get_json_object(doc, "$.properties.scale_to_original_photo").cast("double")
