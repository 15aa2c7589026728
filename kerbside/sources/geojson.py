"""GeoJSON features as columns of JSON text. Positions are longitude, latitude."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _position(p: Column) -> Column:
    return F.array(p["lon"], p["lat"])


def point(lat: Column, lon: Column) -> Column:
    return F.to_json(F.struct(F.lit("Point").alias("type"), F.array(lon, lat).alias("coordinates")))


def line(points: Column) -> Column:
    return F.to_json(F.struct(F.lit("LineString").alias("type"), F.transform(points, _position).alias("coordinates")))


def lines(path: Column) -> Column:
    return F.to_json(F.struct(F.lit("MultiLineString").alias("type"), F.transform(path, lambda c: F.transform(c, _position)).alias("coordinates")))


def points(stops: Column) -> Column:
    return F.to_json(F.struct(F.lit("MultiPoint").alias("type"), F.transform(stops, _position).alias("coordinates")))


def polygons(rings: Column) -> Column:
    """Each ring a polygon of its own."""
    return F.to_json(F.struct(F.lit("MultiPolygon").alias("type"), F.transform(rings, lambda r: F.array(F.transform(r, _position))).alias("coordinates")))


def face_geometry(path: Column, stops: Column) -> Column:
    """The carriageway, or for runs off the network the stops."""
    return F.when(F.size(path) > 0, lines(path)).otherwise(points(stops))


def box_ring(south: Column, west: Column, north: Column, east: Column) -> Column:
    """A closed ring around a box."""
    corners = ((south, west), (south, east), (north, east), (north, west), (south, west))
    return F.array(*[F.struct(a.alias("lat"), o.alias("lon")) for a, o in corners])


def features(rows: DataFrame, id_: Column, geometry: Column, properties: list[Column]) -> DataFrame:
    """One feature per row as JSON text; null properties are left out."""
    body = F.concat(F.lit('{"type":"Feature","id":'), F.to_json(F.array(id_)).substr(F.lit(2), F.length(F.to_json(F.array(id_))) - 2), F.lit(',"geometry":'), geometry, F.lit(',"properties":'), F.to_json(F.struct(*properties)), F.lit("}"))
    return rows.select(id_.alias("id"), body.alias("feature"))


def collection(parts: DataFrame) -> DataFrame:
    """The whole collection as one row of JSON text, for results that are shown on a map. For files write the features."""
    listed = parts.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("id", "feature"))), lambda f: f["feature"]), ",").alias("f"))
    return listed.select(F.concat(F.lit('{"type":"FeatureCollection","features":['), "f", F.lit("]}")).alias("geojson"))
