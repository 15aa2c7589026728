"""Column builders for distances, projections, rings and grid cells. Coordinates are degrees, lengths metres."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_M = 6_371_000.0
#: Metres to a degree of latitude in the flat projection; on purpose not EARTH_M's.
DEGREE_M = 111_320.0
NODE_DIGITS = 7
WALK_M_PER_MIN = 80.0


def haversine(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    p, q = F.radians(lat1), F.radians(lat2)
    h = F.pow(F.sin((q - p) / 2), 2) + F.cos(p) * F.cos(q) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return F.lit(2 * EARTH_M) * F.asin(F.sqrt(F.least(h, F.lit(1.0))))


def project(lat: Column, lon: Column, a_lat: Column, a_lon: Column, b_lat: Column, b_lon: Column) -> Column:
    """Nearest point of a segment in a flat frame at the point's latitude: struct of offset (m), lat, lon."""
    k = F.cos(F.radians(lat))
    ax, ay = (a_lon - lon) * k, a_lat - lat
    dx, dy = (b_lon - lon) * k - ax, (b_lat - lat) - ay
    square = dx * dx + dy * dy
    t = F.when(square == 0, F.lit(0.0)).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), -(ax * dx + ay * dy) / F.nullif(square, F.lit(0.0)))))
    return F.struct((F.sqrt(F.pow(ax + t * dx, F.lit(2)) + F.pow(ay + t * dy, F.lit(2))) * DEGREE_M).alias("offset_m"), (a_lat + t * (b_lat - a_lat)).alias("lat"), (a_lon + t * (b_lon - a_lon)).alias("lon"))


def node(x: Column) -> Column:
    """A coordinate as a whole number of 1e-7 degrees, so that equal nodes join exactly."""
    return F.round(x * 1e7).cast("bigint")


def degrees_of(n: Column) -> Column:
    return n / F.lit(1e7)


def cell(x: Column, size: float) -> Column:
    return F.floor(x / size).cast("bigint")


def cells_between(low: Column, high: Column, size: float) -> Column:
    return F.sequence(cell(low, size), cell(high, size))


def pad_lat(metres: float) -> float:
    return metres * 1.01 / DEGREE_M


def pad_lon(metres: float, lat: Column) -> Column:
    """Degrees of longitude that cover so many metres at this latitude, with some slack."""
    return F.lit(metres * 1.02 / DEGREE_M) / F.greatest(F.cos(F.radians(F.least(F.abs(lat) + pad_lat(metres), F.lit(89.0)))), F.lit(0.01))


def ring_contains(lat: Column, lon: Column, ring: Column) -> Column:
    """Ray casting with a half-open latitude test; a ring of less than three points holds nothing."""

    def step(inside: Column, i: Column) -> Column:
        a, b = F.get(ring, i), F.get(ring, (i + 1) % F.size(ring))
        spans = (a["lat"] > lat) != (b["lat"] > lat)
        rise = F.nullif(b["lat"] - a["lat"], F.lit(0.0))
        cross = a["lon"] + (lat - a["lat"]) / rise * (b["lon"] - a["lon"])
        return inside != (spans & F.coalesce(lon < cross, F.lit(False)))

    return F.when(F.size(ring) < 3, F.lit(False)).otherwise(F.aggregate(F.sequence(F.lit(0), F.size(ring) - 1), F.lit(False), step))


def rings_contain(lat: Column, lon: Column, rings: Column) -> Column:
    """Even-odd over all rings, so holes count."""
    return F.aggregate(rings, F.lit(False), lambda inside, ring: inside != ring_contains(lat, lon, ring))


def ring_is_closed(ring: Column, tolerance_m: float = 1.0) -> Column:
    a, b = F.get(ring, F.lit(0)), F.element_at(ring, -1)
    return (F.size(ring) > 3) & (haversine(a["lat"], a["lon"], b["lat"], b["lon"]) <= tolerance_m)


def segments(points: Column) -> Column:
    """Consecutive pairs of an array of points: structs of a and b."""
    n = F.size(points)
    return F.when(n > 1, F.transform(F.sequence(F.lit(0), n - 2), lambda i: F.struct(F.get(points, i).alias("a"), F.get(points, i + 1).alias("b")))).otherwise(F.array())


def line_length(points: Column) -> Column:
    return F.aggregate(segments(points), F.lit(0.0), lambda s, e: s + haversine(e["a"]["lat"], e["a"]["lon"], e["b"]["lat"], e["b"]["lon"]))


def interpolate(a: Column, b: Column, share: Column) -> Column:
    """The place so far from a to b, both structs of lat and lon."""
    return F.struct((a["lat"] + (b["lat"] - a["lat"]) * share).alias("lat"), (a["lon"] + (b["lon"] - a["lon"]) * share).alias("lon"))


def circle(lat: Column, lon: Column, radius_m: Column, steps: int = 96) -> Column:
    """A closed polygon of ``steps`` sides around a point."""
    k = F.cos(F.radians(lat))

    def at(i: Column) -> Column:
        angle = i / F.lit(float(steps)) * F.lit(2.0) * F.pi()
        return F.struct((lat + radius_m * F.sin(angle) / DEGREE_M).alias("lat"), (lon + radius_m * F.cos(angle) / (F.lit(DEGREE_M) * k)).alias("lon"))

    return F.transform(F.sequence(F.lit(0), F.lit(steps)), at)


def walk_minutes(metres: Column) -> Column:
    return metres / WALK_M_PER_MIN


def dwell_seconds(doors: Column, cap: int | None = 8, approach: float = 30.0, per_door: float = 75.0) -> Column:
    charged = doors if cap is None else F.least(doors, F.lit(cap))
    return F.lit(approach) + F.lit(per_door) * charged


def longer_axis(south: Column, north: Column, west: Column, east: Column) -> Column:
    """lat or lon, whichever is longer in metres; latitude on a tie."""
    height = (north - south) * DEGREE_M
    width = (east - west) * DEGREE_M * F.cos(F.radians((south + north) / 2))
    return F.when(height >= width, "lat").otherwise("lon")
