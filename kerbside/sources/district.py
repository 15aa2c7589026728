"""A synthetic district derived from the TPC-H-like tables: doors from customer, a road lattice from nation x nation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from kerbside.runtime import table

#: The same text runs in Spark and in DuckDB, with the same doubles.
DOORS_SQL = """
SELECT concat('n', CAST(i AS STRING)) AS osm_id, i AS ord,
       -3.784e1 + r * 2e-3 + (CASE WHEN r = 19 THEN 5e-2 ELSE 0e0 END) + (CASE WHEN number % 2 = 0 THEN 2e-4 ELSE -2e-4 END) AS lat,
       1.45e2 + (slot + (pos + 5e-1) / 3e0) * 2.5e-3 AS lon,
       CAST(number AS STRING) AS number,
       CASE WHEN r >= 18 THEN 'Mary Street' WHEN r = 17 THEN 'Ghost Road' ELSE concat('Row ', CAST(r AS STRING), ' Street') END AS street,
       CASE WHEN unit > 0 THEN CAST(unit AS STRING) END AS unit,
       CASE WHEN r = 19 THEN '3104' ELSE '3101' END AS postcode
FROM (SELECT i, r, slot, pos, unit, slot * 3 + pos + 1 AS number FROM (
  SELECT i, i % 20 AS r, k % 15 AS slot, CAST(floor(k / 15e0) AS BIGINT) % 3 AS pos, CAST(floor(floor(k / 15e0) / 3e0) AS BIGINT) AS unit
  FROM (SELECT c_custkey AS i, CAST(floor(c_custkey / 20e0) AS BIGINT) AS k FROM customer) x) y) z
"""
_LAT = "-3.784e1 + {r} * 2e-3 + (CASE WHEN {r} = 19 THEN 5e-2 ELSE 0e0 END)"
_LON = "1.45e2 + {c} * 2.5e-3"
#: One row per way of two points.
SEGMENTS_SQL = f"""
WITH g AS (SELECT a.n_nationkey AS r, b.n_nationkey AS c FROM nation a CROSS JOIN nation b WHERE a.n_nationkey < 20 AND b.n_nationkey < 16 AND a.n_nationkey <> 17)
SELECT CAST(1000 + 16 * r + c AS BIGINT) AS osm_id,
       CASE WHEN r >= 18 THEN 'Mary Street' ELSE concat('Row ', CAST(r AS STRING), ' Street') END AS name,
       CASE WHEN r % 5 = 0 THEN 'primary' ELSE 'residential' END AS highway,
       {_LAT.format(r="r")} AS a_lat, {_LON.format(c="c")} AS a_lon, {_LAT.format(r="r")} AS b_lat, {_LON.format(c="(c + 1)")} AS b_lon
FROM g WHERE c < 15
UNION ALL
SELECT CAST(5000 + 16 * r + c AS BIGINT), concat('Column ', CAST(c AS STRING), ' Street'), 'residential',
       {_LAT.format(r="r")}, {_LON.format(c="c")}, {_LAT.format(r="(CASE WHEN r = 16 THEN 18 ELSE r + 1 END)")}, {_LON.format(c="c")}
FROM g WHERE r <= 16
"""


def _view(spark: SparkSession, sf_dir: str, names: tuple[str, ...]) -> dict[str, DataFrame]:
    return {n: table(spark, sf_dir, n) for n in names}


def doors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The address table: osm_id, ord, lat, lon, number, street, unit, postcode."""
    return spark.sql(DOORS_SQL.replace("FROM customer", "FROM {customer}"), **_view(spark, sf_dir, ("customer",)))


def road_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(SEGMENTS_SQL.replace("FROM nation a CROSS JOIN nation b", "FROM {nation} a CROSS JOIN {nation} b"), **_view(spark, sf_dir, ("nation",)))


def ways(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The way table: ord, osm_id, geometry, tags."""
    return road_segments(spark, sf_dir).selectExpr(
        "osm_id AS ord",
        "osm_id",
        "array(named_struct('lat', a_lat, 'lon', a_lon), named_struct('lat', b_lat, 'lon', b_lon)) AS geometry",
        "CASE WHEN highway = 'primary' THEN map('highway', highway, 'name', name, 'lanes', '4') ELSE map('highway', highway, 'name', name, 'maxspeed', '50') END AS tags",
    )
