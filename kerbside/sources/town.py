"""A larger synthetic town whose streets grow with the tables: a block of 40 columns, a row of blocks for every 40 customers.

Lanes run along two of three rows, Walks down the columns, with a bend in the
middle of every block, some blocks missing. Coast Road is one long street beside
them, joined by a Gate at every 25th of its bends. The doors are those of the
customers, beside their block's north-western corner.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from kerbside.runtime import table

#: The same text runs in Spark and in DuckDB, with the same doubles.
NODES_SQL = """
SELECT i, r, c, -3.79e1 + r * 1e-3 + (i * 7919 % 97) * 1e-6 AS lat, 1.45e2 + c * 1.3e-3 + (i * 7127 % 89) * 1e-6 AS lon
FROM (SELECT c_custkey AS i, CAST(floor((c_custkey - 1) / 4e1) AS BIGINT) AS r, (c_custkey - 1) % 40 AS c FROM customer) k
"""
_MIDDLE = "(a.lat + b.lat) / 2e0 + (a.i % 5 - 2) * 2e-5 AS m_lat, (a.lon + b.lon) / 2e0 + (a.i % 3 - 1) * 2e-5 AS m_lon"
#: One row per way of three points.
WAYS_SQL = f"""
WITH n AS ({NODES_SQL}),
k AS (SELECT i, -3.79e1 + i * 3e-5 AS lat, 1.4499e2 + (i * 7717 % 83) * 1e-6 AS lon FROM n)
SELECT CAST(4 * a.i AS BIGINT) AS osm_id, concat('Lane ', CAST(a.r AS STRING)) AS name, CASE WHEN a.r % 10 = 0 THEN 'secondary' ELSE 'residential' END AS highway, a.lat AS a_lat, a.lon AS a_lon, {_MIDDLE}, b.lat AS b_lat, b.lon AS b_lon
FROM n a JOIN n b ON b.i = a.i + 1 WHERE a.c < 39 AND a.r % 3 <> 1 AND a.i % 11 <> 0
UNION ALL
SELECT CAST(4 * a.i + 1 AS BIGINT), concat('Walk ', CAST(a.c AS STRING)), CASE WHEN a.c = 20 THEN 'primary' ELSE 'tertiary' END, a.lat, a.lon, {_MIDDLE}, b.lat, b.lon
FROM n a JOIN n b ON b.i = a.i + 40 WHERE a.i % 13 <> 0
UNION ALL
SELECT CAST(4 * a.i + 2 AS BIGINT), 'Coast Road', 'unclassified', a.lat, a.lon, {_MIDDLE}, b.lat, b.lon
FROM k a JOIN k b ON b.i = a.i + 1
UNION ALL
SELECT CAST(4 * a.i + 3 AS BIGINT), concat('Gate G', CAST(a.i AS STRING)), 'service', a.lat, a.lon, {_MIDDLE}, b.lat, b.lon
FROM k a JOIN n b ON b.i = a.i WHERE a.i % 25 = 0
"""
#: One row per segment of two points: ord of its way, place in it, and its ends.
SEGMENTS_SQL = f"""
SELECT osm_id AS ord, 0 AS seg, osm_id, name, highway, a_lat, a_lon, m_lat AS b_lat, m_lon AS b_lon FROM ({WAYS_SQL}) w
UNION ALL SELECT osm_id, 1, osm_id, name, highway, m_lat, m_lon, b_lat, b_lon FROM ({WAYS_SQL}) v
"""
DOORS_SQL = f"SELECT concat('n', CAST(i AS STRING)) AS osm_id, i AS ord, lat + 3e-4 AS lat, lon + 2e-4 + (i % 7) * 1e-5 AS lon, CAST(1 + r AS STRING) AS number, concat('Walk ', CAST(c AS STRING)) AS street FROM ({NODES_SQL}) n"


def over(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    """The result of SQL over customer."""
    return spark.sql(sql.replace("FROM customer", "FROM {customer}"), customer=table(spark, sf_dir, "customer"))


def doors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """osm_id, ord, lat, lon, number, street."""
    return over(spark, sf_dir, DOORS_SQL)


def ways(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The way table: ord, osm_id, geometry, tags."""
    return over(spark, sf_dir, WAYS_SQL).selectExpr(
        "osm_id AS ord",
        "osm_id",
        "array(named_struct('lat', a_lat, 'lon', a_lon), named_struct('lat', m_lat, 'lon', m_lon), named_struct('lat', b_lat, 'lon', b_lon)) AS geometry",
        "map('highway', highway, 'name', name) AS tags",
    )
