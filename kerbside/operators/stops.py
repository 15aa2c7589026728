"""Doors collapsed into stops: equal street and number, and near each other."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kerbside.functions import geo, text
from kerbside.operators import kernels

CLUSTER_M = 200.0
GATED_DOORS = 8


def spatial_clusters(points: DataFrame, keys: list[str], order: list[str], metres: float = CLUSTER_M, weight: str | None = None) -> DataFrame:
    """Adds ``cluster``: single-link clusters of each key's points, 0 being the largest.

    Keys whose points lie within the threshold anyway, nearly all, are settled by
    their bounding box; only the places of the others go to the kernel, one key at
    a time, each once with its number of points. Points are taken in the given
    order, which decides ties; a row may stand for several points (``weight``).
    """
    box = points.groupBy(*keys).agg(F.min("lat").alias("s"), F.max("lat").alias("n"), F.min("lon").alias("w"), F.max("lon").alias("e"))
    equator = F.when((F.col("s") <= 0) & (F.col("n") >= 0), F.lit(0.0)).otherwise(F.least(F.abs("s"), F.abs("n")))
    diagonal = F.hypot(geo.haversine(F.col("s"), F.col("w"), F.col("n"), F.col("w")), geo.haversine(equator, F.col("w"), equator, F.col("e")))
    wide = box.where(diagonal > metres * 0.99).select(*keys)
    near = points.join(wide, keys, "left_anti").withColumn("cluster", F.lit(0))

    # points at one place are in one cluster; it stands where the last of them does
    last = F.max(F.struct(*[x for c in order for x in (F.col(c).isNull().alias(f"{c}_none"), F.col(c).alias(c))])).alias("last")
    places = points.join(wide, keys, "left_semi").groupBy(*keys, "lat", "lon").agg((F.sum(weight) if weight else F.count("*")).alias("points"), last)
    places = places.select(*keys, "lat", "lon", "points", *[F.col(f"last.{c}").alias(f"last_{i}") for i, c in enumerate(order)])

    def label(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values([f"last_{i}" for i in range(len(order))], kind="stable")
        return group[[*keys, "lat", "lon"]].assign(cluster=kernels.cluster(group["lat"].to_numpy(), group["lon"].to_numpy(), metres, group["points"].to_numpy()).astype(np.int32))

    schema = T.StructType([places.schema[c] for c in (*keys, "lat", "lon")]).add("cluster", T.IntegerType())
    labelled = places.groupBy(*keys).applyInPandas(label, schema).withColumnsRenamed({c: f"_{c}" for c in (*keys, "lat", "lon")})
    same = [F.col(c) == F.col(f"_{c}") for c in keys] + [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in ("lat", "lon")]
    far = points.join(labelled, same).select(*points.columns, "cluster")
    return near.unionByName(far)


def build_stops(addresses: DataFrame, metres: float = CLUSTER_M) -> DataFrame:
    """One row per stop: stop_id, lat, lon, street, street_norm, number, door_count, doors (by id).

    The id is s and the lowest door id; the position is the mean of the doors in
    order of their ids.
    """
    rows = spatial_clusters(addresses.select("osm_id", "ord", "lat", "lon", "number", "street", "unit"), ["street", "number"], ["ord"], metres)
    doors = F.array_sort(F.collect_list(F.struct("osm_id", "lat", "lon", "unit")))
    stops = rows.groupBy("street", "number", "cluster").agg(doors.alias("doors"))
    n = F.size("doors")

    def mean(field: str) -> Column:
        return F.aggregate("doors", F.lit(0.0), lambda s, d: s + d[field]) / n

    return stops.select(
        F.concat(F.lit("s"), F.col("doors")[0]["osm_id"]).alias("stop_id"),
        mean("lat").alias("lat"),
        mean("lon").alias("lon"),
        "street",
        text.normalise_street(F.col("street")).alias("street_norm"),
        "number",
        n.alias("door_count"),
        F.transform("doors", lambda d: F.struct(d["osm_id"].alias("osm_id"), d["unit"].alias("unit"))).alias("doors"),
    )


def stop_order() -> list[Column]:
    """Street, natural house number, id."""
    return [F.col("street"), text.natural_key(F.col("number")), F.col("stop_id")]


def payload(stops: DataFrame) -> DataFrame:
    """What a stop shows: id, position and properties; the gated ones with their uncapped dwell too."""
    gated = F.col("door_count") >= GATED_DOORS
    return stops.select(
        "stop_id",
        "lat",
        "lon",
        "street",
        "number",
        text.stop_label(F.col("number"), F.col("street"), F.col("door_count")).alias("label"),
        "door_count",
        F.bround(geo.dwell_seconds(F.col("door_count")) / 60, 1).alias("dwell_minutes"),
        F.when(gated, F.lit(True)).alias("gated_candidate"),
        F.when(gated, F.bround(geo.dwell_seconds(F.col("door_count"), None) / 60, 1)).alias("uncapped_dwell_minutes"),
        F.filter(F.transform("doors", lambda d: d["unit"]), lambda u: F.coalesce(u, F.lit("")) != "").alias("units"),
    )
