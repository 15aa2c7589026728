"""Atomic runs of work: one street, one side where the road is busy, one block, at most about 45 minutes."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kerbside.functions import geo, text
from kerbside.operators import kernels, network
from kerbside.operators.stops import spatial_clusters

MOST_MINUTES = 45.0
FRONTAGE_M = 10.0


def _member() -> Column:
    """A stop as a struct that sorts by natural house number, then street and id."""
    return F.struct(text.natural_key(F.col("number")).alias("natural"), "street", "stop_id", "number", "lat", "lon", "door_count", F.transform("doors", lambda d: d["osm_id"]).alias("door_ids"))


def _dwell(stop: Column) -> Column:
    return geo.dwell_seconds(stop["door_count"]) / 60


def _chain_length(stops: Column) -> Column:
    return geo.line_length(F.transform(stops, lambda s: F.struct(s["lat"].alias("lat"), s["lon"].alias("lon"))))


def split_by_side(members: DataFrame, most_minutes: float = MOST_MINUTES) -> DataFrame:
    """members: one row per stop with span_id, busy, highway, length_m (of the run), off_network.

    Returns faces without geometry. A run that takes longer than ``most_minutes``
    is cut in house-number order: the fold carries how many parts are closed and
    the minutes of the open one, and closes it when it is full or when no more
    stops are left than parts.
    """
    side = F.when(F.col("busy"), text.parity(F.col("number"))).otherwise(F.lit("both"))
    runs = members.withColumn("side", side).groupBy("span_id", "side", "busy", "highway", "length_m", "off_network").agg(F.array_sort(F.collect_list(_member())).alias("stops"))
    total = F.aggregate("stops", F.lit(0.0), lambda s, x: s + _dwell(x)) + geo.walk_minutes(F.col("length_m"))
    runs = runs.withColumn("total", total).withColumn("parts", F.least(F.size("stops"), F.greatest(F.lit(1), F.ceil(F.col("total") / most_minutes).cast("int"))))
    walk, goal, n = F.col("length_m") / F.col("parts") / geo.WALK_M_PER_MIN, F.col("total") / F.col("parts"), F.size("stops")

    def fold(state: Column, stop: Column) -> Column:
        used = state["used"] + _dwell(stop)
        left_stops, left_parts = n - F.size(state["of"]) - 1, F.col("parts") - state["closed"] - 1
        close = (left_parts > 0) & ((left_stops <= left_parts) | (used >= goal))
        return F.struct((state["closed"] + close.cast("int")).alias("closed"), F.when(close, walk).otherwise(used).alias("used"), F.concat(state["of"], F.array(state["closed"])).alias("of"))

    start = F.struct(F.lit(0).alias("closed"), walk.alias("used"), F.array().cast("array<int>").alias("of"))
    runs = runs.withColumn("of", F.when(F.col("parts") > 1, F.aggregate("stops", start, fold, lambda s: s["of"])).otherwise(F.transform("stops", lambda s: F.lit(0))))
    runs = runs.withColumn("last", F.array_max("of")).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("last"))))
    stops = F.filter("stops", lambda s, i: F.get("of", i) == F.col("part"))
    suffix = F.when(F.col("last") > 0, F.concat(F.lit("/"), (F.col("part") + 1).cast("string"))).otherwise("")
    return runs.select(
        F.concat("span_id", F.lit("#"), "side", suffix).alias("blockface_id"),
        "span_id",
        "side",
        F.col("busy").alias("one_side_per_pass"),
        "highway",
        (F.col("length_m") / F.col("parts")).alias("length_m"),
        "off_network",
        stops.alias("stops"),
    )


def _off_network(stops: DataFrame, spans: DataFrame) -> DataFrame:
    """Stops away from any geometry of their street, by spatial cluster; a street without geometry counts as busy.

    Bucketed by normalised street, so that two spellings cannot give one id twice.
    """
    doors = stops.select("street_norm", "stop_id", "lat", "lon", "street", "number", "door_count", "doors", text.natural_key(F.col("number"))["n"].alias("k_n"))
    groups = spatial_clusters(doors, ["street_norm"], ["street", "k_n", "number", "stop_id"])
    streets = network.street_busyness(groups.select("street_norm").distinct(), spans)
    length = groups.groupBy("street_norm", "cluster").agg(_chain_length(F.array_sort(F.collect_list(_member()))).alias("length_m"))
    rows = groups.join(length, ["street_norm", "cluster"]).join(streets, "street_norm")
    return rows.withColumn("span_id", F.concat("street_norm", F.lit("~"), F.col("cluster").cast("string"))).withColumn("busy", F.coalesce("busy", F.lit(True))).withColumn("off_network", F.lit(True))


def measured(faces: DataFrame) -> DataFrame:
    """Adds what follows from the stops: street, doors, centroid, numbers, minutes, label."""
    n = F.size("stops")

    def mean(field: str) -> Column:
        return F.aggregate("stops", F.lit(0.0), lambda s, x: s + x[field]) / n

    faces = faces.withColumns(
        {
            "street": F.col("stops")[0]["street"],
            "stop_count": n,
            "door_count": F.aggregate("stops", F.lit(0), lambda s, x: s + x["door_count"]),
            "gated_candidates": F.size(F.filter("stops", lambda x: x["door_count"] >= 8)),
            "lat": mean("lat"),
            "lon": mean("lon"),
            "from_number": F.col("stops")[0]["number"],
            "to_number": F.element_at("stops", -1)["number"],
            "dwell_minutes": F.aggregate("stops", F.lit(0.0), lambda s, x: s + geo.dwell_seconds(x["door_count"])) / 60,
            "walk_minutes": geo.walk_minutes(F.col("length_m")),
        }
    )
    faces = faces.withColumn("minutes", F.col("dwell_minutes") + F.col("walk_minutes")).withColumn("street_norm", text.normalise_street(F.col("street")))
    return faces.withColumn("label", text.blockface_label(*(F.col(c) for c in ("street", "side", "from_number", "to_number", "door_count", "minutes"))))


def build_blockfaces(stops: DataFrame, edges: DataFrame, spans: DataFrame) -> DataFrame:
    """All faces with geometry: on their spans, and off network. Each stop is in exactly one."""
    at = network.stop_spans(stops, edges)
    own = stops.join(at.select("stop_id", "span_id"), "stop_id").join(spans.select("span_id", "busy", "highway", "length_m"), "span_id").withColumn("off_network", F.lit(False))
    away = _off_network(stops.join(at, "stop_id", "left_anti"), spans)
    columns = ["stop_id", "street", "number", "lat", "lon", "door_count", "doors", "span_id", "busy", "highway", "length_m", "off_network"]
    faces = split_by_side(own.select(*columns).unionByName(away.select(*columns)))
    faces = faces.join(spans.select("span_id", "path", "nodes"), "span_id", "left")
    none = F.array().cast(network.PATH)
    faces = faces.withColumns({"path": F.coalesce("path", none), "nodes": F.coalesce("nodes", F.array().cast("array<struct<y:bigint,x:bigint>>")), "clipped": F.lit(False)})
    return measured(faces)


def clip(faces: DataFrame, keep: DataFrame, scenario: list[str]) -> DataFrame:
    """Faces cut back to the stops to keep: keep has the scenario columns and stop_id. Faces that keep none are gone.

    Geometry and walking length shrink with the stops; nodes stay, since cutting
    a run changes nothing about which blocks adjoin.
    """
    pairs = faces.select("blockface_id", F.explode("stops.stop_id").alias("stop_id")).join(keep.select(*scenario, "stop_id").distinct(), "stop_id")
    kept = pairs.groupBy(*scenario, "blockface_id").agg(F.collect_set("stop_id").alias("kept"))
    base = ["blockface_id", "span_id", "side", "one_side_per_pass", "highway", "length_m", "off_network", "stops", "path", "nodes"]
    rows = kept.join(faces.select(*base), "blockface_id")
    rows = rows.withColumn("all", F.size("stops")).withColumn("stops", F.filter("stops", lambda s: F.array_contains("kept", s["stop_id"])))
    rows = rows.withColumn("clipped", F.size("stops") < F.col("all"))
    rows = rows.withColumn("path", F.when(F.col("clipped"), trimmed("path", "stops")).otherwise(F.col("path")))
    along = F.aggregate("path", F.lit(0.0), lambda s, chain: s + geo.line_length(chain))
    length = F.when(~F.col("clipped"), F.col("length_m")).when(F.size("path") > 0, along).otherwise(_chain_length(F.col("stops")))
    return measured(rows.withColumn("length_m", length).drop("all", "kept"))


def trimmed(path: str, stops: str) -> Column:
    """The path cut back to the stretch that the stops occupy."""

    @F.pandas_udf(network.PATH)
    def cut(paths: pd.Series, members: pd.Series) -> pd.Series:
        def one(chains, stops):
            found = kernels.trim([[(p["lat"], p["lon"]) for p in c] for c in chains], [(s["lat"], s["lon"]) for s in stops], FRONTAGE_M)
            return [[{"lat": p[0], "lon": p[1]} for p in c] for c in found]

        return pd.Series([one(c, s) for c, s in zip(paths, members, strict=True)])

    return cut(F.col(path), F.transform(stops, lambda s: F.struct(s["lat"].alias("lat"), s["lon"].alias("lon"))))


def shown() -> list[Column]:
    """The columns that a face shows, rounded."""
    rounded = {c: F.bround(c, 1) for c in ("length_m", "dwell_minutes", "walk_minutes", "minutes")}
    plain = ("street", "side", "label", "from_number", "to_number", "stop_count", "door_count", "gated_candidates", "one_side_per_pass", "highway")
    return [*[F.col(c) for c in plain], *[v.alias(k) for k, v in rounded.items()], F.col("off_network"), F.col("clipped")]


def payload(faces: DataFrame) -> DataFrame:
    """What a face shows, with its id."""
    return faces.select("blockface_id", *shown())
