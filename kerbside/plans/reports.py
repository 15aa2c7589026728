"""Reports: hub previews over many hubs at once, district coverage, effort."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kerbside.functions import geo, text
from kerbside.operators import blockfaces, geocode, routing
from kerbside.runtime import cut

RADIUS = (50.0, 3000.0)
CELL = 1e-2


def checked_radius(rows: DataFrame) -> DataFrame:
    """Fails on a radius_m out of RADIUS when it is read."""
    low, high = RADIUS
    wrong = F.raise_error(F.concat(F.lit(f"radius_m must be from {low} to {high}, not "), F.col("radius_m").cast("string"))).cast("double")
    return rows.withColumn("radius_m", F.when(F.col("radius_m").between(low, high), F.col("radius_m").cast("double")).otherwise(wrong))


def totals(rows: DataFrame, minutes: Column) -> DataFrame:
    """What a page adds up to: rows, doors, minutes."""
    return rows.agg(F.count("*").alias("rows"), F.coalesce(F.sum("door_count"), F.lit(0)).alias("doors"), F.bround(F.coalesce(F.sum(minutes), F.lit(0.0)), 1).alias("minutes"))


def effort_columns(doors: Column, session_minutes: int = 180, seconds_per_door: int = 75, overhead: float = 0.35) -> list[Column]:
    """Doors that a pair knocks in a session, and sessions for all of them."""
    per = max(1, int(session_minutes * (1 - overhead) * 60 / seconds_per_door))
    return [F.lit(per).alias("doors_per_pair_session"), F.bround(doors / F.lit(per), 1).alias("pair_sessions")]


def within(hubs: DataFrame, points: DataFrame, columns: list[str]) -> DataFrame:
    """Points within each hub's radius as the crow flies. hubs: hub_id, lat, lon, radius_m.

    A hub is dealt to the cells that its circle's box reaches; an equi-join on
    cells, then the exact distance.
    """
    pad_y = F.col("radius_m") * 1.01 / geo.DEGREE_M
    pad_x = F.col("radius_m") * 1.02 / geo.DEGREE_M / F.cos(F.radians(F.least(F.abs("h_lat") + 0.1, F.lit(89.0))))
    h = hubs.select("hub_id", F.col("lat").alias("h_lat"), F.col("lon").alias("h_lon"), "radius_m")
    h = h.withColumn("cy", F.explode(geo.cells_between(F.col("h_lat") - pad_y, F.col("h_lat") + pad_y, CELL))).withColumn("cx", F.explode(geo.cells_between(F.col("h_lon") - pad_x, F.col("h_lon") + pad_x, CELL)))
    p = points.select(*columns, F.col("lat").alias("p_lat"), F.col("lon").alias("p_lon"), geo.cell(F.col("lat"), CELL).alias("cy"), geo.cell(F.col("lon"), CELL).alias("cx"))
    distance = geo.haversine(F.col("h_lat"), F.col("h_lon"), F.col("p_lat"), F.col("p_lon"))
    return h.join(p, ["cy", "cx"]).withColumn("distance_m", distance).where(F.col("distance_m") <= F.col("radius_m")).select("hub_id", *columns, "distance_m")


def hub_preview_crow(hubs: DataFrame, addresses: DataFrame, stops: DataFrame) -> DataFrame:
    """Workload within each hub's circle: doors, streets, stops, knocking seconds, nearest address, effort."""
    doors = within(hubs, addresses, ["osm_id", "street"]).groupBy("hub_id").agg(F.count("*").alias("doors_within"), F.count_distinct("street").alias("streets_within"))
    places = within(hubs, stops, ["stop_id", "door_count"]).groupBy("hub_id").agg(F.count("*").alias("stops_within"), F.sum(geo.dwell_seconds(F.col("door_count"))).alias("knock_seconds"))
    near = geocode.reverse(hubs.select(F.col("hub_id").alias("pid"), "lat", "lon"), addresses).select(F.col("pid").alias("hub_id"), F.col("label").alias("nearest_address"))
    rows = hubs.join(doors, "hub_id", "left").join(places, "hub_id", "left").join(near, "hub_id", "left")
    counts = [F.coalesce(c, F.lit(0)).alias(c) for c in ("doors_within", "streets_within", "stops_within")]
    return rows.select("hub_id", "lat", "lon", "radius_m", *counts, F.coalesce("knock_seconds", F.lit(0.0)).alias("knock_seconds"), "nearest_address", *effort_columns(F.coalesce("doors_within", F.lit(0))))


def hub_preview_walk(hubs: DataFrame, addresses: DataFrame, stops: DataFrame, faces: DataFrame, edges: DataFrame, snaps: DataFrame) -> DataFrame:
    """The same on foot: what is within the radius as walking distance."""
    reached = routing.reach(hubs.select("hub_id", "lat", "lon", F.col("radius_m").alias("cutoff_m")), edges, snaps)
    doors = reached.join(addresses.select("osm_id", "street"), "osm_id").groupBy("hub_id").agg(F.count("*").alias("doors_within"), F.count_distinct("street").alias("streets_within"), F.max("walk_m").alias("farthest_m"))
    bridge = stops.select("stop_id", "door_count", F.explode("doors.osm_id").alias("osm_id"))
    places = reached.join(bridge, "osm_id").select("hub_id", "stop_id", "door_count").distinct()
    sums = places.groupBy("hub_id").agg(F.count("*").alias("stops_within"), F.sum(geo.dwell_seconds(F.col("door_count"))).alias("knock_seconds"))
    touched = faces.select("blockface_id", F.explode("stops.stop_id").alias("stop_id")).join(places.select("hub_id", "stop_id"), "stop_id").groupBy("hub_id").agg(F.count_distinct("blockface_id").alias("blockfaces_within"))
    rows = hubs.select("hub_id").join(doors, "hub_id", "left").join(sums, "hub_id", "left").join(touched, "hub_id", "left")
    counts = [F.coalesce(c, F.lit(0)).alias(c) for c in ("doors_within", "stops_within", "streets_within", "blockfaces_within")]
    return rows.select("hub_id", *counts, F.bround(F.coalesce("knock_seconds", F.lit(0.0)) / 3600, 1).alias("knock_hours"), F.bround(geo.walk_minutes(F.coalesce("farthest_m", F.lit(0.0))), 1).alias("minutes_to_farthest"))


def session_faces(faces: DataFrame, hubs: DataFrame, stops: DataFrame, key: str = "scenario_id") -> DataFrame:
    """Each hub's faces, cut back to the stops within its circle."""
    inside = within(hubs, stops, ["stop_id"]).select(F.col("hub_id").alias(key), "stop_id")
    return blockfaces.clip(faces, inside, [key])


def coverage(addresses: DataFrame, ways: DataFrame, rings: DataFrame, stops: DataFrame, faces: DataFrame) -> DataFrame:
    """One row about a district: counts, histogram, largest stops, top streets, hours, ways by class, extent, effort."""
    d = addresses.agg(
        F.count("*").alias("doors"),
        F.count_distinct("street").alias("streets"),
        F.count_if(F.coalesce("unit", F.lit("")) != "").alias("doors_with_unit"),
        F.count_if(F.coalesce("street", F.lit("")) == "").alias("addresses_missing_street"),
    )
    s = stops.agg(
        F.count("*").alias("stops"),
        F.count_if(F.col("door_count") > 1).alias("multi_unit_stops"),
        F.count_if(F.col("door_count") >= 8).alias("gated_complex_candidates"),
        F.bround(F.sum(geo.dwell_seconds(F.col("door_count"))) / 3600, 1).alias("knock_hours"),
        F.bround(F.sum(geo.dwell_seconds(F.col("door_count"), None)) / 3600, 1).alias("uncapped_knock_hours"),
    )
    b = faces.agg(F.count("*").alias("blockfaces"), F.count_if("one_side_per_pass").alias("blockfaces_one_side_per_pass"), F.count_if("off_network").alias("blockfaces_off_network"))

    def listed(rows: DataFrame, order: list[str], name: str) -> DataFrame:
        return rows.agg(F.array_sort(F.collect_list(F.struct(*order))).alias(name))

    histogram = listed(stops.groupBy("door_count").agg(F.count("*").alias("stops")), ["door_count", "stops"], "cluster_histogram")
    largest = stops.orderBy(F.desc("door_count"), "street", text.natural_key(F.col("number")), "stop_id").limit(8)
    largest = listed(largest.select((-F.col("door_count")).alias("o"), "street", "number"), ["o", "street", "number"], "largest_stops")
    top = addresses.groupBy("street").agg(F.count("*").alias("doors"), F.min("ord").alias("first")).orderBy(F.desc("doors"), "first").limit(10)
    top = listed(top.select((-F.col("doors")).alias("o"), "first", "street"), ["o", "first", "street"], "top_streets")
    classes = listed(ways.groupBy(F.coalesce(F.try_element_at("tags", F.lit("highway")), F.lit("")).alias("highway")).agg((-F.count("*")).alias("o")), ["o", "highway"], "walkable_ways")
    box = rings.select(F.explode("ring").alias("p")).agg(F.min("p.lat").alias("south"), F.min("p.lon").alias("west"), F.max("p.lat").alias("north"), F.max("p.lon").alias("east"))
    r = rings.agg(F.count("*").alias("boundary_rings"), F.count_if(geo.ring_is_closed(F.col("ring"))).alias("boundary_closed_rings"))
    rows = d.crossJoin(s).crossJoin(b).crossJoin(histogram).crossJoin(largest).crossJoin(top).crossJoin(classes).crossJoin(box).crossJoin(r)
    km = [F.bround(geo.haversine(F.col("south"), F.col("west"), *e) / 1000, 1) for e in ((F.col("north"), F.col("west")), (F.col("south"), F.col("east")))]
    return rows.withColumns({"extent_km_ns": km[0], "extent_km_ew": km[1]}).withColumns(
        {
            "largest_stops": F.transform("largest_stops", lambda x: F.struct(x["street"].alias("street"), x["number"].alias("number"), (-x["o"]).alias("doors"))),
            "top_streets": F.transform("top_streets", lambda x: F.struct(x["street"].alias("street"), (-x["o"]).alias("doors"))),
            "walkable_ways": F.transform("walkable_ways", lambda x: F.struct(x["highway"].alias("highway"), (-x["o"]).alias("ways"))),
            "doors_per_pair_session": effort_columns(F.col("doors"))[0],
            "pair_sessions": effort_columns(F.col("doors"))[1],
        }
    )


def in_box(df: DataFrame, box: tuple[float, float, float, float] | str | None) -> DataFrame:
    """Rows with lat, lon inside south, west, north, east, borders included. Reaches a Parquet scan."""
    if box is None:
        return df
    south, west, north, east = parse_box(box) if isinstance(box, str) else box
    return df.where(F.col("lat").between(south, north) & F.col("lon").between(west, east))


def sizes(df: DataFrame, value: str, by: list[str] = ()) -> DataFrame:
    """Least, upper median (of an even number of values the larger middle one) and most of a column, per group if asked for."""
    middle = F.expr(f"percentile_disc(0.5) WITHIN GROUP (ORDER BY `{value}` DESC)")
    return df.groupBy(*by).agg(F.min(value).alias("least"), middle.alias("upper_median"), F.max(value).alias("most"))


def parse_box(box: str) -> tuple[float, float, float, float]:
    try:
        south, west, north, east = map(float, box.split(","))
    except ValueError as e:
        raise ValueError("a box is south,west,north,east") from e
    return south, west, north, east


def page(df: DataFrame, order: list, limit: int, most: int) -> tuple[DataFrame, bool]:
    """The first rows in order, and whether there are more."""
    if not 1 <= limit <= most:
        raise ValueError(f"limit must be from 1 to {most}")
    first = cut(df.orderBy(*order).limit(limit + 1))  # one run for the rows and the flag
    return first.orderBy(*order).limit(limit), first.count() > limit
