"""Walking reach and shortest routes over batches of requests.

Only the edges that a request can use are dealt to it, by grid cells: for reach
those within the cutoff of the hub, for a route those inside an ellipse around
its ends. Each hub then runs one shortest-path search on its own edges; routes of
about the same size and place share theirs.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kerbside.functions import geo
from kerbside.operators import kernels, network
from kerbside.runtime import cut

CELL = 1e-2
#: Metres of the smallest class of routes (each is twice the one before), and the routes that share one copy of their edges.
CLASS_M, SHARED = 4000.0, 500
#: Landmarks of a graph on which more than so many routes are searched.
LANDMARKS, MANY = 4, 8
#: Rows of boxes that are sent to all tasks; more are dealt.
FEW_CELLS = 500_000
_SNAP = ["a_y", "a_x", "b_y", "b_x", "offset_m", "snap_lat", "snap_lon", "to_a_m", "to_b_m"]


def _edges_near(boxes: DataFrame, key: list[str], edges: DataFrame, size: float = CELL, few: bool = False) -> DataFrame:
    """Edges with both ends in a box (s, n, w, e), and others near it: key, a_y .. b_x, length, ends in degrees. An edge is held by the cell of its end a."""
    held = edges.withColumns({"cy": geo.cell(F.col("a_lat"), size), "cx": geo.cell(F.col("a_lon"), size)})
    dealt = boxes.withColumn("cy", F.explode(geo.cells_between(F.col("s"), F.col("n"), size))).withColumn("cx", F.explode(geo.cells_between(F.col("w"), F.col("e"), size)))
    return (F.broadcast(dealt) if few else dealt).join(held, ["cy", "cx"])


def reach(hubs: DataFrame, edges: DataFrame, snaps: DataFrame) -> DataFrame:
    """Doors within walking distance. hubs: hub_id, lat, lon, cutoff_m; snaps: door snaps keyed by osm_id.

    Returns hub_id, osm_id, walk_m. The search stops at the cutoff along the
    network; the offsets at both ends count in the final comparison.
    """
    start = network.edge_snaps(hubs, edges, ["hub_id"]).toDF("hub_id", *[f"h_{c}" for c in ("a_y", "a_x", "b_y", "b_x", "offset_m", "snap_lat", "snap_lon", "to_a_m", "to_b_m")])
    start = cut(hubs.join(start, "hub_id"))
    pad_y, pad_x = F.col("cutoff_m") * 1.01 / geo.DEGREE_M, F.col("cutoff_m") * 1.02 / geo.DEGREE_M / F.cos(F.radians(F.least(F.abs("h_snap_lat") + 0.1, F.lit(89.0))))
    boxes = start.select("hub_id", "cutoff_m", *[f"h_{c}" for c in ("a_y", "a_x", "b_y", "b_x", "to_a_m", "to_b_m")], (F.col("h_snap_lat") - pad_y).alias("s"), (F.col("h_snap_lat") + pad_y).alias("n"), (F.col("h_snap_lon") - pad_x).alias("w"), (F.col("h_snap_lon") + pad_x).alias("e"))
    near = _edges_near(boxes, ["hub_id"], edges.select("a_y", "a_x", "b_y", "b_x", "a_lat", "a_lon", "b_lat", "b_lon", "length_m"))
    near = near.select("hub_id", "cutoff_m", *[f"h_{c}" for c in ("a_y", "a_x", "b_y", "b_x", "to_a_m", "to_b_m")], "a_y", "a_x", "b_y", "b_x", "length_m")

    def search(group: pd.DataFrame) -> pd.DataFrame:
        h = group.iloc[0]
        first: dict = {}
        for n, d in (((h.h_a_y, h.h_a_x), h.h_to_a_m), ((h.h_b_y, h.h_b_x), h.h_to_b_m)):
            first[n] = min(d, first.get(n, math.inf))
        done, _ = kernels.shortest((((r.a_y, r.a_x), (r.b_y, r.b_x), r.length_m) for r in group.itertuples()), first, float(h.cutoff_m))
        return pd.DataFrame({"hub_id": h.hub_id, "y": [n[0] for n in done], "x": [n[1] for n in done], "d": list(done.values())})

    kind = hubs.schema["hub_id"].dataType.simpleString()
    dist = cut(near.groupBy("hub_id").applyInPandas(search, f"hub_id {kind}, y long, x long, d double"))
    # a door is reached over either end of its edge, or along the hub's own edge
    s = snaps.select("osm_id", *_SNAP)
    sides = [dist.join(s, (F.col("y") == F.col(f"{e}_y")) & (F.col("x") == F.col(f"{e}_x"))).select("hub_id", "osm_id", (F.col("d") + F.col(f"to_{e}_m") + F.col("offset_m")).alias("m")) for e in "ab"]
    same = start.join(s, (F.col("h_a_y") == F.col("a_y")) & (F.col("h_a_x") == F.col("a_x")) & (F.col("h_b_y") == F.col("b_y")) & (F.col("h_b_x") == F.col("b_x")))
    sides.append(same.select("hub_id", "osm_id", (F.abs(F.col("to_a_m") - F.col("h_to_a_m")) + F.col("offset_m")).alias("m")))
    best = sides[0].unionByName(sides[1]).unionByName(sides[2]).groupBy("hub_id", "osm_id").agg(F.min("m").alias("m"))
    best = best.join(start.select("hub_id", "cutoff_m", "h_offset_m"), "hub_id").withColumn("walk_m", F.col("m") + F.col("h_offset_m"))
    return best.where(F.col("walk_m") <= F.col("cutoff_m")).select("hub_id", "osm_id", "walk_m")


def connected(requests: DataFrame, labels: DataFrame) -> DataFrame:
    """Those snapped requests whose ends lie in one component of the graph: two equi-joins with the labels of the nodes."""
    found = requests
    for e in "ft":
        own = labels.toDF(f"{e}_node", f"{e}_component")
        found = found.join(own, network.node_number(F.col(f"{e}_a_y"), F.col(f"{e}_a_x")) == F.col(f"{e}_node"))
    return found.where("f_component = t_component").select(*requests.columns)


def routes(requests: DataFrame, edges: DataFrame, widen: float = 4.0, labels: DataFrame | None = None, points: bool = True) -> DataFrame:
    """requests: route_id, from_lat, from_lon, to_lat, to_lon. Shortest door-to-door walks.

    Returns route_id, distance_m, minutes, crow_m, detour, points (not if they are
    not asked for: a long way has very many); requests whose ends are off the
    network or not connected are left out. ``edges`` are read several times.

    A route of length L lies within the ellipse of points whose distances to both
    ends add up to L at most. So a route found among the edges around an ellipse of
    size B is shortest if it is no longer than B; if not, the request is tried again
    with its length, or if none is found, on a larger ellipse, until it holds all
    edges. Requests without a route on the first ellipse are looked up in ``labels``:
    those whose ends are not connected go no further. If none are given they are
    made, which takes longer than some more searches, for what is left after three
    ellipses, or for many after two.
    The first ellipse follows from the ends of the edges that the places lie on: a
    long edge must be left at one of them. Requests between the same two places are
    searched once; those whose ellipses are of one class of size, with their middles
    in one cell, share one copy of the edges around all of them.
    """
    places = ["from_lat", "from_lon", "to_lat", "to_lon"]
    asked = requests.select("route_id", *places)
    requests = cut(asked.groupBy(*places).agg(F.min("route_id").alias("route_id")))
    both = [requests.select("route_id", F.lit(e[0]).alias("side"), F.col(f"{e}_lat").alias("lat"), F.col(f"{e}_lon").alias("lon")) for e in ("from", "to")]
    snaps = cut(network.edge_snaps(both[0].unionByName(both[1]), edges, ["route_id", "side"]))
    ends = [snaps.where(F.col("side") == e).select("route_id", *[F.col(c).alias(f"{e}_{c}") for c in _SNAP]) for e in "ft"]
    crow = geo.haversine(*(F.col(c) for c in ("from_lat", "from_lon", "to_lat", "to_lon")))
    left = requests.withColumn("crow_m", crow).join(ends[0], "route_id").join(ends[1], "route_id")

    def over(f: str, t: str) -> Column:
        """The least that a route takes over these ends of its first and last edge."""
        at = [geo.degrees_of(F.col(c)) for c in (f"f_{f}_y", f"f_{f}_x", f"t_{t}_y", f"t_{t}_x")]
        return F.col(f"f_to_{f}_m") + geo.haversine(*at) + F.col(f"t_to_{t}_m")

    same = F.lit(True)
    for c in ("a_y", "a_x", "b_y", "b_x"):
        same = same & (F.col(f"f_{c}") == F.col(f"t_{c}"))
    least = F.least(*[over(f, t) for f in "ab" for t in "ab"], F.when(same, F.abs(F.col("f_to_a_m") - F.col("t_to_a_m"))))
    left = cut(left.withColumn("bound", F.lit(1.5) * least + 1000))
    extent = edges.agg(F.min(F.least("a_lat", "b_lat")).alias("s"), F.max(F.greatest("a_lat", "b_lat")).alias("n"), F.min(F.least("a_lon", "b_lon")).alias("w"), F.max(F.greatest("a_lon", "b_lon")).alias("e")).first()
    if extent["s"] is None:
        whole = 0.0
    else:
        whole = 4 * float(kernels.haversine(extent["s"], extent["w"], extent["n"], extent["e"])) + 4000
    slim = edges.select(network.node_number(F.col("a_y"), F.col("a_x")).alias("a"), network.node_number(F.col("b_y"), F.col("b_x")).alias("b"), "a_lat", "a_lon", "b_lat", "b_lon", "length_m")
    kind = requests.schema["route_id"].dataType.simpleString()
    carried = [F.col("route_id"), *[network.node_number(F.col(f"{e}_y"), F.col(f"{e}_x")).alias(e) for e in ("f_a", "f_b", "t_a", "t_b")], "f_to_a_m", "f_to_b_m", "t_to_a_m", "t_to_b_m"]

    def search(request: pa.Table, group: pa.Table) -> pa.Table:
        rows = request.to_pylist()
        kept = np.concatenate([request[c].to_numpy() for c in ("f_a", "f_b", "t_a", "t_b")])
        roads = kernels.Roads(*(group[c].to_numpy() for c in ("a", "b", "length_m")), kept)
        number = {n: roads.number(n) for n in np.unique(kept).tolist()}
        known = [n for n in number.values() if n is not None]
        if known and len(rows) > MANY:
            roads.mark(known[0], LANDMARKS)
        metres, ways = [], []
        for h in rows:
            some: list[dict] = [{}, {}]
            for at, e in zip(some, "ft", strict=True):
                for end in "ab":
                    n, d = number[h[f"{e}_{end}"]], h[f"{e}_to_{end}_m"]
                    if n is not None:
                        at[n] = min(d, at.get(n, math.inf))
            length, first, way = roads.search(*some)
            via = []
            if (h["f_a"], h["f_b"]) == (h["t_a"], h["t_b"]) and abs(h["f_to_a_m"] - h["t_to_a_m"]) <= length:
                length = abs(h["f_to_a_m"] - h["t_to_a_m"])
            elif points and length < math.inf:
                via = roads.points(first, way)
            metres.append(length)
            ways.append([{"y": (n >> 32) - 900_000_000, "x": (n & ((1 << 32) - 1)) - 1_800_000_000} for n in via])
        return pa.table([request["route_id"], pa.array(metres, pa.float64()), pa.array(ways, pa.list_(pa.struct([("y", pa.int64()), ("x", pa.int64())])))], names=["route_id", "network_m", "via"])

    found, tries, labelled = None, 0, False
    while whole and not left.isEmpty():
        tries += 1
        lost = F.col("network_m") == float("inf")
        if tries > 1 and not labelled:
            n = left.where(lost).count()
            labelled = n > 0 and (labels is not None or tries > 3 or (tries > 2 and n > SHARED))
            if labelled:
                left = cut(left.where(~lost).unionByName(connected(left.where(lost), labels if labels is not None else network.labels(edges))))
        left = left.drop("network_m")
        span = F.col("bound") / 2
        mid_lat, mid_lon = (F.col("f_snap_lat") + F.col("t_snap_lat")) / 2, (F.col("f_snap_lon") + F.col("t_snap_lon")) / 2
        pad_y = span * 1.01 / geo.DEGREE_M + 1e-6
        pad_x = span * 1.02 / geo.DEGREE_M / F.cos(F.radians(F.least(F.abs(mid_lat) + pad_y, F.lit(89.0)))) + 1e-6
        k = F.greatest(F.lit(0), F.ceil(F.log2(F.col("bound") / CLASS_M))).cast("int")
        cell = F.pow(F.lit(2.0), F.col("k")) * (CLASS_M / 2 / geo.DEGREE_M)
        each = left.select(*carried, k.alias("k"), (mid_lat - pad_y).alias("s"), (mid_lat + pad_y).alias("n"), (mid_lon - pad_x).alias("w"), (mid_lon + pad_x).alias("e"), mid_lat.alias("y"), mid_lon.alias("x"))
        each = each.withColumns({"gy": F.floor(F.col("y") / cell), "gx": F.floor(F.col("x") / cell)}).drop("y", "x")
        part = F.floor((F.row_number().over(Window.partitionBy("k", "gy", "gx").orderBy("route_id")) - 1) / SHARED).cast("int")
        each = cut(each.withColumn("part", part))
        group = ["k", "gy", "gx", "part"]
        box = [f(c).alias(c) for c, f in (("s", F.min), ("n", F.max), ("w", F.min), ("e", F.max))]
        others = [f"of_{c}" for c in group]
        boxes = each.groupBy(*[F.col(c).alias(o) for c, o in zip(group, others, strict=True)]).agg(*box)
        boxes = boxes.withColumns({"s": F.greatest("s", F.lit(extent["s"])), "n": F.least("n", F.lit(extent["n"])), "w": F.greatest("w", F.lit(extent["w"])), "e": F.least("e", F.lit(extent["e"]))})
        boxes = cut(boxes.where("s <= n and w <= e"))
        near = None
        for size, count in sorted(boxes.groupBy("of_k").count().collect()):
            # cells of the size of a box: a few of them cover it
            beside = _edges_near(boxes.where(F.col("of_k") == size), others, slim, 2.0**size * CLASS_M / geo.DEGREE_M, count * 16 <= FEW_CELLS)
            near = beside if near is None else near.unionByName(beside)
        if near is None:
            near = boxes.limit(0).crossJoin(slim.limit(0))
        inside = [F.col(f"{e}_{c}").between(F.col(low) - 1e-6, F.col(high) + 1e-6) for e in "ab" for c, low, high in (("lat", "s", "n"), ("lon", "w", "e"))]
        near = near.where(inside[0] & inside[1] & inside[2] & inside[3]).select(*others, "a", "b", "length_m")
        tried = each.groupBy(*group).cogroup(near.groupBy(*others)).applyInArrow(search, f"route_id {kind}, network_m double, via array<struct<y:bigint,x:bigint>>")
        tried = cut(left.join(tried, "route_id"))
        done = tried.where((F.col("network_m") <= F.col("bound")) & (F.col("network_m") < float("inf")))
        found = done if found is None else found.unionByName(done)
        again = F.when(F.col("network_m") < float("inf"), F.col("network_m") + 1e-3).otherwise(F.col("bound") * widen)
        left = cut(tried.where((F.col("network_m") > F.col("bound")) & ((F.col("bound") < whole) | (F.col("network_m") < float("inf")))).withColumn("bound", again).drop("via"))
    if found is None:
        found = left.limit(0).withColumn("network_m", F.lit(0.0)).withColumn("via", F.array().cast("array<struct<y:bigint,x:bigint>>"))

    def point(lat, lon):
        return F.struct(lat.alias("lat"), lon.alias("lon"))

    via = F.transform("via", lambda n: F.struct(geo.degrees_of(n["y"]).alias("lat"), geo.degrees_of(n["x"]).alias("lon")))
    line = F.concat(F.array(point(F.col("from_lat"), F.col("from_lon")), point(F.col("f_snap_lat"), F.col("f_snap_lon"))), via, F.array(point(F.col("t_snap_lat"), F.col("t_snap_lon")), point(F.col("to_lat"), F.col("to_lon"))))
    rows = found.withColumn("distance_m", F.col("f_offset_m") + F.col("network_m") + F.col("t_offset_m"))
    detour = F.when(F.col("crow_m") > 1, F.bround(F.col("distance_m") / F.col("crow_m"), 2)).otherwise(F.lit(1.0))
    given = ["distance_m", "minutes", "crow_m", "detour", *(["points"] if points else [])]
    rows = rows.withColumns({"minutes": geo.walk_minutes(F.col("distance_m")), "detour": detour, "points": line}).select(*places, *given)
    return asked.join(rows, places).select("route_id", *given)
