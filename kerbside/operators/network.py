"""The street network: walkable edges, intersections, spans between them, and nearest-edge joins.

Nodes are whole numbers of 1e-7 degrees, so that ways meet exactly where they
share a node. Nearest-edge joins deal edges and points to tiles: an edge to every
tile it crosses when padded by the largest offset allowed, a point to its own.
Tiles are large, as a long edge is dealt to all along it, and are divided where
points crowd; inside one, boxes of points are halved with the edges near them.
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kerbside.functions import geo, text
from kerbside.operators import kernels
from kerbside.operators.components import components
from kerbside.runtime import cut

SNAP_M = 300.0
CELL = 4e-3
#: Degrees of the largest tiles, the points above which one is divided (by four each way), and the number of sizes.
TILE, TILE_POINTS, TILE_SIZES = 0.2, 20_000, 4
#: Edges of which one task finds the connected components; more are spread over tasks in rounds.
FEW_EDGES = 100_000
#: Metres within which the small cells answer.
NEAR_M, NEAR_CELL = 60.0, 8e-4
#: More segments than any way has.
WAY_SEGMENTS = 1 << 20
# Road classes, lanes and speed from which a road counts as busy.
BUSY_CLASSES = ("trunk", "trunk_link", "primary", "primary_link", "secondary", "secondary_link")
BUSY_LANES, BUSY_KMH = 4, 60
PATH = "array<array<struct<lat:double,lon:double>>>"
_ENDS = ("a_lat", "a_lon", "b_lat", "b_lon")


def tag(name: str) -> Column:
    return F.try_element_at("tags", F.lit(name))


def is_walkable() -> Column:
    """foot decides where it is yes or no; else access must not be private or no."""
    foot, access = F.coalesce(tag("foot"), F.lit("")), F.coalesce(tag("access"), F.lit(""))
    return F.when(foot == "no", False).when(foot.isin("yes", "designated", "permissive"), True).otherwise(~access.isin("private", "no"))


def is_busy() -> Column:
    return F.coalesce(tag("highway"), F.lit("")).isin(*BUSY_CLASSES) | F.coalesce(text.speed_or_lanes(tag("lanes")) >= BUSY_LANES, F.lit(False)) | F.coalesce(text.speed_or_lanes(tag("maxspeed")) >= BUSY_KMH, F.lit(False))


def busiest(highway: str = "highway") -> Column:
    """The class of a group that governs crossing: busy ones first, then by name; empty for none."""
    h = F.col(highway)
    return F.coalesce(F.max_by(h, F.struct(h.isin(*BUSY_CLASSES), h)), F.lit(""))


def segments(ways: DataFrame) -> DataFrame:
    """One row per segment of a way whose rounded ends differ: way and segment order, node numbers, tags of use."""
    rows = ways.select("ord", "osm_id", F.coalesce(tag("name"), F.lit("")).alias("name"), F.coalesce(tag("highway"), F.lit("")).alias("highway"), is_busy().alias("busy"), is_walkable().alias("walkable"), F.posexplode(geo.segments(F.col("geometry"))).alias("seg", "s"))
    ends = {f"{e}_{k}": geo.node(F.col(f"s.{e}.{f}")) for e in "ab" for k, f in (("y", "lat"), ("x", "lon"))}
    return rows.withColumns(ends).drop("s").where("a_y <> b_y or a_x <> b_x")


def with_degrees(df: DataFrame) -> DataFrame:
    """Adds a_lat, a_lon, b_lat, b_lon from the node numbers."""
    return df.withColumns({f"{e}_{f}": geo.degrees_of(F.col(f"{e}_{k}")) for e in "ab" for k, f in (("y", "lat"), ("x", "lon"))})


def walk_edges(ways: DataFrame) -> DataFrame:
    """The walking graph: each undirected edge once, the lower node first, with its length."""
    s = segments(ways).where("walkable")
    a, b = F.struct(F.col("a_y").alias("y"), F.col("a_x").alias("x")), F.struct(F.col("b_y").alias("y"), F.col("b_x").alias("x"))
    e = s.select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b")).distinct()
    e = with_degrees(e.select(F.col("a.y").alias("a_y"), F.col("a.x").alias("a_x"), F.col("b.y").alias("b_y"), F.col("b.x").alias("b_x")))
    return e.withColumn("length_m", geo.haversine(*(F.col(c) for c in ("a_lat", "a_lon", "b_lat", "b_lon"))))


def labels(edges: DataFrame) -> DataFrame:
    """node (as of node_number) and component of the walking graph, for every node: two nodes are connected if their components are equal."""
    return components(edges.select(*[node_number(F.col(f"{e}_y"), F.col(f"{e}_x")).alias(e) for e in "ab"]), local=FEW_EDGES)


def graph_counts(edges: DataFrame) -> DataFrame:
    ends = edges.select(F.col("a_y").alias("y"), F.col("a_x").alias("x")).unionByName(edges.select(F.col("b_y").alias("y"), F.col("b_x").alias("x")))
    return ends.agg(F.count_distinct("y", "x").alias("nodes")).crossJoin(edges.agg(F.count("*").alias("edges")))


def named(ways: DataFrame) -> DataFrame:
    return ways.where((F.coalesce(tag("name"), F.lit("")) != "") & is_walkable())


def intersections(ways: DataFrame, street: Callable[[Column], Column] = text.normalise_street) -> DataFrame:
    """Nodes shared by streets of different names, as ``street`` tells them apart."""
    points = named(ways).select(street(tag("name")).alias("street_norm"), F.explode("geometry").alias("p"))
    return points.select("street_norm", geo.node(F.col("p.lat")).alias("y"), geo.node(F.col("p.lon")).alias("x")).groupBy("y", "x").agg(F.count_distinct("street_norm").alias("streets")).where("streets > 1")


def node_number(y: Column, x: Column) -> Column:
    """A node as one whole number, in the order of its latitude and then longitude."""
    return (y + 900_000_000) * (1 << 32) + (x + 1_800_000_000)


@F.pandas_udf(T.StringType())
def _five_digits(y: pd.Series, x: pd.Series) -> pd.Series:
    """Node coordinates as text, rounded from their exact binary values."""
    return pd.Series([f"{p / 1e7:.5f},{q / 1e7:.5f}" for p, q in zip(y, x, strict=True)], dtype=object)


def span_edges(ways: DataFrame, street: Callable[[Column], Column] = text.normalise_street) -> DataFrame:
    """Every segment of a named street with the span it belongs to: a maximal run between intersections.

    An unbroken node is on one street only, so spans are the connected components
    of the unbroken nodes, whatever the street's length; a segment between two
    intersections is one by itself. ``edge_ord`` is the place in the extract (way,
    then segment), ``span_ord`` orders the spans of a street: by their lowest
    segment, then by the first. An id is made of the street and the lowest node;
    spans that share it are numbered. ``street`` makes the key of a street of its
    name. Normalised names take four digits for a postcode: where streets are told
    apart by such numbers alone, another key is needed.
    """
    breaks = intersections(ways, street).select("y", "x", F.lit(True).alias("broken"))
    s = segments(named(ways)).withColumn("street_norm", street(F.col("name")))
    for e in "ab":
        s = s.join(breaks.toDF(f"{e}_y", f"{e}_x", f"{e}_break"), [f"{e}_y", f"{e}_x"], "left").withColumn(e, node_number(F.col(f"{e}_y"), F.col(f"{e}_x")))
        s = s.withColumn(f"{e}_run", F.when(F.col(f"{e}_break").isNull(), F.col(e)))
    place = (F.col("ord") * WAY_SEGMENTS + F.col("seg")).alias("edge_ord")
    s = cut(s.select("street_norm", place, "osm_id", "highway", "busy", "a_y", "a_x", "b_y", "b_x", F.least("a", "b").alias("low"), F.greatest("a", "b").alias("high"), "a_run", "b_run"))
    roots = components(s.where("a_run is not null and b_run is not null").select("a_run", "b_run"), local=FEW_EDGES)
    # a segment belongs to the run of an unbroken end, or stands alone
    s = s.withColumn("end", F.coalesce("a_run", "b_run")).join(roots.toDF("end", "root"), "end", "left")
    s = s.withColumn("run", F.struct(F.coalesce("root", "end").alias("node"), F.when(F.col("end").isNull(), F.col("edge_ord")).alias("edge"))).drop("end", "root", "a_run", "b_run")
    s = cut(s)
    runs = s.groupBy("street_norm", "run").agg(F.min(F.struct("low", "high", "edge_ord")).alias("first"), F.min("edge_ord").alias("edge")).select("street_norm", "run", F.struct("first.low", "first.high", "edge").alias("span_ord"))
    lowest = F.col("span_ord.low")
    y, x = F.shiftright(lowest, 32) - 900_000_000, lowest.bitwiseAND(F.lit((1 << 32) - 1)) - 1_800_000_000
    base = F.concat("street_norm", F.lit("@"), _five_digits(y, x))
    nth = F.row_number().over(Window.partitionBy("base").orderBy("span_ord"))
    runs = runs.withColumn("base", base).withColumn("nth", nth).select(F.col("street_norm").alias("street"), F.col("run").alias("of"), "span_ord", F.when(F.col("nth") == 1, F.col("base")).otherwise(F.concat("base", F.lit("+"), F.col("nth").cast("string"))).alias("span_id"))
    found = s.join(runs, (F.col("street_norm") == F.col("street")) & F.col("run").eqNullSafe(F.col("of")))
    return with_degrees(found.select("street_norm", "osm_id", "highway", "busy", "a_y", "a_x", "b_y", "b_x", "edge_ord", "span_ord", "span_id"))


def spans(edges: DataFrame) -> DataFrame:
    """One row per span: length (repeated segments count), busiest class, busy, edges, ways in the order they are first used, path (chains of points), nodes."""
    step = geo.haversine(*(F.col(c) for c in ("a_lat", "a_lon", "b_lat", "b_lon")))
    rows = edges.groupBy("street_norm", "span_id", "span_ord").agg(
        F.sum(step).alias("length_m"),
        busiest().alias("highway"),
        F.bool_or("busy").alias("busy"),
        F.count("*").cast("int").alias("edge_count"),
        F.transform(F.array_sort(F.collect_list(F.struct("edge_ord", "a_lat", "a_lon", "b_lat", "b_lon"))), lambda e: F.array(F.struct(e["a_lat"].alias("lat"), e["a_lon"].alias("lon")), F.struct(e["b_lat"].alias("lat"), e["b_lon"].alias("lon")))).alias("lines"),
        F.array_distinct(F.transform(F.array_sort(F.collect_list(F.struct("edge_ord", "osm_id"))), lambda e: e["osm_id"])).alias("way_ids"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list(F.array(F.struct(F.col("a_y").alias("y"), F.col("a_x").alias("x")), F.struct(F.col("b_y").alias("y"), F.col("b_x").alias("x"))))))).alias("nodes"),
    )
    return rows.withColumn("path", chained("lines")).drop("lines")


def street_busyness(streets: DataFrame, spans: DataFrame) -> DataFrame:
    """streets: street_norm. Adds busy and highway of the whole street: busy if any of its spans is, null (and no class) if it has none."""
    own = spans.groupBy("street_norm").agg(F.bool_or("busy").alias("busy"), busiest().alias("highway"))
    return streets.join(own, "street_norm", "left").withColumn("highway", F.coalesce("highway", F.lit("")))


def chained(lines: str) -> Column:
    """Lines of points stitched end to end."""

    @F.pandas_udf(PATH)
    def stitch(column: pd.Series) -> pd.Series:
        def key(p):
            return round(p[0], 7), round(p[1], 7)

        return column.map(lambda rows: [[{"lat": p[0], "lon": p[1]} for p in chain] for chain in kernels.chains([[(p["lat"], p["lon"]) for p in line] for line in rows], key)])

    return stitch(lines)


def nearest_edge(points: DataFrame, edges: DataFrame, id_columns: list[str], order: list[str], keep: list[str], same: list[str] = (), metres: float = SNAP_M) -> DataFrame:
    """For each point its nearest edge within so many metres: id columns, ``keep`` of the edge, offset_m, snap_lat, snap_lon.

    points: id columns, lat, lon (and ``same``); edges: a_lat ... b_lon, ``keep``,
    ``order``. ``same`` are columns that must be equal too; ``order`` settles ties.

    Without ``same``, the edges of a tile are thinned out on the way to each point,
    and those that are left are compared exactly. With it, the search grows: in
    small cells every edge within ``NEAR_M`` of a point meets it, which answers
    nearly all points; only the rest look through large ones.
    """
    points = points.select(*id_columns, *[s for s in same if s not in id_columns], "lat", "lon")
    if not same:
        taken = list(dict.fromkeys([*keep, *order, *_ENDS]))
        return _best(_pairs_in_tiles(points, edges.select(*taken), metres), id_columns, order, keep, taken, metres)
    if metres <= NEAR_M:
        return _nearest_in_cells(points, edges, id_columns, order, keep, same, metres, NEAR_CELL)
    close = cut(_nearest_in_cells(points, edges, id_columns, order, keep, same, NEAR_M, NEAR_CELL))
    rest = points.join(close.select(*id_columns), id_columns, "left_anti")
    return close.unionByName(_nearest_in_cells(rest, edges, id_columns, order, keep, same, metres, CELL))


def _dealt(edges: DataFrame, metres: float, size: float) -> DataFrame:
    """Each edge to the cells (cy, cx) that come within so many metres of it."""
    dealt = edges.withColumn("cy", F.explode(geo.cells_between(F.least("a_lat", "b_lat") - geo.pad_lat(metres), F.greatest("a_lat", "b_lat") + geo.pad_lat(metres), size)))
    # of each row of cells those that the edge crosses there: the box of a long slanting edge holds far more
    slack, rise = geo.pad_lat(metres), F.col("b_lat") - F.col("a_lat")
    shares = [F.greatest(F.lit(0.0), F.least(F.lit(1.0), (edge - F.col("a_lat")) / F.nullif(rise, F.lit(0.0)))) for edge in (F.col("cy") * size - slack - 1e-9, (F.col("cy") + 1) * size + slack + 1e-9)]
    crossed = [F.when(F.abs(rise) < 1e-7, F.col(end)).otherwise(F.col("a_lon") + share * (F.col("b_lon") - F.col("a_lon"))) for end, share in zip(("a_lon", "b_lon"), shares, strict=True)]
    pad = geo.pad_lon(metres, F.greatest(F.abs("a_lat"), F.abs("b_lat"))) + 1e-9
    return dealt.withColumn("cx", F.explode(geo.cells_between(F.least(*crossed) - pad, F.greatest(*crossed) + pad, size)))


def _pairs_in_tiles(points: DataFrame, edges: DataFrame, metres: float) -> DataFrame:
    """Points with the edges that may be their nearest within so many metres; all nearest ones are among them."""
    finest = TILE / 4 ** (TILE_SIZES - 1)
    own = points.withColumns({"cy": geo.cell(F.col("lat"), finest), "cx": geo.cell(F.col("lon"), finest)})

    def tile(k: int) -> list[Column]:
        return [F.shiftright(c, 2 * (TILE_SIZES - 1 - k)) for c in ("cy", "cx")]

    # the largest tile around a cell that holds few enough points
    filled = own.groupBy("cy", "cx").agg(F.count("*").alias("n"))
    few = [F.when(F.sum("n").over(Window.partitionBy(*tile(k))) <= TILE_POINTS, k) for k in range(TILE_SIZES - 1)]
    filled = cut(filled.withColumn("k", F.coalesce(*few, F.lit(TILE_SIZES - 1))).drop("n"))
    at = [F.coalesce(*[F.when(F.col("k") == k, tile(k)[i]) for k in range(TILE_SIZES)]).alias(c) for i, c in enumerate(("ty", "tx"))]
    tiles = filled.select("cy", "cx", "k", *at)
    dealt = None
    for (k,) in sorted(filled.select("k").distinct().collect()):
        # in number at most the largest tiles on earth, and sixteen for every full one
        needed = F.broadcast(tiles.where(F.col("k") == k).select("k", F.col("ty").alias("cy"), F.col("tx").alias("cx")).distinct())
        found = _dealt(edges, metres, TILE / 4**k).join(needed, ["cy", "cx"])
        dealt = found if dealt is None else dealt.unionByName(found)
    if dealt is None:
        dealt = edges.limit(0).select("*", *[F.lit(0).cast(kind).alias(c) for c, kind in (("cy", "long"), ("cx", "long"), ("k", "int"))])
    own = own.join(tiles, ["cy", "cx"]).select(*points.columns, "k", "ty", "tx")
    dealt = dealt.select(*edges.columns, "k", F.col("cy").alias("ty"), F.col("cx").alias("tx"))
    columns, others = points.columns, [c for c in edges.columns if c not in points.columns]

    def near(some: pa.Table, beside: pa.Table) -> pa.Table:
        lat, lon = (some[c].to_numpy() for c in ("lat", "lon"))
        i, j = kernels.near_edges(lat, lon, [beside[c].to_numpy() for c in _ENDS], metres)
        some, beside = some.select(columns).take(pa.array(i)), beside.select(others).take(pa.array(j))
        return pa.table([*some.columns, *beside.columns], names=[*columns, *others])

    schema = T.StructType([*points.schema.fields, *[edges.schema[c] for c in others]])
    return own.groupBy("k", "ty", "tx").cogroup(dealt.groupBy("k", "ty", "tx")).applyInArrow(near, schema)


def _nearest_in_cells(points: DataFrame, edges: DataFrame, id_columns: list[str], order: list[str], keep: list[str], same: list[str], metres: float, size: float) -> DataFrame:
    dealt = _dealt(edges, metres, size)
    own = points.select(*id_columns, *[s for s in same if s not in id_columns], "lat", "lon", geo.cell(F.col("lat"), size).alias("cy"), geo.cell(F.col("lon"), size).alias("cx"))
    need = [*same, "cy", "cx"]
    taken = list(dict.fromkeys([*keep, *order, *_ENDS]))
    pairs = own.join(dealt.select(*need, *[c for c in taken if c not in need]), need)
    return _best(pairs, id_columns, order, keep, taken, metres)


def _best(pairs: DataFrame, id_columns: list[str], order: list[str], keep: list[str], taken: list[str], metres: float) -> DataFrame:
    """Of each point's edges the nearest, if it is within so many metres."""
    at = geo.project(F.col("lat"), F.col("lon"), *(F.col(c) for c in _ENDS))
    best = pairs.withColumn("at", at).where(F.col("at.offset_m") <= metres)
    best = best.groupBy(*id_columns).agg(F.min(F.struct(F.col("at.offset_m").alias("offset_m"), *order, F.col("at.lat").alias("snap_lat"), F.col("at.lon").alias("snap_lon"), *[c for c in taken if c not in order])).alias("b"))
    return best.select(*id_columns, *[F.col(f"b.{c}") for c in keep], "b.offset_m", "b.snap_lat", "b.snap_lon")


def edge_snaps(points: DataFrame, edges: DataFrame, id_columns: list[str], metres: float = SNAP_M) -> DataFrame:
    """Nearest walkable edge of each point, with the distances from the foot of the perpendicular to both ends."""
    nodes = ["a_y", "a_x", "b_y", "b_x"]
    s = nearest_edge(points, edges, id_columns, nodes, [*nodes, "a_lat", "a_lon", "b_lat", "b_lon"], metres=metres)
    to = {f"to_{e}_m": geo.haversine(F.col("snap_lat"), F.col("snap_lon"), F.col(f"{e}_lat"), F.col(f"{e}_lon")) for e in "ab"}
    return s.withColumns(to).drop("a_lat", "a_lon", "b_lat", "b_lon")


def stop_spans(stops: DataFrame, edges: DataFrame, metres: float = SNAP_M) -> DataFrame:
    """The span of its own street that each stop lies at; stops without one within reach are left out."""
    return nearest_edge(stops.select("stop_id", "street_norm", "lat", "lon"), edges, ["stop_id"], ["span_ord", "edge_ord"], ["span_id"], ["street_norm"], metres)
