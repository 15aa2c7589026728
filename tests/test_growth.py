"""Tables in which very many rows stand at one place: work must follow the distinct ones."""

import pytest
from pyspark.sql import functions as F

from kerbside.operators import geocode, kernels, stops


def _crowd(spark, doors: int):
    """Two far places of one street with as many doors each, at numbers 2 and 4."""
    rows = spark.range(2 * doors).select(F.concat(F.lit("n"), F.col("id").cast("string")).alias("osm_id"), F.col("id").alias("ord"), (F.lit(-37.8) + (F.col("id") % 2) * 0.05).alias("lat"), F.lit(145.0).alias("lon"))
    number = F.when(F.col("ord") % 2 == 0, "2").otherwise("4").alias("number")
    return rows.select("*", number, F.lit("Long Street").alias("street"), F.col("ord").cast("string").alias("unit"), F.when(F.col("ord") % 3 == 0, "3101").alias("postcode"))


def test_doors_at_one_place_are_clustered_once(spark):
    """the kernel compared all doors of a street with each other, here 40,000 squared."""
    rows = _crowd(spark, 40_000).where("ord <> 1")
    found = stops.spatial_clusters(rows, ["street"], ["ord"])
    assert {(r["number"], r["cluster"], r["count"]) for r in found.groupBy("number", "cluster").count().collect()} == {("2", 0, 40_000), ("4", 1, 39_999)}
    # of equal sizes the one with the later last point comes first
    even = stops.spatial_clusters(_crowd(spark, 50), ["street"], ["ord"]).groupBy("number", "cluster").count().collect()
    assert {(r["number"], r["cluster"], r["count"]) for r in even} == {("4", 0, 50), ("2", 1, 50)}


def test_equal_questions_meet_a_street_once(spark):
    """F1, F3, F8: each question met each door of its address, here 20,000 times 20,000 rows for each form."""
    kind = F.element_at(F.array(F.lit("2 Long Street"), F.lit("5 Long St"), F.lit("Long Street"), F.lit("Lomg Street")), (F.col("id") % 4 + 1).cast("int"))
    asked = spark.range(80_000).select(F.col("id").alias("qid"), kind.alias("q"))
    found = geocode.search(asked, _crowd(spark, 20_000))
    got = found.groupBy((F.col("qid") % 4).alias("k"), "rank", "number", "door_count", "match_type").count().collect()
    assert {tuple(r) for r in got} == {
        (0, 1, "2", 20_000, "exact", 20_000),
        (1, 1, "4", 20_000, "approximate", 20_000),
        (1, 2, "2", 20_000, "approximate", 20_000),
        (2, 1, None, 20_000, "street", 20_000),
        (2, 2, None, 20_000, "street", 20_000),
        (3, 1, None, 20_000, "street", 20_000),
        (3, 2, None, 20_000, "street", 20_000),
    }


def test_points_and_addresses_at_one_place_meet_once(spark):
    """each point met each door of its cells, here 30,000 times 30,000."""
    points = spark.range(30_000).select(F.col("id").alias("pid"), F.lit(-37.8001).alias("lat"), F.lit(145.0).alias("lon"))
    found = geocode.reverse(points, _crowd(spark, 30_000)).groupBy("label", F.round("distance_m", 1).alias("m")).count().collect()
    assert [tuple(r) for r in found] == [("0/2 Long Street", 11.1, 30_000)]


def test_an_edge_is_chosen_as_the_sql_chooses(spark):
    """where two edges meet at the nearest node, the last bit of the offset decides; hypot gave another one than the SQL."""
    from kerbside.functions import geo
    from kerbside.operators import network
    from kerbside.sources import town

    doors = spark.sql(town.DOORS_SQL.replace("FROM customer", "FROM {customer}"), customer=spark.createDataFrame([(1716,), (14982,)], "c_custkey long"))
    nodes = [(-378584675, 1450455995, -378579200, 1450455860), (-378579910, 1450449525, -378579200, 1450455860), (-375264670, 1450273455, -375259880, 1450273320), (-375259905, 1450266985, -375259880, 1450273320)]
    edges = network.with_degrees(spark.createDataFrame(nodes, "a_y long, a_x long, b_y long, b_x long"))
    edges = edges.withColumn("length_m", geo.haversine(*(F.col(c) for c in ("a_lat", "a_lon", "b_lat", "b_lon"))))
    found = {r["osm_id"]: (r["a_y"], r["a_x"]) for r in network.edge_snaps(doors, edges, ["osm_id"]).collect()}
    assert found == {"n1716": (-378584675, 1450455995), "n14982": (-375264670, 1450273455)}


def test_equal_trips_are_searched_once(spark, monkeypatch):
    """every trip got its own copy of the edges; and a long slanting edge was dealt to all cells of its box."""
    from kerbside.functions import geo
    from kerbside.operators import network, routing

    nodes = [(-378000000, 1450000000, -370000000, 1460000000)]
    edges = network.with_degrees(spark.createDataFrame(nodes, "a_y long, a_x long, b_y long, b_x long"))
    edges = edges.withColumn("length_m", geo.haversine(*(F.col(c) for c in ("a_lat", "a_lon", "b_lat", "b_lon"))))
    seen, plain = [], routing._edges_near
    monkeypatch.setattr(routing, "_edges_near", lambda boxes, *rest: seen.append(boxes.count()) or plain(boxes, *rest))
    trips = spark.range(500).select(F.col("id").alias("route_id"), F.lit(-37.6).alias("from_lat"), F.lit(145.25).alias("from_lon"), F.lit(-37.2).alias("to_lat"), F.lit(145.75).alias("to_lon"))
    found = routing.routes(trips, edges).agg(F.count_distinct("route_id").alias("n"), F.round(F.min("distance_m") / F.min("crow_m"), 3).alias("ratio")).first()
    assert tuple(found) == (500, 1.0) and set(seen) == {1}


def test_streets_of_four_digits_stay_apart(spark, tmp_path):
    """of more than 40,000 customers the lanes have four digits, which were dropped as postcodes, so that Lane 1001 and Lane 1002 were one street."""
    import duckdb
    from __spark_entry__ import oracle_sql, queries

    spark.range(40_000, 40_200).withColumnRenamed("id", "c_custkey").write.parquet(str(tmp_path / "customer.parquet"))
    found = queries()["town_spans"](spark, str(tmp_path))
    with duckdb.connect() as db:
        db.execute(f"CREATE VIEW customer AS SELECT * FROM '{tmp_path}/customer.parquet/*.parquet'")
        want = db.execute(f"SELECT {', '.join(found.columns)} FROM ({oracle_sql()['town_spans']})").fetchall()
    assert sorted(tuple(r) for r in found.collect()) == sorted(want)
    assert any(r[0].startswith("lane 1001@") for r in want)


def test_a_group_of_one_task_is_cut_in_one_job(spark, monkeypatch):
    """every level took a round of jobs, however small its groups were; here there are nine levels."""
    from kerbside.operators import zones
    from tests.test_zones import SCHEMA, brute, faces

    rows, seen, plain = faces(5, 600, 30), [], zones.cut
    df = spark.createDataFrame(rows, SCHEMA)
    monkeypatch.setattr(zones, "cut", lambda some: seen.append(1) or plain(some))
    assert {r["blockface_id"]: r["leaf"] for r in zones.split(df, 10).collect()} == brute(rows, 10)
    assert len(seen) <= 4
    # above the limit it goes by levels first, and down to it at once
    assert {r["blockface_id"]: (r["leaf"], r["k1"], r["k2"]) for r in zones.split(df, 10, 100, 8).collect()} == {r["blockface_id"]: (r["leaf"], r["k1"], r["k2"]) for r in zones.split(df, 10).collect()}


@pytest.mark.parametrize("most", [20_000, 40])
def test_long_edges_are_dealt_to_few_tiles(spark, monkeypatch, most):
    """edges of 200 km beside each other were dealt to thousands of small cells each, and met all points of each; they grow in number and length with the town."""
    import numpy as np

    from kerbside.operators import network

    monkeypatch.setattr(network, "TILE_POINTS", most)
    rng = np.random.default_rng(2)
    n, m = 300, 400
    lat, lon = -36.0 + rng.random(n) * 0.5, 145.0 + rng.random(n) * 0.05
    lat[:60], lon[:60] = lat[0], lon[0]
    a = np.stack([-37.0 + rng.random(m) * 0.3, 144.99 + rng.random(m) * 0.07], 1)
    b = np.stack([-35.0 + rng.random(m) * 0.3, 144.99 + rng.random(m) * 0.07], 1)
    rows = [tuple(int(round(v * 1e7)) for v in (*p, *q)) for p, q in zip(a, b, strict=True)]
    edges = network.with_degrees(spark.createDataFrame(rows, "a_y long, a_x long, b_y long, b_x long"))
    points = spark.createDataFrame([(k, float(p), float(q)) for k, (p, q) in enumerate(zip(lat, lon, strict=True))], "id long, lat double, lon double")
    assert network._dealt(edges, network.SNAP_M, network.TILE).count() < 20 * m
    assert network._pairs_in_tiles(points, edges, network.SNAP_M).count() < 2 * n
    found = {r["id"]: (r["a_y"], r["a_x"], r["b_y"], r["b_x"], r["offset_m"]) for r in network.nearest_edge(points, edges, ["id"], ["a_y", "a_x", "b_y", "b_x"], ["a_y", "a_x", "b_y", "b_x"]).collect()}
    ends = np.array(rows) / 1e7
    want = {}
    for k, p in enumerate(zip(lat, lon, strict=True)):
        off = [kernels.along([tuple(e[:2]), tuple(e[2:])], p)[0] for e in ends]
        if min(off) <= network.SNAP_M:
            want[k] = (*rows[int(np.argmin(off))], pytest.approx(min(off)))
    assert found == want and len(want) > n / 2


@pytest.mark.parametrize("at", [-37.9, 0.0, 89.99, 95.0])
def test_near_edges_hold_all_nearest_ones(at):
    """also where a degree of longitude is next to nothing."""
    import numpy as np

    rng = np.random.default_rng(3)
    lat, lon = at + rng.uniform(-0.05, 0.05, 400), rng.uniform(-0.05, 0.05, 400)
    lat[:50], lon[:50] = lat[0], lon[0]
    ends = [at + rng.uniform(-0.05, 0.05, 300), rng.uniform(-0.05, 0.05, 300)]
    ends += [ends[0] + rng.normal(0, 0.01, 300) * (rng.random(300) < 0.9), ends[1] + rng.normal(0, 0.01, 300)]
    k = np.abs(np.cos(np.radians(lat)))[:, None]
    px, py, rx, ry = (ends[1] - lon[:, None]) * k, ends[0] - lat[:, None], (ends[3] - ends[1]) * k, ends[2] - ends[0]
    share = np.clip(-(px * rx + py * ry) / (rx * rx + ry * ry), 0.0, 1.0)
    off = np.hypot(px + share * rx, py + share * ry) * kernels.DEGREE_M
    i, j = kernels.near_edges(lat, lon, ends, 300.0, leaf=16)
    nearest = off.argmin(1)
    assert {(p, nearest[p]) for p in range(400) if off[p].min() <= 300} <= set(zip(i.tolist(), j.tolist(), strict=True))
    assert (off[i, j] <= off.min(1)[i] * (1 + 1e-8) + 1e-5).all() and (off[i, j] <= 300.001).all()
    assert [len(v) for v in kernels.near_edges(lat[:0], lon[:0], ends, 300.0)] == [0, 0] == [len(v) for v in kernels.near_edges(lat, lon, [e[:0] for e in ends], 300.0)]


def test_routes_over_long_edges_share_their_edges(spark, tmp_path, monkeypatch):
    """most doors of the large town lie at a Gate of many kilometres, so that a route is as long; every trip had its own copy of the edges around it, and the edges were tried on one ellipse after another."""
    from kerbside.operators import network, routing
    from kerbside.sources import town
    from tests.test_nearest import brute_routes

    spark.range(80_000, 80_600).withColumnRenamed("id", "c_custkey").write.parquet(str(tmp_path / "customer.parquet"))
    edges = network.walk_edges(town.ways(spark, str(tmp_path))).cache()
    gates = edges.where("length_m > 1000").orderBy("a_y", "a_x").collect()
    doors = [(k, *(r[f"a_{c}"] + s * (r[f"b_{c}"] - r[f"a_{c}"]) for c in ("lat", "lon"))) for k, (r, s) in enumerate((r, s) for r in gates for s in (0.2, 0.4, 0.6, 0.8))]
    trips = [(k, *doors[k][1:], *doors[(7 * k + 90) % len(doors)][1:]) for k in range(len(doors))]
    seen, plain = [], routing._edges_near
    monkeypatch.setattr(routing, "_edges_near", lambda boxes, *rest: seen.append(boxes.count()) or plain(boxes, *rest))
    asked = spark.createDataFrame(trips, "route_id long, from_lat double, from_lon double, to_lat double, to_lon double")
    found = {r["route_id"]: r for r in routing.routes(asked, edges).collect()}
    ends = spark.createDataFrame([(k, *d[1:]) for k, d in enumerate(doors)], "id long, lat double, lon double")
    snapped = {r["id"]: r for r in network.edge_snaps(ends, edges, ["id"]).collect()}
    want = brute_routes(edges.collect(), [(k, snapped[k], snapped[(7 * k + 90) % len(doors)]) for k in range(len(doors))])
    assert {k: r["distance_m"] for k, r in found.items()} == pytest.approx(want)
    assert max(want.values()) > 40_000 and len(want) > 150 and sum(seen) < len(trips)
    for r in found.values():
        steps = [float(kernels.haversine(p["lat"], p["lon"], q["lat"], q["lon"])) for p, q in zip(r["points"], r["points"][1:], strict=False)]
        assert sum(steps) == pytest.approx(r["distance_m"], rel=2e-3, abs=0.1)
    bare = {r["route_id"]: r for r in routing.routes(asked, edges, points=False).collect()}
    assert {k: r["distance_m"] for k, r in bare.items()} == {k: r["distance_m"] for k, r in found.items()} and "points" not in bare[0]


@pytest.mark.parametrize("seed", range(12))
def test_folded_roads_by_plain_search(seed):
    """runs of nodes with two neighbours are one edge, with and without landmarks; kept nodes, rings and loops too."""
    import math
    import random

    import numpy as np

    rng = random.Random(seed)
    links = {(min(p), max(p)): rng.random() * 10 for p in ((rng.randrange(40), rng.randrange(40)) for _ in range(50)) if p[0] != p[1]}
    links |= {(100 + k, 101 + k): rng.random() for k in range(30)} | {(0, 100): 1.0, (1, 130): 1.0} | {(200 + k, 200 + (k + 1) % 4): 1.0 for k in range(4)} | {(300 + k, 301 + k): 1.0 for k in range(5)} | {(0, 300): 1.0, (0, 305): 1.0}
    trips = [(rng.choice(list(links)), rng.choice(list(links)), *(rng.random() for _ in range(4))) for _ in range(40)]
    kept = np.array([n for f, t, *_ in trips for n in (*f, *t)])
    roads = kernels.Roads(*(np.array([p[e] for p in links]) for e in (0, 1)), np.array(list(links.values())), kept)
    if seed % 2:
        roads.mark(roads.number(int(kept[0])), 3)
    for f, t, *d in trips:
        first = {f[0]: d[0], f[1]: d[1]}
        want = kernels.shortest([(*p, w) for p, w in links.items()] + [(t[0], -1, d[2]), (t[1], -1, d[3])], first, goal=-1)[0].get(-1, math.inf)
        length, start, way = roads.search({roads.number(n): w for n, w in first.items()}, {roads.number(t[0]): d[2], roads.number(t[1]): d[3]})
        assert length == pytest.approx(want)
        if length < math.inf:
            line = roads.points(start, way)
            steps = sum(links[p, q] if (p, q) in links else links[q, p] for p, q in zip(line, line[1:], strict=False))
            assert d[f.index(line[0])] + steps + d[2 + t.index(line[-1])] == pytest.approx(want)
