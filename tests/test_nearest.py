"""Nearest addresses against all of them, near and far, and what a far point meets."""

import random

import pytest
from pyspark.sql import functions as F

from kerbside.operators import geocode, kernels, network, routing

SCHEMA = "ord long, lat double, lon double, unit string, number string, street string"


def addresses(seed, n=150):
    rng = random.Random(seed)
    centres = [(10.0, 20.0), (10.02, 20.5), (-33.0, 151.0), (60.0, -170.0)]
    rows = []
    for k in range(n):
        lat, lon = rng.choice(centres)
        rows.append((k, lat + rng.randrange(40) * 2e-4, lon + rng.randrange(40) * 2e-4, None, str(k), rng.choice(["A Street", "B Street"] if lat > 0 else ["C Street"])))
    return rows


def metres(p, a):
    return float(kernels.haversine(p[0], p[1], a[1], a[2]))


@pytest.mark.parametrize("seed", [1, 2])
def test_reverse_and_other_street_by_hand(spark, seed):
    rows = addresses(seed)
    rng = random.Random(seed)
    points = [(k, rng.uniform(-80, 80), rng.uniform(-170, 170)) for k in range(40)] + [(100 + k, r[1] + rng.uniform(-1, 1) * 10 ** -rng.randint(1, 5), r[2] + rng.uniform(-1, 1) * 10 ** -rng.randint(1, 5)) for k, r in enumerate(rows[:60])]
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    found = {r["pid"]: r for r in geocode.reverse(spark.createDataFrame(points, "pid long, lat double, lon double"), df).collect()}
    for pid, lat, lon in points:
        want = min(rows, key=lambda a: (metres((lat, lon), a), a[0]))
        assert found[pid]["distance_m"] == pytest.approx(metres((lat, lon), want), rel=1e-9) and found[pid]["label"] == f"{want[4]} {want[5]}"
    asked = [(r[5], r[1], r[2]) for r in rows]
    others = {(r["street"], r["lat"], r["lon"]): r["other"] for r in geocode.nearest_other_street(spark.createDataFrame(asked, "street string, lat double, lon double"), df).collect()}
    for street, lat, lon in set(asked):
        want = min((a for a in rows if a[5] != street), key=lambda a: (metres((lat, lon), a), a[0]))
        assert others[street, lat, lon] == want[5]


def test_empty_and_one_street(spark):
    none = spark.createDataFrame([], SCHEMA)
    one = spark.createDataFrame([(0, 10.0, 20.0, None, "1", "A Street")], SCHEMA)
    point = spark.createDataFrame([(1, 11.0, 21.0)], "pid long, lat double, lon double")
    assert geocode.reverse(point, none).count() == 0 and geocode.reverse(point.limit(0), one).count() == 0
    assert geocode.nearest_other_street(one.select("street", "lat", "lon"), one).count() == 0


def test_a_far_point_meets_few_addresses(spark):
    """30 km away from 10,000 addresses, a point reads the addresses of a few small cells."""
    df = spark.range(10_000).selectExpr("id AS ord", "10 + (id % 100) * 5e-4 AS lat", "20 + id div 100 * 5e-4 AS lon", "CAST(NULL AS STRING) AS unit", "CAST(id AS STRING) AS number", "'A Street' AS street")
    point = spark.createDataFrame([(1, 10.0, 20.33)], "pid long, p_lat double, p_lon double")
    cells = geocode._cells_in_reach(point, ["pid"], df)
    met = df.withColumns({"cy": F.floor(F.col("lat") / geocode.NEAR_CELL), "cx": F.floor(F.col("lon") / geocode.NEAR_CELL)}).join(cells, ["cy", "cx"])
    assert 0 < met.count() < 100
    assert geocode._nearest(point, ["pid"], df, ["ord", "lat", "lon"]).first()["lon"] == pytest.approx(20.0495)
    levels = geocode._pyramid(df, None)
    assert levels[0].count() > 2000 and levels[-1].count() <= geocode.TOP_CELLS


def brute_routes(rows, requests):
    """Distances over an undirected graph of snapped ends, by plain search."""
    edges = [((r["a_y"], r["a_x"]), (r["b_y"], r["b_x"]), r["length_m"]) for r in rows]
    out = {}
    for rid, f, t in requests:
        first = {(f["a_y"], f["a_x"]): f["to_a_m"]}
        first[f["b_y"], f["b_x"]] = min(f["to_b_m"], first.get((f["b_y"], f["b_x"]), float("inf")))
        done, _ = kernels.shortest(edges, first)
        ways = [done[n] + d for n, d in (((t["a_y"], t["a_x"]), t["to_a_m"]), ((t["b_y"], t["b_x"]), t["to_b_m"])) if n in done]
        if [f[c] for c in ("a_y", "a_x", "b_y", "b_x")] == [t[c] for c in ("a_y", "a_x", "b_y", "b_x")]:
            ways.append(abs(f["to_a_m"] - t["to_a_m"]))
        if ways:
            out[rid] = f["offset_m"] + min(ways) + t["offset_m"]
    return out


def test_routes_on_a_graph_in_two_parts(spark):
    rng = random.Random(9)
    node = lambda p, k: (10 + p * 0.02 + (k // 6) * 1e-3, 20 + (k % 6) * 1e-3)
    ways = []
    for p in (0, 1):
        for k in range(36):
            for m in ([k + 1] if k % 6 < 5 else []) + ([k + 6] if k < 30 else []):
                if rng.random() < 0.8:
                    ways.append((len(ways), len(ways), [node(p, k), node(p, m)], {"highway": "residential"}))
    edges = network.walk_edges(spark.createDataFrame(ways, "ord long, osm_id long, geometry array<struct<lat:double,lon:double>>, tags map<string,string>")).cache()
    places = [(10 + rng.choice([0, 0.02]) + rng.random() * 5e-3, 20 + rng.random() * 5e-3) for _ in range(60)]
    requests = [(k, *places[k], *places[k + 30]) for k in range(30)]
    snapped = {r["id"]: r for r in network.edge_snaps(spark.createDataFrame([(k, *p) for k, p in enumerate(places)], "id long, lat double, lon double"), edges, ["id"]).collect()}
    want = brute_routes(edges.collect(), [(k, snapped[k], snapped[k + 30]) for k in range(30) if k in snapped and k + 30 in snapped])
    found = {r["route_id"]: r["distance_m"] for r in routing.routes(spark.createDataFrame(requests, "route_id long, from_lat double, from_lon double, to_lat double, to_lon double"), edges).collect()}
    assert 0 < len(want) < 30 and found == pytest.approx(want)
