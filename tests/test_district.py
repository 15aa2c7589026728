"""The engine on small hand-made districts of our own, and conservation laws on the derived one."""

import gzip
import json
import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from kerbside.functions import geo
from kerbside.operators import blockfaces, geocode, kernels, network, routing, stops, territory, zones
from kerbside.plans import reports
from kerbside.plans.district import District, SnapshotMissingError
from kerbside.sources import overpass, snapshot
from tests.conftest import SF

WAY = "ord long, osm_id long, geometry array<struct<lat:double,lon:double>>, tags map<string,string>"
DOOR = "osm_id string, ord long, lat double, lon double, number string, street string, unit string, postcode string"


def ways_of(spark, *rows):
    """rows: (points, tags)."""
    return spark.createDataFrame([(i, 70 + i, list(points), tags) for i, (points, tags) in enumerate(rows)], WAY)


def doors_of(spark, rows):
    """rows: dicts with at, number, street, and unit or postcode."""
    return spark.createDataFrame([(r.get("id", f"door-{i:03d}"), i, *r["at"], r["number"], r["street"], r.get("unit"), r.get("postcode")) for i, r in enumerate(rows)], DOOR)


def row_of_doors(street, start, step, numbers, **more):
    """Doors at equal steps from a point."""
    return [{"at": (start[0] + step[0] * k, start[1] + step[1] * k), "number": str(n), "street": street, **more} for k, n in enumerate(numbers)]


# a village on the chalk: four houses, a block of four flats, two shops, and a farm outside the boundary

VILLAGE = [
    *row_of_doors("Tanners Lane", (51.4000, -1.3200), (0.0003, 0.0002), (3, 5, 7, 9)),
    *[{"at": (51.4020, -1.3190), "number": "8", "street": "Weir Close", "unit": unit} for unit in "ABCD"],
    *row_of_doors("London Road", (51.4080, -1.3100), (0.0002, 0.0001), (61, 63)),
    {"at": (51.4500, -1.3200), "number": "1", "street": "Far Drove"},
]
VILLAGE_WAYS = [
    ([(51.3998, -1.3202), (51.4012, -1.3192)], {"highway": "residential", "name": "Tanners Lane"}),
    ([(51.4012, -1.3192), (51.4024, -1.3188)], {"highway": "residential", "name": "Weir Close"}),
    ([(51.4060, -1.3115), (51.4100, -1.3090)], {"highway": "tertiary", "name": "London Road", "lanes": "2"}),
    ([(51.4024, -1.3188), (51.4060, -1.3115)], {"highway": "path"}),
]
FENCE = [(51.39, -1.34), (51.39, -1.30), (51.42, -1.30), (51.42, -1.34)]


@pytest.fixture(scope="module")
def village(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("village") / "village.json.gz"
    houses = [{"id": f"h{i}", "lat": d["at"][0], "lon": d["at"][1], "number": d["number"], "street": d["street"], **({"unit": d["unit"]} if "unit" in d else {})} for i, d in enumerate(VILLAGE)]
    roads = [{"id": 300 + i, "tags": tags, "geometry": [list(p) for p in points]} for i, (points, tags) in enumerate(VILLAGE_WAYS)]
    document = {"format": 1, "meta": {"district_name": "Chalkwater", "relation_id": 51, "fetched_at": "2025-03-01T12:00:00+00:00"}, "boundary": {"rings": [[list(p) for p in (*FENCE, FENCE[0])]]}, "addresses": houses, "ways": roads}
    path.write_bytes(gzip.compress(json.dumps(document).encode()))
    return District.open(spark, str(path))


def test_coverage_of_the_village(village):
    seen = village.coverage().first()
    assert (seen.doors, seen.stops, seen.streets) == (11, 8, 4)
    assert (seen.doors_with_unit, seen.multi_unit_stops, seen.gated_complex_candidates) == (4, 1, 0)
    assert [(b.door_count, b.stops) for b in seen.cluster_histogram] == [(1, 7), (4, 1)]
    assert {w.highway: w.ways for w in seen.walkable_ways} == {"residential": 2, "tertiary": 1, "path": 1}
    assert (seen.boundary_rings, seen.boundary_closed_rings) == (1, 1)
    assert (seen.largest_stops[0].street, seen.largest_stops[0].doors) == ("Weir Close", 4)
    assert seen.top_streets[0].doors == 4


def test_health_and_outline(village):
    health = village.health().first()
    assert (health.status, health.doors, health.district_name) == ("ok", 11, "Chalkwater")
    outline = village.district().first()
    assert (outline.south, outline.east, outline.walkable_ways) == (51.39, -1.30, 4)
    assert village.source.meta.first().boundary_source == "osm"


def test_boxes_and_pages(village):
    inside = "51.39,-1.34,51.42,-1.30"
    assert village.address_features(inside)[0].count() == 10 and village.stop_features(inside)[0].count() == 7
    some, more = village.address_features(limit=4)
    assert (some.count(), more) == (4, True)
    assert village.address_features()[1] is False
    first = json.loads(some.orderBy("id").first().feature)
    assert first["geometry"] == {"type": "Point", "coordinates": [-1.32, 51.4]}
    assert first["properties"]["label"] == "3 Tanners Lane"
    for wrong in ("51,-1,52", "s,w,n,e"):
        with pytest.raises(ValueError):
            village.address_features(wrong)
    for wrong in (0, 100_001):
        with pytest.raises(ValueError):
            village.address_features(limit=wrong)


def test_totals_of_a_page(village):
    assert village.stop_totals(limit=2).first().rows == 2
    every = village.stop_totals().first()
    assert (every.rows, every.doors) == (8, 11) and every.minutes == pytest.approx(sum(30 + 75 * n for n in (1, 1, 1, 1, 4, 1, 1, 1)) / 60, abs=0.06)
    faces = village.blockface_totals().first()
    assert faces.doors == 11 and faces.rows == village.faces.count()
    counts = village.network_counts().first()
    assert (counts.street_count, counts.span_count) == (3, 3)


def test_limits_of_parameters(spark, village):
    def hub(radius):
        return spark.createDataFrame([(1, 51.4, -1.32, radius)], "hub_id int, lat double, lon double, radius_m double")

    for wrong in (49.0, 3001.0):
        with pytest.raises(Exception, match="radius"):
            village.hub_preview(hub(wrong)).collect()
    with pytest.raises(Exception, match="teams"):
        village.territories(spark.createDataFrame([(1, 51.4, -1.32, 500.0, 9)], "scenario_id int, lat double, lon double, radius_m double, teams int"))[1].collect()


def test_hub_and_reverse(spark, village):
    near = village.hub_preview(spark.createDataFrame([(5, 51.4000, -1.3200, 500.0)], "hub_id int, lat double, lon double, radius_m double")).first()
    assert (near.doors_within, near.stops_within, near.streets_within) == (8, 5, 2)
    assert (near.nearest_address, near.inside_district) == ("3 Tanners Lane", True)
    asked = spark.createDataFrame([(1, 51.4001, -1.3200), (2, 51.4499, -1.3200)], "pid int, lat double, lon double")
    here, there = village.reverse(asked).orderBy("pid").collect()
    assert here.label == "3 Tanners Lane" and 10 < here.distance_m < 12 and here.inside_district
    assert there.label == "1 Far Drove" and not there.inside_district


def test_geocoding(spark, village):
    asked = {1: "5 Taners Lane", 2: "9 Imaginary Crescent", 3: "Unit 3, 8 Weir Cl, Melbourne", 4: "  ", 5: "6 Tanners Ln", 6: "London Road"}
    found = {}
    for r in village.geocode(spark.createDataFrame(list(asked.items()), "qid int, q string")).orderBy("rank").collect():
        found.setdefault(r.qid, []).append(r)
    assert set(found) == {1, 3, 5, 6}
    assert (found[1][0].street, found[1][0].match_type) == ("Tanners Lane", "fuzzy")
    assert (found[3][0].label, found[3][0].score) == ("8 Weir Close (4 doors)", 1.0)
    assert {r.number for r in found[5]} == {"3", "5", "7"} and {(r.match_type, r.score) for r in found[5]} == {("approximate", 0.7)}
    assert (found[6][0].match_type, found[6][0].number, found[6][0].score) == ("street", None, 0.9)


def test_one_street_name_in_two_places(spark):
    mills = [{"id": "north", "at": (52.02, 0.10), "number": "40", "street": "Mill Road", "postcode": "1090"}, {"id": "south", "at": (51.98, 0.11), "number": "40", "street": "Mill Road", "postcode": "1010"}, {"id": "ridge", "at": (51.9801, 0.1101), "number": "2", "street": "Ridge Way"}]
    doors = doors_of(spark, mills)
    assert stops.build_stops(doors).count() == 3
    found = geocode.search(spark.createDataFrame([(1, "40 Mill Rd")], "qid int, q string"), doors).orderBy("rank").collect()
    assert sorted(r.label for r in found) == ["40 Mill Road - 1010", "40 Mill Road - 1090"]
    assert [r.score for r in found] == [1.0, 0.99]
    others = geocode.nearest_other_street(doors.where("street = 'Mill Road'").select("street", "lat", "lon"), doors)
    assert [r.other for r in others.collect()] == ["Ridge Way"] * 2


# kernels


def test_single_link_clusters():
    string_of_lights = np.arange(150) * 0.001
    assert kernels.cluster(np.full(150, 10.0), 20 + string_of_lights, 150).max() == 0
    assert kernels.cluster(np.full(150, 10.0), 20 + string_of_lights, 100).max() == 149
    assert kernels.cluster(np.array([10.3, 10.0, 10.0]), np.array([20.0, 20.0, 20.0005]), 150).tolist() == [1, 0, 0]


def test_chains_join_ends():
    apex, left, right = (2, 1), (0, 0), (0, 2)
    assert kernels.chains([[left, right], [apex, left], [apex, right]]) == [[left, right, apex, left]]
    assert kernels.chains([[left, right], [(8, 8), (9, 9)], [apex]]) == [[left, right], [(8, 8), (9, 9)]]
    # the earliest line that touches the tail goes on
    assert kernels.chains([[left, apex], [apex, (5, 5)], [apex, right]]) == [[left, apex, (5, 5)], [apex, right]]
    assert kernels.chains([]) == []


def test_measures_along_a_chain():
    bend = [(0.0, 0.0), (0.0, 0.01), (0.01, 0.01)]
    leg = math.radians(0.01) * kernels.EARTH_M
    offset, gone = kernels.along(bend, (0.001, 0.005))
    assert offset == pytest.approx(0.001 * kernels.DEGREE_M) and gone == pytest.approx(leg / 2)
    piece = kernels.cut_out(bend, leg / 2, leg * 1.5)
    assert np.allclose(piece, [(0.0, 0.005), (0.0, 0.01), (0.005, 0.01)])
    assert kernels.cut_out(bend, leg, leg) == [] and np.allclose(kernels.cut_out(bend, -5, 9e9), bend)
    trimmed = kernels.trim([bend, [(5.0, 5.0), (5.0, 5.01)]], [(0.0001, 0.004), (-0.0001, 0.006)], frontage=leg / 10)
    assert len(trimmed) == 1 and np.allclose(trimmed[0], [(0.0, 0.003), (0.0, 0.007)], atol=1e-6)
    assert kernels.trim([], [(0, 0)]) == [] and kernels.trim([bend], []) == []


def test_circle_and_interpolation(spark):
    ring = spark.range(1).select(geo.circle(F.lit(10.0), F.lit(20.0), F.lit(250.0)).alias("ring")).first().ring
    assert len(ring) == 97 and all(kernels.haversine(10.0, 20.0, p.lat, p.lon) == pytest.approx(250, rel=3e-3) for p in ring)


# a river with a lower and an upper road, and one footbridge at their western end

BANKS = {"lower west": (10.000, 20.000), "lower east": (10.000, 20.006), "upper west": (10.003, 20.000), "upper east": (10.003, 20.006)}


@pytest.fixture(scope="module")
def river(spark):
    lw, le, uw, ue = BANKS.values()
    lines = [([lw, le], {"highway": "residential"}), ([uw, ue], {"highway": "service"}), ([lw, uw], {"highway": "footway"}), ([le, ue], {"highway": "path", "foot": "no"}), ([le, le], {"highway": "steps"}), ([(10.05, 20.05), (10.05, 20.052)], {"highway": "track"}), ([le, (9.998, 20.006)], {"highway": "residential", "access": "private", "foot": "yes"}), ([ue, (10.004, 20.006)], {"highway": "residential", "access": "private"})]
    return network.walk_edges(ways_of(spark, *lines)).cache()


def test_walking_graph(spark, river):
    counts = network.graph_counts(river).first()
    assert (counts.nodes, counts.edges) == (7, 5)


def test_reach_along_the_river(spark, river):
    doors = doors_of(spark, [{"id": "low", "at": (10.00005, 20.0045), "number": "1", "street": "Lower"}, {"id": "high", "at": (10.00295, 20.0045), "number": "1", "street": "Upper"}, {"id": "lost", "at": (11.0, 21.0), "number": "1", "street": "Lost"}])
    snaps = network.edge_snaps(doors, river, ["osm_id"])
    assert {r.osm_id for r in snaps.collect()} == {"low", "high"}
    hubs = spark.createDataFrame([(1, 10.00005, 20.0015, 400.0), (2, 10.00005, 20.0043, 300.0), (3, 10.00005, 20.0015, 1100.0)], "hub_id int, lat double, lon double, cutoff_m double")
    reached = {(r.hub_id, r.osm_id): r.walk_m for r in routing.reach(hubs, river, snaps).collect()}
    assert set(reached) == {(1, "low"), (2, "low"), (3, "low"), (3, "high")}
    assert reached[2, "low"] < 40 < reached[1, "low"] < 400 < reached[3, "high"]


def test_routes_over_the_bridge(spark, river):
    asked = {1: ((10.00005, 20.0045), (10.00295, 20.0045)), 2: ((10.00005, 20.0045), (10.05, 20.051)), 3: ((10.00005, 20.0045), (11.0, 21.0)), 4: ((10.00005, 20.0015), (10.00005, 20.0045))}
    found = {r.route_id: r for r in routing.routes(spark.createDataFrame([(k, *a, *b) for k, (a, b) in asked.items()], "route_id int, from_lat double, from_lon double, to_lat double, to_lon double"), river).collect()}
    assert set(found) == {1, 4}  # 2 is on an island, 3 is far from any path
    assert found[1].distance_m > 3.5 * found[1].crow_m > 0
    assert {BANKS["lower west"], BANKS["upper west"]} <= {(round(p.lat, 6), round(p.lon, 6)) for p in found[1].points}
    assert found[4].distance_m == pytest.approx(found[4].crow_m, abs=15)


# a quiet street of two blocks above a busy one, and a lane between them

GREEN = {"w": (10.010, 20.010), "m": (10.010, 20.012), "e": (10.010, 20.014)}
QUAY = {"w": (10.007, 20.010), "m": (10.007, 20.012), "e": (10.007, 20.014)}


def green_and_quay(spark, extra=()):
    lines = [([GREEN["w"], GREEN["m"]], {"highway": "residential", "name": "The Green", "maxspeed": "30"}), ([GREEN["m"], GREEN["e"]], {"highway": "residential", "name": "The Green", "maxspeed": "30"}), ([GREEN["m"], QUAY["m"]], {"highway": "service", "name": "Rope Walk"}), ([QUAY["w"], QUAY["m"], QUAY["e"]], {"highway": "secondary", "name": "Quay Road", "lanes": "4", "maxspeed": "60"})]
    houses = []
    for n in range(1, 11):  # five to a block, even numbers on the north side
        houses.append({"id": f"g{n:02d}", "at": (10.010 + (1.5e-4 if n % 2 == 0 else -1.5e-4), 20.010 + (n - 0.5 if n <= 5 else n - 0.5) * 4e-4), "number": str(n), "street": "The Green"})
    for n in (11, 12, 13, 14):
        houses.append({"id": f"q{n}", "at": (10.007 + (1.5e-4 if n % 2 == 0 else -1.5e-4), 20.0104 + (n - 11) * 3e-4), "number": str(n), "street": "Quay Road"})
    edges = network.span_edges(ways_of(spark, *lines)).cache()
    spans, built = network.spans(edges).cache(), stops.build_stops(doors_of(spark, houses + list(extra))).cache()
    return built, spans, blockfaces.build_blockfaces(built, edges, spans).cache()


def test_sides_and_blocks(spark):
    lane = row_of_doors("Nowhere Lane", (10.5, 20.5), (0.0, 0.0004), (7, 8))
    built, spans, faces = green_and_quay(spark, lane)
    per_street = {r.street_norm: (r["count"], round(r.metres)) for r in spans.groupBy("street_norm").agg(F.count("*").alias("count"), F.sum("length_m").alias("metres")).collect()}
    assert per_street["the green"] == (2, 438) and per_street["quay road"][0] == 2 and per_street["rope walk"] == (1, 334)
    rows = faces.collect()
    assert sorted((r.from_number, r.to_number, r.side, r.door_count) for r in rows if r.street == "The Green") == [("1", "5", "both", 5), ("6", "10", "both", 5)]
    assert sorted((r.from_number, r.to_number, r.side) for r in rows if r.street == "Quay Road") == [("11", "13", "odd"), ("12", "14", "even")]
    lost = [r for r in rows if r.street == "Nowhere Lane"]
    assert sorted(r.side for r in lost) == ["even", "odd"] and all(r.off_network and not r.path for r in lost)
    held = [s.stop_id for r in rows for s in r.stops]
    assert sorted(held) == sorted(r.stop_id for r in built.collect())
    label = next(r.label for r in rows if r.street == "The Green" and r.from_number == "1")
    assert label.startswith("The Green #1-#5 - 5 doors - ")


def test_clipping(spark):
    _, _, faces = green_and_quay(spark)
    wanted = [("part", "sg02"), ("part", "sg03"), ("block", "sg06"), ("block", "sg07"), ("block", "sg08"), ("block", "sg09"), ("block", "sg10")]
    cut = {r.scenario_id: r for r in blockfaces.clip(faces, spark.createDataFrame(wanted, "scenario_id string, stop_id string"), ["scenario_id"]).collect()}
    # from house 2 to house 3 with ten metres of frontage at both ends
    assert cut["part"].clipped and (cut["part"].stop_count, cut["part"].door_count) == (2, 2)
    assert cut["part"].length_m == pytest.approx(4e-4 * 111195 * math.cos(math.radians(10.01)) + 20, abs=1)
    assert not cut["block"].clipped and cut["block"].length_m == pytest.approx(219, abs=1)


def test_long_block_is_cut_in_order(spark):
    ends = [(10.02, 20.02), (10.02, 20.023)]
    doors = row_of_doors("Long Row", (10.0201, 20.02), (0.0, 0.003 / 49), range(101, 151))
    edges = network.span_edges(ways_of(spark, (ends, {"highway": "residential", "name": "Long Row"})))
    parts = sorted(blockfaces.build_blockfaces(stops.build_stops(doors_of(spark, doors)), edges, network.spans(edges)).collect(), key=lambda r: r.blockface_id)
    assert len(parts) >= 2 and max(r.minutes for r in parts) <= 45 * 1.25
    assert [s.number for r in parts for s in r.stops] == [str(n) for n in range(101, 151)]
    assert [r.blockface_id.rsplit("/", 1)[1] for r in parts] == [str(k + 1) for k in range(len(parts))]


def test_arms_of_a_star_have_ids_of_their_own(spark):
    hub = (10.03, 20.03)
    arms = [([hub, tip], {"highway": "residential", "name": "Star Close"}) for tip in ((10.033, 20.027), (10.034, 20.03), (10.033, 20.033))]
    edges = network.span_edges(ways_of(spark, *arms, ([hub, (10.027, 20.03)], {"highway": "residential", "name": "Stem Road"})))
    ids = [r.span_id for r in network.spans(edges).where("street_norm = 'star close'").orderBy("span_ord").collect()]
    base = "star close@10.03000,20.03000"
    assert ids == [base, f"{base}+2", f"{base}+3"]


# plans


def terraces(spark, extra=()):
    """Five streets of eight houses each, 130 m apart."""
    lines, doors = [], []
    for k in range(5):
        lat = 10.04 + 0.0012 * k
        lines.append(([(lat, 20.04), (lat, 20.048)], {"highway": "residential", "name": f"Terrace {k}"}))
        doors += row_of_doors(f"Terrace {k}", (lat + 1e-4, 20.0405), (0.0, 0.001), range(1, 9))
    edges = network.span_edges(ways_of(spark, *lines))
    return blockfaces.build_blockfaces(stops.build_stops(doors_of(spark, doors + list(extra))), edges, network.spans(edges)).cache()


def test_zones_of_a_size(spark):
    faces = terraces(spark, [{"at": (10.2, 20.04), "number": "1", "street": "Hermitage"}])
    plan = zones.build_zones(faces, 16)
    told = zones.plan_summary(plan, faces, 16).first()
    assert (told.total_doors, told.covered_doors, told.dropped_doors) == (41, 40, 1)
    table = zones.zone_table(plan, faces).collect()
    assert sum(z.doors for z in table) == 40 and all(8 <= z.doors <= 32 for z in table)
    assert sorted(z.zone_id for z in table) == [f"z{k:04d}" for k in range(1, len(table) + 1)]
    again = zones.build_zones(faces.repartition(4), 16)
    assert sorted(map(tuple, plan.collect()), key=str) == sorted(map(tuple, again.collect()), key=str)


def test_zones_at_the_extremes(spark):
    faces = terraces(spark)
    assert zones.plan_summary(zones.build_zones(faces, 5000), faces, 5000).first().zone_count == 1
    assert zones.plan_summary(zones.build_zones(faces, 1), faces, 1).first().coverage_pct == 100.0
    with pytest.raises(ValueError):
        zones.build_zones(faces, 0)


def estate(spark, extra=()):
    """Three streets of six blocks, crossed by seven lanes without houses; five houses a block, each block of its own name."""
    lines, doors = [], []
    for j in range(7):
        lines += [([(10.060 + 0.0018 * i, 20.060 + 0.0016 * j), (10.060 + 0.0018 * (i + 1), 20.060 + 0.0016 * j)], {"highway": "residential", "name": f"Cross Lane {j}"}) for i in range(2)]
    for i in range(3):
        for j in range(6):
            lat, lon, name = 10.060 + 0.0018 * i, 20.060 + 0.0016 * j, f"Estate {'ABC'[i]}{j}"
            lines.append(([(lat, lon), (lat, lon + 0.0016)], {"highway": "residential", "name": name}))
            doors += row_of_doors(name, (lat + 1e-4, lon + 0.0002), (0.0, 0.0003), range(1, 6))
    edges = network.span_edges(ways_of(spark, *lines))
    return blockfaces.build_blockfaces(stops.build_stops(doors_of(spark, doors + list(extra))), edges, network.spans(edges))


def test_territories_share_an_estate(spark):
    faces = estate(spark).cache()
    n = faces.count()
    assert n == 18
    asked = spark.createDataFrame([(k, 10.0618, 20.0648, k) for k in (1, 2, 3, 6)], "scenario_id int, lat double, lon double, teams int")
    both = faces.crossJoin(asked.select("scenario_id"))
    plan = territory.build_territories(both, asked)
    for r in plan.groupBy("scenario_id").agg(F.count("*").alias("rows"), F.count_distinct("blockface_id").alias("faces"), F.count_distinct("team").alias("teams"), F.bool_and("contiguous").alias("whole")).collect():
        assert (r.rows, r.faces, r.teams, r.whole) == (n, n, r.scenario_id, True)
    for r in territory.summary(plan, both, asked).collect():
        assert r.spread_pct == 0 if r.teams == 1 else r.spread_pct <= 25
    assert territory.team_table(plan, both, asked).count() == 12
    assert sorted(map(tuple, plan.collect())) == sorted(map(tuple, territory.build_territories(both.repartition(7), asked).collect()))


def test_a_pocket_makes_a_territory_disconnected(spark):
    faces = estate(spark, [{"at": (10.3, 20.3), "number": "9", "street": "Island View"}]).withColumn("scenario_id", F.lit(1))
    one = spark.createDataFrame([(1, 10.0618, 20.0648, 1)], "scenario_id int, lat double, lon double, teams int")
    assert not territory.build_territories(faces, one).agg(F.bool_and("contiguous")).first()[0]


def test_a_street_beyond_a_share_is_cut():
    long_ = [{"blockface_id": f"ave#{k}", "street": "Avenue", "street_norm": "avenue", "side": "both", "from_number": str(2 * k), "k_n": 2 * k, "lat": 10.1, "lon": 20.1 + 8e-4 * k, "minutes": 50.0, "span": f"ave{k}", "has_path": True, "nodes": [(1, k), (1, k + 1)]} for k in range(10)]
    short = {"blockface_id": "mews#0", "street": "Mews", "street_norm": "mews", "side": "both", "from_number": "1", "k_n": 1, "lat": 10.101, "lon": 20.1, "minutes": 15.0, "span": "mews", "has_path": True, "nodes": [(1, 0), (7, 7)]}
    faces = pd.DataFrame([*long_, short])
    plan = territory.partition(faces, (10.1, 20.1035), 4)
    assert sorted(plan.blockface_id) == sorted(faces.blockface_id) and plan.team.nunique() == 4
    assert set(plan[plan.street_cut].blockface_id) == {f"ave#{k}" for k in range(10)}
    alone = territory.partition(faces[faces.street == "Mews"].reset_index(drop=True), (10.1, 20.1), 5)
    assert alone.team.nunique() == 1 and not alone.street_cut.any()


def test_parts_of_a_run():
    minutes = np.array([10.0, 30.0, 10.0, 10.0, 40.0, 5.0])
    run = [0, 1, 2, 3, 4, 5]
    assert territory.parts_of_run(run, minutes, 100.0) == [run] and territory.parts_of_run(run, minutes, 0.0) == [run]
    assert territory.parts_of_run(run, minutes, 50.0) == [[0, 1, 2, 3], [4, 5]]
    assert territory.parts_of_run(run, minutes, 35.0) == [[0, 1], [2, 3, 4], [5]]
    assert territory.parts_of_run(run, minutes, 1.0) == [[k] for k in run]


# sources


def test_snapshot_round_trip_and_reload(spark, village, tmp_path):
    target = str(tmp_path / "copy")
    snapshot.save(village.source, target)
    back = snapshot.load(spark, target)
    for name, key in (("address", "osm_id"), ("way", "osm_id")):
        assert getattr(back, name).orderBy(key).collect() == getattr(village.source, name).orderBy(key).collect()
    other = tmp_path / "other.json"
    other.write_text(json.dumps({"format": 7, "addresses": [], "ways": []}))
    with pytest.raises(Exception, match="snapshot format"):
        snapshot.load(spark, str(other)).meta.collect()
    with pytest.raises(SnapshotMissingError):
        District.open(spark, str(tmp_path / "absent.json.gz"))
    assert village.reload() is False


def test_extract_is_parsed_and_counted(spark, tmp_path):
    def element(kind, number, **more):
        return {"type": kind, "id": number, **more}

    def house(number, street):
        return {"addr:housenumber": number, **({"addr:street": street} if street else {})}

    homes = [element("node", 11, lat=4.0, lon=6.0, tags=house("21", "Fen Lane")), element("way", 12, center={"lat": 4.1, "lon": 6.1}, tags={**house("23", "Fen Lane"), "addr:unit": "top"}), element("node", 13, lat=4.0, lon=6.0, tags=house("25", None)), element("way", 14, tags=house("27", "Fen Lane")), element("node", 15, lat=4.0, lon=6.0)]
    line = [{"lat": 4.0, "lon": 6.0}, {"lat": 4.0, "lon": 6.2}]
    roads = [element("way", 21, tags={"highway": "track", "name": "Drove", "colour": "brown"}, geometry=line), element("way", 22, geometry=line[:1])]
    p, q, r = ({"lat": a, "lon": b} for a, b in ((3.0, 5.0), (3.0, 7.0), (6.0, 6.0)))
    fence = element("relation", 31, tags={"name": "Fenland"}, members=[{"type": "way", "geometry": g} for g in ([q, r], [q, p], [r, p])])
    answers = {"map_to_area": {"highway": roads, "housenumber": homes}}

    def post(url, query):
        found = [fence] if "map_to_area" not in query else next(v for k, v in answers["map_to_area"].items() if k in query)
        return json.dumps({"elements": found}).encode()

    spark.conf.set("spark.sql.session.timeZone", "Asia/Tokyo")
    try:
        taken, counters = overpass.fetch_district(spark, overpass.Client(["only"], post=post), 31, str(tmp_path / "raw"))
        stamp = taken.meta.first().fetched_at
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    from datetime import datetime, timezone

    assert stamp.endswith("+00:00") and abs((datetime.now(timezone.utc) - datetime.fromisoformat(stamp)).total_seconds()) < 120
    assert [r.osm_id for r in taken.address.orderBy("ord").collect()] == ["n11", "w12"]
    assert [(r.osm_id, r.tags) for r in taken.way.collect()] == [(21, {"highway": "track", "name": "Drove"})]
    told = counters.first()
    assert (told.address_elements, told.addresses_kept, told.skipped_no_street, told.skipped_no_position) == (5, 2, 1, 1)
    assert (told.way_elements, told.ways_kept, told.boundary_ways, told.boundary_rings, told.closed_rings) == (2, 1, 3, 1, 1)
    assert taken.meta.first().district_name == "Fenland"


class Server:
    """Answers in turn; an exception is raised."""

    def __init__(self, *answers):
        self.answers, self.asked = list(answers), []

    def __call__(self, url, query):
        self.asked.append(url)
        answer = self.answers.pop(0)
        if isinstance(answer, Exception):
            raise answer
        return answer


def test_client_goes_round_the_mirrors():
    pauses, notes = [], []
    server = Server(b"gateway error", TimeoutError("slow"), b'{"remark": "out of memory"}', b'{"elements": [{"id": 4}]}')
    client = overpass.Client(["x", "y", "z"], wait_s=3, post=server, sleep=pauses.append, note=lambda *a: notes.append(a))
    assert client.elements("?") == [{"id": 4}]
    assert server.asked == ["x", "y", "z", "x"] and pauses == [3, 6, 12]
    assert [n[:2] for n in notes] == [(0, "x"), (1, "y"), (2, "z"), (3, "x")] and "out of memory" in notes[2][2]


def test_client_gives_up():
    pauses = []
    with pytest.raises(overpass.SourceError, match="3 attempts") as failure:
        overpass.Client(["x"], attempts=3, wait_s=2, post=Server(*[OSError(f"no {k}") for k in range(3)]), sleep=pauses.append).raw("?")
    assert pauses == [2, 4] and str(failure.value.__cause__) == "no 2"
    with pytest.raises(ValueError):
        overpass.Client([])


def test_derived_district_conserves(spark):
    own = District.from_tables(spark, SF)
    assert own.addresses.count() == 150 and own.ways.count() == 557
    members = own.faces.select(F.explode("stops").alias("s")).agg(F.count("*"), F.count_distinct("s.stop_id"), F.sum("s.door_count")).first()
    assert members[0] == members[1] == own.stops.count() and members[2] == 150
    hub = spark.createDataFrame([(1, -37.82, 145.01, 800.0)], "hub_id int, lat double, lon double, radius_m double")
    r = reports.hub_preview_crow(hub, own.addresses, own.stops).first()
    assert (r.doors_within, r.streets_within, r.stops_within, r.knock_seconds) == (39, 7, 39, 4095.0)
    own.register_views()
    assert spark.sql("SELECT count(*) FROM blockface WHERE door_count > 0").first()[0] == own.faces.count()
    with pytest.raises(ValueError):
        own.zones(5)
    assert math.isclose(own.coverage().first().knock_hours, round(150 * 105 / 3600, 1), abs_tol=0.11)
