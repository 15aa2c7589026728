"""The registered queries over the derived district, and the same in SQL where SQL can say it.

``QUERIES`` maps a name to a function of (spark, sf_dir); ``ORACLES`` maps a name
to SQL over the same tables. Lengths are rounded to millimetres in both.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kerbside.functions import geo, text
from kerbside.operators import blockfaces, geocode, network, stops, territory, zones
from kerbside.plans import reports
from kerbside.plans.district import District
from kerbside.runtime import cut, prepare, table
from kerbside.sources import district as derived
from kerbside.sources import geojson, snapshot, town

HUBS = ((1, -3.782e1, 1.4501e2, 800.0), (2, -3.783e1, 1.4502e2, 400.0), (3, -3.7752e1, 1.4501e2, 1200.0))
BOX = (-3.783e1, 1.45005e2, -3.781e1, 1.4502e2)
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return f(prepare(spark), sf_dir)

        QUERIES[f.__name__] = run
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def hub_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(HUBS, "hub_id int, lat double, lon double, radius_m double")


_HUB_VALUES = ", ".join(f"({i}, {lat!r}e0, {lon!r}e0, {r!r}e0)" for i, lat, lon, r in HUBS)
_HUBS = f"hubs AS (SELECT * FROM (VALUES {_HUB_VALUES}) t(hub_id, lat, lon, radius_m))"
_DOORS = f"doors AS ({derived.DOORS_SQL})"
_SEGS = f"segs AS ({derived.SEGMENTS_SQL})"
_TOWN = f"segs AS ({town.SEGMENTS_SQL})"
_N = "CAST(round({} * 1e7) AS BIGINT)"


def _dist(a: str, b: str, c: str, d: str) -> str:
    """Haversine in SQL."""
    return f"(2 * 6371000e0 * asin(sqrt(least(1e0, pow(sin((radians({c}) - radians({a})) / 2), 2) + cos(radians({a})) * cos(radians({c})) * pow(sin(radians({d} - {b}) / 2), 2)))))"


def _offset(p: str, s: str) -> str:
    """Metres from point p to segment s in the flat frame."""
    k = f"cos(radians({p}.lat))"
    ax, ay = f"(({s}.a_lon - {p}.lon) * {k})", f"({s}.a_lat - {p}.lat)"
    dx, dy = f"((({s}.b_lon - {p}.lon) * {k}) - {ax})", f"(({s}.b_lat - {p}.lat) - {ay})"
    t = f"greatest(0e0, least(1e0, -({ax} * {dx} + {ay} * {dy}) / ({dx} * {dx} + {dy} * {dy})))"
    return f"(sqrt(pow({ax} + {t} * {dx}, 2) + pow({ay} + {t} * {dy}, 2)) * 111320e0)"


def _share(p: str, s: str) -> str:
    """Where on segment s, from 0 to 1, the foot of point p lies in the flat frame."""
    k = f"cos(radians({p}.lat))"
    ax, ay = f"(({s}.a_lon - {p}.lon) * {k})", f"({s}.a_lat - {p}.lat)"
    dx, dy = f"((({s}.b_lon - {p}.lon) * {k}) - {ax})", f"(({s}.b_lat - {p}.lat) - {ay})"
    return f"greatest(0e0, least(1e0, -({ax} * {dx} + {ay} * {dy}) / ({dx} * {dx} + {dy} * {dy})))"


_FOOT = "(a_lat + {0} * (b_lat - a_lat))", "(a_lon + {0} * (b_lon - a_lon))"


def _to(end: str) -> str:
    """Metres from the foot of p on e to one end of e."""
    foot = [f.format(_share("p", "e")) for f in _FOOT]
    return _dist(*foot, f"{end}_lat", f"{end}_lon")


def _num(n: str) -> str:
    """A node as one number."""
    return f"(({n}.y + 900000000) * 4294967296 + {n}.x + 1800000000)"


#: The walking graph of segs: edges with their lower node first, and steps in both directions.
_EDGES = f"""ends AS (SELECT {{'y': {_N.format("a_lat")}, 'x': {_N.format("a_lon")}}} AS p, {{'y': {_N.format("b_lat")}, 'x': {_N.format("b_lon")}}} AS q FROM segs),
edge AS (SELECT DISTINCT least(p, q) AS a, greatest(p, q) AS b FROM ends WHERE p <> q),
e AS MATERIALIZED (SELECT *, {_dist("a_lat", "a_lon", "b_lat", "b_lon")} AS w FROM (SELECT a, b, a.y / 1e7 AS a_lat, a.x / 1e7 AS a_lon, b.y / 1e7 AS b_lat, b.x / 1e7 AS b_lon FROM edge)),
step AS MATERIALIZED (SELECT {_num('a')} AS p, {_num('b')} AS q, w FROM e UNION ALL SELECT {_num('b')}, {_num('a')}, w FROM e)"""
#: The nearest edge of point p (m, a, b, to_a, to_b), among those beside it.
_NEAREST = f"min({{'m': {_offset('p', 'e')}, 'a': a, 'b': b, 'to_a': {_to('a')}, 'to_b': {_to('b')}}})"
_BESIDE = "least(e.a_lat, e.b_lat) - 3e-3 < p.lat AND greatest(e.a_lat, e.b_lat) + 3e-3 > p.lat AND least(e.a_lon, e.b_lon) - 4e-3 < p.lon AND greatest(e.a_lon, e.b_lon) + 4e-3 > p.lon"


#: Stops in closed form: on this layout 200 m clusters are (street, number), Mary Street split by latitude.
_STOPS = """stops AS (
  SELECT concat('s', min(osm_id)) AS stop_id, street, number, lat > -3.778e1 AS far, avg(lat) AS lat, avg(lon) AS lon, CAST(count(*) AS BIGINT) AS door_count
  FROM doors GROUP BY street, number, lat > -3.778e1)"""


_DISTRICTS: dict[tuple, District] = {}


def _own(spark: SparkSession, sf_dir: str) -> District:
    """One district per application and state of its tables, so that it is built once for all questions."""
    key = (spark.sparkContext.applicationId, sf_dir, *[snapshot.stamp(spark, f"{sf_dir}/{t}.parquet") for t in ("customer", "nation")])
    if key not in _DISTRICTS:
        _DISTRICTS[key] = District.from_tables(spark, sf_dir)
    return _DISTRICTS[key]


# scans, filters, stops


@query(f"WITH {_DOORS} SELECT osm_id, street, number, round(lat, 6) AS lat, round(lon, 6) AS lon FROM doors WHERE lat BETWEEN {BOX[0]!r}e0 AND {BOX[2]!r}e0 AND lon BETWEEN {BOX[1]!r}e0 AND {BOX[3]!r}e0")
def doors_bbox(spark, sf_dir):
    d = reports.in_box(derived.doors(spark, sf_dir), BOX)
    return d.select("osm_id", "street", "number", F.round("lat", 6).alias("lat"), F.round("lon", 6).alias("lon"))


@query(f"WITH {_DOORS}, {_STOPS} SELECT stop_id, street, number, door_count, round(lat, 6) AS lat, round(lon, 6) AS lon, 30e0 + 75e0 * least(door_count, 8) AS dwell_s, door_count >= 8 AS gated FROM stops")
def stops_build(spark, sf_dir):
    s = stops.build_stops(derived.doors(spark, sf_dir))
    return s.select("stop_id", "street", "number", F.col("door_count").cast("long").alias("door_count"), F.round("lat", 6).alias("lat"), F.round("lon", 6).alias("lon"), geo.dwell_seconds(F.col("door_count")).alias("dwell_s"), (F.col("door_count") >= 8).alias("gated"))


@query(f"WITH {_DOORS}, {_STOPS} SELECT stop_id, door_count FROM stops WHERE lat BETWEEN {BOX[0]!r}e0 AND {BOX[2]!r}e0 AND lon BETWEEN {BOX[1]!r}e0 AND {BOX[3]!r}e0")
def stops_bbox(spark, sf_dir):
    return reports.in_box(stops.build_stops(derived.doors(spark, sf_dir)), BOX).select("stop_id", F.col("door_count").cast("long").alias("door_count"))


@query(f"WITH {_DOORS}, {_STOPS} SELECT door_count, count(*) AS stops FROM stops GROUP BY door_count")
def stop_histogram(spark, sf_dir):
    return stops.build_stops(derived.doors(spark, sf_dir)).groupBy(F.col("door_count").cast("long").alias("door_count")).agg(F.count("*").alias("stops"))


@query(f"WITH {_DOORS}, {_STOPS} SELECT stop_id, street, number, door_count FROM stops ORDER BY door_count DESC, street, CAST(number AS BIGINT), stop_id LIMIT 8")
def largest_stops(spark, sf_dir):
    s = stops.build_stops(derived.doors(spark, sf_dir))
    return s.orderBy(F.desc("door_count"), "street", text.natural_key(F.col("number")), "stop_id").limit(8).select("stop_id", "street", "number", F.col("door_count").cast("long").alias("door_count"))


@query(f"WITH {_DOORS} SELECT street, count(*) AS doors FROM doors GROUP BY street ORDER BY doors DESC, min(ord) LIMIT 10")
def top_streets(spark, sf_dir):
    d = derived.doors(spark, sf_dir).groupBy("street").agg(F.count("*").alias("doors"), F.min("ord").alias("first"))
    return d.orderBy(F.desc("doors"), "first").limit(10).select("street", "doors")


@query(f"WITH {_DOORS}, {_STOPS} SELECT round(sum(30e0 + 75e0 * least(door_count, 8)), 3) AS capped_s, round(sum(30e0 + 75e0 * door_count), 3) AS uncapped_s, count(*) AS stops FROM stops")
def dwell_seconds(spark, sf_dir):
    s = stops.build_stops(derived.doors(spark, sf_dir))
    return s.agg(F.round(F.sum(geo.dwell_seconds(F.col("door_count"))), 3).alias("capped_s"), F.round(F.sum(geo.dwell_seconds(F.col("door_count"), None)), 3).alias("uncapped_s"), F.count("*").alias("stops"))


@query(f"WITH {_DOORS} SELECT count(*) AS doors, CAST(93 AS INTEGER) AS doors_per_pair_session, round_even(count(*) / 93e0, 1) AS pair_sessions FROM doors")
def effort_estimate(spark, sf_dir):
    d = derived.doors(spark, sf_dir).agg(F.count("*").alias("doors"))
    return d.select("doors", *reports.effort_columns(F.col("doors")))


@query(f"""WITH {_DOORS}, {_STOPS} SELECT (SELECT count(*) FROM doors) AS doors, (SELECT count(DISTINCT street) FROM doors) AS streets, (SELECT count(*) FROM doors WHERE coalesce(unit, '') <> '') AS doors_with_unit,
  count(*) AS stops, count(*) FILTER (WHERE door_count > 1) AS multi_unit_stops, count(*) FILTER (WHERE door_count >= 8) AS gated_complex_candidates FROM stops""")
def coverage_counts(spark, sf_dir):
    return _own(spark, sf_dir).coverage().select("doors", "streets", "doors_with_unit", "stops", "multi_unit_stops", "gated_complex_candidates")


@query()
def coverage_report(spark, sf_dir):
    return _own(spark, sf_dir).coverage()


# text

_SPELLED = "SELECT n_nationkey AS id, CASE n_nationkey % 5 WHEN 0 THEN concat(upper(n_name), ' ST.') WHEN 1 THEN concat(n_name, ' Rd, VIC 3103') WHEN 2 THEN concat('St ', n_name, ' Ave') WHEN 3 THEN concat(n_name, ' Street Balwyn North') ELSE concat('Victoria ', n_name, '-Gdns Australia') END AS street FROM nation"
_EXPAND = "CASE " + " ".join(f"WHEN t = '{k}' THEN '{v}'" for k, v in text.ABBREVIATIONS.items()) + " ELSE t END"
_WORDS = f"list_transform(list_filter(string_split(trim(regexp_replace(lower(street), '[^a-z0-9 ]+', ' ', 'g')), ' '), lambda t: t <> '' AND t NOT IN ('vic', 'victoria', 'australia', 'aus', 'au') AND NOT regexp_full_match(t, '[0-9]{{4}}')), lambda t: {_EXPAND})".replace("{{", "{").replace("}}", "}")
_NUMBERED = "SELECT o_orderkey AS id, CASE o_orderkey % 4 WHEN 0 THEN concat(CAST(o_orderkey % 50 AS STRING), '-', CAST(o_orderkey % 50 + o_orderkey % 13 AS STRING)) WHEN 1 THEN concat(CAST(o_orderkey % 300 AS STRING), 'B') WHEN 2 THEN CAST(o_orderkey % 90 AS STRING) ELSE concat('Lot ', CAST(o_orderkey % 7 AS STRING)) END AS number FROM orders"


def _spelled(spark, sf_dir):
    return spark.sql(_SPELLED.replace("FROM nation", "FROM {nation}"), nation=table(spark, sf_dir, "nation"))


def _numbered(spark, sf_dir):
    return spark.sql(_NUMBERED.replace("FROM orders", "FROM {orders}"), orders=table(spark, sf_dir, "orders"))


@query(f"WITH s AS ({_SPELLED}) SELECT id, array_to_string({_WORDS}, ' ') AS street_norm FROM s")
def normalise_street(spark, sf_dir):
    return _spelled(spark, sf_dir).select("id", text.normalise_street(F.col("street")).alias("street_norm"))


@query(f"WITH s AS ({_SPELLED}), w AS (SELECT id, {_WORDS} AS w FROM s) SELECT id, CAST(len(w) - n AS BIGINT) AS place, array_to_string(w[1:n], ' ') AS variant FROM w, (SELECT unnest(range(1, 9)) AS n) WHERE n <= len(w)")
def suffix_variants(spark, sf_dir):
    v = _spelled(spark, sf_dir).select("id", F.posexplode(text.suffix_variants(F.col("street"))).alias("place", "variant"))
    return v.withColumn("place", F.col("place").cast("long"))


@query(f"WITH s AS ({_NUMBERED}) SELECT id, regexp_replace(lower(number), '[^a-z0-9]+', '', 'g') AS norm, CASE WHEN coalesce(try_cast(nullif(regexp_extract(number, '^([0-9]+)', 1), '') AS BIGINT), 0) % 2 = 0 THEN 'even' ELSE 'odd' END AS side, coalesce(try_cast(nullif(regexp_extract(number, '^([0-9]+)', 1), '') AS BIGINT), 0) AS sort_n FROM s")
def house_numbers(spark, sf_dir):
    n = F.col("number")
    return _numbered(spark, sf_dir).select("id", text.normalise_number(n).alias("norm"), text.parity(n).alias("side"), text.natural_key(n)["n"].alias("sort_n"))


@query(f"""WITH s AS ({_NUMBERED}), p AS (SELECT id, regexp_replace(lower(number), '[^a-z0-9]+', '', 'g') AS whole, lower(trim(number)) AS t FROM s),
r AS (SELECT *, try_cast(nullif(regexp_extract(t, '^([0-9]+)[a-z]? *- *([0-9]+)[a-z]?$', 1), '') AS BIGINT) AS lo, try_cast(nullif(regexp_extract(t, '^([0-9]+)[a-z]? *- *([0-9]+)[a-z]?$', 2), '') AS BIGINT) AS hi, nullif(regexp_extract(t, '^([0-9]+[a-z]?)', 1), '') AS lead FROM p),
k AS (SELECT id, whole AS key FROM r
  UNION SELECT id, CAST(v AS VARCHAR) FROM (SELECT id, unnest(range(lo, hi + 1, CASE WHEN (hi - lo) % 2 = 0 THEN 2 ELSE 1 END)) AS v FROM r WHERE lo < hi AND hi - lo <= 100)
  UNION SELECT id, lead FROM r WHERE lead IS NOT NULL AND NOT coalesce(lo < hi AND hi - lo <= 100, false)) SELECT id, key FROM k""")
def number_keys(spark, sf_dir):
    return _numbered(spark, sf_dir).select("id", F.explode(text.number_keys(F.col("number"))).alias("key"))


_ASKED = "SELECT id, concat(CASE id % 3 WHEN 0 THEN 'Unit 5, ' WHEN 1 THEN '7/' ELSE '' END, number, ' Harp Road, Melbourne') AS q FROM ({}) s WHERE number NOT LIKE 'Lot%'"


@query(f"""WITH a AS ({_ASKED.format(_NUMBERED)}) SELECT id, CASE id % 3 WHEN 0 THEN '5' WHEN 1 THEN '7' END AS unit,
  regexp_extract(regexp_replace(q, '^(Unit 5, |7/)', ''), '^([0-9]+[A-Za-z]?( *- *[0-9]+[A-Za-z]?)?)', 1) AS number, 'Harp Road' AS street FROM a""")
def parse_query(spark, sf_dir):
    q = spark.sql(_ASKED.format(_NUMBERED).replace("FROM orders", "FROM {orders}"), orders=table(spark, sf_dir, "orders"))
    return q.select("id", text.parse_query(F.col("q")).alias("p")).select("id", "p.unit", "p.number", "p.street")


# geocoding

_QUERIES = (
    "SELECT c_custkey AS qid, concat(CAST(1 + c_custkey % 45 AS STRING), ' Row ', CAST(c_custkey % 17 AS STRING), ' St, Melbourne') AS q FROM customer"
)


def _questions(spark, sf_dir, sql):
    return spark.sql(sql.replace("FROM customer", "FROM {customer}"), customer=table(spark, sf_dir, "customer"))


@query(f"""WITH {_DOORS}, q AS (SELECT c_custkey AS qid, CAST(1 + c_custkey % 45 AS VARCHAR) AS number, concat('Row ', CAST(c_custkey % 17 AS VARCHAR), ' Street') AS street FROM customer)
SELECT qid, street, number, CAST(count(*) AS INTEGER) AS door_count, 'exact' AS match_type, 1e0 AS score, round(avg(d.lat), 6) AS lat, round(avg(d.lon), 6) AS lon FROM q JOIN doors d USING (street, number) GROUP BY qid, street, number""")
def geocode_exact(spark, sf_dir):
    found = geocode.search(_questions(spark, sf_dir, _QUERIES), derived.doors(spark, sf_dir))
    return found.where("match_type = 'exact'").select("qid", "street", "number", "door_count", "match_type", "score", F.round("lat", 6).alias("lat"), F.round("lon", 6).alias("lon"))


_BEYOND = "SELECT c_custkey AS qid, concat(CAST(50 + c_custkey % 9 AS STRING), ' Row ', CAST(c_custkey % 17 AS STRING), ' Street') AS q FROM customer"


@query(f"""WITH {_DOORS}, q AS (SELECT c_custkey AS qid, 50 + c_custkey % 9 AS goal, concat('Row ', CAST(c_custkey % 17 AS VARCHAR), ' Street') AS street FROM customer),
n AS (SELECT street, number, CAST(count(*) AS INTEGER) AS door_count, min(ord) AS first FROM doors GROUP BY street, number),
r AS (SELECT qid, street, number, door_count, row_number() OVER (PARTITION BY qid ORDER BY abs(CAST(number AS BIGINT) - goal), first) AS k FROM q JOIN n USING (street))
SELECT qid, street, number, door_count, 'approximate' AS match_type, 7e-1 AS score FROM r WHERE k <= 3""")
def geocode_nearby_number(spark, sf_dir):
    return geocode.search(_questions(spark, sf_dir, _BEYOND), derived.doors(spark, sf_dir)).select("qid", "street", "number", "door_count", "match_type", "score")


_STREETS = "SELECT DISTINCT c_nationkey AS qid, CASE WHEN c_nationkey % 4 = 0 THEN 'Mary St' ELSE concat('Row ', CAST(c_nationkey % 17 AS STRING), ' Street Balwyn') END AS q FROM customer"


@query(f"""WITH {_DOORS}, q AS (SELECT DISTINCT c_nationkey AS qid, CASE WHEN c_nationkey % 4 = 0 THEN 'Mary Street' ELSE concat('Row ', CAST(c_nationkey % 17 AS VARCHAR), ' Street') END AS street FROM customer),
c AS (SELECT qid, street, lat > -3.778e1 AS far, CAST(count(*) AS INTEGER) AS door_count, max(ord) AS last FROM q JOIN doors USING (street) GROUP BY ALL)
SELECT qid, street, door_count, 'street' AS match_type, round_even(9e-1 - 1e-2 * (row_number() OVER (PARTITION BY qid ORDER BY door_count DESC, last DESC) - 1), 3) AS score FROM c""")
def geocode_street(spark, sf_dir):
    return geocode.search(_questions(spark, sf_dir, _STREETS), derived.doors(spark, sf_dir)).select("qid", "street", "door_count", "match_type", "score")


#: Every 50th customer types a street that is misspelt in one of four ways.
_TYPED = "SELECT c_custkey AS qid, CASE CAST(floor(c_custkey / 50e0) AS BIGINT) % 4 WHEN 0 THEN concat('Rw ', CAST(c_custkey % 17 AS STRING), ' Street') WHEN 1 THEN concat('Roww ', CAST(c_custkey % 13 AS STRING), ' Stret Balwyn') WHEN 2 THEN 'Mery Street' ELSE 'Gohst Roaad' END AS street FROM customer WHERE c_custkey % 50 = 0"
#: Ratcliff and Obershelp: m is the sum over all windows of their longest common block, the first in x and then in y.
_MATCHED = """spot AS (SELECT x, y, i, unnest(range(1, length(y) + 1)) AS j FROM (SELECT x, y, unnest(range(1, length(x) + 1)) AS i FROM pair)),
ext AS MATERIALIZED (SELECT x, y, i, j, max(k) AS n FROM (SELECT *, unnest(range(1, least(length(x) - i, length(y) - j) + 2)) AS k FROM spot) WHERE substr(x, i, k) = substr(y, j, k) GROUP BY ALL),
win AS (
  SELECT x, y, 1 AS al, length(x) + 1 AS ah, 1 AS bl, length(y) + 1 AS bh FROM pair
  UNION ALL
  SELECT x, y, c.al, c.ah, c.bl, c.bh FROM (
    SELECT x, y, unnest([{'al': al, 'ah': -b.i, 'bl': bl, 'bh': -b.j}, {'al': b.k - b.i, 'ah': ah, 'bl': b.k - b.j, 'bh': bh}]) AS c FROM (
      SELECT w.x, w.y, al, ah, bl, bh, max({'k': least(n, ah - i, bh - j), 'i': -i, 'j': -j}) AS b
      FROM win w JOIN ext e ON e.x = w.x AND e.y = w.y AND e.i >= al AND e.i < ah AND e.j >= bl AND e.j < bh GROUP BY ALL)) WHERE c.al < c.ah AND c.bl < c.bh),
block AS (SELECT w.x, w.y, al, bl, max(least(n, ah - i, bh - j)) AS k FROM win w JOIN ext e ON e.x = w.x AND e.y = w.y AND e.i >= al AND e.i < ah AND e.j >= bl AND e.j < bh GROUP BY w.x, w.y, al, ah, bl, bh),
ratio AS (SELECT x, y, 2e0 * sum(k) / (length(x) + length(y)) AS r FROM block GROUP BY x, y)"""


@query(f"""WITH RECURSIVE {_DOORS}, t AS ({_TYPED}), w AS (SELECT qid, {_WORDS} AS w FROM t),
variant AS (SELECT qid, len(w) - n AS place, array_to_string(w[1:n], ' ') AS v FROM w, (SELECT unnest(range(1, 9)) AS n) WHERE n <= len(w)),
st AS (SELECT DISTINCT lower(street) AS s FROM doors),
pair AS (SELECT DISTINCT v AS x, s AS y FROM variant, st WHERE length(v) >= 4 UNION SELECT DISTINCT s, v FROM variant, st WHERE length(v) >= 4), {_MATCHED},
ranked AS (SELECT f.x AS v, f.y AS s, f.r AS score, row_number() OVER (PARTITION BY f.x ORDER BY b.r DESC, f.y DESC) AS n FROM ratio f JOIN ratio b ON b.x = f.y AND b.y = f.x JOIN st ON st.s = f.y WHERE b.r >= 8e-1),
best AS (SELECT qid, s, max(score) AS score, min({{'place': place, 'n': n}}) AS seen FROM variant JOIN ranked USING (v) WHERE n <= 3 GROUP BY qid, s),
top AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, seen) AS n FROM best)
SELECT qid, s AS street_norm, round(score, 6) AS score FROM top WHERE n <= 3""")
def fuzzy_streets(spark, sf_dir):
    asked = _questions(spark, sf_dir, _TYPED)
    found = geocode.resolve_streets(asked, geocode.indexed(derived.doors(spark, sf_dir)))
    return found.where("match_type = 'fuzzy'").select("qid", "street_norm", F.round("score", 6).alias("score"))


@query()
def geocode_fuzzy(spark, sf_dir):
    """Whole candidates for what every 50th customer types."""
    asked = _questions(spark, sf_dir, _TYPED).withColumnRenamed("street", "q")
    return _own(spark, sf_dir).geocode(asked)


_POINTS = "SELECT s_suppkey AS pid, -3.784e1 + (s_suppkey % 37) * 1e-3 + 1.3e-5 AS lat, 1.45e2 + (s_suppkey % 31) * 1.2e-3 + 1.7e-5 AS lon FROM supplier"


def _points(spark, sf_dir):
    return spark.sql(_POINTS.replace("FROM supplier", "FROM {supplier}"), supplier=table(spark, sf_dir, "supplier"))


@query(f"""WITH {_DOORS}, p AS ({_POINTS}), d AS (SELECT p.pid, d.ord, concat(coalesce(unit || '/', ''), number, ' ', street) AS label, {_dist("p.lat", "p.lon", "d.lat", "d.lon")} AS m FROM p CROSS JOIN doors d)
SELECT pid, arg_min(label, {{'m': m, 'ord': ord}}) AS label, round(min(m), 3) AS distance_m FROM d GROUP BY pid""")
def reverse_geocode(spark, sf_dir):
    return geocode.reverse(_points(spark, sf_dir), derived.doors(spark, sf_dir)).select("pid", "label", F.round("distance_m", 3).alias("distance_m"))


@query(f"""WITH {_DOORS}, a AS (SELECT * FROM doors)
SELECT a.osm_id, round(min({_dist("a.lat", "a.lon", "d.lat", "d.lon")}), 3) AS distance_m FROM a JOIN doors d ON a.street <> d.street GROUP BY a.osm_id""")
def nearest_other_street(spark, sf_dir):
    d = derived.doors(spark, sf_dir)
    # doors at one place have one answer
    places = d.groupBy("street", "lat", "lon").agg(F.min("ord").alias("ord"))
    other = geocode.nearest_other_street(places, places)
    back = places.join(other, ["street", "lat", "lon"]).select("street", F.col("lat").alias("y"), F.col("lon").alias("x"), "other")
    near = back.join(places.withColumnRenamed("street", "other"), "other").groupBy("street", "y", "x").agg(F.min(geo.haversine(F.col("y"), F.col("x"), F.col("lat"), F.col("lon"))).alias("m"))
    return d.join(near, (d["street"] == near["street"]) & (d["lat"] == near["y"]) & (d["lon"] == near["x"])).select("osm_id", F.round("m", 3).alias("distance_m"))


# hubs


@query(f"""WITH {_DOORS}, {_STOPS}, {_HUBS},
d AS (SELECT h.hub_id, count(*) AS doors_within, count(DISTINCT street) AS streets_within FROM hubs h JOIN doors d ON {_dist("h.lat", "h.lon", "d.lat", "d.lon")} <= h.radius_m GROUP BY h.hub_id),
s AS (SELECT h.hub_id, count(*) AS stops_within, sum(30e0 + 75e0 * least(door_count, 8)) AS knock_seconds FROM hubs h JOIN stops s ON {_dist("h.lat", "h.lon", "s.lat", "s.lon")} <= h.radius_m GROUP BY h.hub_id)
SELECT h.hub_id, coalesce(doors_within, 0) AS doors_within, coalesce(streets_within, 0) AS streets_within, coalesce(stops_within, 0) AS stops_within, coalesce(knock_seconds, 0e0) AS knock_seconds FROM hubs h LEFT JOIN d USING (hub_id) LEFT JOIN s USING (hub_id)""")
def hub_preview_crow(spark, sf_dir):
    d = derived.doors(spark, sf_dir)
    p = reports.hub_preview_crow(hub_table(spark), d, stops.build_stops(d))
    return p.select("hub_id", "doors_within", "streets_within", "stops_within", "knock_seconds")


@query(f"WITH {_DOORS}, {_HUBS} SELECT h.hub_id, d.osm_id, round({_dist('h.lat', 'h.lon', 'd.lat', 'd.lon')}, 3) AS distance_m FROM hubs h JOIN doors d ON {_dist('h.lat', 'h.lon', 'd.lat', 'd.lon')} <= h.radius_m")
def hub_radius_doors(spark, sf_dir):
    return reports.within(hub_table(spark), derived.doors(spark, sf_dir), ["osm_id"]).select("hub_id", "osm_id", F.round("distance_m", 3).alias("distance_m"))


@query()
def hub_preview_walk(spark, sf_dir):
    return _own(spark, sf_dir).hub_preview(hub_table(spark)).select("hub_id", "inside_district", "nearest_address", "walk.*")


_REACH = f"""WITH RECURSIVE {_SEGS}, {_DOORS}, {_HUBS}, {_EDGES},
door AS MATERIALIZED (SELECT osm_id, {_NEAREST} AS s FROM doors p JOIN e ON {_BESIDE} GROUP BY osm_id),
hub AS MATERIALIZED (SELECT hub_id, radius_m, {_NEAREST} AS s FROM hubs p JOIN e ON {_BESIDE} GROUP BY hub_id, radius_m),
go(hub_id, node, d) USING KEY (hub_id, node) AS (
  SELECT hub_id, node, min(d) FROM (SELECT hub_id, radius_m, {_num('s.a')} AS node, s.to_a AS d FROM hub UNION ALL SELECT hub_id, radius_m, {_num('s.b')}, s.to_b FROM hub) WHERE d <= radius_m GROUP BY hub_id, node
  UNION
  SELECT n.hub_id, n.node, n.d FROM (SELECT g.hub_id, s.q AS node, min(g.d + s.w) AS d FROM go g JOIN step s ON s.p = g.node GROUP BY g.hub_id, s.q) n JOIN hub h ON h.hub_id = n.hub_id
    LEFT JOIN recurring.go o ON o.hub_id = n.hub_id AND o.node = n.node WHERE n.d <= h.radius_m AND (o.d IS NULL OR n.d < o.d)),
way AS (
  SELECT hub_id, osm_id, d + door.s.to_a + door.s.m AS m FROM go JOIN door ON {_num('door.s.a')} = node UNION ALL SELECT hub_id, osm_id, d + door.s.to_b + door.s.m FROM go JOIN door ON {_num('door.s.b')} = node
  UNION ALL SELECT hub_id, osm_id, abs(door.s.to_a - hub.s.to_a) + door.s.m FROM hub JOIN door ON door.s.a = hub.s.a AND door.s.b = hub.s.b),
reach AS (SELECT hub_id, osm_id, min(way.m) + any_value(hub.s.m) AS walk_m FROM way JOIN hub USING (hub_id) WHERE hub.s.m <= 300 GROUP BY hub_id, osm_id, radius_m HAVING min(way.m) + any_value(hub.s.m) <= radius_m)"""


@query(f"{_REACH} SELECT hub_id, osm_id, round(walk_m, 3) AS walk_m FROM reach")
def walk_reach(spark, sf_dir):
    from kerbside.operators import routing

    own = _own(spark, sf_dir)
    found = routing.reach(hub_table(spark).withColumnRenamed("radius_m", "cutoff_m"), own.walk_edges, own.snaps)
    return found.select("hub_id", "osm_id", F.round("walk_m", 3).alias("walk_m"))


@query(f"""{_REACH}, {_STOPS},
d AS (SELECT hub_id, count(*) AS doors_within, count(DISTINCT street) AS streets_within, max(walk_m) AS far FROM reach JOIN doors USING (osm_id) GROUP BY hub_id),
s AS (SELECT hub_id, count(*) AS stops_within, sum(30e0 + 75e0 * least(door_count, 8)) AS secs FROM (
  SELECT DISTINCT hub_id, stop_id, door_count FROM reach JOIN doors d USING (osm_id) JOIN stops ON stops.street = d.street AND stops.number = d.number AND stops.far = (d.lat > -3.778e1)) GROUP BY hub_id)
SELECT h.hub_id, coalesce(doors_within, 0) AS doors_within, coalesce(stops_within, 0) AS stops_within, coalesce(streets_within, 0) AS streets_within,
  round_even(coalesce(secs, 0e0) / 3600, 1) AS knock_hours, round_even(coalesce(far, 0e0) / 80, 1) AS minutes_to_farthest FROM hubs h LEFT JOIN d USING (hub_id) LEFT JOIN s USING (hub_id)""")
def walk_preview(spark, sf_dir):
    """What each hub reaches on foot."""
    found = _own(spark, sf_dir).hub_preview(hub_table(spark)).select("hub_id", "walk.*")
    return found.select("hub_id", "doors_within", "stops_within", "streets_within", "knock_hours", "minutes_to_farthest")


#: Every 50th door to one far away from it.
_TRIPS = "SELECT f.ord AS route_id, f.lat AS from_lat, f.lon AS from_lon, t.lat AS to_lat, t.lon AS to_lon FROM ({0}) f JOIN ({0}) t ON t.ord = CASE WHEN f.ord > 333 THEN f.ord - 333 ELSE f.ord + 17 END WHERE f.ord % 50 = 0"


_WALK = f"""{_EDGES},
point AS (SELECT route_id, 'f' AS side, from_lat AS lat, from_lon AS lon FROM trip UNION ALL SELECT route_id, 't', to_lat, to_lon FROM trip),
near AS (SELECT route_id, side, {_NEAREST} AS s FROM point p JOIN e ON {_BESIDE} GROUP BY route_id, side),
snap AS MATERIALIZED (SELECT f.route_id, f.s AS f, t.s AS t FROM near f JOIN near t USING (route_id) WHERE f.side = 'f' AND t.side = 't' AND f.s.m <= 300 AND t.s.m <= 300),
go(route_id, node, d) USING KEY (route_id, node) AS (
  SELECT route_id, node, min(d) FROM (SELECT route_id, {_num('f.a')} AS node, f.to_a AS d FROM snap UNION ALL SELECT route_id, {_num('f.b')}, f.to_b FROM snap) GROUP BY route_id, node
  UNION
  SELECT n.route_id, n.node, n.d FROM (SELECT g.route_id, s.q AS node, min(g.d + s.w) AS d FROM go g JOIN step s ON s.p = g.node GROUP BY g.route_id, s.q) n
    LEFT JOIN recurring.go o ON o.route_id = n.route_id AND o.node = n.node WHERE o.d IS NULL OR n.d < o.d)"""


_ROUTED = f"""found AS (SELECT route_id, f.m + t.m + least(coalesce(min(d + CASE WHEN g.node = {_num('t.a')} THEN t.to_a ELSE t.to_b END), 'infinity'::DOUBLE), CASE WHEN f.a = t.a AND f.b = t.b THEN abs(f.to_a - t.to_a) ELSE 'infinity'::DOUBLE END) AS m
  FROM snap LEFT JOIN go g USING (route_id) WHERE g.node = {_num('t.a')} OR g.node = {_num('t.b')} OR (f.a = t.a AND f.b = t.b) GROUP BY route_id, f, t)
SELECT route_id, round_even(m, 1) AS distance_m FROM found WHERE m < 'infinity'::DOUBLE"""


@query()
def town_routes(spark, sf_dir):
    """Without SQL: relaxation over the whole town takes DuckDB most of a minute. The same SQL is held against walk_route."""
    from kerbside.operators import routing

    trips = town.over(spark, sf_dir, _TRIPS.format(town.DOORS_SQL))
    return routing.routes(trips, cut(network.walk_edges(town.ways(spark, sf_dir))), points=False).select("route_id", F.bround("distance_m", 1).alias("distance_m"))


@query(f"WITH RECURSIVE {_SEGS}, trip AS ({_TRIPS.format(derived.DOORS_SQL)}), {_WALK}, {_ROUTED}")
def walk_route(spark, sf_dir):
    """Some of the doors are on a road without geometry, and are met from the nearest other one."""
    trips = town.over(spark, sf_dir, _TRIPS.format(derived.DOORS_SQL))
    return _own(spark, sf_dir).routes(trips).select("route_id", "distance_m")


# boundary

_RING = ((-37.845, 144.999), (-37.845, 145.03), (-37.83, 145.02), (-37.815, 145.039), (-37.79, 145.02), (-37.805, 144.999))
_HOLE = ((-37.835, 145.004), (-37.835, 145.009), (-37.825, 145.009), (-37.825, 145.004))


def _edge_values(*rings):
    rows = [(k, *r[i], *r[(i + 1) % len(r)]) for k, r in enumerate(rings) for i in range(len(r))]
    return ", ".join(f"({k}, {a!r}e0, {b!r}e0, {c!r}e0, {d!r}e0)" for k, a, b, c, d in rows)


@query(f"""WITH {_DOORS}, e AS (SELECT * FROM (VALUES {_edge_values(_RING, _HOLE)}) t(ring, a_lat, a_lon, b_lat, b_lon)),
c AS (SELECT d.osm_id, count(*) FILTER (WHERE (e.a_lat > d.lat) <> (e.b_lat > d.lat) AND d.lon < e.a_lon + (d.lat - e.a_lat) / nullif(e.b_lat - e.a_lat, 0) * (e.b_lon - e.a_lon)) AS n FROM doors d CROSS JOIN e GROUP BY d.osm_id)
SELECT osm_id, n % 2 = 1 AS inside FROM c""")
def point_in_district(spark, sf_dir):
    rings = F.array(*[F.array(*[F.struct(F.lit(a).alias("lat"), F.lit(b).alias("lon")) for a, b in r]) for r in (_RING, _HOLE)])
    return derived.doors(spark, sf_dir).select("osm_id", geo.rings_contain(F.col("lat"), F.col("lon"), rings).alias("inside"))


@query(f"""WITH {_DOORS}, b AS (SELECT min(lat) AS s, max(lat) AS n, min(lon) AS w, max(lon) AS e FROM doors)
SELECT round(s, 6) AS south, round(w, 6) AS west, round(n, 6) AS north, round(e, 6) AS east, round({_dist("s", "w", "n", "w")} / 1000, 3) AS km_ns, round({_dist("s", "w", "s", "e")} / 1000, 3) AS km_ew FROM b""")
def boundary_bbox(spark, sf_dir):
    b = derived.doors(spark, sf_dir).agg(F.min("lat").alias("s"), F.max("lat").alias("n"), F.min("lon").alias("w"), F.max("lon").alias("e"))
    s, n, w, e = (F.col(c) for c in "snwe")
    return b.select(F.round(s, 6).alias("south"), F.round(w, 6).alias("west"), F.round(n, 6).alias("north"), F.round(e, 6).alias("east"), F.round(geo.haversine(s, w, n, w) / 1000, 3).alias("km_ns"), F.round(geo.haversine(s, w, s, e) / 1000, 3).alias("km_ew"))


# network

@query(f"""WITH {_SEGS} SELECT least({_N.format("a_lat")}, {_N.format("b_lat")}) AS low_y, count(*) AS edges, round(sum({_dist("a_lat", "a_lon", "b_lat", "b_lon")}), 2) AS metres FROM segs GROUP BY 1""")
def walk_edges(spark, sf_dir):
    e = network.walk_edges(derived.ways(spark, sf_dir))
    return e.groupBy(F.least("a_y", "b_y").alias("low_y")).agg(F.count("*").alias("edges"), F.round(F.sum("length_m"), 2).alias("metres"))


@query(f"WITH {_SEGS}, n AS (SELECT {_N.format('a_lat')} AS y, {_N.format('a_lon')} AS x FROM segs UNION SELECT {_N.format('b_lat')}, {_N.format('b_lon')} FROM segs) SELECT (SELECT count(*) FROM n) AS nodes, (SELECT count(*) FROM segs) AS edges")
def graph_counts(spark, sf_dir):
    return network.graph_counts(network.walk_edges(derived.ways(spark, sf_dir)))


@query(f"""WITH {_SEGS}, n AS (SELECT name, {_N.format("a_lat")} AS y, {_N.format("a_lon")} AS x FROM segs UNION SELECT name, {_N.format("b_lat")}, {_N.format("b_lon")} FROM segs)
SELECT y, x, count(DISTINCT name) AS streets FROM n GROUP BY y, x HAVING count(DISTINCT name) > 1""")
def intersections(spark, sf_dir):
    return network.intersections(derived.ways(spark, sf_dir))


@query(f"""WITH RECURSIVE {_SEGS}, s AS (SELECT osm_id, name, highway, a_lat, a_lon, b_lat, b_lon, {_N.format("a_lat")} AS ay, {_N.format("a_lon")} AS ax, {_N.format("b_lat")} AS by_, {_N.format("b_lon")} AS bx FROM segs),
n AS (SELECT name, ay AS y, ax AS x, osm_id FROM s UNION ALL SELECT name, by_, bx, osm_id FROM s),
brk AS (SELECT y, x FROM n GROUP BY y, x HAVING count(DISTINCT name) > 1),
link AS (SELECT DISTINCT p.osm_id AS a, q.osm_id AS b FROM n p JOIN n q ON p.y = q.y AND p.x = q.x AND p.name = q.name LEFT JOIN brk ON brk.y = p.y AND brk.x = p.x WHERE brk.y IS NULL),
comp AS (SELECT osm_id AS a, osm_id AS root FROM s UNION SELECT l.b, c.root FROM comp c JOIN link l ON l.a = c.a),
span AS (SELECT a AS osm_id, min(root) AS span FROM comp GROUP BY a)
SELECT lower(s.name) AS street_norm, CAST(count(*) AS INTEGER) AS edge_count, round(sum({_dist("a_lat", "a_lon", "b_lat", "b_lon")}), 2) AS length_m, bool_or(highway = 'primary') AS busy, max(highway = 'primary') AS top FROM s JOIN span USING (osm_id) GROUP BY span, lower(s.name)""".replace(", max(highway = 'primary') AS top", ""))
def spans(spark, sf_dir):
    s = network.spans(network.span_edges(derived.ways(spark, sf_dir)))
    return s.select("street_norm", "edge_count", F.round("length_m", 2).alias("length_m"), "busy")


@query(f"""WITH RECURSIVE {_TOWN}, s AS (SELECT *, lower(name) AS street, {_N.format("a_lat")} AS ay, {_N.format("a_lon")} AS ax, {_N.format("b_lat")} AS zy, {_N.format("b_lon")} AS zx, ord * 1048576 + seg AS k FROM segs),
n AS (SELECT street, ay AS y, ax AS x, k FROM s UNION ALL SELECT street, zy, zx, k FROM s),
brk AS (SELECT y, x FROM n GROUP BY y, x HAVING count(DISTINCT street) > 1),
free AS (SELECT n.* FROM n ANTI JOIN brk USING (y, x)),
link AS (SELECT DISTINCT p.k AS a, q.k AS b FROM free p JOIN free q USING (y, x)),
comp AS (SELECT k AS a, k AS root FROM s UNION SELECT l.b, c.root FROM comp c JOIN link l ON l.a = c.a),
root AS (SELECT a AS k, min(root) AS root FROM comp GROUP BY a),
e AS (SELECT s.*, root.root, least({{'y': ay, 'x': ax}}, {{'y': zy, 'x': zx}}) AS low, greatest({{'y': ay, 'x': ax}}, {{'y': zy, 'x': zx}}) AS high FROM s JOIN root USING (k)),
run AS (SELECT street, root, min({{'l': low, 'h': high}}) AS place, min(k) AS k, count(*) AS edge_count, sum({_dist("a_lat", "a_lon", "b_lat", "b_lon")}) AS m, max({{'busy': highway IN ('primary', 'secondary'), 'h': highway}}) AS top,
  list(osm_id ORDER BY k) AS ways FROM e GROUP BY street, root),
named AS (SELECT *, street || '@' || format('{{:.5f}},{{:.5f}}', place.l.y / 1e7, place.l.x / 1e7) AS base FROM run),
done AS (SELECT *, row_number() OVER (PARTITION BY base ORDER BY place, k) AS nth, list_filter(ways, lambda w, i: list_position(ways, w) = i) AS used FROM named)
SELECT CASE WHEN nth = 1 THEN base ELSE base || '+' || nth END AS span_id, CAST(edge_count AS INTEGER) AS edge_count, round(m, 2) AS length_m, top.h AS highway, array_to_string(used, ',') AS way_ids FROM done""")
def town_spans(spark, sf_dir):
    """Spans of the growing town, with their ids and the ways they use; one street of it is as long as the table."""
    s = network.spans(network.span_edges(town.ways(spark, sf_dir), F.lower))
    return s.select("span_id", "edge_count", F.round("length_m", 2).alias("length_m"), "highway", F.array_join(F.col("way_ids").cast("array<string>"), ",").alias("way_ids"))


@query(f"WITH {_SEGS} SELECT lower(name) AS street_norm, bool_or(highway = 'primary') AS busy, CASE WHEN bool_or(highway = 'primary') THEN 'primary' ELSE 'residential' END AS highway FROM segs GROUP BY lower(name)")
def street_busy(spark, sf_dir):
    s = network.spans(network.span_edges(derived.ways(spark, sf_dir)))
    return s.groupBy("street_norm").agg(F.bool_or("busy").alias("busy"), network.busiest().alias("highway"))


@query(f"""WITH {_DOORS}, {_SEGS}, {_EDGES}, near AS (SELECT osm_id, {_NEAREST} AS s FROM doors p JOIN e ON {_BESIDE} GROUP BY osm_id)
SELECT osm_id, round(s.m, 3) AS offset_m, s.a.y AS a_y, s.a.x AS a_x, s.b.y AS b_y, s.b.x AS b_x, round(s.to_a, 2) AS to_a_m FROM near WHERE s.m <= 300""")
def edge_snap(spark, sf_dir):
    s = network.edge_snaps(derived.doors(spark, sf_dir), network.walk_edges(derived.ways(spark, sf_dir)), ["osm_id"])
    return s.select("osm_id", F.round("offset_m", 3).alias("offset_m"), "a_y", "a_x", "b_y", "b_x", F.round("to_a_m", 2).alias("to_a_m"))


@query(f"""WITH d AS ({town.DOORS_SQL}), {_TOWN}, {_EDGES}, near AS (SELECT osm_id, {_NEAREST} AS s FROM d p JOIN e ON {_BESIDE} GROUP BY osm_id)
SELECT osm_id, round(s.m, 3) AS offset_m, s.a.y AS a_y, s.a.x AS a_x, s.b.y AS b_y, s.b.x AS b_x FROM near WHERE s.m <= 300""")
def town_snaps(spark, sf_dir):
    """The nearest edge of every door of the growing town."""
    s = network.edge_snaps(town.doors(spark, sf_dir), network.walk_edges(town.ways(spark, sf_dir)), ["osm_id"])
    return s.select("osm_id", F.round("offset_m", 3).alias("offset_m"), "a_y", "a_x", "b_y", "b_x")


@query(f"""WITH {_DOORS}, {_STOPS}, {_SEGS}, o AS (SELECT p.stop_id, {_offset("p", "s")} AS m FROM stops p JOIN segs s ON p.street = s.name)
SELECT stop_id, round(min(m), 3) AS offset_m FROM o GROUP BY stop_id HAVING min(m) <= 300""")
def stop_span(spark, sf_dir):
    s = network.stop_spans(stops.build_stops(derived.doors(spark, sf_dir)), network.span_edges(derived.ways(spark, sf_dir)))
    return s.select("stop_id", F.round("offset_m", 3).alias("offset_m"))


@query(f"""WITH {_DOORS}, {_STOPS} SELECT a.stop_id AS a, b.stop_id AS b FROM stops a JOIN stops b ON a.stop_id < b.stop_id AND {_dist("a.lat", "a.lon", "b.lat", "b.lon")} <= 250""")
def proximity_pairs(spark, sf_dir):
    s = stops.build_stops(derived.doors(spark, sf_dir))
    near = reports.within(s.select(F.col("stop_id").alias("hub_id"), "lat", "lon", F.lit(250.0).alias("radius_m")), s, ["stop_id"])
    return near.where("hub_id < stop_id").select(F.col("hub_id").alias("a"), F.col("stop_id").alias("b"))


@query(f"""WITH {_SEGS}, n AS (SELECT osm_id, {_N.format("a_lat")} AS y, {_N.format("a_lon")} AS x FROM segs UNION ALL SELECT osm_id, {_N.format("b_lat")}, {_N.format("b_lon")} FROM segs)
SELECT DISTINCT p.osm_id AS a, q.osm_id AS b FROM n p JOIN n q ON p.y = q.y AND p.x = q.x AND p.osm_id < q.osm_id""")
def node_adjacency(spark, sf_dir):
    s = network.segments(derived.ways(spark, sf_dir))
    n = s.select("osm_id", F.explode(F.array(*[F.struct(F.col(f"{e}_y").alias("y"), F.col(f"{e}_x").alias("x")) for e in "ab"])).alias("n"))
    return n.toDF("a", "n").join(n.toDF("b", "n"), "n").where("a < b").select("a", "b").distinct()


# faces, zones, territories


@query()
def blockface_table(spark, sf_dir):
    return blockfaces.payload(_own(spark, sf_dir).faces)


#: On the rows of the lattice a face is a block, or one side of it where the row is busy: three stops to a block.
@query(f"""WITH {_DOORS}, {_STOPS}, {_SEGS},
b AS (SELECT *, lower(name) || '@' || format('{{:.5f}},{{:.5f}}', {_N.format("a_lat")} / 1e7, least({_N.format("a_lon")}, {_N.format("b_lon")}) / 1e7) AS span_id FROM segs WHERE name LIKE 'Row %'),
m AS (SELECT b.span_id, b.highway, {_dist("b.a_lat", "b.a_lon", "b.b_lat", "b.b_lon")} AS length, CAST(s.number AS BIGINT) AS n, s.door_count,
  CASE WHEN b.highway <> 'primary' THEN 'both' WHEN CAST(s.number AS BIGINT) % 2 = 0 THEN 'even' ELSE 'odd' END AS side
  FROM stops s JOIN b ON b.name = s.street AND s.lon > b.a_lon AND s.lon < b.b_lon)
SELECT span_id || '#' || side AS blockface_id, side, side <> 'both' AS one_side_per_pass, highway, CAST(min(n) AS VARCHAR) AS from_number, CAST(max(n) AS VARCHAR) AS to_number, CAST(count(*) AS INTEGER) AS stop_count, CAST(sum(door_count) AS INTEGER) AS door_count,
  round(length, 2) AS length_m, round(sum(30e0 + 75e0 * least(door_count, 8)) / 60 + length / 80, 3) AS minutes FROM m GROUP BY span_id, side, highway, length""")
def lattice_faces(spark, sf_dir):
    f = _own(spark, sf_dir).faces.where("street LIKE 'Row %'")
    return f.select("blockface_id", "side", "one_side_per_pass", "highway", "from_number", "to_number", F.col("stop_count").cast("int").alias("stop_count"), F.col("door_count").cast("int").alias("door_count"), F.round("length_m", 2).alias("length_m"), F.round("minutes", 3).alias("minutes"))


@query(f"WITH {_DOORS}, {_STOPS} SELECT stop_id, CAST(1 AS BIGINT) AS faces, door_count AS doors FROM stops")
def blockface_membership(spark, sf_dir):
    """Each stop in exactly one face, with all its doors."""
    f = _own(spark, sf_dir).faces.select("blockface_id", F.explode("stops").alias("s"))
    return f.groupBy("s.stop_id").agg(F.count_distinct("blockface_id").alias("faces"), F.sum("s.door_count").alias("doors"))


@query()
def blockfaces_bbox(spark, sf_dir):
    rows, _ = _own(spark, sf_dir).blockface_rows(BOX)
    return blockfaces.payload(rows)


@query(f"""WITH {_DOORS}, {_STOPS}, {_HUBS} SELECT h.hub_id AS scenario_id, count(*) AS stops FROM hubs h JOIN stops s ON {_dist("h.lat", "h.lon", "s.lat", "s.lon")} <= h.radius_m GROUP BY h.hub_id""")
def clip_blockfaces(spark, sf_dir):
    faces = _own(spark, sf_dir).session(hub_table(spark).withColumnRenamed("hub_id", "scenario_id"))
    return faces.groupBy("scenario_id").agg(F.sum("stop_count").alias("stops"))


@query()
def zone_plan(spark, sf_dir):
    own = _own(spark, sf_dir)
    return zones.zone_table(own.zones(100), own.faces)


@query(f"""WITH {_DOORS}, {_STOPS} SELECT osm_id FROM doors""")
def zone_conservation(spark, sf_dir):
    """Every door, through the stops of the faces that zones keep or drop, exactly once."""
    own = _own(spark, sf_dir)
    inside = own.zones(100).select("blockface_id").join(own.faces.select("blockface_id", F.explode("stops").alias("s")), "blockface_id")
    return inside.select(F.explode("s.door_ids").alias("osm_id"))


_BISECTED = 60


@query(f"""WITH RECURSIVE d AS ({town.DOORS_SQL}),
t AS (
  SELECT osm_id, '' AS leaf, row_number() OVER (ORDER BY street, CAST(number AS BIGINT), number, osm_id) AS seq, 1 + ord % 5 AS doors, lat, lon FROM d
  UNION ALL
  SELECT osm_id, leaf || CASE WHEN k = 1 OR (before < total * floor(parts / 2e0) / parts AND k < size) THEN '0' ELSE '1' END, k, doors, lat, lon FROM (
    SELECT *, row_number() OVER (PARTITION BY leaf ORDER BY v, seq) AS k, sum(doors) OVER (PARTITION BY leaf ORDER BY v, seq) - doors AS before FROM (
      SELECT *, CASE WHEN (n - s) * 111320e0 >= (e - w) * 111320e0 * cos(radians((s + n) / 2)) THEN lat ELSE lon END AS v FROM (
        SELECT *, count(*) OVER p AS size, sum(doors) OVER p AS total, greatest(1, round_even(sum(doors) OVER p / {_BISECTED}e0, 0)) AS parts,
          min(lat) OVER p AS s, max(lat) OVER p AS n, min(lon) OVER p AS w, max(lon) OVER p AS e FROM t WINDOW p AS (PARTITION BY leaf))) WHERE parts > 1 AND size > 1)),
l AS (SELECT leaf, count(*) AS faces, CAST(sum(doors) AS BIGINT) AS doors, string_agg(osm_id, ',' ORDER BY osm_id) AS ids FROM t GROUP BY leaf)
SELECT leaf, faces, doors, sha256(ids) AS ids_sha256 FROM l WHERE NOT (round_even(doors / {_BISECTED}e0, 0) > 1 AND faces > 1)""")
def bisection(spark, sf_dir):
    """The growing town's doors cut into leaves of about 60 residents, as faces of one door each."""
    faces = town.doors(spark, sf_dir).select(F.col("osm_id").alias("blockface_id"), "street", F.col("number").alias("from_number"), F.lit("both").alias("side"), "lat", "lon", (1 + F.col("ord") % 5).alias("door_count"))
    leaves = zones.split(faces, _BISECTED).groupBy("leaf").agg(F.count("*").alias("faces"), F.sum("door_count").alias("doors"), F.array_sort(F.collect_list("blockface_id")).alias("ids"))
    return leaves.select("leaf", "faces", "doors", F.sha2(F.array_join("ids", ",").cast("binary"), 256).alias("ids_sha256"))


@query()
def zone_split_streets(spark, sf_dir):
    own = _own(spark, sf_dir)
    return zones.split_streets(own.zones(100), own.faces)


@query(f"""WITH d AS ({town.DOORS_SQL}), c AS (SELECT street, 1 + ord % 5 AS residents, row_number() OVER (PARTITION BY street ORDER BY 1 + ord % 5) AS k, count(*) OVER (PARTITION BY street) AS n FROM d)
SELECT street, min(residents) AS least, CAST(max(residents) FILTER (WHERE k = n // 2 + 1) AS DOUBLE) AS upper_median, max(residents) AS most FROM c GROUP BY street""")
def street_sizes(spark, sf_dir):
    rows = town.doors(spark, sf_dir).select("street", (1 + F.col("ord") % 5).alias("residents"))
    return reports.sizes(rows, "residents", ["street"]).withColumn("upper_median", F.col("upper_median").cast("double"))


@query(f"""WITH {_DOORS}, {_SEGS}, s AS (SELECT DISTINCT street FROM doors)
SELECT lower(street) AS street_norm, bool_or(highway = 'primary') AS busy, coalesce(CASE WHEN bool_or(highway = 'primary') THEN 'primary' ELSE max(highway) END, '') AS highway FROM s LEFT JOIN segs ON segs.name = street GROUP BY street""")
def street_busyness(spark, sf_dir):
    """Every street that has a door: busy, not busy, or unknown where it has no geometry."""
    streets = geocode.indexed(derived.doors(spark, sf_dir)).select("street_norm").distinct()
    return network.street_busyness(streets, network.spans(network.span_edges(derived.ways(spark, sf_dir))))


def _scenarios(spark):
    return hub_table(spark).withColumnRenamed("hub_id", "scenario_id").withColumn("teams", F.col("scenario_id") + 2)


@query()
def territories(spark, sf_dir):
    _, teams = _own(spark, sf_dir).territories(_scenarios(spark))
    return teams


@query()
def territory_summary(spark, sf_dir):
    faces, teams = _own(spark, sf_dir).territories(_scenarios(spark))
    return territory.summary(teams, faces, _scenarios(spark))


@query(f"WITH {_DOORS} SELECT osm_id AS id, 'Point' AS kind, round(lon, 6) AS lon, round(lat, 6) AS lat, number, street FROM doors")
def geojson_points(spark, sf_dir):
    d = derived.doors(spark, sf_dir)
    f = geojson.features(d, F.col("osm_id"), geojson.point(F.col("lat"), F.col("lon")), [F.col("number"), F.col("street")])
    at = lambda p: F.get_json_object("feature", p)
    return f.select(at("$.id").alias("id"), at("$.geometry.type").alias("kind"), F.round(at("$.geometry.coordinates[0]").cast("double"), 6).alias("lon"), F.round(at("$.geometry.coordinates[1]").cast("double"), 6).alias("lat"), at("$.properties.number").alias("number"), at("$.properties.street").alias("street"))


@query()
def geojson_zones(spark, sf_dir):
    return _own(spark, sf_dir).zone_features(100)
