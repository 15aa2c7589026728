"""District snapshots, as one JSON document (gzip or plain) or as Parquet tables with a manifest; and parsers of map extracts."""

from __future__ import annotations

import json
import re
import uuid
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kerbside.functions import geo
from kerbside.operators import kernels

FORMAT = 1
# The tags of a way that are kept, and the road classes that are asked for.
TAGS = ("highway", "name", "foot", "access", "sidewalk", "footway", "width", "lanes", "maxspeed", "surface", "service", "tunnel", "bridge", "crossing", "barrier", "dual_carriageway", "junction")
WALKABLE = ("residential", "footway", "path", "pedestrian", "living_street", "service", "unclassified", "tertiary", "tertiary_link", "secondary", "secondary_link", "primary", "primary_link", "steps", "track", "cycleway", "road")

POINT = "struct<lat:double,lon:double>"
DOCUMENT = (
    "format int, meta struct<district_name:string,relation_id:bigint,fetched_at:string,boundary_source:string>, boundary struct<rings:array<array<array<double>>>>, "
    "addresses array<struct<id:string,lat:double,lon:double,number:string,street:string,unit:string,postcode:string>>, "
    "ways array<struct<id:bigint,tags:map<string,string>,geometry:array<array<double>>>>"
)
ELEMENTS = (
    "remark string, elements array<struct<type:string,id:bigint,lat:double,lon:double,center:struct<lat:double,lon:double>,tags:map<string,string>,"
    "geometry:array<struct<lat:double,lon:double>>,members:array<struct<type:string,ref:bigint,role:string,geometry:array<struct<lat:double,lon:double>>>>>>"
)


@dataclass
class Snapshot:
    """meta (one row), rings (ring_ord, ring), address, way."""

    meta: DataFrame
    rings: DataFrame
    address: DataFrame
    way: DataFrame


def _points(pairs: Column) -> Column:
    return F.transform(pairs, lambda p: F.struct(p[0].alias("lat"), p[1].alias("lon")))


def _pairs(points: Column) -> Column:
    return F.transform(points, lambda p: F.array(p["lat"], p["lon"]))


def stamp(spark: SparkSession, path: str) -> tuple | None:
    """What tells one state of the files at a path from another, in any file system that Spark reads; None if nothing is there."""
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(at):
        return None
    return tuple(sorted((f.getPath().toString(), f.getLen(), f.getModificationTime()) for f in (fs.listStatus(at) if fs.isDirectory(at) else [fs.getFileStatus(at)])))


def _files(spark: SparkSession, path: str):
    """The Hadoop file system of a path, and a maker of its paths."""
    make = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    return make(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), make


def manifests(spark: SparkSession, folder: str) -> list[tuple[int, dict]]:
    """Numbers and contents of the whole manifests of a folder, the latest first. One that was cut short does not count."""
    fs, make = _files(spark, folder)
    if not fs.exists(make(folder)):
        return []
    found = []
    for f in fs.listStatus(make(folder)):
        if m := re.fullmatch(r"manifest-(\d+)\.json", f.getPath().getName()):
            text = spark.read.text(f.getPath().toString(), wholetext=True).first()
            try:
                found.append((int(m[1]), json.loads(text["value"]) if text else None))
            except ValueError:
                continue
    return sorted(((n, told) for n, told in found if told and told.get("format") == FORMAT and "version" in told), key=lambda x: -x[0])


def save_tables(s: Snapshot, folder: str, keep: int = 2) -> int:
    """Write the tables as Parquet, each from its own tasks, and then a manifest that names them; returns its number.

    Readers see the tables of the latest whole manifest, so a save that breaks
    off changes nothing for them. Addresses and ways lie in the order of their
    places, so that a box reads few of the files. Older versions but the last
    ``keep`` are deleted.
    """
    spark = s.address.sparkSession
    before = manifests(spark, folder)
    version = f"version-{uuid.uuid4().hex}"
    first = F.get("geometry", F.lit(0))
    rows = {
        "meta": s.meta,
        "ring": s.rings,
        "address": s.address.repartitionByRange(F.floor(F.col("lat") * 20), F.floor(F.col("lon") * 20)).sortWithinPartitions("lat", "lon"),
        "way": s.way.repartitionByRange(F.floor(first["lat"] * 20), F.floor(first["lon"] * 20)),
    }
    for name, df in rows.items():
        df.write.parquet(f"{folder}/{version}/{name}")
    fs, make = _files(spark, folder)
    taken = [int(m[1]) for f in fs.listStatus(make(folder)) if (m := re.fullmatch(r"manifest-(\d+)\.json", f.getPath().getName()))]
    number = max(taken, default=0) + 1  # those that were cut short count too
    out = fs.create(make(f"{folder}/manifest-{number}.json"), False)  # fails if another save has taken the number
    out.write(bytearray(json.dumps({"format": FORMAT, "version": version}).encode()))
    out.close()
    for n, told in before[keep - 1 :]:
        fs.delete(make(f"{folder}/manifest-{n}.json"), False)
        fs.delete(make(f"{folder}/{told['version']}"), True)
    return number


def load(spark: SparkSession, path: str) -> Snapshot:
    """Read a snapshot: the tables of a folder's latest manifest, or else a document. A document of another format fails when it is read."""
    if found := manifests(spark, path):
        return Snapshot(*[spark.read.parquet(f"{path}/{found[0][1]['version']}/{name}") for name in ("meta", "ring", "address", "way")])
    doc = spark.read.schema(DOCUMENT).option("multiLine", True).json(path)
    gate = F.assert_true(F.coalesce(F.col("format") == FORMAT, F.lit(False)), F.lit("unsupported snapshot format"))
    doc = doc.where(gate.isNull())
    address = doc.select(F.posexplode("addresses").alias("ord", "a")).select(F.col("a.id").alias("osm_id"), F.col("ord").cast("long").alias("ord"), "a.lat", "a.lon", "a.number", "a.street", F.nullif("a.unit", F.lit("")).alias("unit"), F.nullif("a.postcode", F.lit("")).alias("postcode"))
    way = doc.select(F.posexplode("ways").alias("ord", "w")).select(F.col("ord").cast("long").alias("ord"), F.col("w.id").alias("osm_id"), _points(F.col("w.geometry")).alias("geometry"), "w.tags")
    meta = doc.select("meta.district_name", "meta.relation_id", "meta.fetched_at", F.coalesce("meta.boundary_source", F.lit("osm")).alias("boundary_source"))
    rings = doc.select(F.posexplode("boundary.rings").alias("ring_ord", "r")).select("ring_ord", _points(F.col("r")).alias("ring"))
    return Snapshot(meta, rings, address, way)


def document(s: Snapshot) -> DataFrame:
    """The one-row DataFrame of a snapshot's document."""
    address = s.address.agg(F.array_sort(F.collect_list(F.struct("ord", F.col("osm_id").alias("id"), "lat", "lon", "number", "street", F.nullif("unit", F.lit("")).alias("unit"), F.nullif("postcode", F.lit("")).alias("postcode")))).alias("addresses"))
    way = s.way.agg(F.array_sort(F.collect_list(F.struct("ord", F.col("osm_id").alias("id"), F.to_json("tags").alias("tags"), _pairs(F.col("geometry")).alias("geometry")))).alias("ways"))
    rings = s.rings.agg(F.struct(F.transform(F.array_sort(F.collect_list(F.struct("ring_ord", "ring"))), lambda r: _pairs(r["ring"])).alias("rings")).alias("boundary"))
    meta = s.meta.select(F.struct("district_name", "relation_id", "fetched_at", "boundary_source").alias("meta"))
    rows = meta.crossJoin(rings).crossJoin(address).crossJoin(way)
    tags = "map<string,string>"
    return rows.select(
        F.lit(FORMAT).alias("format"),
        "meta",
        "boundary",
        F.transform("addresses", lambda a: a.dropFields("ord")).alias("addresses"),
        F.transform("ways", lambda w: F.struct(w["id"].alias("id"), F.from_json(w["tags"], tags).alias("tags"), w["geometry"].alias("geometry"))).alias("ways"),
    )


def save(s: Snapshot, path: str) -> None:
    """Write the document as gzipped JSON; Spark's committer makes it appear whole or not at all."""
    document(s).coalesce(1).write.mode("overwrite").option("compression", "gzip").json(path)


def read_elements(spark: SparkSession, path: str) -> DataFrame:
    """Elements of saved responses. A body that is no JSON, or carries a remark, fails: its content may be cut short."""
    doc = spark.read.schema(ELEMENTS + ", _corrupt_record string").option("multiLine", True).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt_record").json(path)
    bad = F.col("_corrupt_record").isNotNull() | (F.coalesce("remark", F.lit("")) != "")
    gate = F.assert_true(~bad, F.concat(F.lit("bad response: "), F.coalesce("remark", F.lit("not valid JSON"))))
    return doc.where(gate.isNull()).select(F.posexplode(F.coalesce("elements", F.array().cast(doc.schema["elements"].dataType))).alias("ord", "e")).select(F.col("ord").cast("long").alias("ord"), "e.*")


def position() -> Column:
    own = F.struct("lat", "lon")
    return F.when((F.col("type") == "node") & F.col("lat").isNotNull(), own).when(F.col("center").isNotNull(), F.col("center"))


def _tag(name: str) -> Column:
    return F.nullif(F.try_element_at("tags", F.lit(name)), F.lit(""))


def parse_addresses(elements: DataFrame) -> DataFrame:
    """Elements with a number, a street and a position as addresses."""
    rows = elements.withColumn("at", position()).where(_tag("addr:housenumber").isNotNull() & _tag("addr:street").isNotNull() & F.col("at").isNotNull())
    return rows.select(F.concat(F.substring("type", 1, 1), F.col("id").cast("string")).alias("osm_id"), "ord", "at.lat", "at.lon", _tag("addr:housenumber").alias("number"), _tag("addr:street").alias("street"), _tag("addr:unit").alias("unit"), _tag("addr:postcode").alias("postcode"))


def parse_ways(elements: DataFrame) -> DataFrame:
    """Elements of at least two points as ways, with the tags that are kept."""
    keep = F.map_filter(F.coalesce("tags", F.create_map().cast("map<string,string>")), lambda k, v: k.isin(*TAGS))
    return elements.where(F.size("geometry") >= 2).select("ord", F.col("id").alias("osm_id"), "geometry", keep.alias("tags"))


def parse_boundary(elements: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(name, rings) of the first relation: its member ways stitched into rings."""
    first = elements.where(F.col("type") == "relation").orderBy("ord").limit(1)
    name = first.select("id", F.coalesce(_tag("name"), F.lit("Unknown district")).alias("district_name"))
    lines = first.select(F.filter("members", lambda m: (m["type"] == "way") & (F.size(m["geometry"]) > 0)).alias("m")).select(F.transform("m", lambda m: m["geometry"]).alias("lines"))
    return name, lines.select(F.posexplode(stitched("lines")).alias("ring_ord", "ring"))


def stitched(lines: str) -> Column:
    """Unordered lines in any direction joined end to end."""

    @F.pandas_udf(f"array<array<{POINT}>>")
    def join(column: pd.Series) -> pd.Series:
        def key(p):
            return round(p[0], 7), round(p[1], 7)

        return column.map(lambda rows: [[{"lat": p[0], "lon": p[1]} for p in c] for c in kernels.chains([[(p["lat"], p["lon"]) for p in line] for line in rows], key)])

    return join(lines)


def ingest_counters(boundary: DataFrame, addresses: DataFrame, ways: DataFrame) -> DataFrame:
    """One row of what an ingest saw, kept and skipped."""
    number, street = _tag("addr:housenumber").isNotNull(), _tag("addr:street").isNotNull()
    a = addresses.withColumn("at", position()).agg(F.count("*").alias("address_elements"), F.count_if(number & street & F.col("at").isNotNull()).alias("addresses_kept"), F.count_if(number & ~street).alias("skipped_no_street"), F.count_if(number & street & F.col("at").isNull()).alias("skipped_no_position"))
    w = ways.agg(F.count("*").alias("way_elements"), F.count_if(F.size("geometry") >= 2).alias("ways_kept"))
    _, rings = parse_boundary(boundary)
    members = boundary.where(F.col("type") == "relation").orderBy("ord").limit(1).agg(F.coalesce(F.sum(F.size(F.filter("members", lambda m: (m["type"] == "way") & (F.size(m["geometry"]) > 0)))), F.lit(0)).alias("boundary_ways"))
    r = rings.agg(F.count("*").alias("boundary_rings"), F.count_if(geo.ring_is_closed(F.col("ring"))).alias("closed_rings"))
    rows = members.crossJoin(r).crossJoin(a).crossJoin(w)
    notes = F.array_compact(F.array(F.when(F.col("closed_rings") == 0, F.lit("no boundary ring closed; the outline may be incomplete")), F.when(F.col("skipped_no_street") > 0, F.concat(F.col("skipped_no_street").cast("string"), F.lit(" address points have no street and were skipped")))))
    return rows.withColumn("warnings", notes)
