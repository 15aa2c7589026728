"""Snapshots as Parquet tables: round trip, new versions, saves that broke off."""

import os

from pyspark.sql import functions as F

from kerbside.plans.district import District
from kerbside.sources import snapshot


def made(spark, n):
    address = spark.range(n).select(F.concat(F.lit("n"), "id").alias("osm_id"), F.col("id").alias("ord"), (10 + F.col("id") % 50 * 0.01).alias("lat"), (20 + F.floor(F.col("id") / 50) * 0.01).alias("lon"), F.col("id").cast("string").alias("number"), F.lit("Elm Street").alias("street"), F.when(F.col("id") % 3 == 0, "1").alias("unit"), F.lit(None).cast("string").alias("postcode"))
    point = lambda a, b: F.struct(F.lit(a).alias("lat"), (F.lit(b) + F.col("id") * 0.001).alias("lon"))
    way = spark.range(5).select(F.col("id").alias("ord"), (100 + F.col("id")).alias("osm_id"), F.array(point(10.0, 20.0), point(10.5, 20.0)).alias("geometry"), F.create_map(F.lit("highway"), F.lit("residential"), F.lit("name"), F.lit("Elm Street")).alias("tags"))
    ring = spark.range(1).select(F.lit(0).alias("ring_ord"), F.array(point(9.0, 19.0), point(11.0, 19.0), point(11.0, 22.0), point(9.0, 19.0)).alias("ring"))
    meta = spark.range(1).select(F.lit("Made").alias("district_name"), F.lit(7).cast("long").alias("relation_id"), F.lit("2026-01-01T00:00:00+00:00").alias("fetched_at"), F.lit("osm").alias("boundary_source"))
    return snapshot.Snapshot(meta, ring, address, way)


def rows(s):
    return [sorted(map(str, df.select(*sorted(df.columns)).collect())) for df in (s.meta, s.rings, s.address, s.way)]


def test_round_trip_and_versions(spark, tmp_path):
    folder = str(tmp_path / "town")
    first, second = made(spark, 300), made(spark, 500)
    assert snapshot.save_tables(first, folder) == 1
    assert rows(snapshot.load(spark, folder)) == rows(first)
    own = District.open(spark, folder)
    assert own.addresses.count() == 300 and not own.reload()
    assert snapshot.save_tables(second, folder) == 2
    assert own.reload() and own.addresses.count() == 500
    assert snapshot.save_tables(first, folder) == 3 and snapshot.save_tables(second, folder) == 4
    # two versions are left, whole
    names = sorted(f for f in os.listdir(folder) if not f.startswith("."))
    assert [f for f in names if f.startswith("manifest")] == ["manifest-3.json", "manifest-4.json"] and len(names) == 4


def test_a_save_that_broke_off(spark, tmp_path):
    folder = str(tmp_path / "town")
    snapshot.save_tables(made(spark, 40), folder)
    made(spark, 50).address.write.parquet(f"{folder}/version-torn/address")
    assert snapshot.load(spark, folder).address.count() == 40
    (tmp_path / "town" / "manifest-2.json").write_text('{"format": 1, "versi')
    assert snapshot.load(spark, folder).address.count() == 40
    (tmp_path / "town" / "manifest-3.json").write_text("")
    assert snapshot.load(spark, folder).address.count() == 40
    assert snapshot.save_tables(made(spark, 60), folder) == 4 and snapshot.load(spark, folder).address.count() == 60


def test_no_row_holds_a_district(spark, tmp_path):
    """Written from several tasks; a box reads by the order of places."""
    folder = str(tmp_path / "town")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        snapshot.save_tables(made(spark, 2000), folder)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    version = snapshot.manifests(spark, folder)[0][1]["version"]
    assert len([f for f in os.listdir(f"{folder}/{version}/address") if f.endswith(".parquet")]) > 1
    assert snapshot.load(spark, folder).address.where("lat BETWEEN 10.1 AND 10.2").count() == 11 * 40
