"""A district as lazily built, persisted tables and temp views, with one method per question it answers."""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kerbside.functions import geo, text
from kerbside.operators import blockfaces, geocode, network, routing, territory
from kerbside.operators import stops as stopping
from kerbside.operators import zones as zoning
from kerbside.plans import reports
from kerbside.runtime import prepare
from kerbside.sources import geojson, snapshot
from kerbside.sources import district as derived


class SnapshotMissingError(FileNotFoundError):
    """There is no snapshot at the path yet."""


class District:
    """Tables are built when first asked for and kept until ``refresh``. All distances are metres."""

    def __init__(self, spark: SparkSession, source: snapshot.Snapshot):
        self.spark = prepare(spark)
        self.source = source
        self._kept: dict = {}

    @classmethod
    def open(cls, spark: SparkSession, path: str) -> District:
        if snapshot.stamp(spark, path) is None:
            raise SnapshotMissingError(path)
        own = cls(spark, None)
        own.path, own.stamp = path, None
        own.reload()
        return own

    @classmethod
    def from_tables(cls, spark: SparkSession, sf_dir: str) -> District:
        """The synthetic district of the TPC-H-like tables."""
        address, way = derived.doors(spark, sf_dir), derived.ways(spark, sf_dir)
        box = address.agg(F.min("lat").alias("s"), F.min("lon").alias("w"), F.max("lat").alias("n"), F.max("lon").alias("e"))
        rings = box.select(F.lit(0).alias("ring_ord"), geojson.box_ring(F.col("s") - 0.001, F.col("w") - 0.001, F.col("n") + 0.001, F.col("e") + 0.001).alias("ring"))
        meta = spark.range(1).select(F.lit("Derived district").alias("district_name"), F.lit(0).cast("long").alias("relation_id"), F.lit("1970-01-01T00:00:00+00:00").alias("fetched_at"), F.lit("derived").alias("boundary_source"))
        return cls(spark, snapshot.Snapshot(meta, rings, address, way))

    def reload(self) -> bool:
        """Read the snapshot again if its files have changed, by their times and sizes in any file system; everything built from the old one goes."""
        stamp = snapshot.stamp(self.spark, self.path)
        if stamp == self.stamp:
            return False
        self.refresh()
        self.source, self.stamp = snapshot.load(self.spark, self.path), stamp
        return True

    def refresh(self) -> None:
        for df in self._kept.values():
            df.unpersist()
        self._kept.clear()

    def _keep(self, name, build) -> DataFrame:
        if name not in self._kept:
            self._kept[name] = build().persist(StorageLevel.MEMORY_AND_DISK)
        return self._kept[name]

    addresses = property(lambda self: self._keep("address", lambda: self.source.address))
    ways = property(lambda self: self._keep("way", lambda: self.source.way))
    rings = property(lambda self: self._keep("ring", lambda: self.source.rings))
    stops = property(lambda self: self._keep("stop", lambda: stopping.build_stops(self.addresses)))
    walk_edges = property(lambda self: self._keep("walk_edge", lambda: network.walk_edges(self.ways)))
    walk_labels = property(lambda self: self._keep("walk_label", lambda: network.labels(self.walk_edges)))
    span_edges = property(lambda self: self._keep("span_edge", lambda: network.span_edges(self.ways)))
    spans = property(lambda self: self._keep("span", lambda: network.spans(self.span_edges)))
    snaps = property(lambda self: self._keep("edge_snap", lambda: network.edge_snaps(self.addresses, self.walk_edges, ["osm_id"])))
    faces = property(lambda self: self._keep("blockface", lambda: blockfaces.build_blockfaces(self.stops, self.span_edges, self.spans)))

    def zones(self, target: int = zoning.DEFAULT_TARGET) -> DataFrame:
        if not zoning.LEAST_TARGET <= target <= zoning.MOST_TARGET:
            raise ValueError(f"target must be from {zoning.LEAST_TARGET} to {zoning.MOST_TARGET}")
        return self._keep(("zone", target), lambda: zoning.build_zones(self.faces, target))

    def register_views(self) -> None:
        """address, way, stop, span, span_edge, walk_edge, edge_snap and blockface for Spark SQL."""
        for name, df in {"address": self.addresses, "way": self.ways, "ring": self.rings, "stop": self.stops, "span": self.spans, "span_edge": self.span_edges, "walk_edge": self.walk_edges, "edge_snap": self.snaps, "blockface": self.faces}.items():
            df.createOrReplaceTempView(name)

    def contains(self, points: DataFrame) -> DataFrame:
        """Adds inside_district to rows with lat, lon."""
        rings = self.rings.agg(F.collect_list("ring").alias("rings"))
        return points.crossJoin(rings).withColumn("inside_district", geo.rings_contain(F.col("lat"), F.col("lon"), F.col("rings"))).drop("rings")

    # one method per endpoint

    @staticmethod
    def health_of(spark: SparkSession, path: str) -> DataFrame:
        """Health of the snapshot at a path: status ``no snapshot`` while there is none."""
        try:
            return District.open(spark, path).health()
        except SnapshotMissingError:
            nothing = F.lit(None).cast("string")
            return spark.range(1).select(F.lit("no snapshot").alias("status"), nothing.alias("district_name"), nothing.alias("fetched_at"), F.lit(0).cast("long").alias("doors"))

    def health(self) -> DataFrame:
        return self.source.meta.crossJoin(self.addresses.agg(F.count("*").alias("doors"))).select(F.lit("ok").alias("status"), "district_name", "fetched_at", "doors")

    def district(self) -> DataFrame:
        box = self.rings.select(F.explode("ring").alias("p")).agg(F.min("p.lat").alias("south"), F.min("p.lon").alias("west"), F.max("p.lat").alias("north"), F.max("p.lon").alias("east"))
        outline = self.rings.agg(geojson.polygons(F.transform(F.array_sort(F.collect_list(F.struct("ring_ord", "ring"))), lambda r: r["ring"])).alias("boundary"))
        return self.source.meta.crossJoin(box).crossJoin(outline).crossJoin(self.addresses.agg(F.count("*").alias("doors"))).crossJoin(self.ways.agg(F.count("*").alias("walkable_ways")))

    def address_features(self, box=None, limit: int = 40_000) -> tuple[DataFrame, bool]:
        rows, more = reports.page(reports.in_box(self.addresses, box), ["ord"], limit, 100_000)
        label = text.address_label(F.col("unit"), F.col("number"), F.col("street")).alias("label")
        return geojson.features(rows, F.col("osm_id"), geojson.point(F.col("lat"), F.col("lon")), [label, F.col("street"), F.col("number")]), more

    def stop_features(self, box=None, limit: int = 40_000) -> tuple[DataFrame, bool]:
        rows, more = reports.page(reports.in_box(self.stops, box), stopping.stop_order(), limit, 100_000)
        shown = stopping.payload(rows)
        return geojson.features(shown, F.col("stop_id"), geojson.point(F.col("lat"), F.col("lon")), [F.col(c) for c in ("street", "number", "label", "door_count", "dwell_minutes", "gated_candidate", "uncapped_dwell_minutes")]), more

    def stop_totals(self, box=None, limit: int = 40_000) -> DataFrame:
        """Rows, doors and minutes of one page of stops."""
        rows, _ = reports.page(reports.in_box(self.stops, box), stopping.stop_order(), limit, 100_000)
        return reports.totals(rows, geo.dwell_seconds(F.col("door_count")) / 60)

    def blockface_rows(self, box=None, street: str | None = None, limit: int = 5000) -> tuple[DataFrame, bool]:
        rows = self.faces
        if street:
            rows = rows.where(F.col("street_norm") == text.normalise_street(F.lit(street)))
        return reports.page(reports.in_box(rows, box), ["street", text.natural_key(F.col("from_number")), "side", "blockface_id"], limit, 20_000)

    def blockface_features(self, box=None, street: str | None = None, limit: int = 5000) -> tuple[DataFrame, bool]:
        rows, more = self.blockface_rows(box, street, limit)
        extra = [F.array("lon", "lat").alias("centroid"), F.col("stops.stop_id").alias("stop_ids")]
        return geojson.features(rows, F.col("blockface_id"), geojson.lines(F.col("path")), [*blockfaces.shown(), *extra]), more

    def blockface_totals(self, box=None, street: str | None = None, limit: int = 5000) -> DataFrame:
        """Rows, doors and minutes of one page of blockfaces."""
        rows, _ = self.blockface_rows(box, street, limit)
        return reports.totals(rows, F.col("minutes"))

    def network_counts(self) -> DataFrame:
        """street_count (named) and span_count."""
        return self.spans.agg(F.count_distinct("street_norm").alias("street_count"), F.count("*").alias("span_count"))

    def coverage(self) -> DataFrame:
        return reports.coverage(self.addresses, self.ways, self.rings, self.stops, self.faces)

    def geocode(self, queries: DataFrame, limit: int = 8) -> DataFrame:
        return self.contains(geocode.search(queries, self.addresses, limit))

    def reverse(self, points: DataFrame) -> DataFrame:
        found = geocode.reverse(points, self.addresses).withColumn("distance_m", F.bround("distance_m", 1))
        return found.join(self.contains(points).select("pid", "inside_district"), "pid")

    def hub_preview(self, hubs: DataFrame) -> DataFrame:
        hubs = reports.checked_radius(hubs)
        crow = reports.hub_preview_crow(hubs, self.addresses, self.stops)
        walk = reports.hub_preview_walk(hubs, self.addresses, self.stops, self.faces, self.walk_edges, self.snaps)
        inside = self.contains(hubs).select("hub_id", "inside_district")
        return crow.join(inside, "hub_id").join(walk.select("hub_id", F.struct(*[c for c in walk.columns if c != "hub_id"]).alias("walk")), "hub_id")

    def session(self, scenarios: DataFrame) -> DataFrame:
        """The faces of each scenario (scenario_id, lat, lon, radius_m), cut back to its circle."""
        return reports.session_faces(self.faces, scenarios.withColumnRenamed("scenario_id", "hub_id"), self.stops)

    def territories(self, scenarios: DataFrame) -> tuple[DataFrame, DataFrame]:
        """(faces of each scenario, their territories). scenarios: scenario_id, lat, lon, radius_m, teams."""
        faces = self.session(reports.checked_radius(scenarios))
        return faces, territory.build_territories(faces, scenarios)

    def territory_features(self, scenarios: DataFrame) -> DataFrame:
        faces, teams = self.territories(scenarios)
        rows = teams.join(faces, ["scenario_id", "blockface_id"])
        shown = [F.col("scenario_id"), F.col("team"), F.col("label"), F.col("street"), F.bround("minutes", 1).alias("minutes"), F.col("door_count").alias("doors"), F.col("clipped")]
        return geojson.features(rows, F.col("blockface_id"), geojson.face_geometry(F.col("path"), F.col("stops")), shown)

    def zone_features(self, target: int = zoning.DEFAULT_TARGET) -> DataFrame:
        table = zoning.zone_table(self.zones(target), self.faces)
        rows = self.zones(target).where("kept").join(table.select("zone_id", "palette"), "zone_id").join(self.faces, "blockface_id")
        shown = [F.col("zone_id").alias("zone"), F.col("palette"), F.col("label"), F.col("street"), F.col("door_count").alias("doors")]
        return geojson.features(rows, F.concat("zone_id", F.lit("/"), "blockface_id"), geojson.face_geometry(F.col("path"), F.col("stops")), shown)

    def routes(self, requests: DataFrame) -> DataFrame:
        found = routing.routes(requests, self.walk_edges, labels=self._kept.get("walk_label"))
        return found.select("route_id", F.bround("distance_m", 1).alias("distance_m"), F.bround("minutes", 1).alias("minutes"), F.bround("crow_m", 1).alias("crow_flies_m"), F.col("detour").alias("detour_ratio"), geojson.line(F.col("points")).alias("geometry"))
