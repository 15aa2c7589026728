"""Command line: fetch a district's extract, or print a report of a snapshot."""

from __future__ import annotations

import argparse
import os
import sys
from dataclasses import dataclass, field

from pyspark.sql import SparkSession

from kerbside.plans.district import District
from kerbside.sources import overpass, snapshot


@dataclass(frozen=True)
class Settings:
    """Where things are; the environment overrides (KERBSIDE_RELATION_ID, _SLUG, _DATA_DIR, _MIRRORS)."""

    relation_id: int = 0
    slug: str = "district"
    data_dir: str = "data"
    mirrors: tuple[str, ...] = field(default=("https://overpass-api.de/api/interpreter",))

    @classmethod
    def from_environment(cls) -> Settings:
        found = {}
        for name, key, kind in (("relation_id", "RELATION_ID", int), ("slug", "SLUG", str), ("data_dir", "DATA_DIR", os.path.abspath), ("mirrors", "MIRRORS", lambda v: tuple(v.split(",")))):
            if value := os.environ.get(f"KERBSIDE_{key}"):
                found[name] = kind(value)
        return cls(**found)

    @property
    def snapshot_path(self) -> str:
        return f"{self.data_dir}/{self.slug}"


def report_lines(own: District) -> list[str]:
    """The coverage report as text."""
    r, m = own.coverage().first(), own.source.meta.first()
    return [
        f"{m.district_name}, fetched {m.fetched_at}",
        f"{r.doors} doors, {r.stops} stops, {r.streets} streets, {r.blockfaces} runs ({r.blockfaces_one_side_per_pass} one side at a time, {r.blockfaces_off_network} off the network)",
        f"{r.multi_unit_stops} stops with several doors, {r.gated_complex_candidates} probably gated; {r.doors_with_unit} doors with a unit",
        f"knocking {r.knock_hours} h ({r.uncapped_knock_hours} h uncapped); {r.doors_per_pair_session} doors a session, {r.pair_sessions} sessions",
        "largest stops: " + ", ".join(f"{x.number} {x.street} ({x.doors})" for x in r.largest_stops[:5]),
        "ways: " + ", ".join(f"{x.highway or '-'} {x.ways}" for x in r.walkable_ways),
        f"extent {r.extent_km_ns} x {r.extent_km_ew} km, {r.boundary_closed_rings} of {r.boundary_rings} rings closed",
    ]


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="kerbside")
    sub = parser.add_subparsers(dest="command", required=True)
    fetch = sub.add_parser("fetch-district")
    fetch.add_argument("--force", action="store_true")
    sub.add_parser("report")
    args = parser.parse_args(argv)
    settings = Settings.from_environment()
    spark = SparkSession.builder.getOrCreate()
    there = snapshot.stamp(spark, settings.snapshot_path) is not None  # in any file system that Spark reads
    if args.command == "fetch-district" and there and not args.force:
        print(f"{settings.snapshot_path} is there already; --force fetches it again")
        return 0
    if args.command == "fetch-district":
        found, counters = overpass.fetch_district(spark, overpass.Client(settings.mirrors), settings.relation_id, f"{settings.data_dir}/raw", progress=print)
        snapshot.save(found, settings.snapshot_path)
        print(counters.first().asDict())
        return 0
    if not there:
        print(f"no snapshot at {settings.snapshot_path}", file=sys.stderr)
        return 1
    print("\n".join(report_lines(District.open(spark, settings.snapshot_path))))
    return 0


if __name__ == "__main__":
    sys.exit(main())
