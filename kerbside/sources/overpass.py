"""A retrying client for map-extract servers, and a data source over it. Filters of the extract run on the server."""

from __future__ import annotations

import functools
import itertools
import json
import os
import time
import urllib.parse
import urllib.request
from collections.abc import Callable, Iterator, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from kerbside.sources import snapshot

AGENT = "kerbside/0.1"


class SourceError(RuntimeError):
    """Every attempt failed; the last failure is the cause."""


# Query texts of the extract servers' language.
BOUNDARY = "[out:json][timeout:{timeout}];rel({relation});out geom;"
INSIDE = "[out:json][timeout:{timeout}];\nrel({relation});map_to_area->.d;\n{body}\nout {out};"
ADDRESSES = '(node["addr:housenumber"](area.d);way["addr:housenumber"](area.d););'
WAYS = 'way["highway"~"^({kinds})$"](area.d);'


def boundary_query(relation_id: int, timeout_s: int) -> str:
    """Members come with geometry only in body mode."""
    return BOUNDARY.format(timeout=timeout_s, relation=relation_id)


def addresses_query(relation_id: int, timeout_s: int) -> str:
    return INSIDE.format(timeout=timeout_s, relation=relation_id, body=ADDRESSES, out="center tags")


def ways_query(relation_id: int, timeout_s: int) -> str:
    return INSIDE.format(timeout=timeout_s, relation=relation_id, body=WAYS.format(kinds="|".join(snapshot.WALKABLE)), out="geom")


def fault(body: bytes) -> str | None:
    """Why a response cannot be used: servers report trouble in a remark under status 200."""
    try:
        found = json.loads(body.decode())
    except ValueError:
        return "response is not valid JSON"
    remark = found.get("remark") if isinstance(found, dict) else None
    return f"server remark: {remark}" if remark else None


def post_form(url: str, query: str, timeout_s: float = 300.0) -> bytes:
    data = urllib.parse.urlencode({"data": query}).encode()
    with urllib.request.urlopen(urllib.request.Request(url, data, {"User-Agent": AGENT}), timeout=timeout_s) as r:
        return r.read()


def schedule(mirrors: Sequence[str], attempts: int, wait_s: float) -> Iterator[tuple[str, float]]:
    """The mirror of each attempt, in turn, and the pause before it: none, then doubling."""
    pauses = itertools.chain([0.0], (wait_s * 2**k for k in itertools.count()))
    return itertools.islice(zip(itertools.cycle(mirrors), pauses, strict=False), attempts)


class Client:
    """Sends queries by a schedule of mirrors and pauses until one gives a usable response."""

    def __init__(self, mirrors: Sequence[str], attempts: int = 8, timeout_s: float = 300.0, wait_s: float = 5.0, post: Callable[[str, str], bytes] | None = None, sleep: Callable[[float], None] = time.sleep, note: Callable[[int, str, str], None] | None = None):
        if not mirrors:
            raise ValueError("no mirrors")
        self.plan = lambda: schedule(list(mirrors), attempts, wait_s)
        self.sleep, self.note = sleep, note or (lambda attempt, mirror, text: None)
        self.post = post or functools.partial(post_form, timeout_s=timeout_s)

    def one(self, mirror: str, query: str) -> bytes:
        body = self.post(mirror, query)
        if why := fault(body):
            raise SourceError(why)
        return body

    def raw(self, query: str) -> bytes:
        failures: list[Exception] = []
        for attempt, (mirror, pause) in enumerate(self.plan()):
            if pause:
                self.sleep(pause)
            try:
                body = self.one(mirror, query)
            except Exception as e:  # any failure of a mirror is worth another try
                failures.append(e)
                self.note(attempt, mirror, f"failed: {e}")
            else:
                self.note(attempt, mirror, f"ok, {len(body)} bytes")
                return body
        raise SourceError(f"{len(failures)} attempts failed, the last with: {failures[-1] if failures else None}") from (failures or [None])[-1]

    def elements(self, query: str) -> list[dict]:
        return json.loads(self.raw(query).decode()).get("elements", [])


class QueryPartition(InputPartition):
    def __init__(self, query: str):
        self.query = query


class QueryReader(DataSourceReader):
    def __init__(self, options: dict):
        self.options = options

    def partitions(self) -> list[QueryPartition]:
        return [QueryPartition(q) for q in json.loads(self.options["queries"])]

    def read(self, part: QueryPartition) -> Iterator[tuple]:
        client = Client(json.loads(self.options["mirrors"]), int(self.options.get("attempts", 8)), float(self.options.get("timeout", 300)), float(self.options.get("wait", 5)))
        for k, e in enumerate(client.elements(part.query)):
            yield part.query, k, json.dumps(e)


class QuerySource(DataSource):
    """``spark.read.format("kerbside_overpass")``: one partition per query, one row per element (as JSON)."""

    @classmethod
    def name(cls) -> str:
        return "kerbside_overpass"

    def schema(self) -> str:
        return "query string, ord long, element string"

    def reader(self, schema) -> QueryReader:
        return QueryReader(self.options)


def fetch_district(spark: SparkSession, client: Client, relation_id: int, folder: str, timeout_s: int = 300, progress: Callable[[str], None] | None = None) -> tuple[snapshot.Snapshot, DataFrame]:
    """Three queries, each response saved as it came, then parsed by Spark: the snapshot and its ingest counters."""
    from pyspark.sql import functions as F

    say = progress or (lambda text: None)
    queries = {"boundary": boundary_query, "addresses": addresses_query, "ways": ways_query}
    parsed = {}
    os.makedirs(folder, exist_ok=True)
    for name, query in queries.items():
        say(name)
        with open(f"{folder}/{name}.json.part", "wb") as f:
            f.write(client.raw(query(relation_id, timeout_s)))
        os.replace(f"{folder}/{name}.json.part", f"{folder}/{name}.json")
        parsed[name] = snapshot.read_elements(spark, f"{folder}/{name}.json")
    if parsed["boundary"].where(F.col("type") == "relation").isEmpty():
        raise ValueError("the boundary query gave no relation")
    name, rings = snapshot.parse_boundary(parsed["boundary"])
    if rings.isEmpty():
        raise ValueError(f"relation {relation_id} came without member geometry; it must be asked for in body mode")
    now = F.concat(F.date_format(F.to_utc_timestamp(F.current_timestamp(), F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss"), F.lit("+00:00"))
    meta = name.select("district_name", F.lit(relation_id).cast("long").alias("relation_id"), now.alias("fetched_at"), F.lit("osm").alias("boundary_source"))
    found = snapshot.Snapshot(meta, rings, snapshot.parse_addresses(parsed["addresses"]), snapshot.parse_ways(parsed["ways"]))
    return found, snapshot.ingest_counters(parsed["boundary"], parsed["addresses"], parsed["ways"])
