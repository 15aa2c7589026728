"""WARC files as a table: writing with revisit records, and a data source that reads them.

``plan`` decides each record's type: of records with equal payloads of at least
``REVISIT_FROM`` bytes the one with the smallest id is a response and the others
are revisits of it. Only digests and ids are grouped; the groups then meet the
pages in an equi-join that Spark can broadcast, or split where one payload has a
large share of the rows.

``write`` puts one gzip member per record into files of bounded size in the
shared folder, each with the skip-length extra field of the WARC guidelines.
``WarcSource`` plans one partition per file, takes predicates on the record type
and on headers, inflates a record's headers first, and goes to the next record
by the skip length without inflating the block of a record that nobody wants.

Null payload counts as empty. A null id is written empty and read as null; it is
never the smallest, and where all ids of a payload are null all are responses.
Rows that repeat the smallest id are all responses. Control characters in a
header value are percent-encoded, in ids also what would be read otherwise. An empty
table gives an empty result; columns other than id, URL and payload are not archived.
"""

from __future__ import annotations

import json
import re
import struct
import uuid
import zlib
from collections.abc import Iterable, Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition, IsNotNull, StringContains, StringEndsWith, StringStartsWith

from kerbside.llm.storage import discard_at_exit, resolve
from kerbside.runtime import shared_folder

REVISIT_FROM = 100
FILE, OUT_BYTES = 16 << 20, 8 << 20
DATE = "1970-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Column of the source by header name.
HEADERS = {
    "WARC-Type": "warc_type",
    "WARC-Record-ID": "record_id",
    "WARC-Target-URI": "target_uri",
    "WARC-Date": "date",
    "WARC-Payload-Digest": "payload_digest",
    "WARC-Refers-To": "refers_to",
    "WARC-Payload-Length": "payload_length",
}
SCHEMA = ", ".join(f"{c} string" for c in HEADERS.values()) + ", payload binary"
_URN = "urn:page:"


def plan(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """key, url, payload, digest (hex SHA-256), record_type, refers_to."""
    body = F.coalesce(F.col(f"`{html}`").cast("string"), F.lit("")).cast("binary")
    rows = pages.select(F.col(f"`{key}`").alias("key"), F.col(f"`{url}`").cast("string").alias("url"), body.alias("payload"), F.sha2(body, 256).alias("digest"))
    narrow = pages.select(F.col(f"`{key}`").alias("key"), F.sha2(body, 256).alias("d"), F.length(body).alias("n")).where(F.col("n") >= REVISIT_FROM)
    first = narrow.groupBy("d").agg(F.min("key").alias("first"), F.count("*").alias("times")).where((F.col("times") > 1) & F.col("first").isNotNull()).select("d", "first")
    again = F.col("first").isNotNull() & ~F.col("key").eqNullSafe(F.col("first"))
    return rows.join(first, rows["digest"] == first["d"], "left").select("key", "url", "payload", "digest", F.when(again, "revisit").otherwise("response").alias("record_type"), F.when(again, F.col("first")).alias("refers_to"))


def _value(text: str) -> str:
    return re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", text)


def ident(key: str | None) -> str:
    """A record id; null is no name, and every other id, empty or odd, is told by what follows the equals sign."""
    return f"<{_URN}>" if key is None else f"<{_URN}=" + re.sub(r"[\x00-\x20\x7f%+<>]", lambda m: f"%{ord(m[0]):02X}", key) + ">"


def record(key: str | None, url: str | None, payload: bytes, digest: str, kind: str, refers_to: str | None, date: str = DATE) -> bytes:
    """One record as a gzip member with skip lengths (compressed and plain)."""
    fields = [("WARC-Type", kind), ("WARC-Record-ID", ident(key)), ("WARC-Date", date)]
    if url is not None:
        fields.append(("WARC-Target-URI", _value(url)))
    fields += [("WARC-Payload-Digest", f"sha256:{digest}"), ("WARC-Payload-Length", str(len(payload)))]
    if kind == "revisit":
        fields += [("WARC-Refers-To", ident(refers_to)), ("WARC-Profile", PROFILE)]
        block = b"HTTP/1.1 200 OK\r\n\r\n"
    else:
        block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload) + payload
    fields += [("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(block)))]
    plain = b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields).encode() + b"\r\n" + block + b"\r\n\r\n"
    squeeze = zlib.compressobj(1, zlib.DEFLATED, -15)
    packed = squeeze.compress(plain) + squeeze.flush()
    # header with FEXTRA: one subfield "sl" of 8 bytes
    total = 10 + 2 + 12 + len(packed) + 8
    head = b"\x1f\x8b\x08\x04\0\0\0\0\0\xff" + struct.pack("<H2sHII", 12, b"sl", 8, total, len(plain) & 0xFFFFFFFF)
    return head + packed + struct.pack("<II", zlib.crc32(plain), len(plain) & 0xFFFFFFFF)


def write(planned: DataFrame, folder: str, limit: int = FILE) -> str:
    """Writes the records below ``folder``; returns the manifest, which names the files of the attempts that counted."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, top = resolve(folder)
        fs.create_dir(f"{top}/warc", recursive=True)
        out, size, done = None, 0, []
        for batch in batches:
            for row in batch.to_pylist():
                if out is None:
                    path, size = f"{top}/warc/{uuid.uuid4().hex}.warc.gz", 0
                    out = fs.open_output_stream(path, compression=None)
                    done.append(path)
                data = record(row["key"], row["url"], row["payload"], row["digest"], row["record_type"], row["refers_to"])
                out.write(data)
                size += len(data)
                if size >= limit:
                    out.close()
                    out = None
        if out is not None:
            out.close()
        yield pa.RecordBatch.from_arrays([pa.array(done, pa.string())], names=["path"])

    text = planned.withColumn("key", F.col("key").cast("string")).withColumn("refers_to", F.col("refers_to").cast("string"))
    text.mapInArrow(run, "path string").write.parquet(f"{folder}/manifest")
    return f"{folder}/manifest"


class WarcFile(InputPartition):
    def __init__(self, path: str, size: int):
        self.path, self.size = path, size


class WarcReader(DataSourceReader):
    """Options: ``files`` a JSON list of [path, bytes], ``folder``, and ``payload`` (false: blocks are never inflated)."""

    def __init__(self, options: dict):
        self.folder, self.files = options["folder"], json.loads(options["files"])
        self.payload = options.get("payload", "true").lower() == "true"
        self.tests: list[tuple[str, str, Any]] = []

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        """Takes comparisons of header columns; yields the rest back to Spark."""
        kinds = {EqualTo: "eq", In: "in", IsNotNull: "set", StringStartsWith: "starts", StringEndsWith: "ends", StringContains: "has"}
        for f in filters:
            at = getattr(f, "attribute", ("",))
            if type(f) in kinds and len(at) == 1 and at[0] in HEADERS.values():
                self.tests.append((kinds[type(f)], at[0], getattr(f, "value", None)))
            else:
                yield f

    def wanted(self, row: dict[str, str]) -> bool:
        for kind, column, value in self.tests:
            own = row.get(column)
            if own is None:
                return False
            if not {"eq": lambda: own == value, "in": lambda: own in value, "set": lambda: True, "starts": lambda: own.startswith(value), "ends": lambda: own.endswith(value), "has": lambda: value in own}[kind]():
                return False
        return True

    def partitions(self) -> list[WarcFile]:
        return [WarcFile(p, n) for p, n in self.files] or [WarcFile("", 0)]

    def read(self, part: WarcFile) -> Iterator[pa.RecordBatch]:
        if not part.path:
            return
        fs, _ = resolve(self.folder)
        rows, held = [], 0
        with fs.open_input_file(part.path) as f:
            at = 0
            while at < part.size:
                f.seek(at)
                row, at = self.one(f, at)
                if row is not None:
                    rows.append(row)
                    held += len(row["payload"] or b"") + 200
                if held >= OUT_BYTES:
                    yield self.batch(rows)
                    rows, held = [], 0
        if rows:
            yield self.batch(rows)

    def one(self, f, at: int) -> tuple[dict | None, int]:
        """The record that starts at ``at`` (None if unwanted) and where the next one starts."""
        raw = f.read(4096)
        if raw[:2] != b"\x1f\x8b":
            raise ValueError(f"no record at {at}")
        skip = struct.unpack_from("<I", raw, 16)[0] if raw[3] & 4 and raw[12:14] == b"sl" else 0
        inflate = zlib.decompressobj(31)
        plain = bytearray(inflate.decompress(raw))
        taken = len(raw)
        while (end := plain.find(b"\r\n\r\n")) < 0 and not inflate.eof:
            raw = f.read(1 << 14)
            if not raw:
                raise ValueError(f"record at {at} is cut off")
            taken += len(raw)
            plain += inflate.decompress(raw)
        row: dict[str, Any] = {"payload": None}
        length = 0
        for line in bytes(plain[:end]).decode("utf-8", "replace").split("\r\n")[1:]:
            name, _, value = line.partition(":")
            value = value.strip()
            if name in HEADERS:
                row[HEADERS[name]] = value
            elif name == "Content-Length":
                length = int(value)
        keep = self.wanted(row)
        if skip and not (keep and self.payload):
            return (row if keep else None), at + skip
        while not inflate.eof:
            raw = f.read(1 << 16)
            if not raw:
                raise ValueError(f"record at {at} is cut off")
            taken += len(raw)
            plain += inflate.decompress(raw)
        nxt = at + taken - len(inflate.unused_data)
        if not keep:
            return None, nxt
        if self.payload:
            block = bytes(plain[end + 4 : end + 4 + length])
            if len(block) != length:
                raise ValueError(f"record at {at} is cut off")
            row["payload"] = block[block.find(b"\r\n\r\n") + 4 :]
        return row, nxt

    @staticmethod
    def batch(rows: list[dict]) -> pa.RecordBatch:
        names = [*HEADERS.values()]
        return pa.RecordBatch.from_arrays([pa.array([r.get(c) for r in rows], pa.string()) for c in names] + [pa.array([r["payload"] for r in rows], pa.binary())], names=[*names, "payload"])


class WarcSource(DataSource):
    """``spark.read.format("kerbside_warc")``; one row per record."""

    @classmethod
    def name(cls) -> str:
        return "kerbside_warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> WarcReader:
        return WarcReader(self.options)


def read(spark: SparkSession, manifest: str, folder: str, payload: bool = True) -> DataFrame:
    """Records of all files in the manifest; filters on header columns reach the reader."""
    fs, _ = resolve(folder)
    paths = [r["path"] for r in spark.read.schema("path string").parquet(manifest).collect()]
    listed = sorted((i.path, i.size) for lo in range(0, len(paths), 1000) for i in fs.get_file_info(paths[lo : lo + 1000]))
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(WarcSource)
    return spark.read.format("kerbside_warc").option("folder", folder).option("files", json.dumps(listed)).option("payload", str(payload).lower()).load()


def archive_and_read(pages: DataFrame, key: str = "page_id") -> DataFrame:
    """key, payload_bytes, payload_digest, record_type, refers_to, from the archives written.

    Responses are read with their payloads and measured; revisits by headers alone.
    """
    spark = pages.sparkSession
    folder = shared_folder(spark, "warc")
    discard_at_exit(folder)
    manifest = write(plan(pages, key), folder)
    kind = pages.schema[key].dataType

    def own(column: str):
        named = F.url_decode(F.regexp_extract(column, f"(?s)^<{_URN}=(.*)>$", 1))
        return F.when(F.col(column).startswith(f"<{_URN}="), named).cast(kind)

    full = read(spark, manifest, folder).where(F.col("warc_type") == "response")
    full = full.select(own("record_id").alias(key), F.length("payload").cast("long").alias("payload_bytes"), F.sha2("payload", 256).alias("payload_digest"), F.col("warc_type").alias("record_type"), F.lit(None).cast(kind).alias("refers_to"))
    lean = read(spark, manifest, folder, payload=False).where(F.col("warc_type") == "revisit")
    lean = lean.select(own("record_id").alias(key), F.col("payload_length").cast("long").alias("payload_bytes"), F.substring("payload_digest", 8, 64).alias("payload_digest"), F.col("warc_type").alias("record_type"), own("refers_to").alias("refers_to"))
    return full.unionByName(lean)


ORACLE = """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b FROM pages),
q AS (SELECT page_id, CAST(octet_length(b) AS BIGINT) AS payload_bytes, sha256(b) AS payload_digest FROM p),
f AS (SELECT *, CASE WHEN payload_bytes >= 100 THEN min(page_id) OVER (PARTITION BY payload_digest) ELSE page_id END AS first FROM q)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN page_id IS DISTINCT FROM first THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN page_id IS DISTINCT FROM first THEN first END AS refers_to
FROM f
"""
