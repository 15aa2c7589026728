"""Media columns: payloads in archive files, read back by a data source over byte ranges.

``write_archives`` packs each row's payload as a PNG image of 8-bit grey samples,
64 to a line, into ZIP archives of bounded size in the shared folder; each task
writes its own. ``MediaSource`` reads them: the driver only lists the archives and
their sizes and plans byte ranges; a reader opens an archive's directory, takes
the members whose header starts within its range, and streams them out in small
Arrow batches. A member that fails to read or fails its checksum is read again,
alone, from its offset; after ``RETRIES`` attempts the task fails, so nothing is
lost silently.

Null payload text counts as empty; an empty one is stored as 64 zero bytes.
Rows that repeat are members of their own. A payload's stored form depends on
its bytes alone. Only archives named in the manifest count, which is written by
Spark's committer, so those of failed or repeated attempts are never read.
"""

from __future__ import annotations

import json
import struct
import time
import uuid
import zipfile
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from kerbside.llm.storage import discard_at_exit, resolve
from kerbside.runtime import shared_folder

LINE = 64
#: Bytes after which a new archive begins, of a planned range, and of a batch.
ARCHIVE, RANGE, OUT_BYTES = 64 << 20, 16 << 20, 8 << 20
RETRIES, PAUSE = 3, 0.2
_SIGNATURE = b"\x89PNG\r\n\x1a\n"


def padded(data: bytes) -> bytes:
    """Zero bytes appended up to a positive multiple of LINE."""
    return data + bytes((-len(data)) % LINE if data else LINE)


def _chunk(kind: bytes, body: bytes) -> bytes:
    return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))


def encode_png(payload: bytes) -> bytes:
    """Grey 8-bit PNG, LINE samples wide, no line filter: the samples are the payload's bytes."""
    lines = np.zeros((len(payload) // LINE, LINE + 1), np.uint8)
    lines[:, 1:] = np.frombuffer(payload, np.uint8).reshape(-1, LINE)
    head = struct.pack(">IIBBBBB", LINE, len(lines), 8, 0, 0, 0, 0)
    return _SIGNATURE + _chunk(b"IHDR", head) + _chunk(b"IDAT", zlib.compress(lines, 1)) + _chunk(b"IEND", b"")


def decode_png(stored: bytes) -> bytes:
    """The samples of what encode_png wrote; any damage raises."""
    if stored[:8] != _SIGNATURE:
        raise ValueError("not a PNG")
    at, packed, width, height = 8, b"", 0, 0
    while at < len(stored):
        (n,) = struct.unpack_from(">I", stored, at)
        kind, body = stored[at + 4 : at + 8], stored[at + 8 : at + 8 + n]
        if zlib.crc32(kind + body) != struct.unpack_from(">I", stored, at + 8 + n)[0]:
            raise ValueError(f"checksum of chunk {kind!r}")
        if kind == b"IHDR":
            width, height, depth, colour = struct.unpack_from(">IIBB", body)
            if (depth, colour) != (8, 0):
                raise ValueError("not 8-bit grey")
        elif kind == b"IDAT":
            packed += body
        at += n + 12
    lines = np.frombuffer(zlib.decompress(packed), np.uint8).reshape(height, width + 1)
    if lines[:, 0].any():
        raise ValueError("line filters are not written here")
    return lines[:, 1:].tobytes()


def features(payload: bytes) -> str:
    """A short description of the samples: lines, mean, deviation, and the shares of eight value ranges."""
    x = np.frombuffer(payload, np.uint8)
    counts = np.bincount(x, minlength=256)
    values = np.arange(256)
    mean = float(counts @ values) / len(x)
    deviation = float(np.sqrt(max(float(counts @ (values * values)) / len(x) - mean * mean, 0)))
    return f"{len(x) // LINE}x{LINE} {mean:.4f} {deviation:.4f} " + ",".join(f"{v:.4f}" for v in counts.reshape(8, 32).sum(1) / len(x))


def write_archives(rows: DataFrame, folder: str, limit: int = ARCHIVE) -> str:
    """rows: ``key`` string, ``payload`` binary. Writes archives below ``folder``; returns the manifest's path.

    A member's name has its number and, as JSON, the key; its comment the payload's length.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, top = resolve(folder)
        fs.create_dir(f"{top}/archives", recursive=True)
        out = archive = None
        done: list[tuple[str, int]] = []
        path, members = "", 0

        def close() -> None:
            nonlocal out, archive
            if archive is not None:
                archive.close()
                out.close()
                done.append((path, members))
                out = archive = None

        for batch in batches:
            for k in range(batch.num_rows):
                key, data = batch.column(0)[k].as_py(), batch.column(1)[k].as_py() or b""
                if archive is None:
                    path, members = f"{top}/archives/{uuid.uuid4().hex}.zip", 0
                    out = fs.open_output_stream(path)
                    archive = zipfile.ZipFile(out, "w", zipfile.ZIP_STORED)
                info = zipfile.ZipInfo(f"{members:08d}.png", (1980, 1, 1, 0, 0, 0))
                info.comment = json.dumps([key, len(data)]).encode()
                archive.writestr(info, encode_png(padded(data)))
                members += 1
                if out.tell() >= limit:
                    close()
        close()
        yield pa.RecordBatch.from_arrays([pa.array([p for p, _ in done], pa.string()), pa.array([m for _, m in done], pa.int64())], names=["path", "members"])

    rows.select(F.col("key").cast("string").alias("key"), F.col("payload").cast("binary").alias("payload")).mapInArrow(run, "path string, members long").write.parquet(f"{folder}/manifest")
    return f"{folder}/manifest"


class ByteRange(InputPartition):
    def __init__(self, path: str, start: int, end: int):
        self.path, self.start, self.end = path, start, end


class MediaReader(DataSourceReader):
    """Options: ``archives`` a JSON list of [path, bytes], ``folder`` for the file system, ``range`` bytes, ``retries``."""

    def __init__(self, options: dict):
        self.folder = options["folder"]
        self.archives = json.loads(options["archives"])
        self.step = int(options.get("range", RANGE))
        self.retries = int(options.get("retries", RETRIES))

    def partitions(self) -> list[ByteRange]:
        found = [ByteRange(path, lo, min(lo + self.step, size)) for path, size in self.archives for lo in range(0, size, self.step)]
        return found or [ByteRange("", 0, 0)]

    def read(self, part: ByteRange) -> Iterator[pa.RecordBatch]:
        if not part.path:
            return
        fs, _ = resolve(self.folder)
        keys, lengths, offsets, stored, payloads, held = [], [], [], [], [], 0
        with fs.open_input_file(part.path) as f:
            members = [m for m in zipfile.ZipFile(f).infolist() if part.start <= m.header_offset < part.end]
        for m in members:
            data, payload = self.member(fs, part.path, m)
            key, length = json.loads(m.comment)
            keys.append(key)
            lengths.append(length)
            offsets.append(m.header_offset)
            stored.append(data)
            payloads.append(payload)
            held += len(data) + len(payload)
            if held >= OUT_BYTES:
                yield self.batch(part.path, keys, lengths, offsets, stored, payloads)
                keys, lengths, offsets, stored, payloads, held = [], [], [], [], [], 0
        if keys:
            yield self.batch(part.path, keys, lengths, offsets, stored, payloads)

    def member(self, fs, path: str, m: zipfile.ZipInfo) -> tuple[bytes, bytes]:
        """One member from its offset, with attempts of its own."""
        for attempt in range(self.retries):
            try:
                with fs.open_input_file(path) as f:
                    f.seek(m.header_offset)
                    head = f.read(30)
                    if head[:4] != b"PK\x03\x04":
                        raise ValueError("no member starts here")
                    name, extra = struct.unpack_from("<HH", head, 26)
                    f.seek(m.header_offset + 30 + name + extra)
                    data = f.read(m.compress_size)
                if len(data) != m.file_size or zlib.crc32(data) != m.CRC:
                    raise ValueError("length or checksum of the member")
                return data, decode_png(data)
            except (OSError, ValueError, zlib.error) as e:
                if attempt + 1 == self.retries:
                    raise OSError(f"{path} at {m.header_offset}: {e}") from e
                time.sleep(PAUSE * 2**attempt)
        raise AssertionError

    @staticmethod
    def batch(path, keys, lengths, offsets, stored, payloads) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([path] * len(keys), pa.string()), pa.array(offsets, pa.int64()), pa.array(keys, pa.string()), pa.array(lengths, pa.int64()), pa.array(stored, pa.binary()), pa.array(payloads, pa.binary()), pa.array([features(p) for p in payloads], pa.string())], names=["archive", "offset", "key", "n_bytes", "media", "payload", "feature"])


class MediaSource(DataSource):
    """``spark.read.format("kerbside_media")``; one row per member of the archives."""

    @classmethod
    def name(cls) -> str:
        return "kerbside_media"

    def schema(self) -> str:
        return "archive string, offset long, key string, n_bytes long, media binary, payload binary, feature string"

    def reader(self, schema) -> MediaReader:
        return MediaReader(self.options)


def read_archives(spark: SparkSession, manifest: str, folder: str, step: int = RANGE) -> DataFrame:
    """The members of all archives in the manifest. The driver holds one path and size per archive of up to ARCHIVE bytes."""
    fs, _ = resolve(folder)
    paths = [r["path"] for r in spark.read.schema("path string, members long").parquet(manifest).select("path").collect()]
    listed = sorted((i.path, i.size) for lo in range(0, len(paths), 1000) for i in fs.get_file_info(paths[lo : lo + 1000]))
    spark.dataSource.register(MediaSource)
    return spark.read.format("kerbside_media").option("folder", folder).option("archives", json.dumps(listed)).option("range", str(step)).load()


def described(media: DataFrame) -> DataFrame:
    """key, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature; hashes of what was read back. The reader has computed the features."""
    return media.select(
        "key",
        "n_bytes",
        F.length("payload").cast("long").alias("payload_bytes"),
        F.sha2("payload", 256).alias("payload_sha256"),
        F.crc32(F.substring(F.col("payload"), -LINE, LINE)).alias("tail_crc32"),
        F.length("media").cast("long").alias("media_bytes"),
        F.sha2("media", 256).alias("media_sha256"),
        "feature",
    )


def store_and_read(rows: DataFrame) -> DataFrame:
    """Write the payloads of ``rows`` (key, payload) to the shared folder, for as long as the driver runs, and read them back."""
    folder = shared_folder(rows.sparkSession, "media")
    discard_at_exit(folder)
    return read_archives(rows.sparkSession, write_archives(rows, folder), folder)


