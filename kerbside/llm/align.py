"""Alignment of two tokenizers' tokens over the same bytes, and corpus-wide counts of the linked id pairs.

A is a byte-level BPE file (given a space and the text), B a sentencepiece model
(which adds the space itself); an id stands for fixed bytes in either. The
tokens of all documents of a batch lie on one byte line: sorted by start, with
the running maximum of their ends, a group breaks where a start reaches that
maximum, which is where tokens of both end together. Within the groups the
overlapping pairs are expanded, and the links are those that end together.

The ids of a link end at one byte of one text, so the bytes of one are a suffix
of the other's. The pairs for which that holds are listed from the vocabularies
alone (some hundred thousand); this bounds everything that is counted: a task
counts into one flat array, the sums over all tasks have at most so many rows,
and they come back to every task as one array. The links of a document are kept
as numbers into that list between the two passes, in the shared folder, so texts
are encoded once; nothing else is shuffled.

Null and empty texts, and those whose tokens do not spell the space and the text
(B normalises some), have no tokens: zeros and an empty string. Rows that repeat
are counted each by itself. Ties for a B id's highest count all count as best.
An empty table gives an empty result. Other columns come back in ``row``.
"""

from __future__ import annotations

import functools
import hashlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kerbside.llm import encoder
from kerbside.llm.storage import discard_at_exit
from kerbside.runtime import shared_folder


@functools.lru_cache(maxsize=4)
def pieces_of(path: str):
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=path)


@functools.lru_cache(maxsize=4)
def piece_bytes(path: str) -> list[bytes]:
    """The bytes of every B id: byte pieces are one byte, U+2581 is a space."""
    own = pieces_of(path)
    return [bytes([int(own.id_to_piece(k)[3:5], 16)]) if own.is_byte(k) else own.id_to_piece(k).replace("▁", " ").encode() for k in range(own.get_piece_size())]


class Pairs:
    """The id pairs that can end together, in ascending order of (A id, B id), and their numbers."""

    def __init__(self, a: list[bytes], b: list[bytes]):
        self.width = len(b)
        left, right = defaultdict(list), defaultdict(list)
        for ids, words in ((left, a), (right, b)):
            for k, w in enumerate(words):
                if w:
                    ids[w].append(k)
        found = [(k, m) for w, ks in left.items() for i in range(len(w)) for m in right.get(w[i:], ()) for k in ks]
        found += [(k, m) for w, ms in right.items() for i in range(1, len(w)) for k in left.get(w[i:], ()) for m in ms]
        self.keys = np.unique(np.array([k * self.width + m for k, m in found], np.int64))

    def __len__(self) -> int:
        return len(self.keys)

    def number(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.keys, a.astype(np.int64) * self.width + b).astype(np.int32)


@functools.lru_cache(maxsize=2)
def pairs_of(a_path: str, b_path: str) -> Pairs:
    return Pairs(encoder.entry_bytes(a_path), piece_bytes(b_path))


@functools.lru_cache(maxsize=2)
def _sizes(a_path: str, b_path: str) -> tuple[np.ndarray, np.ndarray]:
    return tuple(np.array(list(map(len, words)), np.int64) for words in (encoder.entry_bytes(a_path), piece_bytes(b_path)))


@functools.lru_cache(maxsize=2)
def _written(n: int) -> list[bytes]:
    """Every id below n followed by a comma, then by a bar, then by a semicolon."""
    return [b"%d%c" % (k, c) for c in b",|;" for k in range(n)]


def coalesce(a_ends: np.ndarray, b_ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The group of every A and B token; ends ascend, and tokens of either side follow one another without a gap."""
    ends = np.concatenate([a_ends, b_ends])
    starts = np.concatenate([np.r_[0, a_ends[:-1]], np.r_[0, b_ends[:-1]]]) if len(ends) else ends
    order = np.lexsort((ends, starts))
    reached = np.maximum.accumulate(ends[order])
    group = np.empty(len(ends), np.int64)
    group[order] = np.cumsum(np.r_[0, starts[order][1:] >= reached[:-1]]) if len(ends) else []
    return group[: len(a_ends)], group[len(a_ends) :]


def overlaps(a_ends: np.ndarray, b_ends: np.ndarray, a_group: np.ndarray, b_group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All overlapping pairs of tokens, as indices, expanded within their groups."""
    if not len(a_ends):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    a_starts, b_starts = np.r_[0, a_ends[:-1]], np.r_[0, b_ends[:-1]]
    inside = np.searchsorted(b_group, np.arange(a_group[-1] + 2))  # where each group's B tokens begin
    low = np.maximum(np.searchsorted(b_ends, a_starts, "right"), inside[a_group])
    high = np.minimum(np.searchsorted(b_starts, a_ends, "left"), inside[a_group + 1])
    times = high - low
    a = np.repeat(np.arange(len(a_ends)), times)
    b = np.arange(len(a)) - np.repeat(np.cumsum(times) - times, times) + np.repeat(low, times)
    return a, b


def tokens(texts: list[str], a_path: str, b_path: str, fast: bool) -> list[tuple[np.ndarray, np.ndarray] | None]:
    """A and B ids of each text, None where there are none or they don't spell the space and the text."""
    a_words, b_words, out = encoder.entry_bytes(a_path), piece_bytes(b_path), []
    own = pieces_of(b_path)
    for text in texts:
        if not text:
            out.append(None)
            continue
        whole = " " + text
        given = whole.encode()
        b = own.encode(text)
        if b"".join(map(b_words.__getitem__, b)) != given:
            out.append(None)
            continue
        a = encoder.encode(whole, a_path, fast, specials=False)
        out.append((a.astype(np.int64), np.array(b, np.int64)) if b"".join(map(a_words.__getitem__, a.tolist())) == given else None)
    return out


def aligned(found: list[tuple[np.ndarray, np.ndarray] | None], a_path: str, b_path: str, expand: bool = False) -> list[dict]:
    """Groups and links of each text of a batch; expand: the groups themselves too."""
    pairs, (a_sizes, b_sizes) = pairs_of(a_path, b_path), _sizes(a_path, b_path)
    here = [x for x in found if x]
    a = np.concatenate([x[0] for x in here]) if here else np.empty(0, np.int64)
    b = np.concatenate([x[1] for x in here]) if here else np.empty(0, np.int64)
    a_ends, b_ends = np.cumsum(a_sizes[a]), np.cumsum(b_sizes[b])
    a_group, b_group = coalesce(a_ends, b_ends)
    i, j = overlaps(a_ends, b_ends, a_group, b_group)
    together = a_ends[i] == b_ends[j]
    i, j = i[together], j[together]
    code = pairs.number(a[i], b[j])
    groups = int(a_group[-1]) + 1 if len(a_group) else 0
    # groups in order, each group's A ids before its B ids, every id with the mark that follows it
    n_a, n_b = np.bincount(a_group, minlength=groups), np.bincount(b_group, minlength=groups)
    line = np.empty(len(a) + len(b), np.int64)
    written = _written(max(len(a_sizes), len(b_sizes)))
    third = len(written) // 3
    last = lambda g: np.r_[g[1:] != g[:-1], True] if len(g) else np.empty(0, bool)
    line[np.arange(len(a)) + (np.cumsum(n_b) - n_b)[a_group]] = a + third * last(a_group)
    line[np.arange(len(b)) + np.cumsum(n_a)[b_group]] = b + 2 * third * last(b_group)
    out, at, bt, lt, gt = [], 0, 0, 0, 0
    for x in found:
        if not x:
            out.append({"n_a": 0, "n_b": 0, "n_groups": 0, "links": b"", "groups_sha256": "", "groups": []})
            continue
        ae, be = at + len(x[0]), bt + len(x[1])
        le, ge = int(np.searchsorted(i, ae)), int(a_group[ae - 1]) + 1
        text = b"".join(map(written.__getitem__, line[at + bt : ae + be].tolist()))[:-1]
        row = {"n_a": ae - at, "n_b": be - bt, "n_groups": ge - gt, "links": code[lt:le].tobytes(), "groups_sha256": hashlib.sha256(text).hexdigest()}
        if expand:
            row["groups"] = [{"a": list(map(int, p.split(b","))), "b": list(map(int, q.split(b",")))} for p, q in (g.split(b"|") for g in text.split(b";"))]
        out.append(row)
        at, bt, lt, gt = ae, be, le, ge
    return out


#: Bytes of text that are aligned at once (a text by itself can be longer).
AT_ONCE = 1 << 20


def linked(docs: DataFrame, a_path: str, b_path: str, text: str = "text", with_groups: bool = False) -> DataFrame:
    """row, n_a, n_b, n_groups, groups_sha256, links (numbers of id pairs, as 32-bit integers in a binary) and, if asked for, groups. Narrow."""
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != text]).alias("row"), F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).alias("text"))
    fast = encoder.by_rank(a_path)
    ids = T.ArrayType(T.IntegerType())
    plain = [*((c, T.LongType()) for c in ("n_a", "n_b", "n_groups")), ("groups_sha256", T.StringType()), ("links", T.BinaryType()), *[("groups", T.ArrayType(T.StructType([T.StructField("a", ids), T.StructField("b", ids)])))] * with_groups]
    schema = T.StructType([packed.schema["row"], *[T.StructField(n, t) for n, t in plain]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        kinds = to_arrow_schema(schema)
        for batch in batches:
            texts, start = batch.column(1).to_pylist(), 0
            while start < len(texts):
                stop, held = start, 0
                while stop < len(texts) and (stop == start or held + len(texts[stop]) <= AT_ONCE):
                    held += len(texts[stop])
                    stop += 1
                rows = aligned(tokens(texts[start:stop], a_path, b_path, fast), a_path, b_path, with_groups)
                columns = [pa.array([r[f.name] for r in rows], f.type) for f in list(kinds)[1:]]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(start, stop - start), *columns], names=schema.fieldNames())
                start = stop

    return packed.mapInArrow(run, schema)


def pair_counts(links: DataFrame, n_pairs: int) -> DataFrame:
    """pair, n: how many links of all documents hold each pair. One flat array a task, one row a pair that it has seen."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        flat = np.zeros(n_pairs, np.int64)
        for batch in batches:
            for value in batch.column(0):
                flat += np.bincount(np.frombuffer(value.as_py(), np.int32), minlength=n_pairs)
        seen = np.flatnonzero(flat)
        for k in range(0, len(seen), 1 << 16):
            part = seen[k : k + (1 << 16)]
            yield pa.RecordBatch.from_arrays([pa.array(part.astype(np.int32)), pa.array(flat[part])], names=["pair", "n"])

    return links.select("links").mapInArrow(run, "pair int, n long").groupBy("pair").agg(F.sum("n").alias("n"))


def align(docs: DataFrame, a_path: str, b_path: str, text: str = "text", with_groups: bool = False) -> DataFrame:
    """All columns of ``docs`` but the text in ``row``, with n_a, n_b, n_groups, n_links, n_best, count_sum and groups_sha256 beside it."""
    spark = docs.sparkSession
    folder = shared_folder(spark, "links")
    discard_at_exit(folder)
    linked(docs, a_path, b_path, text, with_groups).write.option("compression", "zstd").parquet(folder)
    kept = spark.read.parquet(folder)
    pairs = pairs_of(a_path, b_path)
    count = np.zeros(len(pairs), np.int64)
    found = pair_counts(kept, len(pairs)).toArrow()  # at most a row for each pair that the vocabularies allow
    count[found.column("pair").to_numpy()] = found.column("n").to_numpy()
    highest = np.zeros(pairs.width, np.int64)
    np.maximum.at(highest, pairs.keys % pairs.width, count)
    best = count == highest[pairs.keys % pairs.width]
    shared = spark.sparkContext.broadcast((count, best))
    rest = ["n_a", "n_b", "n_groups", "groups_sha256", *["groups"] * with_groups]
    chosen = kept.select("row", *rest, "links")
    added = ["n_links", "n_best", "count_sum"]
    schema = T.StructType([*chosen.schema.fields[:-1], *[T.StructField(c, T.LongType()) for c in added]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, bests = shared.value
        for batch in batches:
            codes = [np.frombuffer(value.as_py(), np.int32) for value in batch.column(batch.num_columns - 1)]
            columns = [[len(c) for c in codes], [int(bests[c].sum()) for c in codes], [int(counts[c].sum()) for c in codes]]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *[pa.array(c, pa.int64()) for c in columns]], names=schema.fieldNames())

    return chosen.mapInArrow(run, schema)
