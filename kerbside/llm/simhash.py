"""Near-duplicate documents by SimHash and meet-in-the-middle ball hashing.

A document's 64-bit fingerprint is the bitwise majority of the XXH64 hashes of
its four-word shingles. Two fingerprints link when at most ``RADIUS`` = 4 bits
differ. If they do, one of the two 32-bit halves differs in at most 2, and there
they meet in the middle: every distinct fingerprint emits, for each half, all
variants within half of that radius (1 + 32 of them), rows are dealt by variant,
and colliding pairs are verified on all 64 bits, once each way they collide.

Comparison happens within a task, which puts out only the links that connect what
it has not connected yet, so no group of copies becomes a table of pairs. A
variant at which more than ``CROWD`` fingerprints meet is not compared in pairs
at all. Its fingerprints emit the whole ball instead, all 2,081 variants within 2
bits of the 64: any two that meet at one of these are within 4 bits for certain,
and any two within 4 bits meet, so each is tied to the smallest one there and no
pair is formed. Both ways are exact; together no link is lost.

The whole ball for every fingerprint would multiply the rows by 2,081 instead of
66; ``whole_ball=True`` does so.

Null text counts as empty; a text without words has fingerprint zero and links
like any other. Rows that repeat share a fingerprint. Documents with a null id
get a fingerprint and the component of their group.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kerbside.llm.components import components
from kerbside.runtime import cut

WORDS, SEED, RADIUS, CROWD = 4, 42, 4, 1024
#: Fingerprints at one variant up to which pairs are compared for many variants at once.
FEW = 8
#: Shingles hashed before they are added up.
STEP = 1 << 15
#: Fingerprints whose ties a task remembers, so as not to repeat what is connected already.
KNOWN = 200_000


def fingerprint(text: str | None) -> int:
    """The unsigned fingerprint of a whole text."""
    words = (text or "").encode("utf-8").lower().split()  # bytes: only A-Z are lowered, only ASCII white space splits
    if not words:
        return 0
    digest = xxhash.xxh64_intdigest
    if len(words) < WORDS:
        return digest(b" ".join(words), SEED)
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.r_[0, ends[: -WORDS] + 1].tolist()
    ends = ends[WORDS - 1 :].tolist()
    total = np.zeros(64, np.int64)
    for lo in range(0, len(starts), STEP):
        hashes = np.array([digest(joined[a:b], SEED) for a, b in zip(starts[lo : lo + STEP], ends[lo : lo + STEP], strict=True)], np.uint64)
        total += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int32)
    bits = total * 2 > len(starts)
    return int(np.packbits(bits, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, text: str = "text") -> DataFrame:
    """All columns of ``docs`` but the text in a struct ``row``, with ``fp`` (as a signed long) beside it. Narrow."""
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != text]).alias("row"), F.col(f"`{text}`").cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1)
            found = np.array([fingerprint(texts[k].as_py()) for k in range(len(texts))], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found.view(np.int64))], names=["row", "fp"])

    return packed.mapInArrow(run, f"row {packed.schema['row'].dataType.simpleString()}, fp long")


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _runs(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and lengths of the runs of equal keys."""
    starts = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else np.zeros(0, np.int64)
    return starts, np.diff(np.r_[starts, len(key)])


def meet(variants: DataFrame, crowd: int, certain: bool) -> DataFrame:
    """variants: ``key``, ``fp``. Returns edges a, b; a = b marks a fingerprint that met more than ``crowd`` others.

    One shuffle, dealt by variant and sorted; a task walks its runs of equal
    keys as they stream past and holds at most one batch and ``crowd`` + 1 of a run.
    certain: all that meet are linked, so each goes with the run's first and no
    run counts as crowded.
    """

    def pairs(key: np.ndarray, fp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        starts, lengths = _runs(key)
        size = np.repeat(lengths, lengths)
        first = np.repeat(fp[starts], lengths)
        if certain:
            at = fp != first
            return fp[at], first[at]
        left, right = [fp[size > crowd]], [fp[size > crowd]]
        for at, n in zip(starts[(lengths > FEW) & (lengths <= crowd)].tolist(), lengths[(lengths > FEW) & (lengths <= crowd)].tolist(), strict=True):
            own = fp[at : at + n]
            i, j = np.nonzero(np.triu(np.bitwise_count((own[:, None] ^ own[None, :]).view(np.uint64)) <= RADIUS, 1))
            left.append(own[j])
            right.append(own[i])
        few = min(FEW, crowd)
        small = (size > 1) & (size <= few)
        key, fp = key[small], fp[small]
        for lag in range(1, min(few, len(key))):
            same = key[lag:] == key[:-lag]
            if not same.any():
                break
            x, y = fp[lag:][same], fp[:-lag][same]
            near = np.bitwise_count((x ^ y).view(np.uint64)) <= RADIUS
            left.append(x[near])
            right.append(y[near])
        return np.concatenate(left), np.concatenate(right)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held_key, held_fp = np.zeros(0, np.int64), np.zeros(0, np.int64)
        parent: dict[int, int] = {}

        def find(x: int) -> int:
            while (up := parent.setdefault(x, x)) != x:
                parent[x] = x = parent[up]
            return x

        def news(a: int, b: int) -> bool:
            """Whether a and b were not connected yet by what this task has put out."""
            a, b = find(a), find(b)
            parent[max(a, b)] = min(a, b)
            return a != b

        def out(a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
            both = np.unique(np.stack([a, b], 1), axis=0) if len(a) else np.zeros((0, 2), np.int64)
            if len(parent) > KNOWN:
                parent.clear()
            if len(both):
                both = both[np.array([x == y or news(x, y) for x, y in both.tolist()], bool)]
            return pa.RecordBatch.from_arrays([pa.array(both[:, 0].copy()), pa.array(both[:, 1].copy())], names=["a", "b"])

        for batch in batches:
            key = np.concatenate([held_key, batch.column(0).to_numpy()])
            fp = np.concatenate([held_fp, batch.column(1).to_numpy()])
            starts, lengths = _runs(key)
            if not len(starts):
                continue
            last = starts[-1]
            done = pairs(key[:last], fp[:last])
            held_key, held_fp = key[last:], fp[last:]
            if len(held_fp) > crowd + 1 or certain:
                # enough of this run is known: what has come goes out, its head stays for what follows
                more = pairs(held_key, held_fp)
                done = tuple(np.concatenate(p) for p in zip(done, more, strict=True))
                held_key, held_fp = held_key[: crowd + 1], held_fp[: crowd + 1]
                if certain:
                    held_key, held_fp = held_key[:1], held_fp[:1]
            yield out(*done)
        yield out(*pairs(held_key, held_fp))

    return variants.repartition("key").sortWithinPartitions("key", "fp").mapInArrow(run, "a long, b long")


def half_ball(fps: DataFrame) -> DataFrame:
    """For each half, its variants within one bit, marked by the half in bit 32."""
    masks = F.array(F.lit(0).cast("long"), *[F.lit(1 << k).cast("long") for k in range(32)])
    low = F.col("fp").bitwiseAND(F.lit((1 << 32) - 1))
    high = F.shiftrightunsigned("fp", 32)
    return fps.select("fp", F.explode(masks).alias("m")).select(F.explode(F.array(low.bitwiseXOR(F.col("m")), high.bitwiseXOR(F.col("m")).bitwiseOR(F.lit(1 << 32)))).alias("key"), "fp")


def full_ball(fps: DataFrame) -> DataFrame:
    """All 2,081 variants within two bits of the 64."""
    single = F.array(F.lit(0).cast("long"), *[F.lit(_signed(1 << k)).cast("long") for k in range(64)])
    first = fps.select("fp", F.posexplode(single).alias("i", "m"))
    # no flip, or any flip with no second one or a lower one: 1 + 64 + 2016
    second = first.select("fp", "m", F.explode(F.slice(single, 1, F.greatest("i", F.lit(1)))).alias("n"))
    return second.select(F.col("fp").bitwiseXOR(F.col("m")).bitwiseXOR(F.col("n")).alias("key"), "fp")


def links(fps: DataFrame, crowd: int = CROWD, whole_ball: bool = False) -> DataFrame:
    """Edges that connect what is within RADIUS, over distinct fingerprints ``fp``."""
    if whole_ball:
        return meet(full_ball(fps), 0, certain=True)
    found = cut(meet(half_ball(fps), crowd, certain=False))
    crowded = found.where("a = b").select(F.col("a").alias("fp")).distinct()
    return found.where("a <> b").unionByName(meet(full_ball(crowded), 0, certain=True))


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """``row`` (key and the columns named in ``keep``), fp, component_id (the smallest key reachable, itself included) and root, the group's smallest fingerprint."""
    names = list(dict.fromkeys([key, *(keep or [])]))
    marked = cut(fingerprints(docs.select(*names, *([text] if text not in names else [])), text))
    first = cut(marked.groupBy("fp").agg(F.min(f"row.{key}").alias("low")))
    roots = components(links(first.select("fp")))
    of = first.join(roots, first["fp"] == roots["node"], "left").select("fp", "low", F.coalesce("component", "fp").alias("root"))
    low = of.groupBy("root").agg(F.min("low").alias("component_id"))
    named = of.join(low, "root").select(F.col("fp").alias("of"), "component_id", "root")
    return marked.join(named, F.col("fp") == F.col("of")).select("row", "fp", "component_id", "root")


def one_of_each(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs`` of which one stays for each group of near duplicates: that with the smallest key, then hash of the text."""
    own = docs.select(F.col(f"`{key}`").alias("key"), F.col(f"`{text}`").cast("string").alias("text"), F.xxhash64(F.col(f"`{text}`").cast("string")).alias("tk"))
    found = near_duplicates(own, "key", "text", ["tk"])
    stay = cut(found.groupBy("root").agg(F.min(F.struct("row.key", "row.tk")).alias("s")).select("s.*"))
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(f"`{key}`").alias("k"), F.xxhash64(F.col(f"`{text}`").cast("string")).alias("t"))
    rows = rows.join(stay, F.col("k").eqNullSafe(F.col("key")) & (F.col("t") == F.col("tk")), "left_semi")
    # rows that repeat key and text are one document: the one with the smallest hash of all its columns stays
    first = rows.groupBy("k", "t").agg(F.min_by("row", F.xxhash64("row")).alias("row"))
    return first.select("row.*")


def hexed(fp: str = "fp"):
    return F.lpad(F.lower(F.hex(fp)), 16, "0")
