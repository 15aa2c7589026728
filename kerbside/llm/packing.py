"""Documents packed into as few token sequences as possible: dominance reduction, then best fit.

A document's ids, closed by a separator, are one piece, or if they are longer
than a sequence, full pieces after a first one with what is left over. What
packing decides depends on lengths alone, and there are at most as many as a
sequence has tokens: so the instance is a histogram of that size, whatever the
corpus, and it is solved exactly as if every piece stood in it by itself.

``reduce`` is Martello and Toth's reduction: for a piece j, a set of j and at
most two others that dominates every other set which can hold j is fixed for
good (a sequence that some optimal packing has, so no sequence is lost); copies
are fixed together while the decision cannot change. ``best_fit`` packs what is
left, longest first, each piece into the fullest sequence that takes it.

Pieces are numbered within their length by task and place in it (counted while
they are encoded; one sum a task and length is all that meets), and look up
their sequence and offset in the solution, whose size is bounded by the lengths.
No piece but through its own task, no sequence is gathered.

Null text counts as empty: its separator alone. Rows that repeat are packed one
by one; pieces of equal length are interchangeable, so ties don't matter. An
empty table gives an empty result. Other columns come back in a struct ``row``.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kerbside.llm import encoder
from kerbside.runtime import cut

CAPACITY, SEPARATOR = 1024, 2
#: A solution: (lengths and copies in a sequence, sequences of this make).
Pattern = tuple[tuple[tuple[int, int], ...], int]


def dominating(count: np.ndarray, j: int) -> tuple[int, ...] | None:
    """The set with a piece of length j, of at most three pieces, that dominates all others that can hold it; None if none is proven."""
    capacity = len(count) - 1
    room = capacity - j
    count[j] -= 1
    here = np.flatnonzero(count[: room + 1])
    try:
        if not len(here):
            return (j,)
        widest = int(here[-1])
        least: list[int] = []
        for s in here[:3].tolist():
            least += [s] * min(int(count[s]), 3 - len(least))
        if widest == room or len(least) < 2 or least[0] + least[1] > room:
            return (j, widest)
        if len(least) > 2 and sum(least[:3]) <= room:
            return None
        # at most two more fit: the pair with the largest sum, by two pointers
        best, low, high = (0, 0), 0, len(here) - 1
        while low <= high:
            a, b = int(here[high]), int(here[low])
            if a + b > room or (a == b and count[a] < 2):
                high -= 1
                continue
            if a + b > sum(best):
                best = (a, b)
            low += 1
        a, b = best
        if widest >= a + b:
            return (j, widest)
        above = here[here > b]
        two = [s for s in above[:2].tolist() for _ in range(min(2, int(count[s])))][:2]
        if a == widest and (len(two) < 2 or sum(two) > room):
            return (j, a, b)
        return None
    finally:
        count[j] += 1


def reduce(count: np.ndarray) -> list[Pattern]:
    """Fixes sets until none is proven to dominate; ``count`` (pieces by length, 0 .. capacity) keeps what is left."""
    fixed: list[Pattern] = []
    changed = True
    while changed:
        changed = False
        for j in np.flatnonzero(count)[::-1].tolist():
            while count[j]:
                found = dominating(count, j)
                if found is None:
                    break
                parts = {s: found.count(s) for s in found}
                if len(found) == 1 or sum(found) == len(count) - 1 and len(found) == 2:
                    copies = min(int(count[s]) // n for s, n in parts.items())  # alone or a perfect pair: as long as there are some
                else:
                    copies = max(1, min((int(count[s]) - 5) // n for s, n in parts.items()))  # the decision sees at most four copies of a length
                for s, n in parts.items():
                    count[s] -= n * copies
                fixed.append((tuple(sorted(parts.items(), reverse=True)), copies))
                changed = True
    return fixed


def best_fit(count: np.ndarray) -> list[Pattern]:
    """Best fit, longest first, of all pieces in ``count``; sequences of one make are kept as one group."""
    capacity = len(count) - 1
    open_: list[list[Pattern]] = [[] for _ in range(capacity + 1)]
    for w in np.flatnonzero(count)[::-1].tolist():
        n = int(count[w])
        for room in range(w, capacity + 1):
            if not n:
                break
            groups, open_[room] = open_[room], []
            times = room // w
            for k, (parts, bins) in enumerate(groups):
                full = min(bins, n // times)
                if full:
                    open_[room - times * w].append(((*parts, (w, times)), full))
                n -= full * times
                bins -= full
                if bins and n:
                    open_[room - n * w].append(((*parts, (w, n)), 1))
                    n, bins = 0, bins - 1
                if bins:
                    open_[room].append((parts, bins))
                if not n:
                    open_[room] += groups[k + 1 :]
                    break
        times = capacity // w
        if n // times:
            open_[capacity - times * w].append((((w, times),), n // times))
        if n % times:
            open_[capacity - n % times * w].append((((w, n % times),), 1))
    return [g for groups in open_ for g in groups]


def solve(count: np.ndarray) -> list[Pattern]:
    """A packing of all pieces, ``count`` by length."""
    left = count.astype(np.int64).copy()
    left[0] = 0
    fixed = reduce(left)
    return fixed + best_fit(left)


def slots(patterns: list[Pattern], capacity: int) -> dict[str, np.ndarray]:
    """For a piece's length and number among those of its length: the run of slots it falls in, as sorted arrays."""
    used = [0] * (capacity + 1)
    rows: list[tuple[int, int, int, int, int]] = []
    sequence = 0
    for parts, bins in patterns:
        offset = 0
        for length, times in parts:
            rows.append((length, used[length], times, sequence, offset))
            used[length] += times * bins
            offset += length * times
        sequence += bins
    rows.sort()
    columns = np.array(rows, np.int64).reshape(-1, 5).T
    return dict(zip(("length", "first", "times", "sequence", "offset"), columns, strict=True))


def place(found: dict[str, np.ndarray], length: np.ndarray, number: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sequence and offset of pieces."""
    at = np.searchsorted((found["length"] << 44) + found["first"], (length << 44) + number, "right") - 1
    past = number - found["first"][at]
    times = found["times"][at]
    return found["sequence"][at] + past // times, found["offset"][at] + past % times * length


def pieces(docs: DataFrame, tokenizer: str, text: str = "text", capacity: int = CAPACITY, separator: int = SEPARATOR, with_ids: bool = False) -> DataFrame:
    """row, piece, start, length, ids_crc32, and its number among the pieces of its task (``part``) and length; ids if asked for."""
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != text]).alias("row"), F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).alias("text"))
    fast = encoder.by_rank(tokenizer)
    fields = [("piece", T.IntegerType()), ("start", T.LongType()), ("length", T.LongType()), ("ids_crc32", T.LongType()), ("part", T.IntegerType()), ("number", T.LongType())]
    schema = T.StructType([packed.schema["row"], *[T.StructField(n, t) for n, t in fields], *([T.StructField("ids", T.ArrayType(T.LongType()))] if with_ids else [])])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seen = TaskContext.get().partitionId(), [0] * (capacity + 1)
        for batch in batches:
            of, rows, held = [], [], []
            for k, value in enumerate(batch.column(1)):
                ids = np.append(encoder.encode(value.as_py(), tokenizer, fast), np.uint32(separator)).astype("<u4", copy=False)
                first = len(ids) % capacity or capacity
                stops = [min(first, len(ids)), *range(first + capacity, len(ids) + 1, capacity)]
                start = 0
                for piece, stop in enumerate(stops):
                    size = stop - start
                    of.append(k)
                    rows.append((piece, start, size, zlib.crc32(ids[start:stop].tobytes()), part, seen[size]))
                    if with_ids:
                        held.append(ids[start:stop].astype(np.int64))
                    seen[size] += 1
                    start = stop
            columns = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64()), strict=True)] if rows else []
            if rows:
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(of)), *columns, *([pa.array(held, pa.list_(pa.int64()))] if with_ids else [])], names=[f.name for f in schema.fields])

    return packed.mapInArrow(run, schema)


def pack(docs: DataFrame, tokenizer: str, text: str = "text", capacity: int = CAPACITY, separator: int = SEPARATOR, with_ids: bool = False) -> DataFrame:
    """One row per piece: row, piece, start, length, ids_crc32, sequence_id, offset (and ids if asked for)."""
    cut_up = cut(pieces(docs, tokenizer, text, capacity, separator, with_ids))
    tally = cut_up.groupBy("part", "length").agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    tally = cut(tally.select("part", "length", "n", before.alias("before")))
    count = np.zeros(capacity + 1, np.int64)
    for length, n in tally.groupBy("length").agg(F.sum("n")).collect():  # no more rows than a sequence has tokens
        count[length] = n
    found = slots(solve(count), capacity)
    numbered = cut_up.join(tally, ["part", "length"]).withColumn("number", F.col("number") + F.col("before")).select("row", "piece", "start", "length", "ids_crc32", *(["ids"] if with_ids else []), "number")
    schema = T.StructType([*numbered.schema.fields[:-1], T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sequence, offset = place(found, batch.column("length").to_numpy(), batch.column("number").to_numpy())
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(sequence), pa.array(offset)], names=schema.fieldNames())

    return numbered.mapInArrow(run, schema)


def sequences(packed: DataFrame) -> DataFrame:
    """The packed sequences themselves (``packed`` with ids): sequence_id, ids, and the pieces in order. A sequence has no more pieces than tokens."""
    inside = F.array_sort(F.collect_list(F.struct("offset", "row", "piece", "ids")), lambda a, b: F.signum(a["offset"] - b["offset"]).cast("int")).alias("inside")
    found = packed.groupBy("sequence_id").agg(inside)
    return found.select("sequence_id", F.flatten("inside.ids").alias("ids"), F.transform("inside", lambda x: F.struct(x["row"].alias("row"), x["piece"].alias("piece"), x["offset"].alias("offset"))).alias("pieces"))
