"""Near-duplicate vectors by an epsilon grid order join.

Unit vectors with a cosine of at least t lie within eps = sqrt(2 - 2 t) of each
other. They are rotated to principal axes (fitted on all vectors; any rotation
keeps distances), and the leading coordinates divided by eps give each vector a
grid cell. Sorting by cells puts the vectors of a group into one sequence, which
is cut into blocks of ``BLOCK`` vectors. The join then goes down a tree of
sequence intervals: a pair of intervals whose bounding boxes (leading
coordinates, and the norm of the rest) are more than eps apart is dropped with
all below it; what is left at the leaves is compared exactly, block by block, in
double precision. Equal vectors are compared once.

A pair of blocks gives at most one row per vector: how many it links with there
and the smallest id of its component within the pair. Counts add up; the
component ids are edges for the distributed union-find. No pair of vectors is
ever a row.

Only vectors of equal, non-null label and equal length are compared. Vectors
that are null, zero, or hold a null or non-finite component link with nothing;
nor does a row with a null id, whose component is null and kept false. Ids can be
of any orderable type. Rows that share an id and a vector are copies, linked with
each other; rows that share an id only are vectors of their own. An empty table
gives an empty result; columns other than id, vector and label are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kerbside.llm.components import components
from kerbside.runtime import cut

THRESHOLD = 0.93
BLOCK, LEADING, FANOUT_BITS = 512, 6, 3
#: Vectors longer than this are not rotated: their first coordinates serve as they are.
WIDEST = 2048


def _unit(values: np.ndarray) -> np.ndarray:
    x = values.astype(np.float64)
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def _matrix(column: pa.Array) -> np.ndarray:
    """Rows of one list column of equal lengths, empty batches included."""
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 1)


def classes(vectors: DataFrame, key: str, embedding: str, label: str) -> DataFrame:
    """One row per distinct comparable vector of a label: g_label, g_vec, low (smallest id), times, node (64-bit hash of label and vector)."""
    v = F.col(f"`{embedding}`")
    sound = ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists(v, lambda x: x != 0)
    rows = vectors.where(F.col(f"`{label}`").isNotNull() & F.col(f"`{key}`").isNotNull() & v.isNotNull() & F.coalesce(sound, F.lit(False)))
    return rows.groupBy(F.col(f"`{label}`").alias("g_label"), v.alias("g_vec")).agg(F.min(f"`{key}`").alias("low"), F.count("*").alias("times")).withColumn("node", F.xxhash64("g_label", "g_vec"))


def axes(distinct: DataFrame) -> dict[int, np.ndarray]:
    """Principal axes by vector length, from the second moments of all vectors.

    Sums are formed per partition, then in eight tasks; the driver gets at most
    eight matrices per length.
    """

    def moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            column = batch.column(0)
            lengths = np.asarray(pa.compute.list_value_length(column).fill_null(0))
            for d in np.unique(lengths[lengths <= WIDEST]):
                x = _unit(_matrix(column.take(pa.array(np.flatnonzero(lengths == d)))))
                sums[int(d)] = sums.get(int(d), 0) + x.T @ x
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([m.tobytes() for m in sums.values()], pa.binary())], names=["d", "m"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for d, m in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                sums[d] = sums.get(d, 0) + np.frombuffer(m)
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([m.tobytes() for m in sums.values()], pa.binary())], names=["d", "m"])

    import pyarrow.compute  # noqa: F401

    total: dict[int, np.ndarray] = {}
    for r in distinct.select("g_vec").mapInArrow(moments, "d int, m binary").repartition(8).mapInArrow(add, "d int, m binary").collect():
        total[r["d"]] = total.get(r["d"], 0) + np.frombuffer(bytes(r["m"])).reshape(r["d"], r["d"])
    return {d: np.linalg.eigh(m)[1][:, ::-1][:, :LEADING].copy() for d, m in total.items()}


def blocks(distinct: DataFrame, basis: dict[int, np.ndarray], eps: float, block: int) -> DataFrame:
    """The sorted sequence of each group in blocks: grp, seq, lo, hi, ids, times, vecs (raw components), count."""
    kind = "float" if distinct.schema["g_vec"].dataType.elementType.simpleString() == "float" else "double"
    dtype = np.float32 if kind == "float" else np.float64

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(1)
            lengths = np.asarray(pa.compute.list_value_length(column))
            lead = np.zeros((batch.num_rows, LEADING + 1))
            for d in np.unique(lengths):
                at = np.flatnonzero(lengths == d)
                x = _unit(_matrix(column.take(pa.array(at))))
                y = x @ basis[int(d)] if int(d) in basis else x[:, :LEADING]
                lead[at, : y.shape[1]] = y
                lead[at, LEADING] = np.sqrt(np.maximum(0, 1 - (y * y).sum(1)))
            cells = np.floor(lead / eps).astype(np.int32)
            raw = [np.asarray(column[k].values, dtype).tobytes() for k in range(len(column))]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([f"{g}/{d}" for g, d in zip(batch.column(0).to_pylist(), lengths, strict=True)], pa.string()),
                    pa.FixedSizeListArray.from_arrays(pa.array(cells.ravel()), LEADING + 1).cast(pa.list_(pa.int32())),
                    pa.FixedSizeListArray.from_arrays(pa.array(lead.ravel()), LEADING + 1).cast(pa.list_(pa.float64())),
                    batch.column(2),
                    batch.column(3),
                    pa.array(raw, pa.binary()),
                ],
                names=["grp", "cells", "lead", "node", "times", "vec"],
            )

    import pyarrow.compute  # noqa: F401

    node = distinct.schema["node"].dataType.simpleString()
    placed = distinct.select(F.col("g_label").cast("string").alias("g"), F.col("g_vec").cast(f"array<{kind}>").alias("v"), "node", "times").mapInArrow(place, f"grp string, cells array<int>, lead array<double>, node {node}, times long, vec binary")
    order = ["grp", "cells", "lead", "node"]
    parts = max(1, int(distinct.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    sequence = placed.repartitionByRange(parts, *order).sortWithinPartitions(*order)

    def chunk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        number = 0

        def out() -> pa.RecordBatch:
            nonlocal held, number
            lead = np.array([r[1] for r in held])
            row = {"grp": held[0][0], "idx": number, "lo": lead.min(0).tolist(), "hi": lead.max(0).tolist(), "ids": [r[2] for r in held], "times": [r[3] for r in held], "vecs": b"".join(r[4] for r in held)}
            held, number = [], number + 1
            return pa.RecordBatch.from_pylist([row], schema=shape)

        ids = None
        for batch in batches:
            ids = ids or batch.schema.field("node").type
            shape = pa.schema([("grp", pa.string()), ("idx", pa.int32()), ("lo", pa.list_(pa.float64())), ("hi", pa.list_(pa.float64())), ("ids", pa.list_(ids)), ("times", pa.list_(pa.int64())), ("vecs", pa.binary())])
            for row in zip(*[batch.column(c).to_pylist() for c in ("grp", "lead", "node", "times", "vec")], strict=True):
                if held and (len(held) >= block or row[0] != held[0][0]):
                    yield out()
                held.append(row)
        if held:
            yield out()

    cutup = sequence.select("grp", "lead", "node", "times", "vec").mapInArrow(chunk, f"grp string, idx int, lo array<double>, hi array<double>, ids array<{node}>, times array<long>, vecs binary")
    cutup = cut(cutup.withColumn("part", F.spark_partition_id()))
    # numbered by metadata only: one row per block
    seq = cutup.select("grp", "part", "idx").withColumn("seq", F.row_number().over(Window.partitionBy("grp").orderBy("part", "idx")) - 1)
    return cutup.join(seq, ["grp", "part", "idx"]).drop("part", "idx")


def near_pairs(boxes: DataFrame, eps: float) -> DataFrame:
    """Pairs of block numbers (grp, a <= b) that may hold links, by descent through the tree of sequence intervals."""
    last = boxes.agg(F.max("seq")).first()[0]
    if last is None:
        last = 0
    depth = max(1, math.ceil(math.log(last + 1, 1 << FANOUT_BITS) - 1e-9)) if last else 1
    pairs = boxes.select("grp").distinct().select("grp", F.lit(0).cast("long").alias("a"), F.lit(0).cast("long").alias("b"))
    wide = range(LEADING + 1)
    for level in reversed(range(depth)):
        n = F.shiftright(F.col("seq").cast("long"), FANOUT_BITS * level)
        nodes = boxes.groupBy("grp", n.alias("n")).agg(*[F.min(F.col("lo")[k]).alias(f"lo{k}") for k in wide], *[F.max(F.col("hi")[k]).alias(f"hi{k}") for k in wide])
        x, y = nodes.alias("x"), nodes.alias("y")
        up = FANOUT_BITS
        far = sum((F.pow(F.greatest(F.col(f"x.lo{k}") - F.col(f"y.hi{k}"), F.col(f"y.lo{k}") - F.col(f"x.hi{k}"), F.lit(0.0)), 2) for k in wide), F.lit(0.0))
        joined = pairs.alias("p").join(x, (F.col("p.grp") == F.col("x.grp")) & (F.col("p.a") == F.shiftright(F.col("x.n"), up)))
        joined = joined.join(y, (F.col("p.grp") == F.col("y.grp")) & (F.col("p.b") == F.shiftright(F.col("y.n"), up)))
        pairs = joined.where((F.col("x.n") <= F.col("y.n")) & (far <= eps * eps)).select(F.col("p.grp").alias("grp"), F.col("x.n").alias("a"), F.col("y.n").alias("b"))
        pairs = cut(pairs)
    return pairs


def compare(ids_a, times_a, a: np.ndarray, ids_b, times_b, b: np.ndarray, same: bool, threshold: float):
    """Links between two blocks: (id, links, smallest id of its component here) for each vector that has any."""
    ua, ub = _unit(a), _unit(b)
    close = ua @ ub.T
    hit = close >= threshold
    # what is near the threshold is settled by the cosine's own formula
    for i, j in zip(*np.nonzero(np.abs(close - threshold) < 1e-9), strict=True):
        p, q = a[i].astype(np.float64), b[j].astype(np.float64)
        hit[i, j] = p @ q / (np.sqrt(p @ p) * np.sqrt(q @ q)) >= threshold
    if same:
        np.fill_diagonal(hit, False)
        hit |= hit.T
    rows, cols = np.flatnonzero(hit.any(1)), np.flatnonzero(hit.any(0))
    if not len(rows):
        return []
    hit = hit[np.ix_(rows, cols)]
    ia, ib = np.array(ids_a)[rows], np.array(ids_b)[cols]
    la, lb = ia.copy(), ib.copy()
    top = np.iinfo(np.int64).max
    while True:
        na = np.minimum(la, np.where(hit, lb[None, :], top).min(1))
        nb = np.minimum(lb, np.where(hit, na[:, None], top).min(0))
        if same:  # the same vectors stand on both sides
            na = nb = np.minimum(na, nb)
        if (na == la).all() and (nb == lb).all():
            break
        la, lb = na, nb
    found = list(zip(ia.tolist(), (hit @ np.array(times_b)[cols]).tolist(), la.tolist(), strict=True))
    if not same:
        found += zip(ib.tolist(), (hit.T @ np.array(times_a)[rows]).tolist(), lb.tolist(), strict=True)
    return found


def near_duplicates(vectors: DataFrame, key: str = "vec_id", embedding: str = "embedding", label: str = "label", threshold: float = THRESHOLD, block: int = BLOCK) -> DataFrame:
    """One row per row of ``vectors``: key, n_links, component_id, kept."""
    eps = math.sqrt(2 - 2 * threshold) + 1e-9
    distinct = cut(classes(vectors, key, embedding, label))
    laid = cut(blocks(distinct, axes(distinct), eps, block))
    pairs = near_pairs(laid.select("grp", "seq", "lo", "hi"), eps)
    dtype = np.float32 if distinct.schema["g_vec"].dataType.elementType.simpleString() == "float" else np.float64
    data = laid.select("grp", "seq", "ids", "times", "vecs")
    tiles = pairs.join(data.toDF("grp", "a", "ids_a", "times_a", "vecs_a"), ["grp", "a"]).join(data.toDF("grp", "b", "ids_b", "times_b", "vecs_b"), ["grp", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                own, a, b, ids_a, times_a, vecs_a, ids_b, times_b, vecs_b = (batch.column(c)[k].as_py() for c in range(9))
                xa, xb = np.frombuffer(vecs_a, dtype).reshape(len(ids_a), -1), np.frombuffer(vecs_b, dtype).reshape(len(ids_b), -1)
                found = compare(ids_a, times_a, xa, ids_b, times_b, xb, a == b, threshold)
                if found:
                    yield pa.RecordBatch.from_arrays([pa.array([f[c] for f in found], pa.int64()) for c in range(3)], names=["node", "n", "low"])

    links = cut(tiles.select("grp", "a", "b", "ids_a", "times_a", "vecs_a", "ids_b", "times_b", "vecs_b").mapInArrow(run, "node long, n long, low long"))
    count = links.groupBy("node").agg(F.sum("n").alias("n"))
    roots = components(links.select("node", F.col("low").alias("other")))
    per_class = distinct.join(count, "node", "left").join(roots, "node", "left")
    per_class = cut(per_class.select("g_label", "g_vec", "low", (F.coalesce("n", F.lit(0)) + F.col("times") - 1).alias("n_links"), F.coalesce("component", F.col("node")).alias("root")))
    lowest = per_class.groupBy("root").agg(F.min("low").alias("least"))
    per_class = per_class.join(lowest, "root").select("g_label", "g_vec", "n_links", "least")
    rows = vectors.select(F.col(f"`{key}`").alias("own_key"), F.col(f"`{embedding}`").alias("own_vec"), F.col(f"`{label}`").alias("own_label"))
    own = F.col("own_key")
    back = rows.join(per_class, (F.col("own_label") == F.col("g_label")) & (F.col("own_vec") == F.col("g_vec")) & own.isNotNull(), "left")
    least = F.coalesce("least", own)
    return back.select(own.alias(key), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), least.alias("component_id"), F.coalesce(own == least, F.lit(False)).alias("kept"))


#: All pairs of a label, for tables whose ids are unique.
ORACLE = """
WITH RECURSIVE
v AS MATERIALIZED (
  SELECT vec_id, label, e, sqrt(list_sum(list_transform(e, lambda x: x * x))) AS n
  FROM (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings)
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND len(e) > 0
    AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
link AS MATERIALIZED (
  SELECT x.vec_id AS a, y.vec_id AS b
  FROM v x JOIN v y ON x.label = y.label AND len(x.e) = len(y.e) AND x.vec_id < y.vec_id
  WHERE x.n > 0 AND y.n > 0 AND list_dot_product(x.e, y.e) / (x.n * y.n) >= 0.93),
way AS (SELECT a, b FROM link UNION ALL SELECT b, a FROM link),
reach AS (
  SELECT DISTINCT a AS id, a AS other FROM way
  UNION SELECT r.id, w.b FROM reach r JOIN way w ON w.a = r.other),
root AS (SELECT id, min(other) AS root FROM reach GROUP BY id),
n AS (SELECT a, count(*) AS n FROM way GROUP BY a)
SELECT e.vec_id, coalesce(n.n, 0) AS n_links, coalesce(root.root, e.vec_id) AS component_id,
  coalesce(coalesce(root.root, e.vec_id) = e.vec_id, false) AS kept
FROM embeddings e LEFT JOIN n ON n.a = e.vec_id LEFT JOIN root ON root.id = e.vec_id
"""
