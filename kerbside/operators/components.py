"""Connected components by distributed union-find: alternating large-star and small-star rounds.

Each round hooks every vertex's neighbours on its smallest neighbour by equi-joins
and partial aggregates; a hub's edges are never gathered, and a large join key is
one that Spark's skew handling can split. Rounds end when the edges no longer
change; the lineage is cut at the shared checkpoint folder after each.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kerbside.runtime import cut


def _mark(e: DataFrame) -> tuple[int, int | None]:
    r = e.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("x")).first()
    return r["n"], r["x"]


def _in_one_task(edges: DataFrame) -> DataFrame:
    """The same for as many edges as one task may hold."""

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        up: dict = {}

        def root(x):
            trail = []
            while up.setdefault(x, x) != x:
                trail.append(x)
                x = up[x]
            for t in trail:
                up[t] = x
            return x

        kind = None
        for batch in batches:
            kind = batch.column(0).type
            for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                low, high = sorted((root(a), root(b)))
                up[high] = low
        nodes = list(up)
        for k in range(0, len(nodes), 1 << 16):
            part = nodes[k : k + (1 << 16)]
            yield pa.RecordBatch.from_arrays([pa.array(part, kind), pa.array([root(x) for x in part], kind)], names=["node", "component"])

    kind = edges.schema.fields[0].dataType
    return edges.coalesce(1).mapInArrow(solve, T.StructType([T.StructField(c, kind) for c in ("node", "component")]))


def components(edges: DataFrame, most_rounds: int = 60, local: int = 0) -> DataFrame:
    """edges: two columns of one orderable type, any direction, repeats and loops allowed; nulls are no edges.

    Returns ``node`` and ``component``, the smallest vertex reachable, for every
    vertex that has an edge to another. No edges give no rows. Up to ``local``
    distinct edges, counted first, go to one task instead of rounds.
    """
    a, b = edges.columns
    e = edges.where(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct()
    e = cut(e)
    mark = _mark(e)
    if mark[0] <= local:
        return _in_one_task(e)
    for _ in range(most_rounds):
        if not mark[0]:
            break
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("k"), F.least("u", "m").alias("m"))
        large = both.where("v > u").join(low, F.col("u") == F.col("k")).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("k"), "m")
        small = large.join(low, F.col("u") == F.col("k"))
        pair = F.when(F.col("v") > F.col("m"), F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct(F.col("u").alias("u"), F.col("m").alias("v")))).otherwise(F.array(F.struct(F.col("u").alias("u"), F.col("m").alias("v"))))
        e = cut(small.select(F.inline(pair)).distinct())
        now = _mark(e)
        if now == mark:
            break
        mark = now
    else:
        raise RuntimeError(f"components did not settle in {most_rounds} rounds")
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
